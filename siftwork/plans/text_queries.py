"""Registered cleaning / text queries (documents, labels, pages) and DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwork.functions import text as T
from siftwork.operators import clean as C
from siftwork.plans import sqlsnips as S
from siftwork.plans.common import finish
from siftwork.sources import fixtures as fx
from siftwork.sources.tables import read_table


def q_papers_clean(spark, sf):
    """Title filter, strip, HTML to text, keep-first dedup, strict label (P-03..P-05, F-01,
    F-02, A-20)."""
    p = C.clean_papers(fx.papers(spark, sf))
    return finish(p.select("id", "title", "abstract", "label"))


def q_paper_text(spark, sf):
    """Title + ' ' + abstract per cleaned paper, with the display label (P-06, P-07)."""
    p = C.join_title_abstract(C.clean_papers(fx.papers(spark, sf)))
    return finish(p.select("id", "text", C.label_display().alias("label_name")))


def q_pages_text(spark, sf):
    """HTML pages to visible text (F-01)."""
    pg = read_table(spark, sf, "pages")
    return pg.select("page_id", T.html_to_text("html").alias("text"))


def q_class_balance(spark, sf):
    """Counts and shares of included / excluded papers (A-01)."""
    return finish(C.class_balance(fx.papers(spark, sf)))


def q_text_fingerprint(spark, sf):
    """Order-free fingerprint of all document texts (A-21, scalable form)."""
    return C.text_fingerprint(read_table(spark, sf, "documents"), "text")


def q_sequence_fingerprint(spark, sf):
    """Order-dependent digest of all document texts by doc_id, and by doc_id descending (A-21)."""
    d = read_table(spark, sf, "documents")
    by_id = C.sequence_fingerprint(d, ["doc_id"]).select(F.lit("doc_id").alias("ordered_by"), "*")
    turned = d.select((-F.col("doc_id")).alias("back"), "text")
    return by_id.unionAll(C.sequence_fingerprint(turned, ["back"]).select(F.lit("doc_id descending").alias("ordered_by"), "*"))


def q_dedup_stats(spark, sf):
    """How many documents survive whitespace/case-insensitive dedup, per language (A-20)."""
    d = read_table(spark, sf, "documents")
    kept = C.dedup_keep_first(d, T.normalise_key("text"), "doc_id")
    a = d.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"))
    b = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("n_unique"))
    return a.join(b, "lang", "left").fillna(0, ["n_unique"])


def q_model_short_names(spark, sf):
    """Short model name after the last '/' and a safe partition name (P-08, F-03)."""
    d = fx.decisions(spark, sf)
    m = d.select("model").distinct()
    return m.select("model", T.short_model_name("model").alias("short_name"),
                    T.safe_name("model").alias("safe_name"))


QUERIES = {
    "papers_clean": q_papers_clean,
    "paper_text": q_paper_text,
    "pages_text": q_pages_text,
    "class_balance": q_class_balance,
    "text_fingerprint": q_text_fingerprint,
    "sequence_fingerprint": q_sequence_fingerprint,
    "dedup_stats": q_dedup_stats,
    "model_short_names": q_model_short_names,
}

_CLEAN = f"""{S.PAPERS},
f AS (SELECT * FROM papers WHERE length(title) > 0),
c AS (SELECT id, {S.html_to_text(S.strip('title'))} AS title,
             {S.html_to_text(S.strip("COALESCE(abstract, '')"))} AS abstract, label FROM f),
k AS (SELECT *, lower(regexp_replace(title || ' || ' || abstract, '{S.WS}+', ' ', 'g')) AS dk FROM c),
clean AS (SELECT id, title, abstract, label FROM
          (SELECT *, row_number() OVER (PARTITION BY dk ORDER BY id) AS rn FROM k) WHERE rn = 1)"""

SQL_PAPERS_CLEAN = f"WITH {_CLEAN}\nSELECT id, title, abstract, label FROM clean"

SQL_PAPER_TEXT = f"""WITH {_CLEAN}
SELECT id, title || ' ' || abstract AS text,
       CASE WHEN label THEN 'Included' ELSE 'Excluded' END AS label_name FROM clean"""

SQL_PAGES_TEXT = f"SELECT page_id, {S.html_to_text('html')} AS text FROM pages"

SQL_CLASS_BALANCE = f"""WITH {S.PAPERS},
c AS (SELECT label, COUNT(*) AS n FROM papers GROUP BY label)
SELECT label, CAST(n AS BIGINT) AS n, ROUND(n / SUM(n) OVER (), 6) AS share FROM c"""

SQL_TEXT_FINGERPRINT = """
SELECT CAST(COUNT(*) AS BIGINT) AS n_rows,
  CAST(SUM(CAST(('0x' || substr(sha1(text), 1, 15)) AS BIGINT)) AS VARCHAR) AS hash_sum,
  BIT_XOR(CAST(('0x' || substr(sha1(text), 1, 15)) AS BIGINT)) AS hash_xor
FROM documents"""

SQL_DEDUP_STATS = f"""
WITH k AS (SELECT doc_id, lang, regexp_replace(lower(text), '{S.WS}+', ' ', 'g') AS dk FROM documents),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dk ORDER BY doc_id) AS rn FROM k) WHERE rn = 1),
a AS (SELECT lang, COUNT(*) AS n_docs FROM documents GROUP BY lang),
b AS (SELECT lang, COUNT(*) AS n_unique FROM kept GROUP BY lang)
SELECT a.lang, CAST(a.n_docs AS BIGINT) AS n_docs, CAST(COALESCE(b.n_unique, 0) AS BIGINT) AS n_unique
FROM a LEFT JOIN b ON a.lang = b.lang"""

_MODELS = S.MODELS

SQL_MODEL_SHORT_NAMES = f"""
WITH m AS (SELECT DISTINCT {_MODELS}[CAST(conv_id % 5 AS INTEGER) + 1] AS model FROM conversations)
SELECT model, split_part(model, '/', -1) AS short_name,
       regexp_replace(model, '[^a-zA-Z0-9._-]+', '_', 'g') AS safe_name FROM m"""

def _sql_sequence(name: str, order: str) -> str:
    parts = []
    for k, base in enumerate(C.DIGEST_BASES, 1):
        steps, square = [], base % C.DIGEST_PRIME
        for bit in range(40):
            steps.append(f"CASE WHEN (place >> {bit}) & 1 = 1 THEN {square} ELSE 1 END")
            square = square * square % C.DIGEST_PRIME
        power = f"list_reduce([{', '.join(steps)}], lambda a, b: CAST(a * b % {C.DIGEST_PRIME} AS BIGINT))"
        parts.append(f"CAST(sum(h * {power} % {C.DIGEST_PRIME}) % {C.DIGEST_PRIME} AS BIGINT) AS digest_{k}")
    return f"""SELECT '{name}' AS ordered_by, count(*) AS n_rows, {', '.join(parts)} FROM (
  SELECT CAST(('0x' || substr(sha1(coalesce(text, '')), 1, 7)) AS BIGINT) AS h, CAST(row_number() OVER (ORDER BY {order}) - 1 AS BIGINT) AS place FROM documents)"""


SQL_SEQUENCE_FINGERPRINT = _sql_sequence("doc_id", "doc_id") + " UNION ALL " + _sql_sequence("doc_id descending", "doc_id DESC")

ORACLE = {
    "papers_clean": SQL_PAPERS_CLEAN,
    "paper_text": SQL_PAPER_TEXT,
    "pages_text": SQL_PAGES_TEXT,
    "class_balance": SQL_CLASS_BALANCE,
    "text_fingerprint": SQL_TEXT_FINGERPRINT,
    "sequence_fingerprint": SQL_SEQUENCE_FINGERPRINT,
    "dedup_stats": SQL_DEDUP_STATS,
    "model_short_names": SQL_MODEL_SHORT_NAMES,
}
