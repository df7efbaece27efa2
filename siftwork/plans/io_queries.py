"""Registered round trips through the stores (write, then read back by key)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from siftwork.operators import ranking as R
from siftwork.operators import store as ST
from siftwork.plans.common import finish
from siftwork.plans.llm_queries import SQL_RULE_ANSWERS, q_rule_answers
from siftwork.plans.ranking_queries import SQL_FIXED_RECALL_FOLDS, TARGET
from siftwork.session import ensure_checkpoint_dir
from siftwork.sources import fixtures as fx
from siftwork.plans.ranking_queries import SQL_RECALL_SCAN
from siftwork.plans import sqlsnips as SQ
from siftwork.sources.io import first_n, json_safe, read_answer_dir, read_papers_csv, write_answer_dir, write_csv
from siftwork.sources.tables import read_table


def _scratch(spark, name):
    return os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def q_answers_json_roundtrip(spark, sf):
    """Answers written as JSON lines partitioned by question, read back with defaults
    for missing token counts and sorted (S-11, S-04, O-02)."""
    path = _scratch(spark, "answers-json")
    write_answer_dir(q_rule_answers(spark, sf), path, mode="overwrite")
    return read_answer_dir(spark, path)


def q_result_store_roundtrip(spark, sf):
    """Fold results saved to the result store under data and config hashes, then loaded
    by matching all keys (S-09, A-22)."""
    path = _scratch(spark, "results")
    scored = fx.scored(spark, sf)
    folds = R.evaluate_fixed_recall(scored, ["fold"], TARGET) \
        .withColumn("embedding_model", F.lit("events")).withColumn("classifier", F.lit("given"))
    dkey = ST.data_hash_value(scored, ["id", "label", "score"])
    ckey = ST.config_hash("given", {}, n_splits=5, target_recall=TARGET)
    ST.save_results(folds, path, dkey, ckey)
    hit = ST.load_results(spark, path, dkey, ckey, "events", "given")
    cols = [c for c in folds.columns]
    return finish(hit.select(*cols))


def q_json_safe_scan(spark, sf):
    """Threshold scan made JSON-safe: NaN -> NULL, +-inf -> 'inf' strings (S-10)."""
    c = R.pr_curve(fx.scored(spark, sf), ["fold"])
    return json_safe(finish(R.recall_threshold_scan(c, ["fold"], TARGET)))


def q_first_papers(spark, sf):
    """The first 25 papers by id (P-11 / O-03: the first-n restriction is the feature)."""
    return first_n(fx.papers(spark, sf).select("id", "label"), 25, ["id"])


def q_papers_csv_roundtrip(spark, sf):
    """Papers exported as CSV (quoted, multi-line abstracts) and read back with the
    required-column check and the label column renamed (S-12, S-01, P-01). Empty fields
    read back as NULL, as a pandas CSV reader does."""
    path = _scratch(spark, "papers-csv")
    p = fx.papers(spark, sf).select("id", "title", "abstract", F.col("label").cast("string").alias("included"))
    write_csv(p, path)
    back = read_papers_csv(spark, path, label_col="included")
    return back.select("id", "title", "abstract", (F.col("label") == "true").alias("label"))


def q_document_embeddings(spark, sf):
    """Every document embedded through the content-keyed store with the offline hashing
    encoder (S-08, L-18, X-04); a text already stored is not encoded again."""
    from siftwork.operators import ml as M
    path = _scratch(spark, "embeddings")
    d = read_table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    e = M.embed_with_store(d, path, "hashing-64", M.get_encoder("hashing-64"))
    return finish(e.select("id", "model", "embedding"))


QUERIES = {
    "papers_csv_roundtrip": q_papers_csv_roundtrip,
    "document_embeddings": q_document_embeddings,
    "answers_json_roundtrip": q_answers_json_roundtrip,
    "result_store_roundtrip": q_result_store_roundtrip,
    "json_safe_scan": q_json_safe_scan,
    "first_papers": q_first_papers,
}

ORACLE = {
    "papers_csv_roundtrip": f"WITH {SQ.PAPERS}\n"
                            "SELECT id, NULLIF(title, '') AS title, NULLIF(abstract, '') AS abstract, label FROM papers",
    "json_safe_scan": f"""WITH s AS ({SQL_RECALL_SCAN})
SELECT fold, CAST(target_recall AS VARCHAR) AS target_recall,
  CASE WHEN isinf(threshold_literal) THEN 'inf' ELSE CAST(threshold_literal AS VARCHAR) END AS threshold_literal,
  CASE WHEN isinf(threshold_corrected) THEN 'inf' ELSE CAST(threshold_corrected AS VARCHAR) END AS threshold_corrected
FROM s""",
    "document_embeddings": """WITH tok AS (
  SELECT doc_id, lower(t) AS t FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[^A-Za-z0-9]+')) AS t FROM documents) WHERE t <> ''),
c AS (SELECT doc_id, ('0x' || substr(md5(t), 1, 8))::BIGINT % 64 AS b, COUNT(*)::DOUBLE AS n FROM tok GROUP BY ALL),
nrm AS (SELECT doc_id, sqrt(SUM(n * n)) AS l FROM c GROUP BY doc_id),
grid AS (SELECT doc_id, b FROM documents, range(64) r(b))
SELECT doc_id AS id, 'hashing-64' AS model, list(round(coalesce(n / l, 0.0), 6) ORDER BY b) AS embedding
FROM grid LEFT JOIN c USING (doc_id, b) LEFT JOIN nrm USING (doc_id) GROUP BY doc_id""",
    "first_papers": """SELECT doc_id AS id, quality = 1 AS label FROM labels ORDER BY doc_id LIMIT 25""",
    "answers_json_roundtrip": f"""WITH r AS ({SQL_RULE_ANSWERS})
SELECT paper_id, question_id, response, model, input_tokens, output_tokens FROM r""",
    "result_store_roundtrip": f"""WITH f AS ({SQL_FIXED_RECALL_FOLDS})
SELECT *, 'events' AS embedding_model, 'given' AS classifier FROM f""",
}
