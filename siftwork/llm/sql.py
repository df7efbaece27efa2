"""DuckDB twins of the queries that SQL can express over whole tables."""

from __future__ import annotations

from siftwork.llm.mixing import LONG_WORDS, OTHER, RATE, TARGETS, Flattened
from siftwork.llm.quality import QualityRules

_WS = r"[\x20\x09-\x0D]"
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_TRIM = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

EXACT_DEDUP = rf"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS cp, regexp_replace(coalesce(text, ''), '{_WS}', '', 'g') AS norm FROM documents
), g AS (
  SELECT norm, count(*) AS group_size, min(doc_id) FILTER (cp = top) AS keep_id
  FROM (SELECT *, max(cp) OVER (PARTITION BY norm) AS top FROM t) GROUP BY norm
)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm
"""


def _classes(margin: str, column: str) -> str:
    target = TARGETS[margin]
    if isinstance(target, Flattened) and target.values is None:
        values = f"SELECT {column} FROM documents WHERE {column} IS NOT NULL GROUP BY {column} ORDER BY count(*) DESC, {column} LIMIT {target.most}"
    else:
        values = ", ".join(f"'{v}'" for v in (target.values if isinstance(target, Flattened) else target))
    return f"CASE WHEN {column} IN ({values}) THEN {column} ELSE '{OTHER}' END AS by_{margin}"


def _share(margin: str) -> str:
    """Unnormalised target share of a class, from its own share ``nat``."""
    target = TARGETS[margin]
    if isinstance(target, Flattened):
        return f"pow(nat, {target.power})"
    cases = " ".join(f"WHEN by_{margin} = '{v}' THEN {s}" for v, s in target.items())
    rest = f"{max(0.0, 1 - sum(target.values()))}"
    if 1 - sum(target.values()) < 1e-9:  # the listed shares are of what the other classes leave
        rest = f"coalesce(nullif(sum(CASE {cases} ELSE 0 END) OVER (), 0) * nat / nullif(1 - nat, 0), 1)"
    return f"CASE {cases} ELSE {rest} END"


def _mix_sources(sweeps: int = 200) -> str:
    margins = list(TARGETS)
    by = ", ".join(f"by_{m}" for m in margins)
    targets = ", ".join(
        f"to_{m} AS (SELECT by_{m}, share * total / sum(share) OVER () AS goal_{m} FROM (SELECT by_{m}, total, {_share(m)} AS share FROM "
        f"(SELECT by_{m}, any_value(total) AS total, sum(tokens) / any_value(total) AS nat FROM cells, everything GROUP BY by_{m} HAVING sum(tokens) > 0)))" for m in margins)
    step = "SELECT * FROM r"
    for m in margins:
        step = f"SELECT * REPLACE (coalesce(raked * goal_{m} / nullif(sum(raked) OVER (PARTITION BY by_{m}), 0), 0) AS raked) FROM ({step})"
    return rf"""
WITH RECURSIVE rows AS (
  SELECT doc_id, source, lang, coalesce(text, '') AS text, len({_WORDS})::BIGINT AS tokens,
    ('0x' || substr(md5('mix' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT / 281474976710656.0 AS draw FROM documents
), topical AS (
  SELECT *, CASE WHEN contains(text, 'icensed under') OR contains(text, 'eleased under') THEN 'licence'
                 WHEN contains(text, '@') OR contains(text, '+1 (') THEN 'contact'
                 WHEN tokens >= {LONG_WORDS} THEN 'longform' ELSE 'prose' END AS topic FROM rows
), classed AS MATERIALIZED (
  SELECT doc_id, tokens, draw, {_classes("source", "source")}, {_classes("lang", "lang")}, {_classes("topic", "topic")} FROM topical
), cells AS MATERIALIZED (SELECT {by}, sum(tokens)::BIGINT AS tokens FROM classed GROUP BY {by}),
everything AS (SELECT sum(tokens)::DOUBLE AS total FROM cells), {targets},
r AS (
  SELECT 0 AS sweep, {by}, tokens, tokens::DOUBLE AS raked, {", ".join(f"coalesce(goal_{m}, 0) AS goal_{m}" for m in margins)}
  FROM cells {" ".join(f"LEFT JOIN to_{m} USING (by_{m})" for m in margins)}
  UNION ALL
  SELECT * REPLACE (sweep + 1 AS sweep) FROM ({step}) WHERE sweep < {sweeps}
), weights AS (
  SELECT {by}, coalesce(raked / nullif(tokens, 0), 0) AS weight FROM r WHERE sweep = {sweeps}
), probabilities AS (SELECT *, least(1.0, weight * {RATE}) AS probability FROM weights)
SELECT doc_id, tokens, by_source AS source_class, by_lang AS lang_class, by_topic AS topic, round(weight, 6) AS weight, round(probability, 6) AS probability,
  draw < probability AS kept
FROM classed JOIN probabilities USING ({by})
"""


MIX_SOURCES = _mix_sources()


def _quality(rules: QualityRules = QualityRules()) -> str:
    base = 8
    sizes = sorted({base, *rules.ngram_limits})
    grams = ", ".join(
        f"CASE WHEN lead(word, {n - 1}) OVER along IS NOT NULL THEN concat_ws(' ', word, {', '.join(f'lead(word, {k}) OVER along' for k in range(1, n))}) END AS g{n}"
        for n in sizes)
    flags = ", ".join(f"g{n} IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g{n}) > 1 AS f{n}" for n in sizes)
    covers = ", ".join(f"bool_or(f{n}) OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS c{n}" for n in sizes)
    sums = ", ".join(f"sum(CASE WHEN c{n} THEN 1 ELSE 0 END) AS words{n}, sum(CASE WHEN c{n} THEN length(word) ELSE 0 END) AS chars{n}" for n in sizes)
    limits = " AND ".join(f"coalesce(chars{n}, 0) <= {limit} * word_chars" for n, limit in rules.ngram_limits.items())
    return rf"""
WITH t AS MATERIALIZED (
  SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents
), base AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '{_WS}', '', 'g')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols FROM t
), lines AS (
  SELECT doc_id, sum(times - 1)::BIGINT AS n_dup_lines, sum((times - 1) * chars) AS dup_chars FROM (
    SELECT doc_id, line, count(*) AS times, any_value(length(regexp_replace(line, '{_WS}', '', 'g'))) AS chars
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t) GROUP BY doc_id, line)
  WHERE chars > 0 GROUP BY doc_id
), words AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM t
), grams AS (
  SELECT doc_id, j, word, {grams} FROM words WINDOW along AS (PARTITION BY doc_id ORDER BY j)
), flags AS (
  SELECT doc_id, j, word, {flags} FROM grams
), covers AS (
  SELECT doc_id, word, {covers} FROM flags
), repeats AS (
  SELECT doc_id, {sums} FROM covers GROUP BY doc_id
), judged AS (
  SELECT doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(words{base}, 0)::BIGINT AS n_repeat_words,
    (n_words < {rules.min_words} OR 100 * coalesce(words{base}, 0) > {rules.max_repeat_percent} * n_words) AS base_failed,
    coalesce(dup_chars, 0) <= {rules.line_limit} * word_chars AND {limits} AS passes
  FROM base LEFT JOIN lines USING (doc_id) LEFT JOIN repeats USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND passes AS kept FROM judged
"""


QUALITY = _quality()

LINE_DEDUP = rf"""
WITH l AS MATERIALIZED (
  SELECT doc_id, i, lines[i] AS line, trim(lines[i], {_TRIM}) AS t, coalesce(source, chr(0)) AS site
  FROM (SELECT doc_id, source, lines, unnest(range(1, len(lines) + 1)) AS i
        FROM (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))
), b AS (SELECT t FROM l WHERE t <> '' GROUP BY t HAVING count(DISTINCT site) >= 10)
SELECT doc_id, count(*) AS n_lines, count(b.t) AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (b.t IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN b USING (t) GROUP BY doc_id
"""

ORACLE = {
    "op1_exact_dedup": EXACT_DEDUP,
    "op3_mix_sources": MIX_SOURCES,
    "op7_quality_rules": QUALITY,
    "op9_line_dedup": LINE_DEDUP,
}
