"""Registered answer-table and cost queries and DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwork.operators import answers as A
from siftwork.operators import cost as CO
from siftwork.plans import sqlsnips as S
from siftwork.plans.common import finish
from siftwork.sources import fixtures as fx
from siftwork.sources.dimensions import prices_df, question_ids

QIDS = question_ids()


def _answers_cost(spark, sf):
    return CO.add_cost(fx.answers(spark, sf), prices_df(spark))


def _stats(spark, sf):
    a = fx.answers(spark, sf)
    return A.feature_filter(A.unsure_rates(a), A.label_correlation(a, fx.paper_labels(spark, sf)))


def _encoded(spark, sf):
    wide = A.pivot_answers(fx.answers(spark, sf), QIDS)
    j = fx.paper_labels(spark, sf).join(wide, on="paper_id", how="inner")
    return A.encode_features(j, QIDS, unsure_as_one=True)


def q_answers_cost(spark, sf):
    """Papers x 29 questions answer table with per-row cost in USD (J-05, J-11, A-06, S-06)."""
    return finish(_answers_cost(spark, sf))


def q_unsure_rates(spark, sf):
    """UNSURE percentage per question, flagged above 15 % (A-04)."""
    return finish(A.unsure_rates(fx.answers(spark, sf)))


def q_label_correlation(spark, sf):
    """Correlation of each encoded question with the label, with sign check (A-14)."""
    a = fx.answers(spark, sf)
    return finish(A.label_correlation(a, fx.paper_labels(spark, sf)))


def q_feature_filter(spark, sf):
    """Questions removed for high UNSURE rate or wrong-sign exclusion (L-14, U-02, U-03, P-09)."""
    return finish(_stats(spark, sf))


def q_answers_wide(spark, sf):
    """Pivot to one encoded column per question, inner-joined with labels (A-10, J-02, P-10)."""
    return finish(_encoded(spark, sf))


def q_conflict_rows(spark, sf):
    """Papers whose identical answer vector carries both labels (A-11)."""
    return A.conflicts(_encoded(spark, sf), QIDS).select("paper_id", "label")


def q_conflict_summary(spark, sf):
    """Rows, conflicting rows and distinct conflicting patterns (A-12)."""
    return finish(A.conflict_summary(_encoded(spark, sf), QIDS))


def q_resolve_majority(spark, sf):
    """Keep rows with their pattern's majority label, ties to positive (A-13, W-07)."""
    return A.resolve_conflicts(_encoded(spark, sf), QIDS, strategy="majority").select("paper_id", "label")


def q_resolve_remove(spark, sf):
    """Drop every row of a conflicting pattern (A-13)."""
    return A.resolve_conflicts(_encoded(spark, sf), QIDS, strategy="remove").select("paper_id", "label")


def q_cost_summary(spark, sf):
    """Total, per response, per paper (mean of means) and per 1000 papers (A-07)."""
    return finish(CO.cost_summary(_answers_cost(spark, sf)))


def q_per_paper_costs(spark, sf):
    """Questions, total and mean cost per paper (A-09)."""
    return finish(CO.per_paper_costs(_answers_cost(spark, sf)))


def q_cost_per_1000(spark, sf):
    """Cost per 1000 papers with all questions and with the filtered ones (A-08, J-09)."""
    ac = _answers_cost(spark, sf)
    removed = _stats(spark, sf).where("removed").select("question_id")
    kept = ac.join(removed, "question_id", "left_anti")
    a = CO.cost_per_1000(ac).select(F.lit("all").alias("features"), "cost_per_1000")
    b = CO.cost_per_1000(kept).select(F.lit("filtered").alias("features"), "cost_per_1000")
    return finish(a.unionByName(b))


def q_cost_savings_sweep(spark, sf):
    """Cost savings when dropping questions above each UNSURE threshold (L-17)."""
    return finish(CO.cost_savings_sweep(_answers_cost(spark, sf), _stats(spark, sf)))


QUERIES = {
    "answers_cost": q_answers_cost,
    "unsure_rates": q_unsure_rates,
    "label_correlation": q_label_correlation,
    "feature_filter": q_feature_filter,
    "answers_wide": q_answers_wide,
    "conflict_rows": q_conflict_rows,
    "conflict_summary": q_conflict_summary,
    "resolve_majority": q_resolve_majority,
    "resolve_remove": q_resolve_remove,
    "cost_summary": q_cost_summary,
    "per_paper_costs": q_per_paper_costs,
    "cost_per_1000": q_cost_per_1000,
    "cost_savings_sweep": q_cost_savings_sweep,
}

# ---------------------------------------------------------------- DuckDB side

ANSWERS = f"""{S.PRICES},
answers AS (
  SELECT l.doc_id AS paper_id,
    CASE WHEN q <= 17 THEN 'I' || CAST(q AS VARCHAR) ELSE 'E' || CAST(q - 17 AS VARCHAR) END AS question_id,
    CASE WHEN (l.doc_id * 7 + q * 13) % 100 < q THEN 'UNSURE'
         WHEN (l.doc_id * 31 + q * 17) % 100 < CASE WHEN q <= 17 OR q % 4 = 0 THEN 30 + 30 * l.ql
                                                    ELSE 60 - 30 * l.ql END THEN 'YES'
         ELSE 'NO' END AS response,
    {S.MODELS}[CAST(l.doc_id % 5 AS INTEGER) + 1] AS model, CAST(50 + d.n_chars // 4 AS BIGINT) AS input_tokens, CAST(1 + q % 7 AS BIGINT) AS output_tokens
  FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE quality END AS ql FROM labels) l JOIN documents d ON l.doc_id = d.doc_id CROSS JOIN range(1, 30) t(q)),
ac AS (
  SELECT a.*, round_even((input_tokens / 1e6 * pin + output_tokens / 1e6 * pout) * 1e6, 0) / 1e6 AS cost_usd
  FROM answers a JOIN prices USING (model)),
lab AS (SELECT doc_id AS paper_id, quality = 1 AS label FROM labels)"""

STATS = """ur AS (
  SELECT question_id, 100.0::DOUBLE * COUNT_IF(response = 'UNSURE') / COUNT(*) AS unsure_pct, COUNT(*) AS n_answers
  FROM answers GROUP BY question_id),
enc AS (
  SELECT a.question_id, CASE a.response WHEN 'NO' THEN 0.0 WHEN 'YES' THEN 1.0 WHEN 'UNSURE' THEN 1.0 END AS x,
         CAST(l.label AS DOUBLE) AS y
  FROM answers a JOIN lab l ON a.paper_id = l.paper_id),
co AS (
  SELECT question_id, CASE WHEN stddev_pop(x) * stddev_pop(y) = 0 THEN NULL
                           ELSE covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) END AS corr,
         CASE WHEN question_id LIKE 'I%' THEN 'include' WHEN question_id LIKE 'E%' THEN 'exclude' END AS kind
  FROM enc GROUP BY question_id),
co2 AS (SELECT *, COALESCE(CASE WHEN kind = 'include' THEN corr < 0 WHEN kind = 'exclude' THEN corr > 0 ELSE FALSE END, FALSE) AS wrong_sign FROM co),
fs AS (
  SELECT COALESCE(u.question_id, c.question_id) AS question_id, u.unsure_pct, c.corr,
    COALESCE(u.unsure_pct > 15.0, FALSE) AS high_unsure,
    COALESCE(c.kind = 'exclude' AND c.wrong_sign, FALSE) AS wrong_sign_exclude,
    COALESCE(u.unsure_pct > 15.0, FALSE) OR COALESCE(c.kind = 'exclude' AND c.wrong_sign, FALSE) AS removed
  FROM ur u FULL JOIN co2 c ON u.question_id = c.question_id)"""


def _wide_cols(prefix: str = "") -> str:
    return ", ".join(
        f"MAX(CASE WHEN question_id = '{q}' THEN CASE response WHEN 'NO' THEN 0.0 WHEN 'YES' THEN 1.0 "
        f"WHEN 'UNSURE' THEN 1.0 END END) AS {q}" for q in QIDS)


WIDE = f"""wide AS (
  SELECT l.paper_id, l.label, {_wide_cols()}
  FROM answers a JOIN lab l ON a.paper_id = l.paper_id GROUP BY l.paper_id, l.label)"""

_FEATS = ", ".join(QIDS)

SQL_ANSWERS_COST = f"WITH {ANSWERS}\nSELECT paper_id, question_id, response, model, input_tokens, output_tokens, cost_usd FROM ac"

SQL_UNSURE = f"""WITH {ANSWERS},
{STATS}
SELECT question_id, ROUND(unsure_pct, 6) AS unsure_pct, CAST(n_answers AS BIGINT) AS n_answers,
       unsure_pct > 15.0 AS high_unsure FROM ur"""

SQL_CORR = f"""WITH {ANSWERS},
{STATS}
SELECT question_id, ROUND(corr, 6) AS corr, kind, wrong_sign FROM co2"""

SQL_FEATURE_FILTER = f"""WITH {ANSWERS},
{STATS}
SELECT question_id, ROUND(unsure_pct, 6) AS unsure_pct, ROUND(corr, 6) AS corr, high_unsure, wrong_sign_exclude, removed
FROM fs"""

SQL_WIDE = f"""WITH {ANSWERS},
{WIDE}
SELECT * FROM wide"""

SQL_CONFLICT_ROWS = f"""WITH {ANSWERS},
{WIDE},
p AS (SELECT paper_id, label, MIN(CAST(label AS INT)) OVER (PARTITION BY {_FEATS}) AS mn,
             MAX(CAST(label AS INT)) OVER (PARTITION BY {_FEATS}) AS mx FROM wide)
SELECT paper_id, label FROM p WHERE mn <> mx"""

SQL_CONFLICT_SUMMARY = f"""WITH {ANSWERS},
{WIDE},
st AS (SELECT COUNT(*) AS n, SUM(CAST(label AS INT)) AS pos, MIN(CAST(label AS INT)) AS mn, MAX(CAST(label AS INT)) AS mx
       FROM wide GROUP BY {_FEATS})
SELECT CAST(SUM(n) AS BIGINT) AS n_rows, CAST(SUM(CASE WHEN mn <> mx THEN n ELSE 0 END) AS BIGINT) AS n_conflicting_rows,
       CAST(COUNT_IF(mn <> mx) AS BIGINT) AS n_conflicting_patterns, CAST(SUM(pos) AS BIGINT) AS n_positive FROM st"""

_PAT = f"""p AS (SELECT paper_id, label, COUNT(*) OVER (PARTITION BY {_FEATS}) AS n,
             SUM(CAST(label AS INT)) OVER (PARTITION BY {_FEATS}) AS pos,
             MIN(CAST(label AS INT)) OVER (PARTITION BY {_FEATS}) AS mn,
             MAX(CAST(label AS INT)) OVER (PARTITION BY {_FEATS}) AS mx FROM wide)"""

SQL_RESOLVE_MAJORITY = f"""WITH {ANSWERS},
{WIDE},
{_PAT}
SELECT paper_id, label FROM p WHERE label = (2 * pos >= n)"""

SQL_RESOLVE_REMOVE = f"""WITH {ANSWERS},
{WIDE},
{_PAT}
SELECT paper_id, label FROM p WHERE mn = mx"""

SQL_COST_SUMMARY = f"""WITH {ANSWERS},
per AS (SELECT paper_id, AVG(cost_usd) AS m, SUM(cost_usd) AS s, COUNT(*) AS n FROM ac GROUP BY paper_id)
SELECT ROUND(round_even(SUM(s) * 1e3, 0) / 1e3, 6) AS total_cost,
       ROUND(round_even(SUM(s) / SUM(n) * 1e4, 0) / 1e4, 6) AS avg_cost_per_response,
       ROUND(round_even(AVG(m) * 1e4, 0) / 1e4, 6) AS avg_cost_per_paper,
       ROUND(round_even(SUM(m) / (COUNT(*) / 1000.0::DOUBLE) * 1e2, 0) / 1e2, 6) AS avg_cost_per_1000_papers FROM per"""

SQL_PER_PAPER = f"""WITH {ANSWERS}
SELECT paper_id, CAST(COUNT(question_id) AS BIGINT) AS n_questions, ROUND(SUM(cost_usd), 6) AS total_cost_usd,
       ROUND(AVG(cost_usd), 6) AS avg_cost_usd FROM ac GROUP BY paper_id"""

SQL_COST_1000 = f"""WITH {ANSWERS},
{STATS},
kept AS (SELECT * FROM ac WHERE question_id NOT IN (SELECT question_id FROM fs WHERE removed)),
a AS (SELECT paper_id, SUM(cost_usd) AS s FROM ac GROUP BY paper_id),
b AS (SELECT paper_id, SUM(cost_usd) AS s FROM kept GROUP BY paper_id)
SELECT 'all' AS features, ROUND(AVG(s) * 1000, 6) AS cost_per_1000 FROM a
UNION ALL SELECT 'filtered', ROUND(AVG(s) * 1000, 6) FROM b"""

SQL_SWEEP = f"""WITH {ANSWERS},
{STATS},
th AS (SELECT * FROM (VALUES (0.05::DOUBLE), (0.1::DOUBLE), (0.15::DOUBLE), (0.20::DOUBLE), (0.25::DOUBLE),
                             (0.3::DOUBLE), (0.4::DOUBLE), (0.5::DOUBLE)) v(t)),
allc AS (SELECT round_even(AVG(s) * 1000 * 1e2, 0) / 1e2 AS all1000 FROM (SELECT paper_id, SUM(cost_usd) AS s FROM ac GROUP BY paper_id)),
qk AS (SELECT th.t, fs.question_id, (NOT fs.wrong_sign_exclude AND fs.unsure_pct <= th.t * 100) AS kept FROM th, fs),
filt AS (
  SELECT qk.t, SUM(ac.cost_usd) / COUNT(DISTINCT ac.paper_id) * 1000 AS cost_per_1000
  FROM qk JOIN ac ON qk.question_id = ac.question_id WHERE qk.kept GROUP BY qk.t),
cnt AS (SELECT t, COUNT_IF(NOT kept) AS removed, COUNT(*) AS nq FROM qk GROUP BY t)
SELECT ROUND(cnt.t, 6) AS threshold, ROUND(cnt.t * 100, 6) AS threshold_pct, CAST(cnt.removed AS BIGINT) AS features_removed,
  CAST(cnt.nq - cnt.removed AS BIGINT) AS features_remaining, ROUND(filt.cost_per_1000, 6) AS cost_per_1000,
  ROUND(allc.all1000 - filt.cost_per_1000, 6) AS cost_savings,
  ROUND((allc.all1000 - filt.cost_per_1000) / allc.all1000 * 100, 6) AS cost_savings_pct
FROM cnt LEFT JOIN filt ON cnt.t = filt.t CROSS JOIN allc"""

ORACLE = {
    "answers_cost": SQL_ANSWERS_COST,
    "unsure_rates": SQL_UNSURE,
    "label_correlation": SQL_CORR,
    "feature_filter": SQL_FEATURE_FILTER,
    "answers_wide": SQL_WIDE,
    "conflict_rows": SQL_CONFLICT_ROWS,
    "conflict_summary": SQL_CONFLICT_SUMMARY,
    "resolve_majority": SQL_RESOLVE_MAJORITY,
    "resolve_remove": SQL_RESOLVE_REMOVE,
    "cost_summary": SQL_COST_SUMMARY,
    "per_paper_costs": SQL_PER_PAPER,
    "cost_per_1000": SQL_COST_1000,
    "cost_savings_sweep": SQL_SWEEP,
}
