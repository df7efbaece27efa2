"""Registered reporting queries over fold results, and DuckDB twins."""

from __future__ import annotations

from siftwork.operators import ranking as R
from siftwork.operators import report as RP
from siftwork.operators.quantiles import describe_exact
from siftwork.plans.common import finish
from siftwork.plans.ranking_queries import SQL_DEFAULT_THRESHOLD_FOLDS, SQL_FIXED_RECALL_FOLDS, TARGET
from siftwork.sources import fixtures as fx
from siftwork.sources.tables import read_table

METRICS = R.FOLD_METRICS


def _fixed(spark, sf):
    return finish(R.evaluate_fixed_recall(fx.scored(spark, sf), ["fold"], TARGET))


def _default(spark, sf):
    return finish(R.evaluate_default(fx.scored(spark, sf), ["fold"], score="prob"))


def q_metric_leaderboard(spark, sf):
    """Top two folds for every metric, ties by fold (W-06, O-01)."""
    return finish(RP.top_k_by_metric(_fixed(spark, sf), ["fold"], METRICS, 2))


def q_threshold_comparison(spark, sf):
    """Per fold and metric: automatic-threshold vs fixed-recall value and the difference
    in percentage points (J-04, M-12)."""
    d = RP.paired_differences(_default(spark, sf), _fixed(spark, sf), ["fold"], METRICS, ("default", "fixed"))
    return finish(d)


def q_difference_describe(spark, sf):
    """count / mean / std / min / quartiles / max of those differences per metric (A-15)."""
    d = RP.paired_differences(_default(spark, sf), _fixed(spark, sf), ["fold"], METRICS, ("default", "fixed"))
    return finish(describe_exact(d, "metric", "diff_pp", digits=3))


def q_event_value_describe(spark, sf):
    """count / mean / std / min / quartiles / max of the events' value per type, quartiles by distributed selection (A-15)."""
    return finish(describe_exact(read_table(spark, sf, "events"), "event_type", "value", digits=3, block_rows=500))


QUERIES = {
    "metric_leaderboard": q_metric_leaderboard,
    "threshold_comparison": q_threshold_comparison,
    "difference_describe": q_difference_describe,
    "event_value_describe": q_event_value_describe,
}

_M = ", ".join(METRICS)

_PAIRS = f"""fx AS ({SQL_FIXED_RECALL_FOLDS}),
df AS ({SQL_DEFAULT_THRESHOLD_FOLDS}),
lf AS (SELECT fold, metric, fixed FROM (SELECT fold, {_M} FROM fx) UNPIVOT INCLUDE NULLS (fixed FOR metric IN ({_M}))),
ld AS (SELECT fold, metric, "default" FROM (SELECT fold, {_M} FROM df) UNPIVOT INCLUDE NULLS ("default" FOR metric IN ({_M}))),
p AS (SELECT ld.fold, ld.metric, ld."default", lf.fixed, (lf.fixed - ld."default") * 100.0 AS diff_pp
      FROM ld JOIN lf ON ld.fold = lf.fold AND ld.metric = lf.metric)"""

SQL_LEADERBOARD = f"""WITH fx AS ({SQL_FIXED_RECALL_FOLDS}),
l AS (SELECT fold, metric, value FROM (SELECT fold, {_M} FROM fx) UNPIVOT INCLUDE NULLS (value FOR metric IN ({_M})))
SELECT fold, metric, value, CAST(rank AS BIGINT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY metric ORDER BY value DESC NULLS LAST, fold) AS rank FROM l)
WHERE rank <= 2"""

SQL_COMPARISON = f"""WITH {_PAIRS}
SELECT fold, metric, "default", fixed, ROUND(diff_pp, 6) AS diff_pp FROM p"""


def _r3(x: str) -> str:
    return f"ROUND(round_even(({x}) * 1e3, 0) / 1e3, 6)"


SQL_DESCRIBE = f"""WITH {_PAIRS}
SELECT metric, CAST(COUNT(diff_pp) AS BIGINT) AS count, {_r3('AVG(diff_pp)')} AS mean, {_r3('STDDEV_SAMP(diff_pp)')} AS std,
  {_r3('MIN(diff_pp)')} AS min, {_r3('quantile_cont(diff_pp, 0.25)')} AS q25, {_r3('quantile_cont(diff_pp, 0.5)')} AS q50,
  {_r3('quantile_cont(diff_pp, 0.75)')} AS q75, {_r3('MAX(diff_pp)')} AS max
FROM p GROUP BY metric"""

ORACLE = {
    "metric_leaderboard": SQL_LEADERBOARD,
    "threshold_comparison": SQL_COMPARISON,
    "difference_describe": SQL_DESCRIBE,
    "event_value_describe": f"""SELECT event_type, CAST(COUNT(value) AS BIGINT) AS count, {_r3('AVG(value)')} AS mean, {_r3('STDDEV_SAMP(value)')} AS std,
  {_r3('MIN(value)')} AS min, {_r3('quantile_cont(value, 0.25)')} AS q25, {_r3('quantile_cont(value, 0.5)')} AS q50,
  {_r3('quantile_cont(value, 0.75)')} AS q75, {_r3('MAX(value)')} AS max FROM events GROUP BY event_type""",
}
