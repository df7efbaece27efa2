"""Result-table reporting: leaderboards, top-k per metric, paired comparisons,
describe, approach comparison tables, prediction export (O-01, W-06, J-04, A-15,
M-12, P-19)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwork.functions.expr import round_np


def leaderboard(df: DataFrame, by, tie=()) -> DataFrame:
    """Sort descending by ``by`` (e.g. pr_auc then roc_auc), ascending by ``tie`` keys."""
    return df.orderBy(*[F.col(c).desc_nulls_last() for c in by], *[F.col(c).asc() for c in tie])


def unpivot_metrics(df: DataFrame, ids, metrics, name: str = "metric", value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(metrics), name, value)


def top_k_by_metric(df: DataFrame, ids, metrics, k: int = 3) -> DataFrame:
    """Best k rows for every metric (ties by the id columns). The row_number <= k filter
    runs as a per-partition group limit before the shuffle."""
    long = unpivot_metrics(df, ids, metrics)
    w = Window.partitionBy("metric").orderBy(F.col("value").desc_nulls_last(), *[F.col(c) for c in ids])
    return long.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def paired_differences(a: DataFrame, b: DataFrame, keys, metrics, names=("a", "b")) -> DataFrame:
    """Join two result tables on ``keys`` and report, per metric, both values and the
    difference b - a in percentage points (long format)."""
    la = unpivot_metrics(a.select(*keys, *metrics), keys, metrics, "metric", names[0])
    lb = unpivot_metrics(b.select(*keys, *metrics), keys, metrics, "metric", names[1])
    j = la.join(lb, list(keys) + ["metric"], "inner")
    return j.withColumn("diff_pp", (F.col(names[1]) - F.col(names[0])) * 100.0)


def describe(df: DataFrame, group: str, value: str, exact: bool = True, digits: int | None = 3) -> DataFrame:
    """count, mean, sample std, min, quartiles, max per group. ``exact`` uses the exact
    percentile (linear interpolation, like pandas) -- it holds a group's values, so use
    it on result-sized tables; ``exact=False`` uses the bounded-memory approximation."""
    v = F.col(value)
    qs = [0.25, 0.5, 0.75]
    pct = F.percentile(v, qs) if exact else F.percentile_approx(v, qs, 10000)
    s = df.groupBy(group).agg(F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
                              F.min(v).alias("min"), pct.alias("_q"), F.max(v).alias("max"))
    out = s.select(group, "count", "mean", "std", "min", F.col("_q")[0].alias("q25"),
                   F.col("_q")[1].alias("q50"), F.col("_q")[2].alias("q75"), "max")
    if digits is None:
        return out
    return out.select(group, "count", *[round_np(c, digits).alias(c)
                                        for c in ("mean", "std", "min", "q25", "q50", "q75", "max")])


def approach_table(approaches: dict, metrics) -> DataFrame:
    """One row per (approach, metric) from {approach name: one-row metrics DataFrame}."""
    out = None
    for name, df in approaches.items():
        d = unpivot_metrics(df.select(*metrics).withColumn("approach", F.lit(name)), ["approach"], metrics)
        out = d if out is None else out.unionByName(d)
    return out


def export_predictions(scored: DataFrame, threshold, id_col: str = "id", label: str = "label",
                       score: str = "score", keep=()) -> DataFrame:
    """(id, truth, prediction, probability) with the real ids, and the columns ``keep``."""
    t = threshold if isinstance(threshold, F.Column) else F.lit(float(threshold))
    return scored.select(F.col(id_col).alias("paper_id"), F.col(label).cast("int").alias("y_true"),
                         (F.col(score) >= t).cast("int").alias("y_pred"), F.col(score).alias("probability"), *keep)
