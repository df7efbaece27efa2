"""Exact quantiles of large groups by distributed selection.

``F.percentile`` keeps a group's values in one buffer. Here each wanted rank is looked for by narrowing: the
interval that holds it is cut into value blocks, Spark counts rows per block (partial aggregation), and the
one block that holds the rank becomes the next interval, with its least and greatest value as bounds. An
interval with at most ``block_rows`` rows is ranked by value; one whose bounds are equal is the answer. So
no task holds more than a block, whatever the group, and ties of any number stay one count.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwork.functions.expr import round_np
from siftwork.session import ensure_checkpoint_dir


def exact_quantiles(df: DataFrame, group_cols, value: str, quantiles=(0.25, 0.5, 0.75), block_rows: int = 100_000, blocks: int = 1024) -> DataFrame:
    """(group..., quantile, value): linear interpolation between the two nearest ranks, as pandas and SQL's quantile_cont.

    Null and NaN values are left out; a group without others has no row; infinite values count as values. Null groups are
    groups."""
    spark = df.sparkSession
    g = [f"_g{k}" for k in range(len(group_cols))]
    work = f"{ensure_checkpoint_dir(spark)}/quantiles-{uuid.uuid4().hex[:12]}"

    def stored(x: DataFrame, name: str) -> DataFrame:
        x.write.mode("overwrite").parquet(f"{work}/{name}")
        return spark.read.schema(x.schema).parquet(f"{work}/{name}")

    rows = df.select(*(F.col(c).alias(n) for c, n in zip(group_cols, g, strict=True)), F.col(value).cast("double").alias("_v"))
    rows = rows.where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    sizes = stored(rows.groupBy(*g).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high")), "sizes")
    asked = sizes.select("*", F.explode(F.array(*(F.lit(float(q)) for q in quantiles))).alias("_q")).withColumn("_at", F.col("_q") * (F.col("_n") - 1))
    ranks = asked.select(*g, F.explode(F.array(F.floor("_at"), F.ceil("_at"))).alias("_k")).distinct()
    # one state per wanted rank: the interval that holds it, rows before it and inside
    state = stored(ranks.join(sizes.select(*(F.col(c).alias(f"{c}s") for c in g), "_n", "_low", "_high"), _same(g, "s"))
                   .select(*g, "_k", "_low", "_high", F.lit(0).cast("bigint").alias("_before"), F.col("_n").alias("_inside")), "state-0")
    done, turn = [], 0
    while True:
        settled = (F.col("_low") == F.col("_high")) | (F.col("_inside") <= block_rows)
        done.append(state.where(settled))
        state = state.where(~settled)
        if state.isEmpty():
            break
        turn += 1
        inf, low, high, v = F.lit(float("inf")), F.col("_low"), F.col("_high"), F.col("_v")
        # close bounds of one sign: equal steps (of halves, which stay finite); else equal steps of a signed logarithm that is
        # linear near zero. Every step is monotone, so blocks follow the values.
        top = F.greatest(F.abs(low), F.abs(high))
        close = (low * F.signum(high) > 0) & (F.least(F.abs(low), F.abs(high)) >= top / 2)
        log = lambda x: F.signum(x) * F.log1p(F.abs(x) / top * float(1 << 60))
        share = F.when(close, (v / 2 - low / 2) / (high / 2 - low / 2)).otherwise((log(v) - log(low)) / (log(high) - log(low)))
        place = F.when(F.abs(low) == inf, F.when(v == low, -1).otherwise(0)).when(high == inf, F.when(v == high, blocks).otherwise(0)) \
            .otherwise(F.least(F.lit(blocks - 1), F.floor(share * blocks)))
        inside = _inside(rows, state, g).withColumn("_block", place.cast("int"))
        counts = inside.groupBy(*g, "_k", "_before", "_block").agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_l"), F.max("_v").alias("_h"))
        upto = F.sum("_c").over(Window.partitionBy(*g, "_k").orderBy("_block")) + F.col("_before")
        held = counts.withColumn("_upto", upto).where((F.col("_k") < F.col("_upto")) & (F.col("_k") >= F.col("_upto") - F.col("_c")))
        state = stored(held.select(*g, "_k", F.col("_l").alias("_low"), F.col("_h").alias("_high"), (F.col("_upto") - F.col("_c")).alias("_before"), F.col("_c").alias("_inside")), f"state-{turn}")
    found = done[0]
    for part in done[1:]:
        found = found.unionAll(part)
    plain = found.where("_low = _high").select(*g, "_k", F.col("_low").alias("_x"))
    values = _inside(rows, found.where("_low <> _high"), g).groupBy(*g, "_k", "_before", "_v").agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*g, "_k").orderBy("_v")) + F.col("_before")
    ranked = values.withColumn("_upto", upto).where((F.col("_k") < F.col("_upto")) & (F.col("_k") >= F.col("_upto") - F.col("_c"))).select(*g, "_k", F.col("_v").alias("_x"))
    answers = stored(plain.unionAll(ranked), "answers")
    out = asked
    for end, f in (("low", F.floor), ("high", F.ceil)):
        named = answers.select(*(F.col(c).alias(f"{c}{end}") for c in g), F.col("_k").alias(f"_k{end}"), F.col("_x").alias(f"_x{end}"))
        out = out.join(named, _same(g, end) & (f("_at") == F.col(f"_k{end}")))
    part = F.col("_at") - F.floor("_at")
    value_ = F.when(part == 0, F.col("_xlow")).otherwise(F.col("_xlow") + (F.col("_xhigh") - F.col("_xlow")) * part)
    return out.select(*(F.col(n).alias(c) for c, n in zip(group_cols, g, strict=True)), F.col("_q").alias("quantile"), value_.alias("value"))


def _same(g: list[str], end: str):
    cond = F.lit(True)
    for c in g:
        cond = cond & F.col(c).eqNullSafe(F.col(f"{c}{end}"))
    return cond


def _inside(rows: DataFrame, state: DataFrame, g: list[str]) -> DataFrame:
    """The rows inside each state's interval."""
    named = state.select(*(F.col(c).alias(f"{c}s") for c in g), "_k", "_low", "_high", "_before")
    return rows.join(named, _same(g, "s") & (F.col("_v") >= F.col("_low")) & (F.col("_v") <= F.col("_high"))).drop(*(f"{c}s" for c in g))


def describe_exact(df: DataFrame, group: str, value: str, digits: int | None = 3, **options) -> DataFrame:
    """count, mean, sample std, min, quartiles, max per group, quartiles by ``exact_quantiles``."""
    v = F.col(value)
    s = df.groupBy(group).agg(F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    q = exact_quantiles(df, [group], value, (0.25, 0.5, 0.75), **options)
    wide = q.groupBy(F.col(group).alias("_same")).agg(*(F.max(F.when(F.col("quantile") == x, F.col("value"))).alias(n) for x, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))))
    out = s.join(wide, F.col(group).eqNullSafe(F.col("_same")), "left").select(group, "count", "mean", "std", "min", "q25", "q50", "q75", "max")
    if digits is None:
        return out
    return out.select(group, "count", *(round_np(c, digits).alias(c) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")))
