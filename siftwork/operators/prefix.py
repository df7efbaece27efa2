"""Running totals within groups that stay parallel when one group is huge.

A plain ``sum(x) over (partition by g order by o)`` sends each group to a
single task; with five folds, or one label holding a third of all rows, that
is a handful of tasks for the whole table. Instead:

1. each row gets a *block*: a pure function of its order key that never decreases
   along the order, so a large group is cut into many ordered blocks;
2. running totals inside each ``(g, block)`` with a window (one hash exchange);
3. block totals per ``(g, block)`` -> exclusive prefix over blocks per group;
4. add the block offset back (same keys as the window, so no further exchange of
   the rows).

Because the block depends on nothing but the row, both branches and any
recomputed task agree on it, whatever columns are carried and whether or not
exchanges are reused.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_STEPS_PER_OCTAVE = 1024


def number_block(value: Column, descending: bool = False) -> list[Column]:
    """Blocks of a numeric key: its sign, then a step of its binary logarithm (about 0.07 %
    wide). Both never decrease with the value (nor, negated, against it). NULLs share a block."""
    x = value.cast("double")
    sign = F.signum(x)
    step = F.when(x == 0, F.lit(0.0)).otherwise(sign * F.floor(F.log2(F.abs(x)) * _STEPS_PER_OCTAVE))
    way = -1 if descending else 1
    return [sign * way, step * way]


def hex_block(digest: Column, digits: int = 3) -> list[Column]:
    """Blocks of a hex digest in ascending order: its leading digits (uniform by construction)."""
    return [F.substring(digest, 1, digits)]


def key_block(df: DataFrame, name: str) -> list[Column]:
    """Blocks of an id column in ascending order: numbers by size, text by the four characters after the
    prefix that all ids share (from their least and greatest value: two scalars)."""
    if dict(df.dtypes)[name] == "string":
        ends = [x or "" for x in df.agg(F.min(name), F.max(name)).first()]
        return [F.substring(F.col(name), 1, len(os.path.commonprefix(ends)) + 4)]
    return number_block(F.col(name))


def running_totals(df: DataFrame, group_cols: list[str], order: list[Column],
                   value_cols: list[str], block: list[Column], prefix: str = "cum_") -> DataFrame:
    """Add ``{prefix}{v}`` = inclusive running sum of ``v`` within ``group_cols`` following
    ``order`` (total, e.g. ending with a unique key); ``block`` columns ascend along it."""
    blks = [f"_sw_blk{i}" for i in range(len(block))]
    rows = df.select("*", *[b.alias(n) for b, n in zip(block, blks)])
    w_in = (Window.partitionBy(*group_cols, *blks).orderBy(*order)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = rows.select("*", *[F.sum(v).over(w_in).alias(f"_sw_l_{v}") for v in value_cols])
    totals = rows.groupBy(*group_cols, *blks).agg(*[F.sum(v).alias(f"_sw_t_{v}") for v in value_cols])
    w_off = Window.partitionBy(*group_cols).orderBy(*blks).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *group_cols, *blks,
        *[F.coalesce(F.sum(f"_sw_t_{v}").over(w_off), F.lit(0)).alias(f"_sw_o_{v}") for v in value_cols])
    cond = [local[c].eqNullSafe(offsets[c]) for c in [*group_cols, *blks]]
    joined = local.join(offsets, on=cond, how="inner")
    out_cols = [local[c] for c in df.columns] + [
        (F.col(f"_sw_l_{v}") + F.col(f"_sw_o_{v}")).alias(f"{prefix}{v}") for v in value_cols]
    return joined.select(*out_cols)
