"""Seeded, engine-independent splits: stratified k-fold, stratified hold-out,
balanced samples, random k per label, full shuffle.

Randomness is a hash order: ``md5(concat(id, ':', seed))`` with the id as
tie-break, identical in Spark and DuckDB. Ranks inside a class use blocked
running totals (``prefix.running_totals``), so a class holding most rows is
still ranked by many tasks; top-k picks use ``row_number() <= k``, which Spark
executes with a per-partition group limit before the shuffle.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwork.operators.prefix import hex_block, running_totals
from siftwork.session import cut_lineage


def hash_key(id_col: str = "id", seed: int = 42) -> F.Column:
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")))


def class_rank(df: DataFrame, label: str = "label", id_col: str = "id", seed: int = 42,
               out: str = "_rank") -> DataFrame:
    """0-based rank of each row inside its class in hash order, plus the class size."""
    x = df.withColumn("_h", hash_key(id_col, seed)).withColumn("_one", F.lit(1))
    r = running_totals(x, [label], [F.col("_h"), F.col(id_col)], ["_one"], hex_block(F.col("_h")))
    sizes = x.groupBy(label).agg(F.count(F.lit(1)).alias("_class_n"))
    cond = [r[label].eqNullSafe(sizes[label])]
    j = r.join(sizes, on=cond, how="inner").select(*[r[c] for c in r.columns], "_class_n")
    return j.withColumn(out, F.col("cum__one") - 1).drop("_one", "cum__one", "_h")


def stratified_folds(df: DataFrame, k: int = 5, label: str = "label", id_col: str = "id",
                     seed: int = 42) -> DataFrame:
    """fold = rank-in-class % k: folds are disjoint, complete, and per-class counts
    differ by at most one between folds."""
    r = class_rank(df, label, id_col, seed)
    return r.withColumn("fold", (F.col("_rank") % k).cast("int")).drop("_rank", "_class_n")


def holdout_split(df: DataFrame, test: float = 0.2, val: float = 0.0, label: str = "label",
                  id_col: str = "id", seed: int = 42) -> DataFrame:
    """Stratified hold-out: per class, the first round(n*test) rows in hash order are
    'test', the next round(n*val) 'val', the rest 'train' (60/20/20 = test .2, val .2)."""
    r = class_rank(df, label, id_col, seed)
    n = F.col("_class_n").cast("double")
    n_test = F.round(n * F.lit(float(test)), 0)
    n_val = F.round(n * F.lit(float(val)), 0)
    part = (F.when(F.col("_rank") < n_test, F.lit("test"))
            .when(F.col("_rank") < n_test + n_val, F.lit("val")).otherwise(F.lit("train")))
    return r.withColumn("split", part).drop("_rank", "_class_n")


def top_k_per_group(df: DataFrame, k: int, group_cols, order) -> DataFrame:
    w = Window.partitionBy(*group_cols).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def random_per_label(df: DataFrame, k: int, label: str = "label", id_col: str = "id",
                     seed: int = 42) -> DataFrame:
    """k rows per label value in hash order (the seeded 'random examples' pick)."""
    return top_k_per_group(df, k, [label], [hash_key(id_col, seed), F.col(id_col)])


def hash_rank(df: DataFrame, id_col: str = "id", seed: int = 42, out: str = "position") -> DataFrame:
    """0-based position of every row in the seeded full shuffle (hash order, ties by id)."""
    x = df.withColumn("_h", hash_key(id_col, seed)).withColumn("_one", F.lit(1))
    r = running_totals(x, [], [F.col("_h"), F.col(id_col)], ["_one"], hex_block(F.col("_h")))
    return r.withColumn(out, F.col("cum__one") - 1).drop("_h", "_one", "cum__one")


def balanced_sample(df: DataFrame, n: int, include_share: float, label: str = "label",
                    id_col: str = "id", seed: int = 42) -> DataFrame:
    """n rows with ceil(n * share) positives (clamped to what exists; share -1 means no
    quota), filled from the remaining rows in hash order; if every sampled row is
    positive and a negative exists, the last sampled row is swapped for one negative.
    Output carries ``sample_order`` (its position in the sample's own hash order).

    The rows are never ranked: the hashes at the two cuts (of the positives, and of the rest)
    are selected from counts per hash prefix, and a row's place follows from its own hash. Only
    where rows of one id lie on both sides of a cut are they told apart by blocked ranks."""
    requested = int(math.ceil(n * float(include_share))) if include_share != -1 else 0
    cols = df.columns
    h, yes = F.coalesce(hash_key(id_col, seed), F.lit("")), F.coalesce(F.col(label), F.lit(False))
    swap = F.struct(hash_key(id_col, seed + 1).alias("h"), F.col(id_col).alias("id"))
    keys = cut_lineage(df.select(h.alias("_h"), yes.alias("_yes"), F.col(label).cast("int").alias("_y"), F.col(id_col).alias("_id"), swap.alias("_swap")))
    cut = _first_hashes(keys.where("_yes"), requested)
    picked = F.col("_yes") & (F.col("_h") <= cut.hash)
    fill = _first_hashes(keys.where(~picked), n - min(cut.found, n))
    in_sample = picked | (F.col("_h") <= fill.hash)
    if cut.split or fill.split or cut.found > n:
        return _sampled_by_rank(df, n, requested, label, id_col, seed)
    summary = keys.agg(F.min(F.when(in_sample, F.col("_y"))).alias("all_positive"), F.max(F.when(in_sample, F.struct(F.col("_h").alias("h"), F.col("_id").alias("id")))).alias("last"),
                       F.min(F.when(F.col("_y") == 0, F.col("_swap"))).alias("first_negative")).first()
    taken = df.where((yes & (h <= cut.hash)) | (h <= fill.hash))
    return _in_sample_order(df, taken, summary, label, id_col, seed)


class _Cut(NamedTuple):
    """The first rows in hash order: those up to ``hash`` (null: none). ``split``: rows with that very hash lie on both sides."""
    hash: str | None
    found: int
    split: bool


_FEW = 4096


def _first_hashes(keys: DataFrame, k: int) -> _Cut:
    """Where the ``k`` least ``_h`` of ``keys`` end (all of them, if fewer). Each pass counts rows per prefix, three hex digits
    longer, within the prefix that holds the cut: at most 4,097 counts; then the hashes of a prefix with few rows."""
    if k <= 0:
        return _Cut(None, 0, False)
    prefix, left, exact = "", k, False
    while True:
        part = F.col("_h") if exact else F.substring("_h", 1, len(prefix) + 3)
        counts = sorted(keys.where(F.col("_h").startswith(prefix)).groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
        if left > sum(r.n for r in counts):  # the first pass only: fewer than k rows
            return _Cut("g", sum(r.n for r in counts), False)  # above every hex digest
        for p, rows in counts:
            if left <= rows:
                break
            left -= rows
        if exact or len(p) != len(prefix) + 3:
            return _Cut(p, k, left < rows)
        prefix, exact = p, rows <= _FEW


def _sampled_by_rank(df: DataFrame, n: int, requested: int, label: str, id_col: str, seed: int) -> DataFrame:
    cols = df.columns
    ranked = class_rank(df, label, id_col, seed)
    picked = F.coalesce(F.col(label), F.lit(False)) & (F.col("_rank") < requested)
    rows = ranked.select(*cols, F.coalesce(picked, F.lit(False)).alias("_picked"))
    rest = hash_rank(rows.where(~F.col("_picked")), id_col, seed, "_pool")
    taken = rows.where("_picked").withColumn("_pool", F.lit(-1).cast("long")).unionByName(rest)
    n_picked = rows.agg(F.count_if("_picked")).scalar()
    taken = cut_lineage(taken.where(F.col("_pool") < F.greatest(F.lit(0), F.lit(n) - n_picked)).select(*cols))
    summary = taken.agg(F.min(F.col(label).cast("int")).alias("all_positive"), F.max(F.struct(hash_key(id_col, seed).alias("h"), F.col(id_col).alias("id"))).alias("last"),
                        df.where(~F.col(label)).agg(F.min(F.struct(hash_key(id_col, seed + 1).alias("h"), F.col(id_col).alias("id")))).scalar().alias("first_negative")).first()
    return _in_sample_order(df, taken, summary, label, id_col, seed)


def _in_sample_order(df: DataFrame, taken: DataFrame, summary, label: str, id_col: str, seed: int) -> DataFrame:
    """The sample with ``sample_order``; one of positives only gives its last row up for the first negative of another order."""
    cols, first_negative = df.columns, summary.first_negative
    if summary.all_positive == 1 and first_negative is not None:
        negative = df.where((F.col(id_col) == F.lit(first_negative.id)) & ~F.col(label))
        order = F.when(F.col(id_col) == F.lit(first_negative.id), F.lit(summary.last.h)).otherwise(hash_key(id_col, seed))
        taken = taken.where(F.col(id_col) != F.lit(summary.last.id)).unionByName(negative)
    else:
        order = hash_key(id_col, seed)
    x = taken.withColumn("_h", order).withColumn("_one", F.lit(1))
    r = running_totals(x, [], [F.col("_h"), F.col(id_col)], ["_one"], hex_block(F.col("_h")))
    return r.select(*cols, (F.col("cum__one") - 1).alias("sample_order"))
