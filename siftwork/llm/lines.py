"""Operator 9, line dedup: distinct-site spread (native).

A line that occurs on many sites is boilerplate. For each line hash a HyperLogLog sketch
of the sites it occurs on is built on the map side and merged by aggregation, so a line
that a third of all rows hold is one small sketch per task. Lines whose estimate is
surely above the limit are boilerplate; those whose estimate lies within ``margin`` standard
errors of the limit get an exact distinct count, so the decision is exact there.
Boilerplate lines are then removed from every document.

Documents meet the boilerplate through narrow (document key, line hash, line number) rows; each
document gets the numbers of its lines to remove (never more than it has) and takes its other
lines by number, in time proportional to its lines: the text is shuffled once.

Defined results: a line is compared without the white space around it; lines without a
word are never removed; a null site counts as one site of its own; null and empty texts
have one empty line and stay as they are (null stays null); rows that repeat are cleaned
one by one; other columns are kept.
"""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.llm.common import WHITESPACE, work_dir, written


def _trimmed(line: Column) -> Column:
    return F.trim(line, F.lit(WHITESPACE))


def _key(id_col: Column, text: Column) -> Column:
    """Names a document by id and text: rows with the same key have the same lines."""
    return F.xxhash64(id_col, text)


def spread_lines(docs: DataFrame, text_col: str, site_col: str, min_sites: int, lg_k: int = 10, margin: float = 4.0) -> tuple[DataFrame, DataFrame]:
    """(narrow line rows, hashes of lines that occur on at least ``min_sites`` sites)."""
    work = work_dir(docs.sparkSession, "lines")
    text = docs[text_col]
    each = docs.select(_key(docs["doc_id"], text).alias("key"), F.coalesce(docs[site_col].cast("string"), F.lit("")).alias("site"),
                       docs[site_col].isNull().alias("no_site"), F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("at", "line"))
    trimmed = _trimmed(F.col("line"))
    rows = written(each.filter(trimmed != "").select("key", "at", F.xxhash64(trimmed).alias("h"), F.xxhash64("site", "no_site").alias("site")), f"{work}/lines")
    estimates = rows.groupBy("h").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k))).alias("sites"))
    error = margin * 1.04 / sqrt(1 << lg_k)
    low, high = min_sites * (1 - error) - 1, min_sites * (1 + error) + 1
    spread = written(estimates.filter(F.col("sites") >= low), f"{work}/spread")
    near = spread.filter(F.col("sites") <= high).select("h")
    exact = rows.join(near, "h").groupBy("h", "site").agg(F.lit(1)).groupBy("h").agg(F.count("*").alias("sites")).filter(F.col("sites") >= min_sites)
    sure = spread.filter(F.col("sites") > high).select("h")
    return rows, written(sure.unionAll(exact.select("h")), f"{work}/boilerplate")


def drop_boilerplate(docs: DataFrame, text_col: str = "text", site_col: str = "source", min_sites: int = 10, lg_k: int = 10,
                     margin: float = 4.0) -> DataFrame:
    """``docs`` with boilerplate lines removed from the text, and two columns more:
    ``n_lines`` and ``n_removed`` (names already present are replaced)."""
    rows, boilerplate = spread_lines(docs, text_col, site_col, min_sites, lg_k, margin)
    hits = rows.select("key", "at", "h").join(boilerplate, "h").groupBy("key").agg(F.collect_set("at").alias("drop_lines"))
    keyed = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), _key(docs["doc_id"], docs[text_col]).alias("key"), docs[text_col].alias("text"))
    joined = keyed.join(hits, "key", "left")
    # each step is a column of its own, used more than once, so that a lambda reads an array made once for the row
    cleaned = joined.withColumn("all_lines", F.split("text", "\n"))
    left = F.array_except(F.sequence(F.lit(0), F.size("all_lines") - 1), "drop_lines")  # a set lookup per line
    cleaned = cleaned.withColumn("left_lines", F.when(F.col("drop_lines").isNull(), F.col("all_lines")).otherwise(F.transform(left, lambda i: F.get("all_lines", i))))
    n_lines = F.coalesce(F.size("all_lines"), F.lit(1)).cast("bigint")
    n_lines = F.when(F.col("text").isNull(), F.lit(1)).otherwise(n_lines).cast("bigint")
    n_removed = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size("all_lines") - F.size("left_lines")).cast("bigint")
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return cleaned.select(*(F.array_join("left_lines", "\n").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in kept),
                          n_lines.alias("n_lines"), n_removed.alias("n_removed"))
