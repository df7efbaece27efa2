"""Operator 1, exact dedup: distributed MSD radix partitioning.

Documents are split into groups by successive bytes of the compared text, most
significant first. A round's digit is the next ``w`` bytes (``w`` starts at
``first_digit`` and grows by ``growth`` each round, so the number of rounds is
logarithmic in the longest text). In each round

* one aggregate over (group, digit), combined on the map side, gives the size and the
  smallest member of every subgroup: a group of copies of any size is one row per task;
* a left join on (group, digit) takes subgroups of two or more back to the documents
  (adaptive execution splits a hot subgroup's partition);
* singletons are final, members whose text ended inside the digit are final copies of
  each other, and only the others go on, without the bytes already consumed.

Equality rests on the bytes themselves; no digest takes part. A group is named by its
smallest member, which is unique because members are. Rounds are written to the shared
folder.

Of equal texts the row with the most code points in the original text, then the
smallest id, stays.

Defined results: null and empty texts are equal empty texts; rows that repeat an id are
separate members (numbered by their text); a null id loses every tie and ``keep_id`` is
null only if all members' ids are; extra columns are carried when asked for, under
their own names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwork.llm.common import WHITESPACE_RE, work_dir, written


def without_white_space(text: Column) -> Column:
    """The compared form of the contract: every character of [\\x20\\x09-\\x0D] deleted."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITESPACE_RE, "")


def _occurrence(base: DataFrame) -> DataFrame:
    """Number rows that repeat an id, so that (id, occurrence) names one row. The numbering
    (a shuffle of the texts) runs only if an id does repeat; a salt from the text spreads a hot id."""
    repeated = base.groupBy("doc_id").count().filter("count > 1").limit(1).count()
    if not repeated:
        return base.withColumn("occ", F.lit(0).cast("bigint"))
    salt = F.pmod(F.xxhash64("rest"), F.lit(1 << 20))
    w = W.partitionBy("doc_id", "salt").orderBy("rest", "n_code_points")
    return (base.withColumn("salt", salt).withColumn("occ", F.row_number().over(w) * F.lit(1 << 20).cast("bigint") + F.col("salt"))
            .drop("salt"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", compared=without_white_space,
                 carry: dict[str, Column] | None = None, first_digit: int = 64, growth: int = 16) -> DataFrame:
    """(doc_id, keep_id, group_size, kept) and the carried columns, one row per input row."""
    carry = carry or {}
    work = work_dir(docs.sparkSession, "exact")
    text = docs[text_col]
    rows = _occurrence(docs.select(
        docs[id_col].alias("doc_id"), F.coalesce(F.length(text), F.lit(0)).alias("n_code_points"),
        compared(text).cast("binary").alias("rest"), F.struct(*(c.alias(n) for n, c in carry.items()), F.lit(0).alias("_")).alias("carried")))
    no_name = F.lit(None).cast("struct<doc_id:{0},occ:bigint>".format(rows.schema["doc_id"].dataType.simpleString()))
    rows = rows.withColumn("group", no_name)
    finished, width, level = [], first_digit, 0
    while True:
        rows = rows.withColumn("digit", F.substring("rest", 1, width))
        sizes = (rows.groupBy("group", "digit")
                 .agg(F.count("*").alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "occ")).alias("least"),
                      F.min(F.struct((-F.col("n_code_points")).alias("minus_n"), F.col("doc_id").isNull().alias("unnamed"), "doc_id", "occ")).alias("best"))
                 .filter("n > 1"))
        both = sizes.select(F.col("group").alias("g"), F.col("digit").alias("d"), "n", "least", "best")
        found = rows.join(both, F.col("group").eqNullSafe(F.col("g")) & (F.col("digit") == F.col("d")), "left")
        ended = F.length("digit") < width
        found = found.withColumn("open", F.col("n").isNotNull() & ~ended)
        is_open = F.col("open")
        out = found.select(
            "doc_id", "occ", "n_code_points", "carried",
            F.when(is_open, F.struct(F.col("least.doc_id").alias("doc_id"), F.col("least.occ").alias("occ"))).alias("group"),
            F.when(is_open, F.expr(f"substring(rest, {width + 1})")).alias("rest"),
            F.when(~is_open, F.coalesce("n", F.lit(1))).alias("group_size"),
            F.when(~is_open, F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id"))).alias("keep_id"),
            (F.col("n").isNull() | ((F.col("best.minus_n") == -F.col("n_code_points"))
                                    & F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("occ") == F.col("best.occ")))).alias("kept"),
            "open")
        stored = written(out, f"{work}/round-{level}", partition_by="open")
        finished.append(stored.filter("not open").select("doc_id", "keep_id", "group_size", "kept", "carried"))
        rows = stored.filter("open").select("doc_id", "occ", "n_code_points", "carried", "group", "rest")
        if rows.isEmpty():
            break
        width, level = width * growth, level + 1
    whole = finished[0]
    for part in finished[1:]:
        whole = whole.unionAll(part)
    return whole.select("doc_id", "keep_id", F.col("group_size").cast("bigint").alias("group_size"), "kept",
                        *(F.col(f"carried.`{n}`").alias(n) for n in carry))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    names = [f"c{k}" for k in range(len(docs.columns))]
    carry = {n: docs[c] for n, c in zip(names, docs.columns, strict=True)}
    kept = exact_groups(docs, id_col, text_col, carry=carry, **options).filter("kept")
    return kept.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)))
