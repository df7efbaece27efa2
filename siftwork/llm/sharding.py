"""Operator 5, sharding: sampled splitters (native).

Rows are put in one order and cut into shards of near equal bytes.

* The order is (hash of the text, hash of the id, id): uniform, and equal texts are neighbours.
* A sample, in which a row is drawn in proportion to its size (and a share equal for all
  rows), gives quantile boundaries of the text hash: the splitters of fine ranges, each bounded
  in bytes and rows. A key that fills
  several quantiles by itself (a hot group of copies) is an overfull range: it gets a
  range of its own, subdivided by the id hash into as many pieces as quantiles it filled.
* Within a range, windows give running bytes and row numbers; one row per range gives the
  ranges' offsets. No window sees more than a range.
* A row's place in the total bytes decides its shard. A group of copies goes where its
  first row goes, unless it is larger than ``group_share`` of a shard: then its rows
  are placed one by one. So shards differ by little more than the largest row plus that share.
* Slots number a shard's rows in the same order, from counts per (range, shard).

The number of splitters grows with the rows but is bounded by ``max_ranges``, which bounds
the literal that every task gets.

Defined results: null and empty texts have the size of the fixed part only; rows that
repeat an id get slots of their own; null ids sort first; extra columns are left alone.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwork.llm.common import work_dir, written

FIXED_BYTES = 16
_KEY_SHIFT = 11  # 53 bits of the hash: quantiles pass through doubles and must give keys back exactly


def _splitters(rows: DataFrame, ranges: int, per_range: int) -> list[int]:
    """Quantiles of ``key`` from a sample of about ``ranges * per_range`` draws. Half of the weight is
    the size and half is the same for every row, so a range is bounded in bytes and in rows
    (a hot group of short texts is small in bytes only)."""
    total, n = rows.agg(F.sum("size"), F.count("*")).first()
    if not n:
        return []
    weight = (F.col("size") / float(total) + 1.0 / n) / 2 * ranges * per_range
    # systematic draws: whole steps surely, the rest by a uniform hash
    u = F.shiftrightunsigned(F.xxhash64(F.lit("draw"), "spread", "key"), 11) / float(1 << 53)
    draws = rows.withColumn("draws", F.floor(weight + u)).filter("draws > 0")
    sample = draws.select("key", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("draws"))).alias("_"))
    cuts = sample.agg(F.percentile_approx("key", [k / ranges for k in range(1, ranges)], 20 * ranges)).first()[0]
    return list(cuts or [])


def _range_of(splitters: list[int]):
    """(range, pieces): even ranges lie between splitters, odd ranges are the splitters that
    occur more than once, i.e. hot keys, with as many pieces."""
    distinct = sorted(set(splitters))
    if not distinct:
        return F.lit(0).cast("bigint"), F.lit(1)
    hot = {s: n for s, n in Counter(splitters).items() if n > 1}
    # two-level search: coarse steps first, then one slice
    width = max(1, int(len(distinct) ** 0.5))
    slices = [distinct[k:k + width] for k in range(0, len(distinct), width)]
    key = F.col("key")
    coarse = F.size(F.filter(F.array(*(F.lit(s[0]) for s in slices)), lambda s: s <= key))
    table = F.array(*(F.array(*map(F.lit, s)) for s in slices))
    fine = F.size(F.filter(F.element_at(table, F.greatest(coarse, F.lit(1))), lambda s: s <= key))
    below = F.when(coarse == 0, 0).otherwise((coarse - 1) * width + fine)  # splitters <= key
    pieces = F.lit(None)
    if hot:
        pieces = F.element_at(F.create_map(*(F.lit(x) for kv in hot.items() for x in kv)), key)
    return F.when(pieces.isNull(), 2 * below).otherwise(2 * below - 1).cast("bigint"), F.coalesce(pieces, F.lit(1))


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 40, group_share: float = 0.01,
          ranges_per_shard: int = 8, rows_per_range: int = 500_000, max_ranges: int = 65_536, per_range: int = 64) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row."""
    work = work_dir(docs.sparkSession, "sharding")
    text = F.coalesce(docs[text_col], F.lit(""))
    # rows without an id are spread by their place, which is fixed when they are written
    spread = F.xxhash64(F.lit("spread"), F.coalesce(docs[id_col].cast("string"), F.concat(F.lit("#"), F.monotonically_increasing_id().cast("string"))))
    rows = written(docs.select(
        docs[id_col].alias("doc_id"), (F.octet_length(text) + FIXED_BYTES).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.shiftright(F.xxhash64(text), _KEY_SHIFT).alias("key"), spread.alias("spread")), f"{work}/rows")
    ranges = min(max_ranges, max(shards * ranges_per_shard, rows.count() // rows_per_range))
    band, pieces = _range_of(_splitters(rows, ranges, per_range))
    piece = F.floor(F.shiftrightunsigned("spread", 11) / float(1 << 53) * pieces)
    ranged = rows.withColumn("band", band).withColumn("piece", piece)

    # running bytes within a piece of a range, and the group of copies each row belongs to
    order = [F.col("key"), F.col("spread"), F.col("doc_id").asc_nulls_first(), F.col("size")]
    part = W.partitionBy("band", "piece")
    group = W.partitionBy("band", "piece", "key")
    placed = (ranged.withColumn("up_to", F.sum("size").over(part.orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
              .withColumn("before", F.col("up_to") - F.col("size"))
              .withColumn("group_before", F.min("before").over(group)).withColumn("group_bytes", F.sum("size").over(group)))
    # one row per piece of a range
    offsets = ranged.groupBy("band", "piece").agg(F.sum("size").alias("bytes"))
    offsets = offsets.withColumn("base", F.sum("bytes").over(W.orderBy("band", "piece")) - F.col("bytes")).withColumn("total", F.sum("bytes").over(W.partitionBy()))
    small = (F.col("band") % 2 == 0) & (F.col("group_bytes") <= group_share * F.col("total") / shards)
    at = F.col("base") + F.when(small, F.col("group_before") + F.col("group_bytes") / 2).otherwise(F.col("before") + F.col("size") / 2)
    sharded = placed.join(offsets, ["band", "piece"]).withColumn("shard", F.least(F.lit(shards - 1), F.floor(at * shards / F.col("total"))).cast("int"))
    numbered = sharded.withColumn("nth", F.row_number().over(W.partitionBy("band", "piece", "shard").orderBy(*order)))
    numbered = written(numbered.select("doc_id", "size", "text_crc32", "shard", "band", "piece", "nth"), f"{work}/numbered")
    counts = numbered.groupBy("shard", "band", "piece").agg(F.count("*").alias("n"))
    first = counts.select("shard", "band", "piece", (F.sum("n").over(W.partitionBy("shard").orderBy("band", "piece")) - F.col("n")).alias("first"))
    return numbered.join(first, ["shard", "band", "piece"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("nth") - 1).alias("slot"))
