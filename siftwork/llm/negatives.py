"""Operator 11, hard-negative mining: exact inner-product search with LEMP-style coordinate pruning.

Vectors are scaled and floored to integers; a score is the exact integer inner product.

1. ``quantised``: one row per usable vector with its length (norm) and length bucket, in the shared folder.
   A bucket spans a factor of 0.9 in length; buckets are cut into tiles of bounded size by
   a hash of the row, so a bucket that holds every vector is many tiles.
2. Anchors are cut into blocks of bounded size. Every (tile, block) pair is one group of a
   cogrouped Arrow function, which sorts the tile's normalised values per coordinate. For an
   anchor with threshold t, the cosine with a tile row must be at least
   t / (|anchor| * longest row), which bounds the row's value in any coordinate: with a =
   arccos(anchor's value) and b = arccos(that cosine), it lies in [cos(a + b), cos(a - b)]. The
   ranges of the anchor's ``focus`` largest coordinates are looked up in the sorted lists,
   the smallest gives the candidates, the other ranges are intersected with it, and what is
   left is verified by the exact score. A tile whose longest row can't reach t is skipped.
3. Thresholds: a first round searches every s-th tile of a bucket (s the square root of the number of
   tiles) and merges; the k-th best score so far is the threshold for all other tiles. So about
   2 k sqrt(tiles) rows an anchor meet in the merge, not k per tile.
4. Positives are the best rows of the anchor's label; negatives the best rows of other labels whose
   score lies within ``low`` and ``high`` percent of a positive's score.

Defined results: rows whose label or vector is null or has a null or non-finite
component (also after scaling) take no part; a null id is an ordinary row, after all others in ties, but no
anchor of an id condition; rows that repeat an id are rows of their own (the anchor itself is
one row); vectors of another dimension are not compared; an empty vector scores 0; scores
beyond 64 bits count as the nearest 64-bit value; an anchor without positives, or without rows in
the band, gives no row (a negative positive_score never has a band); other columns are ignored; an
empty table gives no row.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwork.llm.common import work_dir, written

_LENGTH_STEP = math.log(1 / 0.9)
_SLACK = 1e-6  # radians: covers the rounding of normalised values
_DENSE = 0.5   # a range with more of a tile's rows than this prunes too little to be looked up row by row
_CELLS = 1 << 22


# ---- one tile ---------------------------------------------------------------------------

class Tile:
    """Rows of one length bucket with a sorted list per coordinate. Rows are in the order of ties."""

    def __init__(self, vectors: np.ndarray):
        self.vectors, self.n = vectors, len(vectors)
        with np.errstate(over="ignore", invalid="ignore"):
            self.lengths = np.sqrt((vectors * vectors).sum(axis=1))
            unit = vectors / np.where(self.lengths > 0, self.lengths, 1)[:, None]
        self.longest = float(self.lengths.max(initial=0.0))
        self.prunable = bool(np.isfinite(self.longest))
        self.unit = unit
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.exact: dict[str, np.ndarray] = {}

    def sorted_list(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows by value, values) of coordinate f."""
        if f not in self.lists:
            order = np.argsort(self.unit[:, f], kind="stable")
            self.lists[f] = order, self.unit[order, f]
        return self.lists[f]

    def scores(self, rows: np.ndarray | None, queries: np.ndarray) -> np.ndarray:
        """Exact scores of queries (m x d) with rows (all if None), as 64-bit integers: in floats while
        every partial sum is exact, else in Python's integers."""
        top = float(np.sqrt((queries * queries).sum(axis=1)).max(initial=0.0)) * self.longest if self.prunable else math.inf
        kind = "f4" if top < 1 << 24 else "f8" if top < 1 << 53 else "O"
        if kind not in self.exact:
            self.exact[kind] = as_integers(self.vectors) if kind == "O" else self.vectors.astype(kind)
        have = self.exact[kind] if rows is None else self.exact[kind][rows]
        if kind != "O":
            return (queries.astype(kind) @ have.T).astype(np.int64)
        if not have.shape[1]:
            return np.zeros((len(queries), len(have)), np.int64)
        got = as_integers(queries) @ have.T
        return np.array([[min(max(int(x), -(1 << 63)), (1 << 63) - 1) for x in row] for row in got], np.int64).reshape(got.shape)

    def candidates(self, queries: np.ndarray, at_least: np.ndarray, focus: int) -> tuple[list[tuple[int, np.ndarray]], list[int]]:
        """For thresholds ``at_least`` per query: ([(query, rows that can reach it)], queries whose every row is a
        candidate). Queries that no row can reach are in neither."""
        pruned, whole = [], []
        if not self.prunable or not self.vectors.shape[1]:
            return pruned, list(range(len(queries)))
        lengths = np.sqrt((queries * queries).sum(axis=1))
        for k, (length, need) in enumerate(zip(lengths.tolist(), at_least.tolist(), strict=True)):
            bound = length * self.longest
            if need <= 0 or not math.isfinite(bound):
                whole.append(k)
                continue
            if need > bound * (1 + 1e-9):
                continue
            spread = math.acos(min(1.0, need / bound)) + _SLACK
            q = queries[k] / length
            ranges = []
            for f in np.argsort(-np.abs(q), kind="stable")[:focus].tolist():
                a = math.acos(max(-1.0, min(1.0, float(q[f]))))
                low, high = math.cos(min(math.pi, a + spread)), math.cos(max(0.0, a - spread))
                values = self.sorted_list(f)[1]
                i, j = int(np.searchsorted(values, low - 1e-12)), int(np.searchsorted(values, high + 1e-12, "right"))
                ranges.append((j - i, f, i, j, low - 1e-12, high + 1e-12))
            size, f, i, j, *_ = min(ranges)
            if size > _DENSE * self.n:
                whole.append(k)
                continue
            rows = self.sorted_list(f)[0][i:j]
            for size, other, _, _, low, high in sorted(ranges):
                if other != f and len(rows):
                    value = self.unit[rows, other]
                    rows = rows[(value >= low) & (value <= high)]
            if len(rows):
                pruned.append((k, np.sort(rows)))
        return pruned, whole


def as_integers(x: np.ndarray) -> np.ndarray:
    out = np.empty(x.shape, object)
    out.flat[:] = [int(v) for v in x.flat]
    return out


def search(tile: Tile, queries: np.ndarray, at_least: np.ndarray, focus: int):
    """(query, rows or None for all, their scores) for every query that some row may reach."""
    pruned, whole = tile.candidates(queries, at_least, focus)
    for k, rows in pruned:
        yield k, rows, tile.scores(rows, queries[k:k + 1])[0]
    step = max(1, _CELLS // max(1, tile.n))
    for a in range(0, len(whole), step):
        part = whole[a:a + step]
        for k, found in zip(part, tile.scores(None, queries[part]), strict=True):
            yield k, None, found


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, largest first, ties by place."""
    if len(scores) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        places = np.flatnonzero(scores >= cut)
    else:
        places = np.arange(len(scores))
    return places[np.argsort(-scores[places], kind="stable")][:k]


# ---- Spark ------------------------------------------------------------------------------

def quantised(vectors: DataFrame, id_col: str, label_col: str, vector_col: str, scale: float, anchor: Column) -> DataFrame:
    """(uid, id, label, anchor, dim, bucket, q) for usable rows; q = floors as little-endian doubles' shortest exact form."""
    values = vectors[vector_col].cast("array<double>")
    good = values.isNotNull() & ~F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x * F.lit(float(scale))) == F.lit(math.inf)))
    rows = vectors.filter(F.coalesce(good, F.lit(False)) & vectors[label_col].isNotNull())
    rows = rows.select(vectors[id_col].alias("id"), vectors[label_col].cast("string").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), values.alias("v"))
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            lists = batch.column(3)
            sizes = np.array(lists.value_lengths(), np.int64) if batch.num_rows else np.empty(0, np.int64)
            flat = np.floor(scale * np.asarray(lists.flatten(), np.float64))
            ends = np.cumsum(sizes).tolist()
            q, bucket = [], []
            for a, b in zip([0, *ends], ends, strict=False):
                x = flat[a:b]
                with np.errstate(over="ignore"):
                    length = float(np.sqrt((x * x).sum()))
                bucket.append(int(math.log(length) // _LENGTH_STEP) if 0 < length < math.inf else -(1 << 30) if length == 0 else 1 << 30)
                q.append(x.astype("<i2" if b == a or np.abs(x).max() < 1 << 15 else "<f8").tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sizes, pa.int64()), pa.array(bucket, pa.int64()), pa.array(q, pa.binary())], names=["id", "label", "anchor", "dim", "bucket", "q"])

    return rows.mapInArrow(run, f"id {id_type}, label string, anchor boolean, dim bigint, bucket bigint, q binary").withColumn("uid", F.monotonically_increasing_id())


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    raw = column.to_pylist()
    out = np.empty((len(raw), dim))
    if dim:
        for k, x in enumerate(raw):
            out[k] = np.frombuffer(x, "<i2" if len(x) == 2 * dim else "<f8")
    return out


def _codes(*columns: pa.ChunkedArray) -> list[np.ndarray]:
    """Equal labels get equal numbers in all columns."""
    known: dict = {}
    return [np.array([known.setdefault(x, len(known)) for x in c.to_pylist()], np.int64) for c in columns]


def _tie_order(table: pa.Table) -> pa.Table:
    return table.sort_by([("id", "ascending"), ("uid", "ascending")])  # nulls last


class _Mine:
    """Search jobs over the tiles of one table."""

    def __init__(self, rows: DataFrame, focus: int, tile_rows: int, block_anchors: int, least_tiles: int):
        self.focus = focus
        sizes = rows.groupBy("dim", "bucket").agg(F.count("*").alias("n"))
        total, anchors = rows.agg(F.count("*"), F.count_if("anchor")).first()
        tile_rows = min(tile_rows, max(256, -(-total // least_tiles)))  # small tables still give every core a tile
        self.blocks = max(1, -(-anchors // block_anchors))
        self.buckets = sizes.select("dim", "bucket", F.ceil(F.col("n") / tile_rows).cast("bigint").alias("tiles"))
        largest = self.buckets.agg(F.max("tiles")).first()[0] or 1
        self.step = math.isqrt(largest - 1) + 1
        # every tile row meets every block, every anchor every tile: bounded groups on both sides
        self.tiles = (rows.join(self.buckets, ["dim", "bucket"])
                      .withColumn("tile", F.pmod(F.xxhash64("uid"), F.col("tiles")))
                      .withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(self.blocks - 1).cast("bigint")))))

    def run(self, anchors: DataFrame, first: bool, kernel, schema: str) -> DataFrame:
        """kernel(tile table, anchor table, dim) over the first round's tiles or all others."""
        chosen = F.col("tile") % self.step == 0 if first else F.col("tile") % self.step != 0
        placed = (anchors.withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(self.blocks))).join(self.buckets, "dim")
                  .withColumn("tile", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tiles") - 1))).filter(chosen))
        keys = ["dim", "bucket", "tile", "block"]

        def pair(left: pa.Table, right: pa.Table) -> pa.Table:
            empty = pa.schema([pa.field(f.name, t) for f, t in zip(out, types, strict=True)])
            if not left.num_rows or not right.num_rows:
                return empty.empty_table()
            got = kernel(_tie_order(left), right, int(left.column("dim")[0].as_py()))
            return pa.Table.from_arrays([pa.concat_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c]).cast(t) for c, t in zip(got, types, strict=True)], schema=empty)

        from pyspark.sql.pandas.types import to_arrow_type
        from pyspark.sql.types import _parse_datatype_string
        out = _parse_datatype_string(schema)
        types = [to_arrow_type(f.dataType) for f in out]
        tiles = self.tiles.filter(chosen).select(*keys, "uid", "id", "label", "q")
        asked = placed.drop("tiles")
        asked = asked.toDF(*asked.columns)  # columns of its own: both sides come from one table
        return tiles.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(pair, out)


def _ordered(*by: str):
    return W.partitionBy(*by).orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("uid"))


def mine(vectors: DataFrame, anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", scale: float = 256.0,
         positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, focus: int = 6, tile_rows: int = 65_536,
         block_anchors: int = 16_384) -> DataFrame:
    """Hard negatives of the rows where ``anchor`` is true: (anchor_id, anchor_uid, positive_id, positive_rank, positive_score,
    rank, negative_id, negative_score), rank from 1 among the negatives of one anchor and positive."""
    if positives < 1 or negatives < 1:
        raise ValueError("positives and negatives must be at least 1")
    spark = vectors.sparkSession
    work = work_dir(spark, "negatives")
    rows = written(quantised(vectors, id_col, label_col, vector_col, scale, anchor), f"{work}/rows")
    id_type = rows.schema["id"].dataType.simpleString()
    job = _Mine(rows, focus, tile_rows, block_anchors, 2 * spark.sparkContext.defaultParallelism)
    anchors = rows.filter("anchor").select("uid", "id", "label", "dim", "q")

    def positive(left: pa.Table, right: pa.Table, dim: int):
        tile, queries = Tile(_matrix(left.column("q"), dim)), _matrix(right.column("q"), dim)
        uids, own = (t.column("uid").to_numpy() for t in (left, right))
        labels, wanted = _codes(left.column("label"), right.column("label"))
        need = right.column("need").to_pylist()
        least = np.array([-(1 << 63) if x is None else x for x in need], np.int64)
        found_q, found_r, found_s = [], [], []
        for k, rows_, scores in search(tile, queries, least, focus):
            places = np.flatnonzero((labels if rows_ is None else labels[rows_]) == wanted[k])
            places = places[scores[places] >= least[k]]
            at = places if rows_ is None else rows_[places]
            other = uids[at] != own[k]
            at, places = at[other], places[other]
            top = best(scores[places], positives)
            found_q.append(np.full(len(top), k))
            found_r.append(at[top])
            found_s.append(scores[places][top])
        q, r, s = (np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64) for x in (found_q, found_r, found_s))
        return [pa.array(own[q]), left.column("id").take(pa.array(r)), pa.array(uids[r]), pa.array(s)]

    schema = f"anchor_uid bigint, id {id_type}, uid bigint, score bigint"

    def top(found: DataFrame, k: int, *by: str) -> DataFrame:
        return found.withColumn("place", F.row_number().over(_ordered(*by))).filter(F.col("place") <= k)

    early = written(top(job.run(anchors.withColumn("need", F.lit(None).cast("bigint")), True, positive, schema), positives, "anchor_uid"), f"{work}/positives-1")
    floor = early.groupBy("anchor_uid").agg(F.when(F.count("*") >= positives, F.min("score")).alias("need"))
    seeded = anchors.join(floor.withColumnRenamed("anchor_uid", "uid"), "uid", "left")
    late = job.run(seeded, False, positive, schema)
    near = written(top(early.drop("place").unionAll(late), positives, "anchor_uid"), f"{work}/positives")

    share = lambda percent, f: f(F.col("score").cast("decimal(20,0)") * F.lit(percent).cast("decimal(10,0)") / F.lit(100)).cast("bigint")
    bands = near.select("anchor_uid", "place", share(low, F.ceil).alias("low"), share(high, F.floor).alias("high")).filter("low <= high")

    def asked(least: DataFrame) -> DataFrame:
        """Anchors with their positives' bands and thresholds, as arrays."""
        grouped = least.groupBy("anchor_uid").agg(F.sort_array(F.collect_list(F.struct("place", "low", "high"))).alias("bands"))
        return anchors.join(grouped.withColumnRenamed("anchor_uid", "uid"), "uid")

    def negative(left: pa.Table, right: pa.Table, dim: int):
        tile, queries = Tile(_matrix(left.column("q"), dim)), _matrix(right.column("q"), dim)
        uids, own = (t.column("uid").to_numpy() for t in (left, right))
        labels, wanted = _codes(left.column("label"), right.column("label"))
        band = right.column("bands").to_pylist()
        least = np.array([min(b["low"] for b in x) for x in band], np.int64)
        most = np.array([max(b["high"] for b in x) for x in band], np.int64)
        found_q, found_p, found_r, found_s = [], [], [], []
        for k, rows_, scores in search(tile, queries, least, focus):
            places = np.flatnonzero((scores >= least[k]) & (scores <= most[k]))
            at = places if rows_ is None else rows_[places]
            differ = labels[at] != wanted[k]
            at, have = at[differ], scores[places[differ]]
            order = np.argsort(-have, kind="stable")
            at, falling = at[order], -have[order]
            for b in band[k]:
                i, j = np.searchsorted(falling, -b["high"]), np.searchsorted(falling, -b["low"], "right")
                j = min(j, i + negatives)
                found_q.append(np.full(max(0, j - i), k))
                found_p.append(np.full(max(0, j - i), b["place"]))
                found_r.append(at[i:j])
                found_s.append(-falling[i:j])
        q, p, r, s = (np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64) for x in (found_q, found_p, found_r, found_s))
        return [pa.array(own[q]), pa.array(p), left.column("id").take(pa.array(r)), pa.array(uids[r]), pa.array(s)]

    schema = f"anchor_uid bigint, positive bigint, id {id_type}, uid bigint, score bigint"
    pair = ("anchor_uid", "positive")
    early = written(top(job.run(asked(bands), True, negative, schema), negatives, *pair), f"{work}/negatives-1")
    floor = early.groupBy(*pair).agg(F.when(F.count("*") >= negatives, F.min("score")).alias("need")).withColumnRenamed("positive", "place")
    raised = bands.join(floor, ["anchor_uid", "place"], "left").select("anchor_uid", "place", F.greatest("low", "need").alias("low"), "high")
    late = job.run(asked(raised), False, negative, schema)
    hard = top(early.drop("place").unionAll(late), negatives, *pair)

    near = near.select("anchor_uid", F.col("place").alias("positive"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    names = anchors.select(F.col("uid").alias("anchor_uid"), F.col("id").alias("anchor_id"))
    return (hard.withColumnRenamed("place", "rank").join(near, list(pair)).join(names, "anchor_uid")
            .select("anchor_id", "anchor_uid", "positive_id", F.col("positive").alias("positive_rank"), "positive_score", "rank",
                    F.col("id").alias("negative_id"), F.col("score").alias("negative_score")))
