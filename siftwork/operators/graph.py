"""Neighbour graph of all vectors: every row's nearest others without all pairs.

1. Start, ``starts`` times with other centres: vectors are filed in the cell of their nearest centre (centres are fitted
   on a bounded sample); cells are cut into pieces of at most ``piece_rows`` rows, and each piece gives its rows their nearest in the piece.
2. Rounds (nearest-neighbour descent): a neighbour of a neighbour is likely a neighbour. Each node's
   list and a bounded, hash-drawn share of the nodes that list it are joined with themselves on the node; pairs
   in which at least one side entered a list in the last round, and that no list holds, are
   measured, and every list keeps its ``k`` nearest. Lists that take up a pair are tried again in the next round.
3. It ends when a round changes at most ``least_change`` of all list entries.

A node's joined neighbours number at most 2 k, so a round makes at most 2 k^2 pairs a node, whatever the data; a hub that a
third of all rows list passes on ``k`` of them (a group-limited window prunes before the shuffle). Every
round is written to the shared folder. Rows are matched by equi-joins only.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwork.operators.vectors import _to_cells, _unit, fit_cells
from siftwork.session import ensure_checkpoint_dir


@dataclass
class Graph:
    """neighbours: (id, rank, neighbor_id, distance); distances: number of pairs measured; rounds: rounds run."""

    neighbours: DataFrame
    distances: int
    rounds: int


def neighbour_graph(vectors: DataFrame, k: int = 8, id_col: str = "id", vec: str = "embedding", cell_rows: int = 24, most_cells: int = 4096,
                    piece_rows: int = 2048, least_change: float = 0.002, max_rounds: int = 30, starts: int = 2, seed: int = 42) -> Graph:
    """Approximate ``k`` nearest others by cosine distance for every row with a vector; ids must be unique.

    A zero vector is at distance 1 from every other. Rows with a null id or vector take no part. ``max_rounds`` reached
    before the end raises an error."""
    spark = vectors.sparkSession
    work = f"{ensure_checkpoint_dir(spark)}/graph-{uuid.uuid4().hex[:12]}"

    def stored(x: DataFrame, name: str) -> DataFrame:
        x.write.mode("overwrite").parquet(f"{work}/{name}")
        return spark.read.schema(x.schema).parquet(f"{work}/{name}")

    kind = vectors.schema[id_col].dataType.simpleString()

    def to_unit(batches):
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"id": pdf["id"], "v": list(_unit(pdf["v"]))})

    named = vectors.where(F.col(id_col).isNotNull() & F.col(vec).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec).alias("v"))
    nodes = stored(named.mapInPandas(to_unit, f"id {kind}, v array<double>"), "nodes")
    n = nodes.count()
    lists_of = lambda df: _top(df, k)
    empty = spark.createDataFrame([], f"id {kind}, neighbor_id {kind}, distance double, fresh boolean")
    if n < 2:
        return Graph(_ranked(empty), 0, 0)

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        v, ids = np.vstack(pdf["vec"].to_numpy()), pdf["id"].to_numpy()
        out = []
        for a in range(0, len(ids), 512):
            d = 1.0 - v[a:a + 512] @ v.T
            d[np.arange(len(d)), a + np.arange(len(d))] = np.inf
            m = min(k, len(ids) - 1)
            near = np.argpartition(d, m - 1, axis=1)[:, :m] if m else np.empty((len(d), 0), int)
            out.append(pd.DataFrame({"id": np.repeat(ids[a:a + 512], m), "neighbor_id": ids[near.ravel()], "distance": np.take_along_axis(d, near, axis=1).ravel(), "fresh": True}))
        return pd.concat(out, ignore_index=True)

    measured, first = 0, empty
    for start in range(starts):  # independent cells: a pair that one start parts may meet in another
        centres = fit_cells(nodes, max(1, min(most_cells, n // cell_rows)), "v", "id", seed=seed + start)
        filed = stored(_to_cells(nodes, "id", "v", centres, 1), f"filed-{start}")
        sizes = filed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(piece_rows)).cast("int").alias("pieces"))
        cut = filed.join(sizes, "cell").withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces")))
        measured += cut.groupBy("cell", "piece").agg(F.count(F.lit(1)).alias("m")).agg(F.sum(F.col("m") * (F.col("m") - 1) / 2)).first()[0] or 0
        near = cut.select("id", "vec", "cell", "piece").groupBy("cell", "piece").applyInPandas(inside, f"id {kind}, neighbor_id {kind}, distance double, fresh boolean")
        first = first.unionAll(near)
    lists = stored(lists_of(first), "lists-0")
    # every node also meets the next node in its bucket of a hash, so that a node alone in its cell has a list and cells are joined
    ring = nodes.select("id", F.xxhash64(F.lit(seed), "id").alias("h"))
    buckets = max(1, n // 4)
    met = ring.withColumn("bucket", F.pmod("h", F.lit(buckets)))
    few = met.withColumn("nth", F.row_number().over(Window.partitionBy("bucket").orderBy("h", "id"))).where("nth <= 64")
    far = few.select("bucket", F.col("id").alias("a"), "nth").join(few.select("bucket", F.col("id").alias("b"), F.col("nth").alias("m")), "bucket").where("m = nth + 1").select("a", "b")
    pairs, turn = _unknown(far, lists), 0
    while True:
        pairs = stored(_measured(pairs, nodes), f"pairs-{turn}")
        measured += pairs.count()
        both = pairs.select(F.col("a").alias("id"), F.col("b").alias("neighbor_id"), "distance").unionAll(pairs.select(F.col("b").alias("id"), F.col("a").alias("neighbor_id"), "distance"))
        was = lists if turn == 0 else lists.withColumn("fresh", F.lit(False))  # the start's entries are all fresh in round 1
        lists = stored(lists_of(was.unionAll(both.withColumn("fresh", F.lit(True)))), f"lists-{turn + 1}")
        changed = lists.where("fresh").count()
        if turn and changed <= least_change * k * n:
            return Graph(_ranked(lists), int(measured), turn)
        turn += 1
        if turn > max_rounds:
            raise RuntimeError(f"lists still change after {max_rounds} rounds")
        back = lists.select(F.col("neighbor_id").alias("node"), F.col("id").alias("other"), "fresh", F.xxhash64(F.lit(turn), "id").alias("draw"))
        back = back.withColumn("nth", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("fresh"), "draw", "other"))).where(F.col("nth") <= k).select("node", "other", "fresh")
        about = lists.select(F.col("id").alias("node"), F.col("neighbor_id").alias("other"), "fresh").unionAll(back)
        about = stored(about.groupBy("node", "other").agg(F.max("fresh").alias("fresh")), f"about-{turn}")
        other = about.select("node", F.col("other").alias("b"), F.col("fresh").alias("fresh_b"))
        found = about.select("node", F.col("other").alias("a"), "fresh").join(other, "node").where((F.col("fresh") | F.col("fresh_b")) & (F.col("a") < F.col("b"))).select("a", "b").distinct()
        pairs = _unknown(found, lists)


def _top(df: DataFrame, k: int) -> DataFrame:
    """The k nearest of each node, each neighbour once."""
    once = df.groupBy("id", "neighbor_id").agg(F.min("distance").alias("distance"), F.min("fresh").alias("fresh"))
    w = Window.partitionBy("id").orderBy("distance", "neighbor_id")
    return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("id", "neighbor_id", "distance", "fresh")


def _ranked(lists: DataFrame) -> DataFrame:
    w = Window.partitionBy("id").orderBy("distance", "neighbor_id")
    return lists.select("id", F.row_number().over(w).alias("rank"), "neighbor_id", "distance")


def _unknown(pairs: DataFrame, lists: DataFrame) -> DataFrame:
    """Pairs that no list holds, least id first."""
    ordered = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    known = lists.select(F.least("id", "neighbor_id").alias("a"), F.greatest("id", "neighbor_id").alias("b")).distinct()
    return ordered.join(known, ["a", "b"], "left_anti")


def _measured(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """+ cosine distance of unit vectors."""
    x = pairs.join(nodes.select(F.col("id").alias("a"), F.col("v").alias("va")), "a").join(nodes.select(F.col("id").alias("b"), F.col("v").alias("vb")), "b")
    dot = F.aggregate(F.zip_with("va", "vb", lambda p, q: p * q), F.lit(0.0), lambda s, t: s + t)
    return x.select("a", "b", (F.lit(1.0) - dot).alias("distance"))
