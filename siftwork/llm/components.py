"""Connected components of an edge table by alternating large-star / small-star rounds.

Each round is two grouped minima and two joins over the edge table; nothing is
gathered per node, so a hub's edges are pre-aggregated on the map side and its join
partition can be split by adaptive execution. Rounds are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.llm.common import written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(low.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def components(edges: DataFrame, work: str, max_rounds: int = 60) -> DataFrame:
    """Edges (a, b) -> (node, component), component = smallest node reachable.

    Nodes without an edge to another node are not listed. Null ends, loops and repeated
    edges change nothing."""
    current = written(_small_star(edges.select("a", "b").dropna()), f"{work}/round-0")
    before = None
    for k in range(1, max_rounds + 1):
        # a star forest maps onto itself: two equal checksums mean that every node hangs on its minimum
        state = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == before:
            return current.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = state
        current = written(_small_star(_large_star(current)), f"{work}/round-{k}")
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
