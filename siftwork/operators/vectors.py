"""Vector operators: normalisation, exact cosine top-k retrieval, label-filtered
few-shot retrieval, seeded random picks, SMOTE oversampling.

Exact top-k (``nearest_neighbours``) is a tiled block join: both sides are cut
into tiles of at most ``tile_rows`` vectors; each (query tile, corpus tile) pair
meets in one ``cogroup`` task, where numpy computes the distance block and keeps
only the k best per query. No pair row is ever materialised: a task emits at most
k rows per query, and the final per-query top-k runs over (corpus tiles x k)
candidates with a group-limited window. Work is the inherent Q x C distance
products, spread over nq x nc tasks of bounded size.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwork.functions.vector import l2_norm, l2_normalize, scale

def normalize(df: DataFrame, vec: str = "embedding", out: str | None = None) -> DataFrame:
    """L2 normalisation in double precision; a zero vector is left unchanged."""
    return df.withColumn(out or vec, l2_normalize(vec))


def dimension_stats(df: DataFrame, group_cols=("label",), vec: str = "embedding") -> DataFrame:
    return df.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("n_items"),
                                      F.max(F.size(vec)).alias("dim"), F.min(F.size(vec)).alias("min_dim"),
                                      F.avg(l2_norm(vec)).alias("mean_norm"))


def _tiles(n: int, tile_rows: int) -> int:
    return max(1, int(math.ceil(n / float(tile_rows))))


def _block_topk(k: int, exclude_self: bool, chunk_rows: int = 512):
    """Per (query tile, corpus tile): exact top-k by (distance, neighbour id). Distances
    are computed in chunks of ``chunk_rows`` queries, fewer for large tiles, so memory is chunk x tile. The
    distance to or from a zero vector is undefined: NULL, ranked after all others."""
    def fn(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if len(q) == 0 or len(c) == 0:
            return pd.DataFrame({"query_id": q["qid"][:0], "neighbor_id": c["cid"][:0],
                                 "distance": pd.Series([], dtype="float64")})
        qv = np.vstack(q["qv"].map(lambda a: np.asarray(a, dtype=np.float64)).to_numpy())
        cv = np.vstack(c["cv"].map(lambda a: np.asarray(a, dtype=np.float64)).to_numpy())
        qid, cid = (np.array(x.tolist()) for x in (q["qid"], c["cid"]))  # numbers or text
        qn = np.sqrt((qv * qv).sum(axis=1))
        cn = np.sqrt((cv * cv).sum(axis=1))
        outs = []
        rows = min(chunk_rows, _chunk_rows(len(cid), 1 << 22))
        for s0 in range(0, len(qid), rows):
            ids = qid[s0:s0 + rows]
            with np.errstate(divide="ignore", invalid="ignore"):
                dist = 1.0 - (qv[s0:s0 + rows] @ cv.T) / np.outer(qn[s0:s0 + rows], cn)
            dist[~np.isfinite(dist)] = np.inf
            allowed = ids[:, None] != cid[None, :] if exclude_self else np.ones(dist.shape, dtype=bool)
            if k + 1 < dist.shape[1]:  # k allowed ones are among the k + 1 smallest and their ties
                cut = np.partition(dist, k, axis=1)[:, k]
                r, j = np.nonzero((dist <= cut[:, None]) & allowed)
            else:
                r, j = np.nonzero(allowed)
            d = dist[r, j]
            order = np.lexsort((cid[j], d, r))            # by row, then distance, then id
            r, j, d = r[order], j[order], d[order]
            starts = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else np.empty(0, dtype=int)
            rank = np.arange(len(r)) - np.repeat(starts, np.diff(np.r_[starts, len(r)]))
            sel = rank < k
            outs.append(pd.DataFrame({"query_id": ids[r[sel]], "neighbor_id": cid[j[sel]],
                                      "distance": np.where(np.isinf(d[sel]), np.nan, d[sel])}))
        return pd.concat(outs, ignore_index=True)
    return fn


def nearest_neighbours(queries: DataFrame, corpus: DataFrame, k: int, q_id: str = "id",
                       c_id: str = "id", q_vec: str = "embedding", c_vec: str = "embedding",
                       exclude_self: bool = True, tile_rows: int = 8192) -> DataFrame:
    """Exact cosine-distance top-k: (query_id, rank, neighbor_id, distance), ties by
    neighbour id; every query has min(k, other corpus rows) rows. ``exclude_self`` drops
    corpus rows with the query's own id. Ids may be numbers or text. All pairs are
    computed, so one side must be small (a stated query set, one label's rows);
    ``approximate_neighbours`` is the form for two large sides."""
    sizes = queries.count(), corpus.count()
    # every vector goes to all tiles of the other side: larger tiles for larger tables, up to 8 times ``tile_rows``, so that
    # less is shuffled while there are still some 64 pairs of tiles to share out
    nq, nc = (_tiles(n, min(max(tile_rows, n // 8), 8 * tile_rows)) for n in sizes)

    def tile(col: str, n: int):  # one type on both sides, or equal tiles would hash apart
        return F.pmod(F.xxhash64(col), F.lit(n)).cast("int")

    def every(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    q = queries.select(F.col(q_id).alias("qid"), F.col(q_vec).alias("qv"), tile(q_id, nq).alias("qt"), every(nc).alias("ct"))
    c = corpus.select(F.col(c_id).alias("cid"), F.col(c_vec).alias("cv"), tile(c_id, nc).alias("ct"), every(nq).alias("qt"))
    kinds = [x.schema[n].dataType.simpleString() for x, n in ((q, "qid"), (c, "cid"))]
    cand = q.groupBy("qt", "ct").cogroup(c.groupBy("qt", "ct")).applyInPandas(
        _block_topk(k, exclude_self), f"query_id {kinds[0]}, neighbor_id {kinds[1]}, distance double")
    return _best(cand, k)


def _best(cand: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("distance").asc_nulls_last(), "neighbor_id")
    return cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k) \
        .select("query_id", "rank", "neighbor_id", "distance")


def _chunk_rows(columns: int, values: int = 1 << 21) -> int:
    """Rows of a block of at most ``values`` products (16 MB) with so many columns, one at least."""
    return max(1, values // max(1, columns))


def _unit(rows) -> np.ndarray:
    v = np.vstack([np.asarray(r, dtype=np.float64) for r in rows])
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(n == 0, 1.0, n)


def fit_cells(corpus: DataFrame, cells: int, vec: str = "embedding", id_col: str = "id", sample_rows: int = 20_000,
              rounds: int = 10, seed: int = 42) -> np.ndarray:
    """Cell centres (spherical k-means) of a bounded sample: the ``sample_rows`` vectors of the
    least seeded id hash. The sample is all that reaches the driver."""
    picked = corpus.orderBy(F.xxhash64(F.lit(seed), id_col), id_col).select(vec).limit(sample_rows).collect()
    if not picked:
        raise ValueError("no vectors to fit cells on")
    x = _unit([r[0] for r in picked])
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    chunk = _chunk_rows(len(centres))
    for _ in range(rounds):
        near = np.concatenate([(x[a:a + chunk] @ centres.T).argmax(axis=1) for a in range(0, len(x), chunk)])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.where(size == 0, 1.0, size), centres)
    return centres


def _to_cells(df: DataFrame, id_col: str, vec: str, centres: np.ndarray, n: int) -> DataFrame:
    """(id, vec, cell): each row with its ``n`` nearest cells."""
    shared = df.sparkSession.sparkContext.broadcast(centres)  # cells x dimension, both parameters
    n = min(n, len(centres))
    chunk = _chunk_rows(len(centres))

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), chunk):  # a worker holds chunk x cells products, whatever the batch
                part = pdf.iloc[at:at + chunk]
                close = _unit(part["vec"]) @ shared.value.T
                near = close.argmax(axis=1)[:, None] if n == 1 else np.argsort(-close, axis=1, kind="stable")[:, :n]
                yield pd.DataFrame({"id": np.repeat(part["id"].to_numpy(), n), "vec": part["vec"].repeat(n), "cell": near.ravel()})

    x = df.select(F.col(id_col).alias("id"), F.col(vec).alias("vec"))
    kinds = {f.name: f.dataType.simpleString() for f in x.schema.fields}
    return x.mapInPandas(run, f"id {kinds['id']}, vec {kinds['vec']}, cell int")


def approximate_neighbours(queries: DataFrame, corpus: DataFrame, k: int, centres: np.ndarray, q_id: str = "id", c_id: str = "id",
                           q_vec: str = "embedding", c_vec: str = "embedding", exclude_self: bool = True,
                           probes: int = 4, tile_rows: int = 4096) -> DataFrame:
    """Cosine top-k from candidate cells with exact re-rank: (query_id, rank, neighbor_id,
    distance).

    Every corpus vector is filed in the cell of its nearest centre (``fit_cells``); a query looks
    into its ``probes`` nearest cells. A cell meets its queries in co-group tasks; cells above
    ``tile_rows`` vectors are cut into pieces by an id hash, and their queries go to every
    piece, so a hot cell is many tasks of bounded size. Distances inside a cell are exact;
    only neighbours in cells that are not probed are missed."""
    filed = _to_cells(corpus, c_id, c_vec, centres, 1)
    sizes = filed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(tile_rows)).cast("int").alias("pieces"))
    asked = _to_cells(queries, q_id, q_vec, centres, probes).join(sizes, "cell") \
        .select(F.col("id").alias("qid"), F.col("vec").alias("qv"), "cell", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
    cut = sizes.select("cell", F.col("pieces").alias("cut"))
    held = filed.join(cut, "cell").select(F.col("id").alias("cid"), F.col("vec").alias("cv"), "cell",
                                          F.pmod(F.xxhash64("id"), F.col("cut")).cast("int").alias("piece"))
    kinds = [x.schema[n].dataType.simpleString() for x, n in ((asked, "qid"), (held, "cid"))]
    cand = asked.groupBy("cell", "piece").cogroup(held.groupBy("cell", "piece")).applyInPandas(
        _block_topk(k, exclude_self), f"query_id {kinds[0]}, neighbor_id {kinds[1]}, distance double")
    return _best(cand, k)


def nearest_by_label(queries: DataFrame, corpus: DataFrame, k: int, label: str = "label",
                     labels=(True, False), **kw) -> DataFrame:
    """Top-k per label value of the corpus (label filter pushed before the search);
    adds ``group_order`` = position of the label in ``labels``."""
    parts = []
    for i, lv in enumerate(labels):
        nn = nearest_neighbours(queries, corpus.where(F.col(label) == F.lit(lv)), k, **kw)
        parts.append(nn.withColumn("group_order", F.lit(i)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def exclude_containing(df: DataFrame, text_col: str, query) -> DataFrame:
    """Drop every document containing the query text (not only the query itself): a literal,
    or a column for retrieval results that carry both texts. NULL texts contain nothing."""
    q = query if isinstance(query, Column) else F.lit(query)
    return df.where(~F.coalesce(F.col(text_col).contains(q), F.lit(False)))


def lookup(df: DataFrame, id_value, id_col: str = "id") -> DataFrame:
    """Point lookup (pushed down to the scan); raises when the id is absent."""
    hit = df.where(F.col(id_col) == F.lit(id_value)).limit(2).collect()
    if not hit:
        raise KeyError(f"id {id_value!r} not found")
    return df.where(F.col(id_col) == F.lit(id_value))


def smote(df: DataFrame, k: int = 3, target: str = "target", id_col: str = "id", vec: str = "embedding",
          seed: int = 42, tile_rows: int = 8192, neighbours: DataFrame | None = None, parents: bool = False) -> DataFrame:
    """SMOTE to parity: each synthetic row = x + u (x_nb - x) with x a minority row, x_nb
    one of its k nearest minority neighbours and u in [0, 1), both chosen by hashes of
    (id, j, seed). Synthetic row j (0-based) grows from the minority row of hash rank
    j % n_min, so rows share the quota evenly. Adds ``synthetic``.

    The minority's neighbours (query_id, rank 1.., neighbor_id) can be given, e.g. from ``graph.neighbour_graph``; else they
    are searched exactly, which is all pairs of the minority. ``parents`` adds parent_id, neighbor_id and share (null for
    given rows): a synthetic row lies at ``share`` of the way from its parent to the neighbour."""
    from siftwork.operators.split import class_rank
    counts = {r[0]: r[1] for r in df.groupBy(target).count().collect()}  # two scalars
    if len(counts) < 2:
        return df.withColumn("synthetic", F.lit(False))
    minority = min(counts, key=lambda v: (counts[v], str(v)))
    n_min = counts[minority]
    n_synth = max(counts.values()) - n_min  # synthetic ids are -1 .. -n_synth
    kind = df.schema[id_col].dataType
    origin = ["parent_id", "neighbor_id", "share"] if parents else []
    base = df.withColumn("synthetic", F.lit(False))
    if parents:
        base = base.withColumns({"parent_id": F.lit(None).cast(kind), "neighbor_id": F.lit(None).cast(kind), "share": F.lit(None).cast("double")})
    if n_synth == 0:
        return base
    mino = df.where(F.col(target) == F.lit(minority))
    nn = nearest_neighbours(mino, mino, k, id_col, id_col, vec, vec, True, tile_rows) if neighbours is None else neighbours.select("query_id", "rank", "neighbor_id").where(F.col("rank") <= k)
    ranked = class_rank(mino.select(id_col, vec, target), target, id_col, seed, out="_r") \
        .select(id_col, vec, target, "_r")
    # synthetic row j comes from minority row j % n_min: the indices are a distributed
    # range, so a tiny minority facing a huge majority never expands inside one task
    gen = spark_range(df, n_synth).select(F.col("id").alias("_j"), (F.col("id") % n_min).alias("_r"))
    gen = gen.join(ranked, "_r", "inner")  # every rank 0 .. n_min - 1 exists once
    h = F.xxhash64(F.col(id_col), F.col("_j"), F.lit(seed))
    n_nb = nn.groupBy("query_id").agg(F.max("rank").alias("_nk"))
    gen = gen.join(n_nb, gen[id_col] == n_nb["query_id"], "left").drop("query_id")
    gen = gen.withColumn("_pick", F.pmod(h, F.col("_nk")) + 1) \
             .withColumn("_u", F.pmod(F.xxhash64(F.col(id_col), F.col("_j"), F.lit(seed + 1)), F.lit(1 << 30))
                         / F.lit(float(1 << 30)))
    nbv = mino.select(F.col(id_col).alias("_nid"), F.col(vec).alias("_other"))
    # a parent without neighbours (the only minority row) is repeated as it is
    g2 = gen.join(nn, (gen[id_col] == nn["query_id"]) & (gen["_pick"] == nn["rank"]), "left") \
            .join(nbv, F.col("neighbor_id") == F.col("_nid"), "left") \
            .withColumn("_nv", F.coalesce("_other", F.col(vec)))
    newv = F.zip_with(F.col(vec), F.col("_nv"), lambda a, b: a.cast("double") + F.col("_u") * (b - a))
    synth = g2.select((-F.col("_j") - 1).alias(id_col), newv.alias(vec), F.col(target), F.lit(True).alias("synthetic"),
                      *([F.col(id_col).alias("parent_id"), F.coalesce("neighbor_id", F.col(id_col)).alias("neighbor_id"), F.col("_u").alias("share")] if parents else []))
    keep = [c for c in base.columns if c in (id_col, vec, target, "synthetic", *origin)]
    return base.select(*keep).withColumn(vec, F.transform(vec, lambda x: x.cast("double"))) \
        .unionByName(synth.select(*keep))


def spark_range(df: DataFrame, n: int) -> DataFrame:
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return spark.range(0, n, 1, max(1, min(parts, n)))


def scaled_vectors(df: DataFrame, vec: str = "embedding", factor_col: str = "id") -> DataFrame:
    """Vectors multiplied by 1 + id % 7 (to give unit-length inputs real norms)."""
    return df.withColumn(vec, scale(vec, F.lit(1) + F.col(factor_col) % 7))
