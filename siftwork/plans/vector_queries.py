"""Registered vector queries and DuckDB twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from siftwork.functions.text import after_first_line, first_line
from siftwork.operators import llm as L
from siftwork.operators import store as ST
from siftwork.operators import vectors as V
from siftwork.operators.contain import containing, nearest_not_containing
from siftwork.operators.graph import neighbour_graph
from siftwork.plans.common import finish
from siftwork.sources import fixtures as fx
from siftwork.session import ensure_checkpoint_dir
from siftwork.sources.tables import read_table


def q_normalized_vectors(spark, sf):
    """Vectors scaled by 1 + id % 7, then L2-normalised (F-04)."""
    v = V.scaled_vectors(fx.vectors(spark, sf))
    return finish(V.normalize(v).select("id", "embedding"))


def q_vector_dims(spark, sf):
    """Items, dimension and mean norm per label, of vectors stored in and read back from a
    collection partitioned by label (A-24, S-14)."""
    path = f"{ensure_checkpoint_dir(spark)}/collection-{uuid.uuid4().hex[:12]}"
    ST.add_to_collection(fx.vectors(spark, sf).drop("target"), path)
    return finish(V.dimension_stats(ST.read_collection(spark, path, label_type="long"), ["label"]))


def q_vector_top3(spark, sf):
    """Every vector's three nearest other vectors by cosine distance (J-10, W-12, W-13,
    F-05, P-14)."""
    v = fx.vectors(spark, sf)
    return finish(V.nearest_neighbours(v, v, 3))


def q_vector_search_recall(spark, sf):
    """Approximate search by cells with exact re-rank, for every vector whose id is divisible
    by 100 against all vectors: queries, rows, and whether at least 90 % of the exact three
    nearest are found (J-10, W-12). The given vectors have no clusters, so 14 of 16 cells are
    probed; vectors of a trained encoder need far fewer."""
    v = fx.vectors(spark, sf).select("id", "embedding")
    asked = v.where("id % 100 = 0")
    near = V.approximate_neighbours(asked, v, 3, V.fit_cells(v, 16), probes=14)
    exact = V.nearest_neighbours(asked, v, 3)
    hit = exact.join(near.select("query_id", "neighbor_id", F.lit(1).alias("found")), ["query_id", "neighbor_id"], "left")
    return hit.agg(F.count_distinct("query_id").alias("n_queries"), F.count(F.lit(1)).alias("n_exact"),
                   (F.count("found") >= 0.9 * F.count(F.lit(1))).alias("recall_reached"))


def _corpus(spark, sf):
    d = read_table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    v = fx.vectors(spark, sf).select("id", "embedding", F.col("target").alias("include"))
    return v.join(d, "id", "inner").select("id", "embedding", "include", first_line("text").alias("title"),
                                           after_first_line("text").alias("abstract"))


def q_few_shot_examples(spark, sf):
    """Per vector, the two nearest included and two nearest excluded other items as a
    few-shot example block (P-12, F-08, J-10)."""
    c = _corpus(spark, sf)
    nn = V.nearest_by_label(c, c, 2, label="include", labels=(True, False))
    ex = nn.join(c.select(F.col("id").alias("neighbor_id"), "title", "abstract", F.col("include").alias("label")),
                 "neighbor_id", "inner")
    return L.example_block(ex, "query_id", "group_order", "rank")


def q_smote_counts(spark, sf):
    """SMOTE to parity on the vectors (target = label 0): class counts after
    oversampling (L-15; the counts are exact, the synthetic vectors seeded)."""
    s = V.smote(fx.vectors(spark, sf).select("id", "embedding", "target"), 3)
    return s.groupBy("target", "synthetic").agg(F.count(F.lit(1)).alias("n"))


def _spectral(spark, sf):
    """The given vectors with falling weights by coordinate: directions that matter are few, as in a trained encoder's vectors."""
    return fx.vectors(spark, sf).select("id", "target", F.transform("embedding", lambda x, i: x.cast("double") * F.pow(F.lit(0.8), i)).alias("embedding"))


def q_neighbour_graph_top3(spark, sf):
    """Every vector's three nearest others from the neighbour graph (J-10, W-12, W-13); approximate, so without a twin."""
    return finish(neighbour_graph(_spectral(spark, sf)).neighbours.where("rank <= 3"))


def q_neighbour_graph_recall(spark, sf):
    """The graph's three nearest for the vectors whose id is divisible by 100 against an exact search of all: rows, whether at
    least 90 % are found, and whether under a quarter of all distances were measured (J-10, W-12)."""
    v = _spectral(spark, sf)
    n, graph = v.count(), neighbour_graph(v)
    exact = V.nearest_neighbours(v.where("id % 100 = 0"), v, 3)
    near = graph.neighbours.where("rank <= 3").select(F.col("id").alias("query_id"), "neighbor_id", F.lit(1).alias("found"))
    hit = exact.join(near, ["query_id", "neighbor_id"], "left")
    return hit.agg(F.count_distinct("query_id").alias("n_queries"), F.count(F.lit(1)).alias("n_exact"), (F.count("found") >= 0.9 * F.count(F.lit(1))).alias("recall_reached"),
                   F.lit(graph.distances < n * (n - 1) / 8).alias("under_a_quarter"))


def q_smote_segments(spark, sf):
    """SMOTE with the minority's neighbours from the graph and recorded parents: rows per class, and how many synthetic rows lie on
    the segment between their parents, which are two different minority rows (L-15)."""
    v = _spectral(spark, sf).select("id", "embedding", "target")
    graph = neighbour_graph(v.where("target"), k=6).neighbours.select(F.col("id").alias("query_id"), "rank", "neighbor_id")
    s = V.smote(v, 3, neighbours=graph, parents=True)
    ends = v.where("target").select("id", "embedding")
    a, b = (ends.select(F.col("id").alias(x), F.col("embedding").alias(f"{x}_vec")) for x in ("parent_id", "neighbor_id"))
    made = s.join(a, "parent_id", "left").join(b, "neighbor_id", "left")
    at = F.zip_with("parent_id_vec", "neighbor_id_vec", lambda p, q: p + F.col("share") * (q - p))
    near = F.forall(F.zip_with("embedding", at, lambda x, y: F.abs(x - y)), lambda d: d < 1e-9)
    good = near & (F.col("share") >= 0) & (F.col("share") < 1) & (F.col("parent_id") != F.col("neighbor_id"))
    return made.groupBy("target", "synthetic").agg(F.count(F.lit(1)).alias("n"), F.count_if(good).alias("on_segment"))


def q_collection_upsert(spark, sf):
    """Vectors added to a keyed collection, then a third of them added again with another label, twice: one row per id, the newest
    label; counts per label, and the rows that a point lookup of every 50th id finds (S-14, S-15)."""
    path = f"{ensure_checkpoint_dir(spark)}/keyed-{uuid.uuid4().hex[:12]}"
    v = fx.vectors(spark, sf).select("id", "embedding", F.col("label").cast("bigint").alias("label"))
    ST.create_keyed(spark, path, 16)
    ST.upsert_keyed(v, path)
    again = v.where("id % 3 = 0").withColumn("label", (F.col("label") + 1) % 10)
    for _ in range(2):
        ST.upsert_keyed(again, path)
    stored = ST.read_keyed(spark, path)
    found = ST.lookup_keyed(spark, path, [r[0] for r in v.where("id % 50 = 0").select("id").collect()]).select("id", F.lit(1).cast("bigint").alias("hit"))
    return stored.join(found, "id", "left").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("n_ids"), F.count("hit").alias("n_found"))


def q_title_containment(spark, sf):
    """For every document with a title, how many documents contain that title anywhere in their text, and the least of them (P-13)."""
    d = read_table(spark, sf, "documents").select("doc_id", "text", first_line("text").alias("title"))
    found = containing(d, d, "doc_id", "title", "doc_id", "text")
    sizes = found.doc_classes.groupBy("doc_class").agg(F.count(F.lit(1)).alias("n"))
    by_class = found.pairs.join(sizes, "doc_class").groupBy("query_class").agg(F.sum("n").alias("n_containing"), F.min("doc_class").alias("first_id"))
    return found.query_classes.join(by_class, "query_class").select(F.col("query_id").alias("id"), "n_containing", "first_id")


def q_few_shot_outside(spark, sf):
    """Per vector, the three nearest others whose text does not contain the vector's own title (P-13, J-10)."""
    c = _corpus(spark, sf).select("id", "embedding", "title", F.concat_ws("\n", "title", "abstract").alias("text"))
    return finish(nearest_not_containing(c, c, 3, "text", query_col="title"))


QUERIES = {
    "title_containment": q_title_containment,
    "few_shot_outside": q_few_shot_outside,
    "neighbour_graph_top3": q_neighbour_graph_top3,
    "neighbour_graph_recall": q_neighbour_graph_recall,
    "smote_segments": q_smote_segments,
    "collection_upsert": q_collection_upsert,
    "normalized_vectors": q_normalized_vectors,
    "vector_dims": q_vector_dims,
    "vector_top3": q_vector_top3,
    "few_shot_examples": q_few_shot_examples,
    "smote_counts": q_smote_counts,
    "vector_search_recall": q_vector_search_recall,
}

_VD = "CAST(embedding AS DOUBLE[])"

SQL_NORMALIZED = f"""
WITH v AS (SELECT vec_id AS id, list_transform({_VD}, lambda x: x * (1 + vec_id % 7)) AS e FROM embeddings),
n AS (SELECT id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS nrm FROM v)
SELECT id, list_transform(e, lambda x: round(x / CASE WHEN nrm = 0 THEN 1.0 ELSE nrm END, 6)) AS embedding FROM n"""

SQL_DIMS = f"""
SELECT CAST(label AS BIGINT) AS label, CAST(COUNT(*) AS BIGINT) AS n_items, CAST(MAX(len(embedding)) AS BIGINT) AS dim,
  CAST(MIN(len(embedding)) AS BIGINT) AS min_dim,
  ROUND(AVG(sqrt(list_sum(list_transform({_VD}, lambda x: x * x)))), 6) AS mean_norm
FROM embeddings GROUP BY label"""

_PAIRS = f"""v AS (SELECT vec_id AS id, {_VD} AS e, label = 0 AS include FROM embeddings),
d AS (SELECT a.id AS query_id, b.id AS neighbor_id, b.include,
        1 - list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) AS distance
      FROM v a JOIN v b ON a.id <> b.id)"""

SQL_TOP3 = f"""WITH {_PAIRS}
SELECT query_id, CAST(rank AS BIGINT) AS rank, neighbor_id, ROUND(distance, 6) AS distance FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM d) WHERE rank <= 3"""

SQL_FEW_SHOT = f"""WITH v AS (SELECT e.vec_id AS id, CAST(e.embedding AS DOUBLE[]) AS e, e.label = 0 AS include,
               split_part(doc.text, chr(10), 1) AS title,
               CASE WHEN instr(doc.text, chr(10)) > 0 THEN substr(doc.text, instr(doc.text, chr(10)) + 1) ELSE '' END AS abstract
             FROM embeddings e JOIN documents doc ON e.vec_id = doc.doc_id),
d AS (SELECT a.id AS query_id, b.id AS neighbor_id, b.include, b.title, b.abstract,
        1 - list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) AS distance
      FROM v a JOIN v b ON a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, include ORDER BY distance, neighbor_id) AS rk FROM d),
t AS (SELECT query_id, CASE WHEN include THEN 0 ELSE 1 END AS g, rk,
        'Title: ' || title || chr(10) || 'Abstract: ' || abstract || chr(10) || 'Label: '
        || CASE WHEN include THEN 'YES' ELSE 'NO' END || chr(10) || chr(10) AS item FROM r WHERE rk <= 2)
SELECT query_id, 'EXAMPLES:' || chr(10) || chr(10) || string_agg(item, '' ORDER BY g, rk) AS examples
FROM t GROUP BY query_id"""

SQL_SMOTE_COUNTS = """
WITH c AS (SELECT label = 0 AS target, COUNT(*) AS n FROM embeddings GROUP BY 1),
mx AS (SELECT MAX(n) AS m FROM c)
SELECT target, FALSE AS synthetic, CAST(n AS BIGINT) AS n FROM c
UNION ALL
SELECT c.target, TRUE, CAST(mx.m - c.n AS BIGINT) FROM c, mx WHERE c.n < mx.m"""

SQL_CONTAINMENT = """
WITH d AS (SELECT doc_id AS id, text, split_part(text, chr(10), 1) AS title FROM documents)
SELECT a.id, CAST(COUNT(*) AS BIGINT) AS n_containing, MIN(b.id) AS first_id
FROM d a JOIN d b ON contains(b.text, a.title) WHERE a.title <> '' GROUP BY a.id"""

SQL_FEW_SHOT_OUTSIDE = f"""WITH v AS (SELECT e.vec_id AS id, {_VD} AS e, split_part(doc.text, chr(10), 1) AS title,
    split_part(doc.text, chr(10), 1) || chr(10) || CASE WHEN instr(doc.text, chr(10)) > 0 THEN substr(doc.text, instr(doc.text, chr(10)) + 1) ELSE '' END AS text
  FROM embeddings e JOIN documents doc ON e.vec_id = doc.doc_id),
d AS (SELECT a.id AS query_id, b.id AS neighbor_id,
        1 - list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) AS distance
      FROM v a JOIN v b ON a.id <> b.id AND (a.title = '' OR NOT contains(b.text, a.title)))
SELECT query_id, CAST(rank AS BIGINT) AS rank, neighbor_id, ROUND(distance, 6) AS distance FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM d) WHERE rank <= 3"""

ORACLE = {
    "title_containment": SQL_CONTAINMENT,
    "few_shot_outside": SQL_FEW_SHOT_OUTSIDE,
    "neighbour_graph_recall": """WITH q AS (SELECT COUNT(*) AS n FROM embeddings WHERE vec_id % 100 = 0), a AS (SELECT COUNT(*) AS n FROM embeddings)
SELECT q.n AS n_queries, q.n * LEAST(3, a.n - 1) AS n_exact, TRUE AS recall_reached, TRUE AS under_a_quarter FROM q, a""",
    "smote_segments": f"SELECT *, CASE WHEN synthetic THEN n ELSE 0 END AS on_segment FROM ({SQL_SMOTE_COUNTS})",
    "collection_upsert": """SELECT CAST(CASE WHEN vec_id % 3 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, COUNT(*) AS n,
  COUNT(DISTINCT vec_id) AS n_ids, COUNT(*) FILTER (WHERE vec_id % 50 = 0) AS n_found FROM embeddings GROUP BY 1""",
    "normalized_vectors": SQL_NORMALIZED,
    "vector_dims": SQL_DIMS,
    "vector_top3": SQL_TOP3,
    "few_shot_examples": SQL_FEW_SHOT,
    "smote_counts": SQL_SMOTE_COUNTS,
    "vector_search_recall": """WITH q AS (SELECT COUNT(*) AS n FROM embeddings WHERE vec_id % 100 = 0), a AS (SELECT COUNT(*) AS n FROM embeddings)
SELECT q.n AS n_queries, q.n * LEAST(3, a.n - 1) AS n_exact, TRUE AS recall_reached FROM q, a""",
}
