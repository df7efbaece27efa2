"""Registered split / sampling queries and DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwork.operators import split as SP
from siftwork.plans import sqlsnips as S
from siftwork.plans.common import finish
from siftwork.sources import fixtures as fx


def q_stratified_folds(spark, sf):
    """Seeded stratified 5-fold assignment of papers (W-08)."""
    f = SP.stratified_folds(fx.papers(spark, sf), 5)
    return finish(f.select("id", "label", "fold"))


def q_fold_balance(spark, sf):
    """Rows per (fold, label): class counts differ by at most one between folds (W-08)."""
    f = SP.stratified_folds(fx.papers(spark, sf), 5)
    return finish(f.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n")))


def q_holdout_split(spark, sf):
    """Stratified 60/20/20 train/val/test split (W-09)."""
    h = SP.holdout_split(fx.papers(spark, sf), test=0.2, val=0.2)
    return h.select("id", "label", "split")


def q_class_weights(spark, sf):
    """Balanced class weights n / (2 n_c) per paper (F-09)."""
    from siftwork.operators.ml import with_balanced_weights
    return finish(with_balanced_weights(fx.papers(spark, sf).select("id", "label")).select("id", "label", "weight"))


def q_folds_with_vectors(spark, sf):
    """Stratified folds and a 60/20/20 split of rows that carry their vector (W-08, W-09)."""
    v = fx.vectors(spark, sf).select("id", "embedding", F.col("target").alias("label"))
    f = SP.holdout_split(SP.stratified_folds(v, 5), test=0.2, val=0.2)
    return finish(f.select("id", "fold", "split", F.size("embedding").alias("dim")))


def q_balanced_sample(spark, sf):
    """50 papers with a 10 % include quota, topped up in hash order (W-10, J-08, U-01)."""
    s = SP.balanced_sample(fx.papers(spark, sf), 50, 0.1)
    return s.select("id", "label", "sample_order")


def q_shuffled_positions(spark, sf):
    """Position of every paper in the seeded full shuffle (O-04)."""
    return SP.hash_rank(fx.papers(spark, sf)).select("id", "position")


def q_random_per_label(spark, sf):
    """Three seeded random vectors per label (W-11)."""
    v = fx.vectors(spark, sf)
    return SP.random_per_label(v, 3, "label").select("id", "label")


QUERIES = {
    "stratified_folds": q_stratified_folds,
    "fold_balance": q_fold_balance,
    "holdout_split": q_holdout_split,
    "class_weights": q_class_weights,
    "folds_with_vectors": q_folds_with_vectors,
    "balanced_sample": q_balanced_sample,
    "random_per_label": q_random_per_label,
    "shuffled_positions": q_shuffled_positions,
}

_FOLDS = f"""{S.PAPERS},
folds AS (SELECT id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY {S.HASH42}, id) - 1) % 5 AS BIGINT) AS fold
          FROM papers)"""

SQL_FOLDS = f"WITH {_FOLDS}\nSELECT id, label, fold FROM folds"
SQL_FOLD_BALANCE = f"WITH {_FOLDS}\nSELECT fold, label, CAST(COUNT(*) AS BIGINT) AS n FROM folds GROUP BY fold, label"

SQL_HOLDOUT = f"""WITH {S.PAPERS},
r AS (SELECT id, label, row_number() OVER (PARTITION BY label ORDER BY {S.HASH42}, id) - 1 AS rk,
             CAST(COUNT(*) OVER (PARTITION BY label) AS DOUBLE) AS n FROM papers)
SELECT id, label, CASE WHEN rk < ROUND(n * 0.2::DOUBLE, 0) THEN 'test'
                       WHEN rk < ROUND(n * 0.2::DOUBLE, 0) + ROUND(n * 0.2::DOUBLE, 0) THEN 'val'
                       ELSE 'train' END AS split FROM r"""

SQL_FOLDS_WITH_VECTORS = f"""
WITH r AS (SELECT id, len(embedding) AS dim, row_number() OVER (PARTITION BY label ORDER BY {S.HASH42}, id) - 1 AS rk,
             CAST(COUNT(*) OVER (PARTITION BY label) AS DOUBLE) AS n
           FROM (SELECT vec_id AS id, embedding, label = 0 AS label FROM embeddings))
SELECT id, CAST(rk % 5 AS BIGINT) AS fold, CASE WHEN rk < ROUND(n * 0.2::DOUBLE, 0) THEN 'test'
  WHEN rk < ROUND(n * 0.2::DOUBLE, 0) + ROUND(n * 0.2::DOUBLE, 0) THEN 'val' ELSE 'train' END AS split, CAST(dim AS BIGINT) AS dim FROM r"""

SQL_CLASS_WEIGHTS = f"""WITH {S.PAPERS},
c AS (SELECT label, COUNT(*) AS n_c FROM papers GROUP BY label),
w AS (SELECT label, (SELECT SUM(n_c) FROM c) / (2.0 * n_c) AS weight FROM c)
SELECT p.id, p.label, ROUND(w.weight, 6) AS weight FROM papers p JOIN w ON p.label = w.label"""

SQL_BALANCED_SAMPLE = f"""WITH {S.PAPERS},
pos_pick AS (SELECT *, {S.HASH42} AS h FROM papers WHERE label ORDER BY h, id LIMIT 5),
pool_top AS (SELECT *, {S.HASH42} AS h FROM papers WHERE id NOT IN (SELECT id FROM pos_pick) ORDER BY h, id LIMIT 50),
neg1 AS (SELECT *, md5(concat(CAST(id AS VARCHAR), ':43')) AS h FROM papers WHERE NOT label ORDER BY h, id LIMIT 1),
cand AS (SELECT id, label, h, 0 AS src FROM pos_pick UNION ALL SELECT id, label, h, 1 FROM pool_top
         UNION ALL SELECT id, label, h, 2 FROM neg1),
c1 AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY h, id) AS r,
              SUM(CASE WHEN src = 0 THEN 1 ELSE 0 END) OVER () AS n0, {S.HASH42} AS ord FROM cand),
c2 AS (SELECT *, (src = 0 OR (src = 1 AND r <= 50 - n0)) AS inn FROM c1),
c3 AS (SELECT *, MIN(CASE WHEN inn THEN CAST(label AS INTEGER) END) OVER () AS allpos,
              MAX(CASE WHEN src = 2 THEN 1 ELSE 0 END) OVER () AS hasneg,
              MAX(CASE WHEN inn THEN ord END) OVER () AS last FROM c2),
c4 AS (SELECT *, (allpos = 1 AND hasneg = 1) AS swap FROM c3),
o AS (SELECT id, label, CASE WHEN src = 2 THEN last ELSE ord END AS ord2 FROM c4
      WHERE (inn AND NOT (swap AND ord = last)) OR (src = 2 AND swap))
SELECT id, label, CAST(row_number() OVER (ORDER BY ord2, id) - 1 AS INTEGER) AS sample_order FROM o"""

SQL_RANDOM_PER_LABEL = """
SELECT id, label FROM (
  SELECT vec_id AS id, label,
         row_number() OVER (PARTITION BY label ORDER BY md5(concat(CAST(vec_id AS VARCHAR), ':42')), vec_id) AS rn
  FROM embeddings) WHERE rn <= 3"""

ORACLE = {
    "shuffled_positions": f"WITH {S.PAPERS} SELECT id, row_number() OVER (ORDER BY {S.HASH42}, id) - 1 AS position FROM papers",
    "folds_with_vectors": SQL_FOLDS_WITH_VECTORS,
    "stratified_folds": SQL_FOLDS,
    "fold_balance": SQL_FOLD_BALANCE,
    "holdout_split": SQL_HOLDOUT,
    "class_weights": SQL_CLASS_WEIGHTS,
    "balanced_sample": SQL_BALANCED_SAMPLE,
    "random_per_label": SQL_RANDOM_PER_LABEL,
}
