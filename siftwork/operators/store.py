"""Evaluation-result store and fingerprints (S-09, A-22) and the vector collection
table (S-14).

Results are rows of a Parquet table partitioned by (embedding_model, classifier)
and by their keys, an order-free data hash and a configuration hash. A lookup is an
equality filter (partition pruning); saving replaces only the written
partitions (dynamic partition overwrite).
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.session import read_if_any

PARTITIONS = ("embedding_model", "classifier")
KEYS = ("data_hash", "config_hash")


def data_hash(df: DataFrame, cols) -> DataFrame:
    """Order-free content hash of the given columns: row count plus the sum (as decimal)
    of per-row 64-bit xxhash values. One partial-aggregated pass."""
    h = F.xxhash64(*[F.col(c) for c in cols])
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.sum(h.cast("decimal(38,0)")).cast("string").alias("hash_sum"))


def data_hash_value(df: DataFrame, cols) -> str:
    r = data_hash(df, cols).collect()[0]  # one row
    return hashlib.sha256(f"{r.n_rows}:{r.hash_sum}".encode()).hexdigest()[:16]


def config_hash(name: str, params: dict, **cv) -> str:
    """Class name + sorted parameters + CV settings (+ target recall) -> short SHA-256."""
    payload = json.dumps({"name": name, "params": {k: str(v) for k, v in sorted(params.items())},
                          "cv": {k: str(v) for k, v in sorted(cv.items())}}, sort_keys=True)
    return hashlib.sha256(payload.encode()).hexdigest()[:16]


def save_results(folds: DataFrame, path: str, data_key: str, config_key: str) -> None:
    """Store the fold rows of one evaluation, replacing an earlier save of the same keys.

    The table is partitioned down to the two key hashes, so a save overwrites only its own
    rows: other evaluations are neither read nor rewritten, whatever columns they have."""
    out = folds.withColumn("data_hash", F.lit(data_key)).withColumn("config_hash", F.lit(config_key))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
        .partitionBy(*PARTITIONS, *KEYS).parquet(path)


def load_results(spark: SparkSession, path: str, data_key: str, config_key: str,
                 embedding_model: str | None = None, classifier: str | None = None) -> DataFrame | None:
    """Stored fold rows when every key matches, else None. Only the folders of these keys are
    read, so evaluations stored with other columns or types do not matter."""
    folders = f"{path}/*/*/data_hash={data_key}/config_hash={config_key}"
    df = read_if_any(lambda: spark.read.option("basePath", path).parquet(folders))
    if df is None:
        return None
    df = df.withColumns({c: F.col(c).cast("string") for c in PARTITIONS} | {KEYS[0]: F.lit(data_key), KEYS[1]: F.lit(config_key)})
    cond = F.lit(True)
    if embedding_model is not None:
        cond = cond & (F.col("embedding_model") == embedding_model)
    if classifier is not None:
        cond = cond & (F.col("classifier") == classifier)
    hit = df.where(cond)
    return hit if not hit.isEmpty() else None


def list_results(spark: SparkSession, path: str) -> DataFrame:
    """One metadata row per stored evaluation."""
    df = read_if_any(lambda: spark.read.parquet(path))
    if df is None:
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in (*PARTITIONS, *KEYS)) + ", n_folds bigint")
    named = df.select(*(F.col(c).cast("string").alias(c) for c in (*PARTITIONS, *KEYS)))
    return named.groupBy(*PARTITIONS, *KEYS).agg(F.count(F.lit(1)).alias("n_folds"))


def clear_results(spark: SparkSession, path: str) -> None:
    """Empty the store (overwrite with an empty table of the same schema)."""
    schema = spark.read.parquet(path).schema
    spark.createDataFrame([], schema).write.mode("overwrite").option("partitionOverwriteMode", "static") \
        .partitionBy(*PARTITIONS, *KEYS).parquet(path)


# ---------------------------------------------------------------- vector collection

def add_to_collection(vectors: DataFrame, path: str, label: str = "label", mode: str = "append") -> None:
    """Store vectors partitioned by label (label filters prune partitions)."""
    vectors.write.mode(mode).partitionBy(label).parquet(path)


def read_collection(spark: SparkSession, path: str, label: str = "label", label_type: str = "boolean",
                    value=None) -> DataFrame:
    """Read the collection; ``value`` keeps only that label's partition (pruned at
    listing time). Partition discovery yields strings for booleans, so the label is
    cast back to ``label_type``."""
    df = spark.read.parquet(path)
    df = df.withColumn(label, F.col(label).cast(label_type))
    return df if value is None else df.where(F.col(label) == F.lit(value))


def collection_info(spark: SparkSession, path: str, label: str = "label", label_type: str = "boolean") -> DataFrame:
    return read_collection(spark, path, label, label_type).groupBy(label).agg(F.count(F.lit(1)).alias("n_items"))


# ---------------------------------------------------------------- keyed collection

def _bucket(key, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def create_keyed(spark: SparkSession, path: str, buckets: int = 256) -> None:
    """An empty keyed collection; the number of buckets is fixed for its life."""
    spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.mode("error").parquet(f"{path}/_layout")


def _buckets(spark: SparkSession, path: str) -> int:
    return spark.read.schema("buckets int").parquet(f"{path}/_layout").first()[0]


def upsert_keyed(rows: DataFrame, path: str, id_col: str = "id") -> None:
    """Add rows by id: a new id is added, a stored one is replaced, and of several new rows with one id the least (by its
    columns' hash) stays. The collection lies in folders by a hash of the id, sorted by id in each; only the folders that hold a new id are read and
    overwritten, each at the commit of one job. Rows without an id are refused."""
    spark = rows.sparkSession
    n = _buckets(spark, path)
    key = F.when(F.col(id_col).isNull(), F.raise_error(F.lit("a row without an id"))).otherwise(F.col(id_col))
    whole = F.struct(*[F.col(c) for c in rows.columns])
    new = rows.withColumn(id_col, key.cast(rows.schema[id_col].dataType)).groupBy(id_col).agg(F.min_by(whole, F.xxhash64(*rows.columns)).alias("_row"))
    new = new.select("_row.*").withColumn("bucket", _bucket(id_col, n))
    have = read_keyed(spark, path, keep_bucket=True)
    if have is not None:
        touched = new.select("bucket").distinct()
        kept = have.join(touched, "bucket", "left_semi").join(new.select(id_col), id_col, "left_anti")
        new = new.unionByName(kept, allowMissingColumns=True)
    new.repartition("bucket").sortWithinPartitions("bucket", id_col) \
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{path}/rows")


def read_keyed(spark: SparkSession, path: str, keep_bucket: bool = False) -> DataFrame | None:
    """The whole collection; None while nothing was added."""
    df = read_if_any(lambda: spark.read.parquet(f"{path}/rows"))
    return df if df is None or keep_bucket else df.drop("bucket")


def lookup_keyed(spark: SparkSession, path: str, ids: list, id_col: str = "id") -> DataFrame | None:
    """The rows of some ids: only their hash folders are listed and read, and the id goes down to the scan."""
    df = read_keyed(spark, path, keep_bucket=True)
    if df is None:
        return None
    kind = df.schema[id_col].dataType
    wanted = [F.lit(i).cast(kind) for i in ids]
    n = _buckets(spark, path)
    at = spark.range(1).select(F.array(*(_bucket(w, n) for w in wanted))).first()[0] if ids else []
    return df.where(F.col("bucket").isin(at) & F.col(id_col).isin(wanted)).drop("bucket")


def clear_keyed(spark: SparkSession, path: str) -> None:
    """Empty the collection; its layout stays."""
    df = read_keyed(spark, path, keep_bucket=True)
    if df is not None:
        spark.createDataFrame([], df.schema).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(f"{path}/rows")
