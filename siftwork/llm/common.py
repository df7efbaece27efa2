"""Shared folders, written tables and reads used by the operators of this subpackage."""

from __future__ import annotations

import hashlib
import sys
import uuid
from collections.abc import Callable
from types import ModuleType

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.session import ensure_checkpoint_dir

# The white space of every contract, [\x20\x09-\x0D].
WHITESPACE = " \t\n\x0b\x0c\r"
WHITESPACE_RE = r"[\x20\x09-\x0D]"
WORD_RE = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in a shared folder and read it back: a lineage cut that
    outlives lost executors. The schema is passed on, so an empty result reads back too."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def utf8(column: str | Column) -> Column:
    """The text's UTF-8 bytes, null as empty."""
    col = F.col(column) if isinstance(column, str) else column
    return F.coalesce(col, F.lit("")).cast("binary")


def per_worker(shared, kind: str, make: Callable):
    """``make(broadcast value)``, made once per Python worker and kept while it is one of the last two made there, whatever
    query asks for it: the same file is one model, and memory doesn't grow with the number of queries."""
    kept = sys.modules.setdefault("siftwork_worker_models", ModuleType("siftwork_worker_models")).__dict__.setdefault("models", {})
    value = shared.value
    files = value if isinstance(value, tuple) else (value,)
    key = (kind, *(hashlib.sha256(f).digest() for f in files))
    model = kept.pop(key, None)
    while len(kept) > 1:
        kept.pop(next(iter(kept)))
    if model is None:
        model = make(value)
    kept[key] = model  # the last made or used stands last
    return model
