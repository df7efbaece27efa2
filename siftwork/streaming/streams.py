"""Structured Streaming versions of the study's incremental pieces.

* ``daily_counts_stream``: event-time windowed counts per type with a watermark
  (the decision-distribution / progress counters, as a stream).
* ``answer_ingest_stream``: a stream over an answer-store folder that keeps one
  answer per (paper, question) in a target table -- the resume logic of the
  answer job as exactly-once micro-batches over a keyed state store.

Both use ``trigger(availableNow=True)``: the stream drains what is there and
stops, and a later run continues from the checkpoint. Checkpoints and sinks live
under the session's shared checkpoint folder.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwork.session import ensure_checkpoint_dir, read_if_any


def _scratch(spark: SparkSession, name: str) -> str:
    return os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def daily_counts_stream(spark: SparkSession, source_glob: str, schema, out_dir: str | None = None,
                        ckpt_dir: str | None = None, window: str = "1 day", delay: str = "1 day",
                        files_per_batch: int = 1000) -> DataFrame:
    """Windowed counts per (day, event_type) from a parquet stream. Each micro-batch's
    updated windows are appended with the batch id; the result keeps the newest value
    per window. Rows that arrive more than ``delay`` behind the newest event time of
    earlier micro-batches are dropped (the watermark); with none so late, the drained
    stream equals the batch aggregate."""
    out_dir = out_dir or _scratch(spark, "daily-counts-out")
    ckpt_dir = ckpt_dir or _scratch(spark, "daily-counts-ckpt")
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source_glob)
    # event time as an instant whose UTC reading is the stored wall clock (unix_timestamp
    # reads TIMESTAMP_NTZ as UTC), so day windows do not move with the session time zone
    ev = src.select(F.timestamp_seconds(F.unix_timestamp("ts")).alias("et"), "event_type")
    agg = (ev.withWatermark("et", delay).groupBy(F.window("et", window).alias("w"), "event_type")
           .agg(F.count(F.lit(1)).alias("n")))

    def sink(batch: DataFrame, batch_id: int):
        day = F.date_from_unix_date(F.floor(F.unix_seconds(F.col("w.start")) / 86400).cast("int"))
        batch.select(day.alias("day"), "event_type", "n",
                     F.lit(batch_id).alias("batch_id")).write.mode("append").parquet(out_dir)

    q = (agg.writeStream.outputMode("update").foreachBatch(sink)
         .option("checkpointLocation", ckpt_dir).trigger(availableNow=True).start())
    _await(q)
    res = spark.read.parquet(out_dir)
    w = Window.partitionBy("day", "event_type").orderBy(F.col("batch_id").desc())
    latest = res.withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
    return latest.select("day", "event_type", F.col("n").cast("long").alias("n"))


def _await(q, timeout_s: float = 3600.0) -> None:
    """Wait for an availableNow stream; stop it and fail instead of blocking forever."""
    if not q.awaitTermination(timeout_s):
        q.stop()
        raise TimeoutError(f"stream {q.name or q.id} did not drain within {timeout_s:.0f}s")
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def answer_ingest_stream(spark: SparkSession, source_dir: str, schema, target_dir: str,
                         ckpt_dir: str, keys=("paper_id", "question_id"), fmt: str = "parquet",
                         event_time: str | None = None, delay: str = "7 days") -> int:
    """Append to ``target_dir`` every answer whose key has not been seen. The keys seen live in the
    stream's state store, so no batch reads the target; the file sink commits each batch once.
    Null key parts are equal to each other. Of several answers to one key in a micro-batch one stays.

    Without ``event_time`` every key is kept in the state for good. With it, rows that are not newer than the
    watermark (newest event time of earlier micro-batches less ``delay``) are dropped, and a key
    leaves the state once the watermark has passed its first row by ``delay``, which bounds the
    state: a key that comes back later than that is a new answer. ``fmt`` is the source format
    ('parquet' or 'json' for the JSON answer folders). Returns the number of rows in the target."""
    src = spark.readStream.schema(schema).format(fmt).load(source_dir)
    if event_time is None:
        new = src.dropDuplicates(list(keys))
    else:
        new = src.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(keys))
    q = (new.writeStream.format("parquet").option("path", target_dir).option("checkpointLocation", ckpt_dir)
         .outputMode("append").trigger(availableNow=True).start())
    _await(q)
    have = read_if_any(lambda: spark.read.schema(new.schema).parquet(target_dir))
    return 0 if have is None else have.count()
