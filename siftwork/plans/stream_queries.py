"""Registered streaming query (drained with availableNow) and its batch SQL twin."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from siftwork.operators import llm as L
from siftwork.plans.llm_queries import SQL_RULE_ANSWERS, q_rule_answers
from siftwork.session import ensure_checkpoint_dir
from siftwork.sources import fixtures as fx
from siftwork.sources.dimensions import question_ids
from siftwork.sources.tables import read_table
from siftwork.streaming.streams import answer_ingest_stream, daily_counts_stream


def q_stream_daily_counts(spark, sf):
    """Event-time daily counts per event type from a watermarked stream (T-02)."""
    schema = read_table(spark, sf, "events").schema
    return daily_counts_stream(spark, os.path.join(sf, "events*.parquet"), schema)


def q_stream_answer_ingest(spark, sf):
    """Rule answers arriving in two overlapping deliveries, kept once per (paper, question)
    by the ingest stream (T-01, X-03)."""
    work = f"{ensure_checkpoint_dir(spark)}/ingest-{uuid.uuid4().hex[:12]}"
    rows = q_rule_answers(spark, sf).select("paper_id", "question_id", "response")
    schema = rows.schema
    for part in ("paper_id % 3 < 2", "paper_id % 3 > 0"):
        rows.where(part).write.mode("append").parquet(f"{work}/source")
        answer_ingest_stream(spark, f"{work}/source", schema, f"{work}/target", f"{work}/checkpoint")
    return spark.read.schema(schema).parquet(f"{work}/target")


def q_stream_answer_dedup(spark, sf):
    """Answers of three deliveries with event times, kept once per key by the stateful stream under a watermark of
    ten days: re-sent answers, answers without a question id, and answers that come too late (T-01)."""
    work = f"{ensure_checkpoint_dir(spark)}/dedup-{uuid.uuid4().hex[:12]}"
    unnamed = F.col("paper_id") % 7 == 0
    rows = q_rule_answers(spark, sf).select(
        "paper_id", F.when(~unnamed, F.col("question_id")).alias("question_id"),
        F.when(unnamed, F.lit("UNSURE")).otherwise(F.col("response")).alias("response"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("paper_id") % 40 * 86_400).alias("at"))
    schema = rows.schema
    days = F.col("paper_id") % 40
    # first the papers of days 0 to 19, then 15 to 39 (15 to 19 again), then all of them: days 0 to 9 are too late if new
    for part in ((days < 20) & (F.col("paper_id") % 3 > 0), days >= 15, F.lit(True)):
        rows.where(part).write.mode("append").parquet(f"{work}/source")
        answer_ingest_stream(spark, f"{work}/source", schema, f"{work}/target", f"{work}/checkpoint", event_time="at", delay="10 days")
    return spark.read.schema(schema).parquet(f"{work}/target").select("paper_id", "question_id", "response")


def q_answer_job_resume(spark, sf):
    """The resumable answer job run on a third of the papers, then on all of them: only
    missing answers are computed (X-01, X-02, X-03, J-07)."""
    path = f"{ensure_checkpoint_dir(spark)}/answers-{uuid.uuid4().hex[:12]}"
    papers, questions = fx.papers(spark, sf), [(q, q) for q in question_ids()]
    L.run_answer_job(papers.where("id % 3 = 0"), questions, path)
    L.run_answer_job(papers, questions, path)
    return L.read_answers(spark, path).select("paper_id", "question_id", "response", "input_tokens", "output_tokens", "model")


QUERIES = {
    "stream_daily_counts": q_stream_daily_counts,
    "stream_answer_ingest": q_stream_answer_ingest,
    "stream_answer_dedup": q_stream_answer_dedup,
    "answer_job_resume": q_answer_job_resume,
}

ORACLE = {
    "stream_answer_ingest": f"SELECT paper_id, question_id, response FROM ({SQL_RULE_ANSWERS})",
    "answer_job_resume": SQL_RULE_ANSWERS,
    "stream_answer_dedup": f"""
WITH a AS (SELECT DISTINCT paper_id, CASE WHEN paper_id % 7 = 0 THEN NULL ELSE question_id END AS question_id,
    CASE WHEN paper_id % 7 = 0 THEN 'UNSURE' ELSE response END AS response, paper_id % 40 AS day FROM ({SQL_RULE_ANSWERS})),
sent AS (SELECT *, 1 AS delivery FROM a WHERE day < 20 AND paper_id % 3 > 0 UNION ALL SELECT *, 2 FROM a WHERE day >= 15 UNION ALL SELECT *, 3 FROM a),
newest AS (SELECT delivery, max(day) AS day FROM sent GROUP BY delivery),
arrived AS (SELECT s.*, (SELECT max(n.day) - 10 FROM newest n WHERE n.delivery < s.delivery) AS watermark FROM sent s)
SELECT DISTINCT paper_id, question_id, response FROM arrived WHERE watermark IS NULL OR day > watermark""",
    "stream_daily_counts": """
SELECT CAST(ts AS DATE) AS day, event_type, CAST(COUNT(*) AS BIGINT) AS n FROM events GROUP BY 1, 2""",
}
