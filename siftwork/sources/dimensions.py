"""Small dimensions: model prices and the screening question ids.

Both are tiny by construction (5 and 29 rows), so joining them with
``broadcast`` is size-safe at any data scale.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# USD per 1M input / output tokens, per model.
_PRICES = {
    "gpt-5-mini": (0.25, 2.0),
    "gpt-5-nano": (0.05, 0.4),
    "gemini-2.5-flash": (0.3, 2.5),
    "gemini-2.5-pro": (1.25, 10.0),
    "google/medgemma-27b-text-it": (0.0, 0.0),
}

# 17 inclusion questions I1..I17 and 12 exclusion questions E1..E12.
N_INCLUDE_QUESTIONS = 17
N_EXCLUDE_QUESTIONS = 12

PRICE_SCHEMA = T.StructType([
    T.StructField("model", T.StringType(), False),
    T.StructField("usd_per_1m_in", T.DoubleType(), False),
    T.StructField("usd_per_1m_out", T.DoubleType(), False),
])

QUESTION_SCHEMA = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("question", T.StringType(), True),
    T.StructField("category", T.StringType(), True),
    T.StructField("include_exclude", T.StringType(), True),
    T.StructField("notes", T.StringType(), True),
])


def price_table() -> dict[str, tuple[float, float]]:
    return dict(_PRICES)


def question_ids() -> list[str]:
    return ([f"I{i}" for i in range(1, N_INCLUDE_QUESTIONS + 1)]
            + [f"E{i}" for i in range(1, N_EXCLUDE_QUESTIONS + 1)])


def prices_df(spark: SparkSession, prices: dict | None = None) -> DataFrame:
    rows = [(m, float(i), float(o)) for m, (i, o) in (prices or _PRICES).items()]
    return spark.createDataFrame(rows, PRICE_SCHEMA)


def read_prices_json(spark: SparkSession, path: str) -> DataFrame:
    """Price file: a JSON object keyed by model with the per-1M input/output costs."""
    raw = spark.read.text(path, wholetext=True)
    m = F.from_json("value", T.MapType(T.StringType(), T.MapType(T.StringType(), T.DoubleType())))
    e = raw.select(F.explode(m).alias("model", "c"))
    return e.select("model", F.col("c")["COST_PER_1M_TOKENS_INPUT"].alias("usd_per_1m_in"),
                    F.col("c")["COST_PER_1M_TOKENS_OUTPUT"].alias("usd_per_1m_out"))


def read_questions_csv(spark: SparkSession, path: str) -> DataFrame:
    """Quoted CSV with embedded quotes, commas and line breaks (RFC 4180)."""
    return (spark.read.schema(QUESTION_SCHEMA)
            .option("header", True).option("multiLine", True).option("escape", '"')
            .csv(path))
