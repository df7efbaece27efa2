"""Readers and writers with explicit schemas (S-01, S-02, S-04, S-05, S-07, S-10,
S-12, S-13) and the name-field parsing they need (F-12)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwork.session import read_if_any

PAPER_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), True),
    T.StructField("title", T.StringType(), True),
    T.StructField("abstract", T.StringType(), True),
    T.StructField("label", T.StringType(), True),
])

ANSWER_SCHEMA = T.StructType([
    T.StructField("paper_id", T.LongType(), True),
    T.StructField("question_id", T.StringType(), True),
    T.StructField("prompt", T.StringType(), True),
    T.StructField("response", T.StringType(), True),
    T.StructField("model", T.StringType(), True),
    T.StructField("input_tokens", T.LongType(), True),
    T.StructField("output_tokens", T.LongType(), True),
])


def _csv(spark: SparkSession, schema=None):
    r = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return r.schema(schema) if schema is not None else r


def read_papers_csv(spark: SparkSession, path: str, label_col: str = "label", id_col: str = "id",
                    extra_schema: T.StructType | None = None) -> DataFrame:
    """Paper table from CSV: keeps id, title, abstract and the label column (renamed to
    ``label``); raises when a required column is missing."""
    df = _csv(spark, extra_schema).csv(path)
    need = [id_col, "title", "abstract", label_col]
    missing = [c for c in need if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df.select(F.col(id_col).cast("long").alias("id"), "title", "abstract",
                     F.col(label_col).alias("label"))


def read_indexed_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV whose first (unnamed) column is a row index: renamed to ``row_id``."""
    df = _csv(spark).csv(path)
    first = df.columns[0]
    return df.withColumnRenamed(first, "row_id") if first in ("_c0", "") else df


def read_answer_dir(spark: SparkSession, path: str, one_object_per_file: bool = False) -> DataFrame:
    """Answer folder: JSON lines (our writer) or one pretty-printed JSON object per
    (paper, question) file (``one_object_per_file``). Missing token counts default to
    0; sorted by (paper, question). An empty folder gives an empty frame."""
    df = read_if_any(lambda: spark.read.schema(ANSWER_SCHEMA).option("multiLine", one_object_per_file).json(path))
    if df is None:
        df = spark.createDataFrame([], ANSWER_SCHEMA)
    return df.select("paper_id", "question_id", "response", "model",
                     F.coalesce("input_tokens", F.lit(0)).alias("input_tokens"),
                     F.coalesce("output_tokens", F.lit(0)).alias("output_tokens")) \
        .orderBy("paper_id", "question_id")


def write_answer_dir(df: DataFrame, path: str, mode: str = "append") -> None:
    """Answers as JSON lines, partitioned by question (not one tiny file per answer). Rows are
    dealt by question and a salt first, so a folder gets a few files, not one per task."""
    salt = F.pmod(F.xxhash64("paper_id"), F.lit(4))
    df.repartition("question_id", salt).write.mode(mode).partitionBy("question_id").json(path)


def parse_run_name(file_col: F.Column) -> tuple[F.Column, F.Column]:
    """'<model>_run<k>.csv' -> (model, run)."""
    base = F.regexp_extract(file_col, r"([^/]+?)(\.[A-Za-z0-9]+)?$", 1)
    return (F.regexp_extract(base, r"^(.*)_run\d+$", 1),
            F.regexp_extract(base, r"_run(\d+)$", 1).cast("int"))


def parse_provider_strategy(name_col: F.Column) -> tuple[F.Column, F.Column]:
    """'<provider>_<strategy...>' split at the first underscore."""
    return (F.regexp_extract(name_col, r"^([^_]+)_", 1), F.regexp_extract(name_col, r"^[^_]+_(.*)$", 1))


def read_runs_csv(spark: SparkSession, glob: str, schema: T.StructType | None = None) -> DataFrame:
    """Many result files in one scan; model and run number parsed from each file name."""
    df = _csv(spark, schema).csv(glob)
    fname = F.col("_metadata.file_name")
    model, run = parse_run_name(fname)
    return df.select("*", model.alias("model"), run.alias("run"))


def read_tagged_csv(spark: SparkSession, glob: str, tag: str = "provider",
                    schema: T.StructType | None = None) -> DataFrame:
    """One result file per model/provider read as one table with the file stem as tag."""
    df = _csv(spark, schema).csv(glob)
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[A-Za-z0-9]+)?$", 1)
    return df.select("*", stem.alias(tag))


def union_tagged(frames: dict, tag: str = "provider") -> DataFrame:
    """Dict of result tables -> one table with a tag column (instead of a pickle)."""
    out = None
    for name, df in frames.items():
        d = df.withColumn(tag, F.lit(name))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def json_safe(df: DataFrame) -> DataFrame:
    """NaN -> NULL and +-inf -> 'inf' / '-inf' strings in every double column, so rows
    serialise to strict JSON."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = (F.when(F.isnan(c), F.lit(None))
                 .when(c == float("inf"), F.lit("inf")).when(c == float("-inf"), F.lit("-inf"))
                 .otherwise(c.cast("string")))
        out.append(c.alias(f.name))
    return df.select(*out)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def first_n(df: DataFrame, n: int, order=("id",)) -> DataFrame:
    """First n rows by ``order``; n = -1 means all rows."""
    return df if n == -1 else df.orderBy(*order).limit(n)
