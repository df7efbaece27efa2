"""Corpus pipeline: quality rules, exact dedup, SimHash near-dedup, mixing, SentencePiece encoding and decoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet in the shared folder and read back as the next stage's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.llm.common import table, work_dir, written
from siftwork.llm.exact import drop_copies
from siftwork.llm.mixing import mixed
from siftwork.llm.pieces import encode_documents
from siftwork.llm.quality import keep_good
from siftwork.llm.simhash import drop_near_duplicates


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts (white space aside)."""
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each SimHash component."""
    return drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose token shares are the production targets."""
    return mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the ids of the text, their number, the segmentation's score, and whether decoding the ids
    gives the text back (null: empty; the space mark U+2581 as a space), by CRC-32 of the UTF-8 bytes."""
    text = F.replace(F.coalesce(docs["text"], F.lit("")), F.lit("\u2581"), F.lit(" "))
    encoded = encode_documents(docs, carry={**{c: docs[c] for c in ("doc_id", "lang", "source")}, "text_crc32": F.crc32(text.cast("binary"))}, decode=True)
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "score", "ids",
                          (F.col("decoded_crc32") == F.col("text_crc32")).alias("round_trip"))


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mix", mix), ("encode", encode)]

# SimHash components and SentencePiece ids have no SQL form; tests/llm compares run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    work = work_dir(spark, "pipeline")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"{work}/{name}")
    return docs
