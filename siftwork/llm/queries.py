"""The registered opN_* queries: thin uses of the operators on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.llm.common import table, work_dir
from siftwork.llm.sql import ORACLE  # noqa: F401


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwork.llm.exact import exact_groups, without_white_space
    docs = table(spark, sf_dir, "documents")
    return exact_groups(docs, carry={"text_sha256": F.sha2(without_white_space(docs["text"]), 256)})


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwork.llm.suffix import repeated_spans
    found = repeated_spans(table(spark, sf_dir, "documents"), length=200)
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwork.llm.mixing import mix
    found = mix(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "tokens", F.col("by_source").alias("source_class"), F.col("by_lang").alias("lang_class"), F.col("by_topic").alias("topic"),
                        F.round("weight", 6).alias("weight"), F.round("probability", 6).alias("probability"), "kept")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwork.llm.pieces import encode_documents
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(docs["text"], F.lit(""))
    encoded = encode_documents(docs, carry={"doc_id": docs["doc_id"], "text_crc32": F.crc32(F.replace(text, F.lit("\u2581"), F.lit(" ")).cast("binary"))}, decode=True)
    return encoded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "score", "n_chunks",
                          F.xxhash64("ids").alias("ids_hash"), (F.col("decoded_crc32") == F.col("text_crc32")).alias("round_trip"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwork.llm.sharding import shard
    found = shard(table(spark, sf_dir, "documents"), shards=40)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwork.llm.simhash import near_duplicates
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwork.llm.quality import quality_measures
    return quality_measures(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwork.llm.urls import judge_urls
    return judge_urls(table(spark, sf_dir, "pages"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwork.llm.lines import drop_boilerplate
    cleaned = drop_boilerplate(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwork.llm.idstore import document_keys, find_keys, read_ids, write_store
    docs = table(spark, sf_dir, "documents")
    folder = work_dir(spark, "idstore")
    write_store(docs, folder)
    return read_ids(spark, folder, find_keys(spark, folder, document_keys(docs))).select("doc_id", "start", "n_tokens", "ids_crc32")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwork.llm.negatives import mine
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = mine(vectors.select("vec_id", label.alias("label"), "embedding"), anchor=F.col("vec_id") % 100 == 0)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwork.llm.alignment import align
    return align(table(spark, sf_dir, "documents")).documents


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftwork.llm.packing import pack, tokenised
    pieces = pack(tokenised(table(spark, sf_dir, "documents")))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "stored", "loss_tokens")


QUERIES = {f.__name__: f for f in (
    op1_exact_dedup, op2_suffix_dedup, op3_mix_sources, op4_sentencepiece, op5_sharding, op6_simhash_near_dedup, op7_quality_rules, op8_url_filter, op9_line_dedup, op10_token_store,
    op11_hard_negatives, op12_token_alignment, op13_packing)}
