"""Operator 6, SimHash near-dedup: pigeonhole blocks.

1. ``fingerprints``: 64-bit SimHash over k-word shingles of the whole text (Arrow batches).
2. Equal fingerprints collapse to one class by a map-side combined aggregate, so a
   group of copies of any size is one node.
3. ``near_pairs``: fingerprints are split into ``blocks`` parts. Two that differ in at
   most ``max_bits`` bits agree in at least ``blocks - max_bits`` of them, so each is
   filed under every choice of that many blocks; an equi-join on (choice, bits) finds
   the candidates and the Hamming distance verifies them. A bucket with more than
   ``bucket_limit`` members is not paired: its members go through an exact linear form
   instead. Each is filed under itself and its 64 one-bit neighbours; members that
   share such a key are within two bits, and two that are within two bits share one,
   so linking each member to the smallest of its key keeps every connection without
   a pair per link (at most 65 members share a key).
4. ``components`` joins links transitively.

Defined results: null and empty texts have fingerprint zero and are linked like any
other; texts with fewer than k words hash their whole word sequence; rows repeating a
doc_id each get a row; null ids keep their fingerprint and take part as members, but
give no name to a component unless no other member has one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.llm.common import utf8, work_dir, written
from siftwork.llm.components import components

_SEED = 42
_SLAB = 1 << 16  # shingles counted at once: 4 MB of bits


def simhash(raw: bytes, shingle: int = 3) -> int:
    """Fingerprint of one UTF-8 text, as a signed 64-bit integer."""
    words = raw.lower().split()  # on bytes: A-Z only, and cuts at exactly [\x20\x09-\x0D]
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    n = max(1, len(words) - shingle + 1)
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=_SEED), grams), np.uint64, n).astype(">u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, n, _SLAB):
        part = hashes[k:k + _SLAB]
        ones += np.unpackbits(part.view(np.uint8)).reshape(len(part), 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, text_hash, fp) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([simhash(raw.as_py(), shingle) for raw in batch.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], fps], names=["doc_id", "text_hash", "fp"])

    keyed = docs.select(docs[id_col].alias("doc_id"), F.xxhash64(docs[text_col]).alias("text_hash"), utf8(docs[text_col]).alias("raw"))
    return keyed.mapInArrow(run, f"doc_id {keyed.schema['doc_id'].dataType.simpleString()}, text_hash bigint, fp bigint")


def _distance(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _block_masks(blocks: int, chosen: int) -> list[int]:
    """One signed 64-bit mask per choice of ``chosen`` blocks."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    part = [((1 << edges[k + 1]) - 1) ^ ((1 << edges[k]) - 1) for k in range(blocks)]
    return [m - (1 << 64) if m >> 63 else m for m in (sum(part[k] for k in ks) for ks in combinations(range(blocks), chosen))]


def near_pairs(fps: DataFrame, max_bits: int = 2, blocks: int = 5, bucket_limit: int = 64, work: str | None = None) -> DataFrame:
    """Distinct fingerprints (column ``fp``) -> links (a, b) whose transitive closure is that of
    all pairs at a distance of at most ``max_bits`` (0 to 2); every link is within that distance."""
    if not 0 <= max_bits <= 2:
        raise ValueError("max_bits must be 0, 1 or 2")
    if max_bits == 0:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    masks = _block_masks(blocks, blocks - max_bits)
    filed = fps.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m).cast("bigint")) for m in masks))).alias("choice", "bits"))
    sizes = filed.groupBy("choice", "bits").agg(F.count("*").alias("n")).filter("n > 1")
    shared = filed.join(sizes, ["choice", "bits"])
    if work:
        shared = written(shared, f"{work}/buckets")
    small = shared.filter(F.col("n") <= bucket_limit)
    left, right = small.withColumnRenamed("fp", "a"), small.select("choice", "bits", F.col("fp").alias("b"))
    pairs = left.join(right, ["choice", "bits"]).filter((F.col("a") < F.col("b")) & (_distance("a", "b") <= max_bits)).select("a", "b")

    crowded = shared.filter(F.col("n") > bucket_limit).select("fp").distinct()
    bits = F.array(*(F.lit(1 << k if k < 63 else -(1 << 63)).cast("bigint") for k in range(64)))
    flips = F.transform(bits, lambda bit: F.col("fp").bitwiseXOR(bit))
    if max_bits == 1:
        near = crowded.select(F.col("fp").alias("a"), F.explode(flips).alias("b"))
        dense = near.join(crowded.select(F.col("fp").alias("b")), "b").filter("a < b").select("a", "b")
    else:
        keyed = crowded.select("fp", F.explode(F.concat(F.array("fp"), flips)).alias("key"))
        hubs = keyed.groupBy("key").agg(F.min("fp").alias("hub"), F.count("*").alias("n")).filter("n > 1")
        dense = keyed.join(hubs, "key").filter("fp <> hub").select(F.col("hub").alias("a"), F.col("fp").alias("b"))
    return pairs.unionAll(dense)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                    max_bits: int = 2, blocks: int = 5, bucket_limit: int = 64) -> DataFrame:
    """(doc_id, text_hash, fp, root, component_id) for every row; component_id = smallest doc_id
    reachable, root = smallest fingerprint reachable."""
    work = work_dir(docs.sparkSession, "simhash")
    marks = written(fingerprints(docs, id_col, text_col, shingle), f"{work}/fingerprints")
    classes = written(marks.groupBy("fp").agg(F.min("doc_id").alias("first_id")), f"{work}/classes")
    links = near_pairs(classes.select("fp"), max_bits, blocks, bucket_limit, work)
    joined = components(links, f"{work}/components")
    members = classes.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("component", "fp").alias("root"))
    names = members.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = members.join(names, "root").select("fp", "root", "component_id")
    return marks.join(named, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each component, with all its columns: the smallest id (an id before
    none), of rows that share it the smallest text hash. Rows equal in id and text are one
    document and stay together."""
    found = near_duplicates(docs, id_col, text_col, **options)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")).alias("first"))
    leaders = first.select(F.col("first.doc_id").alias("leader"), F.col("first.text_hash").alias("leader_hash"))
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs[id_col].alias("row_id"), F.xxhash64(docs[text_col]).alias("row_hash"))
    kept = rows.join(leaders, F.col("row_id").eqNullSafe(F.col("leader")) & (F.col("row_hash") == F.col("leader_hash")), "left_semi")
    return kept.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
