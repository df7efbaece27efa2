"""Which texts contain which query texts, without comparing all pairs.

Texts are compared as bytes (UTF-8 byte strings are contained just where the texts are). A query is found from the
place in a document where it begins, by prefixes of growing length, so that the work and the rows put out follow
the places that hold a query, not the pairs that share some part of one.

1. Of each query the prefixes of 1, 2, 4, ... bytes up to the largest power of two that it holds are marked, the last one of them
   in a way of its own, then those that add the lower powers of its length, the largest first: 1, 2, 4, 8 (the last), 12, 13 for
   a query of 13 bytes. Its whole text is marked apart. Marks are bits of a hash of the prefix in a table of fixed size (``bits``
   for the prefixes, ``slots`` words of 32 bits for the whole texts), which goes to the tasks.
2. The documents are read once, where they are stored. A place in a document goes on from a prefix to the next ones while these are
   marked, and where a whole text is marked, the SHA-256 of these bytes is put out with that of the document, once a document.
3. Digests that are no query's fall out at the join with the queries' digests: a prefix or a whole text whose bits are set by
   chance costs time or a row, never a pair. What is left are the pairs; no text is shuffled or written.

Equal queries and equal documents are one class each, so copies aren't expanded into pairs.

Defined results: null and empty query texts have no pairs (a null contains nothing and is contained in
nothing; the empty text would be contained in everything); null documents contain nothing; a text contains itself.
Ids may be of any type that has an order; an id that stands for several texts is in several classes.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwork.operators.vectors import nearest_neighbours
from siftwork.session import ensure_checkpoint_dir

GRAM = 8
BLOCK = 1 << 18  # bytes of text that are hashed together
PIECE = 1 << 16  # places that are followed together
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


class Containment(NamedTuple):
    """``pairs`` (query_class, doc_class), ``query_classes`` (query_id, query_class) and ``doc_classes`` (doc_id, doc_class)."""

    pairs: DataFrame
    query_classes: DataFrame
    doc_classes: DataFrame


def _words(text: bytes, size: int | np.ndarray, at: np.ndarray | slice = slice(None)) -> np.ndarray:
    """The byte strings of ``size`` (1 to 8) that begin at each place of a text, as numbers; bytes behind its end are zero."""
    words = np.ndarray((len(text),), "<u8", buffer=text + bytes(GRAM), strides=(1,))[at]
    return words & (np.uint64(0xFFFFFFFFFFFFFFFF) >> np.uint64(8) * np.asarray(GRAM - size, np.uint64))


def byte_grams(text: bytes, size: int) -> np.ndarray:
    """The different byte strings of ``size`` (at most 8) in a text, as numbers."""
    n = len(text) - size + 1
    return np.unique(_words(text, size, slice(n))).view("<i8") if n > 0 else np.empty(0, "<i8")


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


LETTERS = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _scaled(h: np.ndarray, n: int) -> np.ndarray:
    return (((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


class _Spans:
    """Hashes of any spans of a text from its prefix sums: the same bytes have the same hash wherever they are."""

    def __init__(self, text: bytes, powers: tuple[np.ndarray, np.ndarray]) -> None:
        data = np.frombuffer(text, np.uint8)
        self.sums, self.inverse = np.zeros(len(data) + 1, np.uint64), powers[1]
        np.cumsum(LETTERS[data] * powers[0][:len(data)], out=self.sums[1:])

    def __call__(self, at: np.ndarray, length: int | np.ndarray) -> np.ndarray:
        span = (self.sums[at + length] - self.sums[at]) * self.inverse[at]
        return _mixed(span ^ (np.asarray(length).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))


def _last_bit(h: np.ndarray, bits: int) -> np.ndarray:
    """The bit of a prefix that is the longest power of two of its query."""
    return _scaled(_mixed(h ^ np.uint64(BASE)), bits)


def _end_bits(h: np.ndarray, bits: int, slots: int) -> list[np.ndarray]:
    """The three bits of whole texts, in one word each, behind the ``bits`` of the prefixes."""
    h = _mixed(h * np.uint64(BASE))
    word = bits + 32 * _scaled(h, slots)
    return [word + ((h >> np.uint64(k)) & np.uint64(31)).astype(np.int64) for k in (0, 5, 10)]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, np.ndarray, _Spans]]:
    """Texts (of one byte at least) one after the other, the places where each begins and the last one ends, and their spans."""
    powers = _powers(BASE, 0), _powers(INVERSE, 0)

    def block(texts: list[bytes]) -> tuple[bytes, np.ndarray, _Spans]:
        nonlocal powers
        text = b"".join(texts)
        if len(text) > len(powers[0]):
            powers = _powers(BASE, len(text)), _powers(INVERSE, len(text))
        return text, np.cumsum([0, *map(len, texts)]), _Spans(text, powers)

    for batch in batches:
        texts, size = [], 0
        for value in batch.column(0):
            texts.append(value.as_py())
            size += len(texts[-1])
            if size >= BLOCK:
                yield block(texts)
                texts, size = [], 0
        if texts:
            yield block(texts)


def _marks(bounds: np.ndarray, spans: _Spans, bits: int, slots: int) -> np.ndarray:
    """The bits of the queries' prefixes and whole texts."""
    at, lengths = bounds[:-1], np.diff(bounds)
    top = np.frexp(lengths)[1] - 1
    out = []
    for a in range(int(top.max()) + 1):
        out += [_scaled(spans(at[top > a], 1 << a), bits), _last_bit(spans(at[top == a], 1 << a), bits)]
    length = np.int64(1) << top.astype(np.int64)
    for b in reversed(range(int(top.max()))):
        more = (b < top) & ((lengths >> b) & 1 > 0)
        length[more] += 1 << b
        out.append(_scaled(spans(at[more], length[more]), bits))
    return np.unique(np.concatenate(out + _end_bits(spans(at, lengths), bits, slots)))


def _table(queries: DataFrame, bits: int, slots: int) -> tuple:
    """The marks of all queries as a broadcast of ``bits`` / 8 + 4 ``slots`` bytes; tasks put out the numbers of their bits, only blocks of bits meet."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, bounds, spans in _blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(_marks(bounds, spans, bits, slots))], names=["slot"])

    slot = queries.select(F.col("text").cast("binary")).mapInArrow(run, "slot bigint").select((F.col("slot") + 1).alias("slot"))
    parts = slot.groupBy(F.bitmap_bucket_number("slot").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")).collect()
    out = np.zeros(-(-(bits + 32 * slots) // 32768) * 4096, np.uint8)
    for part, found in parts:
        out[(part - 1) * len(found):part * len(found)] = np.frombuffer(found, np.uint8)
    return queries.sparkSession.sparkContext.broadcast(out), bits, slots


def _marked(table: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return (table[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0


def _held(text: bytes, bounds: np.ndarray, spans: _Spans, table: np.ndarray, bits: int, slots: int) -> set[tuple[int, bytes]]:
    """(number of the document, byte string) of the spans whose prefixes and whole text are marked, each once."""
    found: set[tuple[int, bytes]] = set()

    def descend(at: np.ndarray, left: np.ndarray, power: int) -> None:
        length = np.full(len(at), 1 << power)
        for b in reversed(range(power)):
            more = np.flatnonzero(left >= length + (1 << b))
            more = more[_marked(table, _scaled(spans(at[more], length[more] + (1 << b)), bits))]
            at, left, length = np.append(at, at[more]), np.append(left, left[more]), np.append(length, length[more] + (1 << b))
        one, two, three = (_marked(table, bit) for bit in _end_bits(spans(at, length), bits, slots))
        at, length = at[one & two & three], length[one & two & three]
        doc = np.searchsorted(bounds, at, "right") - 1
        if power < 3:  # short ones come often in a document
            word = _words(text, length, at)
            order = np.lexsort((word, length, doc))
            new = np.ones(len(order), bool)
            new[1:] = np.any([np.diff(x[order]) != 0 for x in (doc, length, word)], axis=0)
            at, length, doc = at[order][new], length[order][new], doc[order][new]
        found.update((d, text[i:i + n]) for d, i, n in zip(doc.tolist(), at.tolist(), length.tolist(), strict=True))

    one_byte = _mixed(LETTERS ^ np.uint64(0xC2B2AE3D27D4EB4F))
    begins = _marked(table, _scaled(one_byte, bits)) | _marked(table, _last_bit(one_byte, bits))
    starts = np.flatnonzero(begins[np.frombuffer(text, np.uint8)])
    for k in range(0, len(starts), PIECE):
        at = starts[k:k + PIECE]
        left = bounds[np.searchsorted(bounds, at, "right")] - at
        power = 0
        while len(at):
            h = spans(at, 1 << power)
            last, on = _marked(table, _last_bit(h, bits)), _marked(table, _scaled(h, bits))
            if last.any():
                descend(at[last], left[last], power)
            power += 1
            on &= left >= 1 << power
            at, left = at[on], left[on]
    return found


def _found(docs: DataFrame, marks: tuple) -> DataFrame:
    """(doc_sha, query_sha): a document's digest, and those of the marked byte strings in it."""
    table, bits, slots = marks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for text, bounds, spans in _blocks(batches):
            found = sorted(_held(text, bounds, spans, table.value, bits, slots))
            own = {d: hashlib.sha256(text[bounds[d]:bounds[d + 1]]).digest() for d in {d for d, _ in found}}
            for k in range(0, len(found), 100_000):
                rows = found[k:k + 100_000]
                yield pa.RecordBatch.from_pydict({"doc_sha": pa.array([own[d] for d, _ in rows], pa.binary()),
                                                  "query_sha": pa.array([hashlib.sha256(held).digest() for _, held in rows], pa.binary())})

    return docs.select(F.col("text").cast("binary")).mapInArrow(run, "doc_sha binary, query_sha binary")


def _saved(df: DataFrame, work: str, name: str) -> DataFrame:
    df.write.mode("overwrite").parquet(f"{work}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{work}/{name}")


def _classes(df: DataFrame, id_col: str, text_col: str, name: str) -> tuple[DataFrame, DataFrame]:
    """(text) of each row that has one, and (id, sha, class): the class is the smallest id of those with the same text."""
    x = df.select(F.col(id_col).alias(f"{name}_id"), F.col(text_col).alias("text")).where("text <> ''")
    ids = x.select(f"{name}_id", F.unhex(F.sha2("text", 256)).alias(f"{name}_sha"))
    return x.select("text"), ids.join(ids.groupBy(f"{name}_sha").agg(F.min(f"{name}_id").alias(f"{name}_class")), f"{name}_sha")


def containing(queries: DataFrame, docs: DataFrame, q_id: str = "id", q_text: str = "text", d_id: str = "id", d_text: str = "text",
               bits: int = 1 << 28, slots: int = 1 << 22) -> Containment:
    """Every pair of a query class and a document class whose text contains the query's."""
    spark: SparkSession = docs.sparkSession
    work = f"{ensure_checkpoint_dir(spark).rstrip('/')}/contain-{uuid.uuid4().hex[:12]}"
    asked, asked_ids = _classes(queries, q_id, q_text, "query")
    held, held_ids = _classes(docs, d_id, d_text, "doc")
    asked_ids, held_ids = _saved(asked_ids, work, "asked"), _saved(held_ids, work, "held")
    asked_names = asked_ids.groupBy("query_sha").agg(F.min("query_class").alias("query_class"))
    held_names = held_ids.groupBy("doc_sha").agg(F.min("doc_class").alias("doc_class"))
    found = _found(held, _table(asked, bits, slots)).distinct()
    pairs = found.join(asked_names, "query_sha").join(held_names, "doc_sha").select("query_class", "doc_class")
    return Containment(_saved(pairs, work, "pairs"), asked_ids.select("query_id", "query_class"), held_ids.select("doc_id", "doc_class"))


def nearest_not_containing(queries: DataFrame, corpus: DataFrame, k: int, text_col: str = "text", id_col: str = "id", query_col: str | None = None, **options) -> DataFrame:
    """The ``k`` nearest corpus rows of every query among those whose text doesn't contain the query's
    (``text_col`` of the queries, else ``query_col``):
    (query_id, rank, neighbor_id, distance), fewer where the corpus has fewer. Queries that lose neighbours ask again for
    twice as many until ``k`` are left, so a query contained in very many documents is still answered in full."""
    spark = corpus.sparkSession
    work = f"{ensure_checkpoint_dir(spark).rstrip('/')}/outside-{uuid.uuid4().hex[:12]}"
    inside = containing(queries, corpus, id_col, query_col or text_col, id_col, text_col)
    total, want, asked, done = corpus.count(), k, queries, None
    while True:
        near = nearest_neighbours(asked, corpus, want, id_col, id_col, **options)
        known = (near.join(inside.query_classes, "query_id", "left").join(inside.doc_classes.withColumnRenamed("doc_id", "neighbor_id"), "neighbor_id", "left")
                 .join(inside.pairs, ["query_class", "doc_class"], "left_anti"))
        left = _saved(known.select("query_id", "rank", "neighbor_id", "distance"), work, f"left-{want}")
        enough = left.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select("query_id")
        last = want >= total
        part = left if last else left.join(enough, "query_id")
        done = part if done is None else done.unionByName(part)
        asked = asked.join(enough.withColumnRenamed("query_id", id_col), id_col, "left_anti")
        if last or asked.isEmpty():
            break
        asked, want = _saved(asked, work, f"asked-{want}"), 2 * want
    order = Window.partitionBy("query_id").orderBy(F.col("rank"))
    return done.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "neighbor_id", "distance")
