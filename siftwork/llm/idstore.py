"""Operator 10, token-ID / binary output: raw id files with a minimal perfect hash index.

A store is one shared folder:

* ``ids-SSSSSS.bin``: the ids of shard S, raw little-endian unsigned integers without any
  header, documents in ascending doc_id order (shard 0 first, nulls first). Ids take two
  bytes when the vocabulary allows, else four.
* ``index-PPPPP.bin``: the keys of index part P (a key's part is its hash modulo the number
  of parts). A minimal perfect hash over the part's keys (levels of bit arrays; a key sits in
  the first level where no other key shares its bit, and its rank is its slot) leads to
  arrays by slot: 32-bit key fingerprint, shard, offset in the shard, number of ids, and
  number of ids in all documents before it. A lookup reads one slot; a key that is not in
  the store is refused by its fingerprint (but for one in 2**32).
* ``meta.json``: id width and number of parts.

A key is (doc_id, occurrence): rows that repeat a doc_id are numbered 0, 1, ... in order of
their text. The texts are range-partitioned by doc_id once (Spark samples the bounds), each
partition is one shard, written by its task under a temporary name and renamed, so that
repeated or speculative tasks leave the same file. Only one row per document goes on to
the index, and one row per shard to the running total.

Files are written through pyarrow's file systems (file, hdfs, s3, gs URIs).

Defined results: null and empty texts hold the end id only; a null doc_id is a key like
any other and sorts first; extra columns are ignored; an empty table gives a store without shards.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwork.llm.common import per_worker, written
from siftwork.llm.words import _byte_symbols

_PUNCTUATION = r"[!-/:-@\[-`{-~]"
_LETTERS_THEN_PUNCTUATION = re.compile(rf"[A-Za-zÀ-ÖØ-öø-ɏ]+{_PUNCTUATION}+")  # letters below U+0250: no two engines read them differently
# The steps before merging of the files whose pieces are known to close at letters, single digits and runs of other characters
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
_WORDS_KEPT = 800_000  # packed: about 20 MB a worker
_WORD_BYTES = 32 << 20  # of the words kept
_TEXT_BYTES = 4 << 20  # encoded at once
_GAMMA = 2
_MAX_LEVELS = 64
_RECORD = np.dtype([("fingerprint", "<u4"), ("shard", "<u4"), ("at", "<u8"), ("n", "<u8"), ("start", "<u8")])


def default_tokenizer() -> bytes:
    import public_tokenizers
    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as f:
        return f.read()


# ---- files ------------------------------------------------------------------------------

def _open(uri: str):
    from pyarrow import fs
    if uri.startswith("file:"):  # also file:/path, Hadoop's short form
        uri = "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def _put(folder: str, name: str, parts) -> None:
    """Write a file under a temporary name, then rename it."""
    import uuid
    files, path = _open(folder)
    temp = f"{path}/.{name}.{uuid.uuid4().hex}"
    with files.open_output_stream(temp) as out:
        for part in parts:
            out.write(part)
    files.move(temp, f"{path}/{name}")


def _read(folder: str, name: str, at: int = 0, size: int | None = None) -> bytes:
    files, path = _open(folder)
    with files.open_input_file(f"{path}/{name}") as f:
        return f.read() if size is None else f.read_at(size, at)


# ---- encoding ---------------------------------------------------------------------------

class _Words:
    """Ids by white-space-separated word, each encoded once while it is remembered. The table is packed (an Arrow column of
    the words and a numpy array of all their ids in a row, without an object per word) and bounded in words and bytes.

    A tokenizer that drops white space never joins across it, so a text's ids are its words'
    ids in a row (``by_word``; checked on an example, other kinds get whole texts). New words
    are encoded many at a time. If the tokenizer closes each piece before merging with a suffix (``closing``: the ids that hold
    it), words of letters are cut apart by it, as are letters followed by punctuation: such a word has at least
    one piece, or two, so a total of just as many means that each has that number. Other words have a mark
    of one id between them."""

    def __init__(self, tokenizer: bytes, width: int):
        from tokenizers import Tokenizer
        self.tokenizer, self.kind = Tokenizer.from_buffer(tokenizer), f"<u{width}"
        ids = [e.ids for e in self._encode(["a b", "a", "b", "\x00"])]
        self.by_word = ids[0] == ids[1] + ids[2]
        self.mark, self.closing = ids[3], self._closing()
        self._forget()

    def _forget(self) -> None:
        self.known, self.ids, self.ends = pa.array([], pa.string()), np.zeros(0, self.kind), np.zeros(1, np.int64)

    def __len__(self) -> int:
        return len(self.known)

    def __getitem__(self, word: str) -> bytes:
        return self.of([word])[0]

    def _closing(self) -> np.ndarray | None:
        file, added = json.loads(self.tokenizer.to_str()), self.tokenizer.get_added_tokens_decoder()
        model, suffix = file["model"], file["model"].get("end_of_word_suffix")
        inside = re.compile(rf"[^\W\d_]*{_PUNCTUATION}*")  # an added token that could be found in such a word
        if (not suffix or (file["normalizer"], file["pre_tokenizer"]) != (_NORMALIZER, _PRE_TOKENIZER)
                or any(inside.fullmatch(t.content) for t in added.values()) or any(c + suffix not in model["vocab"] for c in _byte_symbols())):
            return None
        out = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        out[[k for piece, k in model["vocab"].items() if piece.endswith(suffix)]] = True
        return out

    def _cut(self, words: list[str], pieces: int, learned: dict[str, bytes]) -> list[str]:
        """Learn words that should have so many pieces each; those of groups where the total differs are given back."""
        step, rest = np.dtype(self.kind).itemsize, []
        for k in range(0, len(words), 4000):
            part = words[k:k + 4000]
            ids = np.array(self._encode([" ".join(part)])[0].ids, self.kind)
            ends = np.flatnonzero(self.closing[ids])
            if len(ends) != pieces * len(part) or ends[-1] != len(ids) - 1:
                rest += part
                continue
            raw, to = ids.tobytes(), (step * (ends[pieces - 1::pieces] + 1)).tolist()
            learned.update(zip(part, map(raw.__getitem__, map(slice, [0, *to[:-1]], to)), strict=True))
        return rest

    def _encode(self, texts: list[str]):
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self._encode(texts)]

    def learn(self, words: list[str]) -> None:
        learned: dict[str, bytes] = {}
        if self.closing is not None:
            letters, other = [], []
            for w in words:
                (letters if w.isalpha() else other).append(w)
            two, words = [], []
            for w in other:
                (two if _LETTERS_THEN_PUNCTUATION.fullmatch(w) else words).append(w)
            words += self._cut(letters, 1, learned) + self._cut(two, 2, learned)
        step, rest = np.dtype(self.kind).itemsize, [] if len(self.mark) == 1 else words
        for k in range(0, len(words) if len(self.mark) == 1 else 0, 2000):
            part = words[k:k + 2000]
            joined = " \x00 ".join(part)
            if "<|" in joined or joined.count("\x00") != len(part) - 1:  # words that hold a mark or may be a special token: one by one
                rest += [w for w in part if "\x00" in w or "<|" in w]
                part = [w for w in part if "\x00" not in w and "<|" not in w]
                joined = " \x00 ".join(part)
            if not part:
                continue
            ids = np.array(self._encode([joined])[0].ids, self.kind)
            marks = step * np.flatnonzero(ids == self.mark[0])
            if len(marks) == len(part) - 1:
                raw = ids.tobytes()
                learned.update(zip(part, map(raw.__getitem__, map(slice, [0, *(marks + step).tolist()], [*marks.tolist(), len(raw)])), strict=True))
            else:
                rest += part
        for k in range(0, len(rest), 2000):
            part = rest[k:k + 2000]
            learned.update(zip(part, self.whole(part), strict=True))
        self.known = pa.concat_arrays([self.known, pa.array(list(learned), pa.string())])
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(learned.values()), self.kind)])
        self.ends = np.append(self.ends, self.ends[-1] + np.cumsum(np.fromiter(map(len, learned.values()), np.int64, len(learned)) // step))

    def rows(self, words: pa.Array) -> np.ndarray:
        """The rows of different words in the table; new ones are learned."""
        words = words.cast(pa.string())
        at = pc.index_in(words, value_set=self.known)
        if at.null_count and (len(self) + at.null_count > _WORDS_KEPT or self.known.nbytes > _WORD_BYTES):
            self._forget()
            at = pc.index_in(words, value_set=self.known)
        if at.null_count:
            first, new = len(self), words.filter(at.is_null())
            self.learn(new.to_pylist())
            at = pc.replace_with_mask(at, at.is_null(), pc.add(pc.index_in(new, value_set=self.known.slice(first)), pa.scalar(first, pa.int32())))
        return at.to_numpy()

    def of(self, words: list[str]) -> list[bytes]:
        """The ids of different words, as little-endian bytes."""
        return [self.ids[self.ends[k]:self.ends[k + 1]].tobytes() for k in self.rows(pa.array(words, pa.string())).tolist()]


def encode_texts(texts: list[str | None] | pa.Array, words: _Words, end_id: int) -> list[bytes]:
    """Each text's ids with the end id, as little-endian bytes. Arrow splits the texts, numbers their different words and finds
    them in the table, so Python meets only new words; numpy lays the ids out."""
    end, out = np.array([end_id], words.kind).tobytes(), []
    if not words.by_word:
        return [ids + end for ids in words.whole([t or "" for t in (texts.to_pylist() if isinstance(texts, pa.Array) else texts)])]
    texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
    group = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64) // _TEXT_BYTES
    width = np.dtype(words.kind).itemsize
    for a, b in zip([0, *(np.flatnonzero(np.diff(group)) + 1).tolist()], [*(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)], strict=True):
        split = pc.ascii_split_whitespace(texts.slice(a, b - a))
        numbered = split.flatten().dictionary_encode()
        which = words.rows(numbered.dictionary)[numbered.indices.to_numpy(zero_copy_only=False)]
        n = words.ends[which + 1] - words.ends[which]
        ends = np.cumsum(n)
        at = np.repeat(words.ends[which] - (ends - n), n)
        at += np.arange(len(at))
        raw = words.ids[at].tobytes()
        upto = np.append(0, ends)[np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False), dtype=np.int64)] * width
        at = 0
        for to in upto.tolist():
            out.append(raw[at:to] + end)
            at = to
    return out


# ---- minimal perfect hash ---------------------------------------------------------------

def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _level_hash(h1: np.ndarray, h2: np.ndarray, level: int, bits: int) -> np.ndarray:
    return _mix(_mix(h1, 2 * level) ^ h2, 2 * level + 1) % np.uint64(bits)


def build_mph(h1: np.ndarray, h2: np.ndarray) -> list[np.ndarray]:
    """Levels of bit arrays (as booleans) for keys given by two 64-bit hashes each."""
    levels = []
    while len(h1):
        if len(levels) == _MAX_LEVELS:
            raise ValueError("two keys share both hashes")
        bits = max(64, _GAMMA * len(h1))
        slot = _level_hash(h1, h2, len(levels), bits).astype(np.int64)
        alone = np.bincount(slot, minlength=bits) == 1
        levels.append(alone)
        rest = ~alone[slot]
        h1, h2 = h1[rest], h2[rest]
    return levels


def mph_slots(levels: list[np.ndarray], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Slot 0 .. n-1 of each key; -1 for a key that no level holds."""
    return Ranked(levels).slots(h1, h2)


class Ranked:
    """Levels as 64-bit words with the number of ones before each word: a lookup reads one word and one
    count per level, whatever the number of keys."""

    def __init__(self, levels: list[np.ndarray]):
        self.bits = [len(alone) for alone in levels]
        padded = [np.concatenate([alone, np.zeros(-len(alone) % 64, bool)]) for alone in levels]
        self._set([np.packbits(alone, bitorder="little").view("<u8") for alone in padded])

    def _set(self, words: list[np.ndarray]) -> None:
        self.words, before = words, 0
        self.ranks = []
        for w in words:
            ones = np.cumsum(np.bitwise_count(w), dtype=np.int64)
            self.ranks.append(before + np.concatenate([np.zeros(1, np.int64), ones[:-1]]) if len(w) else np.zeros(0, np.int64))
            before += int(ones[-1]) if len(w) else 0

    @classmethod
    def of(cls, bits: list[int], words: list[np.ndarray], ranks: list[np.ndarray]) -> Ranked:
        out = cls([])
        out.bits, out.words, out.ranks = bits, words, ranks
        return out

    def slots(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out, todo = np.full(len(h1), -1, np.int64), np.arange(len(h1))
        for k, (bits, words, ranks) in enumerate(zip(self.bits, self.words, self.ranks, strict=True)):
            if not len(todo):
                break
            at = _level_hash(h1[todo], h2[todo], k, bits)
            word, bit = words[(at >> np.uint64(6)).astype(np.int64)], at & np.uint64(63)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[todo[hit]] = (ranks[(at >> np.uint64(6)).astype(np.int64)] + below)[hit]
            todo = todo[~hit]
        return out


def _fingerprint(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    return (_mix(h2 ^ np.uint64(0x5851F42D4C957F2D), 0) ^ h1).astype(np.uint32)


def _index_bytes(levels: list[np.ndarray], records: np.ndarray) -> Iterator[bytes]:
    """[number of records, number of levels, bits of each level], words and ranks of each level, records."""
    table = Ranked(levels)
    yield np.array([len(records), len(levels), *table.bits], "<u8").tobytes()
    for words, ranks in zip(table.words, table.ranks, strict=True):
        yield words.tobytes()
        yield ranks.astype("<i8").tobytes()
    yield records.tobytes()


class IndexPart:
    """One index part over its raw bytes; nothing is rebuilt when it is opened."""

    def __init__(self, raw: bytes):
        n, n_levels = np.frombuffer(raw, "<u8", 2).astype(int)
        bits = np.frombuffer(raw, "<u8", n_levels, 16).astype(int).tolist()
        at, words, ranks = 16 + 8 * int(n_levels), [], []
        for size in bits:
            count = (size + 63) // 64
            words.append(np.frombuffer(raw, "<u8", count, at))
            ranks.append(np.frombuffer(raw, "<i8", count, at + 8 * count))
            at += 16 * count
        self.table, self.records = Ranked.of(bits, words, ranks), np.frombuffer(raw, _RECORD, n, at)

    def find(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(is it there, its record) for each key."""
        slot = self.table.slots(h1, h2)
        if not len(self.records):
            return np.zeros(len(slot), bool), np.zeros(len(slot), _RECORD)
        got = self.records[np.maximum(slot, 0)]
        return (slot >= 0) & (got["fingerprint"] == _fingerprint(h1, h2)), got


# ---- Spark jobs -------------------------------------------------------------------------

def _keyed(df: DataFrame, parts: int) -> DataFrame:
    return (df.withColumn("h1", F.xxhash64("doc_id", "occ")).withColumn("h2", F.xxhash64(F.lit("key"), F.col("occ"), F.col("doc_id")))
            .withColumn("part", F.pmod("h1", F.lit(parts))))


def write_store(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: bytes | None = None,
                end_id: int = 2, shard_bytes: int = 96 << 20, part_keys: int = 100_000) -> None:
    """Encode the texts and write the store into ``folder`` (a new folder below a shared one)."""
    spark = docs.sparkSession
    source = tokenizer or default_tokenizer()
    from tokenizers import Tokenizer
    width = 2 if max(Tokenizer.from_buffer(source).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    shared = spark.sparkContext.broadcast(source)  # one vocabulary file: a fixed size
    keyed = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    size = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(spark.sparkContext.defaultParallelism, int(size // shard_bytes) + 1)
    files, path = _open(folder)
    files.create_dir(path, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from pyspark import TaskContext
        shard, words, rows = TaskContext.get().partitionId(), per_worker(shared, f"words-{width}", lambda file: _Words(file, width)), []

        def parts():
            at, last, occ = 0, object(), 0
            for batch in batches:
                names = batch.column(0).to_pylist()
                for name, ids in zip(names, encode_texts(batch.column(1), words, end_id), strict=True):
                    occ = occ + 1 if name == last else 0
                    last = name
                    rows.append((name, occ, at, len(ids) // width))
                    at += len(ids) // width
                    yield ids

        first = next(stream := parts(), None)
        if first is None:
            return
        _put(folder, f"ids-{shard:06d}.bin", chain([first], stream))
        pa.default_memory_pool().release_unused()  # the worker waits for its next task
        for k in range(0, len(rows), 65_536):
            name, occ, at, n = zip(*rows[k:k + 65_536], strict=True)
            yield pa.RecordBatch.from_pydict({"doc_id": name, "occ": occ, "shard": [shard] * len(name), "at": at, "n": n}, schema=manifest)

    manifest = pa.schema([("doc_id", pa.int64()), ("occ", pa.int64()), ("shard", pa.int64()), ("at", pa.int64()), ("n", pa.int64())])
    ordered = (keyed.repartitionByRange(shards, F.col("doc_id").cast("bigint").asc_nulls_first(), F.xxhash64("text"))  # a hot id is many shards
               .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text"))
    entries = written(ordered.mapInArrow(write, "doc_id bigint, occ bigint, shard bigint, at bigint, n bigint"), f"{folder}/manifest")
    # an id that goes on in the next shard is that shard's first: its rows there are numbered on
    first = entries.groupBy("shard").agg(F.min_by(F.struct("doc_id"), "at").alias("id")).select(F.col("id.doc_id").alias("doc_id")).distinct()
    here = entries.join(first, entries["doc_id"].eqNullSafe(first["doc_id"]), "left_semi").groupBy("doc_id", "shard").agg(F.count("*").alias("rows"))
    earlier = here.withColumn("earlier", F.sum("rows").over(W.partitionBy("doc_id").orderBy("shard")) - F.col("rows")).filter("earlier > 0")
    earlier = written(earlier.select(F.col("doc_id").alias("same"), F.col("shard").alias("in"), "earlier"), f"{folder}/repeats")  # a row per shard at most
    totals = entries.groupBy("shard").agg(F.sum("n").alias("n"))
    # one row per shard
    before = totals.select("shard", (F.sum("n").over(W.orderBy("shard")) - F.col("n")).alias("base"))
    n_parts = max(1, -(-entries.count() // part_keys))

    def index(pdf: pd.DataFrame) -> pd.DataFrame:
        h1, h2 = (pdf[c].to_numpy(np.int64).view(np.uint64) for c in ("h1", "h2"))
        levels = build_mph(h1, h2)
        records = np.zeros(len(pdf), _RECORD)
        slot = mph_slots(levels, h1, h2)
        records["fingerprint"][slot] = _fingerprint(h1, h2)
        for c in ("shard", "at", "n", "start"):
            records[c][slot] = pdf[c].to_numpy()
        part = int(pdf["part"].iloc[0])
        _put(folder, f"index-{part:05d}.bin", _index_bytes(levels, records))
        return pd.DataFrame({"part": [part], "keys": [len(pdf)]})

    numbered = entries.join(earlier, F.col("doc_id").eqNullSafe(F.col("same")) & (F.col("shard") == F.col("in")), "left").withColumn("occ", F.col("occ") + F.coalesce("earlier", F.lit(0)))
    placed = _keyed(numbered.drop("same", "in", "earlier").join(before, "shard").withColumn("start", F.col("base") + F.col("at")), n_parts)
    built = placed.groupBy("part").applyInPandas(index, "part bigint, keys bigint").agg(F.sum("keys")).first()[0] or 0
    _put(folder, "meta.json", [json.dumps({"width": width, "parts": n_parts, "keys": built}).encode()])


def find_keys(spark: SparkSession, folder: str, keys: DataFrame) -> DataFrame:
    """Look up keys (doc_id, occ) in the index: + shard, at, n, start; absent keys give no row."""
    parts = json.loads(_read(folder, "meta.json"))["parts"]

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        part = int(pdf["part"].iloc[0])
        try:
            index = IndexPart(_read(folder, f"index-{part:05d}.bin"))
        except FileNotFoundError:  # no key of the store has this part
            return pd.DataFrame({c: [] for c in ("doc_id", "occ", "shard", "at", "n", "start")})
        there, got = index.find(*(pdf[c].to_numpy(np.int64).view(np.uint64) for c in ("h1", "h2")))
        out = pdf.loc[there, ["doc_id", "occ"]].reset_index(drop=True)
        return out.assign(**{c: got[c][there].astype(np.int64) for c in ("shard", "at", "n", "start")})

    schema = "doc_id bigint, occ bigint, shard bigint, at bigint, n bigint, start bigint"
    return _keyed(keys.select("doc_id", "occ"), parts).groupBy("part").applyInPandas(find, schema)


def read_ids(spark: SparkSession, folder: str, found: DataFrame) -> DataFrame:
    """Digest of the stored ids of looked-up keys: doc_id, occ, start, n_tokens, ids_crc32 (of the ids
    as little-endian unsigned 32-bit integers). A task reads each shard file once."""
    width = json.loads(_read(folder, "meta.json"))["width"]

    def digest(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.frombuffer(_read(folder, f"ids-{int(pdf['shard'].iloc[0]):06d}.bin"), f"<u{width}")
        crc = [zlib.crc32(ids[a:a + n].astype("<u4").tobytes()) for a, n in zip(pdf["at"], pdf["n"], strict=True)]
        return pd.DataFrame({"doc_id": pdf["doc_id"], "occ": pdf["occ"], "start": pdf["start"], "n_tokens": pdf["n"], "ids_crc32": crc})

    return found.groupBy("shard").applyInPandas(digest, "doc_id bigint, occ bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


class IdStore:
    """Keyed access from one process. A lookup reads one word and one rank per level tried (mostly one or
    two), one record and the ids, each by its offset in the file; a part's header is read once."""

    def __init__(self, folder: str):
        self.folder = folder
        meta = json.loads(_read(folder, "meta.json"))
        self.width, self.parts, self._headers = meta["width"], meta["parts"], {}

    def _header(self, name: str) -> list[int]:
        if name not in self._headers:
            n, n_levels = np.frombuffer(_read(self.folder, name, 0, 16), "<u8").tolist()
            self._headers[name] = [n, *np.frombuffer(_read(self.folder, name, 16, 8 * n_levels), "<u8").tolist()]
        return self._headers[name]

    def _record(self, name: str, h1: np.ndarray, h2: np.ndarray) -> np.ndarray | None:
        n, *bits = self._header(name)
        at, slot = 16 + 8 * len(bits), None
        for level, size in enumerate(bits):
            count = (size + 63) // 64
            if slot is None:
                bit = int(_level_hash(h1, h2, level, size)[0])
                word = int.from_bytes(_read(self.folder, name, at + 8 * (bit >> 6), 8), "little")
                if word >> (bit & 63) & 1:
                    rank = int.from_bytes(_read(self.folder, name, at + 8 * (count + (bit >> 6)), 8), "little")
                    slot = rank + (word & ((1 << (bit & 63)) - 1)).bit_count()
            at += 16 * count
        if slot is None:
            return None
        got = np.frombuffer(_read(self.folder, name, at + _RECORD.itemsize * slot, _RECORD.itemsize), _RECORD)
        return got if got["fingerprint"] == _fingerprint(h1, h2) else None

    def get(self, h1: int, h2: int) -> np.ndarray | None:
        """The ids of the key with these hashes (``key_hashes``), or None."""
        try:
            got = self._record(f"index-{h1 % self.parts:05d}.bin", *(np.array([h], np.int64).view(np.uint64) for h in (h1, h2)))
        except FileNotFoundError:  # no key of the store has this part
            return None
        if got is None:
            return None
        raw = _read(self.folder, f"ids-{int(got['shard'][0]):06d}.bin", int(got["at"][0]) * self.width, int(got["n"][0]) * self.width)
        return np.frombuffer(raw, f"<u{self.width}")


def key_hashes(keys: DataFrame) -> DataFrame:
    """(doc_id, occ) -> + h1, h2, for ``IdStore.get``."""
    return _keyed(keys, 1).drop("part")


def document_keys(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The keys (doc_id, occ) of a table's rows."""
    counts = docs.groupBy(docs[id_col].cast("bigint").alias("doc_id")).agg(F.count("*").alias("n"))
    begins = counts.select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(1 << 16).cast("bigint"))).alias("from"))  # short arrays, also for a hot id
    return begins.select("doc_id", F.explode(F.sequence("from", F.least(F.col("from") + (1 << 16), "n") - 1)).alias("occ"))
