"""Operator 4, SentencePiece encoding and decoding: a max-plus parallel scan.

Encoding finds the segmentation of a text into the model's pieces with the largest sum
of piece scores (characters that no piece covers become byte pieces). Ties go to the
longest last piece, as in a left-to-right search, so the result is one fixed sequence
whatever the chunking. A unigram model's scores are its log-probabilities, in 1/1024; other
models store ranks, which are read as log-probabilities by Zipf's law, -log2(rank + 2), in
1/1024. Scores are whole numbers, so sums are exact in any order.

A piece never holds a space mark after another character, nor a character outside the
pieces' alphabet, so every path passes through certain cuts; between two cuts lies a
unit (mostly a word) that is solved once per task and remembered (a bounded table). Units
are solved by the library's unigram search, texts without cuts by the same search here.

Texts above ``giant_chars`` are split into chunk rows of ``chunk_chars`` and dealt over
the cluster:

1. each chunk yields its boundary-state transfer matrix ``T[i, j]``: the best score of
   pieces that start inside it when the piece before it covers its first ``i``
   characters and its last piece reaches ``j`` characters into the next chunk;
2. the matrices of a document are combined in the (max, +) semiring, which is
   associative: products of blocks first, then prefixes, giving each chunk's vector of
   entry scores;
3. each chunk maps every exit state to the entry state its best path comes from, and
   these maps, composed from the end, fix the states at all boundaries;
4. each chunk is traced back on its own between its two states.

Chunk tables are written to the shared folder, so a lost executor repeats its chunks only.

Defined results: null and empty texts have no ids; the space mark U+2581 in a text is
encoded as a space (so decoding gives a space); rows that repeat an id are encoded one by
one; null ids stay null; carried columns keep their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from math import log2

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwork.llm.common import work_dir, written

MARK = "▁"
_MARK_BYTES = MARK.encode("utf-8")
_DECODED_AT_ONCE = 65_536
NONE = -(1 << 60)
_UNITS_KEPT = 250_000  # about 60 MB a worker
_UNIT_CHARS = 64  # longer units are searched here: the library adds scores in single precision
_BLOCK = 64


def default_model() -> bytes:
    """The public tokenizer's model file."""
    import public_tokenizers
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def scored_model(model: bytes) -> bytes:
    """The model file as a unigram model with whole-number scores and no prefix of its own."""
    from sentencepiece import sentencepiece_model_pb2 as pb
    proto = pb.ModelProto()
    proto.ParseFromString(model)
    unigram = proto.trainer_spec.model_type == 1
    normal = [p for p in proto.pieces if p.type == 1]
    worst = max((-p.score for p in normal if p.score > -1e8), default=0)  # a score far below is a mark, not a rank
    for p in normal:
        p.score = float(round(1024 * (p.score if unigram else -log2(min(max(0, -p.score), worst + 1) + 2))))
    proto.trainer_spec.model_type = 1
    proto.normalizer_spec.add_dummy_prefix = False
    proto.normalizer_spec.remove_extra_whitespaces = False
    return proto.SerializeToString()


class PieceModel:
    """Pieces, scores and the search; built in each task, which frees it, from ``scored_model``'s bytes."""

    def __init__(self, model: bytes):
        import sentencepiece
        self.sp = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        score: dict[str, int] = {}
        self.id: dict[str, int] = {}
        self.bytes_of: list[bytes] = []
        self.byte_id = [0] * 256
        for k, piece in enumerate(sp.id_to_piece(list(range(n)))):
            if sp.is_byte(k):
                value = int(piece[1:-1], 16)
                self.byte_id[value] = k
                self.bytes_of.append(bytes([value]))
            elif sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k):
                self.bytes_of.append(b"")
            else:
                score[piece], self.id[piece] = round(sp.get_score(k)), k
                self.bytes_of.append(piece.encode("utf-8"))
        self.unknown = min(score.values()) - 10
        self.score_of = np.zeros(n, np.int64)  # by id; a character in bytes counts once, at its first byte
        for piece, k in self.id.items():
            self.score_of[k] = score[piece]
        for value, k in enumerate(self.byte_id):
            if value < 0x80 or value >= 0xC0:
                self.score_of[k] = self.unknown
        self.longest = max(map(len, score))
        self.score, self._trie = score, None
        outside = re.escape("".join(c for c in "\n\t\r" if not any(c in p for p in score)))
        splits = all(MARK not in p.lstrip(MARK) for p in score)
        skip = f"[{outside}]|" if outside else ""
        self.unit_re = re.compile(skip + (f"{MARK}*[^{MARK}{outside}]+|{MARK}+" if splits else f"[^{outside}]+" if outside else "(?s:.+)"))
        self.known: dict[str, bytes] = {}

    @property
    def trie(self) -> list:
        """[next by character, score]; built when a unit is searched here for the first time."""
        if self._trie is None:
            self._trie = [{}, None]
            for piece, value in self.score.items():
                node = self._trie
                for c in piece:
                    node = node[0].setdefault(c, [{}, None])
                node[1] = value
        return self._trie

    def search(self, s: str, starts_before: int, entry: list[int]) -> tuple[list[int], list[int]]:
        """Best score to each position of ``s`` and where its last piece starts; pieces start before
        ``starts_before`` only. ``entry``: scores of the first positions that paths come in at."""
        n = len(s)
        best, back = [NONE] * (n + 1), [-1] * (n + 1)
        best[:len(entry)] = entry
        trie = self.trie
        for i in range(min(n, starts_before)):
            here = best[i]
            if here <= NONE:
                continue
            node, e, single = trie, i, False
            while e < n:
                node = node[0].get(s[e])
                if node is None:
                    break
                e += 1
                value = node[1]
                if value is not None:
                    if e == i + 1:
                        single = True
                    if here + value > best[e]:
                        best[e], back[e] = here + value, i
            if not single and here + self.unknown > best[i + 1]:
                best[i + 1], back[i + 1] = here + self.unknown, i
        return best, back

    def trace(self, s: str, back: list[int], end: int) -> tuple[int, list[int]]:
        """Follow the pieces back from ``end``: where the path came in, and its ids."""
        parts: list[str] = []
        while back[end] >= 0:
            parts.append(s[back[end]:end])
            end = back[end]
        ids: list[int] = []
        for part in reversed(parts):
            k = self.id.get(part)
            if k is None:
                ids.extend(self.byte_id[b] for b in part.encode("utf-8"))
            else:
                ids.append(k)
        return end, ids

    def _learn(self, units: set[str]) -> None:
        short = [u for u in units if len(u) <= _UNIT_CHARS]
        for u, ids in zip(short, self.sp.encode(short, num_threads=1), strict=True):
            self.known[u] = np.array(ids, "<i4").tobytes()
        for u in units:
            if len(u) > _UNIT_CHARS:
                self.known[u] = np.array(self.trace(u, self.search(u, len(u), [0])[1], len(u))[1], "<i4").tobytes()

    def encode_marked(self, marked_texts: list[str]) -> list[np.ndarray]:
        """Ids of texts that begin and end at cuts."""
        known = self.known
        units = [self.unit_re.findall(s) for s in marked_texts]
        found = [list(map(known.get, us)) for us in units]
        open_texts = [k for k, got in enumerate(found) if None in got]
        missing = {u for k in open_texts for u, got in zip(units[k], found[k], strict=True) if got is None}
        if len(known) + len(missing) > _UNITS_KEPT:
            known.clear()
            missing = {u for k in open_texts for u in units[k]}
        self._learn(missing)
        for k in open_texts:
            found[k] = list(map(known.__getitem__, units[k]))
        return [np.frombuffer(b"".join(got), "<i4") for got in found]

    def encode(self, texts: list[str | None]) -> tuple[list[int], list[np.ndarray]]:
        """Scores and ids of whole texts."""
        ids: list[np.ndarray] = []
        group, size = [], 0
        for text in texts:
            group.append(marked(text))
            size += len(group[-1])
            if size > 1 << 18:
                ids += self.encode_marked(group)
                group, size = [], 0
        ids += self.encode_marked(group)
        return [int(self.score_of[x].sum()) for x in ids], ids

    def decode(self, ids: list[int]) -> str:
        """The text of a whole document's ids."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")[1:]

    def decoded_crc32(self, ids: np.ndarray) -> int:
        """CRC-32 of the decoded text's UTF-8 bytes, from slices of the ids: no text as long as the document's is built.
        For ids that spell valid UTF-8, as all encodings do."""
        crc, first = 0, True
        for at in range(0, len(ids), _DECODED_AT_ONCE):
            part = b"".join(map(self.bytes_of.__getitem__, ids[at:at + _DECODED_AT_ONCE].tolist())).replace(_MARK_BYTES, b" ")
            crc, first = zlib.crc32(part[1:] if first else part, crc), False
        return crc


class Chunk:
    """One chunk of a giant text: ``size`` characters of ``s``, the rest is what pieces may reach into."""

    def __init__(self, model: PieceModel, s: str, size: int):
        self.model, self.size = model, size
        # a cut is where a unit begins; position 0 is left to the states, for a unit may have begun before it
        cuts = [m.start() for m in model.unit_re.finditer(s) if 0 < m.start() <= size]
        self.cut, self.whole = bool(cuts), s
        if cuts:
            first, self.last = cuts[0], cuts[-1]
            self.head, self.middle, self.tail = s[:first], s[first:self.last], s[self.last:]

    def transfer(self) -> np.ndarray:
        """The boundary-state transfer matrix."""
        states = self.model.longest
        if not self.cut:
            rows = [_padded(self.model.search(self.whole, self.size, [NONE] * i + [0])[0][self.size:], states) if i <= self.size else _padded([], states) for i in range(states)]
            return np.stack(rows)
        first = len(self.head)
        head = np.array([self.model.search(self.head, first, [NONE] * i + [0])[0][first] if i <= first else NONE for i in range(states)], np.int64)
        middle = int(self.model.score_of[self.model.encode_marked([self.middle])[0]].sum())
        tail = _padded(self.model.search(self.tail, self.size - self.last, [0])[0][self.size - self.last:], states)
        both = np.where((head[:, None] > NONE) & (tail[None, :] > NONE), head[:, None] + middle + tail[None, :], NONE)
        return both

    def origins(self, entry: list[int]) -> list[int]:
        """For each exit state the entry state its best path comes from (-1: no path)."""
        states = self.model.longest
        if self.cut:
            first = len(self.head)
            _, back = self.model.search(self.head, first, entry[:first + 1])
            return [self.model.trace(self.head, back, first)[0]] * states
        best, back = self.model.search(self.whole, self.size, entry[:self.size + 1])
        out = []
        for end in range(self.size, self.size + states):
            if end >= len(best) or best[end] <= NONE:
                out.append(-1)
                continue
            while back[end] >= 0:
                end = back[end]
            out.append(end)
        return out

    def ids(self, entry: list[int], leave: int) -> np.ndarray:
        """The ids of the pieces that start in the chunk, on the best path that leaves at ``leave``."""
        if not self.cut:
            _, back = self.model.search(self.whole, self.size, entry[:self.size + 1])
            return np.array(self.model.trace(self.whole, back, self.size + leave)[1], "<i4")
        first = len(self.head)
        _, back = self.model.search(self.head, first, entry[:first + 1])
        head = self.model.trace(self.head, back, first)[1]
        _, back = self.model.search(self.tail, self.size - self.last, [0])
        tail = self.model.trace(self.tail, back, self.size - self.last + leave)[1]
        return np.concatenate([np.array(head, "<i4"), self.model.encode_marked([self.middle])[0], np.array(tail, "<i4")])


def marked(text: str | None) -> str:
    """The searched form: spaces as marks, one mark before the text."""
    return MARK + text.replace(" ", MARK) if text else ""


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product in the (max, +) semiring."""
    return np.maximum((a[:, :, None] + b[None, :, :]).max(axis=1), NONE)


def product(matrices: np.ndarray) -> np.ndarray:
    """The transfer matrix of neighbouring chunks taken together."""
    out = matrices[0]
    for m in matrices[1:]:
        out = max_plus(out, m)
    return out


def entry_vectors(matrices: np.ndarray, entry: np.ndarray | None = None) -> np.ndarray:
    """For each chunk (or block of chunks) the scores of its entry states, from those of the first
    (default: a text's start)."""
    states = matrices.shape[1]
    vector = np.where(np.arange(states) == 0, 0, NONE)[None, :] if entry is None else entry[None, :]
    out = np.empty((len(matrices), states), np.int64)
    for k, m in enumerate(matrices):
        out[k] = vector[0]
        vector = max_plus(vector, m)
    return out


def joined_origins(origins: np.ndarray) -> np.ndarray:
    """The entry state of the first of some neighbouring chunks for each exit state of the last (-1: no path)."""
    out = origins[-1]
    for origin in origins[-2::-1]:
        out = np.where(out >= 0, origin[out], -1)
    return out


def exit_states(origins: np.ndarray, leave: int = 0) -> list[int]:
    """The exit state of each chunk (or block of chunks) on the path that leaves the last one at ``leave``."""
    out = []
    for origin in origins[::-1]:
        out.append(leave)
        leave = int(origin[leave])
    return out[::-1]


def _padded(scores: list[int], states: int) -> np.ndarray:
    row = np.full(states, NONE, np.int64)
    row[:min(states, len(scores))] = scores[:states]
    return row


def _lists(ids: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, "<i4"), *ids])))


def _giants(parts: DataFrame, model, chunk_chars: int, work: str) -> DataFrame:
    """(uid, text) -> (uid, ids, n_chunks) by the scan."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longest = PieceModel(model.value).longest
        for batch in batches:
            for uid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = marked(text)
                edges = [*range(0, max(1, len(s) - longest), chunk_chars), len(s)]
                spans = list(zip(edges, edges[1:]))
                yield pa.RecordBatch.from_pydict({
                    "uid": [uid] * len(spans), "k": list(range(len(spans))), "size": [b - a for a, b in spans], "s": [s[a:b + longest - 1] for a, b in spans]}, schema=rows)

    rows = pa.schema([("uid", pa.int64()), ("k", pa.int64()), ("size", pa.int64()), ("s", pa.string())])
    pieces = written(parts.mapInArrow(split, "uid bigint, k bigint, size bigint, s string"), f"{work}/chunks")
    # few bytes but much work per row: dealt by count, not by size
    spark = parts.sparkSession
    dealt = max(2 * spark.sparkContext.defaultParallelism, pieces.count() // 64)

    def transfer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = PieceModel(model.value)
        for pdf in batches:
            out = [Chunk(m, s, size).transfer().tobytes() for s, size in zip(pdf["s"], pdf["size"], strict=True)]
            yield pd.DataFrame({"uid": pdf["uid"], "k": pdf["k"], "matrix": out})

    block = F.floor(F.col("k") / _BLOCK).alias("block")
    matrices = written(pieces.repartition(dealt, "uid", "k").mapInPandas(transfer, "uid bigint, k bigint, matrix binary").select("uid", "k", block, "matrix"), f"{work}/matrices")

    def stacked(pdf: pd.DataFrame) -> np.ndarray:
        states = int((len(pdf["matrix"].iloc[0]) // 8) ** 0.5)
        return np.stack([np.frombuffer(b, np.int64).reshape(states, states) for b in pdf["matrix"]])

    def multiply(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        return pd.DataFrame({"uid": pdf["uid"].iloc[:1], "block": pdf["block"].iloc[:1], "matrix": [product(stacked(pdf)).tobytes()]})

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        return pd.DataFrame({"uid": pdf["uid"], "block": pdf["block"], "entry": list(entry_vectors(stacked(pdf)))})

    def apply(pdf: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        return pd.DataFrame({"uid": pdf["uid"], "k": pdf["k"], "entry": list(entry_vectors(stacked(pdf), np.asarray(entry["entry"].iloc[0])))})

    # blocks are multiplied apart, a scan passes over their products (at most some 4,000 for a text of 2 GB), and
    # each block's own chunks follow from its entry, apart again
    products = matrices.groupBy("uid", "block").applyInPandas(multiply, "uid bigint, block bigint, matrix binary")
    block_entries = products.groupBy("uid").applyInPandas(scan, "uid bigint, block bigint, entry array<bigint>")
    entries = written(matrices.groupBy("uid", "block").cogroup(block_entries.groupBy("uid", "block")).applyInPandas(apply, "uid bigint, k bigint, entry array<bigint>"), f"{work}/entries")
    ready = pieces.join(entries, ["uid", "k"])

    def origins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = PieceModel(model.value)
        for pdf in batches:
            out = [Chunk(m, s, size).origins([int(x) for x in entry]) for s, size, entry in zip(pdf["s"], pdf["size"], pdf["entry"], strict=True)]
            yield pd.DataFrame({"uid": pdf["uid"], "k": pdf["k"], "origin": out})

    # the maps from exit to entry states compose in the same three steps, from the end
    came = written(ready.mapInPandas(origins, "uid bigint, k bigint, origin array<bigint>").select("uid", "k", block, "origin"), f"{work}/origins")

    def join_block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        return pd.DataFrame({"uid": pdf["uid"].iloc[:1], "block": pdf["block"].iloc[:1], "origin": [joined_origins(np.stack(pdf["origin"]))]})

    def leave_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        return pd.DataFrame({"uid": pdf["uid"], "block": pdf["block"], "leave": exit_states(np.stack(pdf["origin"]))})  # the last piece ends with the text

    def leave_chunks(pdf: pd.DataFrame, leave: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        return pd.DataFrame({"uid": pdf["uid"], "k": pdf["k"], "leave": exit_states(np.stack(pdf["origin"]), int(leave["leave"].iloc[0]))})

    block_leaves = (came.groupBy("uid", "block").applyInPandas(join_block, "uid bigint, block bigint, origin array<bigint>")
                    .groupBy("uid").applyInPandas(leave_blocks, "uid bigint, block bigint, leave bigint"))
    leaves = written(came.groupBy("uid", "block").cogroup(block_leaves.groupBy("uid", "block")).applyInPandas(leave_chunks, "uid bigint, k bigint, leave bigint"), f"{work}/leaves")

    def trace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = PieceModel(model.value)
        for pdf in batches:
            ids = [Chunk(m, s, size).ids([int(x) for x in entry], leave) for s, size, entry, leave in zip(pdf["s"], pdf["size"], pdf["entry"], pdf["leave"], strict=True)]
            yield pd.DataFrame({"uid": pdf["uid"], "k": pdf["k"], "ids": ids})

    traced = ready.join(leaves, ["uid", "k"]).repartition(dealt, "uid", "k").mapInPandas(trace, "uid bigint, k bigint, ids array<int>")
    whole = traced.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("parts"))
    return whole.select("uid", F.flatten("parts.ids").alias("ids"), F.size("parts").cast("bigint").alias("n_chunks"))


def encode_documents(docs: DataFrame, text_col: str = "text", carry: dict[str, Column] | None = None, model: bytes | None = None,
                     giant_chars: int = 65_536, chunk_chars: int = 8_192, decode: bool = False) -> DataFrame:
    """The carried columns, ``score`` (in 1/1024), ``ids array<int>`` and ``n_chunks``, one row per input row. With
    ``decode`` also ``decoded_crc32``, the CRC-32 of the text that the finished ids decode to: the task that has the ids
    decodes them, so checking a round trip needs no second pass over them and no second worker."""
    carry = carry if carry is not None else {"doc_id": docs["doc_id"]}
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(scored_model(model or default_model()))  # one model file: a fixed size
    base = docs.select(F.struct(*(c.alias(n) for n, c in carry.items()), F.lit(0).alias("_")).alias("carried"), docs[text_col].alias("text"))
    length = F.coalesce(F.length("text"), F.lit(0))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = PieceModel(shared.value)
        for batch in batches:
            scores, ids = m.encode(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.int64()), _lists(ids), pa.array([1] * len(ids), pa.int64()), *decoded(m, ids)],
                                             names=names)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = PieceModel(shared.value)
        for batch in batches:
            ids = [x.values.to_numpy() for x in batch.column(2)]
            found = [int(m.score_of[x].sum()) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64()), *batch.columns[2:], *decoded(m, ids)], names=names)

    def decoded(m: PieceModel, ids: list[np.ndarray]) -> list[pa.Array]:
        return [pa.array([m.decoded_crc32(x) for x in ids], pa.int64())] if decode else []

    made = ["score", "ids", "n_chunks"] + ["decoded_crc32"] * decode
    names = ["carried", *made]
    schema = T.StructType([base.schema["carried"], T.StructField("score", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())),
                           T.StructField("n_chunks", T.LongType()), *[T.StructField("decoded_crc32", T.LongType())] * decode])
    encoded = base.filter(length <= giant_chars).mapInArrow(whole, schema)
    work = work_dir(spark, "pieces")
    giants = written(base.filter(length > giant_chars).withColumn("uid", F.monotonically_increasing_id()), f"{work}/giants")
    if not giants.isEmpty():
        done = written(_giants(giants.select("uid", "text"), shared, chunk_chars, work), f"{work}/encoded")
        joined = giants.select("uid", "carried").join(done, "uid").select("carried", F.lit(0).cast("bigint").alias("score"), "ids", "n_chunks")
        encoded = encoded.unionAll(joined.mapInArrow(scores, schema))
    return encoded.select(*(F.col(f"carried.`{n}`").alias(n) for n in carry), *made)


def decode_documents(encoded: DataFrame, ids_col: str = "ids", model: bytes | None = None, out_col: str = "decoded") -> DataFrame:
    """Append the text of each row's ids."""
    shared = encoded.sparkSession.sparkContext.broadcast(scored_model(model or default_model()))
    at = encoded.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = PieceModel(shared.value)
        for batch in batches:
            texts = [m.decode(x.as_py() or []) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out_col])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField(out_col, T.StringType())]))
