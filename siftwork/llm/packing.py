"""Operator 13, packing: vector bin packing of tokenised examples by the dot-product heuristic.

A sequence has three limits at once: tokens, segments (pieces) and loss-bearing tokens. The
open sequence takes, among all pooled examples that fit in every dimension, the one whose
demand has the largest weighted dot product with what the sequence has left,
sum(weight_i * demand_i * left_i), demands and rests being shares of the limits and weight_i
the pool's mean demand in dimension i. When nothing fits whole and examples may be cut, the
longest example gives a prefix that fills the gap and its rest returns to the pool.

A sequence is stored at ``max_tokens``, padded, unless its length is a power of two, which is
stored as it is. With cuts allowed, a sequence that can't be filled (a limit on segments or
loss binds, or the pool is empty) gives tokens back down to the next power of two, so
nothing is padded.

``pack`` runs inside the tasks that read the examples: each partition keeps a pool of at most
``pool`` examples (and ``pool_tokens`` tokens), closes sequences while the pool is full, and
empties it at its end. No row is shuffled, no task holds more than its pool, and a lost
task packs its own partition again. Sequence ids carry the partition's number in the upper bits.

Defined results: a null or empty text is its end id alone, one piece; an example without ids
gives no piece; null ids of documents are kept; repeated rows are packed one by one; loss
spans that overlap or leave the example count each position once, null spans mean
that every position bears loss; an example over a limit is cut even when ``cut`` is false (it can't
be stored otherwise), at the limit; other columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.llm.common import per_worker
from siftwork.llm.words import ByteLevel

_TAKEN = np.iinfo(np.int64).max
_BATCH_IDS = 1 << 20


def default_tokenizer() -> bytes:
    import public_tokenizers
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        return f.read()


# ---- examples ---------------------------------------------------------------------------

def tokenised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: bytes | None = None, end_id: int = 1) -> DataFrame:
    """(doc_id, ids, loss) for every row: ids (little-endian unsigned 32-bit) of the whole text and the
    end id, as binary; every id but the first bears loss."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer or default_tokenizer())  # one vocabulary file: a fixed size
    keyed = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    schema = f"doc_id {keyed.schema['doc_id'].dataType.simpleString()}, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, end = per_worker(shared, "byte-level", ByteLevel), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            lengths = np.array([len(t) for t in batch.column(1).to_pylist()], np.int64)
            part = (np.cumsum(lengths) // (1 << 18)).tolist()
            at = 0
            while at < len(part):  # about 256 K characters at a time
                to = at + part[at:].count(part[at])
                texts = batch.column(1).slice(at, to - at).to_pylist()
                ids = [x.astype("<u4").tobytes() + end for x in known.encode(texts)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array(ids, pa.binary())], names=["doc_id", "ids"])
                at = to

    loss = F.array(F.struct(F.lit(1).cast("bigint").alias("start"), (F.octet_length("ids") / 4).cast("bigint").alias("end")))
    return keyed.mapInArrow(run, schema).withColumn("loss", loss)


# ---- one pool ---------------------------------------------------------------------------

class Example:
    """What is left of one example: ids from ``start`` on, and where loss lies."""

    __slots__ = ("key", "ids", "start", "total", "spans")

    def __init__(self, key, ids: np.ndarray, start: int, total: int, spans: list[tuple[int, int]]):
        self.key, self.ids, self.start, self.total, self.spans = key, ids, start, total, spans

    def loss(self, n: int) -> int:
        """Loss-bearing ids among the next n."""
        a, b = self.start, self.start + n
        return sum(max(0, min(b, e) - max(a, s)) for s, e in self.spans)

    def prefix(self, n: int, loss: int) -> int:
        """The longest prefix of at most n ids and at most ``loss`` loss-bearing ones."""
        at, end = self.start, self.start + min(n, len(self.ids))
        for s, e in self.spans:
            s, e = max(s, at), min(e, end)
            if s >= e:
                continue
            if e - s > loss:
                return s + loss - self.start
            loss -= e - s
        return end - self.start

    def cut(self, n: int) -> tuple[Example, Example | None]:
        """The first n ids and the rest, if any."""
        rest = Example(self.key, self.ids[n:], self.start + n, self.total, self.spans) if n < len(self.ids) else None
        return Example(self.key, self.ids[:n], self.start, self.total, self.spans), rest


def clean_spans(spans, n: int) -> list[tuple[int, int]]:
    """Sorted, disjoint, inside the example; None: all of it."""
    if spans is None:
        return [(0, n)]
    out: list[tuple[int, int]] = []
    for s, e in sorted((max(0, s["start"] or 0), n if s["end"] is None else min(n, s["end"])) for s in spans if s):
        if e <= s:
            continue
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


class Pool:
    """Open examples of one partition, and the sequences made of them."""

    def __init__(self, max_tokens: int, max_segments: int, max_loss: int, cut: bool):
        if min(max_tokens, max_segments, max_loss) < 1:
            raise ValueError("limits must be at least 1")
        self.limits, self.may_cut = (max_tokens, max_segments, max_loss), cut
        self.items: list[Example | None] = []
        self.n, self.loss = np.empty(64, np.int64), np.empty(64, np.int64)
        self.live, self.tokens, self.losses = 0, 0, 0

    def add(self, item: Example) -> None:
        k = len(self.items)
        if k == len(self.n):
            if self.live < k // 2:
                self._compact()
                k = len(self.items)
            else:
                self.n, self.loss = (np.concatenate([x, np.empty(k, np.int64)]) for x in (self.n, self.loss))
        self.items.append(item)
        self.n[k], self.loss[k] = len(item.ids), item.loss(len(item.ids))
        self.live, self.tokens, self.losses = self.live + 1, self.tokens + len(item.ids), self.losses + int(self.loss[k])

    def _compact(self) -> None:
        keep = [k for k, x in enumerate(self.items) if x is not None]
        self.n[:len(keep)], self.loss[:len(keep)] = self.n[keep], self.loss[keep]
        self.items = [self.items[k] for k in keep]

    def _take(self, k: int) -> Example:
        item, self.items[k] = self.items[k], None
        self.live, self.tokens, self.losses = self.live - 1, self.tokens - int(self.n[k]), self.losses - int(self.loss[k])
        self.n[k] = _TAKEN
        return item

    def _best(self, left: list[int]) -> int | None:
        """The example that fits and has the largest dot product with the rest of the sequence."""
        n, loss = self.n[:len(self.items)], self.loss[:len(self.items)]
        fits = (n <= left[0]) & (loss <= left[2])
        if left[1] < 1 or not fits.any():
            return None
        t, s, m = self.limits
        weights = self.tokens / t / self.live, 1 / s, self.losses / m / self.live
        score = n * (weights[0] / t * left[0] / t) + loss * (weights[2] / m * left[2] / m) + weights[1] / s * left[1] / s
        return int(np.where(fits, score, -1.0).argmax())

    def _prefix(self, left: list[int]) -> tuple[int, int] | None:
        """(example, ids) of the prefix that fills the gap best, longest example first."""
        if left[1] < 1 or left[0] < 1:
            return None
        n, best = self.n[:len(self.items)], None
        for k in np.argsort(np.where(n == _TAKEN, -1, n), kind="stable")[::-1]:
            if n[k] == _TAKEN:
                break
            got = self.items[k].prefix(left[0], left[2])
            if got == left[0]:
                return int(k), got
            if got and (best is None or got > best[1]):
                best = int(k), got
        return best

    def sequence(self) -> list[Example]:
        """Close one sequence."""
        left, out = list(self.limits), []

        def place(item: Example) -> None:
            out.append(item)
            left[0], left[1], left[2] = left[0] - len(item.ids), left[1] - 1, left[2] - item.loss(len(item.ids))

        while left[0] and self.live and (k := self._best(left)) is not None:
            place(self._take(k))
        while self.live and (self.may_cut or not out) and (found := self._prefix(left)):
            head, rest = self._take(found[0]).cut(found[1])
            place(head)
            if rest:
                self.add(rest)
        if self.may_cut and left[0]:
            over = self.limits[0] - left[0]
            over -= 1 << (over.bit_length() - 1)
            while over:
                item = out.pop()
                if over < len(item.ids):
                    head, rest = item.cut(len(item.ids) - over)
                    out.append(head)
                    self.add(rest)
                    break
                over -= len(item.ids)
                self.add(item)
        return out


def stored_length(n: int, max_tokens: int) -> int:
    """A sequence's length with its padding."""
    return n if n & (n - 1) == 0 else max_tokens


# ---- Spark ------------------------------------------------------------------------------

def pack(examples: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", loss_col: str | None = "loss", max_tokens: int = 2048, max_segments: int = 128,
         max_loss: int = 2048, cut: bool = True, pool: int = 4096, pool_tokens: int = 4 << 20) -> DataFrame:
    """Examples (ids as little-endian unsigned 32-bit binary; loss as array<struct<start, end>>) ->
    (doc_id, start, length, doc_tokens, sequence_id, offset, stored, loss_tokens, ids) for every piece."""
    loss = F.lit(None).cast("array<struct<start:bigint,end:bigint>>") if loss_col is None else examples[loss_col].cast("array<struct<start:bigint,end:bigint>>")
    rows = examples.select(examples[id_col].alias("doc_id"), examples[ids_col].alias("ids"), loss.alias("loss"))
    id_type = rows.schema["doc_id"].dataType
    schema = f"doc_id {id_type.simpleString()}, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, stored bigint, loss_tokens bigint, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        open_pool, number, rows, held, key_type = Pool(max_tokens, max_segments, max_loss, cut), TaskContext.get().partitionId() << 36, [], 0, None

        def close(pieces: list[Example]) -> None:
            nonlocal number, held
            offset, stored = 0, stored_length(sum(len(p.ids) for p in pieces), max_tokens)
            for p in pieces:
                rows.append((p.key, p.start, len(p.ids), p.total, number, offset, stored, p.loss(len(p.ids)), p.ids.tobytes()))
                offset += len(p.ids)
            number, held = number + 1, held + offset

        def flush() -> pa.RecordBatch:
            nonlocal held
            columns = list(zip(*rows, strict=True))
            rows.clear()
            held = 0
            arrays = [pa.array(columns[0], key_type), *(pa.array(c, pa.int64()) for c in columns[1:8]), pa.array(columns[8], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "stored", "loss_tokens", "ids"])

        for batch in batches:
            key_type = batch.column(0).type
            for k in range(batch.num_rows):
                raw = batch.column(1)[k].as_py()
                if not raw:
                    continue
                ids = np.frombuffer(raw, "<u4")
                item = Example(batch.column(0)[k].as_py(), ids, 0, len(ids), clean_spans(batch.column(2)[k].as_py(), len(ids)))
                while item and len(item.ids) >= max_tokens and item.prefix(max_tokens, max_loss) == max_tokens:
                    full, item = item.cut(max_tokens)
                    close([full])
                    if held >= _BATCH_IDS:
                        yield flush()
                if item:
                    item.ids = item.ids.copy()  # lets go of a long example
                    open_pool.add(item)
                while open_pool.live > pool or open_pool.live > 1 and open_pool.tokens > pool_tokens:
                    close(open_pool.sequence())
                if held >= _BATCH_IDS:
                    yield flush()
        while open_pool.live:
            close(open_pool.sequence())
            if held >= _BATCH_IDS:
                yield flush()
        if rows:
            yield flush()

    return rows.mapInArrow(run, schema)
