"""Operator 12, cross-tokenizer alignment: an associative monoid of fragments over byte ranges.

Both tokenizers cut the same bytes (a space and the text). Offsets where both end a token cut the
document into groups; tokens of the two that share a group are linked.

A byte range of a document yields a ``Fragment`` of the tokens that end in it: an open prefix (up to
the first common end), closed groups, and an open suffix (after the last). Two neighbouring
fragments compose: the left suffix and the right prefix are one closed group, and a fragment
without a common end only lengthens what is open. Composition is associative, so the fragments of a
long document are made by separate tasks and composed by a tree of Spark jobs, ``_FAN`` at a
time; each level passes on one fragment of open ends and emits the groups it closed. Texts of at most
``chunk_chars`` characters are one range: their fragment is closed where it is made, many texts at once in numpy.

Ranges end anywhere, also inside words and tokens. A task tokenises its range out to the next cuts
(``slices``: no tokenizer of these kinds joins across) and keeps the tokens that end inside.

Pair counts: tasks count, per batch of texts, in how many documents of the batch a pair of ids is
linked; Spark adds these up and finds every A id's highest count. The counts of a batch's
pairs then return to the batch's packed links, so that neither the texts nor single links are shuffled.

Defined results: null and empty texts, and texts whose joined tokens are not the bytes of space and
text (a U+2581 in it, say), have no tokens: zeros and the empty string, and count in no pair; rows
that repeat an id, and null ids, are documents of their own; other columns are ignored; an empty table
gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwork.llm.common import per_worker, work_dir, written
from siftwork.llm.slices import cut_after, cut_before
from siftwork.llm.words import ByteLevel

_FAN = 16
_BATCH_CHARS = 2 << 20   # texts aligned at once
_ENCODE_CHARS = 1 << 18  # texts handed to a tokenizer at once
_CONTEXT = 4096          # a range's end may lie inside a stretch without cuts of at most this length
_WIDE_LINKS = 1 << 16    # groups with more links count pairs of distinct ids instead of listing links
_SHIFT = 32


def default_tokenizers() -> tuple[bytes, bytes]:
    import public_tokenizers
    return tuple(open(public_tokenizers.path(name), "rb").read() for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


# ---- tokenizers -------------------------------------------------------------------------

class Pair:
    """Both tokenizers with the bytes of their ids."""

    def __init__(self, a: bytes, b: bytes):
        from sentencepiece import SentencePieceProcessor
        self.a, self.b = ByteLevel(a, plain=True), SentencePieceProcessor(model_proto=b)
        self.bytes_a = self.a.bytes
        self.bytes_b = []
        for k in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(k)
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(k) else piece.replace("▁", " ").encode("utf-8"))
        self.size_a, self.size_b = (np.array([len(x) for x in table], np.int64) for table in (self.bytes_a, self.bytes_b))
        # written ids: followed by the next id of the side, by the other side, by the next group
        self.n_a, self.n_b = len(self.bytes_a), len(self.bytes_b)
        self.words = [b"%d," % k for k in range(self.n_a)] + [b"%d|" % k for k in range(self.n_a)] + [b"%d," % k for k in range(self.n_b)] + [b"%d;" % k for k in range(self.n_b)]

    def encode(self, spaced: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids (A, B) of texts that begin with their added space; None where the bytes differ."""
        out = []
        at = 0
        while at < len(spaced):
            to, size = at, 0
            while to < len(spaced) and (to == at or size + len(spaced[to]) <= _ENCODE_CHARS):
                size += len(spaced[to])
                to += 1
            part = spaced[at:to]
            both = zip(self.a.encode(part), self.b.encode([t[1:] for t in part], num_threads=1), strict=True)
            for text, (a, b) in zip(part, both, strict=True):
                raw = text.encode("utf-8")
                same = b"".join(map(self.bytes_a.__getitem__, a.tolist())) == raw == b"".join(map(self.bytes_b.__getitem__, b))
                out.append((a.astype(np.int64), np.array(b, np.int64)) if same else None)
            at = to
        return out


# ---- groups -----------------------------------------------------------------------------

@dataclass
class Groups:
    """Closed groups in a row: ids of both sides, and each id's group."""

    a: np.ndarray
    b: np.ndarray
    of_a: np.ndarray
    of_b: np.ndarray
    n: int

    def sizes(self) -> tuple[np.ndarray, np.ndarray]:
        return np.bincount(self.of_a, minlength=self.n), np.bincount(self.of_b, minlength=self.n)

    def written(self, pair: Pair) -> tuple[np.ndarray, np.ndarray]:
        """(places in ``pair.words``, end of each group among them): a1,a2|b1;a3|b2,b3;"""
        in_a, in_b = self.sizes()
        out = np.empty(len(self.a) + len(self.b), np.int64)
        before_b, before_a = np.cumsum(in_b) - in_b, np.cumsum(in_a)
        last_a, last_b = (np.append(x[1:] != x[:-1], True) if len(x) else np.empty(0, bool) for x in (self.of_a, self.of_b))
        out[np.arange(len(self.a)) + before_b[self.of_a]] = self.a + pair.n_a * last_a
        out[np.arange(len(self.b)) + before_a[self.of_b]] = self.b + 2 * pair.n_a + pair.n_b * last_b
        return out, np.cumsum(in_a + in_b)

    def links(self, owner: np.ndarray, whole: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per distinct (owner of the group, pair): (sorted distinct pairs, places among them, times, owner)."""
        in_a, in_b = self.sizes()
        first_a, first_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        wide = in_a * in_b > _WIDE_LINKS
        fan = np.where(wide, 0, in_b)[self.of_a]
        start = np.cumsum(fan) - fan
        b_at = np.arange(int(fan.sum())) - np.repeat(start - first_b[self.of_a], fan)
        keys, owners = [np.repeat(self.a, fan) << _SHIFT | self.b[b_at]], [np.repeat(owner[self.of_a], fan)]
        times = [np.ones(len(keys[0]), np.int64)]
        for g in np.flatnonzero(wide).tolist():
            a, n_a = np.unique(self.a[first_a[g]:first_a[g] + in_a[g]], return_counts=True)
            b, n_b = np.unique(self.b[first_b[g]:first_b[g] + in_b[g]], return_counts=True)
            keys.append((a[:, None] << _SHIFT | b[None, :]).ravel())
            times.append((n_a[:, None] * n_b[None, :]).ravel())
            owners.append(np.full(len(keys[-1]), owner[g]))
        pairs, place = np.unique(np.concatenate(keys), return_inverse=True)
        if len(pairs) * max(1, whole) >= 1 << 62:
            raise ValueError("too many owners at once")
        code, inverse = np.unique(np.concatenate(owners) * len(pairs) + place, return_inverse=True)
        counted = np.bincount(inverse, np.concatenate(times), len(code)).astype(np.int64) if len(keys) > 1 else np.bincount(inverse, minlength=len(code))
        return pairs, code % max(1, len(pairs)), counted, code // max(1, len(pairs))


def aligned(a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[Groups, np.ndarray]:
    """Groups of two token runs that cover the same bytes, and the groups' ends."""
    top = int(max(ends_a[-1:].max(initial=0), ends_b[-1:].max(initial=0))) + 1
    mark = np.zeros(top, bool)
    mark[ends_b] = True
    cut_a = mark[ends_a]
    cuts = ends_a[cut_a]
    mark[ends_b] = False
    mark[cuts] = True
    cut_b = mark[ends_b]
    return Groups(a, b, np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b, len(cuts)), cuts


# ---- the monoid -------------------------------------------------------------------------

@dataclass
class Fragment:
    """Tokens that end in one byte range. ``cut`` is the first common end, None without one; then all is in
    ``prefix``. Open ends are (A ids, B ids)."""

    cut: int | None = None
    prefix: tuple[list[int], list[int]] = field(default_factory=lambda: ([], []))
    suffix: tuple[list[int], list[int]] = field(default_factory=lambda: ([], []))


def _joined(x, y):
    return x[0] + y[0], x[1] + y[1]


def compose(left: Fragment, right: Fragment) -> tuple[Fragment, tuple[int, tuple[list[int], list[int]]] | None]:
    """The fragment of both ranges, and the group that this closes: (its end, its ids)."""
    if left.cut is None:
        return Fragment(right.cut, _joined(left.prefix, right.prefix), right.suffix), None
    if right.cut is None:
        return Fragment(left.cut, left.prefix, _joined(left.suffix, right.prefix)), None
    return Fragment(left.cut, left.prefix, right.suffix), (right.cut, _joined(left.suffix, right.prefix))


def fragment(a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[Fragment, Groups | None]:
    """The fragment of the tokens that end in one range, and its closed groups."""
    cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
    if not len(cuts):
        return Fragment(None, (a.tolist(), b.tolist())), None
    i, j = (np.searchsorted(e, cuts[0], "right") for e in (ends_a, ends_b))
    p, q = (np.searchsorted(e, cuts[-1], "right") for e in (ends_a, ends_b))
    found = Fragment(int(cuts[0]), (a[:i].tolist(), b[:j].tolist()), (a[p:].tolist(), b[q:].tolist()))
    if len(cuts) == 1:
        return found, None
    base = int(cuts[0])
    return found, aligned(a[i:p], b[j:q], ends_a[i:p] - base, ends_b[j:q] - base)[0]


def ranges(spaced: str, size: int) -> list[tuple[int, int, int, int]]:
    """Byte ranges of about ``size`` characters, as characters: (range, window to tokenise)."""
    marks, at = [(0, 0, 0)], size
    while at < len(spaced):
        before, after = cut_before(spaced, at), cut_after(spaced, at)
        if after - before > _CONTEXT:
            at = before = after
        if after >= len(spaced):
            break
        marks.append((at, before, after))
        at += size
    marks.append((len(spaced),) * 3)
    return [(x[0], y[0], x[1], y[2]) for x, y in zip(marks, marks[1:], strict=False)]


# ---- Spark ------------------------------------------------------------------------------

_CLOSED = "n_groups bigint, n_links bigint, written binary, pairs array<bigint>, times array<bigint>"
_FRAGMENT = f"uid bigint, k bigint, cut bigint, at bigint, prefix_a array<bigint>, prefix_b array<bigint>, suffix_a array<bigint>, suffix_b array<bigint>, {_CLOSED}"


def _closed_columns(groups: Groups | None, pair: Pair) -> dict:
    if groups is None or not groups.n:
        return {"n_groups": 0, "n_links": 0, "written": b"", "pairs": [], "times": []}
    places, _ = groups.written(pair)
    keys, _, times, _ = groups.links(np.zeros(groups.n, np.int64), 1)
    return {"n_groups": groups.n, "n_links": int(times.sum()), "written": b"".join(map(pair.words.__getitem__, places.tolist())),
            "pairs": keys.tolist(), "times": times.tolist()}


def _one_group(ids: tuple[list[int], list[int]]) -> Groups:
    a, b = (np.array(x, np.int64) for x in ids)
    return Groups(a, b, np.zeros(len(a), np.int64), np.zeros(len(b), np.int64), 1)


def _batches_of(batches: Iterator[pa.RecordBatch], id_type: pa.DataType, most: int):
    """(ids as an array, texts) of about ``most`` characters."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for k, text in enumerate(batch.column(1).to_pylist()):
            if texts and size + len(text) > most:
                yield pa.array(ids, id_type), texts
                ids, texts, size = [], [], 0
            ids.append(batch.column(0)[k].as_py())
            texts.append(text)
            size += len(text) + 64
    if texts:
        yield pa.array(ids, id_type), texts


def _narrow(x: np.ndarray) -> np.ndarray:
    top = int(x.max(initial=0))
    return x.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8")


def _short(keyed: DataFrame, shared) -> DataFrame:
    """One row per batch of texts: per-document sums, packed links, and the batch's pairs with document counts."""
    id_type = keyed.schema["doc_id"].dataType.simpleString()
    schema = (f"batch bigint, doc_id array<{id_type}>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, digest array<string>, "
              "ends array<bigint>, places binary, times binary, widths array<bigint>, pairs array<bigint>, documents array<bigint>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        number, pair, key = TaskContext.get().partitionId() << 36, None, None
        first = next(iter_ := iter(batches), None)
        if first is None:
            return
        key, pair = first.column(0).type, per_worker(shared, "alignment", lambda files: Pair(*files))

        def chained():
            yield first
            yield from iter_

        for ids, texts in _batches_of(chained(), key, _BATCH_CHARS):
            found = pair.encode([" " + t for t in texts])
            there = [k for k, x in enumerate(found) if x and texts[k]]
            n_docs = len(texts)
            a = np.concatenate([found[k][0] for k in there] or [np.empty(0, np.int64)])
            b = np.concatenate([found[k][1] for k in there] or [np.empty(0, np.int64)])
            groups, cuts = aligned(a, b, np.cumsum(pair.size_a[a]), np.cumsum(pair.size_b[b]))
            doc_ends = np.cumsum([int(pair.size_a[found[k][0]].sum()) for k in there], dtype=np.int64)
            owner = np.array(there, np.int64)[np.searchsorted(doc_ends, cuts)] if there else np.empty(0, np.int64)
            in_a, in_b = groups.sizes()
            keys, places, times, of = groups.links(owner, n_docs)
            written_ids, group_ends = groups.written(pair)
            n_groups = np.bincount(owner, minlength=n_docs)
            last = np.cumsum(n_groups)
            ends = np.where(last > 0, group_ends[np.maximum(last - 1, 0)], 0).tolist() if len(group_ends) else [0] * n_docs
            digest, at, flat = [], 0, written_ids.tolist()
            for n, end in zip(n_groups.tolist(), ends, strict=True):
                digest.append(hashlib.sha256(b"".join(map(pair.words.__getitem__, flat[at:end]))[:-1]).hexdigest() if n else "")
                at = end
            packed = _narrow(places), _narrow(times)
            row = [
                [number], [ids.to_pylist()], *([np.bincount(owner, x, n_docs).astype(np.int64).tolist()] for x in (in_a, in_b)), [n_groups.tolist()],
                [np.bincount(owner, in_a * in_b, n_docs).astype(np.int64).tolist()], [digest], [np.searchsorted(of, np.arange(n_docs), "right").tolist()],
                [packed[0].tobytes()], [packed[1].tobytes()], [[x.itemsize for x in packed]], [keys.tolist()], [np.bincount(places, minlength=len(keys)).tolist()]]
            long, longs = pa.int64(), pa.list_(pa.int64())
            types = [long, pa.list_(key), longs, longs, longs, longs, pa.list_(pa.string()), longs, pa.binary(), pa.binary(), longs, longs, longs]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, types, strict=True)], names=[c.split()[0] for c in schema.split(", ")])
            number += 1

    return keyed.mapInArrow(run, schema)


def _windows(keyed: DataFrame, chunk_chars: int) -> DataFrame:
    """One row per byte range of a long text: (uid, doc_id, k, window, window's first byte, range)."""
    marked = keyed.select("doc_id", "text", F.monotonically_increasing_id().alias("uid"))
    id_type = keyed.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                spaced = " " + batch.column(1)[r].as_py()
                at_char = at_byte = 0
                for k, (lo, hi, begin, end) in enumerate(ranges(spaced, chunk_chars)):
                    lo_byte = at_byte + len(spaced[at_char:lo].encode("utf-8"))
                    hi_byte = lo_byte + len(spaced[lo:hi].encode("utf-8"))
                    begin_byte = lo_byte - len(spaced[begin:lo].encode("utf-8"))
                    at_char, at_byte = hi, hi_byte
                    columns = {"uid": batch.column(2).slice(r, 1), "doc_id": batch.column(0).slice(r, 1), "k": pa.array([k]), "window": pa.array([spaced[begin:end]]),
                               "begin": pa.array([begin_byte]), "lo": pa.array([lo_byte]), "hi": pa.array([hi_byte])}
                    yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return marked.mapInArrow(run, f"uid bigint, doc_id {id_type}, k bigint, window string, begin bigint, lo bigint, hi bigint")


def _fragments(windows: DataFrame, shared) -> DataFrame:
    schema = f"ok boolean, n_a bigint, n_b bigint, {_FRAGMENT}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair = per_worker(shared, "alignment", lambda files: Pair(*files))
            for row in batch.to_pylist():
                found, out = pair.encode([row["window"]])[0], {"ok": False, "n_a": 0, "n_b": 0, "uid": row["uid"], "k": row["k"]}
                piece, groups = Fragment(), None
                if found:
                    a, b = found
                    ends_a, ends_b = row["begin"] + np.cumsum(pair.size_a[a]), row["begin"] + np.cumsum(pair.size_b[b])
                    in_a, in_b = ((e > row["lo"]) & (e <= row["hi"]) for e in (ends_a, ends_b))
                    piece, groups = fragment(a[in_a], b[in_b], ends_a[in_a], ends_b[in_b])
                    out |= {"ok": True, "n_a": int(in_a.sum()), "n_b": int(in_b.sum())}
                out |= _open_columns(piece) | _closed_columns(groups, pair)
                yield pa.RecordBatch.from_pylist([out], schema=types)

    types = _arrow(schema)
    return windows.mapInArrow(run, schema)


def _open_columns(piece: Fragment) -> dict:
    return {"cut": piece.cut, "at": piece.cut, "prefix_a": piece.prefix[0], "prefix_b": piece.prefix[1], "suffix_a": piece.suffix[0], "suffix_b": piece.suffix[1]}


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string
    return to_arrow_schema(_parse_datatype_string(schema))


def _level(pieces: DataFrame, shared, last: bool) -> DataFrame:
    """Compose ``_FAN`` neighbours each: one fragment (group false) and the groups closed (group true)."""
    schema = f"group boolean, {_FRAGMENT}"
    types = _arrow(schema)

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.select(["uid", "k", "cut", "prefix_a", "prefix_b", "suffix_a", "suffix_b"]).to_pylist(), key=lambda r: r["k"])
        uid, k, total, closed = rows[0]["uid"], rows[0]["k"] // _FAN, Fragment(), []
        for r in rows:
            total, group = compose(total, Fragment(r["cut"], (r["prefix_a"], r["prefix_b"]), (r["suffix_a"], r["suffix_b"])))
            if group:
                closed.append(group)
        if last and total.cut is not None:  # the document's start closes the prefix; its end is a common end
            closed.append((total.cut, total.prefix))
        pair = per_worker(shared, "alignment", lambda files: Pair(*files)) if closed else None
        out = [{"group": False, "uid": uid, "k": k} | _open_columns(total) | _closed_columns(None, pair)]
        out += [{"group": True, "uid": uid, "k": k} | _open_columns(Fragment(at)) | _closed_columns(_one_group(ids), pair) for at, ids in closed]
        return pa.Table.from_pylist(out, schema=types)

    return pieces.groupBy("uid", F.expr(f"k div {_FAN}")).applyInArrow(run, schema)


def _digests(closed: DataFrame) -> DataFrame:
    """(uid, digest): the groups of a document in order, hashed as they stream past."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid, digest, tail = None, None, b""
        for batch in batches:
            for k in range(batch.num_rows):
                this = batch.column(0)[k].as_py()
                if this != uid:
                    if uid is not None:
                        digest.update(tail[:-1])
                        yield pa.RecordBatch.from_pydict({"uid": [uid], "digest": [digest.hexdigest()]})
                    uid, digest, tail = this, hashlib.sha256(), b""
                piece = batch.column(1)[k].as_py()
                if piece:
                    digest.update(tail)
                    tail = piece
        if uid is not None:
            digest.update(tail[:-1])
            yield pa.RecordBatch.from_pydict({"uid": [uid], "digest": [digest.hexdigest()]})

    ordered = closed.repartition("uid").sortWithinPartitions("uid", "at", F.col("group").desc()).select("uid", "written")
    return ordered.mapInArrow(run, "uid bigint, digest string")


@dataclass
class Alignment:
    """documents: one row each; pairs: (a, b, documents, best) corpus-wide."""

    documents: DataFrame
    pairs: DataFrame


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizers: tuple[bytes, bytes] | None = None, chunk_chars: int = 1 << 16) -> Alignment:
    """documents: (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row."""
    spark = docs.sparkSession
    work = work_dir(spark, "alignment")
    shared = spark.sparkContext.broadcast(tokenizers or default_tokenizers())  # two vocabulary files: a fixed size
    keyed = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    is_long = F.char_length("text") >= chunk_chars

    short = written(_short(keyed.filter(~is_long), shared), f"{work}/short")
    windows = written(_windows(keyed.filter(is_long), chunk_chars), f"{work}/windows")
    chunks = windows.agg(F.count("*"), F.max("k")).first()
    parts = max(spark.sparkContext.defaultParallelism, chunks[0] // 64)
    made = written(_fragments(windows.repartition(parts, "uid", "k"), shared), f"{work}/fragments")
    names = windows.filter("k = 0").select("uid", "doc_id")
    sums = made.groupBy("uid").agg(F.min("ok").alias("ok"), F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"))
    good = written(sums.join(names, "uid"), f"{work}/long")

    columns = ["uid", "k", "cut", "at", "prefix_a", "prefix_b", "suffix_a", "suffix_b", "n_groups", "n_links", "written", "pairs", "times"]
    closed = made.select(F.lit(False).alias("group"), *columns)
    pieces, most, level = made.select(*columns), (chunks[1] or 0) + 1, 0
    while level == 0 or most > 1:
        most = -(-most // _FAN)
        composed = written(_level(pieces, shared, most == 1), f"{work}/level-{level}")
        closed = closed.unionAll(composed.filter("group").select("group", *columns))
        pieces, level = composed.filter("NOT group").select(*columns), level + 1
    closed = closed.join(good.filter("ok").select("uid"), "uid", "left_semi")

    # pairs of long documents: distinct per document, whatever ranges they come from
    zipped = lambda *c: F.explode(F.arrays_zip(*c))
    long_pairs = written(closed.select("uid", zipped("pairs", "times").alias("x")).groupBy("uid", F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("times")), f"{work}/long-pairs")
    batch_pairs = short.select(zipped("pairs", "documents").alias("x")).select(F.col("x.pairs").alias("pair"), F.col("x.documents").alias("n"))
    counts = batch_pairs.unionAll(long_pairs.select("pair", F.lit(1).cast("bigint").alias("n"))).groupBy("pair").agg(F.sum("n").alias("n"))
    a_id = F.shiftrightunsigned("pair", _SHIFT)
    counted = written(counts.withColumn("best", F.col("n") == F.max("n").over(W.partitionBy(a_id))), f"{work}/pairs")

    schema = f"doc_id {keyed.schema['doc_id'].dataType.simpleString()}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    sent = short.select("batch", F.posexplode("pairs").alias("pos", "pair")).join(counted, "pair").select("batch", "pos", "n", "best")
    kept = short.drop("pairs", "documents")
    kept = kept.toDF(*kept.columns)  # columns of its own: both sides come from one table
    few = kept.groupBy("batch").cogroup(sent.groupBy("batch")).applyInArrow(_settle, schema)

    totals = closed.groupBy("uid").agg(F.sum("n_groups").alias("n_groups"), F.sum("n_links").alias("n_links"))
    scored = (long_pairs.join(counted, "pair").groupBy("uid")
              .agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")))
    long = good.join(totals, "uid", "left").join(scored, "uid", "left").join(_digests(closed), "uid", "left")
    zero = lambda c: F.when(F.col("ok"), F.coalesce(c, F.lit(0))).otherwise(0).cast("bigint").alias(c)
    many = long.select("doc_id", *map(zero, ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")),
                       F.when(F.col("ok"), F.col("digest")).otherwise("").alias("groups_sha256"))
    pairs = counted.select(a_id.alias("a"), F.col("pair").bitwiseAND(F.lit((1 << _SHIFT) - 1)).alias("b"), F.col("n").alias("documents"), "best")
    return Alignment(few.unionAll(many), pairs)


def _settle(batch: pa.Table, counts: pa.Table) -> pa.Table:
    """Per document of a batch: its links summed by their pairs' counts."""
    row = batch.to_pylist()[0]
    n, best = np.zeros(counts.num_rows, np.int64), np.zeros(counts.num_rows, np.int64)
    pos = counts.column("pos").to_numpy()
    n[pos], best[pos] = counts.column("n").to_numpy(), counts.column("best").to_numpy(zero_copy_only=False)
    places, times = (np.frombuffer(row[c], f"<u{w}").astype(np.int64) for c, w in zip(("places", "times"), row["widths"], strict=True))
    ends = np.array(row["ends"], np.int64)
    total = lambda x: (y := np.append(0, np.cumsum(x)))[ends] - y[np.append(0, ends[:-1])]
    out = [batch.column("doc_id").combine_chunks().flatten(), *(pa.array(row[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")),
           pa.array(total(times * best[places])), pa.array(total(times * n[places])), pa.array(row["digest"], pa.string())]
    return pa.Table.from_arrays(out, names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])
