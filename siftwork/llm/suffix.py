"""Operator 2, suffix-array dedup: a common-prefix-aware distributed merge sort.

Finds every byte covered by a string of ``length`` bytes that also starts anywhere else
in the table (the same document included; matches never cross documents).

Sorting all suffixes is not needed. Every ``length``-byte window holds a synchronising
position that depends on the window's bytes only (the least hash of a short gram among its
first ``length - core + 1`` positions), so two equal windows hold it at the same place. It is
enough to sort the suffixes at these positions, about one in 70 bytes; a repeat is found from
the suffix's ``length`` bytes and the ``length - core`` bytes before it. A suffix whose first
``core`` bytes occur once in the table cannot repeat; fingerprints of these prefixes are
counted first (collisions only cost work), and only suffixes whose count is above one go on.

1. Documents are dealt into runs by a hash. Each run sorts its suffixes; equal ones collapse
   into one entry, so a passage in any number of documents is one entry a run.
2. Each run is cut into buckets by the prefix fingerprint (a uniform order: no splitters to
   sample) and exchanged front-coded: the length of the prefix shared with the entry before,
   and the rest, compressed.
3. Each bucket merges its runs with a loser tree that carries, for every run's head, the prefix
   length it shares with the last entry put out. Heads are told apart by these lengths alone; only on
   a tie are bytes compared, from that length on. The merge gives the sorted suffixes with
   their common prefix lengths: a sparse suffix array with its LCP array.
4. For every split of ``length`` into left and right parts, entries that share both parts are
   repeats; each entry learns how far its repeated windows reach to the left and right.
5. The reach goes back to the runs, which hold the documents' texts, and becomes spans.

A prefix with more than ``hot`` candidates (a boilerplate line between different neighbours) would
fill one bucket whatever their number. Its suffixes are read off the texts where these are stored, by a bitmap of the hot
prints (8 MB at any size; a print that shares a hot one's bit comes along with all its suffixes, which costs work only).
They do not go to the runs but through ``_hot_reach``:
the splits are halved, and for the splits lo to hi a suffix is filed under the bytes that all their
windows hold (``length - hi`` to the right, ``lo`` to the left). Suffixes equal in all bytes that any
of these windows holds collapse into one. Files of at most ``hot`` are searched as in 4; larger
ones are halved again, down to one split, where a file is one window and collapses.

Defined results: null and empty texts have no spans; texts shorter than ``length`` bytes
neither have nor cause any; rows that repeat a document are copies of each other;
a null id is carried along; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.llm.common import utf8, work_dir, written

_SLAB = 4 << 20
_ROWS = 1 << 16
_SLOTS = 1 << 26
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Shape:
    """Lengths that belong together: the repeat, the shared core, the gram, the bytes kept to the left."""

    def __init__(self, length: int):
        if not 16 <= length <= 250:
            raise ValueError("length must be 16 to 250 bytes")
        self.length = length
        self.core = max(8, length * 8 // 25)
        self.gram = 8
        self.window = length - self.core + 1
        self.left = self.window - 1
        self.width = length + 1 + self.left + 1  # right bytes, their number, left bytes reversed, their number


def _words(buf: np.ndarray, at: np.ndarray | None, n: int) -> np.ndarray:
    """Little-endian 8-byte words at every (or the given) position; ``buf`` has 8 bytes of padding."""
    view = np.ndarray((n,), "<u8", buffer=buf.data, strides=(1,))
    return view.copy() if at is None else view[at]


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """Least or largest of every ``width`` neighbours, by doubling."""
    size = 1
    while 2 * size <= width:
        x = pick(x[:-size], x[size:])
        size *= 2
    return pick(x[:len(x) - (width - size)], x[width - size:]) if width > size else x


def _anchors(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, shape: Shape) -> np.ndarray:
    """Synchronising positions of all windows that lie inside one document."""
    n, found = len(buf) - 8, []
    valid = np.zeros(n + 1, np.int8)
    fits = ends - starts >= shape.length
    np.add.at(valid, starts[fits], 1)
    np.subtract.at(valid, ends[fits] - shape.length + 1, 1)
    valid = np.cumsum(valid[:n], dtype=np.int8) > 0
    for s in range(0, n, _SLAB):
        e = min(n, s + _SLAB)
        stop = min(n, e + shape.window - 1)
        ok = valid[s:e]
        if not ok.any():
            continue
        h = _words(buf[s:stop + 8], None, stop - s) * _M1
        h = (((h ^ (h >> np.uint64(29))) * _M2) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        h = np.concatenate([h, np.full(e - s + shape.window - 1 - len(h), 0xFFFFFFFF, np.uint32)])
        least = _slide(h, shape.window, np.minimum)
        least = np.where(ok, least, np.uint32(0))
        pad = np.zeros(shape.window - 1, np.uint32)
        reached = _slide(np.concatenate([pad, least, pad]), shape.window, np.maximum)
        found.append(np.flatnonzero(reached == h) + s)
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)


def _core_prints(buf: np.ndarray, at: np.ndarray, shape: Shape) -> np.ndarray:
    """64-bit fingerprints of the first ``core`` bytes from each position."""
    n = len(buf) - 8
    out = np.zeros(len(at), np.uint64)
    for k in [*range(0, shape.core - 7, 8), shape.core - 8]:
        out = (out ^ _words(buf, at + k, n)) * _M1
        out ^= out >> np.uint64(31)
    return out


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one buffer with 8 bytes of padding, and where each starts and ends."""
    buf = np.frombuffer(b"".join(texts) + bytes(8), np.uint8)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    return buf, ends - np.fromiter(map(len, texts), np.int64, len(texts)), ends


# ---- runs -------------------------------------------------------------------------------

def _rows(buf: np.ndarray, at: np.ndarray, start: np.ndarray, end: np.ndarray, shape: Shape) -> np.ndarray:
    """One fixed-width row a suffix: bytes to the right, their number, bytes to the left reversed, their number."""
    right, left = np.minimum(shape.length, end - at), np.minimum(shape.left, at - start)
    rows = np.zeros((len(at), shape.width), np.uint8)
    step = np.arange(shape.length)
    rows[:, :shape.length] = np.where(step < right[:, None], buf[np.minimum(at[:, None] + step, len(buf) - 1)], 0)
    rows[:, shape.length] = right
    step = np.arange(shape.left)
    rows[:, shape.length + 1:-1] = np.where(step < left[:, None], buf[np.maximum(at[:, None] - 1 - step, 0)], 0)
    rows[:, -1] = left
    return rows


def _unique(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different rows, and each row's place among them."""
    text = np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel()
    order = np.argsort(text, kind="stable")
    s = rows[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]).any(axis=1)
    place = np.empty(len(s), np.int64)
    place[order] = np.cumsum(new) - 1
    return s[new], place


def _entries(buf, at, start, end, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different rows of all suffixes and the place of each suffix, slab by slab (so that a
    periodic text, where every position synchronises, stays small)."""
    kept, places, base = [], [], 0
    for k in range(0, len(at), _ROWS):
        part = slice(k, k + _ROWS)
        rows, place = _unique(_rows(buf, at[part], start[part], end[part], shape))
        kept.append(rows)
        places.append(place + base)
        base += len(rows)
    rows, place = _unique(np.concatenate(kept))
    return rows, place[np.concatenate(places)]


def _front_coded(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix length shared with the row before, and the remaining bytes of all rows."""
    lcp = np.zeros(len(rows), np.int64)
    differ = rows[1:] != rows[:-1]
    lcp[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return lcp, rows[np.arange(rows.shape[1]) >= lcp[:, None]]


def _pack(*arrays: np.ndarray) -> bytes:
    import zstandard
    raw = np.array([len(arrays), *(a.nbytes for a in arrays)], "<i8").tobytes() + b"".join(a.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unpack(blob: bytes, *types: str) -> list[np.ndarray]:
    import zstandard
    raw = zstandard.ZstdDecompressor().decompress(blob)
    sizes, at, out = np.frombuffer(raw, "<i8", 1 + len(types))[1:], 8 * (1 + len(types)), []
    for size, kind in zip(sizes, types, strict=True):
        out.append(np.frombuffer(raw[at:at + size], kind))
        at += size
    return out


class _Run:
    """The documents of one run in a fixed order, their candidate suffixes and entries."""

    def __init__(self, docs: pa.Table, side: pa.Table):
        keys = docs.column("key").to_numpy()
        self.order = np.argsort(keys, kind="stable")
        texts = docs.column("text").take(pa.array(self.order)).to_pylist()
        self.buf, self.starts, self.ends = _joined(texts)
        keys = keys[self.order]
        cand = side.filter(side.column("pos").is_valid())
        key, pos = cand.column("key").to_numpy(), cand.column("pos").to_numpy().astype(np.int64)
        pairs = np.unique(np.rec.fromarrays([key, pos]))  # rows that repeat a document name a position twice
        key, pos = pairs.f0, pairs.f1
        first, last = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
        times = last - first  # one suffix for each row with that key
        self.doc = np.repeat(first, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        self.at = self.starts[self.doc] + np.repeat(pos, times)
        self.cand, self.times = pairs, times

    def entries(self, shape: Shape) -> None:
        if len(self.at):
            self.rows, self.place = _entries(self.buf, self.at, self.starts[self.doc], self.ends[self.doc], shape)


def _cut_run(docs: pa.Table, side: pa.Table, shape: Shape, buckets: int, schema: pa.Schema) -> pa.Table:
    """Sorted front-coded entries of one run, one blob a bucket."""
    run = _Run(docs, side)
    run.entries(shape)
    if not len(run.at):
        return schema.empty_table()
    number = docs.column("run")[0].as_py()
    first = np.zeros(len(run.rows), np.int64)
    first[run.place[::-1]] = run.at[::-1]
    bucket = (_core_prints(run.buf, first, shape) % np.uint64(buckets)).astype(np.int64)
    several = np.bincount(run.place) > 1
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    out = []
    for part in np.split(order, cuts):
        lcp, rest = _front_coded(run.rows[part])
        out.append((int(bucket[part[0]]), number, _pack(lcp.astype("<u2"), rest, part.astype("<u4"), several[part].astype("u1"))))
    b, r, blob = zip(*out, strict=True)
    return pa.Table.from_pydict({"bucket": b, "run": r, "blob": blob}, schema=schema)


# ---- merge ------------------------------------------------------------------------------

def _shared(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix, known to be at least ``at``."""
    n = len(a)
    while at < n:
        x, y = a[at:at + 32], b[at:at + 32]
        if x != y:
            return at + len(x) - ((int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_length() + 7) // 8
        at += 32
    return n


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[int], list[int]]:
    """Merge sorted runs, each with its front-coding lengths: for every entry in sorted order, which
    run it comes from and the prefix length it shares with the entry before.

    Loser tree over the runs' heads. ``known[r]`` is the prefix length that run r's head shares
    with the entry that last passed the node where it waits; of two heads the one that shares
    more is smaller, and bytes are read only when both share the same length, from there on."""
    k = len(runs)
    size = 1 << max(0, (k - 1).bit_length())
    texts, lcps = [r[0] for r in runs], [r[1] for r in runs]
    nxt = [0] * k
    head: list[bytes | None] = [t[0] if t else None for t in texts] + [None] * (size - k)
    known = [0] * size
    loser = [0] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); sets the loser's known length to what it shares with the winner."""
        x, y = head[a], head[b]
        if x is None:
            return b, a
        if y is None:
            return a, b
        p, q = known[a], known[b]
        if p != q:
            return (a, b) if p > q else (b, a)
        at = _shared(x, y, p)
        if x[at:at + 1] <= y[at:at + 1]:
            known[b] = at
            return a, b
        known[a] = at
        return b, a

    def build(node: int) -> int:
        if node >= size:
            return node - size
        winner, loser[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    sources, shared = [], []
    top = build(1) if size > 1 else 0
    while head[top] is not None:
        sources.append(top)
        shared.append(known[top])
        j = nxt[top] = nxt[top] + 1
        if j < len(texts[top]):
            head[top], known[top] = texts[top][j], lcps[top][j]
        else:
            head[top] = None
        node = (top + size) >> 1
        while node:
            top, loser[node] = play(top, loser[node])
            node >>= 1
    return sources, shared


def _reach(rows: np.ndarray, lcp: np.ndarray, several: np.ndarray, shape: Shape, parts: range | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For sorted rows with their shared prefix lengths: the most and the fewest bytes to the left
    (of ``parts``, else of all splits) with which a repeated window holds the suffix's start (-1: none)."""
    n = len(rows)
    right, left = rows[:, shape.length].astype(np.int64), rows[:, -1].astype(np.int64)
    before = np.ascontiguousarray(rows[:, shape.length + 1:-1])
    order = np.argsort(before.view(f"S{shape.left}").ravel(), kind="stable")
    left_lcp, _ = _front_coded(before[order])
    bits = max(1, int(n).bit_length())
    if 3 * bits > 63:
        raise ValueError("too many entries in a bucket: use more buckets")
    most, fewest = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    left_class = np.empty(n, np.int64)
    for part in parts or range(shape.left + 1):
        can = np.flatnonzero((left >= part) & (right >= shape.length - part))
        if not len(can):
            continue
        right_class = np.cumsum(lcp < shape.length - part)
        left_class[order] = np.cumsum(left_lcp < part)
        packed = np.sort((right_class[can] << 2 * bits) | (left_class[can] << bits) | can)
        group, entry = packed >> bits, packed & ((1 << bits) - 1)
        same = np.zeros(len(packed), bool)
        equal = group[1:] == group[:-1]
        same[1:] |= equal
        same[:-1] |= equal
        good = entry[same | several[entry]]
        most[good] = part
        fewest[good] = np.where(fewest[good] < 0, part, fewest[good])
    return most, fewest


def _merge_bucket(blobs: pa.Table, shape: Shape, schema: pa.Schema) -> pa.Table:
    """Merge a bucket's runs and send each run the reach of its entries."""
    blobs = blobs.sort_by("run")
    numbers = blobs.column("run").to_pylist()
    runs, decoded = [], []
    for blob in blobs.column("blob").to_pylist():
        lcp, rest, entry, several = _unpack(blob, "<u2", "u1", "<u4", "u1")
        raw, at, texts, last = rest.tobytes(), 0, [], b""
        lengths = lcp.tolist()
        for shared in lengths:
            size = shape.width - shared
            last = last[:shared] + raw[at:at + size]
            texts.append(last)
            at += size
        runs.append((texts, lengths))
        decoded.append((entry, several))
    sources, shared = merge_runs(runs)
    source, lcp = np.array(sources), np.array(shared)
    by_run = np.argsort(source, kind="stable")  # the sorted order of run 0's entries, then run 1's, ...
    rows = np.empty((len(source), shape.width), np.uint8)
    rows[by_run] = np.frombuffer(b"".join(t for texts, _ in runs for t in texts), np.uint8).reshape(-1, shape.width)
    several = np.empty(len(source), bool)
    several[by_run] = np.concatenate([s for _, s in decoded]) > 0
    most, fewest = _reach(rows, lcp, several, shape)
    out, at = [], 0
    for number, (entry, _) in zip(numbers, decoded, strict=True):
        mine = by_run[at:at + len(entry)]
        at += len(entry)
        hit = most[mine] >= 0
        if hit.any():
            out.append((number, _pack(entry[hit], most[mine][hit].astype("<i2"), fewest[mine][hit].astype("<i2"))))
    return pa.Table.from_pydict({"run": [x[0] for x in out], "blob": [x[1] for x in out]}, schema=schema)


# ---- hot prefixes -----------------------------------------------------------------------

def _slots(prints: DataFrame, n: int = _SLOTS) -> np.ndarray:
    """A bitmap of ``n`` bits (8 MB, whatever the table) with the bit of every print set."""
    slot = F.pmod("print", F.lit(n)) + 1
    parts = prints.groupBy(F.bitmap_bucket_number(slot).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).collect()
    bits = np.zeros(n, bool)
    for part, found in parts:
        size = 8 * len(found)
        bits[(part - 1) * size:part * size] = np.unpackbits(np.frombuffer(found, np.uint8), bitorder="little")
    return np.packbits(bits, bitorder="little")


def _hot_rows(keys: pa.Array, texts: list[bytes], slots: np.ndarray, shape: Shape) -> Iterator[pa.RecordBatch]:
    """(key, pos, r, l) of the suffixes whose print is set in ``slots``: the bytes to the right and (reversed) to the left."""
    buf, starts, ends = _joined(texts)
    every = _anchors(buf, starts, ends, shape)
    slot = (_core_prints(buf, every, shape) & np.uint64(8 * len(slots) - 1)).astype(np.int64)
    every = every[(slots[slot >> 3] >> (slot & 7)) & 1 > 0]
    for k in range(0, len(every), _ROWS):
        at = every[k:k + _ROWS]
        doc = np.searchsorted(ends, at, "right")
        right, left = [], []
        for a, s, e in zip(at.tolist(), starts[doc].tolist(), ends[doc].tolist(), strict=True):
            right.append(buf[a:min(e, a + shape.length)].tobytes())
            left.append(buf[max(s, a - shape.left):a][::-1].tobytes())
        yield pa.RecordBatch.from_arrays([keys.take(pa.array(doc)), pa.array((at - starts[doc]).astype(np.int32)), pa.array(right, pa.binary()), pa.array(left, pa.binary())],
                                         names=["key", "pos", "r", "l"])


def _merge_file(rows: pa.Table, shape: Shape, schema: pa.Schema) -> pa.Table:
    """The reach of the suffixes of some files that hold all their partners."""
    out = []
    low, high = rows.column("lo").to_numpy(), rows.column("hi").to_numpy()
    for lo, hi in sorted(set(zip(low.tolist(), high.tolist(), strict=True))):
        part = rows.filter(pa.array((low == lo) & (high == hi)))
        right, left = part.column("r").to_pylist(), part.column("l").to_pylist()
        text = [r.ljust(shape.length, b"\0") + bytes([len(r)]) + x.ljust(shape.left, b"\0") + bytes([len(x)]) for r, x in zip(right, left, strict=True)]
        table = np.frombuffer(b"".join(text), np.uint8).reshape(-1, shape.width)
        order = np.argsort(table.view(f"S{shape.width}").ravel(), kind="stable")
        lcp, _ = _front_coded(table[order])
        several = part.column("several").to_numpy()[order]
        most, fewest = _reach(table[order], lcp, several, shape, range(lo, hi + 1))
        part = part.take(pa.array(order)).select(["key", "pos"])
        hit = pa.array((most >= 0) & part.column("key").is_valid().to_numpy())
        found = part.append_column("most", pa.array(most, pa.int32())).append_column("fewest", pa.array(fewest, pa.int32()))
        out.append(found.filter(hit).cast(schema))
    return pa.concat_tables(out)


def _hot_reach(rows: DataFrame, shape: Shape, hot: int, work: str) -> DataFrame:
    """(key, pos, several, r, l) -> (key, pos, most, fewest), one row a suffix. A null key is a suffix whose reach is known already; it stays a partner of others."""
    spark, length = rows.sparkSession, shape.length
    schema = pa.schema([("key", pa.int64()), ("pos", pa.int32()), ("most", pa.int32()), ("fewest", pa.int32())])
    node = ["lo", "hi", "r", "l"]
    most = F.least("hi", F.length("l")).cast("int")
    fewest = F.greatest("lo", length - F.length("r")).cast("int")
    state = rows.select("key", "pos", "several", "r", "l", F.lit(0).alias("lo"), F.lit(shape.left).alias("hi"))
    state, found, level = state.filter(fewest <= most), [], 0
    while True:
        state = written(state, f"{work}/hot-{level}")
        # equal in all bytes of all windows: one entry, and all of them are repeats
        same = written(state.groupBy(*node).agg(((F.count("*") > 1) | F.max("several")).alias("several"), F.min(F.struct("key", "pos")).alias("who")), f"{work}/same-{level}")
        repeats = same.filter("several").select(*node)
        found.append(written(state.filter("key is not null").join(repeats, node).select("key", "pos", most.alias("most"), fewest.alias("fewest")), f"{work}/equal-{level}"))
        who = F.when(~F.col("several"), F.col("who"))
        file = F.xxhash64("lo", "hi", F.expr(f"substring(r, 1, {length} - hi)"), F.expr("substring(l, 1, lo)"))
        entries = written(same.filter("lo < hi").select(file.alias("file"), *node, "several", who["key"].alias("key"), who["pos"].alias("pos")), f"{work}/entries-{level}")
        sizes = written(entries.groupBy("file").agg(F.count("*").alias("n")).filter("n > 1"), f"{work}/sizes-{level}")
        small = sizes.filter(F.col("n") <= hot)
        total = small.agg(F.sum("n")).first()[0] or 0
        if total:
            groups = max(1, total // hot, min(64, total // 500))
            cold = entries.join(small.select("file"), "file").withColumn("bucket", F.pmod("file", F.lit(groups)))
            merged = cold.groupBy("bucket").applyInArrow(lambda t: _merge_file(t, shape, schema), "key bigint, pos int, most int, fewest int")
            found.append(written(merged, f"{work}/merged-{level}"))
        large = sizes.filter(F.col("n") > hot).select("file")
        if large.isEmpty():
            break
        middle = F.expr("(lo + hi) div 2").cast("int")
        halves = F.explode(F.array(F.struct(F.col("lo").alias("lo"), middle.alias("hi")), F.struct((middle + 1).alias("lo"), F.col("hi").alias("hi"))))
        state = (entries.join(large, "file").select("key", "pos", "several", "r", "l", halves.alias("half"))
                 .select("key", "pos", "several", F.expr(f"substring(r, 1, {length} - half.lo)").alias("r"), F.expr("substring(l, 1, half.hi)").alias("l"), "half.lo", "half.hi")
                 .filter((F.length("l") >= F.col("lo")) & (F.length("r") >= length - F.col("hi")) & (fewest <= most)))
        level += 1
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    # all windows hold the suffix's start, so the outermost two tell their union
    return out.groupBy("key", "pos").agg(F.max("most").alias("most"), F.min("fewest").alias("fewest"))


# ---- spans ------------------------------------------------------------------------------

def _spans(docs: pa.Table, side: pa.Table, shape: Shape, schema: pa.Schema) -> pa.Table:
    """The removed spans and the remaining bytes of one run's documents."""
    hot = side.filter(side.column("most").is_valid())
    run = _Run(docs, side.filter(side.column("most").is_null()))
    run.entries(shape)
    depth = np.zeros(len(run.buf) + 1, np.int32)
    if len(run.at):
        most, fewest = np.full(len(run.rows), -1, np.int64), np.zeros(len(run.rows), np.int64)
        for blob in side.column("blob").drop_null().to_pylist():
            entry, m, f = _unpack(blob, "<u4", "<i2", "<i2")
            most[entry], fewest[entry] = m, f
        hit = most[run.place] >= 0
        at, most, fewest = run.at[hit], most[run.place][hit], fewest[run.place][hit]
        # every window holds the start of its suffix, so their union is one span
        np.add.at(depth, at - most, 1)
        np.add.at(depth, at + shape.length - fewest, -1)
    if hot.num_rows:
        more = _Run(docs, hot)
        hot = hot.sort_by([("key", "ascending"), ("pos", "ascending")])  # one row a suffix, in the order of the candidates
        np.add.at(depth, more.at - np.repeat(hot.column("most").to_numpy(), more.times), 1)
        np.add.at(depth, more.at + shape.length - np.repeat(hot.column("fewest").to_numpy(), more.times), -1)
    gone = np.cumsum(depth[:-1]) > 0
    ids = docs.column("doc_id").take(pa.array(run.order))
    spans, kept = [], []
    for a, b in zip(run.starts.tolist(), run.ends.tolist(), strict=True):
        mask = gone[a:b]
        if mask.any():
            edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
            spans.append([{"start": int(s), "end": int(e)} for s, e in zip(edge[::2], edge[1::2], strict=True)])
            kept.append(run.buf[a:b][~mask].tobytes())
        else:
            spans.append([])
            kept.append(run.buf[a:b].tobytes())
    return pa.table([ids, pa.array(run.ends - run.starts), pa.array(spans, schema.field("spans").type), pa.array(kept, pa.binary())], schema=schema)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, hot: int = 40_000) -> DataFrame:
    """(doc_id, n_bytes, spans array<struct<start, end>>, kept binary) for every row: byte spans of
    the text covered by repeated strings of ``length`` bytes, and the other bytes. Prefixes with more
    than ``hot`` candidates are searched in parts; the result does not depend on it."""
    shape, work = Shape(length), work_dir(docs.sparkSession, "suffix")
    kind = docs.schema[id_col].dataType.simpleString()
    # the key names a document by id and text: rows with the same key are copies and share their result
    base = docs.select(F.xxhash64(docs[id_col], docs[text_col]).alias("key"), docs[id_col].alias("doc_id"), utf8(docs[text_col]).alias("text"))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, starts, ends = _joined(batch.column(1).to_pylist())
            at = _anchors(buf, starts, ends, shape)
            doc = np.searchsorted(ends, at, "right")
            yield pa.RecordBatch.from_arrays(
                [pa.array(_core_prints(buf, at, shape).view(np.int64)), batch.column(0).take(pa.array(doc)), pa.array((at - starts[doc]).astype(np.int32))],
                names=["print", "key", "pos"])

    marks = base.select("key", "text").mapInArrow(anchors, "print bigint, key bigint, pos int")
    # written, so that the join reads two plain exchanges and a hot print's rows can be split
    repeated = written(marks.groupBy("print").agg(F.count("*").alias("n")).filter("n > 1").select("print", (F.col("n") > hot).alias("hot")), f"{work}/repeated")
    cand = written(marks.join(repeated.filter("not hot").select("print"), "print").select("key", "pos"), f"{work}/candidates")
    n_cand = cand.count()
    total = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # runs of 256 KB to 8 MB; beyond 4096 runs they grow instead, so that runs x buckets stays in proportion
    run_bytes = max(min(8 << 20, max(256 << 10, total // 64)), total // 4096)
    runs = max(1, -(-total // run_bytes))
    buckets = max(1, n_cand // 40_000, min(64, n_cand // 500))
    run = F.pmod("key", F.lit(runs)).alias("run")
    texts = base.select(run, "key", "doc_id", "text")
    side = cand.select(run, "key", "pos", F.lit(None).cast("binary").alias("blob"))

    none = F.lit(None).cast("int")
    cut_schema = pa.schema([("bucket", pa.int64()), ("run", pa.int64()), ("blob", pa.binary())])
    reach_schema = pa.schema([("run", pa.int64()), ("blob", pa.binary())])
    cut = (texts.groupBy("run").cogroup(side.groupBy("run"))
           .applyInArrow(lambda d, s: _cut_run(d, s, shape, buckets, cut_schema), "bucket bigint, run bigint, blob binary"))
    merged = cut.groupBy("bucket").applyInArrow(lambda b: _merge_bucket(b, shape, reach_schema), "run bigint, blob binary")
    both = side.unionAll(merged.select("run", F.lit(None).cast("bigint"), F.lit(None).cast("int"), "blob")).withColumns({"most": none, "fewest": none})
    if not repeated.filter("hot").isEmpty():
        slots = base.sparkSession.sparkContext.broadcast(_slots(repeated.filter("hot")))

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from _hot_rows(batch.column(0), batch.column(1).to_pylist(), slots.value, shape)

        rows = base.select("key", "text").mapInArrow(near, "key bigint, pos int, r binary, l binary").withColumn("several", F.lit(False))
        both = both.unionAll(_hot_reach(rows, shape, hot, work).select(run, "key", "pos", F.lit(None).cast("binary"), "most", "fewest"))
    to_arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    out = pa.schema([("doc_id", to_arrow[kind]), ("n_bytes", pa.int64()), ("spans", spans), ("kept", pa.binary())])
    return (texts.groupBy("run").cogroup(both.groupBy("run"))
            .applyInArrow(lambda d, s: _spans(d, s, shape, out), f"doc_id {kind}, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary"))
