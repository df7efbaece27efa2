"""Cross-tokenizer alignment: the monoid, ranges, and whole results against brute force."""

import hashlib
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftwork.llm import alignment
from siftwork.llm.alignment import Fragment, Pair, align, aligned, compose, default_tokenizers, fragment, ranges
from tests.llm.conftest import BASE, documents


@pytest.fixture(scope="module")
def pair():
    return Pair(*default_tokenizers())


def brute(pair, rows):
    """Rows (doc_id, text) -> (sorted result rows, {(a, b): documents}), by sets and loops."""
    groups_of = []
    for _, text in rows:
        spaced = " " + (text or "")
        a, b = pair.a.tokenizer.encode(spaced, add_special_tokens=False).ids, pair.b.encode(text or "")
        raw = spaced.encode()
        if not text or b"".join(pair.bytes_a[i] for i in a) != raw or b"".join(pair.bytes_b[i] for i in b) != raw:
            groups_of.append(None)
            continue
        ends = []
        for ids, table in ((a, pair.bytes_a), (b, pair.bytes_b)):
            at, out = 0, []
            for i in ids:
                at += len(table[i])
                out.append(at)
            ends.append(out)
        common = sorted(set(ends[0]) & set(ends[1]))
        groups = {e: ([], []) for e in common}
        for side, ids in enumerate((a, b)):
            for i, e in zip(ids, ends[side]):
                groups[common[bisect_left(common, e)]][side].append(i)
        groups_of.append([groups[e] for e in common])
    count = Counter()
    for groups in groups_of:
        count.update({(a, b) for g in groups or [] for a in g[0] for b in g[1]})
    top = defaultdict(int)
    for (a, _), n in count.items():
        top[a] = max(top[a], n)
    out = []
    for (doc, _), groups in zip(rows, groups_of):
        if groups is None:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_best = total = n_links = 0
        for g in groups:
            for a, k in Counter(g[0]).items():
                for b, m in Counter(g[1]).items():
                    n_links += k * m
                    total += k * m * count[a, b]
                    n_best += k * m * (count[a, b] == top[a])
        text = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        out.append((doc, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), n_links, n_best, total, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str), dict(count)


def collected(found):
    return sorted(map(tuple, found.documents.collect()), key=str), {(r.a, r.b): r.documents for r in found.pairs.collect()}


AWKWARD = ["word", " two", "  ", "\n", " x", "é", "漢字", "\U0001f600", "<|endoftext|>", "<s>", "</s>", "\x00", "\xa0", "é", "don't", " 123", "....", " ", "\t", "▁", "ﬁ", "<0x41>", "aaaa"]


@settings(max_examples=120, deadline=None)
@given(parts=st.lists(st.sampled_from(AWKWARD), max_size=14), size=st.integers(1, 30))
def test_fragments_of_any_ranges_compose_to_the_whole(pair, parts, size):
    text = "".join(parts)
    whole = pair.encode([" " + text])[0]
    if not text or whole is None:
        return
    a, b = whole
    ends_a, ends_b = np.cumsum(pair.size_a[a]), np.cumsum(pair.size_b[b])
    want, _ = aligned(a, b, ends_a, ends_b)
    made, closed = [], []
    for lo in range(0, int(ends_a[-1]), size):  # ranges end inside words, tokens and characters
        in_a, in_b = ((e > lo) & (e <= lo + size) for e in (ends_a, ends_b))
        piece, groups = fragment(a[in_a], b[in_b], ends_a[in_a], ends_b[in_b])
        made.append(piece)
        if groups:
            closed += [(piece.cut, 1, g, groups.a[groups.of_a == g].tolist(), groups.b[groups.of_b == g].tolist()) for g in range(groups.n)]

    def fold(pieces, out):
        total = Fragment()
        for p in pieces:
            total, group = compose(total, p)
            if group:
                out.append((group[0], 0, 0, *group[1]))
        return total

    left, tree = [], []
    one = fold(made, left)
    two = fold([fold(made[k:k + 3], tree) for k in range(0, len(made), 3)], tree)
    assert one == two and sorted(left) == sorted(tree)
    assert one.suffix == ([], [])
    found = [(one.cut, -1, 0, *one.prefix)] + closed + left
    assert [x[3:] for x in sorted(found)] == [(want.a[want.of_a == g].tolist(), want.b[want.of_b == g].tolist()) for g in range(want.n)]


@settings(max_examples=100, deadline=None)
@given(parts=st.lists(st.sampled_from(AWKWARD), max_size=30), size=st.integers(1, 20))
def test_tokens_of_windows_are_the_whole_texts(pair, parts, size):
    text = "".join(parts)
    if not text or pair.encode([" " + text])[0] is None:
        return
    spaced, got = " " + text, ([], [])
    for lo, hi, begin, end in ranges(spaced, size):
        base, low, high = (len(spaced[:x].encode()) for x in (begin, lo, hi))
        for side, (ids, sizes) in enumerate(zip(pair.encode([spaced[begin:end]])[0], (pair.size_a, pair.size_b))):
            ends = base + np.cumsum(sizes[ids])
            got[side].extend(ids[(ends > low) & (ends <= high)].tolist())
    want = pair.encode([spaced])[0]
    assert got == (want[0].tolist(), want[1].tolist())


def test_groups_with_many_links_count_like_small_ones(pair, monkeypatch):
    r = np.random.default_rng(3)
    a, b = r.integers(0, 9, 300), r.integers(0, 9, 300)
    ends = np.cumsum(r.integers(1, 4, 300))
    other = np.unique(np.append(r.choice(ends, 40), ends[-1]))
    groups, _ = aligned(a, b[:len(other)], ends, other)
    owner = np.arange(groups.n) % 3
    want = [x.tolist() for x in groups.links(owner, 3)]
    monkeypatch.setattr(alignment, "_WIDE_LINKS", 3)
    assert [x.tolist() for x in groups.links(owner, 3)] == want


@pytest.mark.parametrize("chunk", [37, 500, 1 << 16])
def test_awkward_rows_against_brute_force(spark, pair, edge, chunk):
    rows = [r[:2] for r in BASE]
    if chunk == 37:  # many levels of the tree on a few texts
        rows = [r for r in rows if len(r[1] or "") < 2000] + [(20, "漢字" * 90 + " end"), (21, "<|endoftext|> a▁b"), (21, "x \n  y" * 60), (22, "ab" * 300)]
        edge = documents(spark, [(*r, "en", "a") for r in rows]).repartition(3, "text")
    found = align(edge, chunk_chars=chunk)
    want, counts = brute(pair, rows)
    assert collected(found) == (want, counts)


def test_empty_table(spark, empty):
    found = align(empty)
    assert found.documents.collect() == [] and found.pairs.collect() == []


def test_best_pairs(spark, pair, empty):
    docs = documents(spark, [(k, "alpha beta" if k % 3 else "alpha beta gamma", "en", "a") for k in range(9)])
    pairs = align(docs).pairs.collect()
    top = defaultdict(int)
    for r in pairs:
        top[r.a] = max(top[r.a], r.documents)
    assert pairs and all(r.best == (r.documents == top[r.a]) for r in pairs)
