"""Suffix-array dedup against a count of all windows; the loser tree against sorting."""

import random
from collections import Counter

import numpy as np
import pytest

from siftwork.llm.suffix import Shape, _anchors, _joined, merge_runs, repeated_spans
from tests.llm.conftest import BASE, documents


def brute(texts, length):
    counts = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if counts[t[i:i + length]] > 1:
                gone[i:i + length] = True
        out.append((bytes(b for b, g in zip(t, gone, strict=True) if not g), int(gone.sum())))
    return out


def compare(docs, rows, length, **options):
    texts = [(r[1] or "").encode() for r in rows]
    want = sorted(((r[0], len(t), n, kept) for r, t, (kept, n) in zip(rows, texts, brute(texts, length), strict=True)), key=str)
    got = repeated_spans(docs, length=length, **options).collect()
    assert sorted(((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), bytes(r.kept)) for r in got), key=str) == want
    for r in got:  # maximal, ordered runs
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))


@pytest.mark.parametrize("length", [24, 200])
def test_edge_cases_match_brute_force(edge, length):
    compare(edge, BASE, length)


@pytest.mark.parametrize("seed", range(4))
def test_random_repeats_match_brute_force(spark, seed):
    r = random.Random(seed)
    pool = ["".join(r.choice("abc") for _ in range(r.choice([30, 60, 200, 500]))) for _ in range(8)]
    rows = []
    for k in range(80):
        parts = [r.choice(pool)[r.randrange(20):] if r.random() < 0.6 else "".join(r.choice("abcdé ") for _ in range(r.randrange(150))) for _ in range(r.randrange(6))]
        rows.append((k, "".join(parts), "en", "a"))
    compare(documents(spark, rows).repartition(5), rows, r.choice([16, 40, 64]))


def test_periodic_and_overlapping_repeats(spark):
    rows = [(1, "ab" * 300, "", ""), (2, "z" * 199, "", ""), (3, "z" * 200, "", ""), (4, "z" * 201, "", ""), (5, "q" * 150 + "r" * 150, "", "")]
    compare(documents(spark, rows), rows, 200)


def test_empty_table(empty):
    assert repeated_spans(empty).collect() == []


def test_every_window_has_an_anchor_placed_by_content():
    shape = Shape(200)
    text = bytes(random.Random(1).randrange(97, 105) for _ in range(5000))
    other = b"prefix of another length" + text[700:3000]
    places = []
    for t in (text, other):
        buf, starts, ends = _joined([t])
        at = _anchors(buf, starts, ends, shape)
        assert all(((at >= p) & (at < p + shape.window)).any() for p in range(len(t) - 199))
        places.append(set(at.tolist()))
    shift = 700 - len(b"prefix of another length")
    inner = {a for a in places[0] if 900 <= a < 2700}
    assert inner == {a + shift for a in places[1] if 900 <= a + shift < 2700}


@pytest.mark.parametrize("runs", [1, 2, 3, 7, 16])
def test_loser_tree_merges_and_keeps_prefix_lengths(runs):
    r = random.Random(runs)
    strings = [bytes(r.choice(b"ab") for _ in range(12)) for _ in range(400)]
    parts = []
    for k in range(runs):
        mine = sorted(strings[k::runs])
        lcp = [0] + [next((i for i in range(12) if a[i] != b[i]), 12) for a, b in zip(mine, mine[1:])]
        parts.append((mine, lcp))
    sources, shared = merge_runs(parts)
    at, out = [0] * runs, []
    for s in sources:
        out.append(parts[s][0][at[s]])
        at[s] += 1
    assert out == sorted(strings)
    assert shared[1:] == [next((i for i in range(12) if a[i] != b[i]), 12) for a, b in zip(out, out[1:])]


def hot_rows():
    """Passages of 40 to 110 bytes between different neighbours, copies, short ends, and a period."""
    r = random.Random(5)
    line = "".join(r.choice("abcdefgh") for _ in range(110))
    rows = []
    for k in range(160):
        left, right = ("".join(r.choice("stuvwxyz ") for _ in range(r.choice([0, 3, 30, 90]))) for _ in range(2))
        rows.append((k, left + line[r.choice([0, 0, 0, 25]):r.choice([110, 110, 65])] + right, "en", "a"))
    rows += [(200 + k, rows[k % 3][1], "en", "a") for k in range(30)]
    rows += [(5, rows[5][1], "en", "b"), (None, line, "en", "a"), (300, "z" * 300, "", ""), (301, "y" + "z" * 90, "", "")]
    return rows


@pytest.mark.parametrize("hot", [3, 40])
def test_hot_passage_between_different_neighbours(spark, hot):
    rows = hot_rows()
    docs = documents(spark, rows).repartition(5)
    compare(docs, rows, 60, hot=hot)


def test_entries_of_a_hot_prefix_do_not_meet_in_one_task(spark, tmp_path, monkeypatch):
    import siftwork.llm.suffix as suffix
    inner, seen = suffix._reach, str(tmp_path)

    def counted(rows, *rest):
        import os
        import uuid
        most = max(Counter(bytes(x) for x in rows[:, :19]).values())  # the core of 60 bytes
        with open(os.path.join(seen, uuid.uuid4().hex), "w") as f:
            f.write(str(most))
        return inner(rows, *rest)

    monkeypatch.setattr(suffix, "_reach", counted)
    r = random.Random(9)
    line = "".join(r.choice("abcdefgh") for _ in range(70))
    rows = [(k, "".join(r.choice("stuvwxyz ") for _ in range(40)) + line + "".join(r.choice("stuvwxyz ") for _ in range(40)), "en", "a") for k in range(300)]
    compare(documents(spark, rows).repartition(5), rows, 60, hot=50)
    assert max([0, *(int(p.read_text()) for p in tmp_path.iterdir())]) <= 150  # two or three files of a bucket; all 300 before
