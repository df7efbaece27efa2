"""Hard negatives: pruning keeps every row that can reach a threshold; whole results against brute force."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftwork.llm.negatives import Tile, as_integers, best, mine, search
from tests.llm.conftest import CLASHES

SCHEMA = "vec_id bigint, label string, embedding array<double>"


def brute(rows, anchor, positives=5, negatives=10, low=30, high=90):
    """By loops over all pairs, in Python's integers."""
    usable = []
    for doc, label, v in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) or not math.isfinite(256 * x) for x in v):
            continue
        usable.append((doc, label, [math.floor(256 * x) for x in v]))
    out = []
    for k, (a, label, q) in enumerate(usable):
        if a is None or not anchor(a):
            continue
        score = {j: max(-(1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(q, v)))) for j, (_, _, v) in enumerate(usable) if len(v) == len(q)}
        ranked = sorted((j for j in score if j != k), key=lambda j: (-score[j], usable[j][0] is None, usable[j][0] or 0))
        for p in [j for j in ranked if usable[j][1] == label][:positives]:
            hard = [j for j in ranked if usable[j][1] != label and low * score[p] <= 100 * score[j] <= high * score[p]][:negatives]
            out += [(a, usable[p][0], r, usable[j][0], score[p], score[j]) for r, j in enumerate(hard, 1)]
    return sorted(out, key=str)


def mined(spark, rows, every=3, **options):
    vectors = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in (*CLASHES, "id", "uid", "anchor", "dim", "q", "tile", "block", "place", "bands")})
    got = mine(vectors.repartition(4), F.col("vec_id") % every == 0, **options)
    return sorted(map(tuple, got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=str)


def clustered(n, d, seed, spread=0.15):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, d)) * (r.random((6, d)) < 0.3)
    v = centres[r.integers(0, 6, n)] + spread * r.normal(size=(n, d))
    return v * np.exp(r.normal(size=n))[:, None]


@settings(max_examples=80, deadline=None)
@given(n=st.integers(1, 120), d=st.integers(1, 12), seed=st.integers(0, 10_000), focus=st.integers(1, 12), share=st.floats(-0.5, 1.2))
def test_no_row_that_reaches_the_threshold_is_pruned(n, d, seed, focus, share):
    v = np.floor(256 * clustered(n, d, seed))
    tile, queries = Tile(v), v[: max(1, n // 4)]
    full = queries @ v.T
    need = np.floor(share * full.max(axis=1)).astype(np.int64)
    found = {k: (np.arange(n) if rows is None else rows, scores) for k, rows, scores in search(tile, queries, need, focus)}
    for k in range(len(queries)):
        wanted = set(np.flatnonzero(full[k] >= need[k]).tolist())
        rows, scores = found.get(k, (np.empty(0, int), np.empty(0)))
        assert wanted <= set(rows.tolist())
        assert (scores == full[k][rows]).all()


def test_clustered_vectors_are_pruned():
    v = clustered(4000, 16, 7, spread=0.05)
    v = np.floor(256 * v / np.sqrt((v * v).sum(axis=1))[:, None])  # one length bucket
    tile, queries = Tile(v), v[:100]
    need = np.sort(queries @ v.T, axis=1)[:, -10].astype(np.int64)
    pruned, whole = tile.candidates(queries, need, 6)
    verified = sum(len(rows) for _, rows in pruned) + len(whole) * len(v)
    assert verified < 0.35 * 100 * len(v)


@settings(max_examples=60, deadline=None)
@given(x=st.lists(st.integers(-3, 3), min_size=1, max_size=60), k=st.integers(1, 9))
def test_best_with_ties(x, k):
    assert best(np.array(x), k).tolist() == sorted(range(len(x)), key=lambda j: (-x[j], j))[:k]


@pytest.mark.parametrize("top", [1e3, 1e7, 1e13, 1e40])
def test_scores_are_exact(top):
    r = np.random.default_rng(0)
    v = np.floor(r.normal(size=(20, 5)) * top)
    got = Tile(v).scores(None, v[:3])
    want = [[min(max(sum(int(a) * int(b) for a, b in zip(q, p)), -(1 << 63)), (1 << 63) - 1) for p in v] for q in v[:3]]
    assert got.tolist() == want
    assert as_integers(v[:1]).tolist() == [[int(x) for x in v[0]]]


@pytest.mark.parametrize("tile_rows", [40, 65_536])
def test_against_brute_force(spark, tile_rows):
    v = clustered(500, 8, 11)
    rows = [(k, "abc"[k * 7 % 3], [float(x) for x in v[k]]) for k in range(500)]
    rows += [(1000 + k, "b", rows[30][2]) for k in range(40)]  # one very common vector
    got = mined(spark, rows, every=9, tile_rows=tile_rows, block_anchors=20)
    assert got == brute(rows, lambda a: a % 9 == 0) and len(got) > 300


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, "a", [1.0, 0.5]), (1, "a", [0.9, 0.4]), (1, "a", [0.9, 0.4]), (2, "b", [0.5, 0.3]), (2, "b", [0.5, 0.3]), (None, "b", [0.5, 0.3]), (None, "a", [1.0, 0.5]),
            (3, None, [1.0, 1.0]), (4, "b", None), (5, "b", [1.0, None]), (6, "b", [nan, 1.0]), (7, "a", [inf, 1.0]), (8, "b", [1e307, 1.0]),
            (9, "b", [1.0, 1.0, 1.0]), (12, "a", [0.4, 0.4, 0.9]), (15, "a", [0.2, 0.9, 0.1]), (18, "c", []), (21, "a", []), (24, "a", []), (27, "b", [0.0, 0.0]), (30, "a", [0.0, 0.0]),
            (33, "a", [-1.0, -0.5]), (36, "b", [1e30, 2.0]), (39, "b", [-1e30, 2.0]), (42, "c", [0.6, 0.1]), (0, "a", [1.0, 0.5]), (45, "", [0.55, 0.3])]
    assert mined(spark, rows) == brute(rows, lambda a: a % 3 == 0)


def test_empty_table_and_bad_options(spark):
    assert mined(spark, []) == []
    with pytest.raises(ValueError):
        mine(spark.createDataFrame([], SCHEMA), F.lit(True), positives=0)
