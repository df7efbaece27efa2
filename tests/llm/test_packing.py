"""Packing: limits, whole coverage, little padding, the choice by dot product."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftwork.llm.packing import Example, Pool, clean_spans, default_tokenizer, pack, stored_length, tokenised
from siftwork.llm.slices import slices
from tests.llm.conftest import BASE, LONG, documents


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_buffer(default_tokenizer())


def covered(pieces):
    """(key, row) coverage: pieces of one key sorted by start are gapless."""
    by = defaultdict(list)
    for key, start, n in pieces:
        by[key].append((start, n))
    return {key: sorted(x) for key, x in by.items()}


@settings(max_examples=150, deadline=None)
@given(sizes=st.lists(st.tuples(st.integers(1, 150), st.integers(0, 150), st.integers(0, 150)), max_size=40),
       tokens=st.integers(1, 64), segments=st.integers(1, 6), loss=st.integers(1, 64), cut=st.booleans())
def test_every_limit_holds_and_every_id_is_in_one_piece(sizes, tokens, segments, loss, cut):
    pool = Pool(tokens, segments, loss, cut)
    for key, (n, s, e) in enumerate(sizes):
        pool.add(Example(key, np.arange(n, dtype="<u4"), 0, n, clean_spans([{"start": s, "end": e}], n)))
    got = []
    while pool.live:
        sequence = pool.sequence()
        total = sum(len(p.ids) for p in sequence)
        assert 0 < total <= tokens and len(sequence) <= segments and sum(p.loss(len(p.ids)) for p in sequence) <= loss
        if cut:
            assert total in (tokens, stored_length(total, tokens))  # nothing is padded
        got += [(p.key, p.start, len(p.ids)) for p in sequence]
        assert all(p.ids.tolist() == list(range(p.start, p.start + len(p.ids))) for p in sequence)
    for key, runs in covered(got).items():
        assert [a for a, _ in runs] == [0, *np.cumsum([n for _, n in runs])[:-1].tolist()] and sum(n for _, n in runs) == sizes[key][0]
        if not cut and sizes[key][0] <= tokens and pool.limits[2] >= sum(max(0, min(sizes[key][0], e) - s) for _, s, e in [sizes[key]]):
            assert len(runs) == 1
    assert len(covered(got)) == len(sizes)
    assert (pool.tokens, pool.losses) == (0, 0)


def test_the_largest_dot_product_is_chosen():
    """Brute force over the pool for the next example of an open sequence."""
    r = np.random.default_rng(1)
    for _ in range(50):
        pool = Pool(100, 8, 40, True)
        items = [(int(n), int(min(n, m))) for n, m in zip(r.integers(1, 80, 30), r.integers(0, 40, 30))]
        for k, (n, m) in enumerate(items):
            pool.add(Example(k, np.zeros(n, "<u4"), 0, n, [(n - m, n)] if m else []))
        left = [int(r.integers(1, 101)), int(r.integers(0, 9)), int(r.integers(0, 41))]
        mean = [sum(n for n, _ in items) / 100 / 30, 1 / 8, sum(m for _, m in items) / 40 / 30]
        score = {k: mean[0] * n / 100 * left[0] / 100 + mean[1] / 8 * left[1] / 8 + mean[2] * m / 40 * left[2] / 40
                 for k, (n, m) in enumerate(items) if n <= left[0] and left[1] >= 1 and m <= left[2]}
        got = pool._best(left)
        assert (got is None) == (not score)
        if score:
            assert score[got] == pytest.approx(max(score.values()))


def test_spans():
    assert clean_spans(None, 5) == [(0, 5)] and clean_spans([], 5) == []
    assert clean_spans([{"start": 3, "end": 9}, None, {"start": None, "end": 2}, {"start": 1, "end": 2}, {"start": 4, "end": None}, {"start": 2, "end": 1}], 5) == [(0, 2), (3, 5)]
    e = Example(0, np.zeros(10, "<u4"), 2, 20, [(0, 4), (6, 9)])
    assert [e.loss(n) for n in (1, 2, 4, 7, 10)] == [1, 2, 2, 5, 5]
    assert [e.prefix(10, m) for m in range(6)] == [0, 1, 4, 5, 6, 10]


@pytest.mark.parametrize("pool", [2, 4096])
def test_documents_against_whole_texts(spark, edge, tokenizer, pool):
    examples = tokenised(edge)
    got = pack(examples, pool=pool).collect()
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append(r)
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == [0, *np.cumsum([r.length for r in pieces])[:-1].tolist()]
        total = sum(r.length for r in pieces)
        assert total == pieces[0].stored <= 2048  # no padding at all
        assert len(pieces) <= 128 and all(r.loss_tokens == r.length - (r.start == 0) for r in pieces)
    want = sorted((str(doc), zlib.crc32(np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4").tobytes())) for doc, text, *_ in BASE)
    alone = [r for r in got if r.start == 0 and r.length == r.doc_tokens]
    whole = [(str(r.doc_id), zlib.crc32(r.ids)) for r in alone]
    parts = defaultdict(dict)
    for r in got:
        if r.length < r.doc_tokens:
            assert parts[r.doc_id, r.doc_tokens].setdefault((r.start, len([x for x in parts[r.doc_id, r.doc_tokens] if x[0] == r.start])), r.ids) == r.ids
    # ids 1 to 12 are single rows or repeat one text, so that their pieces join by start
    for (doc, n), pieces in parts.items():
        if doc not in (None, 10):
            raw = b"".join(ids for _, ids in sorted(pieces.items()))
            assert len(raw) == 4 * n
            whole.append((str(doc), zlib.crc32(raw)))
    known = {d for d, _ in whole}
    assert set(whole) <= set(want) and known >= {str(d) for d, *_ in BASE if d not in (None, 10)}
    assert sum(r.length for r in got) == sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, *_ in BASE)


def test_a_long_text_has_the_ids_of_its_slices(tokenizer):
    text = LONG + " <|endoftext|> x  y\n z " + "q" * 3000 + LONG
    assert [i for s in slices(text, 1000) for i in tokenizer.encode(s, add_special_tokens=False).ids] == tokenizer.encode(text, add_special_tokens=False).ids
    assert slices("", 5) == [""] and "".join(slices("a b c d", 2)) == "a b c d"


def test_instruction_data_keeps_examples_whole(spark):
    """Prompts without loss, answers with: limits on all three dimensions, no cuts."""
    r = np.random.default_rng(5)
    rows = [(k, bytearray(np.arange(n, dtype="<u4").tobytes()), [(int(p), int(n))]) for k, (n, p) in enumerate((int(n), int(n * f)) for n, f in zip(r.integers(2, 300, 400), r.random(400)))]
    examples = spark.createDataFrame(rows, "conv string, ids binary, turns array<struct<start:bigint,end:bigint>>").repartition(4)
    got = pack(examples, "conv", "ids", "turns", max_tokens=512, max_segments=5, max_loss=200, cut=False, pool=64)
    per = got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count("*").alias("segments"), F.sum("loss_tokens").alias("loss"), F.max("stored").alias("stored"))
    assert per.filter("n > 512 OR segments > 5 OR loss > 200 OR stored < n").count() == 0
    over = {str(k) for k, (_, ids, turns) in enumerate(rows) if turns[0][1] - turns[0][0] > 200}
    pieces = {x.doc_id: x.n for x in got.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert len(pieces) == 400 and {d for d, n in pieces.items() if n > 1} == over
    assert pack(examples.withColumn("turns", F.lit(None).cast("array<struct<start:bigint,end:bigint>>")), "conv", loss_col="turns").agg(F.sum("loss_tokens")).first()[0] == sum(len(x[1]) // 4 for x in rows)


def test_empty_table_and_empty_examples(spark, empty):
    assert pack(tokenised(empty)).collect() == []
    none = spark.createDataFrame([(1, None), (2, bytearray())], "doc_id bigint, ids binary")
    assert pack(none, loss_col=None).collect() == []
    with pytest.raises(ValueError):
        Pool(0, 1, 1, True)
