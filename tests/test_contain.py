"""Containment by rarest grams against ``in`` on every pair."""

import random

import pytest

from siftwork.operators.contain import byte_grams, containing, nearest_not_containing


def expanded(found):
    rows = found.pairs.join(found.query_classes, "query_class").join(found.doc_classes, "doc_class")
    return sorted((r.query_id, r.doc_id) for r in rows.select("query_id", "doc_id").collect())


def test_grams_are_the_byte_strings():
    assert byte_grams(b"abc", 4).tolist() == []
    assert sorted(int(x).to_bytes(3, "little") for x in byte_grams(b"abcabd", 3)) == sorted({b"abc", b"bca", b"cab", b"abd"})
    assert len(byte_grams(bytes(range(200, 230)), 8)) == 23


@pytest.mark.parametrize("bits", [1 << 10, 1 << 20])
def test_pairs_equal_all_pairs(spark, bits):
    r = random.Random(bits)
    pool = ["".join(r.choice(["the ", "ing", "é", "漢", "a", "b", " "]) for _ in range(r.randrange(1, 12))) for _ in range(25)]
    docs = [(k, "".join(r.choice(pool) for _ in range(r.randrange(8)))) for k in range(120)] + [(200, None), (201, ""), (202, "the "), (203, "the ")]
    asked = [(k, r.choice(pool)[: r.choice([1, 3, 30])]) for k in range(60)] + [(70, None), (71, ""), (72, "nowhere at all"), (73, "the "), (74, docs[3][1]), (75, "é")]
    d, q = (spark.createDataFrame(x, "id bigint, text string").repartition(5) for x in (docs, asked))
    want = sorted((a, b) for a, t in asked for b, u in docs if t and u and t in u)
    assert expanded(containing(q, d, bits=bits)) == want


def test_copies_are_one_class(spark):
    d = spark.createDataFrame([(k, "one text of many copies") for k in range(300)], "id bigint, text string")
    found = containing(d, d)
    assert found.pairs.count() == 1 and found.doc_classes.count() == 300


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "text")], "id bigint, text string")
    assert containing(d.limit(0), d).pairs.collect() == [] and containing(d, d.limit(0)).pairs.collect() == []


def test_neighbours_outside_are_complete(spark):
    """Forty of fifty texts contain query 0's text, so it has to ask again; text 49 has ids of its own only."""
    rows = [(k, "shared words" + (f" and {k}" if k else "") if k < 41 else f"other {k}", [1.0, k / 50]) for k in range(50)]
    df = spark.createDataFrame(rows, "id bigint, text string, embedding array<double>")
    got = {}
    for r in nearest_not_containing(df, df, 3).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.neighbor_id))
    assert sorted(got[0]) == [(1, 41), (2, 42), (3, 43)]
    assert all(len(got[k]) == 3 for k in range(50))
    assert sorted(x for _, x in got[20]) != sorted(x for _, x in got[0])
