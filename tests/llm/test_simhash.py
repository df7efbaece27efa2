"""SimHash: fingerprints bit by bit, links against all pairs, components against union-find."""

import random
from itertools import combinations

import pytest
import xxhash
from pyspark.sql import functions as F

from siftwork.llm.components import components
from siftwork.llm.queries import op6_simhash_near_dedup
from siftwork.llm.simhash import fingerprints, near_duplicates, near_pairs, simhash
from tests.llm.conftest import BASE, LONG, documents


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    grams = [" ".join(words[k:k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprints_match_the_definition(edge):
    got = sorted(((r.doc_id, r.fp & (1 << 64) - 1) for r in fingerprints(edge).collect()), key=str)
    assert got == sorted(((r[0], brute_fingerprint(r[1])) for r in BASE), key=str)


def test_hash_is_sparks_own(spark):
    """XXH64 with seed 42 over UTF-8 bytes is also Spark's xxhash64 of a string."""
    text = "one two three"
    assert simhash(text.encode()) == spark.range(1).select(F.xxhash64(F.lit(text))).first()[0]


def test_slabs_of_a_long_text(monkeypatch):
    whole = simhash(LONG.encode())
    monkeypatch.setattr("siftwork.llm.simhash._SLAB", 100)
    assert simhash(LONG.encode()) == whole


@pytest.mark.parametrize("max_bits", [0, 1, 2])
@pytest.mark.parametrize("bucket_limit", [1, 4, 1000])
def test_links_connect_exactly_the_close_fingerprints(spark, max_bits, bucket_limit):
    r = random.Random(5)
    centres = [r.getrandbits(64) for _ in range(12)]
    fps = {c ^ sum(1 << b for b in r.sample(range(64), r.randrange(4))) for c in centres for _ in range(25)} | {0, 1, 3, 1 << 63, (1 << 64) - 1}
    fps = [signed(x) for x in fps]
    close = {(a, b) for a, b in combinations(sorted(fps), 2) if bin((a ^ b) & (1 << 64) - 1).count("1") <= max_bits}
    df = spark.createDataFrame([(x,) for x in fps], "fp bigint").repartition(4)
    links = [(x.a, x.b) for x in near_pairs(df, max_bits=max_bits, bucket_limit=bucket_limit).collect()]
    if bucket_limit == 1000:
        assert {(min(p), max(p)) for p in links} == close
    else:
        assert all(bin((a ^ b) & (1 << 64) - 1).count("1") <= 2 for a, b in links)
    assert roots(fps, links) == roots(fps, close)


def test_components_of_chains_stars_and_loops(spark, tmp_path):
    r = random.Random(2)
    edges = [(k, k + 1) for k in range(100, 160)] + [(1000, k) for k in range(1001, 1400)] + [(7, 7), (9, 8), (8, 9), (8, 9)]
    edges += [(r.randrange(2000, 2300), r.randrange(2000, 2300)) for _ in range(180)]
    df = spark.createDataFrame(edges + [(None, 3)], "a bigint, b bigint")
    got = {x.node: x.component for x in components(df, str(tmp_path)).collect()}
    want = roots({n for e in edges for n in e}, edges)
    assert {n: got.get(n, n) for n in want} == want
    assert set(got) <= set(want)


def test_components_match_brute_force(edge):
    fps = [(r[0], signed(brute_fingerprint(r[1]))) for r in BASE]
    linked = roots({f for _, f in fps}, [(a, b) for (_, a), (_, b) in combinations(fps, 2) if bin((a ^ b) & (1 << 64) - 1).count("1") <= 2])
    first = {}
    for doc_id, fp in fps:
        if doc_id is not None:
            first[linked[fp]] = min(doc_id, first.get(linked[fp], doc_id))
    got = sorted(((r.doc_id, r.component_id) for r in near_duplicates(edge).collect()), key=str)
    assert got == sorted(((d, first[linked[f]]) for d, f in fps), key=str)


def test_empty_table_and_query_columns(spark, empty, tmp_path):
    assert near_duplicates(empty).collect() == []
    documents(spark, BASE[:6]).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in op6_simhash_near_dedup(spark, str(tmp_path)).collect()}
    assert rows[4].fingerprint == rows[5].fingerprint == "0" * 16 and rows[5].component_id == 4
    assert rows[1].component_id == rows[2].component_id == 1
