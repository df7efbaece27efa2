"""Sharding: the law of near equal bytes, gapless slots, groups of copies."""

import zlib

import pytest
from pyspark.sql import functions as F

from siftwork.llm.sharding import FIXED_BYTES, _range_of, _splitters, shard
from tests.llm.conftest import BASE, documents


def laws(got, shards, slack):
    assert all(0 <= r["shard"] < shards for r in got)
    sizes, slots = [0] * shards, [[] for _ in range(shards)]
    for r in got:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    mean = sum(sizes) / shards
    assert max(abs(s - mean) for s in sizes) <= slack(mean)
    return sizes


def test_edge_rows(edge, empty):
    got = shard(edge, shards=4).collect()
    want = sorted(((r[0], len((r[1] or "").encode()) + FIXED_BYTES, zlib.crc32((r[1] or "").encode())) for r in BASE), key=str)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=str) == want
    laws(got, 4, lambda mean: max(r[1] for r in want))
    assert shard(empty).collect() == []


@pytest.mark.parametrize("rows_per_range", [50, 500_000])
def test_equal_bytes_with_a_hot_group_and_giants(spark, rows_per_range):
    docs = spark.range(9000).selectExpr(
        "id doc_id", "case when id % 3 = 0 then repeat('hot ', 50) when id % 500 = 1 then repeat(concat('giant', id), 500) else repeat(concat('t', id), cast(id % 60 as int)) end text")
    got = shard(docs, shards=40, rows_per_range=rows_per_range).collect()
    assert len(got) == 9000
    laws(got, 40, lambda mean: 5000 + 0.01 * mean)


def test_a_hot_key_is_found_and_subdivided(spark):
    """Its quantiles must be its key exactly; short copies are heavy in rows, not in bytes."""
    docs = spark.range(8000).selectExpr("id doc_id", "if(id % 3 = 0, 'hot', concat('text ', id, repeat(' filler', 30))) text")
    rows = docs.selectExpr("length(text) + 16L size", "shiftright(xxhash64(text), 11) key", "xxhash64('spread', doc_id) spread")
    splitters = _splitters(rows, 100, 64)
    hot = rows.filter("size < 30").first().key
    assert splitters.count(hot) >= 10
    band, pieces = _range_of(splitters)
    sizes = rows.withColumn("band", band).withColumn("piece", F.floor(F.shiftrightunsigned("spread", 11) / float(1 << 53) * pieces)).groupBy("band", "piece").count()
    assert sizes.agg(F.max("count")).first()[0] <= 300


def test_copies_stay_together_unless_they_fill_a_shard(spark):
    docs = spark.range(8000).selectExpr("id doc_id", "concat('text ', id div 4, repeat(' filler', 20)) text")
    got = shard(docs, shards=10, group_share=0.01)
    together = got.groupBy("text_crc32").agg(F.countDistinct("shard").alias("n")).filter("n > 1").count()
    assert together == 0
    laws(got.collect(), 10, lambda mean: 0.02 * mean)


def test_result_does_not_depend_on_the_partitioning(spark):
    docs = documents(spark, [(k, f"text {k % 50} " * (k % 9), "en", "a") for k in range(600)])
    first, second = (sorted(map(tuple, shard(d, shards=7).collect())) for d in (docs.repartition(2), docs.repartition(9, "source", "doc_id")))
    assert first == second


def test_no_python_in_the_plan(edge, capsys):
    shard(edge, shards=4).explain()
    assert not any(x in capsys.readouterr().out for x in ("Python", "Pandas", "Arrow"))


def test_rows_without_an_id_are_spread(spark):
    docs = documents(spark, [(None, "one very common text", "en", "a")] * 3000 + [(k, f"text {k}", "en", "a") for k in range(300)])
    got = shard(docs.repartition(3), shards=8).collect()
    sizes = [0] * 8
    for r in got:
        sizes[r.shard] += r.size
    assert len(got) == 3300 and max(sizes) - min(sizes) < 0.1 * max(sizes)
