"""Raking against a plain loop; the draw and the shares it meets."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from siftwork.llm.mixing import OTHER, RATE, TARGETS, Flattened, mix, mixed, topic, words
from tests.llm.conftest import BASE, documents

TWO = {"source": {"a": 0.2, "b": 0.3}, "lang": Flattened(("en", "de"), 0.5)}


def brute(rows, targets, margins):
    """rows: (tokens, class values by margin). Returns weight by cell and the goals."""
    targets = {m: Flattened(tuple({r[k + 1] for r in rows} - {None}), t.power) if isinstance(t, Flattened) and t.values is None else t
               for k, (m, t) in enumerate(targets.items())}
    cells = defaultdict(float)
    for tokens, *values in rows:
        cells[tuple(v if v in (t.values if isinstance(t, Flattened) else t) else OTHER for v, t in zip(values, targets.values(), strict=True))] += tokens
    total = sum(cells.values())
    goals = []
    for m, t in enumerate(targets.values()):
        sums = defaultdict(float)
        for c, x in cells.items():
            sums[c[m]] += x
        shares = {v: ((s / total) ** t.power if isinstance(t, Flattened) else t.get(v, max(0.0, 1 - sum(t.values())))) for v, s in sums.items() if s > 0}
        if not isinstance(t, Flattened) and sum(t.values()) > 1 - 1e-9 and OTHER in shares:  # keeps its own share
            own, there = sums[OTHER] / total, sum(s for v, s in shares.items() if v != OTHER)
            shares[OTHER] = there * own / (1 - own) if there else 1.0
        goals.append({v: s * total / sum(shares.values()) for v, s in shares.items()})
    raked = dict(cells)
    for _ in range(2000):
        for m, goal in enumerate(goals):
            sums = defaultdict(float)
            for c, x in raked.items():
                sums[c[m]] += x
            raked = {c: x * goal.get(c[m], 0) / sums[c[m]] if sums[c[m]] else 0.0 for c, x in raked.items()}
    return {c: raked[c] / cells[c] if cells[c] else 0.0 for c in cells}, goals, total


def sample_docs(spark, n=3000):
    return spark.range(n).selectExpr(
        "id doc_id", "concat('w ', repeat('x ', cast(id * 7 % 41 as int))) text",
        "element_at(array('en', 'en', 'en', 'de', 'fr', null), cast(id div 3 % 6 + 1 as int)) lang",
        "if(id % 3 = 0, 'a', element_at(array('b', 'c', 'd', null), cast(id div 18 % 4 + 1 as int))) source", "0L n_chars")


def run(docs, targets=TWO, **options):
    margins = {"source": docs["source"], "lang": docs["lang"]}
    return mix(docs, targets=targets, margins=margins, **options).collect()


def test_weights_match_plain_raking(spark):
    docs = sample_docs(spark)
    weights, goals, total = brute([(len(r.text.split()), r.source, r.lang) for r in docs.collect()], TWO, ("source", "lang"))
    got = run(docs)
    for r in got:
        assert r.weight == pytest.approx(weights[r.by_source, r.by_lang], rel=1e-6)
        assert r.probability == pytest.approx(min(1, r.weight * RATE), rel=1e-6)
    for m, by in enumerate(("by_source", "by_lang")):
        sums = defaultdict(float)
        for r in got:
            sums[r[by]] += r.tokens * r.weight
        assert dict(sums) == pytest.approx(goals[m], rel=1e-6)


def test_draw_is_a_hash_of_the_id(spark):
    for r in run(sample_docs(spark, 300)):
        u = int(hashlib.md5(f"mix{r.doc_id}".encode()).hexdigest()[:12], 16) / 2 ** 48
        assert r.kept == (u < r.probability)


def test_sample_meets_the_targets(spark):
    docs = sample_docs(spark, 30000)
    kept = [r for r in run(docs, rate=0.2) if r.kept]
    total = sum(r.tokens for r in kept)
    for value, share in (("a", 0.2), ("b", 0.3), (OTHER, 0.5)):
        assert sum(r.tokens for r in kept if r.by_source == value) / total == pytest.approx(share, abs=0.02)


def test_edge_cases(edge, empty, spark):
    got = mix(edge).collect()
    assert len(got) == len(BASE)
    assert all(0 <= r.probability <= 1 for r in got)
    assert {r.by_lang for r in got} <= {*TARGETS["lang"], OTHER}
    assert mix(empty).collect() == []
    none = documents(spark, [(1, None, None, None), (2, "", "en", "src0")])  # no tokens at all
    assert [(r.weight, r.probability, r.kept) for r in mix(none).collect()] == [(0.0, 0.0, False)] * 2
    kept = mixed(edge)
    assert kept.columns == edge.columns


def test_targets_of_absent_classes_are_spread(spark):
    docs = documents(spark, [(k, "one two", "en", "a" if k % 2 else "b") for k in range(40)])
    got = run(docs, {"source": {"a": 0.4, "b": 0.2, "never": 0.4}, "lang": {"en": 1.0}})
    assert {r.by_source: round(r.weight, 6) for r in got} == {"a": round(4 / 3, 6), "b": round(2 / 3, 6)}


def test_bad_targets_are_refused(spark):
    with pytest.raises(ValueError):
        run(sample_docs(spark, 10), {"source": {"a": 0.8, "b": 0.7}, "lang": {"en": 1.0}})


def test_words_and_topics(spark):
    rows = spark.createDataFrame([("a b\x0bc \x1cd",), (None,), ("Licensed under X",), ("me@x.org",), ("w " * 2000,)], "t string")
    got = rows.select(words(F.col("t")).alias("n"), topic(F.col("t"), words(F.col("t"))).alias("topic")).collect()
    assert [(r.n, r.topic) for r in got] == [(4, "prose"), (0, "prose"), (3, "licence"), (1, "contact"), (2000, "longform")]


def test_no_python_in_the_plan(edge, capsys):
    mix(edge).explain()
    assert not any(x in capsys.readouterr().out for x in ("Python", "Pandas", "Arrow"))


def test_unlisted_and_null_languages_keep_their_share_of_the_corpus(spark):
    import corpus_pipeline
    langs = ["en", "en", "en", "de", "fr", "es", None, "it"]
    docs = documents(spark, [(k, "one two three", langs[k % 8], "src0") for k in range(4000)])
    targets = {"lang": TARGETS["lang"]}
    got = mix(docs, targets=targets, margins={"lang": docs["lang"]}).collect()
    raked = defaultdict(float)
    for r in got:
        raked[r.by_lang] += r.weight * r.tokens / 12_000
    assert dict(raked) == pytest.approx({OTHER: 0.25, **{v: 0.75 * s for v, s in TARGETS["lang"].items()}}, rel=1e-6)
    kept = {(r.lang, r.n) for r in corpus_pipeline.mix(spark, docs, "").groupBy("lang").agg(F.count("*").alias("n")).collect()}
    assert {v for v, n in kept if n > 0} == set(langs)
    alone = documents(spark, [(k, "one two three", None, "src0") for k in range(20)])
    assert {(r.by_lang, round(r.weight, 6), round(r.probability, 6)) for r in mix(alone).collect()} == {(OTHER, 1.0, RATE)}
    assert corpus_pipeline.mix(spark, alone, "").count() > 5


def test_one_stray_source_changes_no_other_keep_rate(spark):
    rows = [(k, "one two three four", ["en", "en", "de", "fr", "es"][k % 5], f"src{k % 7}") for k in range(5000)]
    plain = {(r.by_source, r.by_lang): r.probability for r in mix(documents(spark, rows)).collect()}
    stray = documents(spark, rows + [(9000, "one two three four", "en", "stray"), (9001, "one two three four", "en", None)])
    got = mix(stray).collect()
    for r in got:
        if r.doc_id < 9000:
            assert r.probability == pytest.approx(plain[r.by_source, r.by_lang], rel=0.02)
    assert all(r.kept for r in got if r.doc_id >= 9000) and {r.by_source for r in got if r.doc_id >= 9000} == {"stray", OTHER}


def test_margins_that_cannot_hold(spark):
    docs = documents(spark, [(k, "one two", "en" if k % 2 else "de", "a" if k % 2 else "b") for k in range(20)])
    targets = {"source": {"a": 0.9, "b": 0.1}, "lang": {"en": 0.1, "de": 0.9}}
    assert len(run(docs, targets)) == 20
    with pytest.raises(ValueError, match="can't all hold"):
        run(docs, targets, strict=True)
    with pytest.raises(ValueError):
        run(docs, rate=0.0)


def test_twin_with_unlisted_and_null_classes(spark, tmp_path):
    import duckdb
    from siftwork.llm.queries import op3_mix_sources
    from siftwork.llm.sql import MIX_SOURCES
    langs, sources = ["en", "en", "de", "fr", "es", None, "it", "pt"], ["a", "a", "a", "b", None]
    rows = [(k, "w " * (k % 9), langs[k % 8], sources[k % 5]) for k in range(800)] + [(None, None, None, None)]
    documents(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, op3_mix_sources(spark, str(tmp_path)).collect()), key=str)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.execute(MIX_SOURCES).fetchall(), key=str)
    assert [r[:5] + r[7:] for r in got] == [r[:5] + r[7:] for r in want]
    assert [r[5:7] for r in got] == [pytest.approx(r[5:7], abs=2e-6) for r in want]
