"""Exact quantiles, sequence fingerprint, neighbour graph, keyed collection, stateful ingest, model search."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftwork.operators import clean as C
from siftwork.operators import ml as M
from siftwork.operators import ranking as R
from siftwork.operators import store as ST
from siftwork.operators import vectors as V
from siftwork.operators.graph import neighbour_graph
from siftwork.operators.quantiles import describe_exact, exact_quantiles

# ---------------------------------------------------------------- quantiles


@pytest.mark.parametrize("block_rows", [3, 100_000])
def test_quantiles_equal_numpy(spark, block_rows):
    r = np.random.default_rng(0)
    groups = {"packed": 1 - r.random(900) * 1e-9, "ties": r.integers(0, 3, 700).astype(float), "wide": np.exp(r.normal(size=500) * 200) * r.choice([-1, 1], 500),
              "one": np.array([7.0]), "two": np.array([1.0, 4.0]), "same": np.full(400, -0.5), None: r.normal(size=50)}
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("one", None), ("one", math.nan), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    qs = (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)
    got = {(x.g, x.quantile): x.value for x in exact_quantiles(df, ["g"], "v", qs, block_rows=block_rows, blocks=256).collect()}
    want = {(g, q): float(np.quantile(xs, q)) for g, xs in groups.items() for q in qs}
    assert got.keys() == want.keys()
    for key, value in want.items():
        assert got[key] == pytest.approx(value, rel=1e-12, abs=1e-300)


def test_infinite_values_and_whole_tables(spark):
    df = spark.createDataFrame([(x,) for x in [-math.inf, -math.inf, -1.0, 0.0, 1.0, 2.0, 3.0, math.inf, math.inf]], "v double")
    got = [x.value for x in exact_quantiles(df, [], "v", (0.0, 0.25, 0.5, 1.0), block_rows=1, blocks=4).orderBy("quantile").collect()]
    assert got == [-math.inf, -1.0, 1.0, math.inf]
    assert exact_quantiles(df.limit(0), [], "v").collect() == []


def test_describe_holds_no_group_in_one_buffer(spark, capsys):
    df = spark.range(1000).select(F.lit("a").alias("g"), F.col("id").cast("double").alias("v"))
    d = describe_exact(df, "g", "v", digits=None, block_rows=10)
    assert d.collect()[0][1:] == (1000, 499.5, pytest.approx(288.8194361), 0.0, 249.75, 499.5, 749.25, 999.0)
    d.explain()
    assert "percentile" not in capsys.readouterr().out.lower()


# ---------------------------------------------------------------- sequence fingerprint

def test_sequence_fingerprint_follows_the_order_and_nothing_else(spark):
    rows = [(k, f"text {k % 37}") for k in range(500)] + [(500, None)]
    one = lambda rows, parts: tuple(C.sequence_fingerprint(spark.createDataFrame(rows, "id bigint, text string").repartition(parts), ["id"]).first())
    base = one(rows, 1)
    assert base == one(rows[::-1], 7)
    swapped = [(0, rows[1][1]), (1, rows[0][1]), *rows[2:]]
    assert one(swapped, 3) != base and one(rows[:-1], 3) != base and one([(k + 9, t) for k, t in rows], 3) == base
    assert one([(0, "same"), (1, "same")], 2) == one([(5, "same"), (3, "same")], 2)
    assert one([], 1) == (0, 0, 0)
    named = spark.createDataFrame([(f"doc_{k:05d}", t) for k, t in rows], "id string, text string")
    assert tuple(C.sequence_fingerprint(named, ["id"]).first()) == base


def test_rows_without_an_id_are_not_lost(spark):
    df = spark.createDataFrame([(None, "x"), (None, "y"), (1, "z"), (None, "z"), (2, "z")], "id bigint, t string")
    got = sorted(map(tuple, C.dedup_keep_first(df, F.col("t")).collect()), key=str)
    assert got == [(1, "z"), (None, "x"), (None, "y")]


def test_nan_scores_are_refused(spark):
    df = spark.createDataFrame([(0.9, True), (math.nan, False)], "score double, label boolean")
    with pytest.raises(Exception, match="NaN"):
        R.pr_curve(df).collect()


# ---------------------------------------------------------------- neighbour graph

def low_dimensional(n, seed=0):
    r = np.random.default_rng(seed)
    return r.normal(size=(n, 24)) * 0.7 ** np.arange(24)


def test_graph_recall_with_few_distances(spark):
    v = low_dimensional(1500)
    rows = [(k * 3, [float(x) for x in v[k]]) for k in range(1500)] + [(None, [1.0] * 24), (5000, None)]
    graph = neighbour_graph(spark.createDataFrame(rows, "id bigint, embedding array<double>").repartition(4))
    got = {}
    for x in graph.neighbours.where("rank <= 3").collect():
        got.setdefault(x.id, []).append((x.rank, x.neighbor_id))
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    d = 1 - unit @ unit.T
    np.fill_diagonal(d, np.inf)
    exact = np.argsort(d, axis=1, kind="stable")[:, :3]
    asked = [k for k in range(1500) if 3 * k % 100 == 0]
    hits = sum(3 * j in {b for _, b in got[3 * k]} for k in asked for j in exact[k])
    assert hits >= 0.9 * 3 * len(asked)
    assert graph.distances < 1500 * 1499 / 2 / 4
    assert len(got) == 1500 and all(len(x) == 3 for x in got.values())


def test_graph_of_copies_and_small_tables(spark):
    same = spark.createDataFrame([(k, [1.0, 0.0]) for k in range(300)] + [(300, [0.0, 1.0])], "id bigint, embedding array<double>")
    lists = neighbour_graph(same, k=4, piece_rows=50).neighbours
    assert lists.groupBy("id").count().where("count < 1 or count > 4").count() == 0 and lists.select("id").distinct().count() == 301
    schema = "id string, embedding array<double>"
    assert neighbour_graph(spark.createDataFrame([], schema)).neighbours.collect() == []
    assert neighbour_graph(spark.createDataFrame([("a", [1.0])], schema)).neighbours.collect() == []
    two = neighbour_graph(spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 0.0])], schema)).neighbours.collect()
    assert sorted((x.id, x.neighbor_id, x.distance) for x in two) == [("a", "b", 1.0), ("b", "a", 1.0)]


def test_smote_records_parents(spark):
    v = low_dimensional(60)
    rows = [(k, [float(x) for x in v[k]], k % 4 == 0) for k in range(60)]
    s = V.smote(spark.createDataFrame(rows, "id bigint, embedding array<double>, target boolean"), 3, parents=True)
    made = [x for x in s.collect() if x.synthetic]
    assert len(made) == 30
    for x in made:
        want = v[x.parent_id] + x.share * (v[x.neighbor_id] - v[x.parent_id])
        assert x.parent_id % 4 == 0 and x.neighbor_id % 4 == 0 and np.allclose(x.embedding, want)


# ---------------------------------------------------------------- keyed collection

def test_adding_twice_leaves_one_row_per_id(spark, tmp_path):
    path, schema = str(tmp_path / "c"), "id string, embedding array<double>, label string"
    ST.create_keyed(spark, path, 8)
    assert ST.read_keyed(spark, path) is None and ST.lookup_keyed(spark, path, ["a"]) is None
    rows = spark.createDataFrame([(f"p{k}", [float(k)], "x") for k in range(100)], schema)
    ST.upsert_keyed(rows, path)
    ST.upsert_keyed(rows, path)
    ST.upsert_keyed(spark.createDataFrame([("p7", [70.0], "y"), ("q", [1.0], None), ("q", [1.0], None)], schema), path)
    got = {r.id: (r.embedding, r.label) for r in ST.read_keyed(spark, path).collect()}
    assert ST.read_keyed(spark, path).count() == len(got) == 101 and got["p7"] == ([70.0], "y") and got["p8"] == ([8.0], "x")
    assert [r.label for r in ST.lookup_keyed(spark, path, ["p7", "absent"]).collect()] == ["y"]
    assert ST.lookup_keyed(spark, path, []).collect() == []
    with pytest.raises(Exception, match="without an id"):
        ST.upsert_keyed(spark.createDataFrame([(None, [1.0], "x")], schema), path)
    ST.clear_keyed(spark, path)
    assert (ST.read_keyed(spark, path) is None or ST.read_keyed(spark, path).count() == 0)
    ST.upsert_keyed(rows, path)
    assert ST.read_keyed(spark, path).count() == 100


def test_point_lookup_reads_one_folder(spark, tmp_path):
    path = str(tmp_path / "c")
    ST.create_keyed(spark, path, 16)
    ST.upsert_keyed(spark.range(400).select("id", F.lit("v").alias("value")), path)
    hit = ST.lookup_keyed(spark, path, [123])
    files = {f.rsplit("/", 2)[1] for f in hit.inputFiles()}
    plan = hit._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "PushedFilters: [IsNotNull(id), EqualTo(id,123)]" in plan or "EqualTo(id,123)" in plan or "In(id, [123])" in plan
    assert len(files) <= 16 and hit.count() == 1


# ---------------------------------------------------------------- stateful ingest

def test_null_keys_and_repeats_across_deliveries(spark, tmp_path):
    from siftwork.streaming.streams import answer_ingest_stream
    src, tgt, ck = (str(tmp_path / x) for x in ("src", "tgt", "ck"))
    schema = "paper_id long, question_id string, response string"
    rows = spark.createDataFrame([(1, "I1", "YES"), (1, None, "NO"), (None, None, "NO")], schema)
    for want in (3, 3):
        rows.write.mode("append").parquet(src)
        assert answer_ingest_stream(spark, src, schema, tgt, ck) == want
    spark.createDataFrame([(None, "I1", "YES"), (2, None, "NO"), (1, None, "YES")], schema).write.mode("append").parquet(src)
    assert answer_ingest_stream(spark, src, schema, tgt, ck) == 5


def test_late_answers_are_dropped_under_the_watermark(spark, tmp_path):
    from siftwork.streaming.streams import answer_ingest_stream
    src, tgt, ck = (str(tmp_path / x) for x in ("src", "tgt", "ck"))
    schema = "paper_id long, question_id string, at timestamp"

    def deliver(rows):
        spark.createDataFrame(rows, "paper_id long, question_id string, day int").select(
            "paper_id", "question_id", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("day") * 86_400).alias("at")).write.mode("append").parquet(src)
        return answer_ingest_stream(spark, src, schema, tgt, ck, event_time="at", delay="3 days")

    assert deliver([(1, "a", 0), (2, "a", 10), (2, "a", 9)]) == 2
    assert deliver([(1, "a", 0), (3, "a", 6), (4, "a", 8), (2, "a", 11)]) == 3  # 3 is late, 2 is known, 4 is new
    plan_reads_target = [x for x in spark.streams.active]
    assert plan_reads_target == []


# ---------------------------------------------------------------- model search

def test_model_search_means_follow_from_the_scored_table(spark):
    from pyspark.ml.classification import RandomForestClassifier
    r = np.random.default_rng(2)
    rows = [(i, [float(i % 3 == 0) + r.normal(0, 0.6), r.normal()], bool(i % 3 == 0)) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>, label boolean")

    def forest(params, n):
        assert 70 < n <= 120
        return RandomForestClassifier(featuresCol="features", labelCol="_y", weightCol="weight", numTrees=5, seed=1, **params)

    best, model, table, scored = M.model_search(df, forest, {"maxDepth": [2, 3], "minInstancesPerNode": [1, 5]}, k=3)
    got = table.collect()
    assert len(got) == 4 and [x.selected for x in got] == [True, False, False, False]
    assert {"maxDepth": str(best["maxDepth"]), "minInstancesPerNode": str(best["minInstancesPerNode"])} == {n: got[0][n] for n in ("maxDepth", "minInstancesPerNode")}
    assert model.getMaxDepth() == best["maxDepth"]
    local = scored.toPandas()
    assert len(local) == 4 * 120
    for x in got:
        part = local[local.combination == str(x.combination)]
        recall = np.mean([(f.prediction[f.label] == 1).mean() for _, f in part.groupby("fold")])
        specificity = np.mean([(f.prediction[~f.label] == 0).mean() for _, f in part.groupby("fold")])
        assert x.recall == pytest.approx(recall) and x.specificity == pytest.approx(specificity)
    assert got[0].recall == max(x.recall for x in got)
    drawn = M.model_search(df, forest, {"maxDepth": [2, 3], "minInstancesPerNode": [1, 5]}, k=3, sample=2, metric="specificity")[2].collect()
    assert len(drawn) == 2
    with pytest.raises(ValueError):
        M.model_search(df, forest, {}, metric="accuracy")


def test_fold_weights_come_from_the_training_folds(spark):
    df = spark.createDataFrame([(i, [float(i)], i % 5 == 0) for i in range(50)], "id long, embedding array<double>, label boolean")
    folds = M.FoldTable(df, 5)
    rows, n = folds.train(2)
    got = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w")).collect()
    assert n == 40 and all(x.w == pytest.approx(20.0) for x in got)


def test_scores_fall_back_to_the_prediction(spark):
    df = spark.createDataFrame([(1.0,)], "prediction double")
    assert df.select(M._score_col(df).alias("s")).first().s == 1.0


@settings(max_examples=20, deadline=None)
@given(st.lists(st.floats(-1e300, 1e300), min_size=1, max_size=30))
def test_quantiles_of_any_numbers(spark, values):
    df = spark.createDataFrame([(x,) for x in values], "v double")
    got = exact_quantiles(df, [], "v", (0.5,), block_rows=2, blocks=4).first().value
    assert got == pytest.approx(float(np.quantile(np.array(values), 0.5)), rel=1e-9, abs=1e-300)
