"""I/O readers, result store, reporting operators, ML extras."""

import math
import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwork.operators import ml as M
from siftwork.operators import report as RP
from siftwork.operators import store as ST
from siftwork.sources import io as IO
from siftwork.sources.dimensions import read_prices_json, read_questions_csv


def _tmp(name):
    return os.path.join(tempfile.mkdtemp(prefix="sw-io-"), name)


def test_questions_csv_with_embedded_quotes(spark):
    p = _tmp("q.csv")
    with open(p, "w", encoding="utf-8") as f:
        f.write('id,question,category,include_exclude,notes\n'
                'I1,"Is it a trial (RCT, CCT)?",design,include,"like ""I3""; see\nnext line"\n'
                'E1,Animals only?,population,exclude,\n')
    rows = read_questions_csv(spark, p).collect()
    assert [r.id for r in rows] == ["I1", "E1"]
    assert rows[0].question == "Is it a trial (RCT, CCT)?" and rows[0].notes == 'like "I3"; see\nnext line'


def test_prices_json(spark):
    p = _tmp("prices.json")
    with open(p, "w") as f:
        f.write('{"m-a": {"COST_PER_1M_TOKENS_INPUT": 0.25, "COST_PER_1M_TOKENS_OUTPUT": 2},'
                ' "m/b": {"COST_PER_1M_TOKENS_INPUT": 0.0, "COST_PER_1M_TOKENS_OUTPUT": 0.0}}')
    got = {r.model: (r.usd_per_1m_in, r.usd_per_1m_out) for r in read_prices_json(spark, p).collect()}
    assert got == {"m-a": (0.25, 2.0), "m/b": (0.0, 0.0)}


def test_papers_csv_required_columns(spark):
    p = _tmp("papers.csv")
    with open(p, "w") as f:
        f.write('id,title,abstract,included\n1,"A, b","x\ny",True\n')
    df = IO.read_papers_csv(spark, p, label_col="included").collect()
    assert df[0].title == "A, b" and df[0].abstract == "x\ny" and df[0].label == "True"
    with pytest.raises(ValueError):
        IO.read_papers_csv(spark, p, label_col="nope")


def test_runs_file_names(spark):
    d = tempfile.mkdtemp(prefix="sw-runs-")
    for name in ("gpt-5-mini_run1.csv", "gpt-5-mini_run2.csv", "gemini-2.5-pro_run10.csv"):
        with open(os.path.join(d, name), "w") as f:
            f.write("id,decision\n1,YES\n2,NO\n")
    got = {(r.model, r.run) for r in IO.read_runs_csv(spark, d + "/*.csv").collect()}
    assert got == {("gpt-5-mini", 1), ("gpt-5-mini", 2), ("gemini-2.5-pro", 10)}


def test_answer_dir_defaults_and_empty(spark):
    d = tempfile.mkdtemp(prefix="sw-ans-")
    with open(os.path.join(d, "7_I2.json"), "w") as f:
        f.write('{\n "paper_id": 7,\n "question_id": "I2",\n "response": "YES",\n "model": "m"\n}')
    rows = IO.read_answer_dir(spark, d, one_object_per_file=True).collect()
    assert rows[0].input_tokens == 0 and rows[0].response == "YES"
    assert IO.read_answer_dir(spark, tempfile.mkdtemp()).count() == 0


def test_json_safe(spark):
    df = spark.createDataFrame([(float("nan"), float("inf"), 1.5)], "a double, b double, c double")
    r = IO.json_safe(df).collect()[0]
    assert (r.a, r.b, r.c) == (None, "inf", "1.5")


def test_first_n(spark):
    df = spark.range(10)
    assert IO.first_n(df, -1).count() == 10 and [r.id for r in IO.first_n(df, 3).collect()] == [0, 1, 2]


def test_result_store_roundtrip_and_keys(spark):
    path = _tmp("store")
    folds = spark.createDataFrame([("e", "lr", 0, 0.9), ("e", "lr", 1, 0.8)],
                                  "embedding_model string, classifier string, fold int, roc_auc double")
    ck = ST.config_hash("lr", {"C": 1}, n_splits=5)
    assert ck == ST.config_hash("lr", {"C": 1}, n_splits=5) != ST.config_hash("lr", {"C": 2}, n_splits=5)
    ST.save_results(folds, path, "d1", ck)
    assert ST.load_results(spark, path, "d1", ck).count() == 2
    assert ST.load_results(spark, path, "d2", ck) is None
    ST.save_results(folds.where("fold = 0"), path, "d1", ck)   # replace same key
    assert ST.load_results(spark, path, "d1", ck).count() == 1
    assert ST.list_results(spark, path).count() == 1
    ST.clear_results(spark, path)
    assert ST.load_results(spark, path, "d1", ck) is None


def test_data_hash_order_free(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id long, t string")
    b = spark.createDataFrame([(2, "y"), (1, "x")], "id long, t string").repartition(3)
    assert ST.data_hash_value(a, ["id", "t"]) == ST.data_hash_value(b, ["id", "t"])


def test_top_k_and_describe(spark):
    df = spark.createDataFrame([(i, float(i), float(10 - i)) for i in range(5)], "fold long, m1 double, m2 double")
    top = {(r.metric, r.rank): r.fold for r in RP.top_k_by_metric(df, ["fold"], ["m1", "m2"], 2).collect()}
    assert top == {("m1", 1): 4, ("m1", 2): 3, ("m2", 1): 0, ("m2", 2): 1}
    long = RP.unpivot_metrics(df, ["fold"], ["m1"])
    d = RP.describe(long, "metric", "value", digits=None).collect()[0]
    assert (d["count"], d.mean, d.q25, d.q50, d["max"]) == (5, 2.0, 1.0, 2.0, 4.0)
    assert d.std == pytest.approx(math.sqrt(2.5))


def test_seed_ensemble_and_importance(spark):
    runs = spark.createDataFrame([(1, True, 0.2), (1, True, 0.4), (2, False, 0.1)], "id long, label boolean, score double")
    got = {r.id: r.score for r in M.seed_ensemble(runs).collect()}
    assert got == {1: pytest.approx(0.3), 2: pytest.approx(0.1)}


def test_forest_importance_and_grid_search(spark):
    rnd = np.random.default_rng(2)
    rows = []
    for i in range(80):
        y = bool(i % 2)
        rows.append((i, [float(y) + rnd.normal(0, 0.3), rnd.normal()], y))
    df = M.with_features(spark.createDataFrame(rows, "id long, embedding array<double>, label boolean"))
    model, _ = M.fit_score(df, df, M.random_forest(num_trees=10, max_depth=4))
    imp = M.importance_table(spark, model.stages[-1] if hasattr(model, "stages") else model, ["a", "b"]).collect()
    assert imp[0].feature == "a" and imp[-1].cumulative_share == pytest.approx(1.0)
    from pyspark.ml.classification import RandomForestClassifier
    est = RandomForestClassifier(featuresCol="features", labelCol="_y", weightCol="weight", numTrees=5, seed=1)
    m, scores = M.grid_search(df, est, {"maxDepth": [2, 3], "minInstancesPerNode": [1, 2]}, k=3, sample=3)
    assert len(scores) == 3 and all(0.0 <= s <= 1.0 for _, s in scores)


def test_hashing_encoder_store_skips_known_texts(spark):
    store = _tmp("emb")
    df = spark.createDataFrame([(1, "alpha beta"), (2, "beta gamma")], "id long, text string")
    a = M.embed_with_store(df, store, "hashing-64", M.get_encoder("hashing-64"))
    assert a.count() == 2 and len(a.collect()[0].embedding) == 64
    df2 = spark.createDataFrame([(1, "alpha beta"), (3, "delta")], "id long, text string")
    M.embed_with_store(df2, store, "hashing-64", M.get_encoder("hashing-64"))
    assert spark.read.parquet(store).count() == 3  # 'alpha beta' was not encoded twice
