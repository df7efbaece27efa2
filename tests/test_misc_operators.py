"""Operators not covered elsewhere: scans, collection table, lookup, filters,
calibrated SVM, boosted trees, reporting helpers."""

import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwork.operators import ml as M
from siftwork.operators import report as RP
from siftwork.operators import store as ST
from siftwork.operators import vectors as V
from siftwork.sources import io as IO


def test_indexed_and_tagged_csv(spark):
    d = tempfile.mkdtemp(prefix="sw-csv-")
    with open(os.path.join(d, "idx.csv"), "w") as f:
        f.write(",paper_id,score\n0,10,0.5\n1,11,0.7\n")
    df = IO.read_indexed_csv(spark, os.path.join(d, "idx.csv"))
    assert df.columns[0] == "row_id" and df.count() == 2
    t = os.path.join(d, "tagged")
    os.makedirs(t)
    for name in ("openai_zero_shot.csv", "gemini_few_shot_similar.csv"):
        with open(os.path.join(t, name), "w") as f:
            f.write("id,decision\n1,YES\n")
    got = {r.provider for r in IO.read_tagged_csv(spark, t + "/*.csv").collect()}
    assert got == {"openai_zero_shot", "gemini_few_shot_similar"}
    ps = spark.createDataFrame([("gemini_few_shot_similar",)], "n string")
    prov, strat = IO.parse_provider_strategy(F.col("n"))
    r = ps.select(prov.alias("p"), strat.alias("s")).collect()[0]
    assert (r.p, r.s) == ("gemini", "few_shot_similar")


def test_union_tagged(spark):
    a = spark.createDataFrame([(1, 0.5)], "id long, auc double")
    b = spark.createDataFrame([(2,)], "id long")
    u = IO.union_tagged({"a": a, "b": b}).collect()
    assert {(r.id, r.provider, r.auc) for r in u} == {(1, "a", 0.5), (2, "b", None)}


def test_collection_lookup_and_not_contains(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="sw-coll-"), "c")
    v = spark.createDataFrame([(1, [1.0, 0.0], True, "alpha beta"), (2, [0.0, 1.0], False, "beta gamma"),
                               (3, [1.0, 1.0], False, "delta")],
                              "id long, embedding array<double>, label boolean, text string")
    ST.add_to_collection(v, path)
    info = {r.label: r.n_items for r in ST.collection_info(spark, path).collect()}
    assert info == {True: 1, False: 2}
    assert V.lookup(v, 2).collect()[0].text == "beta gamma"
    with pytest.raises(KeyError):
        V.lookup(v, 9)
    assert sorted(r.id for r in V.exclude_containing(v, "text", "beta").collect()) == [3]
    nn = V.nearest_by_label(v, v, 1, label="label", labels=(True, False)).collect()
    got = {(r.query_id, r.group_order): r.neighbor_id for r in nn}
    assert got[(3, 0)] == 1 and got[(1, 1)] == 3   # label-filtered corpora, self excluded


def _separable(spark, n=90, seed=3):
    rnd = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        y = i % 3 == 0
        rows.append((i, (rnd.normal(size=3) + (1.5 if y else 0.0)).tolist(), y))
    return spark.createDataFrame(rows, "id long, embedding array<double>, label boolean")


def test_svm_platt_probabilities(spark):
    df = M.with_features(_separable(spark))
    train, test = df.where("id % 4 <> 0"), df.where("id % 4 = 0")
    out = M.svm_platt(3, 50)(train, test).collect()
    assert len(out) == test.count() and all(0.0 <= r.score <= 1.0 for r in out)
    pos = np.mean([r.score for r in out if r.label])
    neg = np.mean([r.score for r in out if not r.label])
    assert pos > neg


def test_boosted_trees_fit(spark):
    df = M.with_features(_separable(spark))
    _, pred = M.fit_score(df, df, M.boosted_trees(max_iter=5, depth=3))
    rows = pred.select("label", "score").collect()
    assert len(rows) == 90 and all(0.0 <= r.score <= 1.0 for r in rows)


def test_report_helpers(spark):
    a = spark.createDataFrame([(0.8, 0.6)], "recall double, precision double")
    b = spark.createDataFrame([(0.9, 0.5)], "recall double, precision double")
    t = {(r.approach, r.metric): r.value for r in RP.approach_table({"all": a, "filtered": b},
                                                                    ["recall", "precision"]).collect()}
    assert t[("filtered", "recall")] == 0.9 and t[("all", "precision")] == 0.6
    lb = spark.createDataFrame([("m1", 0.7, 0.9), ("m2", 0.7, 0.95), ("m3", 0.8, 0.1)], "m string, pr double, roc double")
    assert [r.m for r in RP.leaderboard(lb, ["pr", "roc"]).collect()] == ["m3", "m2", "m1"]
    s = spark.createDataFrame([(5, True, 0.7), (6, False, 0.2)], "id long, label boolean, score double")
    e = {r.paper_id: (r.y_true, r.y_pred) for r in RP.export_predictions(s, 0.5).collect()}
    assert e == {5: (1, 1), 6: (0, 0)}
