"""Splits, vectors, the batch answer job, streaming, ML invariants, driver contract."""

import os
import random
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwork.operators import llm as L
from siftwork.operators import ml as M
from siftwork.operators import split as SP
from siftwork.operators import vectors as V


def _labelled(spark, n=103, share=0.3, seed=1):
    rnd = random.Random(seed)
    return spark.createDataFrame([(i, rnd.random() < share) for i in range(n)], "id long, label boolean")


def test_folds_disjoint_complete_balanced(spark):
    df = _labelled(spark)
    f = SP.stratified_folds(df, 5).collect()
    assert sorted(r.id for r in f) == list(range(103))
    for lab in (True, False):
        counts = [sum(1 for r in f if r.label == lab and r.fold == k) for k in range(5)]
        assert max(counts) - min(counts) <= 1


def test_holdout_fractions(spark):
    df = _labelled(spark, 200)
    h = SP.holdout_split(df, test=0.2, val=0.2).groupBy("split").count().collect()
    got = {r.split: r["count"] for r in h}
    assert sum(got.values()) == 200 and abs(got["test"] - 40) <= 2 and abs(got["val"] - 40) <= 2


def test_balanced_sample_quota_and_negative(spark):
    df = _labelled(spark, 100, 0.5)
    s = SP.balanced_sample(df, 20, 0.25).collect()
    assert len(s) == 20 and len({r.id for r in s}) == 20
    assert sum(r.label for r in s) >= 5
    allpos = spark.createDataFrame([(i, i < 30) for i in range(31)], "id long, label boolean")
    s2 = SP.balanced_sample(allpos, 10, 1.0).collect()
    assert len(s2) == 10 and sum(not r.label for r in s2) == 1


def test_zero_vector_unchanged(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "embedding array<double>")
    got = [r.embedding for r in V.normalize(df).collect()]
    assert got[0] == [0.0, 0.0] and got[1] == pytest.approx([0.6, 0.8])


def test_knn_matches_brute_force_with_tiles(spark):
    rnd = np.random.default_rng(3)
    vecs = rnd.normal(size=(57, 5)).round(1)
    vecs[10] = vecs[11]  # an exact tie
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "id long, embedding array<double>")
    got = V.nearest_neighbours(df, df, 4, tile_rows=9).collect()
    nrm = np.linalg.norm(vecs, axis=1)
    d = 1 - (vecs @ vecs.T) / np.outer(nrm, nrm)
    for q in range(57):
        exp = sorted(((d[q, j], j) for j in range(57) if j != q))[:4]
        mine = sorted((r.rank, r.neighbor_id) for r in got if r.query_id == q)
        assert [j for _, j in mine] == [j for _, j in exp]


def test_smote_reaches_parity(spark):
    rnd = np.random.default_rng(0)
    rows = [(i, rnd.normal(size=4).tolist(), i % 5 == 0) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>, target boolean")
    out = V.smote(df, 3)
    c = {(r.target, r.synthetic): r["count"] for r in out.groupBy("target", "synthetic").count().collect()}
    assert c[(True, False)] + c[(True, True)] == c[(False, False)] == 48


def test_answer_job_resumes(spark):
    papers = spark.createDataFrame([(i, f"t{i}", f"a{i}") for i in range(6)], "id long, title string, abstract string")
    store = os.path.join(tempfile.mkdtemp(prefix="sw-store-"), "answers")
    qs = [("I1", "Q one"), ("E1", "Q two")]
    first = L.run_answer_job(papers, qs, store)
    assert first == {"processed": 12, "failed": 0, "skipped": 0, "stored": 12}
    second = L.run_answer_job(papers, qs, store)  # nothing left to do
    assert second["processed"] == 0 and second["skipped"] == 12


def test_answer_ingest_stream_dedups(spark):
    from siftwork.streaming.streams import answer_ingest_stream
    base = tempfile.mkdtemp(prefix="sw-stream-")
    src, tgt, ck = (os.path.join(base, x) for x in ("src", "tgt", "ck"))
    schema = "paper_id long, question_id string, response string"
    spark.createDataFrame([(1, "I1", "YES"), (1, "I1", "NO"), (2, "I1", "NO")], schema).write.parquet(src + "/a")
    assert answer_ingest_stream(spark, src + "/*", schema, tgt, ck) == 2
    spark.createDataFrame([(2, "I1", "YES"), (3, "I1", "NO")], schema).write.parquet(src + "/b")
    assert answer_ingest_stream(spark, src + "/*", schema, tgt, ck) == 3


def test_logreg_scores_are_probabilities_and_beat_prior(spark):
    rnd = np.random.default_rng(1)
    rows = []
    for i in range(120):
        y = i % 3 == 0
        v = rnd.normal(size=4) + (2.0 if y else 0.0)
        rows.append((i, v.tolist(), y))
    df = spark.createDataFrame(rows, "id long, embedding array<double>, label boolean")
    scored = M.cross_val_scored(df, M.logreg(max_iter=50), 3).collect()
    assert len(scored) == 120 and all(0.0 <= r.score <= 1.0 for r in scored)
    from siftwork.operators import ranking as R
    s = spark.createDataFrame([(r.id, r.label, r.score) for r in scored], "id long, label boolean, score double")
    assert R.ranking_summary(R.pr_curve(s, [])).collect()[0].roc_auc > 0.8


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 5 and "roc_auc" in df.columns
    assert set(E.oracle_sql()) <= set(E.queries())


def test_block_kernel_chunks_and_ties():
    import pandas as pd
    from siftwork.operators.vectors import _block_topk
    rnd = np.random.default_rng(7)
    q = rnd.normal(size=(11, 3)).round(1)
    c = np.vstack([q, q[:4]])                      # duplicates -> exact distance ties
    qdf = pd.DataFrame({"qid": np.arange(11), "qv": list(q)})
    cdf = pd.DataFrame({"cid": np.arange(15), "cv": list(c)})
    got = _block_topk(3, True, chunk_rows=4)(qdf, cdf)
    nq, nc = np.linalg.norm(q, axis=1), np.linalg.norm(c, axis=1)
    d = 1 - (q @ c.T) / np.outer(nq, nc)
    for i in range(11):
        exp = [j for _, j in sorted((d[i, j], j) for j in range(15) if j != i)[:3]]
        assert list(got[got.query_id == i].sort_values(["distance", "neighbor_id"]).neighbor_id) == exp


def test_answer_ingest_stream_from_json(spark):
    from siftwork.streaming.streams import answer_ingest_stream
    base = tempfile.mkdtemp(prefix="sw-jstream-")
    src, tgt, ck = (os.path.join(base, x) for x in ("src", "tgt", "ck"))
    schema = "paper_id long, question_id string, response string"
    spark.createDataFrame([(1, "I1", "YES"), (1, "I1", "YES"), (4, "E2", "NO")], schema).write.json(src)
    assert answer_ingest_stream(spark, src, schema, tgt, ck, fmt="json") == 2


@pytest.mark.parametrize("n, share", [(0, 0.5), (1, -1), (7, 0.5), (20, 0.25), (60, 1.0), (90, 0.6), (500, 0.1)])
def test_balanced_sample_equals_the_ranked_one(spark, monkeypatch, n, share):
    """Cuts selected from prefix counts against ranks in plain Python; a few rows a prefix, so several passes are made."""
    import hashlib
    import math
    monkeypatch.setattr(SP, "_FEW", 1)
    rows = [(i, None if i % 11 == 0 else i % 3 == 0) for i in range(140)]
    got = SP.balanced_sample(spark.createDataFrame(rows, "id long, label boolean").repartition(5), n, share).orderBy("sample_order").collect()
    by = lambda r, seed=42: hashlib.md5(f"{r[0]}:{seed}".encode()).hexdigest()
    ordered = sorted(rows, key=by)
    want = [r for r in ordered if r[1]][:math.ceil(n * share) if share != -1 else 0]
    want += [r for r in ordered if r not in want][:max(0, n - len(want))]
    want.sort(key=by)
    if want and all(y is not False for _, y in want) and any(y for _, y in want):
        want[-1] = min((r for r in rows if r[1] is False), key=lambda r: by(r, 43))
    assert [(r.id, r.label) for r in got] == want and [r.sample_order for r in got] == list(range(len(want)))


def test_balanced_sample_of_repeated_and_null_ids(spark):
    """Rows of one id on both sides of a cut: the sample still has exactly n rows."""
    rows = [(1, True)] * 30 + [(2, False)] * 30 + [(None, False)] * 30
    df = spark.createDataFrame(rows, "id long, label boolean")
    for n in (10, 45, 90, 200):
        got = SP.balanced_sample(df, n, 0.3).collect()
        assert len(got) == min(n, 90) and sum(r.label for r in got) >= min(30, math_ceil(n * 0.3))


def math_ceil(x):
    return -int(-x // 1)


def test_refit_on_kept_features(spark):
    """A feature that says nothing goes: the forest on the kept ones ranks the test rows as well."""
    rnd = random.Random(5)
    rows = [(i, i % 3 == 0, float(i % 3 == 0) + rnd.random() * 0.5, rnd.random(), rnd.random()) for i in range(150)]
    wide = spark.createDataFrame(rows, "id long, label boolean, a double, b double, c double")
    scored, importance = M.refit_on_kept(wide, ["a", "b", "c"], ["a"], M.random_forest(num_trees=10, max_depth=4))
    by_set = {s: sorted((r.score, r.label) for r in scored.where(F.col("feature_set") == s).collect()) for s in ("all", "kept")}
    assert len(by_set["all"]) == len(by_set["kept"]) == 30
    assert all(not y for _, y in by_set["kept"][:20]) and all(y for _, y in by_set["kept"][20:])
    assert {(r.feature_set, r.feature) for r in importance.collect()} == {("all", "a"), ("all", "b"), ("all", "c"), ("kept", "a")}
    with pytest.raises(ValueError):
        M.refit_on_kept(wide, ["a"], ["z"], M.random_forest())


def test_forest_points_are_spread_over_tasks_of_bounded_size(spark):
    """A forest's training points, far larger than the rows they come from, go to as many partitions as they need, rows in an
    order of their own; a small table keeps its one partition."""
    from pyspark.ml.classification import RandomForestClassifier

    class Stopped(Exception):
        pass

    class Seen(RandomForestClassifier):
        def _fit(self, rows):
            raise Stopped([[(r.id, r["_y"]) for r in part] for part in rows.select("id", "_y").rdd.glom().collect()])

    def seen(run, trees):
        with pytest.raises(Stopped) as got:
            run(lambda n: Seen(featuresCol="features", labelCol="_y", weightCol="weight", numTrees=trees))
        return got.value.args[0]

    rows = [(i, i % 3 == 0, [float(i % 2), float(i % 5), 1.0]) for i in range(400)]
    train = M.with_features(spark.createDataFrame(rows, "id long, label boolean, embedding array<double>").coalesce(1))
    folds = M.FoldTable(train, 4, vec="features")
    for run, n in ((lambda make: M.fit_score(train, train, make), 400), (lambda make: folds.fit(make, 0), folds.train(0)[1])):
        few, many = seen(run, 10), seen(run, 60_000)
        assert len([p for p in few if p]) == 1
        assert max(map(len, many)) <= 110  # 720 KB a row, 64 MB a task
        assert len({r for p in many for r in p}) == sum(map(len, many)) == n
        assert sorted(r for p in many for r in p) == sorted(r for p in few for r in p)
