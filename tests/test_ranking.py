"""Ranking metrics and thresholds: hand cases, brute force, and properties."""

import math
import random

import pytest
from pyspark.sql import functions as F

from siftwork.operators import ranking as R


def _scored(spark, labels, scores, group=None):
    rows = [(i, group or "g", bool(y), float(s)) for i, (y, s) in enumerate(zip(labels, scores))]
    return spark.createDataFrame(rows, "id long, grp string, label boolean, score double")


def _brute(labels, scores, target=0.95):
    """Straightforward numpy-free reference: curve, AUC, AP, closest-recall threshold."""
    P = sum(labels)
    N = len(labels) - P
    th = sorted(set(scores))
    pts = []
    for t in th:
        tp = sum(1 for y, s in zip(labels, scores) if y and s >= t)
        fp = sum(1 for y, s in zip(labels, scores) if not y and s >= t)
        pts.append((t, tp, fp))
    auc = None
    if P and N:
        acc = 0.0
        for y1, s1 in zip(labels, scores):
            if not y1:
                continue
            for y0, s0 in zip(labels, scores):
                if y0:
                    continue
                acc += 1.0 if s1 > s0 else (0.5 if s1 == s0 else 0.0)
        auc = acc / (P * N)
    ap = 0.0
    if P:
        prev_r = 0.0
        for t, tp, fp in sorted(pts, key=lambda p: -p[0]):
            r = tp / P
            ap += (r - prev_r) * (tp / (tp + fp))
            prev_r = r
    if P == 0:
        thr = (0.0, 0.0, False)
    else:
        recalls = [tp / P for _, tp, _ in pts] + [0.0]
        diffs = [abs(r - target) for r in recalls]
        i = diffs.index(min(diffs))
        if i == len(pts):
            thr = (min(scores) - 1e-6, 0.0, diffs[i] < 1e-6)
        else:
            thr = (pts[i][0], recalls[i], diffs[i] < 1e-6)
    return auc, ap, thr


def test_hand_case_auc_ap(spark):
    df = _scored(spark, [1, 0, 1, 0, 1, 0], [.9, .8, .7, .6, .4, .3])
    r = R.ranking_summary(R.pr_curve(df, ["grp"]), ["grp"]).collect()[0]
    assert round(r.roc_auc, 6) == 0.666667
    assert round(r.pr_auc, 6) == 0.755556


def test_no_positives(spark):
    df = _scored(spark, [0, 0, 0], [.2, .5, .9])
    r = R.evaluate_fixed_recall(df, ["grp"], 0.95).collect()[0]
    assert (r.threshold, r.actual_recall, r.recall_achievable) == (0.0, 0.0, False)
    assert r.roc_auc is None and r.pr_auc == 0.0
    w = R.wss_at_recall(df, ["grp"], 0.95).collect()[0]
    assert w.wss == 0.0


def test_all_scores_equal(spark):
    df = _scored(spark, [1, 0, 1, 0], [.5] * 4)
    c = R.pr_curve(df, ["grp"])
    assert c.count() == 1
    r = R.ranking_summary(c, ["grp"]).collect()[0]
    assert r.roc_auc == 0.5


def test_closest_recall_tie_picks_lower_threshold(spark):
    # recalls on the curve: thresholds .2 -> 1.0, .6 -> 0.9 ; |0.9-0.95| < |1.0-0.95| in doubles
    labels = [1] * 10 + [0]
    scores = [.6] * 9 + [.2] + [.1]
    df = _scored(spark, labels, scores)
    r = R.evaluate_fixed_recall(df, ["grp"], 0.95).collect()[0]
    assert abs(0.9 - 0.95) < abs(1.0 - 0.95)
    assert r.threshold == 0.6 and r.actual_recall == pytest.approx(0.9)


def test_end_point_branch(spark):
    df = _scored(spark, [1, 0, 1], [.3, .5, .9])
    r = R.evaluate_fixed_recall(df, ["grp"], 0.0).collect()[0]
    assert r.threshold == pytest.approx(0.3 - 1e-6)
    assert r.actual_recall == 0.0 and r.recall_achievable
    assert r.tp == 2 and r.fp == 1


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    n = 60
    labels = [rnd.random() < 0.3 for _ in range(n)]
    scores = [round(rnd.random(), 1) for _ in range(n)]  # many ties
    df = _scored(spark, labels, scores)
    auc, ap, thr = _brute(labels, scores)
    r = R.evaluate_fixed_recall(df, ["grp"], 0.95).collect()[0]
    assert r.roc_auc == pytest.approx(auc)
    assert r.pr_auc == pytest.approx(ap)
    assert (r.threshold, r.recall_achievable) == (pytest.approx(thr[0]), thr[2])
    assert r.actual_recall == pytest.approx(thr[1])


def test_auc_invariant_under_monotone_map(spark):
    rnd = random.Random(7)
    labels = [rnd.random() < 0.4 for _ in range(80)]
    scores = [rnd.random() for _ in range(80)]
    a = R.ranking_summary(R.pr_curve(_scored(spark, labels, scores), ["grp"]), ["grp"]).collect()[0]
    b = R.ranking_summary(R.pr_curve(_scored(spark, labels, [math.exp(3 * s) for s in scores]), ["grp"]),
                          ["grp"]).collect()[0]
    assert a.roc_auc == pytest.approx(b.roc_auc) and a.pr_auc == pytest.approx(b.pr_auc)


def test_wss_non_increasing_in_target(spark):
    rnd = random.Random(3)
    labels = [rnd.random() < 0.3 for _ in range(100)]
    scores = [rnd.random() for _ in range(100)]
    df = _scored(spark, labels, scores)
    ws = [R.wss_at_recall(df, ["grp"], t).collect()[0].wss for t in (0.5, 0.8, 0.9, 0.95, 1.0)]
    assert ws == sorted(ws, reverse=True)


def test_fixture_numbers_event_id_folds(spark):
    """Numbers published for events grouped by event_id % 5 at sf0.01."""
    from tests.conftest import SF01
    from siftwork.sources.fixtures import scored
    s = scored(spark, SF01).withColumn("fold", F.col("id") % 5)
    r = R.evaluate_fixed_recall(s, ["fold"], 0.95).where("fold = 0").collect()[0]
    assert round(r.roc_auc, 6) == 0.492997
    assert r.threshold == 3.38 and round(r.actual_recall, 6) == 0.949109 and not r.recall_achievable
    w = R.wss_at_recall(s, ["fold"], 0.95).where("fold = 0").collect()[0]
    assert round(w.wss, 4) == 0.0695


def test_blocked_running_totals_match_window(spark):
    from pyspark.sql import Window
    from siftwork.operators.prefix import number_block, running_totals
    df = spark.range(0, 500).select((F.col("id") % 3).alias("g"), F.col("id").alias("o"),
                                    (F.col("id") % 7).alias("v"))
    got = running_totals(df, ["g"], [F.col("o").desc()], ["v"], number_block(F.col("o"), descending=True))
    w = Window.partitionBy("g").orderBy(F.col("o").desc()).rowsBetween(Window.unboundedPreceding, 0)
    exp = df.withColumn("cum_v", F.sum("v").over(w))
    assert sorted(got.collect()) == sorted(exp.collect())


def test_threshold_grid_matches_direct(spark):
    rnd = random.Random(5)
    labels = [rnd.random() < 0.3 for _ in range(200)]
    scores = [rnd.random() for _ in range(200)]
    df = _scored(spark, labels, scores)
    g = {r.threshold: r for r in R.threshold_grid(df, R.grid_thresholds(), ["grp"]).collect()}
    for t in R.grid_thresholds():
        c = R.confusion_at(df, t, ["grp"]).collect()[0]
        assert (g[t].tp, g[t].fp) == (c.tp, c.fp)
    assert R.grid_thresholds()[2] == 0.15000000000000002


@pytest.mark.parametrize("target", [0.0, 0.5, 0.95, 1.0])
def test_wss_brute_force_with_ties(spark, target):
    rnd = random.Random(11)
    n = 80
    labels = [rnd.random() < 0.3 for _ in range(n)]
    scores = [round(rnd.random(), 1) for _ in range(n)]  # large tie groups
    order = sorted(range(n), key=lambda i: (-scores[i], i))
    P = sum(labels)
    need = math.ceil(target * P)
    cum, k = 0, None
    for pos, i in enumerate(order, 1):
        cum += labels[i]
        if cum >= need:
            k = pos
            break
    exp = 0.0 if P == 0 or k is None else max(0.0, min(1.0, 1.0 - k / n))
    df = _scored(spark, labels, scores)
    for groups in (["grp"], []):
        r = R.wss_at_recall(df, groups, target).collect()[0]
        assert r.k == k and r.wss == pytest.approx(exp)
