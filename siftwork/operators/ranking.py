"""Tie-aware ranking metrics and recall thresholds per group, exact and distributed.

Input: a *scored* table ``(group..., label, score[, id])``; ``label`` is boolean
or 0/1. Everything below is computed from the distinct-score table
``(group..., score, pos, neg)`` (one partial-aggregated shuffle) plus blocked
running totals (see ``prefix.running_totals``), then one aggregation per
group. No group is ever collected into a single task, and no Python runs.

Conventions follow the screening study being re-implemented:
* PR curve: one point per distinct score, thresholds ascending, recall
  non-increasing, plus the end point (precision 1, recall 0).
* ROC AUC: Mann-Whitney with half credit for ties; NULL when one class is absent.
* Average precision: step sum  sum_k (R_k - R_{k-1}) * P_k; 0 without positives.
* Fixed-recall threshold: the curve point whose recall is closest to the
  target, ties to the lowest threshold; the end point wins only when strictly
  closest (threshold = min score - 1e-6, reported recall 0); no positives ->
  (0.0, 0.0, false).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.functions.expr import as_int, f_beta, nan_to_null, round_np, safe_div
from siftwork.operators.prefix import key_block, number_block, running_totals

END_POINT_EPS = 1e-6  # fixed value: offset below the minimum score for the end point
EXACT_TOL = 1e-6      # fixed value: |recall - target| below this counts as exactly reached


def _g(group_cols) -> list[str]:
    return list(group_cols or [])


def _join_totals(rows: DataFrame, tot: DataFrame, g: list[str]) -> DataFrame:
    """Attach per-group totals (one row per group; when ungrouped the single row is
    attached through scalar subqueries rather than a cartesian join)."""
    if not g:  # one row of totals: scalar subqueries, no join at all
        return rows.select("*", *[tot.select(c).scalar().alias(c) for c in tot.columns])
    cond = [rows[c].eqNullSafe(tot[c]) for c in g]
    return rows.join(tot, on=cond, how="inner").drop(*[tot[c] for c in g])


def score_counts(scored: DataFrame, group_cols=None, label: str = "label",
                 score: str = "score") -> DataFrame:
    """(group..., score, pos, neg): one row per distinct score (map-side combined). A NaN score has no place in an
    order and raises an error."""
    g = _g(group_cols)
    y = as_int(label)
    value = F.col(score)
    if dict(scored.dtypes)[score] in ("double", "float"):
        value = F.when(F.isnan(value), F.raise_error(F.lit("a score is NaN")).cast("double")).otherwise(value)
    return (scored.groupBy(*g, value.alias("score"))
            .agg(F.sum(y).cast("long").alias("pos"), F.sum(1 - y).cast("long").alias("neg")))


def pr_curve(scored: DataFrame, group_cols=None, label: str = "label", score: str = "score") -> DataFrame:
    """Per distinct score: tp/fp at threshold = score (predict score >= threshold),
    group totals P/N, precision, recall. Recall is 1 everywhere when P = 0."""
    g = _g(group_cols)
    counts = score_counts(scored, g, label, score)
    cum = running_totals(counts, g, [F.col("score").desc()], ["pos", "neg"], number_block(F.col("score"), descending=True))
    tot = counts.groupBy(*g).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"),
                                 F.min("score").alias("min_score"), F.max("score").alias("max_score"))
    j = _join_totals(cum, tot, g)
    out = j.select(*g, F.col("score").alias("threshold"), "pos", "neg",
                   F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp"), "P", "N",
                   "min_score", "max_score")
    return out.withColumn("precision", safe_div("tp", F.col("tp") + F.col("fp"))) \
              .withColumn("recall", F.when(F.col("P") == 0, F.lit(1.0)).otherwise(safe_div("tp", "P")))


def pr_curve_with_end(curve: DataFrame, group_cols=None) -> DataFrame:
    """Curve rows plus the end point per group (threshold NULL, precision 1, recall 0)."""
    g = _g(group_cols)
    end = curve.groupBy(*g).agg(F.first("P").alias("P"), F.first("N").alias("N")).select(
        *g, F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"))
    return curve.select(*g, "threshold", "precision", "recall").unionByName(end)


def _closest(target: float) -> Column:
    """Lexicographic min: closest recall, then lowest threshold."""
    return F.min(F.struct(F.abs(F.col("recall") - F.lit(float(target))).alias("diff"),
                          F.col("threshold").alias("thr"), F.col("recall").alias("rec"),
                          F.col("tp").alias("tp"), F.col("fp").alias("fp")))


def ranking_summary(curve: DataFrame, group_cols=None, targets=(0.95,)) -> DataFrame:
    """One row per (group, target_recall): P, N, roc_auc, pr_auc and the fixed-recall
    operating point (threshold, actual_recall, recall_achievable, tp, fp).

    All targets are evaluated in the same aggregation pass; the small result is
    then exploded to rows."""
    g = _g(group_cols)
    neg_below = F.col("N") - F.col("fp")
    aggs = [
        F.first("P").alias("P"), F.first("N").alias("N"),
        F.first("min_score").alias("min_score"), F.first("max_score").alias("max_score"),
        F.sum(F.col("pos") * (neg_below.cast("double") + F.col("neg") / F.lit(2.0))).alias("_auc_num"),
        F.sum(F.col("pos") * F.col("precision")).alias("_ap_num"),
        F.sum(F.when(F.col("threshold") >= 0.0, F.col("neg")).otherwise(0)).alias("_neg_ge0"),
    ]
    for i, t in enumerate(targets):
        aggs.append(_closest(t).alias(f"_best{i}"))
    s = curve.groupBy(*g).agg(*aggs)
    per_target = F.array(*[F.struct(F.lit(float(t)).alias("target_recall"), F.col(f"_best{i}").alias("best"))
                           for i, t in enumerate(targets)])
    s = s.select(*g, "P", "N", "min_score", "max_score", "_auc_num", "_ap_num", "_neg_ge0",
                 F.inline(per_target))
    pn = (F.col("P") * F.col("N")).cast("double")
    roc = F.when((F.col("P") > 0) & (F.col("N") > 0), F.col("_auc_num") / pn)
    ap = F.when(F.col("P") > 0, F.col("_ap_num") / F.col("P").cast("double")).otherwise(F.lit(0.0))
    tr = F.col("target_recall")
    no_pos = F.col("P") == 0
    end_wins = F.abs(tr) < F.col("best.diff")
    thr = (F.when(no_pos, F.lit(0.0)).when(end_wins, F.col("min_score") - F.lit(END_POINT_EPS))
           .otherwise(F.col("best.thr")))
    act = F.when(no_pos, F.lit(0.0)).when(end_wins, F.lit(0.0)).otherwise(F.col("best.rec"))
    exact = (F.when(no_pos, F.lit(False)).when(end_wins, F.abs(tr) < F.lit(EXACT_TOL))
             .otherwise(F.col("best.diff") < F.lit(EXACT_TOL)))
    tp = F.when(no_pos, F.lit(0)).when(end_wins, F.col("P")).otherwise(F.col("best.tp"))
    fp = F.when(no_pos, F.col("_neg_ge0")).when(end_wins, F.col("N")).otherwise(F.col("best.fp"))
    return s.select(*g, "target_recall", "P", "N", "min_score", "max_score",
                    roc.alias("roc_auc"), ap.alias("pr_auc"), thr.alias("threshold"),
                    act.alias("actual_recall"), exact.alias("recall_achievable"),
                    tp.cast("long").alias("tp"), fp.cast("long").alias("fp"))


def with_confusion_metrics(df: DataFrame, tp="tp", fp="fp", P="P", N="N") -> DataFrame:
    """From tp, fp and class totals: fn, tn, recall, precision, specificity, accuracy,
    f1, f2 (0 on empty denominators), support columns."""
    fn = F.col(P) - F.col(tp)
    tn = F.col(N) - F.col(fp)
    return (df.withColumn("fn", fn.cast("long")).withColumn("tn", tn.cast("long"))
            .withColumn("recall", safe_div(tp, F.col(tp) + F.col("fn")))
            .withColumn("precision", safe_div(tp, F.col(tp) + F.col(fp)))
            .withColumn("specificity", safe_div("tn", F.col("tn") + F.col(fp)))
            .withColumn("accuracy", safe_div(F.col(tp) + F.col("tn"), F.col(P) + F.col(N)))
            .withColumn("f1", f_beta(tp, fp, "fn", 1.0))
            .withColumn("f2", f_beta(tp, fp, "fn", 2.0))
            .withColumn("support_pos", F.col(P).cast("long"))
            .withColumn("support_neg", F.col(N).cast("long")))


FOLD_METRICS = ["roc_auc", "pr_auc", "f1", "f2", "accuracy", "recall", "precision", "specificity"]


def evaluate_fixed_recall(scored: DataFrame, group_cols=None, target_recall: float = 0.95,
                          label: str = "label", score: str = "score", targets=None) -> DataFrame:
    """Fold-result rows at a fixed recall: threshold tuned per group (on that group's
    own rows, as in the study), predictions score >= threshold, all metrics."""
    g = _g(group_cols)
    curve = pr_curve(scored, g, label, score)
    summ = ranking_summary(curve, g, targets or (target_recall,))
    m = with_confusion_metrics(summ)
    return m.select(*g, *FOLD_METRICS, "support_pos", "support_neg", "target_recall",
                    "actual_recall", "threshold", "recall_achievable", "tp", "fp", "fn", "tn")


def evaluate_default(scored: DataFrame, group_cols=None, label: str = "label",
                     score: str = "score") -> DataFrame:
    """Fold-result rows at the automatic threshold: 0.5 when all scores of the group lie
    in [0, 1] (probabilities), else 0.0 (margins)."""
    g = _g(group_cols)
    curve = pr_curve(scored, g, label, score)
    neg_below = F.col("N") - F.col("fp")
    s = curve.groupBy(*g).agg(
        F.first("P").alias("P"), F.first("N").alias("N"),
        F.min("threshold").alias("min_score"), F.max("threshold").alias("max_score"),
        F.sum(F.col("pos") * (neg_below.cast("double") + F.col("neg") / F.lit(2.0))).alias("_auc_num"),
        F.sum(F.col("pos") * F.col("precision")).alias("_ap_num"),
        F.sum(F.when(F.col("threshold") >= 0.5, F.col("pos")).otherwise(0)).alias("_tp_half"),
        F.sum(F.when(F.col("threshold") >= 0.5, F.col("neg")).otherwise(0)).alias("_fp_half"),
        F.sum(F.when(F.col("threshold") >= 0.0, F.col("pos")).otherwise(0)).alias("_tp_zero"),
        F.sum(F.when(F.col("threshold") >= 0.0, F.col("neg")).otherwise(0)).alias("_fp_zero"))
    prob = (F.col("min_score") >= 0.0) & (F.col("max_score") <= 1.0)
    pn = (F.col("P") * F.col("N")).cast("double")
    s = s.select(*g, "P", "N",
                 F.when((F.col("P") > 0) & (F.col("N") > 0), F.col("_auc_num") / pn).alias("roc_auc"),
                 F.when(F.col("P") > 0, F.col("_ap_num") / F.col("P").cast("double"))
                  .otherwise(F.lit(0.0)).alias("pr_auc"),
                 F.when(prob, F.lit(0.5)).otherwise(F.lit(0.0)).alias("threshold"),
                 F.when(prob, F.col("_tp_half")).otherwise(F.col("_tp_zero")).cast("long").alias("tp"),
                 F.when(prob, F.col("_fp_half")).otherwise(F.col("_fp_zero")).cast("long").alias("fp"))
    m = with_confusion_metrics(s)
    return m.select(*g, *FOLD_METRICS, "support_pos", "support_neg", "threshold",
                    "tp", "fp", "fn", "tn")


def summarise_folds(folds: DataFrame, group_cols=None, fixed_recall: bool = False) -> DataFrame:
    """Means over folds ignoring NaN/NULL (np.nanmean), `*_mean` columns; with
    fixed recall also actual_recall_mean, threshold_mean, recall_achievable_ratio."""
    g = _g(group_cols)
    aggs = [F.avg(nan_to_null(m)).alias(f"{m}_mean") for m in FOLD_METRICS]
    if fixed_recall:
        if "target_recall" not in g:
            aggs.append(F.first("target_recall").alias("target_recall"))
        aggs += [F.avg(nan_to_null("actual_recall")).alias("actual_recall_mean"),
                 F.avg(nan_to_null("threshold")).alias("threshold_mean"),
                 F.avg(F.col("recall_achievable").cast("double")).alias("recall_achievable_ratio")]
    return folds.groupBy(*g).agg(*aggs)


def recall_tradeoff(scored: DataFrame, group_cols=None, fold_col: str = "fold",
                    targets=(0.9, 0.92, 0.95, 0.97, 0.99), label: str = "label",
                    score: str = "score") -> DataFrame:
    """Recall/precision trade-off: scores computed once, every target evaluated per
    fold in one pass, then averaged over folds per (group, target)."""
    g = _g(group_cols)
    folds = evaluate_fixed_recall(scored, g + [fold_col], label=label, score=score, targets=targets)
    return summarise_folds(folds, [*g, "target_recall"], fixed_recall=True)


def confusion_at(scored: DataFrame, threshold, group_cols=None, label: str = "label",
                 score: str = "score") -> DataFrame:
    """Confusion counts and metrics at a fixed threshold (score >= threshold), both labels
    forced; one conditional-aggregate pass, plus workload reduction and FN rate."""
    g = _g(group_cols)
    y = as_int(label)
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    pred = (F.col(score) >= t).cast("int")
    s = scored.groupBy(*g).agg(
        F.sum(y).cast("long").alias("P"), F.sum(1 - y).cast("long").alias("N"),
        F.sum(y * pred).cast("long").alias("tp"), F.sum((1 - y) * pred).cast("long").alias("fp"))
    m = with_confusion_metrics(s)
    return m.withColumn("workload_reduction",
                        F.lit(1.0) - safe_div(F.col("tp") + F.col("fp"), F.col("P") + F.col("N"))) \
            .withColumn("fn_rate", safe_div("fn", F.col("tp") + F.col("fn")))


def grid_thresholds(start: float = 0.05, step: float = 0.05, count: int = 10) -> list[float]:
    """Grid start + i*step, i = 0..count-1, with the same doubles as numpy.arange."""
    return [start + i * step for i in range(count)]


def threshold_grid(scored: DataFrame, thresholds=None, group_cols=None, label: str = "label",
                   score: str = "score") -> DataFrame:
    """Recall, specificity, accuracy, precision at each grid threshold.

    Each row is bucketed once by how many thresholds it clears; buckets are
    aggregated per group (tiny), then spread back to thresholds with an
    explode on that small table -- the data itself is never multiplied."""
    g = _g(group_cols)
    ts = sorted(float(t) for t in (thresholds or grid_thresholds()))
    arr = F.array(*[F.lit(t) for t in ts])
    y = as_int(label)
    b = F.size(F.filter(arr, lambda t: t <= F.col(score)))
    buckets = scored.groupBy(*g, b.alias("_b")).agg(
        F.sum(y).cast("long").alias("pos"), F.sum(1 - y).cast("long").alias("neg"))
    totals = buckets.groupBy(*g).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    spread = buckets.where(F.col("_b") >= 1) \
        .select(*g, "pos", "neg", F.explode(F.sequence(F.lit(1), F.col("_b"))).alias("_j"))
    per_t = spread.groupBy(*g, "_j").agg(F.sum("pos").alias("tp"), F.sum("neg").alias("fp"))
    idx = F.array(*[F.struct(F.lit(i + 1).alias("_j"), F.lit(t).alias("threshold")) for i, t in enumerate(ts)])
    grid = totals.select(*g, "P", "N", F.inline(idx))
    j = grid.join(per_t, on=g + ["_j"], how="left").fillna(0, subset=["tp", "fp"])
    m = with_confusion_metrics(j)
    return m.select(*g, "threshold", "recall", "specificity", "accuracy", "precision",
                    "tp", "fp", "fn", "tn")


def pick_threshold_under_recall_floor(grid: DataFrame, group_cols=None, floor: float = 0.95,
                                      by: str = "precision", digits: int = 3) -> DataFrame:
    """Among grid rows with recall >= floor (compared on values rounded to ``digits``), the
    one with the best ``by`` (first threshold on ties); else the highest-recall row."""
    g = _g(group_cols)
    r = round_np("recall", digits)
    key = round_np(by, digits)
    s = grid.groupBy(*g).agg(
        F.min(F.when(r >= floor, F.struct((-key).alias("k"), F.col("threshold").alias("t")))).alias("_ok"),
        F.min(F.struct((-r).alias("k"), F.col("threshold").alias("t"))).alias("_fb"))
    chosen = F.coalesce(F.col("_ok.t"), F.col("_fb.t"))
    picked = s.select(*g, chosen.alias("threshold"),
                      F.when(F.col("_ok").isNotNull(), F.lit(by)).otherwise(F.lit("max_recall")).alias("chosen_by"))
    return picked.join(grid, on=g + ["threshold"], how="inner")


def highest_threshold_reaching(grid: DataFrame, group_cols=None, floor: float = 0.95) -> DataFrame:
    """Highest grid threshold whose recall >= floor, else the last (highest) grid row."""
    g = _g(group_cols)
    s = grid.groupBy(*g).agg(
        F.max(F.when(F.col("recall") >= floor, F.col("threshold"))).alias("_ok"),
        F.max("threshold").alias("_last"))
    picked = s.select(*g, F.coalesce("_ok", "_last").alias("threshold"),
                      F.col("_ok").isNotNull().alias("reaches_floor"))
    return picked.join(grid, on=g + ["threshold"], how="inner")


def wss_at_recall(scored: DataFrame, group_cols=None, target_recall: float = 0.95,
                  label: str = "label", score: str = "score", id_col: str = "id") -> DataFrame:
    """Work saved over sampling: rows by score desc (ties by id), smallest k whose
    cumulative positives reach ceil(R * P); WSS = 1 - k/N clamped to [0, 1]; 0 without
    positives. (1 - k/N as in the study, not the published 1 - k/N - (1 - R).)

    Two levels, so the full table is never sorted: the distinct-score curve gives the
    critical score s* (highest threshold whose tp reaches the need) and the counts above
    it; only the rows tied at s* are then ranked by id to place the m-th positive."""
    g = _g(group_cols)
    t = F.lit(float(target_recall))
    curve = pr_curve(scored, g, label, score)
    need = F.ceil(t * F.col("P").cast("double"))
    crit = curve.groupBy(*g).agg(
        F.first("P").alias("n_pos"), (F.first("P") + F.first("N")).alias("n"),
        F.max(F.when(F.col("tp") >= need, F.struct(F.col("threshold").alias("s"), F.col("tp").alias("tp"),
                                                     F.col("fp").alias("fp"), F.col("pos").alias("pos"),
                                                     F.col("neg").alias("neg")))).alias("_c"),
        F.first(need).alias("need"))
    crit = crit.select(*g, "n_pos", "n", "need", F.col("_c.s").alias("_s"),
                       (F.col("_c.tp") + F.col("_c.fp") - F.col("_c.pos") - F.col("_c.neg")).alias("_above"),
                       (F.col("need") - (F.col("_c.tp") - F.col("_c.pos"))).alias("_m"))
    # rows tied at s*, ranked by id: the m-th positive's position inside the tie group
    key = crit.where(F.col("_s").isNotNull() & (F.col("_m") >= 1)).select(*g, "_s", "_m")
    rows = scored.select(*g, as_int(label).alias("_y"), F.col(score).alias("_sc"), F.col(id_col).alias("_id"),
                         F.lit(1).alias("_n"))
    cond = [rows[c].eqNullSafe(key[c]) for c in g] + [rows["_sc"] == key["_s"]]
    tie = rows.join(key, on=cond, how="inner").select(*[rows[c] for c in g], "_y", "_id", "_n", "_m")
    cum = running_totals(tie, g, [F.col("_id").asc()], ["_y", "_n"], key_block(tie, "_id"))
    pos_in_tie = cum.where((F.col("_y") == 1) & (F.col("cum__y") == F.col("_m"))) \
        .groupBy(*g).agg(F.min("cum__n").alias("_pos_in_tie"))
    if g:
        j = crit.join(pos_in_tie, on=g, how="left")
    else:
        j = crit.select("*", pos_in_tie.select(F.min("_pos_in_tie")).scalar().alias("_pos_in_tie"))
    k = F.when(F.col("_s").isNull(), F.lit(None)).otherwise(
        F.col("_above") + F.when(F.col("_m") <= 0, F.lit(1)).otherwise(F.col("_pos_in_tie")))
    j = j.withColumn("k", k)
    wss = F.when((F.col("n_pos") == 0) | F.col("k").isNull(), F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - F.col("k") / F.col("n").cast("double"))))
    return j.select(*g, t.alias("target_recall"), F.col("n_pos").cast("long").alias("n_pos"),
                    F.col("n").cast("long").alias("n"), F.col("k").cast("long").alias("k"), wss.alias("wss"))


def recall_threshold_scan(curve: DataFrame, group_cols=None, target_recall: float = 0.95) -> DataFrame:
    """Lowest-threshold scan for a target recall, two forms:
    * ``threshold_literal``: the study's loop, which pairs threshold i with the recall
      of point i+1 (the next higher threshold) -> +inf when nothing qualifies;
    * ``threshold_corrected``: highest threshold whose own recall >= target."""
    g = _g(group_cols)
    nxt = F.when(F.col("P") == 0, F.when(F.col("threshold") == F.col("max_score"), F.lit(0.0))
                 .otherwise(F.lit(1.0))) \
        .otherwise((F.col("tp") - F.col("pos")) / F.col("P").cast("double"))
    t = F.lit(float(target_recall))
    s = curve.groupBy(*g).agg(
        F.min(F.when(nxt >= t, F.col("threshold"))).alias("_lit"),
        F.max(F.when(F.col("recall") >= t, F.col("threshold"))).alias("_cor"))
    inf = F.lit(float("inf"))
    return s.select(*g, t.alias("target_recall"), F.coalesce("_lit", inf).alias("threshold_literal"),
                    F.coalesce("_cor", inf).alias("threshold_corrected"))
