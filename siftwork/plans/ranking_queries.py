"""Registered queries over the scored table (events) and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwork.functions.expr import round_np
from siftwork.operators import ranking as R
from siftwork.operators import report as RP
from siftwork.operators.ml import seed_ensemble
from siftwork.plans.common import finish
from siftwork.sources import fixtures as fx

TARGET = 0.95

# ---------------------------------------------------------------- Spark side


def q_fixed_recall_folds(spark, sf):
    """Per-fold evaluation at fixed recall 0.95 (W-02, M-01..M-05, M-10)."""
    return finish(R.evaluate_fixed_recall(fx.scored(spark, sf), ["fold"], TARGET))


def q_fixed_recall_summary(spark, sf):
    """Fold means ignoring NaN and share of folds reaching the target exactly (A-17, A-18)."""
    folds = R.evaluate_fixed_recall(fx.scored(spark, sf), ["fold"], TARGET)
    return finish(R.summarise_folds(folds.withColumn("model", F.lit("events")), ["model"], fixed_recall=True))


def q_default_threshold_folds(spark, sf):
    """Per-fold evaluation at the automatic threshold 0.5 / 0.0 (P-16, L-06 metrics)."""
    return finish(R.evaluate_default(fx.scored(spark, sf), ["fold"], score="prob"))


def q_pr_curve(spark, sf):
    """Precision-recall curve per fold with end points (M-06)."""
    c = R.pr_curve(fx.scored(spark, sf), ["fold"])
    return finish(R.pr_curve_with_end(c, ["fold"]))


def q_roc_auc_ap(spark, sf):
    """Tie-aware ROC AUC and average precision per fold, and over all rows (M-04, M-05)."""
    s = fx.scored(spark, sf)
    per_fold = R.ranking_summary(R.pr_curve(s, ["fold"]), ["fold"], (TARGET,)) \
        .select(F.col("fold").cast("long").alias("fold"), "roc_auc", "pr_auc", "P", "N")
    overall = R.ranking_summary(R.pr_curve(s, []), [], (TARGET,)) \
        .select(F.lit(-1).cast("long").alias("fold"), "roc_auc", "pr_auc", "P", "N")
    return finish(per_fold.unionByName(overall))


def q_wss_at_recall(spark, sf):
    """Work saved over sampling at 95 % recall per fold, ties by id (W-01)."""
    return finish(R.wss_at_recall(fx.scored(spark, sf), ["fold"], TARGET))


def q_recall_threshold_scan(spark, sf):
    """Lowest-threshold scan, literal (off-by-one) and corrected forms (W-03)."""
    c = R.pr_curve(fx.scored(spark, sf), ["fold"])
    return finish(R.recall_threshold_scan(c, ["fold"], TARGET))


def q_threshold_grid(spark, sf):
    """Recall / specificity / accuracy / precision on the 0.05..0.50 grid per fold (M-11)."""
    g = R.threshold_grid(fx.scored(spark, sf), R.grid_thresholds(), ["fold"], score="prob")
    return finish(g)


def q_best_grid_threshold(spark, sf):
    """Best-precision grid threshold with recall >= .95 on rounded values, fallback max
    recall (W-04), next to the highest threshold reaching .95 (W-05)."""
    g = R.threshold_grid(fx.scored(spark, sf), R.grid_thresholds(), ["fold"], score="prob")
    g3 = g.select("fold", round_np("threshold", 3).alias("threshold"),
                  *[round_np(c, 3).alias(c) for c in ("recall", "specificity", "accuracy", "precision")])
    a = R.pick_threshold_under_recall_floor(g3, ["fold"], 0.95, "precision") \
        .select("fold", F.lit("best_precision").alias("rule"), "threshold", "recall", "precision")
    b = R.highest_threshold_reaching(g, ["fold"], 0.95) \
        .select("fold", F.lit("highest_reaching").alias("rule"), "threshold", "recall", "precision")
    return finish(a.unionByName(b))


def q_confusion_at_half(spark, sf):
    """Confusion matrix and rates at threshold 0.5 per fold, with workload reduction and
    false-negative rate (M-01..M-03, M-08..M-10, P-15)."""
    return finish(R.confusion_at(fx.scored(spark, sf), 0.5, ["fold"], score="prob"))


def q_recall_tradeoff(spark, sf):
    """Trade-off over target recalls .90/.92/.95/.97/.99 averaged over folds (L-09)."""
    s = fx.scored(spark, sf).withColumn("model", F.lit("events"))
    return finish(R.recall_tradeoff(s, ["model"], "fold"))


def q_false_negatives(spark, sf):
    """Positives predicted negative at 0.5, with their probability (P-18, P-19)."""
    s = fx.scored(spark, sf)
    preds = RP.export_predictions(s, 0.5, score="prob", keep=("fold",))
    fn = preds.where("y_true = 1 and y_pred = 0")
    return finish(fn.select(F.col("paper_id").alias("id"), "fold", "probability"))


def q_seed_ensemble(spark, sf):
    """Average probability per row over three seeded runs (L-16): run k reads
    value / (value + 10 k)."""
    ev = fx.scored(spark, sf)
    runs = None
    for k in (1, 2, 3):
        one = ev.select("id", "label", F.lit(k).alias("seed"), (F.col("score") / (F.col("score") + F.lit(10.0 * k))).alias("score"))
        runs = one if runs is None else runs.unionByName(one)
    return finish(seed_ensemble(runs).select("id", "label", "score"))


QUERIES = {
    "fixed_recall_folds": q_fixed_recall_folds,
    "fixed_recall_summary": q_fixed_recall_summary,
    "default_threshold_folds": q_default_threshold_folds,
    "pr_curve": q_pr_curve,
    "roc_auc_ap": q_roc_auc_ap,
    "wss_at_recall": q_wss_at_recall,
    "recall_threshold_scan": q_recall_threshold_scan,
    "threshold_grid": q_threshold_grid,
    "best_grid_threshold": q_best_grid_threshold,
    "confusion_at_half": q_confusion_at_half,
    "recall_tradeoff": q_recall_tradeoff,
    "false_negatives": q_false_negatives,
    "seed_ensemble": q_seed_ensemble,
}

# ---------------------------------------------------------------- DuckDB side

SCORED = """scored AS (
  SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 AS fold,
         event_type = 'purchase' AS label, value AS score, value / (value + 30.0) AS prob
  FROM events)"""

CURVE = """counts AS (
  SELECT fold, score, SUM(CASE WHEN label THEN 1 ELSE 0 END) AS pos,
         SUM(CASE WHEN label THEN 0 ELSE 1 END) AS neg
  FROM scored GROUP BY fold, score),
curve AS (
  SELECT fold, score AS threshold, pos, neg,
    SUM(pos) OVER (PARTITION BY fold ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
    SUM(neg) OVER (PARTITION BY fold ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp,
    SUM(pos) OVER (PARTITION BY fold) AS P, SUM(neg) OVER (PARTITION BY fold) AS N,
    MIN(score) OVER (PARTITION BY fold) AS min_score, MAX(score) OVER (PARTITION BY fold) AS max_score
  FROM counts),
curve2 AS (
  SELECT *, CAST(tp AS DOUBLE) / (tp + fp) AS precision,
         CASE WHEN P = 0 THEN 1.0 ELSE CAST(tp AS DOUBLE) / P END AS recall
  FROM curve)"""


def _fixed_recall_sql(target: float, rounded: bool = True) -> str:
    t = f"CAST({target!r} AS DOUBLE)"
    sql = f"""
WITH {SCORED},
{CURVE},
agg AS (
  SELECT fold, ANY_VALUE(P) AS P, ANY_VALUE(N) AS N, ANY_VALUE(min_score) AS min_score,
    SUM(pos * (CAST(N - fp AS DOUBLE) + neg / 2.0)) AS auc_num, SUM(pos * precision) AS ap_num,
    SUM(CASE WHEN threshold >= 0.0 THEN neg ELSE 0 END) AS neg_ge0
  FROM curve2 GROUP BY fold),
best AS (
  SELECT fold, ABS(recall - {t}) AS diff, threshold AS thr, recall AS rec, tp AS btp, fp AS bfp
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY fold ORDER BY ABS(recall - {t}), threshold) AS rn
        FROM curve2) WHERE rn = 1),
pt AS (
  SELECT a.fold, a.P, a.N, a.auc_num, a.ap_num,
    CASE WHEN a.P = 0 THEN 0.0 WHEN ABS({t}) < b.diff THEN a.min_score - 1e-6 ELSE b.thr END AS threshold,
    CASE WHEN a.P = 0 THEN 0.0 WHEN ABS({t}) < b.diff THEN 0.0 ELSE b.rec END AS actual_recall,
    CASE WHEN a.P = 0 THEN FALSE WHEN ABS({t}) < b.diff THEN ABS({t}) < 1e-6 ELSE b.diff < 1e-6 END AS recall_achievable,
    CASE WHEN a.P = 0 THEN 0 WHEN ABS({t}) < b.diff THEN a.P ELSE b.btp END AS tp,
    CASE WHEN a.P = 0 THEN a.neg_ge0 WHEN ABS({t}) < b.diff THEN a.N ELSE b.bfp END AS fp
  FROM agg a JOIN best b ON a.fold = b.fold),
m AS (
  SELECT *, P - tp AS fn, N - fp AS tn FROM pt)
SELECT CAST(fold AS BIGINT) AS fold,
  ROUND(CASE WHEN P > 0 AND N > 0 THEN auc_num / (CAST(P AS DOUBLE) * N) END, 6) AS roc_auc,
  ROUND(CASE WHEN P > 0 THEN ap_num / P ELSE 0.0 END, 6) AS pr_auc,
  ROUND(COALESCE(2.0 * tp / NULLIF(2.0 * tp + fn + fp, 0), 0.0), 6) AS f1,
  ROUND(COALESCE(5.0 * tp / NULLIF(5.0 * tp + 4.0 * fn + fp, 0), 0.0), 6) AS f2,
  ROUND(COALESCE(CAST(tp + tn AS DOUBLE) / NULLIF(P + N, 0), 0.0), 6) AS accuracy,
  ROUND(COALESCE(CAST(tp AS DOUBLE) / NULLIF(tp + fn, 0), 0.0), 6) AS recall,
  ROUND(COALESCE(CAST(tp AS DOUBLE) / NULLIF(tp + fp, 0), 0.0), 6) AS precision,
  ROUND(COALESCE(CAST(tn AS DOUBLE) / NULLIF(tn + fp, 0), 0.0), 6) AS specificity,
  CAST(P AS BIGINT) AS support_pos, CAST(N AS BIGINT) AS support_neg,
  ROUND({t}, 6) AS target_recall, ROUND(actual_recall, 6) AS actual_recall,
  ROUND(threshold, 6) AS threshold, recall_achievable,
  CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn
FROM m"""
    if not rounded:
        import re
        sql = re.sub(r"ROUND\((.*?), 6\) AS", r"\1 AS", sql)
    return sql


SQL_FIXED_RECALL_FOLDS = _fixed_recall_sql(TARGET)

SQL_FIXED_RECALL_SUMMARY = f"""
WITH f AS ({_fixed_recall_sql(TARGET, rounded=False)})
SELECT 'events' AS model,
  ROUND(AVG(roc_auc), 6) AS roc_auc_mean, ROUND(AVG(pr_auc), 6) AS pr_auc_mean,
  ROUND(AVG(f1), 6) AS f1_mean, ROUND(AVG(f2), 6) AS f2_mean, ROUND(AVG(accuracy), 6) AS accuracy_mean,
  ROUND(AVG(recall), 6) AS recall_mean, ROUND(AVG(precision), 6) AS precision_mean,
  ROUND(AVG(specificity), 6) AS specificity_mean, ROUND(ANY_VALUE(target_recall), 6) AS target_recall,
  ROUND(AVG(actual_recall), 6) AS actual_recall_mean, ROUND(AVG(threshold), 6) AS threshold_mean,
  ROUND(AVG(CASE WHEN recall_achievable THEN 1.0 ELSE 0.0 END), 6) AS recall_achievable_ratio
FROM f"""

SQL_DEFAULT_THRESHOLD_FOLDS = f"""
WITH {SCORED},
s2 AS (SELECT id, fold, label, prob AS score FROM scored),
counts AS (
  SELECT fold, score, SUM(CASE WHEN label THEN 1 ELSE 0 END) AS pos,
         SUM(CASE WHEN label THEN 0 ELSE 1 END) AS neg
  FROM s2 GROUP BY fold, score),
curve AS (
  SELECT fold, score AS threshold, pos, neg,
    SUM(pos) OVER (PARTITION BY fold ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
    SUM(neg) OVER (PARTITION BY fold ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp,
    SUM(pos) OVER (PARTITION BY fold) AS P, SUM(neg) OVER (PARTITION BY fold) AS N
  FROM counts),
agg AS (
  SELECT fold, ANY_VALUE(P) AS P, ANY_VALUE(N) AS N, MIN(threshold) AS mn, MAX(threshold) AS mx,
    SUM(pos * (CAST(N - fp AS DOUBLE) + neg / 2.0)) AS auc_num,
    SUM(pos * (CAST(tp AS DOUBLE) / (tp + fp))) AS ap_num,
    SUM(CASE WHEN threshold >= 0.5 THEN pos ELSE 0 END) AS tp5, SUM(CASE WHEN threshold >= 0.5 THEN neg ELSE 0 END) AS fp5,
    SUM(CASE WHEN threshold >= 0.0 THEN pos ELSE 0 END) AS tp0, SUM(CASE WHEN threshold >= 0.0 THEN neg ELSE 0 END) AS fp0
  FROM curve GROUP BY fold),
pt AS (
  SELECT fold, P, N, auc_num, ap_num, (mn >= 0.0 AND mx <= 1.0) AS prob,
    CASE WHEN mn >= 0.0 AND mx <= 1.0 THEN tp5 ELSE tp0 END AS tp,
    CASE WHEN mn >= 0.0 AND mx <= 1.0 THEN fp5 ELSE fp0 END AS fp
  FROM agg),
m AS (SELECT *, P - tp AS fn, N - fp AS tn FROM pt)
SELECT CAST(fold AS BIGINT) AS fold,
  ROUND(CASE WHEN P > 0 AND N > 0 THEN auc_num / (CAST(P AS DOUBLE) * N) END, 6) AS roc_auc,
  ROUND(CASE WHEN P > 0 THEN ap_num / P ELSE 0.0 END, 6) AS pr_auc,
  ROUND(COALESCE(2.0 * tp / NULLIF(2.0 * tp + fn + fp, 0), 0.0), 6) AS f1,
  ROUND(COALESCE(5.0 * tp / NULLIF(5.0 * tp + 4.0 * fn + fp, 0), 0.0), 6) AS f2,
  ROUND(COALESCE(CAST(tp + tn AS DOUBLE) / NULLIF(P + N, 0), 0.0), 6) AS accuracy,
  ROUND(COALESCE(CAST(tp AS DOUBLE) / NULLIF(tp + fn, 0), 0.0), 6) AS recall,
  ROUND(COALESCE(CAST(tp AS DOUBLE) / NULLIF(tp + fp, 0), 0.0), 6) AS precision,
  ROUND(COALESCE(CAST(tn AS DOUBLE) / NULLIF(tn + fp, 0), 0.0), 6) AS specificity,
  CAST(P AS BIGINT) AS support_pos, CAST(N AS BIGINT) AS support_neg,
  CASE WHEN prob THEN 0.5 ELSE 0.0 END AS threshold,
  CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn
FROM m"""

SQL_PR_CURVE = f"""
WITH {SCORED},
{CURVE}
SELECT CAST(fold AS BIGINT) AS fold, ROUND(threshold, 6) AS threshold, ROUND(precision, 6) AS precision,
       ROUND(recall, 6) AS recall FROM curve2
UNION ALL
SELECT DISTINCT CAST(fold AS BIGINT) AS fold, CAST(NULL AS DOUBLE) AS threshold, 1.0 AS precision, 0.0 AS recall
FROM scored"""

SQL_ROC_AUC_AP = f"""
WITH {SCORED},
{CURVE},
per_fold AS (
  SELECT CAST(fold AS BIGINT) AS fold, ANY_VALUE(P) AS P, ANY_VALUE(N) AS N,
    SUM(pos * (CAST(N - fp AS DOUBLE) + neg / 2.0)) AS auc_num, SUM(pos * precision) AS ap_num
  FROM curve2 GROUP BY fold),
c_all AS (
  SELECT score, SUM(CASE WHEN label THEN 1 ELSE 0 END) AS pos, SUM(CASE WHEN label THEN 0 ELSE 1 END) AS neg
  FROM scored GROUP BY score),
k_all AS (
  SELECT pos, neg,
    SUM(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
    SUM(neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp,
    SUM(pos) OVER () AS P, SUM(neg) OVER () AS N
  FROM c_all),
overall AS (
  SELECT CAST(-1 AS BIGINT) AS fold, ANY_VALUE(P) AS P, ANY_VALUE(N) AS N,
    SUM(pos * (CAST(N - fp AS DOUBLE) + neg / 2.0)) AS auc_num,
    SUM(pos * (CAST(tp AS DOUBLE) / (tp + fp))) AS ap_num
  FROM k_all),
u AS (SELECT * FROM per_fold UNION ALL SELECT * FROM overall)
SELECT fold, ROUND(CASE WHEN P > 0 AND N > 0 THEN auc_num / (CAST(P AS DOUBLE) * N) END, 6) AS roc_auc,
  ROUND(CASE WHEN P > 0 THEN ap_num / P ELSE 0.0 END, 6) AS pr_auc, CAST(P AS BIGINT) AS P, CAST(N AS BIGINT) AS N
FROM u"""

SQL_WSS = f"""
WITH {SCORED},
r AS (
  SELECT fold, label,
    SUM(CASE WHEN label THEN 1 ELSE 0 END) OVER (PARTITION BY fold ORDER BY score DESC, id
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_pos,
    ROW_NUMBER() OVER (PARTITION BY fold ORDER BY score DESC, id) AS k,
    SUM(CASE WHEN label THEN 1 ELSE 0 END) OVER (PARTITION BY fold) AS P,
    COUNT(*) OVER (PARTITION BY fold) AS N
  FROM scored),
g AS (
  SELECT fold, ANY_VALUE(P) AS P, ANY_VALUE(N) AS N,
    MIN(CASE WHEN cum_pos >= CEIL(CAST(0.95 AS DOUBLE) * CAST(P AS DOUBLE)) THEN k END) AS k
  FROM r GROUP BY fold)
SELECT CAST(fold AS BIGINT) AS fold, 0.95 :: DOUBLE AS target_recall, CAST(P AS BIGINT) AS n_pos,
  CAST(N AS BIGINT) AS n, CAST(k AS BIGINT) AS k,
  ROUND(CASE WHEN P = 0 OR k IS NULL THEN 0.0 ELSE GREATEST(0.0, LEAST(1.0, 1.0 - k / CAST(N AS DOUBLE))) END, 6) AS wss
FROM g"""

SQL_RECALL_SCAN = f"""
WITH {SCORED},
{CURVE},
n AS (
  SELECT *, CASE WHEN P = 0 THEN (CASE WHEN threshold = max_score THEN 0.0 ELSE 1.0 END)
                 ELSE CAST(tp - pos AS DOUBLE) / P END AS next_recall
  FROM curve2)
SELECT CAST(fold AS BIGINT) AS fold, 0.95 :: DOUBLE AS target_recall,
  ROUND(COALESCE(MIN(CASE WHEN next_recall >= 0.95 :: DOUBLE THEN threshold END), 'inf' :: DOUBLE), 6) AS threshold_literal,
  ROUND(COALESCE(MAX(CASE WHEN recall >= 0.95 :: DOUBLE THEN threshold END), 'inf' :: DOUBLE), 6) AS threshold_corrected
FROM n GROUP BY fold"""

GRID_SQL = """grid AS (SELECT i + 1 AS j, 0.05 :: DOUBLE + i * 0.05 :: DOUBLE AS threshold FROM range(10) t(i))"""

GRID_BODY = f"""
WITH {SCORED},
{GRID_SQL},
tot AS (SELECT fold, SUM(CASE WHEN label THEN 1 ELSE 0 END) AS P, SUM(CASE WHEN label THEN 0 ELSE 1 END) AS N
        FROM scored GROUP BY fold),
pt AS (
  SELECT t.fold, g.threshold, t.P, t.N,
    (SELECT COUNT(*) FROM scored s WHERE s.fold = t.fold AND s.label AND s.prob >= g.threshold) AS tp,
    (SELECT COUNT(*) FROM scored s WHERE s.fold = t.fold AND NOT s.label AND s.prob >= g.threshold) AS fp
  FROM tot t, grid g),
m AS (SELECT *, P - tp AS fn, N - fp AS tn FROM pt)"""

SQL_THRESHOLD_GRID = GRID_BODY + """
SELECT CAST(fold AS BIGINT) AS fold, ROUND(threshold, 6) AS threshold,
  ROUND(COALESCE(CAST(tp AS DOUBLE) / NULLIF(tp + fn, 0), 0.0), 6) AS recall,
  ROUND(COALESCE(CAST(tn AS DOUBLE) / NULLIF(tn + fp, 0), 0.0), 6) AS specificity,
  ROUND(COALESCE(CAST(tp + tn AS DOUBLE) / NULLIF(P + N, 0), 0.0), 6) AS accuracy,
  ROUND(COALESCE(CAST(tp AS DOUBLE) / NULLIF(tp + fp, 0), 0.0), 6) AS precision,
  CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn
FROM m"""

SQL_BEST_GRID = GRID_BODY + """,
g AS (
  SELECT fold, threshold AS t_raw, round_even(threshold * 1e3, 0) / 1e3 AS threshold,
    COALESCE(CAST(tp AS DOUBLE) / NULLIF(tp + fn, 0), 0.0) AS recall,
    COALESCE(CAST(tp AS DOUBLE) / NULLIF(tp + fp, 0), 0.0) AS precision
  FROM m),
g3 AS (SELECT fold, threshold, round_even(recall * 1e3, 0) / 1e3 AS recall,
             round_even(precision * 1e3, 0) / 1e3 AS precision FROM g),
okp AS (
  SELECT fold, threshold, recall, precision, 'precision' AS how,
    ROW_NUMBER() OVER (PARTITION BY fold ORDER BY precision DESC, threshold) AS rn
  FROM g3 WHERE recall >= 0.95 :: DOUBLE),
fbp AS (
  SELECT fold, threshold, recall, precision,
    ROW_NUMBER() OVER (PARTITION BY fold ORDER BY recall DESC, threshold) AS rn
  FROM g3),
a AS (
  SELECT f.fold, COALESCE(o.threshold, f.threshold) AS threshold
  FROM (SELECT * FROM fbp WHERE rn = 1) f LEFT JOIN (SELECT * FROM okp WHERE rn = 1) o ON f.fold = o.fold),
b AS (
  SELECT fold, COALESCE(MAX(CASE WHEN recall >= 0.95 :: DOUBLE THEN t_raw END), MAX(t_raw)) AS t_raw
  FROM g GROUP BY fold)
SELECT CAST(a.fold AS BIGINT) AS fold, 'best_precision' AS rule, ROUND(g3.threshold, 6) AS threshold,
       ROUND(g3.recall, 6) AS recall, ROUND(g3.precision, 6) AS precision
FROM a JOIN g3 ON a.fold = g3.fold AND a.threshold = g3.threshold
UNION ALL
SELECT CAST(b.fold AS BIGINT), 'highest_reaching', ROUND(g.t_raw, 6), ROUND(g.recall, 6), ROUND(g.precision, 6)
FROM b JOIN g ON b.fold = g.fold AND b.t_raw = g.t_raw"""

SQL_CONFUSION_HALF = f"""
WITH {SCORED},
pt AS (
  SELECT fold, SUM(CASE WHEN label THEN 1 ELSE 0 END) AS P, SUM(CASE WHEN label THEN 0 ELSE 1 END) AS N,
    SUM(CASE WHEN label AND prob >= 0.5 THEN 1 ELSE 0 END) AS tp,
    SUM(CASE WHEN NOT label AND prob >= 0.5 THEN 1 ELSE 0 END) AS fp
  FROM scored GROUP BY fold),
m AS (SELECT *, P - tp AS fn, N - fp AS tn FROM pt)
SELECT CAST(fold AS BIGINT) AS fold, CAST(P AS BIGINT) AS P, CAST(N AS BIGINT) AS N,
  CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn,
  ROUND(COALESCE(CAST(tp AS DOUBLE) / NULLIF(tp + fn, 0), 0.0), 6) AS recall,
  ROUND(COALESCE(CAST(tp AS DOUBLE) / NULLIF(tp + fp, 0), 0.0), 6) AS precision,
  ROUND(COALESCE(CAST(tn AS DOUBLE) / NULLIF(tn + fp, 0), 0.0), 6) AS specificity,
  ROUND(COALESCE(CAST(tp + tn AS DOUBLE) / NULLIF(P + N, 0), 0.0), 6) AS accuracy,
  ROUND(COALESCE(2.0 * tp / NULLIF(2.0 * tp + fn + fp, 0), 0.0), 6) AS f1,
  ROUND(COALESCE(5.0 * tp / NULLIF(5.0 * tp + 4.0 * fn + fp, 0), 0.0), 6) AS f2,
  CAST(P AS BIGINT) AS support_pos, CAST(N AS BIGINT) AS support_neg,
  ROUND(1.0 - COALESCE(CAST(tp + fp AS DOUBLE) / NULLIF(P + N, 0), 0.0), 6) AS workload_reduction,
  ROUND(COALESCE(CAST(fn AS DOUBLE) / NULLIF(tp + fn, 0), 0.0), 6) AS fn_rate
FROM m"""


def _tradeoff_sql(targets) -> str:
    parts = []
    for t in targets:
        body = _fixed_recall_sql(t, rounded=False)
        parts.append(f"SELECT * FROM ({body})")
    union = "\nUNION ALL\n".join(parts)
    return f"""
WITH f AS ({union})
SELECT 'events' AS model, target_recall,
  ROUND(AVG(roc_auc), 6) AS roc_auc_mean, ROUND(AVG(pr_auc), 6) AS pr_auc_mean,
  ROUND(AVG(f1), 6) AS f1_mean, ROUND(AVG(f2), 6) AS f2_mean, ROUND(AVG(accuracy), 6) AS accuracy_mean,
  ROUND(AVG(recall), 6) AS recall_mean, ROUND(AVG(precision), 6) AS precision_mean,
  ROUND(AVG(specificity), 6) AS specificity_mean,
  ROUND(AVG(actual_recall), 6) AS actual_recall_mean, ROUND(AVG(threshold), 6) AS threshold_mean,
  ROUND(AVG(CASE WHEN recall_achievable THEN 1.0 ELSE 0.0 END), 6) AS recall_achievable_ratio
FROM f GROUP BY target_recall"""


SQL_FALSE_NEGATIVES = f"""
WITH {SCORED}
SELECT id, CAST(fold AS BIGINT) AS fold, ROUND(prob, 6) AS probability FROM scored WHERE label AND prob < 0.5"""

ORACLE = {
    "seed_ensemble": """SELECT event_id AS id, event_type = 'purchase' AS label,
  ROUND((value / (value + 10.0::DOUBLE) + value / (value + 20.0::DOUBLE) + value / (value + 30.0::DOUBLE)) / 3, 6) AS score FROM events""",
    "fixed_recall_folds": SQL_FIXED_RECALL_FOLDS,
    "fixed_recall_summary": SQL_FIXED_RECALL_SUMMARY,
    "default_threshold_folds": SQL_DEFAULT_THRESHOLD_FOLDS,
    "pr_curve": SQL_PR_CURVE,
    "roc_auc_ap": SQL_ROC_AUC_AP,
    "wss_at_recall": SQL_WSS,
    "recall_threshold_scan": SQL_RECALL_SCAN,
    "threshold_grid": SQL_THRESHOLD_GRID,
    "best_grid_threshold": SQL_BEST_GRID,
    "confusion_at_half": SQL_CONFUSION_HALF,
    "recall_tradeoff": _tradeoff_sql((0.9, 0.92, 0.95, 0.97, 0.99)),
    "false_negatives": SQL_FALSE_NEGATIVES,
}
