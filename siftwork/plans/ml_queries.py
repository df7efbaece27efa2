"""Registered model-training queries (rows-only checks: model fits are not SQL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwork.operators import ml as M
from siftwork.operators import ranking as R
from siftwork.operators.split import holdout_split
from siftwork.plans.answer_queries import _encoded, QIDS
from siftwork.plans.common import finish
from siftwork.sources import fixtures as fx
from siftwork.session import ensure_checkpoint_dir


def q_ml_logreg_fixed_recall(spark, sf):
    """5-fold logistic regression on the vectors (target = label 0), evaluated at the
    automatic threshold and at a fixed 95 % recall per fold (L-01, L-06, L-07, L-08)."""
    ensure_checkpoint_dir(spark)
    v = fx.vectors(spark, sf).select("id", "embedding", F.col("target").alias("label"))
    scored = M.cross_val_scored(v, M.logreg(), 5, tags={"embedding_model": "given", "classifier": "logreg"})
    g = ["embedding_model", "classifier", "fold"]
    return finish(R.evaluate_fixed_recall(scored, g, 0.95))


def q_ml_forest_holdout(spark, sf):
    """Random forest on the encoded answer matrix: 60/20/20 split, threshold picked on the
    validation grid (recall >= .95, best precision), test metrics at that threshold
    (L-04, L-10, M-11, W-04, M-08)."""
    ensure_checkpoint_dir(spark)
    wide = _encoded(spark, sf).withColumnRenamed("paper_id", "id")
    x = wide.select("id", "label", F.array(*[F.col(q) for q in QIDS]).alias("embedding"))
    from siftwork.session import cut_lineage
    # the split feeds the fit, the validation grid and the test scoring: materialise once
    sp = cut_lineage(M.with_features(holdout_split(x, test=0.2, val=0.2)))
    model, val = M.fit_score(sp.where("split = 'train'"), sp.where("split = 'val'"),
                             M.random_forest(num_trees=500))
    grid = R.threshold_grid(val.withColumn("g", F.lit("val")), R.grid_thresholds(), ["g"])
    pick = R.pick_threshold_under_recall_floor(grid, ["g"], 0.95, "precision")
    test = model.transform(sp.where("split = 'test'").withColumn("_y", F.col("label").cast("double")))
    test = test.withColumn("score", M._score_col(test)).withColumn("g", F.lit("val"))
    t = test.join(pick.select("g", F.col("threshold").alias("t")), "g")
    res = R.confusion_at(t, F.col("t"), ["g", "t"])
    return finish(res.select(F.col("t").alias("threshold"), "recall", "precision", "accuracy", "specificity",
                             "workload_reduction", "tp", "fp", "fn", "tn"))


def q_ml_embedding_benchmark(spark, sf):
    """Embedding models x classifiers grid: raw and L2-normalised vectors, logistic
    regression and linear SVM (by its margin), 5 folds each; all scored rows unioned and evaluated in one grouped
    query, then averaged per (model, classifier) (J-06, L-08, A-17)."""
    from siftwork.operators import vectors as V
    ensure_checkpoint_dir(spark)
    v = fx.vectors(spark, sf).select("id", "embedding", F.col("target").alias("label"))
    both = V.scaled_vectors(v).withColumn("embedding_model", F.lit("scaled")).unionByName(
        V.normalize(V.scaled_vectors(v)).withColumn("embedding_model", F.lit("normalised")))
    scored = M.benchmark_classifiers(both, {"logreg": M.logreg(), "linear_svm": M.linear_svm()}, 5)
    folds = R.evaluate_default(scored, ["embedding_model", "classifier", "fold"])
    return finish(R.summarise_folds(folds, ["embedding_model", "classifier"]))


def q_ml_svm_platt_fixed_recall(spark, sf):
    """Linear SVM with sigmoid calibration from 3 inner folds, per outer fold of 5;
    calibrated scores evaluated at a fixed 95 % recall (L-02, L-07)."""
    from siftwork.operators.split import stratified_folds
    from siftwork.session import cut_lineage
    ensure_checkpoint_dir(spark)
    v = fx.vectors(spark, sf).select("id", "embedding", F.col("target").alias("label"))
    f = cut_lineage(stratified_folds(M.with_features(v), 5).select("id", "label", "features", "fold"))
    from concurrent.futures import ThreadPoolExecutor
    fit = M.svm_platt(3, 100)

    def one(i):  # outer folds are independent jobs: submit them concurrently
        return fit(f.where(F.col("fold") != i), f.where(F.col("fold") == i)).select("fold", "id", "label", "score")

    with ThreadPoolExecutor(max_workers=5) as pool:
        parts = list(pool.map(one, range(5)))
    scored = parts[0]
    for p in parts[1:]:
        scored = scored.unionByName(p)
    return finish(R.evaluate_fixed_recall(scored, ["fold"], 0.95))


def q_ml_model_search(spark, sf):
    """Random forests on the encoded answer matrix: every combination of a small grid by recall, and a seeded draw from a
    larger one by specificity, 5 folds each over one cut table (L-11, L-12, L-13)."""
    from pyspark.ml.classification import RandomForestClassifier
    ensure_checkpoint_dir(spark)
    wide = _encoded(spark, sf).withColumnRenamed("paper_id", "id")
    x = wide.select("id", "label", F.array(*[F.col(q) for q in QIDS]).alias("embedding"))

    def forest(params, n):
        return RandomForestClassifier(featuresCol="features", labelCol="_y", weightCol="weight", numTrees=30, seed=42, **params)

    grid = {"maxDepth": [4, 8], "minInstancesPerNode": [1, 4]}
    wider = {"maxDepth": [3, 5, 8, 12], "minInstancesPerNode": [1, 2, 4, 8], "featureSubsetStrategy": ["sqrt", "log2", "0.5"]}
    _, _, whole, _ = M.model_search(x, forest, grid)
    _, _, drawn, _ = M.model_search(x, forest, wider, sample=4, metric="specificity")
    named = lambda df, name: df.select(F.lit(name).alias("search"), "combination", "maxDepth", "minInstancesPerNode", "n_folds", "recall", "specificity", "selected")
    return finish(named(whole, "grid").unionAll(named(drawn, "randomised")))


def _kept_features(spark, sf):
    from siftwork.plans.answer_queries import _stats
    ensure_checkpoint_dir(spark)
    kept = {r.question_id for r in _stats(spark, sf).where("not removed").select("question_id").collect()}  # at most 29
    wide = _encoded(spark, sf).withColumnRenamed("paper_id", "id")
    return M.refit_on_kept(wide, list(QIDS), [q for q in QIDS if q in kept], M.random_forest(num_trees=100))


def q_ml_kept_features(spark, sf):
    """Random forest on all questions and on those that the feature filter keeps, default threshold on the same hold-out, with
    the number of questions and the shares of the five and ten most important ones (L-14, A-19)."""
    scored, importance = _kept_features(spark, sf)
    shares = importance.groupBy("feature_set").agg(
        F.count(F.lit(1)).alias("n_features"), *(F.max(F.when(F.col("rank") <= k, F.col("cumulative_share"))).alias(f"share_top{k}") for k in (5, 10)))
    return finish(R.evaluate_default(scored, ["feature_set"]).join(shares, "feature_set"))


QUERIES = {
    "ml_kept_features": q_ml_kept_features,
    "ml_model_search": q_ml_model_search,
    "ml_svm_platt_fixed_recall": q_ml_svm_platt_fixed_recall,
    "ml_embedding_benchmark": q_ml_embedding_benchmark,
    "ml_logreg_fixed_recall": q_ml_logreg_fixed_recall,
    "ml_forest_holdout": q_ml_forest_holdout,
}
ORACLE = {}
