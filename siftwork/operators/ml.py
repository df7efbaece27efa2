"""Classifiers on Spark ML and their cross-validated evaluation.

Every model produces the same *scored table* ``(group..., fold, id, label, score)``;
all metrics then come from ``ranking`` in one grouped pass. Folds come from the
seeded stratified assignment, so train/test splits are reproducible and
engine-independent. Parameters follow the study where Spark ML has a
counterpart (documented per factory); gaps are noted.
"""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import (GBTClassifier, LinearSVC, LogisticRegression,
                                       RandomForestClassifier)
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwork.operators.split import stratified_folds
from siftwork.session import read_if_any


def with_features(df: DataFrame, vec: str = "embedding", out: str = "features") -> DataFrame:
    if dict(df.dtypes).get(vec, "").startswith("array"):
        return df.withColumn(out, array_to_vector(F.transform(vec, lambda x: x.cast("double"))))
    return df.withColumn(out, F.col(vec))


def with_balanced_weights(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """n / (2 n_c): aggregate per class, join back."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    c = c.withColumn(out, F.sum("_nc").over(Window.partitionBy()) / (2.0 * F.col("_nc"))).drop("_nc")
    return df.join(c, label, "inner")


# ---------------------------------------------------------------- estimators

def logreg(max_iter: int = 500, reg_param: float | None = None):
    """Standardise then logistic regression with balanced weights. C = 1 of the study
    corresponds to regParam = 1 / sum(weights) = 1 / n (set per fit when None)."""
    def make(n_train: int):
        rp = reg_param if reg_param is not None else 1.0 / max(n_train, 1)
        return Pipeline(stages=[
            StandardScaler(inputCol="features", outputCol="_scaled", withMean=True, withStd=True),
            LogisticRegression(featuresCol="_scaled", labelCol="_y", weightCol="weight", maxIter=max_iter,
                               regParam=rp, standardization=False)])
    return make


def linear_svm(max_iter: int = 100, reg_param: float | None = None):
    """Linear SVM with balanced weights; scores are margins (calibrate with
    ``platt_scale`` when probabilities are needed)."""
    def make(n_train: int):
        rp = reg_param if reg_param is not None else 1.0 / max(n_train, 1)
        return LinearSVC(featuresCol="features", labelCol="_y", weightCol="weight", maxIter=max_iter, regParam=rp)
    return make


def boosted_trees(max_iter: int = 400, depth: int = 6, step: float = 0.05, seed: int = 42):
    """Depth 6, 400 rounds, rate .05, row and feature subsampling .8 (no L2 term in Spark)."""
    def make(n_train: int):
        return GBTClassifier(featuresCol="features", labelCol="_y", maxIter=max_iter, maxDepth=depth,
                             stepSize=step, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=seed,
                             cacheNodeIds=True)
    return make


def random_forest(num_trees: int = 500, max_depth: int = 30, min_leaf: int = 1, seed: int = 42,
                  bootstrap: bool = True, feature_subset: str = "sqrt"):
    """Balanced-weight forest; unlimited depth maps to Spark's maximum of 30. Node-id
    caching and a larger node batch cut the number of passes for deep trees."""
    def make(n_train: int):
        return RandomForestClassifier(featuresCol="features", labelCol="_y", weightCol="weight",
                                      numTrees=num_trees, maxDepth=max_depth, minInstancesPerNode=min_leaf,
                                      bootstrap=bootstrap, featureSubsetStrategy=feature_subset, seed=seed,
                                      maxMemoryInMB=1024, cacheNodeIds=True)
    return make


def _score_col(pred: DataFrame) -> F.Column:
    """Probability of the positive class, else its margin, else the prediction itself."""
    if "probability" in pred.columns:
        return vector_to_array("probability")[1]
    if "rawPrediction" in pred.columns:
        return vector_to_array("rawPrediction")[1]
    return F.col("prediction").cast("double")


def spread_for(estimator, rows: DataFrame, n: int, task_bytes: int = 64 << 20) -> DataFrame:
    """``rows`` (``n`` of them) in as many partitions as a forest's training points need at ``task_bytes`` each. A forest caches,
    for each row and tree, a bootstrap count and two node ids, so its points are far larger than the rows that
    sized the partitions. A table that fits one task, and rows for any other estimator, stay as they are. Rows are ordered
    by what the forest sees of them: its bootstrap draws go by position."""
    if not estimator.hasParam("numTrees"):
        return rows
    features, y = estimator.getFeaturesCol(), estimator.getLabelCol()
    first = rows.select(features).first()
    if first is None or first[0] is None:
        return rows
    point = 12 * estimator.getOrDefault("numTrees") + 8 * first[0].size + 256
    parts = -(-n * point // task_bytes)
    return rows.repartition(parts).sortWithinPartitions(F.xxhash64(features, y), y) if parts > 1 else rows


def fit_score(train: DataFrame, test: DataFrame, make, label: str = "label"):
    """Fit on train, score test: (model, test with ``score``)."""
    tr = with_balanced_weights(train.withColumn("_y", F.col(label).cast("double")), label)
    n = tr.count()
    estimator = make(n)
    model = estimator.fit(spread_for(estimator, tr, n))
    pred = model.transform(test.withColumn("_y", F.col(label).cast("double")))
    return model, pred.withColumn("score", _score_col(pred))


class FoldTable:
    """A cut feature table with folds, and the class counts of every fold: one job, shared by all fits. Each fit's weights
    are literals from the counts of its own training folds, so a fit needs no count, join or checkpoint."""

    def __init__(self, df: DataFrame, k: int, label: str = "label", id_col: str = "id", seed: int = 42, vec: str = "embedding"):
        from siftwork.session import cut_lineage
        f = stratified_folds(with_features(df, vec), k, label, id_col, seed)
        self.rows, self.label, self.id_col, self.k = cut_lineage(f.select(id_col, label, "features", "fold")), label, id_col, k
        self.counts = {(r["fold"], r[label]): r["n"] for r in self.rows.groupBy("fold", label).agg(F.count(F.lit(1)).alias("n")).collect()}  # folds x classes

    def train(self, without: int | None) -> tuple[DataFrame, int]:
        """(rows of all other folds with ``_y`` and balanced ``weight``, their number)."""
        have: dict = {}
        for (fold, y), n in self.counts.items():
            if fold != without:
                have[y] = have.get(y, 0) + n
        total, weight = sum(have.values()), F.lit(None).cast("double")
        for y, n in have.items():
            weight = F.when(F.col(self.label) == F.lit(y), F.lit(total / (2.0 * n))).otherwise(weight)
        rows = self.rows if without is None else self.rows.where(F.col("fold") != without)
        return rows.withColumn("_y", F.col(self.label).cast("double")).withColumn("weight", weight), total

    def fit(self, make, without: int | None):
        rows, n = self.train(without)
        estimator = make(n)
        return estimator.fit(spread_for(estimator, rows, n))

    def scored(self, make, fold: int) -> DataFrame:
        """(fold, id, label, score, prediction) of one fold by a model of the others."""
        test = self.rows.where(F.col("fold") == fold).withColumn("_y", F.col(self.label).cast("double"))
        pred = self.fit(make, fold).transform(test)
        return pred.select("fold", self.id_col, self.label, _score_col(pred).alias("score"), "prediction")


def shared_fits(folds: FoldTable, fits: list[tuple[dict, object]], path: str, parallelism: int = 4) -> DataFrame:
    """Cross-validated scored rows of many fits over one table, written to ``path`` and read back: each fit's tags, fold, id,
    label, score, prediction. Fits run ``parallelism`` at a time."""
    from concurrent.futures import ThreadPoolExecutor
    names = sorted({n for tags, _ in fits for n in tags})

    def one(task):
        (tags, make), fold = task
        scored = folds.scored(make, fold).select(*(F.lit(tags.get(n)).cast("string").alias(n) for n in names), "*")
        scored.write.mode("overwrite").parquet(f"{path}/{number[id(task[0])]}-{fold}")  # a folder each: fits end at any time
        return scored.schema

    number = {id(f): j for j, f in enumerate(fits)}
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        schemas = list(pool.map(one, itertools.product(fits, range(folds.k))))
    return folds.rows.sparkSession.read.schema(schemas[0]).parquet(f"{path}/*-*")


def model_search(df: DataFrame, estimator, grid: dict, k: int = 5, label: str = "label", id_col: str = "id", vec: str = "embedding",
                 seed: int = 42, sample: int | None = None, metric: str = "recall", parallelism: int = 4, path: str | None = None):
    """Cross-validated search over ``grid`` (parameter -> values) or ``sample`` seeded combinations of it:
    (best parameters, best model refitted on all rows, combinations, scored rows).

    combinations: one row per combination (its parameters, number of folds, mean ``recall`` and ``specificity`` over the folds,
    selected), best first: by ``metric``, then by the other one, then in the grid's order. Balanced weights come from
    each fit's own training folds. ``estimator(params, n_train)`` gives an estimator."""
    from siftwork.session import ensure_checkpoint_dir
    if metric not in ("recall", "specificity"):
        raise ValueError("metric must be recall or specificity")
    names = sorted(grid)
    combos = [dict(zip(names, c, strict=True)) for c in itertools.product(*[grid[n] for n in names])]
    if sample is not None and sample < len(combos):
        combos = random.Random(seed).sample(combos, sample)
    folds = FoldTable(df, k, label, id_col, seed, vec)
    spark = df.sparkSession
    path = path or f"{ensure_checkpoint_dir(spark)}/search-{uuid.uuid4().hex[:12]}"
    fits = [({"combination": str(j)}, lambda n, c=c: estimator(c, n)) for j, c in enumerate(combos)]
    scored = shared_fits(folds, fits, path, parallelism)
    y, hit = F.col(label).cast("int") == 1, F.col("prediction") == F.col(label).cast("double")
    per_fold = scored.groupBy("combination", "fold").agg(
        F.try_divide(F.count_if(y & hit), F.count_if(y)).alias("recall"), F.try_divide(F.count_if(~y & hit), F.count_if(~y)).alias("specificity"))
    means = {r["combination"]: r for r in per_fold.groupBy("combination").agg(F.count(F.lit(1)).alias("n"), F.avg("recall").alias("recall"), F.avg("specificity").alias("specificity")).collect()}
    other = "specificity" if metric == "recall" else "recall"
    order = sorted(range(len(combos)), key=lambda j: (-(means[str(j)][metric] or 0), -(means[str(j)][other] or 0), j))
    best = combos[order[0]]
    rows = [(j, *(str(combos[j][n]) for n in names), means[str(j)]["n"], means[str(j)]["recall"], means[str(j)]["specificity"], j == order[0]) for j in order]
    table = spark.createDataFrame(rows, "combination bigint, " + "".join(f"{n} string, " for n in names) + "n_folds bigint, recall double, specificity double, selected boolean")
    return best, folds.fit(lambda n: estimator(best, n), None), table, scored


def cross_val_scored(df: DataFrame, make, k: int = 5, label: str = "label", id_col: str = "id",
                     seed: int = 42, vec: str = "embedding", tags: dict | None = None,
                     parallelism: int | None = None) -> DataFrame:
    """Scored table of a k-fold cross-validation: one fit per fold, predictions unioned.
    Feature vectors and class counts are cut once (``FoldTable``) and reused by every fold; the k fits
    are submitted concurrently."""
    from concurrent.futures import ThreadPoolExecutor
    folds = FoldTable(df, k, label, id_col, seed, vec)

    def one(i):
        return folds.scored(make, i).drop("prediction")

    with ThreadPoolExecutor(max_workers=parallelism or k) as pool:
        parts = list(pool.map(one, range(k)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    for name, value in (tags or {}).items():
        out = out.withColumn(name, F.lit(value))
    return out


def platt_scale(scored_oof: DataFrame, scored: DataFrame, label: str = "label") -> DataFrame:
    """Sigmoid calibration: a one-feature logistic regression fitted on out-of-fold
    margins, applied to ``scored.score``."""
    tr = scored_oof.select(array_to_vector(F.array(F.col("score").cast("double"))).alias("f"),
                           F.col(label).cast("double").alias("_y"))
    lr = LogisticRegression(featuresCol="f", labelCol="_y", regParam=0.0).fit(tr)
    te = scored.withColumn("f", array_to_vector(F.array(F.col("score").cast("double"))))
    return lr.transform(te).withColumn("score", vector_to_array("probability")[1]) \
        .drop("f", "rawPrediction", "probability", "prediction")


def feature_importance(model, names) -> list[tuple[str, float]]:
    """(feature, importance) sorted descending, from a fitted tree model (one value per
    feature: a bounded driver-side list)."""
    imp = model.featureImportances.toArray().tolist()
    return sorted(zip(names, imp), key=lambda t: -t[1])


def importance_table(spark, model, names) -> DataFrame:
    """Importances with rank and cumulative share (top-5 / top-10 shares read off it)."""
    rows = [(n, float(v), i + 1) for i, (n, v) in enumerate(feature_importance(model, names))]
    df = spark.createDataFrame(rows, "feature string, importance double, rank int")
    w = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("cumulative_share", F.sum("importance").over(w) / F.sum("importance").over(Window.partitionBy()))


def grid_search(train: DataFrame, estimator, grid: dict, k: int = 5, label: str = "label",
                id_col: str = "id", seed: int = 42, metric_label: float = 1.0, parallelism: int = 4,
                sample: int | None = None):
    """``model_search`` around a Spark ML estimator over the columns ``features``, ``_y`` and ``weight``, maximising recall
    of the positive class (or specificity with metric_label=0.0): (best model, [(parameters, mean metric)])."""
    def make(params, n):
        return estimator.copy({estimator.getParam(p): v for p, v in params.items()})
    metric = "recall" if metric_label == 1.0 else "specificity"
    _, model, table, _ = model_search(train, make, grid, k, label, id_col, "features", seed, sample, metric, parallelism)
    values = {n: {str(x): x for x in v} for n, v in grid.items()}
    return model, [({n: values[n][r[n]] for n in sorted(grid)}, r[metric]) for r in sorted(table.collect(), key=lambda r: r["combination"])]


def seed_ensemble(scored_runs: DataFrame, id_col: str = "id") -> DataFrame:
    """Average probability per row over seeds (one row per id)."""
    return scored_runs.groupBy(id_col).agg(F.avg("score").alias("score"), F.first("label").alias("label"))


class _Buckets(dict):
    """Token -> bucket: the first 32 bits of its MD5; a bounded number is remembered."""

    def __init__(self, num_features: int, kept: int = 200_000):
        self.num_features, self.kept = num_features, kept

    def __missing__(self, token: bytes) -> int:
        if len(self) >= self.kept:
            self.clear()
        bucket = self[token] = int.from_bytes(hashlib.md5(token).digest()[:4], "big") % self.num_features
        return bucket


def hashing_encoder(num_features: int = 64, piece_bytes: int = 1 << 20):
    """Offline text encoder, a function of the text alone: ASCII word tokens, lower-cased,
    counted in ``num_features`` buckets by the first 32 bits of their MD5, L2-normalised.
    Stands in for a pretrained sentence encoder. Texts without tokens get a zero vector. Each different token is hashed once
    while a task remembers it; long texts are read in pieces that end after a token."""
    def encode(df: DataFrame, text_col: str = "text", key_col: str = "text_sha1") -> DataFrame:
        def run(batches):
            token, after, buckets = re.compile(rb"[a-z0-9]+"), re.compile(rb"[^A-Za-z0-9]"), _Buckets(num_features)
            for batch in batches:
                counts = np.zeros((batch.num_rows, num_features))
                for row, text in enumerate(batch.column(1)):
                    data, at = text.as_py() or b"", 0
                    while at < len(data):
                        cut = after.search(data, at + piece_bytes) if at + piece_bytes < len(data) else None
                        end = cut.start() if cut else len(data)
                        found = list(map(buckets.__getitem__, token.findall(data[at:end].lower())))
                        counts[row] += np.bincount(found, minlength=num_features) if found else 0
                        at = end
                norm = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
                unit = counts / np.where(norm == 0, 1.0, norm)
                ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * num_features)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(unit.ravel()))], names=[key_col, "embedding"])

        kind = df.schema[key_col].dataType.simpleString()
        return df.select(key_col, F.col(text_col).cast("binary")).mapInArrow(run, f"{key_col} {kind}, embedding array<double>")
    return encode


def embed_with_store(df: DataFrame, store_path: str, model_name: str, encoder, text_col: str = "text",
                     id_col: str = "id") -> DataFrame:
    """Content-keyed embedding cache: texts whose (model, sha1(text)) is already stored are
    not encoded again; new ones are encoded and appended (partitioned by model). The
    encoder sees different texts only, and only hashes go through the final join."""
    spark = df.sparkSession
    sha = F.sha1(F.col(text_col).cast("binary"))
    store = read_if_any(lambda: spark.read.parquet(store_path))
    todo = df.groupBy(sha.alias("text_sha1")).agg(F.first(text_col).alias(text_col)).where("text_sha1 is not null")
    if store is not None:
        todo = todo.join(store.where(F.col("model") == model_name).select("text_sha1"), "text_sha1", "left_anti")
    encoder(todo, text_col).select("text_sha1", "embedding", F.lit(model_name).alias("model")) \
        .write.mode("append").partitionBy("model").parquet(store_path)
    store = spark.read.schema("text_sha1 string, embedding array<double>, model string").parquet(store_path) \
        .where(F.col("model") == model_name)
    rows = df.select(*[c for c in df.columns if c != text_col], sha.alias("text_sha1"))
    return rows.join(store, "text_sha1", "inner").drop("text_sha1")


def svm_platt(inner_folds: int = 3, max_iter: int = 100):
    """Linear SVM with sigmoid calibration: margins of ``inner_folds`` inner
    cross-validation fits train a one-feature logistic regression, which then maps the
    margins of the SVM refitted on all training rows to probabilities."""
    def fit_score_calibrated(train: DataFrame, test: DataFrame, label: str = "label", id_col: str = "id"):
        inner = cross_val_scored(train, linear_svm(max_iter), inner_folds, label, id_col, vec="features")
        _, pred = fit_score(train, test, linear_svm(max_iter), label)
        return platt_scale(inner, pred.select(*[c for c in pred.columns
                                                if c not in ("rawPrediction", "probability", "prediction")]),
                           label)
    return fit_score_calibrated


# Encoder choice by model name (X-04): name -> factory returning an encoder function
ENCODERS = {"hashing-64": lambda: hashing_encoder(64), "hashing-256": lambda: hashing_encoder(256)}


def get_encoder(name: str):
    if name not in ENCODERS:
        raise KeyError(f"unknown encoder {name!r}; known: {sorted(ENCODERS)}")
    return ENCODERS[name]()


def benchmark_classifiers(vectors: DataFrame, classifiers: dict, k: int = 5, label: str = "label",
                          id_col: str = "id", model_col: str = "embedding_model", seed: int = 42) -> DataFrame:
    """Every (embedding model, classifier) pair cross-validated; the scored rows of all
    pairs are unioned so the metrics of the whole grid are one grouped query."""
    models = [r[0] for r in vectors.select(model_col).distinct().collect()]  # a handful of names
    parts = []
    for m in sorted(models):
        sub = vectors.where(F.col(model_col) == m)
        for name, make in classifiers.items():
            parts.append(cross_val_scored(sub, make, k, label, id_col, seed,
                                          tags={model_col: m, "classifier": name}))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def refit_on_kept(wide: DataFrame, features: list[str], kept: list[str], make, label: str = "label", id_col: str = "id", test: float = 0.2,
                  seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """One classifier fitted on all ``features`` and again on the ``kept`` ones, over the same rows of one stratified hold-out:
    (scored test rows of both, tagged ``feature_set`` = all / kept, and the importance table of both: tree models)."""
    from siftwork.operators.split import holdout_split
    from siftwork.session import cut_lineage
    if not kept or set(kept) - set(features):
        raise ValueError("kept must be some of the features")
    rows = cut_lineage(holdout_split(wide.select(id_col, label, *features), test, 0.0, label, id_col, seed))
    scored, importance = [], []
    for name, columns in (("all", features), ("kept", kept)):
        x = with_features(rows.withColumn("embedding", F.array(*columns)))
        model, pred = fit_score(x.where("split = 'train'"), x.where("split = 'test'"), make, label)
        scored.append(pred.select(F.lit(name).alias("feature_set"), id_col, label, "score"))
        importance.append(importance_table(wide.sparkSession, model, columns).withColumn("feature_set", F.lit(name)))
    return scored[0].unionByName(scored[1]), importance[0].unionByName(importance[1])


def evaluated(df: DataFrame, classifier: str, make, store_path: str, params: dict | None = None, k: int = 5, label: str = "label",
              id_col: str = "id", vec: str = "embedding", embedding_model: str = "given", seed: int = 42,
              target_recall: float | None = None) -> DataFrame:
    """Fold metrics of one cross-validated classifier, from the result store when the same data
    and configuration were evaluated before, else fitted, evaluated and stored. Default
    threshold without ``target_recall``. Stored rows carry n_samples, n_features, n_splits,
    random_state, parameters, target_recall and created_at."""
    from siftwork.operators import ranking as R
    from siftwork.operators import store as ST
    spark = df.sparkSession
    data_key = ST.data_hash_value(df, [id_col, label, vec])
    config_key = ST.config_hash(classifier, params or {}, k=k, seed=seed, target_recall=target_recall, embedding_model=embedding_model)
    stored = ST.load_results(spark, store_path, data_key, config_key, embedding_model, classifier)
    if stored is not None:
        return stored
    scored = cross_val_scored(df, make, k, label, id_col, seed, vec, {"embedding_model": embedding_model, "classifier": classifier})
    group = ["embedding_model", "classifier", "fold"]
    folds = R.evaluate_default(scored, group) if target_recall is None else R.evaluate_fixed_recall(scored, group, target_recall)
    size = df.agg(F.count(F.lit(1)), F.max(F.size(vec))).first()
    meta = {"n_samples": F.lit(size[0]), "n_features": F.lit(size[1]), "n_splits": F.lit(k), "random_state": F.lit(seed),
            "parameters": F.lit(repr(sorted((params or {}).items()))), "created_at": F.current_timestamp()}
    if "target_recall" not in folds.columns:
        meta["target_recall"] = F.lit(target_recall).cast("double")
    ST.save_results(folds.withColumns(meta), store_path, data_key, config_key)
    return ST.load_results(spark, store_path, data_key, config_key, embedding_model, classifier)
