"""Answer-table analytics: yes/no/unsure answers per (paper, question) as features.

The long table ``(paper_id, question_id, response, ...)`` is the fact table;
statistics per question are plain grouped aggregates on it (algebraic, so a
question answered by every paper is combined map-side, never gathered into
one task). Pivoting to the wide matrix happens only at the ML edge, with an
explicit value list (no extra job to discover the columns).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.functions.text import encode_answer
from siftwork.session import cut_lineage
from siftwork.sources.dimensions import question_ids

UNSURE_RATE_MAX = 15.0  # fixed value: maximum UNSURE percentage allowed per question
UNSURE_SWEEP = (0.05, 0.1, 0.15, 0.20, 0.25, 0.3, 0.4, 0.5)  # fixed values: cost-sweep thresholds


def question_kind(qid) -> F.Column:
    q = F.col(qid) if isinstance(qid, str) else qid
    return F.when(q.startswith("I"), F.lit("include")).when(q.startswith("E"), F.lit("exclude"))


def pivot_answers(long: DataFrame, questions=None, index: str = "paper_id", key: str = "question_id",
                  value: str = "response", check_duplicates: bool = True) -> DataFrame:
    """Long -> wide, one column per question id; a duplicated (paper, question) cell
    raises at execution time (checked inside the same aggregation, no extra pass)."""
    qs = list(questions or question_ids())
    g = long.groupBy(index).pivot(key, qs)
    if check_duplicates:
        cell = F.when(F.count(F.lit(1)) > 1,
                      F.raise_error(F.lit("duplicate (paper, question) answer")).cast("string")) \
            .otherwise(F.first(value))
        return g.agg(cell)
    return g.agg(F.first(value))


def unpivot_answers(wide: DataFrame, questions=None, index: str = "paper_id") -> DataFrame:
    qs = list(questions or question_ids())
    return wide.unpivot([index], qs, "question_id", "response").where(F.col("response").isNotNull())


def encode_features(wide: DataFrame, feature_cols, unsure_as_one: bool = True, strict: bool = True) -> DataFrame:
    """YES 1, NO 0, UNSURE 1 (or 0.5); anything else raises (strict) or becomes NULL."""
    out = [encode_answer(c, unsure_as_one, strict).alias(c) if c in feature_cols else F.col(c)
           for c in wide.columns]
    return wide.select(*out)


def unsure_rates(long: DataFrame, key: str = "question_id", value: str = "response",
                 max_pct: float = UNSURE_RATE_MAX) -> DataFrame:
    """Percentage of UNSURE answers per question among its answers, flagged above max_pct."""
    s = long.groupBy(key).agg(
        (F.lit(100.0) * F.count_if(F.col(value) == "UNSURE") / F.count(F.lit(1))).alias("unsure_pct"),
        F.count(F.lit(1)).alias("n_answers"))
    return s.withColumn("high_unsure", F.col("unsure_pct") > F.lit(float(max_pct)))


def label_correlation(long: DataFrame, labels: DataFrame, key: str = "question_id",
                      value: str = "response", index: str = "paper_id", label: str = "label",
                      unsure_as_one: bool = True) -> DataFrame:
    """Pearson correlation of each encoded question with the label, and the sign check
    (include questions should correlate positively, exclusion questions negatively).

    covar_pop / (stddev_pop * stddev_pop) with try_divide: a constant column gives NULL
    instead of the divide-by-zero error ``corr`` raises under ANSI mode."""
    j = long.join(labels.select(index, label), on=index, how="inner")
    x = encode_answer(value, unsure_as_one, strict=True)
    y = F.col(label).cast("double")
    s = j.groupBy(key).agg(F.covar_pop(x, y).alias("_cov"), F.stddev_pop(x).alias("_sx"),
                           F.stddev_pop(y).alias("_sy"))
    corr = F.try_divide(F.col("_cov"), F.col("_sx") * F.col("_sy"))
    kind = question_kind(key)
    wrong = F.when(kind == "include", corr < 0).when(kind == "exclude", corr > 0).otherwise(F.lit(False))
    return s.select(key, corr.alias("corr"), kind.alias("kind"), F.coalesce(wrong, F.lit(False)).alias("wrong_sign"))


def feature_filter(unsure: DataFrame, corr: DataFrame, key: str = "question_id") -> DataFrame:
    """Questions to drop: UNSURE rate above the maximum OR an exclusion question with a
    positive correlation (union of both lists); the rest are kept."""
    j = unsure.select(key, "unsure_pct", "high_unsure").join(
        corr.select(key, "corr", "kind", "wrong_sign"), on=key, how="full")
    wrong_e = (F.col("kind") == "exclude") & F.col("wrong_sign")
    removed = F.coalesce(F.col("high_unsure"), F.lit(False)) | F.coalesce(wrong_e, F.lit(False))
    return j.select(key, "unsure_pct", "corr", F.coalesce("high_unsure", F.lit(False)).alias("high_unsure"),
                    F.coalesce(wrong_e, F.lit(False)).alias("wrong_sign_exclude"), removed.alias("removed"))


def pattern_key(feature_cols) -> F.Column:
    """Stable key of a feature vector (SHA-256 of the values; NULL-aware)."""
    return F.sha2(F.to_json(F.array(*[F.col(c).cast("string") for c in feature_cols])), 256)


def pattern_stats(df: DataFrame, key: F.Column, label: str = "label") -> DataFrame:
    """Per distinct pattern key: rows, positives, min/max label (partial aggregates, so
    a pattern shared by a third of all papers is combined map-side)."""
    y = F.col(label).cast("int")
    return df.groupBy(key.alias("_pk")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(y).alias("_pos"), F.min(y).alias("_miny"), F.max(y).alias("_maxy"))


def _with_pattern(df: DataFrame, feature_cols, label: str) -> DataFrame:
    """Rows joined with their pattern statistics. The rows (usually a pivot) and their keys
    are computed once and cut: both sides of the join read them. The statistics side has one
    row per pattern; a hot pattern makes one join partition large on the row side only, which
    AQE's skew-join handling splits (the one-row stats side is just replicated)."""
    rows = cut_lineage(df.withColumn("_pk", pattern_key(feature_cols)))
    return rows.join(pattern_stats(rows, F.col("_pk"), label), on="_pk", how="inner")


def conflicts(df: DataFrame, feature_cols, label: str = "label") -> DataFrame:
    """Rows whose identical feature vector occurs with both labels."""
    j = _with_pattern(df, feature_cols, label)
    return j.where(F.col("_miny") != F.col("_maxy")).drop("_pk", "_n", "_pos", "_miny", "_maxy")


def conflict_summary(df: DataFrame, feature_cols, label: str = "label") -> DataFrame:
    """Totals: rows, conflicting rows, distinct conflicting patterns, positives."""
    st = pattern_stats(df, pattern_key(feature_cols), label)
    conf = F.col("_miny") != F.col("_maxy")
    return st.agg(F.sum("_n").alias("n_rows"),
                  F.sum(F.when(conf, F.col("_n")).otherwise(0)).alias("n_conflicting_rows"),
                  F.count_if(conf).alias("n_conflicting_patterns"),
                  F.sum("_pos").alias("n_positive"))


def resolve_conflicts(df: DataFrame, feature_cols, label: str = "label",
                      strategy: str = "majority") -> DataFrame:
    """'remove': drop every row of a conflicting pattern; 'majority': keep rows carrying
    the pattern's majority label (a tie counts as positive, favouring recall)."""
    j = _with_pattern(df, feature_cols, label)
    if strategy == "remove":
        keep = F.col("_miny") == F.col("_maxy")
    elif strategy == "majority":
        maj = (F.lit(2) * F.col("_pos")) >= F.col("_n")
        keep = F.col(label) == maj
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    return j.where(keep).drop("_pk", "_n", "_pos", "_miny", "_maxy")


def skip_answered(todo: DataFrame, done: DataFrame, keys=("paper_id", "question_id")) -> DataFrame:
    """Work still to do: anti-join against what the answer store already holds."""
    return todo.join(done.select(*keys), on=list(keys), how="left_anti")
