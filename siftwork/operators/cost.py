"""Token costs: price lookup, per-row cost, summaries, and the UNSURE-threshold
cost-savings sweep. Prices are joined on the model without a size hint, and an
unknown model raises instead of silently costing 0."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.functions.expr import round_np
from siftwork.operators.answers import UNSURE_SWEEP


def with_price(df: DataFrame, prices: DataFrame, model: str) -> DataFrame:
    """Left join of the price dimension: adds ``_price`` (in, out), null for an unknown model."""
    p = prices.select(F.col("model").alias("_pm"), F.struct(
        F.col("usd_per_1m_in").cast("double").alias("pin"), F.col("usd_per_1m_out").cast("double").alias("pout")).alias("_price"))
    return df.join(p, F.col(model) == F.col("_pm"), "left").drop("_pm")


def add_cost(df: DataFrame, prices: DataFrame, model: str = "model", in_tok: str = "input_tokens",
             out_tok: str = "output_tokens", out: str = "cost_usd", digits: int = 6) -> DataFrame:
    """cost = in/1e6 * price_in + out/1e6 * price_out, rounded to ``digits``; a model
    without a price raises."""
    columns = [c for c in df.columns if c != out]
    price = F.col("_price")
    missing = F.raise_error(F.concat(F.lit("no price for model "), F.coalesce(F.col(model), F.lit("NULL"))))
    cost = (F.coalesce(F.col(in_tok), F.lit(0)) / F.lit(1e6) * price["pin"]
            + F.coalesce(F.col(out_tok), F.lit(0)) / F.lit(1e6) * price["pout"])
    total = F.when(price.isNull(), missing.cast("double")).otherwise(round_np(cost, digits))
    return with_price(df, prices, model).select(*columns, total.alias(out))


def cost_totals(df: DataFrame, prices: DataFrame, group_cols=("model",), model: str = "model",
                in_tok: str = "input_tokens", out_tok: str = "output_tokens") -> DataFrame:
    """Per model: token totals -> total cost, cost per row ('paper'), per 1k rows, n
    (rounded 3 / 4 / 3 as reported)."""
    g = list(group_cols)
    s = df.groupBy(*g).agg(F.sum(in_tok).alias("tot_in"), F.sum(out_tok).alias("tot_out"),
                           F.count(F.lit(1)).alias("n_papers"))
    price = F.col("_price")
    j = with_price(s, prices, model)
    tot = (F.col("tot_in") / F.lit(1e6) * price["pin"] + F.col("tot_out") / F.lit(1e6) * price["pout"])
    per = tot / F.col("n_papers")
    return j.select(*g, round_np(per, 4).alias("cost_per_paper"), round_np(per * 1000, 3).alias("cost_per_1k_papers"),
                    round_np(tot, 3).alias("total_cost"), F.col("n_papers").cast("long").alias("n_papers"))


def cost_summary(df: DataFrame, paper: str = "paper_id", cost: str = "cost_usd") -> DataFrame:
    """Total; mean per response; mean over papers of the per-paper MEAN; and
    sum of per-paper means / (papers / 1000). Two-level aggregation."""
    per = df.groupBy(paper).agg(F.avg(cost).alias("_m"), F.sum(cost).alias("_s"), F.count(F.lit(1)).alias("_n"))
    return per.agg(
        round_np(F.sum("_s"), 3).alias("total_cost"),
        round_np(F.sum("_s") / F.sum("_n"), 4).alias("avg_cost_per_response"),
        round_np(F.avg("_m"), 4).alias("avg_cost_per_paper"),
        round_np(F.sum("_m") / (F.count(F.lit(1)) / F.lit(1000.0)), 2).alias("avg_cost_per_1000_papers"))


def per_paper_costs(df: DataFrame, paper: str = "paper_id", key: str = "question_id",
                    cost: str = "cost_usd") -> DataFrame:
    return df.groupBy(paper).agg(F.count(key).alias("n_questions"), F.sum(cost).alias("total_cost_usd"),
                                 F.avg(cost).alias("avg_cost_usd"))


def cost_per_1000(df: DataFrame, paper: str = "paper_id", cost: str = "cost_usd") -> DataFrame:
    """Mean over papers of the per-paper SUM x 1000 (differs from the summary above)."""
    per = df.groupBy(paper).agg(F.sum(cost).alias("_s"))
    return per.agg((F.avg("_s") * 1000).alias("cost_per_1000"))


def cost_savings_sweep(answers_cost: DataFrame, question_stats: DataFrame, thresholds=UNSURE_SWEEP,
                       paper: str = "paper_id", key: str = "question_id", cost: str = "cost_usd") -> DataFrame:
    """For each UNSURE threshold t: questions removed (rate > 100 t, or wrong-sign
    exclusion question), remaining, cost per 1000 papers over the kept questions,
    savings versus all questions (the all-question figure rounded to 2 first, as
    reported) and savings %.

    Everything is aggregated per question and per paper once; thresholds are applied
    to those small aggregates, never by multiplying the answer rows."""
    ts = [float(t) for t in thresholds]
    qs = question_stats.select(key, "unsure_pct", F.coalesce("wrong_sign_exclude", F.lit(False)).alias("_w"))
    q_cost = answers_cost.groupBy(key).agg(F.sum(cost).alias("_qc"))
    qj = qs.join(q_cost, on=key, how="left")
    kept = [(~F.col("_w")) & (F.col("unsure_pct") <= F.lit(t * 100)) for t in ts]
    q_agg = qj.agg(F.count(F.lit(1)).alias("_nq"),
                   *[F.sum(F.when(k, F.col("_qc")).otherwise(0.0)).alias(f"_c{i}") for i, k in enumerate(kept)],
                   *[F.count_if(~k).alias(f"_r{i}") for i, k in enumerate(kept)])
    # papers counted at t: those with an answered question kept at t, i.e. whose smallest
    # UNSURE rate among answered, right-signed questions is <= 100 t
    pj = answers_cost.join(qs, on=key, how="inner")
    per_paper = pj.groupBy(paper).agg(
        F.min(F.when(~F.col("_w"), F.col("unsure_pct"))).alias("_mr"), F.sum(cost).alias("_ps"))
    p_agg = per_paper.agg(F.avg("_ps").alias("_all"),
                          *[F.count_if(F.col("_mr") <= F.lit(t * 100)).alias(f"_p{i}") for i, t in enumerate(ts)])
    both = q_agg.select("*", *[p_agg.select(c).scalar().alias(c) for c in p_agg.columns])  # 1 row each
    rows = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"_c{i}").alias("_c"),
                              F.col(f"_r{i}").alias("_r"), F.col(f"_p{i}").alias("_p"))
                     for i, t in enumerate(ts)])
    x = both.select("_nq", "_all", F.inline(rows))
    all_1000 = round_np(F.col("_all") * 1000, 2)
    filt = F.try_divide(F.col("_c"), F.col("_p").cast("double")) * 1000
    sav = all_1000 - filt
    return x.select("threshold", (F.col("threshold") * 100).alias("threshold_pct"),
                    F.col("_r").cast("long").alias("features_removed"),
                    (F.col("_nq") - F.col("_r")).cast("long").alias("features_remaining"),
                    filt.alias("cost_per_1000"), sav.alias("cost_savings"),
                    (sav / all_1000 * 100).alias("cost_savings_pct"))
