"""Views over the given tables that play the roles of the study's inputs.

The study ships no data, so each input shape is derived from the generated
tables (the same derivations are written in SQL for the oracle):

* ``scored``   events -> (id, fold, label, score, prob): a scored table with ties
* ``papers``   documents JOIN labels -> (id, title, abstract, label)
* ``vectors``  embeddings -> (id, embedding, label, target)
* ``answers``  papers x 29 questions -> long answer table by an integer rule
* ``decisions`` conversations -> raw model responses with token counts and a model
* ``runs``     events -> repeated runs of three models
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.functions.text import after_first_line, first_line
from siftwork.sources.dimensions import price_table, question_ids
from siftwork.sources.tables import read_table

N_FOLDS = 5


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a scored table: label = purchase, score = value (2 decimals, ties),
    fold = props.k % 5, prob = value / (value + 30) (a probability-like score)."""
    ev = read_table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return ev.select(F.col("event_id").alias("id"), (k % N_FOLDS).alias("fold"),
                     (F.col("event_type") == "purchase").alias("label"),
                     F.col("value").alias("score"),
                     (F.col("value") / (F.col("value") + F.lit(30.0))).alias("prob"))


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as papers: title = first line, abstract = the rest."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    lab = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    j = docs.join(lab, on="doc_id", how="inner")
    return j.select(F.col("doc_id").alias("id"), first_line("text").alias("title"),
                    after_first_line("text").alias("abstract"), (F.col("quality") == 1).alias("label"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings with the binary target label = 0."""
    e = read_table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), "embedding", "label",
                    (F.col("label") == 0).alias("target"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long answer table (paper_id, question_id, response, model, input_tokens,
    output_tokens) for every labelled document x 29 questions.

    Integer rule: the UNSURE rate of question q is about q %, include questions
    correlate positively with the label, exclusion questions negatively, except
    E3, E7, E11 (q % 4 = 0) which have the wrong sign. Every third document is answered
    without regard to its label, so answer patterns recur with both labels (conflicts and
    ties). The model is one of the priced ones, by doc_id % 5."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    lab = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    base = docs.join(lab, on="doc_id", how="inner")
    q = F.explode(F.sequence(F.lit(1), F.lit(len(question_ids())))).alias("q")
    x = base.select("doc_id", "quality", "n_chars", q)
    d, qq = F.col("doc_id"), F.col("q")
    ql = F.when(d % 3 == 0, 0).otherwise(F.col("quality"))
    models = F.array(*[F.lit(m) for m in price_table()])
    yes_cut = F.when((qq <= 17) | (qq % 4 == 0), 30 + 30 * ql).otherwise(60 - 30 * ql)
    resp = (F.when((d * 7 + qq * 13) % 100 < qq, F.lit("UNSURE"))
            .when((d * 31 + qq * 17) % 100 < yes_cut, F.lit("YES")).otherwise(F.lit("NO")))
    qid = F.when(qq <= 17, F.concat(F.lit("I"), qq.cast("string"))) \
        .otherwise(F.concat(F.lit("E"), (qq - 17).cast("string")))
    return x.select(d.alias("paper_id"), qid.alias("question_id"), resp.alias("response"),
                    F.element_at(models, (d % 5 + 1).cast("int")).alias("model"),
                    (F.lit(50) + F.expr("n_chars div 4")).cast("long").alias("input_tokens"),
                    (F.lit(1) + qq % 7).cast("long").alias("output_tokens"))


def paper_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = read_table(spark, sf_dir, "labels")
    return lab.select(F.col("doc_id").alias("paper_id"), (F.col("quality") == 1).alias("label"))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as raw model responses: one of the five priced models by
    conv_id % 5, input tokens = length(text), output tokens = 1 + turn."""
    c = read_table(spark, sf_dir, "conversations")
    models = F.array(*[F.lit(m) for m in price_table().keys()])
    return c.select(F.col("conv_id").alias("id"), "turn", F.col("text").alias("raw_response"),
                    F.element_at(models, (F.col("conv_id") % 5 + 1).cast("int")).alias("model"),
                    F.length("text").cast("long").alias("input_tokens"),
                    (F.col("turn") + 1).cast("long").alias("output_tokens"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as repeated runs: run = event date (30 runs), model = user_id % 3,
    decision positive when the event is a purchase."""
    ev = read_table(spark, sf_dir, "events")
    return ev.select(F.col("event_id").alias("id"),
                     F.to_date(F.col("ts")).alias("run"),  # wall-clock date, any session zone
                     F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model"),
                     (F.col("event_type") == "purchase").alias("positive"))
