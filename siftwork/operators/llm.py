"""Model-answer operators: decision parsing and evaluation, prompt assembly, and the
batch labelling seam where an external model is attached.

The model call itself is injected: ``label_with`` runs a *completer* (any
callable mapping a pandas Series of prompts to responses and token counts)
inside ``mapInArrow`` on the executors, a bounded number of characters at a time. The
default completer is a deterministic rule, so everything runs offline.
Results are appended to an answer store; a rerun anti-joins against the store
and calls the model only for missing (paper, question) pairs.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.functions.expr import as_int, f_beta, safe_div
from siftwork.functions.text import parse_decision
from siftwork.session import read_if_any


def parse_decisions(df: DataFrame, raw: str = "raw_response", out: str = "decision") -> DataFrame:
    return df.withColumn(out, parse_decision(raw))


def decision_distribution(df: DataFrame, group_cols=("model",), decision: str = "decision") -> DataFrame:
    """Share of YES / NO / UNCERTAIN per group (0 for an absent class), uncertain count."""
    d = F.col(decision)
    return df.groupBy(*group_cols).agg(
        F.avg((d == "YES").cast("double")).alias("share_yes"),
        F.avg((d == "NO").cast("double")).alias("share_no"),
        F.avg((d == "UNCERTAIN").cast("double")).alias("share_uncertain"),
        F.count_if(d == "UNCERTAIN").alias("total_uncertain"),
        F.count(F.lit(1)).alias("total_samples"))


def predicted_positive(decision: str = "decision", uncertain_as_positive: bool = True) -> F.Column:
    d = F.col(decision)
    return d.isin("YES", "UNCERTAIN") if uncertain_as_positive else (d == "YES")


def evaluate_decisions(df: DataFrame, group_cols=("model",), label: str = "label",
                       decision: str = "decision", uncertain_as_positive: bool = True) -> DataFrame:
    """Accuracy, precision, recall, F1, specificity (0 on empty denominators), uncertain
    rate and counts per group, in one aggregation pass."""
    y = as_int(label)
    p = predicted_positive(decision, uncertain_as_positive).cast("int")
    s = df.groupBy(*group_cols).agg(
        F.sum(y * p).alias("tp"), F.sum((1 - y) * p).alias("fp"), F.sum(y * (1 - p)).alias("fn"),
        F.sum((1 - y) * (1 - p)).alias("tn"), F.count_if(F.col(decision) == "UNCERTAIN").alias("total_uncertain"),
        F.count(F.lit(1)).alias("total_samples"))
    return s.select(*group_cols, F.lit(uncertain_as_positive).alias("uncertain_as_positive"),
                    safe_div(F.col("tp") + F.col("tn"), "total_samples").alias("accuracy"),
                    safe_div("tp", F.col("tp") + F.col("fp")).alias("precision"),
                    safe_div("tp", F.col("tp") + F.col("fn")).alias("recall"),
                    f_beta("tp", "fp", "fn", 1.0).alias("f1_score"),
                    safe_div("tn", F.col("tn") + F.col("fp")).alias("specificity"),
                    safe_div("total_uncertain", "total_samples").alias("uncertain_rate"),
                    F.col("total_uncertain").cast("long").alias("total_uncertain"),
                    F.col("total_samples").cast("long").alias("total_samples"))


def join_decisions(papers: DataFrame, decisions: DataFrame, id_col: str = "id"):
    """(joined, failures): inner join on id like the study, plus the papers that got no
    decision (the study drops them silently)."""
    return (papers.join(decisions, on=id_col, how="inner"),
            papers.join(decisions.select(id_col), on=id_col, how="left_anti"))


def zero_shot_prompt(include_criteria: str, exclude_criteria: str, examples: F.Column | None = None,
                     title: str = "title", abstract: str = "abstract") -> F.Column:
    """Screening prompt: criteria, optional example block, the paper, the answer rule."""
    parts = [F.lit("You screen papers for a systematic review.\n\nINCLUSION CRITERIA:\n"),
             F.lit(include_criteria), F.lit("\n\nEXCLUSION CRITERIA:\n"), F.lit(exclude_criteria), F.lit("\n\n")]
    if examples is not None:
        parts += [F.coalesce(examples, F.lit("")), F.lit("\n")]
    parts += [F.lit("PAPER:\nTitle: "), F.coalesce(F.col(title), F.lit("")), F.lit("\nAbstract: "),
              F.coalesce(F.col(abstract), F.lit("")),
              F.lit("\n\nAnswer with exactly one word: YES, NO or UNCERTAIN.")]
    return F.concat(*parts)


def example_block(examples: DataFrame, query_col: str = "query_id", group_order: str = "group_order",
                  rank: str = "rank", title: str = "title", abstract: str = "abstract",
                  label: str = "label") -> DataFrame:
    """Few-shot block per query: 'EXAMPLES:' then Title / Abstract / Label (YES|NO) per
    example, includes before excludes, each by rank. Groups are k-bounded."""
    item = F.concat(F.lit("Title: "), F.coalesce(F.col(title), F.lit("")), F.lit("\nAbstract: "),
                    F.coalesce(F.col(abstract), F.lit("")), F.lit("\nLabel: "),
                    F.when(F.col(label), F.lit("YES")).otherwise(F.lit("NO")), F.lit("\n\n"))
    s = examples.groupBy(query_col).agg(
        F.array_sort(F.collect_list(F.struct(F.col(group_order).alias("g"), F.col(rank).alias("r"),
                                             item.alias("t")))).alias("_items"))
    return s.select(query_col, F.concat(F.lit("EXAMPLES:\n\n"),
                                        F.array_join(F.transform("_items", lambda x: x["t"]), "")).alias("examples"))


# ------------------------------------------------------------------ batch labelling seam

def rule_completer(prompts: pd.Series, keys: pd.DataFrame | None = None) -> pd.DataFrame:
    """Deterministic offline stand-in for a model: answer chosen by MD5 of the prompt
    key, token counts from the prompt length."""
    key = keys["key"] if keys is not None and "key" in keys else prompts
    vocab = ("YES", "NO", "UNSURE")
    resp = [vocab[int(hashlib.md5(str(k).encode("utf-8")).hexdigest()[:8], 16) % 3] for k in key]
    return pd.DataFrame({"response": resp,
                         "input_tokens": prompts.str.len().floordiv(4).astype("int64"),
                         "output_tokens": pd.Series([1] * len(prompts), dtype="int64")})


def label_with(df: DataFrame, completer: Callable = rule_completer, prompt_col: str = "prompt",
               key_col: str | None = None, model: str = "rule", keep_errors: bool = False,
               each: str | None = None, keep_prompt: bool = True, call_chars: int = 1 << 22) -> DataFrame:
    """Run ``completer`` over the prompts inside the executors, at most ``call_chars`` characters of prompts at a time (one
    prompt at least), so that a worker's memory does not follow the number or the length of the texts.
    Adds response, input_tokens, output_tokens, model. Keep the input repartitioned to
    bound concurrency (one partition = one sequential caller).

    With ``each`` (a column of (question_id, question) arrays) a row stands for one prompt per question, put together where it
    is sent: the text, which crosses to the worker once, and the question. The answers come as an array column ``answers`` of the
    same order (``each_answer`` gives a row each); a question's key is ``key_col`` and its id joined by a colon.
    Without ``keep_prompt`` the prompt column is not given back.

    With ``keep_errors`` a prompt that raises does not end the job: its batch is repeated
    prompt by prompt, and the failing rows have a null response and the message in an
    ``error`` column (null for the others)."""
    carried = [c for c in df.columns if c != each and (keep_prompt or c != prompt_col)]
    names = ["response", "input_tokens", "output_tokens", *(["error"] if keep_errors else [])]
    added = [f"{n}:{'bigint' if n.endswith('tokens') else 'string'}" for n in names]
    kinds = [f"{n} {df.schema[n].dataType.simpleString()}" for n in carried]
    if each:
        out_schema = ", ".join([*kinds, f"answers array<struct<{','.join(['question_id:string', 'question:string', *added])}>>", "model string"])
    else:
        out_schema = ", ".join([*kinds, *(x.replace(":", " ") for x in added[:3]), "model string", *(x.replace(":", " ") for x in added[3:])])

    def call(prompts, keys):
        res = completer(pd.Series(prompts, dtype=object), None if keys is None else pd.DataFrame({"key": keys}))
        return list(zip(res["response"].tolist(), res["input_tokens"].astype("int64").tolist(), res["output_tokens"].astype("int64").tolist(),
                        [None] * len(prompts), strict=True))

    def call_one(prompt, key):
        try:
            return call([prompt], key)
        except Exception as e:  # noqa: BLE001 - a completer may raise anything; the row says what
            return [(None, 0, 0, f"{type(e).__name__}: {e}")]

    def answered(prompts, keys):
        try:
            return call(prompts, keys)
        except Exception:
            if not keep_errors:
                raise
            return [x for k, p in enumerate(prompts) for x in call_one(p, None if keys is None else keys[k:k + 1])]

    def requests(batch, at):
        """(prompt, key, question_id, question) of one row."""
        text, key = batch.column(prompt_col)[at].as_py(), batch.column(key_col)[at].as_py() if key_col else None
        if each is None:
            return [(text, key, None, None)]
        asked = [(q["question_id"], q["question"]) for q in batch.column(each)[at].as_py() or []]
        return [(None if text is None or q is None else with_question(text, q), ":".join(x for x in (key, i) if x is not None), i, q) for i, q in asked]

    def packed(batch, at, n, sizes, rows):
        part = batch.slice(at, n)
        kept = [part.column(c) for c in carried]
        columns = [pa.array([r[k] for r in rows], pa.int64() if x.endswith("tokens") else pa.string()) for k, x in enumerate(names, 2)]
        if not each:
            kept += [*columns[:3], pa.array([model] * n, pa.string()), *columns[3:]]
            return pa.RecordBatch.from_arrays(kept, names=[*carried, *names[:3], "model", *names[3:]])
        asked = [pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)]
        answers = pa.StructArray.from_arrays([*asked, *columns], names=["question_id", "question", *names])
        ends = pa.array([0, *itertools.accumulate(sizes)], pa.int32())
        return pa.RecordBatch.from_arrays([*kept, pa.ListArray.from_arrays(ends, answers), pa.array([model] * n, pa.string())], names=[*carried, "answers", "model"])

    def run(batches):
        for batch in batches:
            at, sizes, rows, todo, held = 0, [], [], [], 0
            for k in range(batch.num_rows):
                asked = requests(batch, k)
                sizes.append(len(asked))
                for request in asked:
                    if todo and held + len(request[0] or "") > call_chars:
                        rows, todo, held = rows + joined(todo), [], 0
                    todo.append(request)
                    held += len(request[0] or "")
                if len(rows) + len(todo) >= 5000 or k + 1 == batch.num_rows:
                    rows, todo, held = rows + joined(todo), [], 0
                    yield packed(batch, at, k + 1 - at, sizes, rows)
                    at, sizes, rows = k + 1, [], []

    def joined(todo):
        if not todo:
            return []
        got = answered([t[0] for t in todo], [t[1] for t in todo] if key_col or each else None)
        return [(t[2], t[3], *g) for t, g in zip(todo, got, strict=True)]

    return df.mapInArrow(run, out_schema)


def each_answer(answered: DataFrame) -> DataFrame:
    """One row per answer of ``label_with(..., each=...)``: the other columns, then those of the answer."""
    return answered.select(*(c for c in answered.columns if c != "answers"), F.inline("answers"))


def with_question(text, question):
    """The prompt of one question on a paper's text: strings or columns."""
    between = "\n\nQuestion: "
    return text + between + question if isinstance(text, str) else F.concat(text, F.lit(between), question)


def questions_array(questions) -> F.Column:
    """The questions as one array: a Python list is a literal, a DataFrame a scalar subquery."""
    if isinstance(questions, DataFrame):
        each = F.struct(F.col("id").alias("question_id"), F.coalesce("question", "id").alias("question"))
        return questions.agg(F.array_sort(F.collect_list(each))).scalar()
    return F.array(*[F.struct(F.lit(i).alias("question_id"), F.lit(q or i).alias("question"))
                     for i, q in questions])


def paper_requests(papers: DataFrame, questions, id_col: str = "id") -> DataFrame:
    """One row per paper: paper_id, its prompts' common beginning (``prompt``), and ``questions``, the array to ask."""
    text = F.concat(F.lit("Title: "), F.coalesce("title", F.lit("")), F.lit("\n\nAbstract: "), F.coalesce("abstract", F.lit("")))
    return papers.select(F.col(id_col).alias("paper_id"), text.alias("prompt"), questions_array(questions).alias("questions"))


def answer_requests(papers: DataFrame, questions, id_col: str = "id") -> DataFrame:
    """papers x questions with the saved prompt text, one row per (paper, question);
    the questions are one array, so this is an explode, not a join."""
    x = paper_requests(papers, questions, id_col).select("paper_id", "prompt", F.explode("questions").alias("_q"))
    return x.select("paper_id", F.col("_q.question_id").alias("question_id"), with_question(F.col("prompt"), F.col("_q.question")).alias("prompt"))


def run_answer_job(papers: DataFrame, questions, store_path: str, completer: Callable = rule_completer,
                   model: str = "rule", partitions: int | None = None) -> dict:
    """Answer every (paper, question) not yet in the store and append the new answers.

    Questions of one paper are asked in a row, sorted, so a provider-side prompt
    cache for the paper text stays warm. The store has a row per paper and run: the paper's text once and the answers as an
    array, so its size follows the texts and the answers, not their product; ``read_answers`` puts the prompts together.
    A failing prompt is stored with its ``error`` and
    without a response; it counts as not answered, so the next run tries it again.
    Returns processed / failed / skipped / stored counts (``read_answers`` and
    ``read_failures`` give the rows)."""
    spark = papers.sparkSession
    todo = paper_requests(papers, questions)
    done = read_answers(spark, store_path)
    total = todo.agg(F.sum(F.size("questions"))).first()[0] or 0
    before = _store_counts(spark, store_path)
    if done is not None:
        done = done.groupBy(F.col("paper_id").alias("_id")).agg(F.collect_set("question_id").alias("_done"))  # at most the questions
        left = F.filter("questions", lambda q: ~F.coalesce(F.array_contains("_done", q["question_id"]), F.lit(False)))
        todo = todo.join(done, F.col("paper_id") == F.col("_id"), "left").select("paper_id", "prompt", left.alias("questions"))
    pending = todo.withColumn("questions", F.array_sort("questions")).where(F.size("questions") > 0)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions", "8"))
    pending = pending.repartition(n, "paper_id").sortWithinPartitions("paper_id").withColumn("key", F.col("paper_id").cast("string"))
    answered = label_with(pending, completer, "prompt", "key", model, keep_errors=True, each="questions").drop("key")
    answered.write.mode("append").parquet(store_path)
    after = _store_counts(spark, store_path)
    processed, failed = after[0] - before[0], after[1] - before[1]
    return {"processed": processed, "failed": failed, "skipped": total - processed - failed, "stored": after[0]}


def _stored(spark, store_path: str) -> DataFrame | None:
    """A store's attempts, one row each with its prompt, None when there is none yet."""
    stored = read_if_any(lambda: spark.read.parquet(store_path))
    if stored is None:
        return None
    return each_answer(stored).withColumn("prompt", with_question(F.col("prompt"), F.col("question"))).drop("question")


def read_answers(spark, store_path: str) -> DataFrame | None:
    """The answered rows of a store, None when there is none yet."""
    stored = _stored(spark, store_path)
    return None if stored is None else stored.where("error is null").drop("error")


def read_failures(spark, store_path: str) -> DataFrame | None:
    """Failed attempts: paper_id, question_id, prompt, model, error."""
    stored = _stored(spark, store_path)
    return None if stored is None else stored.where("error is not null").select("paper_id", "question_id", "prompt", "model", "error")


def _store_counts(spark, store_path: str) -> tuple[int, int]:
    """(answers, failed attempts) in a store."""
    stored = _stored(spark, store_path)
    if stored is None:
        return 0, 0
    r = stored.agg(F.count_if(F.col("error").isNull()), F.count_if(F.col("error").isNotNull())).first()
    return int(r[0]), int(r[1])
