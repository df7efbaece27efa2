"""Registered model-answer queries (decisions, prompts, batch labelling) and DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwork.operators import cost as CO
from siftwork.operators import llm as L
from siftwork.plans import sqlsnips as S
from siftwork.plans.common import finish
from siftwork.sources import fixtures as fx
from siftwork.sources.dimensions import prices_df, question_ids
from siftwork.sources.tables import read_table

# Fixed values used by the registered prompt query (the criteria are parameters).
INCLUDE_CRITERIA = "Randomised trials in adults."
EXCLUDE_CRITERIA = "Reviews, protocols and animal studies."


def _decisions(spark, sf):
    return L.parse_decisions(fx.decisions(spark, sf))


def _labelled_decisions(spark, sf):
    lab = read_table(spark, sf, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("label"))
    return _decisions(spark, sf).join(lab, "id", "inner")


def q_decisions_parsed(spark, sf):
    """Raw responses parsed to YES / NO / UNCERTAIN (F-06)."""
    return _decisions(spark, sf).select("id", "turn", "model", "decision")


def q_decision_distribution(spark, sf):
    """Decision shares per model with 0 for absent classes; uncertain count (A-02, A-03)."""
    return finish(L.decision_distribution(_decisions(spark, sf)))


def q_decision_eval(spark, sf):
    """Decisions joined with labels and evaluated per model, uncertain as positive or not
    (M-07, J-01, P-17)."""
    d = _labelled_decisions(spark, sf)
    a = L.evaluate_decisions(d, ["model"], uncertain_as_positive=True)
    b = L.evaluate_decisions(d, ["model"], uncertain_as_positive=False)
    return finish(a.unionByName(b))


def q_decision_failures(spark, sf):
    """Labelled papers that received no decision (the study drops them silently) (J-01)."""
    p = fx.papers(spark, sf).select("id")
    _, fail = L.join_decisions(p, _decisions(spark, sf).select("id").distinct())
    return fail


def q_llm_costs(spark, sf):
    """Token totals to total cost, cost per paper and per 1000 papers, per model (A-05, F-13)."""
    return finish(CO.cost_totals(fx.decisions(spark, sf), prices_df(spark)))


def q_run_spread(spark, sf):
    """Mean and sample std over runs of the per-run positive rate, per model (A-16)."""
    r = fx.runs(spark, sf)
    per = r.groupBy("model", "run").agg(F.avg(F.col("positive").cast("double")).alias("rate"))
    return finish(per.groupBy("model").agg(F.avg("rate").alias("rate_mean"),
                                           F.stddev_samp("rate").alias("rate_std"),
                                           F.count(F.lit(1)).alias("n_runs")))


def q_zero_shot_prompts(spark, sf):
    """Screening prompt per paper (F-07)."""
    p = fx.papers(spark, sf)
    return p.select("id", L.zero_shot_prompt(INCLUDE_CRITERIA, EXCLUDE_CRITERIA).alias("prompt"))


def q_rule_answers(spark, sf):
    """Every paper x 29 questions answered through the batch seam with the offline rule
    completer (X-01, X-03, J-05, F-07)."""
    req = L.paper_requests(fx.papers(spark, sf), [(q, q) for q in question_ids()]).withColumn("key", F.col("paper_id").cast("string"))
    out = L.each_answer(L.label_with(req, L.rule_completer, "prompt", "key", model="rule", each="questions", keep_prompt=False))
    return out.select("paper_id", "question_id", "response", "input_tokens", "output_tokens", "model")


QUERIES = {
    "decisions_parsed": q_decisions_parsed,
    "decision_distribution": q_decision_distribution,
    "decision_eval": q_decision_eval,
    "decision_failures": q_decision_failures,
    "llm_costs": q_llm_costs,
    "run_spread": q_run_spread,
    "zero_shot_prompts": q_zero_shot_prompts,
    "rule_answers": q_rule_answers,
}

_MODELS = S.MODELS
_UP = f"upper({S.strip('text')})"

DEC = f"""dec AS (
  SELECT conv_id AS id, turn, text AS raw_response, {_MODELS}[CAST(conv_id % 5 AS INTEGER) + 1] AS model,
    CAST(length(text) AS BIGINT) AS input_tokens, CAST(turn + 1 AS BIGINT) AS output_tokens,
    CASE WHEN {_UP} IN ('YES', 'NO', 'UNCERTAIN') THEN {_UP}
         WHEN contains({_UP}, 'YES') THEN 'YES' WHEN contains({_UP}, 'NO') THEN 'NO' ELSE 'UNCERTAIN' END AS decision
  FROM conversations)"""

PRICES = S.PRICES

SQL_DECISIONS = f"WITH {DEC}\nSELECT id, turn, model, decision FROM dec"

SQL_DISTRIBUTION = f"""WITH {DEC}
SELECT model, ROUND(AVG(CASE WHEN decision = 'YES' THEN 1.0 ELSE 0.0 END), 6) AS share_yes,
  ROUND(AVG(CASE WHEN decision = 'NO' THEN 1.0 ELSE 0.0 END), 6) AS share_no,
  ROUND(AVG(CASE WHEN decision = 'UNCERTAIN' THEN 1.0 ELSE 0.0 END), 6) AS share_uncertain,
  CAST(COUNT_IF(decision = 'UNCERTAIN') AS BIGINT) AS total_uncertain, CAST(COUNT(*) AS BIGINT) AS total_samples
FROM dec GROUP BY model"""


def _eval_sql(unc: bool) -> str:
    pos = "decision IN ('YES', 'UNCERTAIN')" if unc else "decision = 'YES'"
    return f"""SELECT model, {str(unc).upper()} AS uncertain_as_positive,
  SUM(CASE WHEN label AND {pos} THEN 1 ELSE 0 END) AS tp, SUM(CASE WHEN NOT label AND {pos} THEN 1 ELSE 0 END) AS fp,
  SUM(CASE WHEN label AND NOT ({pos}) THEN 1 ELSE 0 END) AS fn, SUM(CASE WHEN NOT label AND NOT ({pos}) THEN 1 ELSE 0 END) AS tn,
  COUNT_IF(decision = 'UNCERTAIN') AS unc, COUNT(*) AS n
FROM j GROUP BY model"""


SQL_EVAL = f"""WITH {DEC},
j AS (SELECT d.*, l.quality = 1 AS label FROM dec d JOIN labels l ON d.id = l.doc_id),
e AS ({_eval_sql(True)} UNION ALL {_eval_sql(False)})
SELECT model, uncertain_as_positive,
  ROUND(COALESCE(CAST(tp + tn AS DOUBLE) / NULLIF(n, 0), 0.0), 6) AS accuracy,
  ROUND(COALESCE(CAST(tp AS DOUBLE) / NULLIF(tp + fp, 0), 0.0), 6) AS precision,
  ROUND(COALESCE(CAST(tp AS DOUBLE) / NULLIF(tp + fn, 0), 0.0), 6) AS recall,
  ROUND(COALESCE(2.0 * tp / NULLIF(2.0 * tp + fn + fp, 0), 0.0), 6) AS f1_score,
  ROUND(COALESCE(CAST(tn AS DOUBLE) / NULLIF(tn + fp, 0), 0.0), 6) AS specificity,
  ROUND(COALESCE(CAST(unc AS DOUBLE) / NULLIF(n, 0), 0.0), 6) AS uncertain_rate,
  CAST(unc AS BIGINT) AS total_uncertain, CAST(n AS BIGINT) AS total_samples
FROM e"""

SQL_FAILURES = f"""WITH {S.PAPERS}
SELECT id FROM papers WHERE id NOT IN (SELECT conv_id FROM conversations)"""

SQL_LLM_COSTS = f"""WITH {DEC},
{PRICES},
s AS (SELECT model, SUM(input_tokens) AS ti, SUM(output_tokens) AS tout, COUNT(*) AS n FROM dec GROUP BY model),
c AS (SELECT s.model, s.n, s.ti / 1e6 * p.pin + s.tout / 1e6 * p.pout AS tot FROM s JOIN prices p ON s.model = p.model)
SELECT model, ROUND(round_even(tot / n * 1e4, 0) / 1e4, 6) AS cost_per_paper,
  ROUND(round_even(tot / n * 1000 * 1e3, 0) / 1e3, 6) AS cost_per_1k_papers,
  ROUND(round_even(tot * 1e3, 0) / 1e3, 6) AS total_cost, CAST(n AS BIGINT) AS n_papers FROM c"""

SQL_RUN_SPREAD = """
WITH r AS (SELECT 'm' || CAST(user_id % 3 AS VARCHAR) AS model, CAST(ts AS DATE) AS run,
                  CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END AS positive FROM events),
per AS (SELECT model, run, AVG(positive) AS rate FROM r GROUP BY model, run)
SELECT model, ROUND(AVG(rate), 6) AS rate_mean, ROUND(STDDEV_SAMP(rate), 6) AS rate_std, CAST(COUNT(*) AS BIGINT) AS n_runs
FROM per GROUP BY model"""

SQL_PROMPTS = f"""WITH {S.PAPERS}
SELECT id, 'You screen papers for a systematic review.' || chr(10) || chr(10) || 'INCLUSION CRITERIA:' || chr(10)
  || {S.sq(INCLUDE_CRITERIA)} || chr(10) || chr(10) || 'EXCLUSION CRITERIA:' || chr(10) || {S.sq(EXCLUDE_CRITERIA)}
  || chr(10) || chr(10) || 'PAPER:' || chr(10) || 'Title: ' || COALESCE(title, '') || chr(10) || 'Abstract: '
  || COALESCE(abstract, '') || chr(10) || chr(10) || 'Answer with exactly one word: YES, NO or UNCERTAIN.' AS prompt
FROM papers"""

_QLIST = "[" + ", ".join(f"'{q}'" for q in question_ids()) + "]"

SQL_RULE_ANSWERS = f"""WITH {S.PAPERS},
q AS (SELECT unnest({_QLIST}) AS question_id),
r AS (SELECT p.id AS paper_id, q.question_id,
        'Title: ' || COALESCE(p.title, '') || chr(10) || chr(10) || 'Abstract: ' || COALESCE(p.abstract, '')
        || chr(10) || chr(10) || 'Question: ' || q.question_id AS prompt
      FROM papers p CROSS JOIN q)
SELECT paper_id, question_id,
  (['YES', 'NO', 'UNSURE'])[CAST(CAST(('0x' || substr(md5(CAST(paper_id AS VARCHAR) || ':' || question_id), 1, 8)) AS BIGINT) % 3 AS INTEGER) + 1] AS response,
  CAST(length(prompt) // 4 AS BIGINT) AS input_tokens, CAST(1 AS BIGINT) AS output_tokens, 'rule' AS model
FROM r"""

ORACLE = {
    "decisions_parsed": SQL_DECISIONS,
    "decision_distribution": SQL_DISTRIBUTION,
    "decision_eval": SQL_EVAL,
    "decision_failures": SQL_FAILURES,
    "llm_costs": SQL_LLM_COSTS,
    "run_spread": SQL_RUN_SPREAD,
    "zero_shot_prompts": SQL_PROMPTS,
    "rule_answers": SQL_RULE_ANSWERS,
}
