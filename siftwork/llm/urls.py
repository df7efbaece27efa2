"""Operator 8, URL filters: character language-model ratio.

URLs that a rule decides are labelled rows: two variable-order Markov models over the
characters of host and path are fitted, one on accepted and one on rejected URLs, with
Witten-Bell smoothing (each context mixes its counts with the next shorter context's
estimate in proportion to the number of different characters seen after it, down to a uniform
alphabet). A URL's score is the difference of its log-likelihoods divided by its
length; URLs without a rule are blocked when the score falls below a threshold
calibrated on held-out labelled URLs.

The models are fitted on every different labelled URL but the held-out fifth, and the threshold on all held-out accepted ones.
Spark counts the n-grams; the probabilities are joined level by level to the different n-grams of the URLs, and a URL's score is
the sum over its own, in order. So counts, probabilities and scores stay distributed, and each different URL is scored once.

Defined results: a null URL, or one without ``://``, has empty host and path, no rule and a
score of 0; without labelled rows of both classes every URL scores 0; the threshold is
never above 0, so such URLs are allowed; repeated rows are judged one by one; null ids
stay null; other columns are ignored.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwork.llm.common import work_dir, written

# The contract's rules as (verdict, host, path).
RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_START = "\x02"
_ALPHABET = 256
_SEEN_KEPT = 500_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, null without one."""
    rule = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


class UrlModel:
    """Two smoothed character models in one process, for single URLs; ``score`` is positive for URLs like the accepted ones."""

    def __init__(self, counts: dict[str, dict[str, int]], order: int):
        """counts: class ("allow", "block") -> n-gram of 1 to order + 1 characters -> count."""
        self.order, self.counts, self.seen = order, counts, {}
        self.after: dict[str, dict[str, tuple[int, int]]] = {}
        for kind, grams in counts.items():
            table: dict[str, tuple[int, int]] = {}
            for gram, n in grams.items():
                total, different = table.get(gram[:-1], (0, 0))
                table[gram[:-1]] = total + n, different + 1
            self.after[kind] = table

    def probability(self, kind: str, context: str, char: str) -> float:
        grams, after, p = self.counts[kind], self.after[kind], 1.0 / _ALPHABET
        for k in range(len(context) + 1):
            ctx = context[len(context) - k:]
            total, different = after.get(ctx, (0, 0))
            if not total:
                break
            p = (grams.get(ctx + char, 0) + different * p) / (total + different)
        return p

    def score(self, text: str) -> float:
        if not text or not all(self.counts.get(k) for k in ("allow", "block")):
            return 0.0
        padded, total = _START * self.order + text, 0.0
        for i in range(len(text)):
            gram = padded[i:i + self.order + 1]
            part = self.seen.get(gram)
            if part is None:
                part = log(self.probability("allow", gram[:-1], gram[-1])) - log(self.probability("block", gram[:-1], gram[-1]))
                if len(self.seen) >= _SEEN_KEPT:
                    self.seen.clear()
                self.seen[gram] = part
            total += part
        return total / len(text)


def labelled_texts(ruled: DataFrame, train_urls: int | None, seed: str) -> DataFrame:
    """The different (text, verdict), null without a rule, every fifth held out; a model is fitted on the others that are
    ``labelled``: all, or with ``train_urls`` at most so many of each class (the least by a seeded hash), held-out ones included."""
    texts = ruled.groupBy(F.concat("host", "path").alias("text")).agg(F.max("verdict").alias("verdict"))
    texts = texts.withColumn("held_out", F.pmod(F.xxhash64(F.lit("fold"), "text"), F.lit(5)) == 0).withColumn("labelled", F.col("verdict").isNotNull())
    if train_urls is None:
        return texts
    draw = F.xxhash64(F.lit(seed), "text")
    drawn = [texts.filter(F.col("verdict") == kind).orderBy(draw, "text").limit(train_urls).select(F.col("text").alias("drawn")) for kind in ("allow", "block")]
    return texts.join(drawn[0].unionAll(drawn[1]), F.col("text") == F.col("drawn"), "left").withColumn("labelled", F.col("drawn").isNotNull()).drop("drawn")


def _windows(texts: DataFrame, order: int) -> DataFrame:
    """+ (pos, g): each character with the ``order`` before it."""
    padded = F.concat(F.lit(_START * order), F.col("text"))
    ends = F.sequence(F.lit(0), F.length("text") - 1)
    return texts.filter("text <> ''").select("*", F.posexplode(F.transform(ends, lambda e: F.substring(padded, e + 1, F.lit(order + 1)))).alias("pos", "g"))


def gram_ratios(texts: DataFrame, order: int, work: str) -> DataFrame | None:
    """(g, part): for every different window of the texts, the logarithm of its last character's probability after the others by
    the accepted URLs' model, less that by the rejected ones'; None when a class has no URL to fit on."""
    kinds = ("allow", "block")
    fitted = F.col("labelled") & ~F.col("held_out")
    counts = [F.count_if(fitted & (F.col("verdict") == kind)).alias(kind) for kind in kinds]
    longest = written(_windows(texts, order).groupBy("g").agg(*counts), f"{work}/grams")
    if not all(longest.agg(*(F.sum(kind) for kind in kinds)).first()):
        return None
    below = None
    for k in range(order + 1):  # n-grams of k + 1 characters: after contexts of k characters
        grams = longest if k == order else longest.groupBy(F.substring("g", order + 1 - k, k + 1).alias("g")).agg(*(F.sum(kind).alias(kind) for kind in kinds))
        context = F.substring("g", 1, k)
        after = grams.groupBy(context.alias("context")).agg(*(x for kind in kinds for x in (F.sum(kind).alias(f"{kind}_total"), F.count_if(F.col(kind) > 0).alias(f"{kind}_different"))))
        level = grams.withColumn("context", context).join(after, "context")
        if below is None:
            level = level.withColumns({f"p_{kind}": F.lit(1.0 / _ALPHABET) for kind in kinds})
        else:
            level = level.withColumn("shorter", F.substring("g", 2, k)).join(below, "shorter")
        mixed = {kind: (F.col(kind) + F.col(f"{kind}_different") * F.col(f"p_{kind}")) / (F.col(f"{kind}_total") + F.col(f"{kind}_different")) for kind in kinds}
        level = level.select("g", *(F.when(F.col(f"{kind}_total") > 0, mixed[kind]).otherwise(F.col(f"p_{kind}")).alias(f"p_{kind}") for kind in kinds))
        below = written(level.withColumnRenamed("g", "shorter"), f"{work}/level-{k}")
    return written(below.select(F.col("shorter").alias("g"), (F.log("p_allow") - F.log("p_block")).alias("part")), f"{work}/ratios")


def scored_texts(texts: DataFrame, ratios: DataFrame | None, order: int) -> DataFrame:
    """+ score: the mean of a text's window ratios, added in order; 0 without models or characters."""
    if ratios is None:
        return texts.withColumn("score", F.lit(0.0))
    # added in the text's order, so that the sum is the same however the rows are dealt
    parts = _windows(texts.select("text"), order).join(ratios, "g").groupBy("text").agg(F.array_sort(F.collect_list(F.struct("pos", "part"))).alias("parts"))
    score = F.aggregate("parts", F.lit(0.0), lambda total, x: total + x["part"]) / F.size("parts")
    return texts.join(parts.select("text", score.alias("score")), "text", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def calibrated(scores: DataFrame, false_reject: float) -> float:
    """The score below which at most ``false_reject`` of the held-out accepted URLs fall, but not above 0. Its rank among them
    all is exact: a sketch bounds it on both sides, and only the scores between are ranked."""
    accepted = scores.filter("held_out and labelled and verdict = 'allow'").select("score")
    n = accepted.count()
    if not n:
        return 0.0
    at, found = int(false_reject * n), None
    near = [min(1.0, max(0.0, at / n + step)) for step in (-2e-4, 2e-4)]  # the sketch errs by at most 1e-4
    for low, high in (accepted.agg(F.percentile_approx("score", near, 10_000)).first()[0], accepted.agg(F.min("score"), F.max("score")).first()):
        rank = at - accepted.filter(F.col("score") < low).count()
        ranked = accepted.filter(F.col("score").between(low, high)).groupBy("score").agg(F.count("*").alias("n"))
        upto = F.sum("n").over(Window.orderBy("score"))
        found = ranked.withColumn("upto", upto).filter(F.col("upto") > rank).agg(F.min("score")).first()[0]
        if rank >= 0 and found is not None:
            break
    return min(0.0, found)


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, train_urls: int | None = None, order: int = 4,
               false_reject: float = 0.01, seed: str = "urls") -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for every row."""
    host, path = host_and_path(pages[url_col])
    parsed = pages.select(pages[id_col].alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    ruled = parsed.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))
    work = work_dir(pages.sparkSession, "urls")
    texts = written(labelled_texts(ruled, train_urls, seed), f"{work}/texts")
    scores = written(scored_texts(texts, gram_ratios(texts, order, work), order), f"{work}/scores")
    threshold = calibrated(scores, false_reject)
    judged = ruled.withColumn("text", F.concat("host", "path")).join(scores.select("text", "score"), "text")
    decided = F.coalesce("verdict", F.when(F.col("score") < threshold, F.lit("block")).otherwise(F.lit("allow")))
    return judged.select("page_id", "host", "path", "rule", decided.alias("verdict"), "score")
