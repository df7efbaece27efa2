"""Operator 3, mixing sources to target weights: iterative proportional fitting (native).

Token counts are summed per cell (source class x language class x topic class). Raking
scales the cells to each margin's target shares in turn until all margins hold at once;
a document of a cell is then kept with probability ``weight * rate``, at most 1, where weight =
raked tokens / actual tokens of its cell and ``rate`` is the stated share of the corpus to
sample. So the expected token shares of the sample are the targets and no document is repeated;
a cell that would need more than all of its documents (weight * rate over 1) is kept whole, and its
class falls short by that much. A rare class doesn't change how many documents of others stay.

A margin's targets are explicit shares, or ``Flattened``: the corpus's own shares raised to
a power below one, which lowers a hot source without fixing its share in advance.
Classes are the values listed in the targets, which are parameters, or the ``most`` most frequent
values of the column (ties by value) where ``Flattened`` lists none; everything else
(nulls too) is the class "(other)" (with the remaining share, or its own flattened one; where
the listed shares leave none, "(other)" keeps its share of the corpus and the listed shares are
of what it leaves, so that no document is lost for its class). The cell table is therefore
bounded by the product of the target lists, whatever the data: it is raked in one
partition (a sweep is three window sums), and joining it back needs no shuffle of the
documents. A hot source is summed on the map side.

Defined results: a document without tokens has weight and probability of its cell like any
other; a cell without tokens has weight 0; target shares of classes without tokens are
spread over the others in proportion; the draw is a hash of the id and the seed, so
rows that repeat an id share their fate, and a null id is drawn as the empty string;
margins that can't all hold (a cell they need is empty) leave the weights of the last sweep, or raise
an error with the gap when ``strict``; extra columns are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwork.llm.common import WORD_RE, work_dir, written

OTHER = "(other)"
LONG_WORDS = 2_000


@dataclass(frozen=True)
class Flattened:
    """Targets in proportion to the classes' own token shares to the power ``power``. Without ``values``
    the classes are the column's ``most`` most frequent ones."""

    values: tuple[str, ...] | None
    power: float = 0.7
    most: int = 64


Targets = dict[str, "dict[str, float] | Flattened"]

# Production targets of the registered query and the pipeline.
TARGETS: Targets = {
    "source": Flattened(None, 0.7),
    "lang": {"en": 0.58, "de": 0.15, "fr": 0.15, "es": 0.12},
    "topic": Flattened(("prose", "longform", "contact", "licence"), 0.97),
}
RATE = 0.65


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("bigint")


def topic(text: Column, n_words: Column) -> Column:
    """A lexical topic: licence notices, contact data, long forms, else prose."""
    t = F.coalesce(text, F.lit(""))
    return (F.when(t.contains("icensed under") | t.contains("eleased under"), "licence")
            .when(t.contains("@") | t.contains("+1 ("), "contact")
            .when(n_words >= LONG_WORDS, "longform").otherwise("prose"))


def _class(value: Column, listed: dict[str, float] | Flattened) -> Column:
    values = listed.values if isinstance(listed, Flattened) else listed
    return F.when(value.isin(list(values)), value).otherwise(F.lit(OTHER)) if values else F.lit(OTHER)


def listed(docs: DataFrame, targets: Targets, margins: dict[str, Column]) -> Targets:
    """The targets with the classes that are to come from the data: a bounded list for each."""
    out = dict(targets)
    for name, t in targets.items():
        if isinstance(t, Flattened) and t.values is None:
            counts = docs.select(margins[name].alias("value")).dropna().groupBy("value").agg(F.count("*").alias("n"))
            out[name] = replace(t, values=tuple(r["value"] for r in counts.orderBy(F.desc("n"), "value").limit(t.most).collect()))
    return out


def classified(docs: DataFrame, targets: Targets, margins: dict[str, Column], tokens: Column, carry: dict[str, Column]) -> DataFrame:
    """The carried columns (one struct), the token count and one class per margin."""
    return docs.select(F.struct(*(c.alias(n) for n, c in carry.items())).alias("carried"), tokens.alias("tokens"),
                       *(_class(margins[m], targets[m]).alias(f"by_{m}") for m in targets))


def rake(cells: DataFrame, targets: Targets, work: str, tolerance: float = 1e-9, sweeps_per_job: int = 4, max_sweeps: int = 400,
         strict: bool = False) -> DataFrame:
    """Cells (by_<margin>..., tokens) -> the same with ``raked``, their scaled token counts. ``strict``: an error when
    a margin still misses its goal by more than 1e-3 of all tokens."""
    for name, shares in targets.items():
        if not isinstance(shares, Flattened) and (min(shares.values()) < 0 or sum(shares.values()) > 1 + 1e-9):
            raise ValueError(f"target shares of {name} must be between 0 and 1 in total")
    everything = W.partitionBy()
    current = cells.coalesce(1).withColumn("raked", F.col("tokens").cast("double")).withColumn("total", F.sum("raked").over(everything))
    for name, shares in targets.items():
        w = W.partitionBy(f"by_{name}")
        first = F.row_number().over(w.orderBy(*(f"by_{m}" for m in targets))) == 1
        present = F.sum("raked").over(w) > 0
        current = current.withColumn("_new", first & present)
        if isinstance(shares, Flattened):
            share = F.pow(F.coalesce(F.try_divide(F.sum("raked").over(w), F.col("total")), F.lit(0.0)), shares.power)
        else:
            rest = max(0.0, 1 - sum(shares.values()))
            share = F.lit(rest)
            for value, s in shares.items():
                share = F.when(F.col(f"by_{name}") == value, F.lit(float(s))).otherwise(share)
            if rest < 1e-9 and OTHER not in shares:  # the listed shares are of what the other classes leave
                listed = F.sum(F.when(F.col("_new") & (F.col(f"by_{name}") != OTHER), share)).over(everything)
                own = F.try_divide(F.sum("raked").over(w), F.col("total"))
                share = F.when(F.col(f"by_{name}") != OTHER, share).otherwise(F.coalesce(F.try_divide(F.nullif(listed, F.lit(0.0)) * own, 1 - own), F.lit(1.0)))
        current = (current.withColumn("_share", share).withColumn("_once", F.when(F.col("_new"), F.col("_share")).otherwise(0.0))
                   .withColumn(f"to_{name}", F.try_divide(F.col("_share") * F.col("total"), F.sum("_once").over(everything)))
                   .drop("_share", "_once", "_new"))
    current = written(current, f"{work}/cells")
    for done in range(0, max_sweeps, sweeps_per_job):
        current = current.coalesce(1)
        for _ in range(sweeps_per_job):
            for name in targets:
                factor = F.try_divide(F.col(f"to_{name}"), F.sum("raked").over(W.partitionBy(f"by_{name}")))
                current = current.withColumn("raked", F.coalesce(F.col("raked") * factor, F.lit(0.0)))
        current = written(current, f"{work}/sweep-{done}")
        off = F.lit(0.0)
        checked = current.coalesce(1)
        for name in targets:
            gap = F.abs(F.sum("raked").over(W.partitionBy(f"by_{name}")) - F.col(f"to_{name}"))
            checked = checked.withColumn(f"gap_{name}", F.when(F.sum("tokens").over(W.partitionBy(f"by_{name}")) > 0, F.try_divide(gap, F.col("total"))))
            off = F.greatest(off, F.coalesce(F.col(f"gap_{name}"), F.lit(0.0)))
        gap = checked.agg(F.max(off)).first()[0] or 0.0
        if gap < tolerance:
            break
    if strict and gap > 1e-3:
        raise ValueError(f"the margins can't all hold: one misses its goal by {gap:.4f} of all tokens")
    return current


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", targets: Targets = TARGETS,
        margins: dict[str, Column] | None = None, tokens: Column | None = None, carry: dict[str, Column] | None = None, seed: str = "mix",
        rate: float = RATE, strict: bool = False) -> DataFrame:
    """The carried columns, tokens, by_<margin>, weight, probability and ``kept``, one row per input row."""
    if not 0 < rate <= 1:
        raise ValueError("rate must be above 0 and at most 1")
    n = words(docs[text_col]) if tokens is None else tokens
    margins = margins or {"source": docs["source"], "lang": docs["lang"], "topic": topic(docs[text_col], n)}
    targets = listed(docs, targets, margins)
    carry = carry or {"doc_id": docs[id_col]}
    by = [f"by_{m}" for m in targets]
    # 48 bits of a digest of the seed and the id, as a number in [0, 1)
    key = F.concat(F.lit(seed), F.coalesce(docs[id_col].cast("string"), F.lit("")))
    draw = F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("double") / float(1 << 48)
    rows = classified(docs, targets, margins, n, {"draw": draw, **{f"c{k}": c for k, c in enumerate(carry.values())}})
    cells = rows.groupBy(*by).agg(F.sum("tokens").alias("tokens"))
    raked = rake(cells, targets, work_dir(docs.sparkSession, "mixing"), strict=strict)
    weight = F.coalesce(F.try_divide("raked", F.col("tokens").cast("double")), F.lit(0.0))
    found = raked.select(*by, weight.alias("weight")).withColumn("probability", F.least(F.lit(1.0), F.col("weight") * rate))
    # the cell table is bounded by the product of the target lists
    joined = rows.join(F.broadcast(found), by, "left")
    return joined.select(*(F.col(f"carried.c{k}").alias(name) for k, name in enumerate(carry)), "tokens", *by, "weight", "probability",
                         (F.col("carried.draw") < F.col("probability")).alias("kept"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The sampled rows of ``docs`` with all their columns."""
    names = [f"in{k}" for k in range(len(docs.columns))]
    kept = mix(docs, carry={n: docs[c] for n, c in zip(names, docs.columns, strict=True)}, **options).filter("kept")
    return kept.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)))
