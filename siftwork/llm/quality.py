"""Operator 7, quality rules: repetition coverage.

Every text is cut into words ``[^\\x20\\x09-\\x0D]+``. Each word gets a 64-bit hash,
and the hashes of all n-word windows follow from those of the (n-1)-word windows by
one multiply-add over the whole array (a rolling hash, in numpy). Windows whose hash
occurs more than once mark their words; the marked words' characters over all word
characters give the coverage of that n. Duplicated lines are measured the same way.

A document is rejected by the base rule (too few words, or too many words inside
repeated 8-word windows) or when one coverage exceeds its limit.

Work is per row: no shuffle, memory a few arrays of the longest text's word count.

Defined results: null and empty texts have no words and fail the base rule; repeated
rows are judged one by one; a null id stays null; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siftwork.llm.common import WHITESPACE

_SYMBOLS = "#*$%&|<>"
_BASE_N = 8
_ODD = np.uint64(0x9E3779B97F4A7C15)

MEASURES = ("n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
            "base_failed boolean, line_coverage double, ngram_coverage array<double>, kept boolean")


@dataclass(frozen=True)
class QualityRules:
    """Limits of the rules; ``ngram_limits`` maps window length to the largest coverage allowed."""

    min_words: int = 20
    max_repeat_percent: int = 30
    line_limit: float = 0.35
    ngram_limits: dict[int, float] = field(default_factory=lambda: {5: 0.40, 10: 0.30, 20: 0.25})


def _repeated(hashes: np.ndarray) -> np.ndarray | None:
    """Which windows occur more than once; None when all are different."""
    s = np.sort(hashes)
    twice = s[1:][s[1:] == s[:-1]]
    return np.isin(hashes, twice) if len(twice) else None


def _covered(repeated: np.ndarray, n: int, n_words: int) -> np.ndarray:
    """Words inside at least one repeated window of n words."""
    edge = np.zeros(n_words + 1, np.int64)
    starts = np.flatnonzero(repeated)
    edge[starts] += 1
    np.subtract.at(edge, starts + n, 1)
    return np.cumsum(edge[:-1]) > 0


def measure(text: str | None, rules: QualityRules) -> tuple:
    """All measures and the verdict of one text, in the order of ``MEASURES``."""
    text = text or ""
    raw = text.encode("utf-8")
    words = raw.split()  # bytes.split() cuts at exactly [\x20\x09-\x0D]
    n_words = len(words)
    word_chars = len(text) - sum(text.count(c) for c in WHITESPACE)
    n_symbols = sum(text.count(c) for c in _SYMBOLS)

    seen: set[str] = set()
    n_dup_lines = dup_line_chars = 0
    for line in text.split("\n"):
        if line in seen:
            n_dup_lines += 1
            dup_line_chars += len(line) - sum(line.count(c) for c in WHITESPACE)
        elif line.strip(WHITESPACE):
            seen.add(line)
    line_coverage = dup_line_chars / word_chars if word_chars else 0.0

    n_repeat_words, lengths = 0, None
    coverage = {n: 0.0 for n in rules.ngram_limits}
    if n_words:
        word = np.fromiter(map(hash, words), np.int64, n_words).view(np.uint64)
        rolling = word.copy()
        for n in range(1, min(n_words, max([_BASE_N, *coverage])) + 1):
            if n > 1:
                rolling = rolling[:-1] * _ODD + word[n - 1:]
            if n != _BASE_N and n not in coverage:
                continue
            repeated = _repeated(rolling)
            if repeated is None:
                break  # longer windows are all different too
            covered = _covered(repeated, n, n_words)
            if n == _BASE_N:
                n_repeat_words = int(covered.sum())
            if n in coverage:
                if lengths is None:
                    lengths = np.fromiter((len(w.decode("utf-8")) for w in words), np.int64, n_words)
                coverage[n] = float(lengths[covered].sum() / word_chars)
    base_failed = n_words < rules.min_words or 100 * n_repeat_words > rules.max_repeat_percent * n_words
    kept = (not base_failed and line_coverage <= rules.line_limit
            and all(coverage[n] <= limit for n, limit in rules.ngram_limits.items()))
    return (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, line_coverage,
            [coverage[n] for n in sorted(coverage)], kept)


def quality_measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     rules: QualityRules = QualityRules()) -> DataFrame:
    """One row per input row: the id as ``doc_id`` and the measures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(t.as_py(), rules) for t in batch.column(1)]
            columns = list(zip(*rows, strict=True)) or [[]] * len(types)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))],
                names=names)

    names = ["doc_id", *(part.split()[0] for part in MEASURES.split(", "))]
    types = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.list_(pa.float64()), pa.bool_()]
    keyed = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind = keyed.schema["doc_id"].dataType.simpleString()
    return keyed.mapInArrow(run, f"doc_id {kind}, {MEASURES}")


def keep_good(docs: DataFrame, text_col: str = "text", rules: QualityRules = QualityRules()) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns (a filter: no shuffle)."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([measure(t.as_py(), rules)[-1] for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
