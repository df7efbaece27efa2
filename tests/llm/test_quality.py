"""Quality rules against plain counting, and each rule's edge."""

import re
from collections import Counter

import pytest

from siftwork.llm.quality import QualityRules, keep_good, measure, quality_measures
from tests.llm.conftest import BASE, documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text, rules=QualityRules()):
    text = text or ""
    words = WORD.findall(text)
    chars = sum(map(len, words))

    def covered(n):
        grams = [tuple(words[k:k + n]) for k in range(len(words) - n + 1)]
        times = Counter(grams)
        return sorted({j for k, g in enumerate(grams) if times[g] > 1 for j in range(k, k + n)})

    lines = [x for x in text.split("\n") if WORD.search(x)]
    again = [x for k, x in enumerate(lines) if x in lines[:k]]
    repeat = len(covered(8))
    base = len(words) < 20 or 100 * repeat > 30 * len(words)
    line_share = sum(len("".join(WORD.findall(x))) for x in again) / chars if chars else 0.0
    shares = [sum(len(words[j]) for j in covered(n)) / chars if chars else 0.0 for n in sorted(rules.ngram_limits)]
    kept = not base and line_share <= rules.line_limit and all(s <= rules.ngram_limits[n] for n, s in zip(sorted(rules.ngram_limits), shares, strict=True))
    return (len(words), chars, len(re.findall(r"[#*$%&|<>]", text)), len(again), repeat, base, kept), line_share, shares


def check(got, text):
    plain, line_share, shares = brute(text)
    assert (*got[:6], got[8]) == plain
    assert got[6] == pytest.approx(line_share) and list(got[7]) == pytest.approx(shares)


PROSE = " ".join(f"w{k}" for k in range(40))


@pytest.mark.parametrize("text", [
    None, "", " \n ", "a", PROSE, "same " * 50, (PROSE + " ") * 2, PROSE + "\n" + PROSE, "# * $ % & | < > ab#c " * 3, "x\n\nx\n x\nx\x0by\n",
    " ".join(f"w{k % 9}" for k in range(60)), PROSE + " w1 w2 w3 w4 w5 w6 w7 w8", "é ü \x1c\x85 漢字 " * 30, "\n".join(["the very same line of words"] * 9),
    " ".join(w for k in range(20) for w in [f"v{k}"] * 7),
])
def test_measures_match_plain_counting(text):
    check(measure(text, QualityRules()), text)


def test_table_with_every_edge_case(edge):
    got = sorted((tuple(r) for r in quality_measures(edge).collect()), key=str)
    want = sorted(((r[0], *measure(r[1], QualityRules())) for r in BASE), key=str)
    assert [g[:7] for g in got] == [w[:7] for w in want]
    for r in BASE:
        check(measure(r[1], QualityRules()), r[1])


def test_filter_keeps_rows_whole(edge, empty):
    kept = keep_good(edge)
    assert kept.columns == edge.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r[0] for r in BASE if brute(r[1])[0][-1])
    assert keep_good(empty).collect() == [] and quality_measures(empty).collect() == []


def test_clean_prose_stays_and_repetition_goes(spark):
    docs = documents(spark, [(1, PROSE, "en", "a"), (2, "again and again " * 40, "en", "a"), (3, " ".join(w for k in range(20) for w in [f"v{k}"] * 7), "en", "a")])
    assert [r.doc_id for r in keep_good(docs).collect()] == [1]
