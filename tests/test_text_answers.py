"""Cleaning, parsing, answer-table and cost operators: hand cases and properties."""

import hashlib

import pytest
from pyspark.sql import functions as F

from siftwork.functions import text as T
from siftwork.operators import answers as A
from siftwork.operators import clean as C
from siftwork.operators import cost as CO
from siftwork.sources.dimensions import prices_df


def test_decision_parser(spark):
    rows = [("UNKNOWN",), ("NO, not YES",), ("UNCERTAIN.",), (" yes ",), ("no",), ("maybe",)]
    df = spark.createDataFrame(rows, "r string")
    got = [r.d for r in df.select(T.parse_decision("r").alias("d")).collect()]
    assert got == ["NO", "YES", "UNCERTAIN", "YES", "NO", "UNCERTAIN"]


def test_html_to_text(spark):
    html = ('<html><head><style>p{x:1}</style><script>var t="</p>";</script></head>'
            '<body><!-- c --><p>A &amp; B</p><p>x&nbsp;&middot;&#169;&amp;lt;</p>\n\n <b>end</b></body></html>')
    df = spark.createDataFrame([(html,)], "h string")
    got = df.select(T.html_to_text("h").alias("t")).collect()[0].t
    assert got == "A & Bx ·©< end"


def test_clean_papers_null_and_blank_titles(spark):
    rows = [(1, None, "a", True), (2, "   ", "b", False), (3, " T ", None, True), (4, "t", "x", True),
            (5, "T", "X", False)]
    df = spark.createDataFrame(rows, "id long, title string, abstract string, label boolean")
    out = {r.id: r for r in C.clean_papers(df).collect()}
    assert 1 not in out                      # null title dropped
    assert out[2].title == ""                # whitespace-only title survives, stripped to ""
    assert out[3].abstract == ""             # null abstract -> "" by default
    assert 4 in out and 5 not in out         # case/space-insensitive dedup keeps the first id
    lit = {r.id: r for r in C.clean_papers(df, null_abstract="literal").collect()}
    assert lit[3].abstract == "nan"


def test_strict_label_rejects_unknown(spark):
    df = spark.createDataFrame([(1, "t", "a", "maybe")], "id long, title string, abstract string, label string")
    with pytest.raises(Exception):
        C.clean_papers(df).collect()


def test_ordered_fingerprint_matches_hashlib(spark):
    texts = ["b", "a", "éé", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    h = hashlib.sha1()
    for t in texts:
        h.update(t.encode("utf-8"))
        h.update(b"\n")
    assert C.text_fingerprint_ordered(df).collect()[0].sha1 == h.hexdigest()


def test_constant_feature_correlation_is_null(spark):
    long = spark.createDataFrame([(1, "I1", "YES"), (2, "I1", "YES"), (1, "E1", "NO"), (2, "E1", "YES")],
                                 "paper_id long, question_id string, response string")
    labels = spark.createDataFrame([(1, True), (2, False)], "paper_id long, label boolean")
    got = {r.question_id: r for r in A.label_correlation(long, labels).collect()}
    assert got["I1"].corr is None and got["I1"].wrong_sign is False
    assert got["E1"].corr == pytest.approx(-1.0)


def test_conflict_tie(spark):
    df = spark.createDataFrame([(1, 1.0, 0.0, True), (2, 1.0, 0.0, False), (3, 0.0, 0.0, False)],
                               "paper_id long, I1 double, E1 double, label boolean")
    maj = {r.paper_id for r in A.resolve_conflicts(df, ["I1", "E1"], strategy="majority").collect()}
    rem = {r.paper_id for r in A.resolve_conflicts(df, ["I1", "E1"], strategy="remove").collect()}
    assert maj == {1, 3} and rem == {3}
    assert rem <= maj
    s = A.conflict_summary(df, ["I1", "E1"]).collect()[0]
    assert (s.n_conflicting_rows, s.n_conflicting_patterns) == (2, 1)


def test_pivot_duplicate_raises(spark):
    long = spark.createDataFrame([(1, "I1", "YES"), (1, "I1", "NO")],
                                 "paper_id long, question_id string, response string")
    with pytest.raises(Exception):
        A.pivot_answers(long, ["I1"]).collect()


def test_pivot_unpivot_roundtrip(spark):
    rows = [(p, q, r) for p in range(3) for q, r in (("I1", "YES"), ("E1", "UNSURE"))]
    long = spark.createDataFrame(rows, "paper_id long, question_id string, response string")
    back = A.unpivot_answers(A.pivot_answers(long, ["I1", "E1"]), ["I1", "E1"])
    assert sorted(back.collect()) == sorted(long.collect())


def test_encode_strict(spark):
    df = spark.createDataFrame([("YES",), ("NO",), ("UNSURE",)], "I1 string")
    assert [r.I1 for r in A.encode_features(df, ["I1"], unsure_as_one=False).collect()] == [1.0, 0.0, 0.5]
    bad = spark.createDataFrame([("PERHAPS",)], "I1 string")
    with pytest.raises(Exception):
        A.encode_features(bad, ["I1"]).collect()
    assert A.encode_features(bad, ["I1"], strict=False).collect()[0].I1 is None


def test_unknown_model_price_raises(spark):
    df = spark.createDataFrame([(1, "nope", 10, 1)], "paper_id long, model string, input_tokens long, output_tokens long")
    with pytest.raises(Exception):
        CO.add_cost(df, prices_df(spark)).collect()


def test_cost_rounding_is_numpy_like(spark):
    df = spark.createDataFrame([(1, "gpt-5-mini", 482, 2)], "paper_id long, model string, input_tokens long, output_tokens long")
    assert CO.add_cost(df, prices_df(spark)).collect()[0].cost_usd == 0.000124


def test_skip_answered(spark):
    todo = spark.createDataFrame([(1, "I1"), (1, "I2"), (2, "I1")], "paper_id long, question_id string")
    done = spark.createDataFrame([(1, "I1")], "paper_id long, question_id string")
    assert sorted(tuple(r) for r in A.skip_answered(todo, done).collect()) == [(1, "I2"), (2, "I1")]


def test_short_and_safe_names(spark):
    df = spark.createDataFrame([("google/medgemma 27b:it",)], "m string")
    r = df.select(T.short_model_name("m").alias("s"), T.safe_name("m").alias("f")).collect()[0]
    assert (r.s, r.f) == ("medgemma 27b:it", "google_medgemma_27b_it")
