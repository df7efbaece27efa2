"""Exact dedup against a dictionary of normalised texts."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from siftwork.llm.exact import drop_copies, exact_groups, without_white_space
from tests.llm.conftest import BASE, WS, documents


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups["".join(c for c in text or "" if c not in WS)].append((doc_id, text or ""))
    out = []
    for members in groups.values():
        best = max(members, key=lambda m: (len(m[1]), m[0] is not None, -(m[0] or 0)))
        out += [(m[0], best[0], len(members)) for m in members]
    return sorted(out, key=str), len(groups)


@pytest.mark.parametrize("first_digit", [1, 7, 64])
def test_groups_match_brute_force(edge, first_digit):
    got = exact_groups(edge, first_digit=first_digit, growth=16).collect()
    want, n_groups = brute(BASE)
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got), key=str) == want
    assert sum(r.kept for r in got) == n_groups


def test_exactly_one_of_repeated_rows_stays(spark):
    docs = documents(spark, [(1, "same", "en", "a")] * 5 + [(1, "other", "en", "a"), (2, "o t h e r", "en", "a")])
    got = exact_groups(docs).collect()
    assert sorted((r.keep_id, r.group_size, r.kept) for r in got) == [(1, 5, False)] * 4 + [(1, 5, True)] + [(2, 2, False), (2, 2, True)]


def test_same_prefix_under_one_id_is_not_merged(spark):
    """Groups are named by members: an id that occurs in two groups must not join them."""
    p, q = "p" * 64, "q" * 64
    docs = documents(spark, [(5, p + "AAAA" * 40, "", ""), (7, p + "AAAA" * 40, "", ""), (5, p + "BBBB" * 40, "", ""), (9, p + "BBBB" * 40, "", ""),
                             (5, q + "AAAA" * 40, "", ""), (3, q + "AAAA" * 40, "", "")])
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in exact_groups(docs).collect()) == [
        (3, 3, 2), (5, 3, 2), (5, 5, 2), (5, 5, 2), (7, 5, 2), (9, 5, 2)]


def test_texts_that_end_at_a_digit_edge(spark):
    docs = documents(spark, [(k, "x" * n, "", "") for k, n in enumerate([0, 63, 64, 64, 65, 128, 1088, 1088, 1089])])
    assert sorted((r.doc_id, r.group_size) for r in exact_groups(docs).collect()) == [
        (0, 1), (1, 1), (2, 2), (3, 2), (4, 1), (5, 1), (6, 2), (7, 2), (8, 1)]


def test_kept_rows_keep_all_columns(edge):
    kept = drop_copies(edge)
    assert kept.dtypes == edge.dtypes
    assert kept.count() == brute(BASE)[1]
    assert kept.filter("doc_id = 7 or doc_id = 8").count() == 1


def test_empty_table_and_carried_columns(empty, edge):
    assert exact_groups(empty).collect() == [] and drop_copies(empty).columns == empty.columns
    out = exact_groups(edge, carry={"sha": F.sha2(without_white_space(edge["text"]), 256)})
    assert out.columns == ["doc_id", "keep_id", "group_size", "kept", "sha"]


def test_a_hot_group_stays_whole(spark):
    docs = spark.range(6000).selectExpr("id doc_id", "if(id % 3 = 0, repeat('copy ', 100), concat('text number ', id)) text")
    got = {(r.group_size, r.kept): r["count"] for r in exact_groups(docs).groupBy("group_size", "kept").count().collect()}
    assert got == {(2000, True): 1, (2000, False): 1999, (1, True): 4000}


def test_ids_of_any_type(spark):
    least = -(1 << 63)
    docs = spark.createDataFrame([(least, "a b"), (5, "ab"), (7, "c"), (least, "c"), (3, "c")], "doc_id bigint, text string")
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_groups(docs).collect()}
    assert got == {(least, least, 2, True), (5, least, 2, False), (7, least, 3, False), (least, least, 3, True), (3, least, 3, False)}
    named = spark.createDataFrame([("x9", "ab"), ("x10", "a b"), (None, "a  b"), ("y", None), ("", "")], "doc_id string, text string")
    got = {(r.doc_id, r.keep_id, r.kept) for r in exact_groups(named).collect()}
    assert got == {("x9", None, False), ("x10", None, False), (None, None, True), ("y", "", False), ("", "", True)}
