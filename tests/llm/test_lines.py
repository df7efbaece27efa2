"""Line dedup against sets of sites."""

from collections import defaultdict

import pytest

from siftwork.llm.lines import drop_boilerplate
from tests.llm.conftest import BASE, WS, documents


def brute(rows, min_sites):
    sites = defaultdict(set)
    for _, text, _, source in rows:
        for line in (text or "").split("\n"):
            if line.strip(WS):
                sites[line.strip(WS)].add(source)
    out = []
    for doc_id, text, _, _ in rows:
        lines = (text or "").split("\n")
        left = [x for x in lines if not x.strip(WS) or len(sites[x.strip(WS)]) < min_sites]
        out.append((doc_id, None if text is None else "\n".join(left), len(lines), len(lines) - len(left)))
    return sorted(out, key=str)


def compare(docs, rows, min_sites, **options):
    got = drop_boilerplate(docs, min_sites=min_sites, **options)
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()), key=str) == brute(rows, min_sites)
    return got


@pytest.mark.parametrize("min_sites", [1, 2, 3])
def test_edge_cases(edge, min_sites):
    got = compare(edge, BASE, min_sites)
    assert set(got.columns) == set(edge.columns) | {"n_removed"}


@pytest.mark.parametrize("lg_k", [4, 10])
def test_lines_around_the_limit_are_decided_exactly(spark, lg_k):
    """Lines on 1 to 80 sites and a limit of 40: a small sketch alone would misjudge many."""
    rows = []
    for site in range(80):
        lines = [f"line for {n} sites" for n in range(1, 81) if site < n]
        rows += [(site * 2, "\n".join(lines), "en", f"s{site}"), (site * 2 + 1, "own line %d\n  line for 80 sites \t" % site, "en", f"s{site}")]
    compare(documents(spark, rows).repartition(6), rows, 40, lg_k=lg_k)


def test_null_site_is_a_site_and_white_space_lines_stay(spark):
    rows = [(1, "x\n \ny", "en", None), (2, "x\n \nz", "en", ""), (3, "x", "en", "a")]
    compare(documents(spark, rows), rows, 3)


def test_empty_table_and_plan(empty, edge, capsys):
    assert drop_boilerplate(empty).collect() == []
    drop_boilerplate(edge).explain()
    assert not any(x in capsys.readouterr().out for x in ("Python", "Pandas", "Arrow"))


def test_time_grows_with_the_lines_of_a_document(spark):
    """Ten documents of boilerplate lines only: four times the lines may not take sixteen times as long."""
    from time import perf_counter
    took = {}
    for n in (200, 8_000, 32_000):
        docs = documents(spark, [(k, "\n".join(f"line {i}" for i in range(n)) + f"\nown {k}", "en", f"s{k}") for k in range(10)])
        start = perf_counter()
        got = drop_boilerplate(docs, min_sites=5).collect()
        took[n] = perf_counter() - start
        assert sorted((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got) == [(k, f"own {k}", n + 1, n) for k in range(10)]
    assert took[32_000] < 8 * max(took[8_000], 1.0)
