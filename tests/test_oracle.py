"""Registered queries vs their DuckDB twins on the smallest scale factor (the full set
runs with ``python tests/oracle_compare.py /root/testdata/sf0.01``)."""

import pytest

from tests.conftest import SF001
from tests.oracle_compare import compare

SUBSET = [
    "fixed_recall_folds", "default_threshold_folds", "pr_curve", "roc_auc_ap", "wss_at_recall",
    "recall_threshold_scan", "threshold_grid", "best_grid_threshold", "recall_tradeoff",
    "papers_clean", "pages_text", "text_fingerprint", "stratified_folds", "balanced_sample",
    "answers_wide", "label_correlation", "resolve_majority", "cost_savings_sweep",
    "decision_eval", "llm_costs", "vector_top3", "few_shot_examples", "metric_leaderboard",
    "difference_describe", "result_store_roundtrip",
]


@pytest.mark.parametrize("name", SUBSET)
def test_query_matches_duckdb(spark, name):
    res = compare(spark, SF001, [name], verbose=False)
    assert res[name][0] == "MATCH", res[name]
