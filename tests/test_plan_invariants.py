"""Scale invariants read off the explained plans of registered queries."""

import contextlib
import io

import pytest

from tests.conftest import SF001

# Queries whose DataFrame is built lazily (no fits, streams or stores run while building).
LAZY = [
    "fixed_recall_folds", "fixed_recall_summary", "default_threshold_folds", "pr_curve", "roc_auc_ap",
    "wss_at_recall", "recall_threshold_scan", "threshold_grid", "best_grid_threshold", "confusion_at_half",
    "recall_tradeoff", "false_negatives", "papers_clean", "paper_text", "pages_text", "class_balance",
    "text_fingerprint", "dedup_stats", "stratified_folds", "fold_balance", "holdout_split", "class_weights",
    "balanced_sample", "random_per_label", "answers_cost", "unsure_rates", "label_correlation",
    "feature_filter", "answers_wide", "conflict_rows", "resolve_majority", "cost_summary",
    "cost_savings_sweep", "decisions_parsed", "decision_eval", "llm_costs", "run_spread",
    "zero_shot_prompts", "rule_answers", "normalized_vectors", "metric_leaderboard", "difference_describe",
]


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


@pytest.fixture(scope="module")
def plans(spark):
    import __spark_entry__ as E
    q = E.queries()
    return {name: _plan(q[name](spark, SF001)) for name in LAZY}


def test_no_cartesian_operators(plans):
    bad = [n for n, p in plans.items() if "CartesianProduct" in p or "BroadcastNestedLoopJoin" in p]
    assert bad == []


@pytest.mark.parametrize("name", ["fixed_recall_folds", "pr_curve", "stratified_folds", "holdout_split"])
def test_running_totals_use_row_pure_blocks(plans, name):
    """Blocks come from the row, not from a sampled range exchange."""
    assert "_sw_blk0" in plans[name] and "rangepartitioning" not in plans[name]


@pytest.mark.parametrize("name", ["random_per_label", "metric_leaderboard"])
def test_top_k_uses_group_limit(plans, name):
    assert "WindowGroupLimit" in plans[name]


def test_scans_are_pruned(plans):
    p = plans["fixed_recall_folds"]
    scans = [line for line in p.splitlines() if line.strip().startswith("ReadSchema")]
    assert scans and all("user_id" not in s and "ts" not in s for s in scans)
