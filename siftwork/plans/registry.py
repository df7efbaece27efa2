"""All registered queries: name -> (spark, sf_dir) -> DataFrame, and DuckDB twins."""

from __future__ import annotations

import importlib

_MODULES = [
    "siftwork.plans.ranking_queries",
    "siftwork.plans.text_queries",
    "siftwork.plans.split_queries",
    "siftwork.plans.answer_queries",
    "siftwork.plans.llm_queries",
    "siftwork.plans.vector_queries",
    "siftwork.plans.report_queries",
    "siftwork.plans.io_queries",
    "siftwork.plans.ml_queries",
    "siftwork.plans.stream_queries",
]


def _load():
    queries, oracle = {}, {}
    for name in _MODULES:
        mod = importlib.import_module(name)
        queries.update(getattr(mod, "QUERIES", {}))
        oracle.update(getattr(mod, "ORACLE", {}))
    return queries, oracle


def all_queries():
    return _load()[0]


def all_oracle_sql():
    q, o = _load()
    return {k: v for k, v in o.items() if k in q}
