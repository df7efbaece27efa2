"""siftwork: screening analytics as Spark DataFrame operators.

Every public operator takes DataFrames and returns a DataFrame. Ranking
metrics, thresholds, cleaning, splits, answer-table analytics, costs and
vector retrieval are expressed with built-in Spark joins, windows and
aggregates; Python only runs inside tasks where no expression exists.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions of this package that run inside tasks (completers, per-tile kernels,
# pandas UDFs) are pickled by value, so executors need no copy of the package on
# their import path.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

from siftwork.session import build_session, ensure_checkpoint_dir  # noqa: E402

__all__ = ["build_session", "ensure_checkpoint_dir"]
