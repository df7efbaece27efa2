"""Vector expressions on ARRAY<FLOAT|DOUBLE> columns, computed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwork.functions.expr import bound, col_


def _d(v) -> Column:
    return F.transform(col_(v), lambda x: x.cast("double"))


def l2_norm(v) -> Column:
    return F.sqrt(F.aggregate(_d(v), F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalize(v) -> Column:
    """Unit length; a zero vector is returned unchanged."""
    def by_norm(d):
        return bound(l2_norm(d), lambda n: F.transform(d, lambda x: x / F.when(n == 0, F.lit(1.0)).otherwise(n)))
    return bound(_d(v), by_norm)


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_d(a), _d(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def scale(v, factor) -> Column:
    f = col_(factor).cast("double") if not isinstance(factor, (int, float)) else F.lit(float(factor))
    return F.transform(_d(v), lambda x: x * f)
