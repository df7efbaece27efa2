"""Small column-expression helpers shared by the operators (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(num, den, default: float | None = 0.0) -> Column:
    """num / den with ``default`` on a zero or null denominator (never raises under ANSI)."""
    q = F.try_divide(col_(num).cast("double"), col_(den).cast("double"))
    return q if default is None else F.coalesce(q, F.lit(float(default)))


def f_beta(tp, fp, fn, beta: float = 1.0) -> Column:
    """F-beta from counts, 0 when undefined (zero_division=0)."""
    b2 = float(beta) * float(beta)
    num = F.lit(1.0 + b2) * col_(tp)
    den = F.lit(1.0 + b2) * col_(tp) + F.lit(b2) * col_(fn) + col_(fp)
    return safe_div(num, den)


def as_int(c) -> Column:
    """Boolean / 0-1 label to int (null stays null)."""
    return col_(c).cast("int")


def nan_to_null(c) -> Column:
    """NaN becomes NULL so ``avg`` ignores it (np.nanmean)."""
    return F.nanvl(col_(c).cast("double"), F.lit(None).cast("double"))


def round_np(c, digits: int) -> Column:
    """numpy / pandas ``round``: half-to-even on the binary product x * 10^d, then / 10^d
    (``F.round`` rounds the decimal representation HALF_UP instead: 0.0001245 -> 0.000125
    there, 0.000124 here). Used for every figure the study itself rounds."""
    p = float(10 ** digits)
    return F.rint(col_(c).cast("double") * F.lit(p)) / F.lit(p)


def round_out(c, digits: int = 6) -> Column:
    """Half away from zero on the binary product x * 10^d (the SQL engines' ROUND on
    doubles); used to normalise query outputs for comparison."""
    p = float(10 ** digits)
    v = col_(c).cast("double") * F.lit(p)
    r = F.rint(v)
    away = F.when(F.abs(v - r) == F.lit(0.5), v + F.lit(0.5) * F.signum(v)).otherwise(r)
    return away / F.lit(p)


def bound(value, body) -> Column:
    """``body(value)`` with the value computed once per row: an expression that a lambda names is
    otherwise computed again for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)
