"""Output conventions shared by registered queries: doubles rounded to 6 decimals
(half away from zero on x * 10^d, as the SQL engines round doubles), counts as BIGINT."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwork.functions.expr import round_out

DIGITS = 6


def finish(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = round_out(c, digits)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, (T.DoubleType, T.FloatType)):
            c = F.transform(c, lambda x: round_out(x, digits))
        out.append(c.alias(f.name))
    return df.select(*out)
