"""Missing-value predicate of the preparation filter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kiln.functions.text import strip


def is_blank(c) -> Column:
    """Null, or empty after Unicode strip."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(strip(c), F.lit("")) == ""


def is_missing(c, dtype: T.DataType) -> Column:
    """Missing by type: null; NaN for floating point; blank strings; empty
    arrays. Zero is not missing."""
    c = F.col(c) if isinstance(c, str) else c
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    if isinstance(dtype, T.StringType):
        return is_blank(c)
    if isinstance(dtype, (T.ArrayType, T.MapType)):
        return c.isNull() | (F.size(c) == 0)
    return c.isNull()
