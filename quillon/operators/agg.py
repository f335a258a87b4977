"""Whole-column aggregates as Columns for DataFrame.agg, and eager forms that return a scalar.

In ``"zero"`` mode a null counts as 0 (false) in min, max, any and all, and an empty or all-null
sum is 0. The eager forms apply it to long and double columns only: all other types skip nulls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def total(c: Column, null_mode: str = "sql") -> Column:
    return F.coalesce(F.sum(c), F.lit(0)) if null_mode == "zero" else F.sum(c)


def minimum(c: Column, null_mode: str = "sql") -> Column:
    return F.min(F.coalesce(c, F.lit(0))) if null_mode == "zero" else F.min(c)


def maximum(c: Column, null_mode: str = "sql") -> Column:
    return F.max(F.coalesce(c, F.lit(0))) if null_mode == "zero" else F.max(c)


def any_true(c: Column) -> Column:
    """Null counts as false; false over no rows."""
    return F.coalesce(F.bool_or(F.coalesce(c, F.lit(False))), F.lit(False))


def all_true(c: Column) -> Column:
    """Null counts as false; true over no rows."""
    return F.coalesce(F.bool_and(F.coalesce(c, F.lit(False))), F.lit(True))


def null_count(c: Column) -> Column:
    return F.count(F.lit(1)) - F.count(c)


def is_null(c: Column) -> Column:
    return c.isNull().cast("int")


_SCALARS = {"sum": total, "min": minimum, "max": maximum}


def scalar(df: DataFrame, column: str, how: str, null_mode: str = "zero"):
    """sum, min, max, any, all or null_count of a column, now. ValueError for min or max of no rows."""
    c, dtype = df[column], df.schema[column].dataType
    if how in ("any", "all", "null_count"):
        return df.agg({"any": any_true, "all": all_true, "null_count": null_count}[how](c)).first()[0]
    mode = null_mode if isinstance(dtype, (T.LongType, T.DoubleType)) else "sql"
    out = df.agg(_SCALARS[how](c, mode)).first()[0]
    if out is None and how != "sum":
        raise ValueError(f"{how} of an empty column")
    return out
