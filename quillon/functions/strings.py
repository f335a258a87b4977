"""ASCII upper case, byte lengths and offsets, struct to JSON text."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ascii_upper(c: Column) -> Column:
    """Only a-z change; every other byte stays."""
    return F.translate(c, string.ascii_lowercase, string.ascii_uppercase)


def byte_length(c: Column, null_mode: str = "sql") -> Column:
    n = F.octet_length(c)
    return F.coalesce(n, F.lit(0)) if null_mode == "zero" else n


def offsets(df: DataFrame, column: str, key: str, alias: str = "end_offset") -> DataFrame:
    """key and the running total of byte lengths in order of a unique key.

    Each key range is summed on its own and shifted by the total of those before it, so no task
    holds the table and rows are shuffled once.
    """
    from quillon.operators.frame import base_of, before_ranges, ranges

    cut = ranges(df.select(key, byte_length(df[column], "zero").cast("long").alias("__n")), key)
    before, _ = before_ranges(cut, F.sum("__n"))
    running = F.sum("__n").over(Window.partitionBy("__range").orderBy(F.col(key).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    return cut.select(key, (running + base_of(before)).alias(alias))


def offset_entries(df: DataFrame, column: str, key: str, alias: str = "offset") -> DataFrame:
    """The column of N + 1 offsets: 0, then each row's end offset."""
    ends = offsets(df, column, key, alias).select(alias)
    return df.sparkSession.range(1).select(F.lit(0).cast("long").alias(alias)).unionByName(ends)


def _python_text(c: Column, dtype: T.DataType, inner: bool = False) -> Column:
    """A value as Python shows it: True and None, strings bare, or in single quotes within lists, lists with a space after the comma."""
    if isinstance(dtype, T.BooleanType):
        out = F.when(c, "True").otherwise("False")
    elif isinstance(dtype, T.StringType):
        out = F.concat(F.lit("'"), c, F.lit("'")) if inner else c
    elif isinstance(dtype, T.ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: _python_text(x, dtype.elementType, True)), ", "), F.lit("]"))
    else:
        out = c.cast("string")
    return F.when(c.isNull(), F.lit("None") if inner else F.lit(None).cast("string")).otherwise(out)


def _field_text(c: Column, dtype: T.DataType) -> Column:
    text = _python_text(c, dtype)
    return F.coalesce(F.concat(F.lit('"'), text, F.lit('"')) if isinstance(dtype, T.StringType) else text, F.lit("null"))


def struct_json(fields: dict[str, Column], types: dict[str, T.DataType] | set[str]) -> Column:
    """``{"a": 1,"b": "x"}``: a space after the colon, none after the comma; text is not escaped.

    types has the fields' types (a set: the names of the strings, all others being numbers). Booleans
    are True and False, lists as Python shows them, null fields null.
    """
    kind = {n: T.StringType() if n in types else T.LongType() for n in fields} if isinstance(types, set) else types
    parts = []
    for n, (name, c) in enumerate(fields.items()):
        parts += [F.lit(("{" if n == 0 else ",") + f'"{name}": '), _field_text(c, kind[name])]
    return F.concat(*(parts or [F.lit("{")]), F.lit("}"))


def struct_column_json(df: DataFrame, column: str) -> Column:
    """struct_json of a struct column; a null struct is null."""
    c, dtype = df[column], df.schema[column].dataType
    text = struct_json({f.name: c[f.name] for f in dtype.fields}, {f.name: f.dataType for f in dtype.fields})
    return F.when(c.isNotNull(), text)
