"""In-memory Arrow data and files as Frames."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession

from quillon.functions.strings import struct_column_json
from quillon.operators.frame import Frame


def normalise(table: pa.Table) -> pa.Table:
    """Times become long microseconds and uint64 decimal(20,0), which Spark can hold."""
    for i, field in enumerate(table.schema):
        column = table.column(i)
        if pa.types.is_time(field.type):
            column = column.cast(pa.time64("us")).cast(pa.int64())
        elif pa.types.is_uint64(field.type):
            column = column.cast(pa.decimal128(20, 0))
        table = table.set_column(i, field.name, column)
    return table


def from_arrow(spark: SparkSession, table: pa.Table, order_key: str | None = None) -> Frame:
    return Frame(spark.createDataFrame(normalise(table)), order_key)


def vector_from_arrow(spark: SparkSession, array: pa.Array | pa.ChunkedArray, name: str = "value", to_json: bool = False) -> Frame:
    """One column. With to_json a struct array becomes JSON text, as in struct_column_json."""
    frame = from_arrow(spark, pa.table({name: array}))
    if to_json and pa.types.is_struct(array.type):
        return Frame(frame.df.select(struct_column_json(frame.df, name).alias(name)))
    return frame


def read(spark: SparkSession, path: str, fmt: str = "parquet", order_key: str | None = None, **options) -> Frame:
    """An extra: any format of spark.read."""
    return Frame(spark.read.format(fmt).options(**options).load(path), order_key)


def write(frame: Frame, path: str, fmt: str = "parquet", mode: str = "error", **options) -> None:
    frame.df.write.format(fmt).mode(mode).options(**options).save(path)


__all__ = ["from_arrow", "normalise", "read", "vector_from_arrow", "write"]
