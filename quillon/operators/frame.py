"""Frame: a DataFrame with batch-style projection, renaming and positional selection.

Frames are immutable: every method returns a new one.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.types import type_code
from quillon.operators.expr import Expression, _name, _quoted, predicate

#: Rows of a key range, about, ranges at most, and sampled keys for each bound between them.
RANGE_ROWS, MOST_RANGES, SAMPLE_KEYS = 500_000, 4096, 32


def _zero(df: DataFrame, field: T.StructField):
    """What a null becomes in zero mode: 0 or False for fixed-width types; others stay null."""
    c = _quoted(field.name)
    if isinstance(field.dataType, T.NumericType):
        return F.coalesce(c, F.lit(0).cast(field.dataType))
    if isinstance(field.dataType, T.BooleanType):
        return F.coalesce(c, F.lit(False))
    if isinstance(field.dataType, T.DateType):
        return F.coalesce(c, F.to_date(F.lit("1970-01-01")))
    if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
        return F.coalesce(c, F.lit("1970-01-01 00:00:00").cast(field.dataType))
    return c


def _range_of(c, bounds: list, base: int = 0):
    """The number of bounds that c reaches, by a balanced tree of comparisons; a null reaches none."""
    if not bounds:
        return F.lit(base)
    mid = len(bounds) // 2
    return F.when(c >= F.lit(bounds[mid]), _range_of(c, bounds[mid + 1 :], base + mid + 1)).otherwise(_range_of(c, bounds[:mid], base))


def ranges(df: DataFrame, key: str) -> DataFrame:
    """df with __range, which follows the key's order: ranges of about RANGE_ROWS rows, cut at sampled bounds.

    So no task sorts the table. The driver sees the sampled keys, SAMPLE_KEYS for each range.
    """
    c = _quoted(key)
    n = min(MOST_RANGES, df.count() // RANGE_ROWS + 1)
    if n == 1:
        return df.withColumn("__range", F.lit(0))
    keys = df.select(c.alias("k")).where(F.col("k").isNotNull())
    keys = sorted(r[0] for r in keys.orderBy(F.xxhash64("k"), "k").limit(n * SAMPLE_KEYS).collect())
    bounds = sorted({keys[i * len(keys) // n] for i in range(1, n)}) if keys else []
    return df.withColumn("__range", _range_of(c, bounds))


def before_ranges(cut: DataFrame, value) -> tuple[list[int], int]:
    """The sum of an aggregate over the ranges before each, and over all; one number a range reaches the driver."""
    per = {r[0]: r[1] or 0 for r in cut.groupBy("__range").agg(value).collect()}
    out, total = [], 0
    for k in range(max(per, default=0) + 1):
        out.append(total)
        total += per.get(k, 0)
    return out, total


def base_of(before: list[int]):
    """The number of a row's range in a list."""
    return F.get(F.array(*[F.lit(n).cast("long") for n in before]), F.col("__range"))


def positions(df: DataFrame, key: str, alias: str = "__pos") -> tuple[DataFrame, int]:
    """df with each row's place (from 0) in ascending order of a unique key (null first), and the number of rows."""
    cut = ranges(df, key)
    before, total = before_ranges(cut, F.count(F.lit(1)))
    return _ranked(cut, key, before, alias).drop("__range"), total


def _ranked(cut: DataFrame, key: str, before: list[int], alias: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("__range").orderBy(_quoted(key).asc_nulls_first()))
    return cut.withColumn(alias, base_of(before) + rank - 1)


class Frame:
    def __init__(self, df: DataFrame, order_key: str | None = None):
        self.df, self.order_key = df, order_key

    @property
    def shape(self) -> tuple[int, int]:
        return self.num_rows, self.num_columns

    @property
    def num_rows(self) -> int:
        return self.df.count()

    @property
    def num_columns(self) -> int:
        return len(self.df.columns)

    @property
    def column_names(self) -> list[bytes]:
        return [c.encode() for c in self.df.columns]

    @property
    def column_types(self) -> list[int]:
        return [type_code(f.dataType) for f in self.df.schema]

    def column(self, name: str | bytes):
        """The Column; KeyError if there is none."""
        self._check([_name(name)])
        return _quoted(_name(name))

    def _check(self, names: list[str]) -> None:
        if missing := [n for n in names if n not in self.df.columns]:
            raise KeyError(f"no column {missing}")

    def select(self, columns: str | bytes | list) -> Frame:
        names = [_name(c) for c in (columns if isinstance(columns, (list, tuple)) else [columns])]
        self._check(names)
        return Frame(self.df.select(*map(_quoted, names)), self.order_key if self.order_key in names else None)

    def rename(self, names: list | dict) -> Frame:
        old = self.df.columns
        if isinstance(names, dict):
            names = {_name(k): _name(v) for k, v in names.items()}
            new = [names.get(c, c) for c in old]
        else:
            new = [_name(n) for n in names]
            if len(new) != len(old):
                raise ValueError(f"{len(new)} names for {len(old)} columns")
        return Frame(self.df.toDF(*new), new[old.index(self.order_key)] if self.order_key in old else None)

    def filter(self, expr: Expression, null_mode: str = "sql", strict_types: bool = False) -> Frame:
        return Frame(self.df.where(predicate(self.df, expr, null_mode, strict_types)), self.order_key)

    def take(self, indices, null_mode: str = "sql", order_key: str | None = None) -> Frame:
        """Rows at the places of indices in order of the key, in index order, repeats allowed.

        IndexError beyond the rows. Only the key ranges that hold an index are shuffled and ranked.
        The list of indices becomes a small local table; Spark broadcasts it only below
        spark.sql.autoBroadcastJoinThreshold.
        """
        key = order_key or self.order_key
        if key is None:
            raise ValueError("take needs an order key")
        indices = [int(i) for i in (indices if hasattr(indices, "__iter__") else [indices])]
        cut = ranges(self.df, key)
        before, total = before_ranges(cut, F.count(F.lit(1)))
        if bad := [i for i in indices if not 0 <= i < total]:
            raise IndexError(f"index {bad[0]} of {total} rows")
        held = sorted({bisect.bisect_right(before, i) - 1 for i in indices})
        placed = _ranked(cut.where(F.col("__range").isin(held)) if len(held) < len(before) else cut, key, before, "__pos").drop("__range")
        want = self.df.sparkSession.createDataFrame([(i, n) for n, i in enumerate(indices)], "__pos long, __slot long")
        out = placed.join(want, "__pos").orderBy("__slot")
        fields = self.df.schema.fields
        return Frame(out.select(*[(_zero(out, f) if null_mode == "zero" else _quoted(f.name)).alias(f.name) for f in fields]), self.order_key)

    def copy(self, columns: list | None = None, indices=None, mask: Expression | None = None) -> Frame:
        out = self if mask is None else self.filter(mask)
        out = out if indices is None else out.take(indices)
        return out if columns is None else out.select(columns)

    def __getitem__(self, i: int) -> tuple:
        return tuple(self.take([i]).df.first())

    def element(self, column: str | bytes, i: int):
        """One value: strings as bytes, dates as days and timestamps as microseconds since the epoch, null as None."""
        c = _quoted(_name(column))
        frame = self if self.order_key is None or self.order_key == _name(column) else self.select([self.order_key, column])
        kind = self.df.schema[_name(column)].dataType
        raw = {T.StringType: lambda: c.cast("binary"), T.DateType: lambda: F.unix_date(c), T.TimestampType: lambda: F.unix_micros(c), T.TimestampNTZType: lambda: F.unix_micros(c.cast("timestamp"))}
        out = frame.take([i]).df.select(raw.get(type(kind), lambda: c)()).first()[0]
        return bytes(out) if isinstance(out, bytearray) else out

    def to_arrow(self):
        return self.df.toArrow()

    def column_to_arrow(self, name: str | bytes, binary: bool = False):
        """One column as an Arrow array; binary: strings as their bytes."""
        df = self.select(name).df
        return (df.select(F.col(df.columns[0]).cast("binary").alias(df.columns[0])) if binary else df).toArrow().column(0)

    def to_pylist(self, column: str | bytes) -> list:
        return [r[0] for r in self.select(column).df.collect()]

    def __repr__(self) -> str:
        return f"Frame({', '.join(f'{n}: {t}' for n, t in self.df.dtypes)})"
