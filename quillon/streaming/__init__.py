"""An extra: the same predicates over a streaming DataFrame."""

from pyspark.sql import DataFrame

from quillon.operators.expr import Expression, predicate


def filter_stream(stream: DataFrame, expr: Expression, null_mode: str = "sql") -> DataFrame:
    """Stateless, so it needs no watermark and works in any output mode."""
    return stream.where(predicate(stream, expr, null_mode))
