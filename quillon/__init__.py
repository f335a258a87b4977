"""Typed column predicates, batch frames, aggregates and hashes on Spark DataFrames."""

from quillon.operators.expr import BinaryExpression, ColumnExpression, LiteralExpression, UnaryExpression, evaluate
from quillon.operators.frame import Frame

__version__ = "0.1.0"
__build__ = 1
__author__ = "quillon contributors"
__all__ = ["BinaryExpression", "ColumnExpression", "Frame", "LiteralExpression", "UnaryExpression", "evaluate"]
