"""Expression trees that compile to Spark Columns.

A tree is a description; Catalyst does the folding, pushdown and code generation. ``null_mode``
is ``"sql"`` (three-valued logic) or ``"zero"`` (a comparison with a null is false, as is a null
operand of a boolean operator, so results hold no nulls).
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ARITHMETIC = {"add": lambda a, b: a + b, "subtract": lambda a, b: a - b, "multiply": lambda a, b: a * b, "divide": lambda a, b: a / b}
COMPARISON = {
    "equals": lambda a, b: a == b,
    "not_equals": lambda a, b: a != b,
    "greater_than": lambda a, b: a > b,
    "greater_than_or_equals": lambda a, b: a >= b,
    "less_than": lambda a, b: a < b,
    "less_than_or_equals": lambda a, b: a <= b,
}
BOOLEAN = {"and": lambda a, b: a & b, "or": lambda a, b: a | b, "xor": lambda a, b: a != b}
OPERATIONS = (*ARITHMETIC, *COMPARISON, *BOOLEAN)
NULL_MODES = ("sql", "zero")


def operation(name: str) -> str:
    """The canonical name of an operation, in any case; ValueError if there is none."""
    if (key := name.lower()) not in OPERATIONS:
        raise ValueError(f"unknown operation {name!r}; known: {', '.join(OPERATIONS)}")
    return key


def is_supported(left: T.DataType, right: T.DataType, name: str) -> bool:
    """Strict typing: comparisons need equal types, arithmetic equal numeric ones, and/or/xor booleans."""
    op = operation(name)
    if op in BOOLEAN:
        return isinstance(left, T.BooleanType) and isinstance(right, T.BooleanType)
    return left == right and (op in COMPARISON or isinstance(left, T.NumericType))


class Expression:
    """Base of the nodes; frozen dataclasses, so equality and hash follow structure."""


@dataclass(frozen=True, eq=False)
class LiteralExpression(Expression):
    value: Any

    def _key(self):
        return type(self.value), self.value

    def __eq__(self, other):
        return isinstance(other, LiteralExpression) and self._key() == other._key()

    def __hash__(self):
        return hash(self._key())


@dataclass(frozen=True)
class ColumnExpression(Expression):
    name: str


@dataclass(frozen=True)
class BinaryExpression(Expression):
    op: str
    left: Expression
    right: Expression


@dataclass(frozen=True)
class UnaryExpression(Expression):
    op: str
    operand: Expression


def _name(name: str | bytes) -> str:
    return name.decode() if isinstance(name, bytes) else name


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def compile_expression(expr: Expression, null_mode: str = "sql") -> Column:
    """The Spark Column of a tree. Byte literals count as UTF-8 text, as strings compare bytewise."""
    if null_mode not in NULL_MODES:
        raise ValueError(f"null_mode must be one of {NULL_MODES}")
    zero = null_mode == "zero"
    false = F.lit(False)
    match expr:
        case LiteralExpression(value=value):
            return F.lit(value.decode() if isinstance(value, bytes) else value)
        case ColumnExpression(name=name):
            return _quoted(_name(name))
        case BinaryExpression(op=op, left=left, right=right):
            op, a, b = operation(op), compile_expression(left, null_mode), compile_expression(right, null_mode)
            if op in ARITHMETIC:
                return ARITHMETIC[op](a, b)
            if op in COMPARISON:
                out = COMPARISON[op](a, b)
                return F.coalesce(out, false) if zero else out
            if zero:
                a, b = F.coalesce(a, false), F.coalesce(b, false)
            return BOOLEAN[op](a, b)
        case UnaryExpression(op="not", operand=operand):
            a = compile_expression(operand, null_mode)
            return ~F.coalesce(a, false) if zero else ~a
        case UnaryExpression(op="is_null", operand=operand):
            return compile_expression(operand, null_mode).isNull()
    raise ValueError(f"unsupported expression {expr!r}")


def _type(df: DataFrame, expr: Expression) -> T.DataType:
    return df.select(compile_expression(expr)).schema[0].dataType


def check_types(df: DataFrame, expr: Expression) -> None:
    """TypeError if an operator of the tree meets types that strict typing refuses."""
    if isinstance(expr, BinaryExpression):
        check_types(df, expr.left)
        check_types(df, expr.right)
        left, right = _type(df, expr.left), _type(df, expr.right)
        if not is_supported(left, right, expr.op):
            raise TypeError(f"{expr.op} of {left.simpleString()} and {right.simpleString()}")
    elif isinstance(expr, UnaryExpression):
        check_types(df, expr.operand)


def _columns(expr: Expression) -> set[str]:
    match expr:
        case ColumnExpression(name=name):
            return {_name(name)}
        case BinaryExpression(left=left, right=right):
            return _columns(left) | _columns(right)
        case UnaryExpression(operand=operand):
            return _columns(operand)
    return set()


def predicate(df: DataFrame, expr: Expression, null_mode: str = "sql", strict_types: bool = False) -> Column:
    """compile_expression, after a check of the names (KeyError) and, on demand, of the types."""
    if missing := _columns(expr) - set(df.columns):
        raise KeyError(f"no column {sorted(missing)}")
    if strict_types:
        check_types(df, expr)
    return compile_expression(expr, null_mode)


def evaluate(data, expr: Expression, null_mode: str = "sql", strict_types: bool = False, alias: str = "result") -> DataFrame:
    """A one-column DataFrame with the value of the tree for each row of a Frame or DataFrame."""
    df = getattr(data, "df", data)
    return df.select(predicate(df, expr, null_mode, strict_types).alias(alias))
