"""Arithmetic answers: rewriting and safe evaluation of expressions in model outputs.

Evaluation never runs text as code: a parsed expression may hold numbers, + - * / **, signs and brackets
only, and powers are bounded. What cannot be evaluated is null, and counts as a wrong answer.
"""

from __future__ import annotations

import ast
import math
import operator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from inkmill.functions.text import as_column

RELATIVE, ABSOLUTE = 1e-5, 1e-8
MOST_POWER, MOST_CHARS = 1000.0, 2000
OPERATORS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Pow: operator.pow, ast.UAdd: operator.pos, ast.USub: operator.neg}


def rewritten(x: Column | str) -> Column:
    """Brackets, powers, a unit, mixed numbers and percentages in one notation."""
    out = F.translate(as_column(x), "[]", "()")
    out = F.replace(out, F.lit("^"), F.lit("**"))
    out = F.replace(out, F.lit("千米/小时"), F.lit(""))
    out = F.regexp_replace(out, r"(\d)\(", "$1+(")
    return F.regexp_replace(out, r"(\d+\.*\d*)%", "($1/100)")


def sides(x: Column | str) -> tuple[Column, Column]:
    """Left and right of the first equals sign; the right is null where there is none."""
    parts = F.split(as_column(x), "=", 2)
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1))


def _value(node: ast.AST) -> float:
    if isinstance(node, ast.Expression):
        return _value(node.body)
    if isinstance(node, ast.Constant) and type(node.value) in (int, float):
        return node.value
    if isinstance(node, ast.UnaryOp) and type(node.op) in OPERATORS:
        return OPERATORS[type(node.op)](_value(node.operand))
    if isinstance(node, ast.BinOp) and type(node.op) in OPERATORS:
        a, b = _value(node.left), _value(node.right)
        if isinstance(node.op, ast.Pow) and abs(b) > MOST_POWER:
            raise ValueError("power")
        if isinstance(node.op, ast.Pow) or isinstance(a, int) and a.bit_length() > 4096:
            a = float(a)
        return OPERATORS[type(node.op)](a, b)
    raise ValueError("not arithmetic")


def value_of(text: str | None) -> float | None:
    """The number that an expression stands for, or None."""
    if text is None or len(text) > MOST_CHARS:
        return None
    try:
        return float(_value(ast.parse(text.strip(), mode="eval")))
    except (ValueError, SyntaxError, ArithmeticError, TypeError, RecursionError, MemoryError):
        return None


def evaluated(x: Column | str) -> Column:
    """The numbers that expressions stand for, in Arrow batches."""

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(value_of, na_action="ignore").astype("float64")

    return run(x)


def close(a: Column, b: Column) -> Column:
    """Whether a is within the tolerance of b, which counts relative to b; null and NaN are far from all."""
    finite = ~F.isnan(a) & ~F.isnan(b) & (F.abs(a) < math.inf) & (F.abs(b) < math.inf)
    near = F.when(finite, F.abs(a - b) <= ABSOLUTE + RELATIVE * F.abs(b)).otherwise((a == b) & ~F.isnan(a))
    return F.coalesce(near, F.lit(False))
