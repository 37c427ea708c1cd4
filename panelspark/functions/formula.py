"""Ratio formulas given as rows, compiled to Column expressions.

A formula has a name, a numerator and a denominator of tokens separated by
blanks. ``+`` and ``-`` take a missing right operand as zero, ``*`` passes it
on; there is no precedence, evaluation runs from left to right.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from .scalars import finite, ratio

OPERATORS = {"+", "-", "*"}


@dataclass(frozen=True)
class Formula:
    name: str
    numerator: str
    denominator: str | None = None


def operand(name: str, available: set[str]) -> Column:
    """A column, or a typed null if the data doesn't have it."""
    return F.col(name) if name in available else F.lit(None).cast("double")


def evaluate(text: str, available: set[str]) -> Column:
    """Token formula; one that begins with an operator is invalid."""
    tokens = text.split()
    if not tokens or tokens[0] in OPERATORS or len(tokens) % 2 == 0:
        raise ValueError(f"not a formula: {text!r}")
    value = operand(tokens[0], available)
    for sign, name in zip(tokens[1::2], tokens[2::2]):
        right = operand(name, available)
        if sign == "*":
            value = value * right
        elif sign in OPERATORS:
            right = F.coalesce(right, F.lit(0.0))
            value = value + right if sign == "+" else value - right
        else:
            raise ValueError(f"unknown operator {sign!r} in {text!r}")
    return value


def growth_lag(name: str, year: int = 52, quarter: int = 12) -> int | None:
    """Rows to look back, by the ending of a formula's name; None: not a growth."""
    return year if name.endswith("yr") else quarter if name.endswith("q") else None


def compile_formulas(df: DataFrame, formulas: list[Formula], window: WindowSpec) -> tuple[dict[str, Column], list[str]]:
    """Expressions by name, and the names skipped.

    No denominator: a copy. Equal sides: growth against an earlier row of
    ``window``. Otherwise a division, null where the denominator is zero.
    """
    available, out, skipped = set(df.columns), {}, []
    for f in formulas:
        top = evaluate(f.numerator, available)
        if f.denominator is None:
            out[f.name] = top
        elif f.numerator == f.denominator:
            lag = growth_lag(f.name)
            if lag is None:
                skipped.append(f.name)
            else:
                out[f.name] = ratio(top, F.lag(top, lag).over(window)) - 1
        else:
            out[f.name] = ratio(top, evaluate(f.denominator, available))
    return out, skipped


def apply_formulas(df: DataFrame, formulas: list[Formula], window: WindowSpec, keep: list[str]) -> DataFrame:
    """``keep`` and one column per formula, in a single projection; rows whose
    ratios are all missing go."""
    expressions, _ = compile_formulas(df, formulas, window)
    out = df.select(*keep, *[finite(e).alias(n) for n, e in expressions.items()])
    return out.dropna("all", subset=list(expressions))
