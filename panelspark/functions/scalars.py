"""Null hygiene and scalar helpers.

NaN and infinity are missing values here, as null is: ``avg`` over a NaN would
be NaN. Division goes through ``ratio``, since ANSI mode raises on zero.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def zero_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(0.0))


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is zero or missing."""
    return F.try_divide(a, F.nullif(b, F.lit(0.0)))


def clip(c: Column, low: Column, high: Column) -> Column:
    """Null stays null, unlike with greatest and least alone."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, low), high))


def row_mean(cols: list[Column]) -> Column:
    """Mean of the columns that aren't null."""
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cols), F.lit(0.0))
    n = sum((c.isNotNull().cast("int") for c in cols), F.lit(0))
    return ratio(total, n)


def correlation(a: str, b: str) -> Column:
    """Correlation of the rows that have both, as an aggregate; null where one of
    the columns is constant there (``F.corr`` is an error then, in ANSI mode)."""
    x, y = F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))
    return ratio(F.covar_pop(a, b), F.stddev_pop(x) * F.stddev_pop(y))


def null_share(names: list[str]) -> Column:
    return sum((F.col(c).isNull().cast("int") for c in names), F.lit(0)) / F.lit(float(len(names)))


def next_quarter_end(d: Column) -> Column:
    """The first quarter end strictly after the date."""
    end = F.last_day(F.add_months(F.trunc(d, "quarter"), 2))
    return F.when(end > d, end).otherwise(F.last_day(F.add_months(F.trunc(d, "quarter"), 5)))


def previous_quarter_end(d: Column) -> Column:
    """The last quarter end strictly before the date."""
    return F.date_sub(F.trunc(d, "quarter"), 1)


MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def month_number(name: Column) -> Column:
    """"Dec" -> 12; null for anything else."""
    return F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), name).cast("int"), F.lit(0))


def yyyymmdd(c: Column) -> Column:
    """A date stored as a number."""
    return F.to_date(c.cast("long").cast("string"), "yyyyMMdd")


def standard_skewness(c: Column, n: Column) -> Column:
    """Bias-corrected skewness from Spark's population skewness."""
    return F.when(n >= 3, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))
