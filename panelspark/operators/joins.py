"""Joins with the sides and key names that panels need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import finite


def left_all(base: DataFrame, *others: tuple[DataFrame, list[str]]) -> DataFrame:
    """Left joins of several frames, each on its own keys. Small sides are
    broadcast by Spark's own threshold."""
    for other, keys in others:
        base = base.join(other, keys, "left")
    return base


def convert_currency(df: DataFrame, fx: DataFrame, columns: list[str], currency: str, day: str) -> DataFrame:
    """Columns divided by the rate of the row's currency and day (columns
    ``currency_code``, ``trading_day``, ``fx_rate`` of ``fx``). Inner: rows
    without a rate vanish."""
    rates = fx.select(F.col("currency_code").alias("__c"), F.col("trading_day").alias("__d"), F.col("fx_rate").alias("__fx"))
    out = df.join(rates, (F.col(currency) == F.col("__c")) & (F.col(day) == F.col("__d")))
    return out.withColumns({c: F.try_divide(F.col(c), F.nullif("__fx", F.lit(0.0))) for c in columns}).drop("__c", "__d", "__fx")


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, name: str, default: Column | None = None) -> DataFrame:
    """Left join of one attribute; ``default`` where there is none."""
    out = df.join(table.select(key, F.col(value).alias("__v")), key, "left")
    return out.withColumn(name, F.col("__v") if default is None else F.coalesce(F.col("__v"), default)).drop("__v")


def outer_with_suffix(a: DataFrame, b: DataFrame, keys: list[str], left: str, right: str) -> DataFrame:
    """Full outer join; names that both have get a suffix."""
    clash = (set(a.columns) & set(b.columns)) - set(keys)
    a = a.withColumnsRenamed({c: c + left for c in clash})
    b = b.withColumnsRenamed({c: c + right for c in clash})
    return a.join(b, keys, "full")


def only_in(df: DataFrame, allowed: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is listed (semi-join instead of a list on the driver)."""
    return df.join(allowed, keys, "left_semi")


def not_in(df: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key isn't listed: what a restart still has to do."""
    return df.join(done, keys, "left_anti")


def complete_inner(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join that must keep every row of ``a``."""
    if not a.join(b, keys, "left_anti").isEmpty():
        raise ValueError(f"rows without a partner on {keys}")
    return a.join(b, keys)


def product(*frames: DataFrame) -> DataFrame:
    """All combinations of small configuration frames."""
    out = frames[0]
    for f in frames[1:]:
        out = out.crossJoin(F.broadcast(f))  # parameter lists, not data
    return out


def with_group_mean(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    return df.join(df.groupBy(*keys).agg(F.avg(finite(F.col(value))).alias(name)), keys, "left")
