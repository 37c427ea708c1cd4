"""Filters, duplicates, outliers and fills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clip, null_share
from .calendar import forward_fill


def most_complete(df: DataFrame, keys: list[str], tie_break: list[str]) -> DataFrame:
    """Of rows with equal keys the one with the fewest nulls."""
    nulls = sum((F.col(c).isNull().cast("int") for c in df.columns), F.lit(0))
    order = Window.partitionBy(*keys).orderBy(nulls, *tie_break)
    return df.withColumn("__rn", F.row_number().over(order)).filter("__rn = 1").drop("__rn")


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of rows with equal keys the first in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def on_weekday(df: DataFrame, day: str, weekday: int = 1) -> DataFrame:
    """Rows of one day of the week (1 is Sunday)."""
    return df.filter(F.dayofweek(day) == weekday)


def every_weeks(df: DataFrame, day: str, weeks: int, as_of: str) -> DataFrame:
    """Every n-th Sunday, back from the Sunday before the last Monday that lies
    before ``as_of``."""
    yesterday = F.date_sub(F.lit(as_of).cast("date"), 1)
    monday = F.date_sub(yesterday, (F.dayofweek(yesterday) + 5) % 7)
    gap = F.datediff(F.date_sub(monday, 1), F.col(day))
    return df.filter((gap % (7 * weeks) == 0) & (gap >= 0))


def after_first(df: DataFrame, keys: list[str], day: str, columns: list[str]) -> DataFrame:
    """Rows from where every one of ``columns`` has been known once."""
    known = {f"__{c}": c for c in columns}
    out = forward_fill(df.withColumns({k: F.col(c) for k, c in known.items()}), keys, day, list(known))
    return out.dropna("any", subset=list(known)).drop(*known)


def from_first_complete(df: DataFrame, day: str, columns: list[str], most_null: float = 0.5) -> DataFrame:
    """Rows from the first period with less than this share of nulls."""
    start = df.filter(null_share(columns) < most_null).agg(F.min(day).alias("__start"))
    return df.join(F.broadcast(start), F.col(day) >= F.col("__start")).drop("__start")  # one row


def winsorize(df: DataFrame, keys: list[str], column: str, share: float = 0.01) -> DataFrame:
    """Values clipped to the quantiles ``share`` and 1 - ``share`` of the group."""
    edges = df.groupBy(*keys).agg(F.percentile(column, F.array(F.lit(share), F.lit(1 - share))).alias("__q"))
    clipped = clip(F.col(column), F.col("__q")[0], F.col("__q")[1])
    return df.join(edges, keys).withColumn(column, clipped).drop("__q")


def flip_sign(column: str, names: str, field: str = "field") -> Column:
    """Negative where ``field`` is in the list column ``names``."""
    return F.when(F.array_contains(F.col(names), F.col(field)), -F.col(column)).otherwise(F.col(column))


def flip_name(names: str, field: str = "field") -> Column:
    """A reversed factor's name gets a star."""
    return F.when(F.array_contains(F.col(names), F.col(field)), F.concat(F.col(field), F.lit("*"))).otherwise(F.col(field))


def fill_statement(df: DataFrame) -> DataFrame:
    """Missing statement items from others, in this order, where those exist."""
    rules = [
        ("net_debt", "debt", "cash", -1),
        ("ttm_ebit", "ttm_pretax_income", "ttm_interest", 1),
        ("ttm_ebitda", "ttm_ebit", "ttm_dda", 1),
        ("current_asset", "total_asset", "ppe_net", -1),
    ]
    for name, a, b, sign in rules:
        if a in df.columns and b in df.columns:
            derived = F.col(a) + F.lit(sign) * F.col(b)
            df = df.withColumn(name, F.coalesce(F.col(name), derived) if name in df.columns else derived)
    return df


def ticker_class(key: str, is_etf: str, returns_only: bool = False) -> Column:
    """Which features a row has: index, etf, returns or stock."""
    kind = F.when(F.col(key).startswith("."), "index").when(F.col(is_etf), "etf")
    return kind.otherwise("returns" if returns_only else "stock")


def pillar_filter(df: DataFrame, pillar: str, column: str = "pillar") -> DataFrame:
    """Rows of a pillar; "cluster" stands for all pillars found by clustering."""
    return df.filter(F.col(column).startswith("pillar") if pillar == "cluster" else F.col(column) == pillar)


def report_units(ret: str = "ret", positive: str = "pos_pct") -> dict[str, Column]:
    """Return and share of winners in percent, both null without a return."""
    share = F.when(F.col(ret).isNotNull(), F.round(positive, 2) * 100)
    return {ret: F.round(ret, 4) * 100, positive: share}
