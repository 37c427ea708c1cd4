"""Quantile buckets and what is built on them.

Buckets come from exact, interpolated quantiles per group. Premiums take them
as window aggregates, so the rows are shuffled once and their plan runs once;
groups are cross-sections of one day and fit a task. Cuts, medians and deciles
take groups of any size (``quantiles``). A bucket is right-closed, and edges that
coincide are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio
from ..sources.sinks import settle
from .calendar import run_days
from .quantiles import exact_quantiles

INF = float("inf")


def bucket(value: Column, edges: list[Column]) -> Column:
    """Index of the right-closed bucket between inner ``edges`` (equal ones
    count once)."""
    above = F.lit(0)
    for i, e in enumerate(edges):
        new = F.lit(True) if i == 0 else e > edges[i - 1]
        above = above + ((value > e) & new).cast("int")
    return F.when(value.isNotNull(), above)


def premium_buckets(df: DataFrame, keys: list[str], factor: str, small: int = 65, count: str | None = None) -> DataFrame:
    """Low, middle and high bucket (0, 1, 2) of ``factor`` per group.

    Tails are 30 %, or 20 % in groups of more than ``small`` values; groups
    under 3 values have none. Infinite values belong to the outer buckets but
    don't count. With one edge dropped the buckets are 0 and 1; with more none.
    ``count`` tells how many values a row stands for.
    """
    f, w = F.col(factor), Window.partitionBy(*keys)
    finite = F.when(F.abs(f) != INF, f)
    times = F.lit(1).cast("long") if count is None else F.col(count)
    q = F.percentile(finite, F.array(*map(F.lit, (0.0, 0.2, 0.3, 0.7, 0.8, 1.0))), times)
    known = F.sum(F.when(finite.isNotNull(), times).otherwise(F.lit(0).cast("long")))
    out = df.withColumns({"__n": known.over(w), "__q": q.over(w)})
    low = F.when(F.col("__n") > small, F.col("__q")[1]).otherwise(F.col("__q")[2])
    high = F.when(F.col("__n") > small, F.col("__q")[4]).otherwise(F.col("__q")[3])
    out = out.withColumn("__e", F.array_distinct(F.array(F.col("__q")[0], low, high, F.col("__q")[5])))
    e, bins = F.col("__e"), F.size("__e") - 1
    second, third = F.try_element_at(e, F.lit(2)), F.try_element_at(e, F.lit(3))
    two = F.when(f <= second, 0).otherwise(1)
    three = F.when(f <= second, 0).when(f <= third, 1).otherwise(2)
    outer = F.when(f == INF, 2).when(f == -INF, 0)
    value = F.coalesce(outer, F.when(bins == 3, three).when(bins == 2, two))
    value = F.when((F.col("__n") >= 3) & (bins >= 2) & f.isNotNull(), value)
    return out.withColumn("bucket", value.cast("int")).drop("__n", "__q", "__e")


def cells(df: DataFrame, keys: list[str], column: str, **values: str) -> DataFrame:
    """(keys, column, n, ...): the values of each group once, with the number of rows that
    have them, and of other columns the sums there and the known values (``_n``). Most
    rows of a panel that moves seldom have the same value, and tasks count these
    before rows are moved."""
    sums = [x for name, c in values.items() for x in (F.sum(c).alias(name), F.count(c).alias(f"{name}_n"))]
    return df.groupBy(*keys, column).agg(F.count("*").alias("n"), *sums)


def day_cells(runs: DataFrame, keys: list[str], day: str, columns: list[str], step: int = 1, **values: str) -> DataFrame:
    """(keys, day, columns, n, ...): ``cells`` of several columns per day, of rows that
    hold on the days of runs (from, to).

    Equal runs are counted before their days are made, and the days move once: what
    groups by keys and day, or by more, finds its rows together. A value may be in
    several rows of a day, of other runs.
    """
    sums = [x for name, c in values.items() for x in (F.sum(c).alias(name), F.count(c).alias(f"{name}_n"))]
    counted = runs.groupBy(*keys, "from", "to", *columns).agg(F.count("*").alias("n"), *sums)
    return run_days(counted, day, step).repartition(*keys, day)


def premium_cells(df: DataFrame, keys: list[str], factor: str, label: str, small: int = 65) -> DataFrame:
    """(keys, factor, n, sum, bucket): the bucket of each value, with the number of rows
    and the sum of their labels."""
    return premium_buckets(cells(df, keys, factor, sum=label), keys, factor, small, "n")


def quantile_premium(df: DataFrame, keys: list[str], factor: str = "factor", label: str = "label", small: int = 65) -> DataFrame:
    """Mean label of the low bucket less that of the high one, per group; for
    all groups, factors and labels at once if those are among the keys."""
    return premium_of_cells(premium_cells(df.dropna("any", subset=[factor, label]), keys, factor, label, small), keys)


def premium_of_cells(cut: DataFrame, keys: list[str]) -> DataFrame:
    """The same of counted values with their buckets (keys, n, sum, bucket)."""
    out = cut.groupBy(*keys)
    mean = lambda b: ratio(*[F.sum(F.when(F.col("bucket") == b, F.col(c))) for c in ("sum", "n")])
    count = F.sum(F.when(F.col("bucket").isNotNull(), F.col("n")).otherwise(F.lit(0).cast("long")))
    return out.agg((mean(0) - mean(2)).alias("value"), count.alias("n")).filter("value IS NOT NULL")


def quantile_cut(df: DataFrame, keys: list[str], column: str, bins: int, name: str = "bucket", count: str | None = None) -> DataFrame:
    """Index of the n-quantile bucket per group; ``count`` as in ``exact_quantiles``."""
    edges = exact_quantiles(df, keys, column, [i / bins for i in range(1, bins)], "__q", count=count)
    return df.join(edges, keys).withColumn(name, bucket(F.col(column), [F.col("__q")[i] for i in range(bins - 1)])).drop("__q")


def quantile_edges(train: DataFrame, column: str, bins: int) -> list[float]:
    """Inner edges of the training values; a handful of numbers."""
    q = exact_quantiles(train, [], column, [i / bins for i in range(1, bins)]).first()["q"]
    return sorted(set(q or []))


def fixed_cut(column: str, edges: list[float]) -> Column:
    """Index of the right-closed bin between given inner edges."""
    return bucket(F.col(column), [F.lit(e) for e in edges])


def bucket_median(df: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    """Each value replaced by the median of its bucket (``keys``)."""
    median = exact_quantiles(df, keys, column, [0.5], name)
    return df.join(median.withColumn(name, F.col(name)[0]), keys, "left")


def decile_table(df: DataFrame, keys: list[str], score: str, ret: str, bins: int = 10) -> DataFrame:
    """Mean return of each score decile and the spread of the outer two."""
    counted = settle(cells(df, keys, score, sum=ret).select(*keys, score, "n", "sum", "sum_n"), "deciles")
    cut = quantile_cut(counted, keys, score, bins, count="n")
    mean = lambda i: ratio(*[F.sum(F.when(F.col("bucket") == i, F.col(c))) for c in ("sum", "sum_n")])
    out = cut.groupBy(*keys).agg(*[mean(i).alias(f"d{i}") for i in range(bins)])
    return out.withColumn("spread", F.col(f"d{bins - 1}") - F.col("d0"))


def tercile(column: str, keys: list[str], share: float = 1 / 3) -> Column:
    """0, 1, 2 by the outer quantiles of the group, as a window expression."""
    w = Window.partitionBy(*keys)
    low, high = (F.percentile(column, F.lit(q)).over(w) for q in (share, 1 - share))
    return F.when(F.col(column) <= low, 0).when(F.col(column) <= high, 1).when(F.col(column).isNotNull(), 2)
