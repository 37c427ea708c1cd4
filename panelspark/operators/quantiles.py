"""Exact quantiles of groups of any size.

``F.percentile`` keeps all distinct values of a group in one task, which a few
large groups don't allow. Here groups of more than ``small`` values are searched
for the ranks that the quantiles need: a range of values is cut at approximate
quantiles (a sketch of fixed size), the values in and on the cuts are counted, and
only the ranges that hold a wanted rank are looked into again, until a range has
one distinct value or few enough values for one task to sort. A round leaves some
``1 / cuts`` of the values in play, so a trillion rows take five; values equal to
a cut are a range of their own, so heavy ties end the search instead of stalling it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import settle

#: Values that a task sorts, and cuts of a range.
SMALL, CUTS = 4096, 64


def same(pairs: list[tuple[str, str]]) -> Column:
    """Equality of columns, nulls equal."""
    return reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(y)) for x, y in pairs])


def renamed(df: DataFrame, columns: list[str], prefix: str = "_r") -> tuple[DataFrame, list[tuple[str, str]]]:
    """``df`` with other names for ``columns``, and the pairs of names."""
    pairs = [(c, f"{prefix}{c}") for c in columns]
    return df.withColumnsRenamed(dict(pairs)), pairs


def exact_quantiles(
    df: DataFrame, keys: list[str], column: str, shares: list[float], name: str = "q", small: int = SMALL, cuts: int = CUTS, count: str | None = None
) -> DataFrame:
    """(keys, ``name``), an array of the interpolated quantiles of each group, as
    ``F.percentile`` gives them: nulls don't count, NaN is the largest value, a
    group without values has null. Keys may be null; without keys the whole
    column is one group. ``count`` tells how many values a row stands for. Runs jobs;
    the values are written once.
    """
    of = [f"__k{i}" for i in range(max(len(keys), 1))]
    named = [F.col(k).alias(a) for k, a in zip(keys, of)] if keys else [F.lit(0).alias("__k0")]
    rows = settle(df.select(*named, F.col(column).cast("double").alias("__v"), (F.col(count) if count else F.lit(1)).cast("long").alias("__c")), "quantile-values")
    known = F.sum(F.when(F.col("__v").isNotNull(), F.col("__c")).otherwise(F.lit(0).cast("long")))
    sizes = settle(rows.groupBy(*of).agg(known.alias("__n")), "group-sizes")
    large = sizes.filter(F.col("__n") > small)
    sorted_ = F.percentile("__v", F.array(*map(F.lit, map(float, shares))), F.col("__c")).alias(name)
    if large.isEmpty():
        out = rows.groupBy(*of).agg(sorted_)
    else:
        other, pairs = renamed(large.select(*of), of)
        rest = rows.join(other, same(pairs), "left_anti").groupBy(*of).agg(sorted_)
        out = rest.unionByName(interpolated(large, selected(rows, large, of, shares, small, cuts), of, shares, name))
    if not keys:
        return out.select(name) if not sizes.isEmpty() else df.sparkSession.range(1).select(F.lit(None).cast("array<double>").alias(name))
    return out.select(*[F.col(a).alias(k) for k, a in zip(keys, of)], name)


def position(share: float) -> Column:
    return (F.col("__n") - 1) * F.lit(float(share))


def selected(rows: DataFrame, large: DataFrame, of: list[str], shares: list[float], small: int, cuts: int) -> DataFrame:
    """(keys, rank, value): the values at the ranks that ``shares`` need."""
    ranks = [f(position(s)).cast("long") for s in shares for f in (F.floor, F.ceil)]
    wanted = large.select(*of, F.explode(F.array_distinct(F.array(*ranks))).alias("rank"), F.col("__n").alias("n"))
    # NaN is above all values
    wanted = wanted.withColumns({"lo": F.lit(float("-inf")), "hi": F.lit(float("nan")), "base": F.lit(0).cast("long")})
    within, known = [*of, "lo", "hi"], []
    while True:
        found = settle(looked_into(rows, wanted, of, cuts), "quantile-ranges")
        known.append(found.filter("lo <=> hi").select(*of, "rank", F.col("lo").alias("value")))
        left = found.filter("NOT lo <=> hi")
        if left.isEmpty():
            break
        ranges, pairs = renamed(left.select(*within).distinct(), within)
        inside = same(pairs[: len(of)]) & F.col("__v").between(F.col("_rlo"), F.col("_rhi"))
        rows = settle(rows.join(ranges, inside).select(*of, "__v", "__c"), "quantile-values")
        # few enough to be sorted
        ready, pairs = renamed(left.filter(F.col("n") <= small), of)
        values = ready.select(*[b for _, b in pairs], "lo", "hi").distinct().join(rows, same(pairs) & F.col("__v").between(F.col("lo"), F.col("hi")))
        values = values.groupBy(*of, "lo", "hi").agg(F.sort_array(F.flatten(F.collect_list(F.array_repeat("__v", F.col("__c").cast("int"))))).alias("values"))  # `small` values
        values, others = renamed(values, within, "_s")
        at = same([(b, f"_s{a}") for a, b in pairs] + others[len(of) :])
        picked = ready.join(values, at).select(*[F.col(b).alias(a) for a, b in pairs], "rank", F.element_at("values", (F.col("rank") - F.col("base") + 1).cast("int")).alias("value"))
        known.append(picked)
        wanted = left.filter(F.col("n") > small)
        if wanted.isEmpty():
            break
    return settle(reduce(DataFrame.unionByName, known), "quantile-ranks")


def looked_into(rows: DataFrame, wanted: DataFrame, of: list[str], cuts: int) -> DataFrame:
    """Wanted ranks with the narrower range each lies in: its least and largest
    value (lo, hi), how many values it has (n) and how many lie below it (base)."""
    within = [*of, "lo", "hi"]
    ranges, pairs = renamed(wanted.select(*within).distinct(), of)
    inside = rows.join(ranges, same(pairs) & F.col("__v").between(F.col("lo"), F.col("hi"))).select(*within, "__v", "__c")
    shares = F.array(*[F.lit(i / cuts) for i in range(1, cuts)])
    edges = inside.groupBy(*within).agg(F.array_distinct(F.percentile_approx("__v", shares, F.lit(20 * cuts))).alias("cut"))
    edges, pairs = renamed(settle(edges, "quantile-cuts"), within)
    below = F.size(F.filter("cut", lambda c: c < F.col("__v")))
    cell = 2 * below + F.coalesce((F.try_element_at("cut", below + 1) == F.col("__v")).cast("int"), F.lit(0))
    counted = inside.join(edges, same(pairs)).groupBy(*within, cell.alias("cell")).agg(F.sum("__c").alias("m"), F.min("__v").alias("a"), F.max("__v").alias("b"))
    before = F.sum("m").over(Window.partitionBy(*within).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))  # 2 * cuts rows
    counted, pairs = renamed(counted.withColumn("before", F.coalesce(before, F.lit(0))), within)
    place = F.col("rank") - F.col("base") - F.col("before")
    hit = wanted.join(counted, same(pairs) & (place >= 0) & (place < F.col("m")))
    return hit.select(*of, "rank", F.col("m").alias("n"), F.col("a").alias("lo"), F.col("b").alias("hi"), (F.col("base") + F.col("before")).alias("base"))


def interpolated(large: DataFrame, known: DataFrame, of: list[str], shares: list[float], name: str) -> DataFrame:
    """The quantiles of each group between its values at the two nearest ranks."""
    once = known.groupBy(*of, "rank").agg(F.first("value").alias("value"))
    values, pairs = renamed(once.groupBy(*of).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at")), of)
    out = []
    for s in shares:
        h = position(s)
        low, high = F.floor(h).cast("long"), F.ceil(h).cast("long")
        a, b = F.try_element_at("at", low), F.try_element_at("at", high)
        out.append(F.when((low == high) | (a == b), a).otherwise((high - h) * a + (h - low) * b))
    return large.join(values, same(pairs)).select(*of, F.array(*out).alias(name))


def with_quantiles(df: DataFrame, keys: list[str], column: str, shares: list[float], name: str, of: DataFrame | None = None, count: str | None = None) -> DataFrame:
    """Each row with the quantiles, an array, of its group in ``of``, or in ``df``."""
    table, pairs = renamed(exact_quantiles(df if of is None else of, keys, column, shares, name, count=count), keys, "__of_")
    if not keys:
        return df.crossJoin(F.broadcast(table))  # one row
    return df.join(table, same(pairs)).drop(*[b for _, b in pairs])
