"""Cross-sectional scores.

Every step is an aggregate per (group, day, factor) on the long table joined
back, or a window over it, so no factor or day is looped over.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clip, ratio, row_mean
from ..sources.sinks import settle
from .buckets import cells
from .quantiles import renamed, same, with_quantiles

#: The search for the exponent of the power transform: the first step, exponents
#: tried to either side in a round, rounds at the first step at most (which reach
#: -96 to 96), and the step that ends it.
STEP, TRIED, REACH, PRECISION = 4.0, 8, 3, 2e-5


def standardize(column: str, keys: list[str]) -> Column:
    """Zero mean and unit population deviation; a constant group becomes zero."""
    w = Window.partitionBy(*keys)
    sd = F.stddev_pop(column).over(w)
    return (F.col(column) - F.avg(column).over(w)) / F.when(sd > 0, sd).otherwise(1.0)


def robust_scale(column: str, keys: list[str]) -> Column:
    """(x - median) / interquartile range; a zero range counts as one."""
    q = F.percentile(column, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).over(Window.partitionBy(*keys))
    iqr = q[2] - q[0]
    return (F.col(column) - q[1]) / F.when(iqr > 0, iqr).otherwise(1.0)


def min_max(column: str, keys: list[str], top: float = 10.0) -> Column:
    """0 to ``top`` within the group; a zero range counts as one."""
    w = Window.partitionBy(*keys)
    low = F.min(column).over(w)
    span = F.max(column).over(w) - low
    return (F.col(column) - low) / F.when(span > 0, span).otherwise(1.0) * top


def with_group_values(df: DataFrame, keys: list[str], values: dict[str, Column], few: bool = False) -> DataFrame:
    """Aggregates of each row's group beside the row. Many small groups take a
    window; ``few`` large ones are aggregated with map-side combine and joined,
    so that no task gets all rows of a group."""
    if not few:
        w = Window.partitionBy(*keys)
        return df.withColumns({c: v.over(w) for c, v in values.items()})
    of = {k: f"__{k}" for k in keys}
    table = df.groupBy(*[F.col(k).alias(n) for k, n in of.items()]).agg(*[v.alias(c) for c, v in values.items()])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in of.items()])
    return df.join(table, same).drop(*of.values())


def robust_min_max(df: DataFrame, keys: list[str], column: str, top: float = 10.0) -> DataFrame:
    """``robust_scale``, then ``min_max``: the numbers of a group come from its values
    counted once, and the rows stay where they are."""
    q = F.percentile(column, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("n"))
    found = cells(df, keys, column).groupBy(*keys).agg(q.alias("__q"), F.min(column).alias("__a"), F.max(column).alias("__z"))
    found, pairs = renamed(settle(found, "group-values"), keys)
    iqr = F.col("__q")[2] - F.col("__q")[0]
    scaled = lambda c: (F.col(c) - F.col("__q")[1]) / F.when(iqr > 0, iqr).otherwise(1.0)
    span = scaled("__z") - scaled("__a")
    out = df.join(found, same(pairs))
    value = (scaled(column) - scaled("__a")) / F.when(span > 0, span).otherwise(1.0) * top
    return out.withColumn(column, value).drop(*found.columns)


def clip_quantiles(df: DataFrame, keys: list[str], column: str, low: float, high: float, few: bool = False) -> DataFrame:
    """Clip to quantiles of the group given by ``keys``: a factor's tickers, or
    with the ticker as key (and 0.0001, 0.0099) the factors of one ticker."""
    if few:
        out = with_quantiles(df, keys, column, [low, high], "__q")
    else:
        out = with_group_values(df, keys, {"__q": F.percentile(column, F.array(F.lit(low), F.lit(high)))})
    return out.withColumn(column, clip(F.col(column), F.col("__q")[0], F.col("__q")[1])).drop("__q")


def power_transform(x: Column, lam: Column) -> Column:
    """Yeo-Johnson."""
    near = lambda v, to: F.abs(v - to) < 1e-9
    up = F.when(near(lam, 0), F.log1p(F.greatest(x, F.lit(0.0)))).otherwise((F.pow(F.greatest(x, F.lit(0.0)) + 1, lam) - 1) / F.when(~near(lam, 0), lam))
    minus = F.greatest(-x, F.lit(0.0))
    down = F.when(near(lam, 2), -F.log1p(minus)).otherwise(-(F.pow(minus + 1, 2 - lam) - 1) / F.when(~near(lam, 2), 2 - lam))
    return F.when(x >= 0, up).otherwise(down)


def best_lambda(df: DataFrame, keys: list[str], column: str, count: str | None = None) -> DataFrame:
    """(keys, lam): per group the exponent with the largest likelihood, within
    ``PRECISION`` of it.

    All groups are searched at once: a round is one aggregate that tries 17
    exponents around each group's best so far; while one is best at the end of its
    range, the range moves on, else the next round looks between the neighbours of
    the best. Ties go to the exponent nearest to one. ``count`` tells how many values
    a row stands for. What a round needs of a group alone is made per group.
    """
    x = F.col("__x")
    known = df.filter(F.col(column).isNotNull() & ~F.isnan(column))
    known = known.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(column).cast("double").alias("__x"), *([F.col(count).alias("__times")] if count else []))
    rows = settle(known.withColumn("__j", F.signum(x) * F.log1p(F.abs(x))), "transform-values")
    of = [f"__k{i}" for i in range(len(keys))]
    best, step, turn = rows.select(*of).distinct().withColumn("lam", F.lit(0.0)), STEP, 1
    y = power_transform(x, F.col("lam"))
    if count:
        times = F.col("__times")
        # squares about the transform of the group's mean, which lies among the values
        best = settle(rows.groupBy(*of).agg((F.sum(x * times) / F.sum(times)).alias("__u")), "transform-means").withColumn("lam", F.lit(0.0))
        y = y - F.col("__t")
        n, s = F.sum(times), F.sum(F.col("__j") * times)
        v = F.sum(y * y * times) / n - F.pow(F.sum(y * times) / n, F.lit(2))
    else:
        n, s, v = F.count("*"), F.sum("__j"), F.var_pop(y)
    own = [c for c in best.columns if c == "__u"]  # a group's mean goes along
    while True:
        at = lambda i, step=step: F.col("lam") + step * i
        of_mean = lambda i: [power_transform(F.col("__u"), at(i)).alias("__t")] if own else []
        tried = F.transform(F.sequence(F.lit(-TRIED), F.lit(TRIED)), lambda i: F.struct(i.alias("__i"), at(i).alias("lam"), *of_mean(i)))
        other, pairs = renamed(best.select(*of, *own, tried.alias("__tried")), of)
        each = rows.join(other, same(pairs)).select(*rows.columns, *own, F.inline("__tried"))
        sums = each.groupBy(*of, *own, "__i", "lam").agg(n.alias("n"), s.alias("s"), v.alias("v"))
        ll = F.when((F.col("v") > 0) & (F.col("v") < float("inf")), -F.col("n") / 2 * F.ln("v") + (F.col("lam") - 1) * F.col("s"))
        told = F.struct(ll.alias("ll"), (-F.abs(F.col("lam") - 1)).alias("near"), "lam", (F.abs("__i") == TRIED).alias("end"))
        top = settle(sums.groupBy(*of, *own).agg(F.max(told).alias("top")), "exponents")
        best = top.select(*of, *own, F.col("top.lam").alias("lam"))
        if turn < REACH and step == STEP and not top.filter("top.end").isEmpty():
            turn += 1
            continue
        if step <= PRECISION:
            return best.select(*of, "lam").withColumnsRenamed(dict(zip(of, keys)))
        step /= TRIED


def trim_outliers(df: DataFrame, keys: list[str], column: str, skew: float = 5, deviations: float = 2) -> DataFrame:
    """Strongly skewed groups are power-transformed, then all are clipped to the
    mean +- ``deviations`` population deviations."""
    strong = settle(df.groupBy(*keys).agg(F.abs(F.skewness(column)).alias("s")).filter(F.col("s") > skew).select(*keys), "skewed")
    out = df
    if not strong.isEmpty():
        other, pairs = renamed(strong, keys)
        lam, of = renamed(best_lambda(df.join(other, same(pairs), "left_semi"), keys, column), keys)
        out = df.join(lam, same(of), "left").drop(*[b for _, b in of])
        x = F.when(F.col("lam").isNotNull(), power_transform(F.col(column), F.col("lam"))).otherwise(F.col(column))
        out = out.withColumn(column, x).drop("lam")
    w = Window.partitionBy(*keys)
    mean, sd = F.avg(column).over(w), F.stddev_pop(column).over(w)
    return out.withColumn(column, clip(F.col(column), mean - deviations * sd, mean + deviations * sd))


#: Quantiles that outliers are clipped to: as documented (per factor), and the
#: bounds that apply across the factors of one ticker.
DOCUMENTED, ACROSS_FACTORS = (0.01, 0.99), (0.0001, 0.0099)


def fundamental_score(
    df: DataFrame, keys: list[str], column: str = "value", quantiles: tuple[float, float] | None = DOCUMENTED, across: list[str] | None = None,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Standardize, clip to quantiles, trim, scale robustly, scale to 0..10, and
    turn round, so that small factor values score high. ``keys``: group, day,
    factor; ``across`` (group, day, ticker, with ACROSS_FACTORS) clips each
    ticker over its factors instead.

    Each step but that one takes numbers of a group, which come from its values counted
    once (``counted``: keys, column, n, if they are known), so rows meet one small table
    and stay where they are."""
    if not across:
        return counted_score(df, keys, column, quantiles, counted)
    out = df.withColumn(column, standardize(column, keys))
    if quantiles:
        out = clip_quantiles(out, across, column, *quantiles)
    out = trim_outliers(out, keys, column)
    out = out.withColumn(column, robust_scale(column, keys))
    return out.withColumn(column, 10 - min_max(column, keys))


def counted_score(
    df: DataFrame, keys: list[str], column: str, quantiles: tuple[float, float] | None, counted: DataFrame | None = None, skew: float = 5, deviations: float = 2
) -> DataFrame:
    """``fundamental_score`` by the values of each group counted once."""
    x, steps = F.col(column), []
    counted = cells(df, keys, column) if counted is None else counted
    of = settle(counted.withColumn("n", F.when(x.isNotNull(), F.col("n")).otherwise(F.lit(0).cast("long"))), "counted")
    times = F.col("n")
    mean = lambda v: ratio(F.sum(v * times), F.sum(times).cast("double"))

    def apply(found: DataFrame, value: Column, how: str = "inner") -> None:
        """The step's numbers of each group (a row a group) beside values; rows take
        all steps at the end."""
        nonlocal of
        steps.append((found, value))
        found, pairs = renamed(found, keys)
        of = of.join(found, same(pairs), how).withColumn(column, value).drop(*found.columns)

    def applied(rows: DataFrame) -> DataFrame:
        """The steps one after the other, by one table of all their numbers."""
        names = [[c for c in found.columns if c not in keys] for found, _ in steps]
        packed = [found.select(*keys, F.struct(*own).alias(f"__s{i}")) for i, ((found, _), own) in enumerate(zip(steps, names))]
        numbers = packed[0]
        for found in packed[1:]:
            found, pairs = renamed(found, keys)
            numbers = numbers.join(found, same(pairs), "left").drop(*[b for _, b in pairs])
        numbers, pairs = renamed(settle(numbers, "numbers"), keys)
        rows = rows.join(numbers, same(pairs))
        for i, ((_, value), own) in enumerate(zip(steps, names)):
            rows = rows.withColumns({c: F.col(f"__s{i}")[c] for c in own}).withColumn(column, value).drop(*own)
        return rows.select(df.columns)

    def moments() -> DataFrame:
        """Mean and population deviation: of equal values the value, and zero."""
        first = of.groupBy(*keys).agg(F.min(column).alias("__a"), F.max(column).alias("__z"), mean(x).alias("__u"))
        first = settle(first.withColumn("__u", F.when(F.col("__a") == F.col("__z"), F.col("__a")).otherwise(F.col("__u"))).drop("__a", "__z"), "means")
        other, pairs = renamed(first, keys)
        each = of.join(other, same(pairs)).drop(*[b for _, b in pairs])
        d = x - F.col("__u")
        return settle(each.groupBy(*keys).agg(F.first("__u").alias("__u"), F.sqrt(mean(d * d)).alias("__d"), mean(d * d * d).alias("__m3")), "moments")

    u, d, q = F.col("__u"), F.col("__d"), F.col("__q")
    apply(moments(), (x - u) / F.when(d > 0, d).otherwise(1.0))
    if quantiles:
        apply(settle(of.groupBy(*keys).agg(F.percentile(column, F.array(*map(F.lit, quantiles)), times).alias("__q")), "clips"), clip(x, q[0], q[1]))
    found = moments()
    strong = found.filter(F.abs(ratio(F.col("__m3"), d * d * d)) > skew).select(*keys)
    if not strong.isEmpty():
        other, pairs = renamed(strong, keys)
        lam = best_lambda(of.filter("n > 0").join(other, same(pairs), "left_semi"), keys, column, "n")
        lam = settle(lam.withColumnRenamed("lam", "__lam"), "transforms")
        apply(lam, F.when(F.col("__lam").isNotNull(), power_transform(x, F.col("__lam"))).otherwise(x), "left")
        found = moments()
    apply(found, clip(x, u - deviations * d, u + deviations * d))
    ends = of.groupBy(*keys).agg(F.percentile(column, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), times).alias("__q"), F.min(column).alias("__a"), F.max(column).alias("__z"))
    iqr = q[2] - q[0]
    scaled = lambda v: (v - q[1]) / F.when(iqr > 0, iqr).otherwise(1.0)
    span = scaled(F.col("__z")) - scaled(F.col("__a"))
    apply(settle(ends, "ends"), 10 - (scaled(x) - scaled(F.col("__a"))) / F.when(span > 0, span).otherwise(1.0) * 10.0)
    return applied(df)


def plain_score(df: DataFrame, keys: list[str], column: str = "value", skew: float = 5, few: bool = False) -> DataFrame:
    """The older score: logarithm if skewed, clip to median +- 2 deviations,
    scale to 0..10, missing values at 0.9 of the mean. Scaling robustly before
    0..10 changes nothing, as both are linear, and is left out."""
    x = F.col(column)
    out = with_group_values(df, keys, {"__s": F.abs(F.skewness(column)) > skew}, few)
    out = out.withColumn(column, F.when(F.col("__s"), F.log1p(F.greatest(x, F.lit(0.0)))).otherwise(x)).drop("__s")
    if few:
        out = with_quantiles(out, keys, column, [0.5], "__q").withColumn("__m", F.col("__q")[0]).drop("__q")
        out = with_group_values(out, keys, {"__d": F.stddev_pop(column)}, few)
    else:
        out = with_group_values(out, keys, {"__m": F.percentile(column, F.lit(0.5)), "__d": F.stddev_pop(column)})
    out = out.withColumn(column, clip(x, F.col("__m") - 2 * F.col("__d"), F.col("__m") + 2 * F.col("__d"))).drop("__m", "__d")
    out = with_group_values(out, keys, {"__a": F.min(column), "__z": F.max(column), "__u": F.avg(column)}, few)
    span = F.col("__z") - F.col("__a")
    scaled = lambda v: (v - F.col("__a")) / F.when(span > 0, span).otherwise(1.0) * 10
    return out.withColumn(column, F.coalesce(scaled(x), scaled(F.col("__u")) * 0.9)).drop("__a", "__z", "__u")


def penalize_missing(df: DataFrame, keys: list[str], score: str, ret: str, share: float = 0.9) -> DataFrame:
    """Rows without a return go; a missing score is 0.9 of the group's mean."""
    mean = F.avg(score).over(Window.partitionBy(*keys)) * share
    return df.filter(F.col(ret).isNotNull()).withColumn(score, F.coalesce(F.col(score), mean))


def pillar_score(scores: DataFrame, selected: DataFrame, keys: list[str], ticker: str, metric: str = "max_ret") -> DataFrame:
    """Mean score of the selected factors (``keys``, factor, side) per ticker.

    max_ret: that of the max side; avg_ret: 2.5 + max - min / 2; net_ret: 5 +
    max - min.
    """
    rows = scores.join(selected, [*keys, "factor"])
    best = F.avg(F.when(F.col("side") == "max", F.col("value")))
    worst = F.coalesce(F.avg(F.when(F.col("side") == "min", F.col("value"))), F.lit(0.0))
    value = {"max_ret": best, "avg_ret": 2.5 + best - worst / 2, "net_ret": 5 + best - worst}[metric]
    return rows.groupBy(*keys, ticker).agg(value.alias("score"))


def final_score(df: DataFrame, keys: list[str], pillars: list[str]) -> DataFrame:
    """Mean over configurations of each <pillar>_score and <pillar>_score_extra;
    extra_score is the mean of the latter, ai_score that of all scores,
    extra_score among them."""
    plain, extra = [f"{p}_score" for p in pillars], [f"{p}_score_extra" for p in pillars]
    out = df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in (*plain, *extra)])
    out = out.withColumn("extra_score", row_mean([F.col(c) for c in extra]))
    return out.withColumn("ai_score", row_mean([*[F.col(c) for c in plain], F.col("extra_score")]))


def backfill_ranks(ranks: DataFrame, groups: DataFrame, group: str = "currency_code", base: str = "USD") -> DataFrame:
    """Groups without ranks of their own take those of the base group."""
    without = groups.select(group).distinct().join(ranks.select(group).distinct(), group, "left_anti")
    base_rows = ranks.filter(F.col(group) == base).drop(group)
    return ranks.unionByName(without.crossJoin(F.broadcast(base_rows)).select(ranks.columns))  # a table of factors


def normalize(column: str, keys: list[str]) -> Column:
    return ratio(F.col(column), F.max(column).over(Window.partitionBy(*keys)))


def list_score(scores: DataFrame, ranks: DataFrame, keys: list[str], ticker: str, extra_z: float = 1.0) -> DataFrame:
    """The older pillar scores: mean of the best factors' scores less that of
    the worst ones; ``extra`` is the mean of factors with ``pred_z`` of at
    least ``extra_z``; ``total`` the mean of both."""
    rows = scores.join(ranks, [*keys, "factor"])
    best, worst = (F.avg(F.when(F.col("side") == s, F.col("value"))) for s in ("max", "min"))
    out = rows.groupBy(*keys, ticker).agg((best - worst).alias("pillar"), F.avg(F.when(F.col("pred_z") >= extra_z, F.col("value"))).alias("extra"))
    return out.withColumn("total", row_mean([F.col("pillar"), F.col("extra")]))
