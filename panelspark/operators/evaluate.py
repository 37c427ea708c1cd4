"""Selection of factors by backtest, and evaluation of portfolios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio
from ..sources.sinks import settle
from .buckets import cells
from .quantiles import renamed, same
from .reshape import concat_lists, to_map


def good_and_bad(df: DataFrame, keys: list[str], pred: str = "pred", share: float = 0.33, single: float = 0.005) -> DataFrame:
    """Marks ``side`` (max, min or null): strictly outside the quantiles of the
    group, or beyond +-``single`` where the group has one factor."""
    w = Window.partitionBy(*keys)
    n, p = F.count(pred).over(w), F.col(pred)
    high, low = F.percentile(pred, F.lit(1 - share)).over(w), F.percentile(pred, F.lit(share)).over(w)
    alone = F.when(p > single, "max").when(p < -single, "min")
    out = df.withColumn("__alone", F.when(n == 1, alone)).withColumn("__many", F.when(n >= 2, F.when(p > high, "max").when(p < low, "min")))
    return out.withColumn("side", F.coalesce("__alone", "__many")).drop("__alone", "__many")


def one_per_subpillar(df: DataFrame, keys: list[str], subpillar: str = "subpillar", pred: str = "pred", name: str = "factor_name") -> DataFrame:
    """Per side and subpillar the best factor stays: the highest prediction of
    max, the lowest of min."""
    rank = F.when(F.col("side") == "max", -F.col(pred)).otherwise(F.col(pred))
    w = Window.partitionBy(*keys, "side", subpillar).orderBy(rank, name)
    return df.filter("side IS NOT NULL").withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def accuracy(pred: str = "pred", actual: str = "actual", swapped: bool = True) -> list[Column]:
    """Aggregates mae, mse and r2 of complete rows, null under two of them.

    ``swapped`` takes the prediction as the truth in r2, as group evaluation
    does; model metrics take the actual value.
    """
    both = F.col(pred).isNotNull() & F.col(actual).isNotNull()
    d = F.when(both, F.col(pred) - F.col(actual))
    truth = F.when(both, F.col(pred if swapped else actual))
    enough = F.count(d) > 1
    r2 = 1 - ratio(F.sum(d * d), F.var_pop(truth) * F.count(truth))
    return [F.when(enough, F.avg(F.abs(d))).alias("mae"), F.when(enough, F.avg(d * d)).alias("mse"), F.when(enough, r2).alias("r2")]


def group_summary(df: DataFrame, picked: DataFrame, keys: list[str]) -> DataFrame:
    """One row per configuration: picked factors as lists and maps, mean
    returns of both sides, accuracy over all factors."""
    side = lambda s: picked.filter(F.col("side") == s).groupBy(*keys)
    out = df.groupBy(*keys).agg(F.avg("actual").alias("actual"), *accuracy())
    for s in ("max", "min"):
        part = side(s).agg(
            F.sort_array(F.collect_list("factor_name")).alias(f"{s}_factor"),
            to_map("factor_name", "pred").alias(f"{s}_factor_pred"),
            to_map("factor_name", "actual").alias(f"{s}_factor_actual"),
            F.avg("actual").alias(f"{s}_ret"),
        )
        out = out.join(part, keys, "left")
    return out


def combine_pillars(df: DataFrame, keys: list[str]) -> DataFrame:
    """Across pillars: lists joined, returns averaged, with net and average
    return of each row."""
    net = F.col("max_ret") - F.col("min_ret")
    rows = df.withColumn("net_ret", net).withColumn("avg_ret", (F.col("max_ret") + F.col("net_ret")) / 2)
    lists = [concat_lists(c).alias(c) for c in ("max_factor", "min_factor")]
    return rows.groupBy(*keys).agg(*lists, *[F.avg(c).alias(c) for c in ("max_ret", "min_ret", "net_ret", "avg_ret")])


def past_mean(metric: str, config: list[str], period: str, n: int) -> Column:
    """Mean of the metric over the n previous periods; null if fewer."""
    w = Window.partitionBy(*config).orderBy(period).rowsBetween(-n, -1)
    return F.when(F.count(metric).over(w) == n, F.avg(metric).over(w))


def top_configs(df: DataFrame, group: list[str], config: list[str], period: str, metric: str, n: int, share: float) -> DataFrame:
    """Configurations whose past mean reaches the quantile 1 - ``share`` of the
    group and period."""
    out = df.withColumn("past", past_mean(metric, [*group, *config], period, n))
    limit = F.percentile("past", F.lit(1 - share)).over(Window.partitionBy(*group, period))
    return out.withColumn("__t", limit).filter(F.col("past") >= F.col("__t")).drop("__t")


#: Shares of configurations that a vote tries, in this order.
SHARES = [0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1, 0.0]


def vote(df: DataFrame, keys: list[str], names: str, least: float = 0.33, extra: float = 0.9) -> DataFrame:
    """Factors that enough configurations picked.

    The first share is taken at which at least ``least`` of the distinct
    factors stay; ``is_extra`` marks those in ``extra`` of the configurations.
    """
    total = df.groupBy(*keys).agg(F.count("*").alias("configs"))
    count = df.select(*keys, F.explode(F.col(names)).alias("factor")).groupBy(*keys, "factor").agg(F.count("*").alias("votes"))
    voted = count.join(total, keys)
    tried = voted.withColumn("share", F.explode(F.array(*map(F.lit, SHARES))))
    stays = (F.col("votes") >= F.col("share") * F.col("configs")).cast("int")
    valid = tried.groupBy(*keys, "share").agg(F.sum(stays).alias("kept"), F.count("*").alias("all"))
    valid = valid.filter(F.col("kept") >= least * F.col("all")).groupBy(*keys).agg(F.max("share").alias("share"))
    out = voted.join(valid, keys).filter(F.col("votes") >= F.col("share") * F.col("configs"))
    return out.withColumn("is_extra", F.col("votes") >= extra * F.col("configs"))


def latest(df: DataFrame, keys: list[str], day: str) -> DataFrame:
    """Rows of each key's last day."""
    last = F.max(day).over(Window.partitionBy(*keys))
    return df.withColumn("__last", last).filter(F.col(day) == F.col("__last")).drop("__last")


def top_with_ties(df: DataFrame, keys: list[str], score: str, n: int) -> DataFrame:
    """The n largest, or for a negative n the smallest, with all ties."""
    order = F.col(score).desc_nulls_last() if n > 0 else F.col(score).asc_nulls_last()
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("__r", F.rank().over(w)).filter(F.col("__r") <= abs(n)).drop("__r")


def place(keys: list[str], order: Column, count: str = "n") -> Column:
    """The rank of a value that ``count`` rows of the group have."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(count).over(before), F.lit(0)) + 1


def portfolio_stats(df: DataFrame, keys: list[str], sizes: list[int], score: str, ret: str, industry: str, ticker: str) -> DataFrame:
    """For each size in ``sizes`` (negative: from the bottom) the portfolio's
    count, mean return, share of winners, most frequent industry and members,
    beside those of all rows."""
    # the last scores that a portfolio takes, and the market, from scores counted once;
    # only rows from these scores on are ranked, and none of them loses one before it
    w, won = Window.partitionBy(*keys), (F.col(ret) > 0).cast("double")
    down, up = F.col(score).desc_nulls_last(), F.col(score).asc_nulls_last()
    counted = cells(df.withColumn("__won", won), keys, score, sum=ret, won="__won").withColumns({"__top": place(keys, down), "__low": place(keys, up)})
    high, low = (F.col(c) <= max([0, *n]) for c, n in (("__top", sizes), ("__low", [-n for n in sizes])))
    limits = counted.groupBy(*keys).agg(
        F.min(F.when(high, F.col(score))).alias("__high"), F.max(F.when(low, F.col(score))).alias("__lowest"),
        F.max((high | low) & F.col(score).isNull()).alias("__all"),
        ratio(F.sum("sum"), F.sum("sum_n")).alias("bm_ret"), ratio(F.sum("won"), F.sum("won_n")).alias("bm_pos_pct"),
    )
    limits, pairs = renamed(settle(limits, "limits"), keys)
    near = (F.col(score) >= F.col("__high")) | (F.col(score) <= F.col("__lowest")) | F.col("__all")
    ranked = df.join(limits, same(pairs)).filter(near).select(
        *keys, score, ret, industry, ticker, "bm_ret", "bm_pos_pct", F.rank().over(w.orderBy(down)).alias("__top"), F.rank().over(w.orderBy(up)).alias("__low")
    )
    n = F.col("top_n")
    member = lambda n: F.when(n > 0, F.col("__top") <= n).otherwise(F.col("__low") <= -n)
    ranked = ranked.withColumn("top_n", F.explode(F.filter(F.array(*map(F.lit, sizes)), member)))
    # by industry first, for the most frequent one (ties to the smallest)
    parts = ranked.groupBy(*keys, n, industry).agg(
        F.count("*").alias("c"), F.sum(ret).alias("__sum"), F.count(ret).alias("__n"), F.sum(won).alias("__won"),
        F.collect_list(ticker).alias("tickers"), F.first("bm_ret").alias("bm_ret"), F.first("bm_pos_pct").alias("bm_pos_pct"),
    )
    best = F.min(F.when(F.col(industry).isNotNull(), F.struct((-F.col("c")).alias("c"), F.col(industry).alias("mode"))))
    stats = parts.groupBy(*keys, n).agg(
        F.sum("c").alias("ticker_count"), ratio(F.sum("__sum"), F.sum("__n")).alias("ret"), ratio(F.sum("__won"), F.sum("__n")).alias("pos_pct"),
        F.sort_array(F.flatten(F.collect_list("tickers"))).alias("tickers"), best.alias("__m"),
        F.first("bm_ret").alias("bm_ret"), F.first("bm_pos_pct").alias("bm_pos_pct"),
    )
    return stats.withColumns({"mode": F.col("__m.mode"), "mode_count": -F.col("__m.c")}).drop("__m")


def percent_rank(column: str, keys: list[str]) -> Column:
    """Average rank over the largest rank of the group."""
    w = Window.partitionBy(*keys)
    ties = F.count(column).over(Window.partitionBy(*keys, column))
    rank = F.rank().over(w.orderBy(F.col(column).asc_nulls_last())) + (ties - 1) / 2
    return F.when(F.col(column).isNotNull(), rank / F.count(column).over(w))


def sharpe(ret: str) -> Column:
    """Mean over sample deviation, as an aggregate."""
    return ratio(F.avg(ret), F.stddev_samp(ret))


def against_benchmark(ret: str, benchmark: str, own_mean: bool = False) -> list[Column]:
    """Sharpe and Sortino ratios of the excess return, its 5 and 10 %
    quantiles and least; ``own_mean`` takes the mean of the return above."""
    e = F.col(ret) - F.col(benchmark)
    top = F.avg(ret) if own_mean else F.avg(e)
    return [
        ratio(top, F.sqrt(F.avg(e * e))).alias("sharpe"),
        ratio(top, F.sqrt(F.avg(F.pow(F.least(e, F.lit(0.0)), 2)))).alias("sortino"),
        F.percentile(e, F.lit(0.05)).alias("q05"),
        F.percentile(e, F.lit(0.10)).alias("q10"),
        F.min(e).alias("least"),
    ]
