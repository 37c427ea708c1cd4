"""Samples for models without leakage: windows, labels, splits, weights."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import ratio
from ..operators.buckets import bucket_median, fixed_cut, quantile_edges


def split_by_period(df: DataFrame, period: str, test_period: str, weeks: int, years: int = 21) -> tuple[DataFrame, DataFrame]:
    """Training rows end ``weeks`` before the test period and begin ``years``
    before it; test rows are those of the period."""
    test = F.lit(test_period).cast("date")
    start = F.add_months(test, -12 * years)
    return df.filter((F.col(period) <= F.date_sub(test, 7 * weeks)) & (F.col(period) >= start)), df.filter(F.col(period) == test)


def test_skeleton(groups: DataFrame, test: DataFrame, period: str, test_period: str) -> DataFrame:
    """Every group of the test period, with nulls where nothing is known."""
    keys = groups.distinct().withColumn(period, F.lit(test_period).cast("date"))
    return keys.join(test, keys.columns, "left")


def shift_labels(y: DataFrame, period: str, weeks: int) -> DataFrame:
    """Labels move back to the period they are predicted from."""
    return y.withColumn(period, F.date_sub(period, 7 * weeks))


def cut_labels(train: DataFrame, test: DataFrame, column: str, bins: int | list[float]) -> tuple[DataFrame, DataFrame]:
    """Bins of the training labels (quantiles, or given edges), applied to
    both; training labels become the median of their bin."""
    edges = bins if isinstance(bins, list) else quantile_edges(train, column, bins)
    a, b = (d.withColumn(f"{column}_bin", fixed_cut(column, edges)) for d in (train, test))
    return bucket_median(a, [f"{column}_bin"], column, f"{column}_cut"), b


def reversed_by_mean(train: DataFrame, field: str = "field", value: str = "value") -> DataFrame:
    """Fields with a negative mean in training."""
    return train.groupBy(field).agg(F.avg(value).alias("mean")).filter("mean < 0")


def reversed_by_rule(formulas: DataFrame, premium: DataFrame) -> DataFrame:
    """Fields to reverse by fixed rules: those that neither follow the rule with
    small minus big positive, nor go against it with it negative."""
    rows = premium.join(formulas.select("name", F.coalesce("smb_positive", F.lit(True)).alias("up")), "name")
    flag = F.when(F.col("up"), F.col("follow_heuristic")).otherwise(~F.col("follow_heuristic"))
    return rows.filter(~flag).select("name")


def validation_split(df: DataFrame, period: str, year: int, share: float, span_days: int) -> DataFrame:
    """Column ``part``: valid from January on for a share of the span, train up
    to half that length before it or after it, and null in the gap."""
    start, length = F.lit(f"{year}-01-01").cast("date"), round(share * span_days)
    end = F.date_add(start, length)
    p = F.col(period)
    train = (p < F.date_sub(start, length // 2)) | (p >= end)
    return df.withColumn("part", F.when((p >= start) & (p < end), "valid").when(train, "train"))


def chronological_split(df: DataFrame, period: str, share: float) -> DataFrame:
    """The last share of the periods validates."""
    cut = df.select(period).distinct().agg(F.percentile(F.unix_date(period), F.lit(1 - share)).alias("__c"))
    return df.join(F.broadcast(cut)).withColumn("part", F.when(F.unix_date(period) > F.col("__c"), "valid").otherwise("train")).drop("__c")  # one row


def group_split(df: DataFrame, keys: list[str], share: float) -> DataFrame:
    """Whole groups validate, chosen by their hash."""
    h = F.pmod(F.xxhash64(*keys), F.lit(10_000))
    return df.withColumn("part", F.when(h < int(share * 10_000), "valid").otherwise("train"))


def sample_weight(returns: list[str], down_share: float) -> Column:
    """``down_share`` where the row's mean return is negative, else the rest."""
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in returns), F.lit(0.0))
    n = sum((F.col(c).isNotNull().cast("int") for c in returns), F.lit(0))
    return F.when(total / F.nullif(n, F.lit(0)) < 0, down_share).otherwise(1 - down_share)


def ranged_weight(weight: Column, period: str, ranges: list[tuple[str, str, float]]) -> Column:
    """Weights multiplied within date ranges."""
    for a, b, factor in ranges:
        weight = weight * F.when(F.col(period).between(F.lit(a).cast("date"), F.lit(b).cast("date")), factor).otherwise(1.0)
    return weight


def option_grid(spark: SparkSession, options: dict[str, list]) -> DataFrame:
    """All combinations of option lists as rows."""
    rows = list(product(*options.values()))
    return spark.createDataFrame(rows, list(options))


def expand_configs(configs: DataFrame, options: DataFrame, periods: DataFrame, last: int, pillars: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """Options x configurations x the last periods, with each pillar's factors,
    less what a restart finds done."""
    recent = periods.orderBy(F.col("testing_period").desc()).limit(last)
    out = configs.crossJoin(F.broadcast(options)).crossJoin(F.broadcast(recent))  # parameter lists
    out = out.join(pillars.select("pillar", "factor_list"), "pillar", "left")
    return out if done is None else out.join(done, done.columns, "left_anti")


def rank_error(df: DataFrame, row: list[str], pred: str, actual: str, name: str) -> DataFrame:
    """Mean over a row's factors of the rank difference: absolute where the
    prediction ranks lower than the truth, squared where higher. Squares and their
    sum are whole numbers of any size: halves of 31 bits are added up."""
    from pyspark.sql import Window

    rank = lambda c: F.row_number().over(Window.partitionBy(*row).orderBy(c, name))
    d = (rank(actual) - rank(pred)).cast("long").alias("d")
    each = df.select(*row, d).select(F.when(F.col("d") > 0, F.col("d")).otherwise(F.col("d") * F.col("d")).alias("e"))
    sums = each.agg(F.sum(F.shiftright("e", 31)).alias("high"), F.sum(F.col("e").bitwiseAND(F.lit(2**31 - 1))).alias("low"), F.count("e").alias("n"))
    total = F.col("high").cast("decimal(19,0)") * F.lit(2**31).cast("decimal(10,0)") + F.col("low").cast("decimal(19,0)")
    return sums.select(ratio(total.cast("double"), F.col("n").cast("double")).alias("rank_error"))


def reverse_factors(train: DataFrame, mode: int, field: str = "field", value: str = "value", forecast: DataFrame | None = None, rules: DataFrame | None = None) -> DataFrame:
    """Names of the fields to reverse: 0 none, 1 negative training mean, 2
    negative forecast (field, prediction), 3 fixed rules (name)."""
    if mode == 0:
        return train.select(field).limit(0)
    if mode == 1:
        return reversed_by_mean(train, field, value).select(field)
    if mode == 2:
        return forecast.filter("prediction < 0").select(field).distinct()
    return rules.select(F.col("name").alias(field)).distinct()


def apply_reversal(df: DataFrame, names: DataFrame, field: str = "field", value: str = "value") -> DataFrame:
    """Values of the listed fields times -1."""
    flags = names.select(field, F.lit(True).alias("__r")).distinct()
    out = df.join(flags, field, "left")
    return out.withColumn(value, F.when(F.col("__r"), -F.col(value)).otherwise(F.col(value))).drop("__r")


def assemble_samples(x: DataFrame, y: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Features of the rows that have a label; a missing feature is an error."""
    out = x.join(y, keys)
    missing = F.lit(False)
    for c in columns:
        missing = missing | F.col(c).isNull()
    if not out.filter(missing).isEmpty():
        raise ValueError("samples with missing features")
    return out
