"""Scans of panel tables. Filters and column lists reach the Parquet reader;
key lists are semi-joins, so no list grows on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import finite
from ..operators.calendar import calendar_carry
from ..operators.joins import left_all
from ..operators.reshape import to_wide

#: Days read before the first day asked for, so that windows are full.
PRE_ROLL_DAYS = 731


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def csv_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and a given schema (none is inferred)."""
    return spark.read.schema(schema).option("header", True).csv(path)


def window_of_days(df: DataFrame, day: str, start: str, pre_roll: int = PRE_ROLL_DAYS, end: str | None = None) -> DataFrame:
    """Rows from ``pre_roll`` days before ``start`` to ``end``."""
    out = df.filter(F.col(day) >= F.date_sub(F.lit(start).cast("date"), pre_roll))
    return out if end is None else out.filter(F.col(day) <= F.lit(end).cast("date"))


def prices(tri: DataFrame, ohlcv: DataFrame, universe: DataFrame, mktcap: DataFrame, start: str, tickers: DataFrame | None = None) -> DataFrame:
    """Return index with prices, static attributes and the latest market
    value, from the pre-roll on; raises when nothing is found."""
    base = window_of_days(tri, "trading_day", start)
    if tickers is not None:
        base = base.join(tickers, "ticker", "left_semi")
    out = left_all(base, (ohlcv, ["ticker", "trading_day"]), (universe.select("ticker", "currency_code"), ["ticker"]), (mktcap.withColumnRenamed("value", "market_cap"), ["ticker"]))
    if out.isEmpty():
        raise ValueError("no prices for these tickers and days")
    return out


def fx_rates(raw: DataFrame, base: str = "USD") -> DataFrame:
    """A rate for every currency and day: calendar-filled, forward-filled, and
    one for the base currency."""
    out = calendar_carry(raw, ["currency_code"], "trading_day", ["last_price"])
    rate = F.when(F.col("currency_code") == base, 1.0).otherwise(F.col("last_price"))
    return out.select("currency_code", "trading_day", rate.alias("fx_rate"))


def statements(eav: DataFrame, fields: list[str], start: str, required: str | None = None, tickers: DataFrame | None = None) -> DataFrame:
    """Wide (ticker, trading_day) table of a long one; a required field must
    occur."""
    rows = window_of_days(eav, "trading_day", start).filter(F.col("field").isin(fields))
    if tickers is not None:
        rows = rows.join(tickers, "ticker", "left_semi")
    if required and rows.filter(F.col("field") == required).isEmpty():
        raise ValueError(f"field {required} is missing")
    return to_wide(rows, ["ticker", "trading_day"], fields)


def attribute(universe: DataFrame, column: str, key: str = "ticker") -> DataFrame:
    return universe.select(key, column).filter(F.col(column).isNotNull())


def industry_code(code: Column, recode: dict[str, str]) -> Column:
    """"NA" is missing, some codes are replaced, six digits count."""
    text = F.nullif(code.cast("string"), F.lit("NA"))
    if recode:
        table = F.create_map(*[F.lit(x) for kv in recode.items() for x in kv])
        text = F.coalesce(F.try_element_at(table, text), text)
    return F.substring(text, 1, 6)


def industry_names(universe: DataFrame, codes: DataFrame) -> DataFrame:
    """ticker -> industry name by the eight-digit code."""
    named = codes.select(F.col("code_8").cast("string").alias("industry_code"), F.col("name_4").alias("industry"))
    return universe.join(named, "industry_code").select("ticker", "industry")


def active_formulas(formulas: DataFrame, names: list[str] | None = None, keep: bool | None = None) -> DataFrame:
    out = formulas.filter("is_active") if names is None else formulas.filter(F.col("name").isin(names))
    return out if keep is None else out.filter(F.col("keep") == keep)


def active_tickers(universe: DataFrame, currencies: list[str] | None = None, etf: bool | None = None) -> DataFrame:
    """One column of tickers, the right side of semi-joins."""
    out = universe.filter("is_active")
    if currencies:
        out = out.filter(F.col("currency_code").isin(currencies))
    if etf is not None:
        out = out.filter(F.col("is_etf") == etf)
    return out.select("ticker")


def factor_panel(ratios: DataFrame, universe: DataFrame, fields: list[str], currencies: list[str], start: str = "1998-01-01", end: str | None = None, fill: float | None = None) -> DataFrame:
    """Wide ratios of active tickers that aren't indices, with their currency."""
    rows = window_of_days(ratios, "trading_day", start, 0, end).filter(F.col("field").isin(fields) & ~F.col("ticker").startswith("."))
    active = universe.filter(F.col("is_active") & F.col("currency_code").isin(currencies)).select("ticker", "currency_code")
    return to_wide(rows.join(active, "ticker"), ["ticker", "trading_day", "currency_code"], fields, fill=fill)


def premium_matrix(premium: DataFrame, periods: DataFrame, groups: list[str], weeks: int, fields: list[str], trimmed: bool = False) -> DataFrame:
    """Wide premiums of the listed periods; raises when there are none."""
    is_trim = F.col("field").startswith("trim_")
    rows = premium.filter((F.col("weeks_to_expire") == weeks) & F.col("group").isin(groups) & (is_trim if trimmed else ~is_trim))
    rows = rows.join(periods, "testing_period", "left_semi")
    if rows.isEmpty():
        raise ValueError(f"no premiums for {groups}, {weeks} weeks")
    return to_wide(rows, ["group", "testing_period", "average_days"], fields)


def index_returns(df: DataFrame, tickers: list[str], fields: list[str]) -> DataFrame:
    """Long series named <field>_<ticker>."""
    rows = df.filter(F.col("ticker").isin(tickers) & F.col("field").isin(fields))
    return rows.select(F.concat_ws("_", "field", "ticker").alias("field"), "trading_day", finite(F.col("value")).alias("value"))


def named_series(df: DataFrame, value: str, field: str | Column, day: str = "trading_day") -> DataFrame:
    """A single series as rows (field, trading_day, value)."""
    name = F.lit(field) if isinstance(field, str) else field
    return df.select(name.alias("field"), F.col(day).alias("trading_day"), F.col(value).alias("value"))


def predictions(prediction: DataFrame, score: DataFrame, run: str, first_period: str, first_uid_day: int) -> DataFrame:
    """Predictions of one run; missing ones are zero."""
    runs = score.filter((F.col("name_sql") == run) & (F.col("testing_period") >= F.lit(first_period).cast("date")))
    runs = runs.filter(F.substring("uid", 1, 8).cast("int") >= first_uid_day)
    return prediction.join(runs, "uid").fillna(0.0, subset=["pred"])


def subpillars(clusters: DataFrame, first_period: str, weeks: int) -> DataFrame:
    rows = clusters.filter(F.col("pillar").startswith("subpillar_") & (F.col("weeks_to_expire") == weeks))
    return rows.filter(F.col("testing_period") >= F.lit(first_period).cast("date"))


def latest_run(score: DataFrame, weeks: int) -> DataFrame:
    """Name of the run with the largest uid of this horizon."""
    return score.filter(F.col("name_sql").startswith(f"w{weeks}_")).agg(F.max_by("name_sql", "uid").alias("name_sql"))


def restart_date(score: DataFrame, run: str) -> DataFrame:
    first = score.filter(F.col("name_sql") == run).agg(F.min("uid").alias("uid"))
    return first.select(F.to_date(F.substring("uid", 1, 8), "yyyyMMdd").alias("restart"))


def configs(df: DataFrame, weeks: int, id_: int = 0) -> DataFrame:
    out = df.filter((F.col("weeks_to_expire") == weeks) & (F.col("id") == id_))
    if out.isEmpty():
        raise ValueError(f"no configuration for {weeks} weeks")
    return out


def non_ratio_fields(fields: DataFrame, name: str = "our_name", flag: str = "non_ratio") -> DataFrame:
    """One column of the fields that hold amounts, which need conversion to a
    common currency; the right side of semi-joins."""
    return fields.filter(F.col(flag)).select(name).distinct()


def evaluation_results(df: DataFrame, run: str, since: str = "2000-01-01") -> DataFrame:
    """Evaluation rows of one run that were updated after ``since``."""
    return df.filter((F.col("name_sql") == run) & (F.col("updated") > F.lit(since).cast("timestamp")))


def weekday_ratings(ratings: DataFrame, universe: DataFrame, currencies: list[str], weekday: int = 2) -> DataFrame:
    """Ratings of active tickers on one weekday (2 is Monday)."""
    active = universe.filter(F.col("is_active") & F.col("currency_code").isin(currencies)).select("ticker", "currency_code")
    return ratings.filter(F.dayofweek("trading_day") == weekday).join(active, "ticker")
