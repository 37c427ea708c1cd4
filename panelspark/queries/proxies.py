"""Panels made of the given tables, for Spark and as SQL.

Suppliers stand for daily tickers, parts for weekly ones, part types and order
priorities for groups, events for a long table, embeddings for factors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.calendar import calendar_carry
from ..sources.scans import table

def unit_price():
    return F.col("l_extendedprice") / F.col("l_quantity")


def daily(spark: SparkSession, d: str) -> DataFrame:
    """key, day, px, vol, op, hi, lo, cl per supplier and ship day. Rows lie by key, so
    what groups by key and more, or looks along it, moves none."""
    order = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    rows = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("key"), F.to_date("l_shipdate").alias("day"), unit_price().alias("p"), "l_quantity", order.alias("o")
    ).repartition("key")
    return rows.groupBy("key", "day").agg(
        F.max("p").alias("px"), F.sum("l_quantity").alias("vol"), F.min_by("p", "o").alias("op"),
        F.max("p").alias("hi"), F.min("p").alias("lo"), F.max_by("p", "o").alias("cl"),
    )


DAILY = """daily AS (
  SELECT l_suppkey AS key, CAST(l_shipdate AS DATE) AS day, max(l_extendedprice / l_quantity) AS px,
         sum(l_quantity) AS vol, arg_min(l_extendedprice / l_quantity, l_orderkey * 10 + l_linenumber) AS op,
         max(l_extendedprice / l_quantity) AS hi, min(l_extendedprice / l_quantity) AS lo,
         arg_max(l_extendedprice / l_quantity, l_orderkey * 10 + l_linenumber) AS cl
  FROM lineitem GROUP BY 1, 2)"""


def filled(spark: SparkSession, d: str) -> DataFrame:
    """Daily panel on every day, with px, vol forward-filled."""
    return calendar_carry(daily(spark, d), ["key"], "day", ["px", "vol"])


FILLED = (
    DAILY
    + """,
days AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM daily),
grid AS (SELECT key, days.day FROM (SELECT DISTINCT key FROM daily), days),
filled AS (
  SELECT g.key, g.day, last_value(px IGNORE NULLS) OVER w AS px, last_value(vol IGNORE NULLS) OVER w AS vol
  FROM grid g LEFT JOIN daily d ON g.key = d.key AND g.day = d.day
  WINDOW w AS (PARTITION BY g.key ORDER BY g.day ROWS UNBOUNDED PRECEDING))"""
)


def weekly(spark: SparkSession, d: str) -> DataFrame:
    """key, week, px, grp, brand per part on every week (Monday), px forward-filled."""
    return calendar_carry(week_prices(spark, d), ["key"], "week", ["px"], step=7).join(parts(spark, d), "key")


def week_rows(spark: SparkSession, d: str) -> DataFrame:
    """key, week, px: the part, week and unit price of each row."""
    return table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("key"), F.to_date(F.date_trunc("week", "l_shipdate")).alias("week"), unit_price().alias("px")
    )


def week_prices(spark: SparkSession, d: str) -> DataFrame:
    """key, week, px: a part's largest unit price of a week. Rows lie by key."""
    return week_rows(spark, d).repartition("key").groupBy("key", "week").agg(F.max("px").alias("px"))


def ship_days(spark: SparkSession, d: str, part: str, name: str) -> DataFrame:
    """The first day of each row's ``part`` (day, week), as column ``name``; no shuffle."""
    return table(spark, d, "lineitem").select(F.to_date(F.date_trunc(part, "l_shipdate")).alias(name))


def parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_type").alias("grp"), F.col("p_brand").alias("brand"))


WEEKLY = """wk AS (
  SELECT l_partkey AS key, CAST(date_trunc('week', l_shipdate) AS DATE) AS week, max(l_extendedprice / l_quantity) AS px
  FROM lineitem GROUP BY 1, 2),
weeks AS (SELECT CAST(unnest(generate_series(min(week), max(week), INTERVAL 7 DAY)) AS DATE) AS week FROM wk),
wgrid AS (SELECT key, weeks.week FROM (SELECT DISTINCT key FROM wk), weeks),
weekly AS (
  SELECT g.key, g.week, last_value(px IGNORE NULLS) OVER (PARTITION BY g.key ORDER BY g.week ROWS UNBOUNDED PRECEDING) AS px,
         p_type AS grp, p_brand AS brand
  FROM wgrid g LEFT JOIN wk ON g.key = wk.key AND g.week = wk.week JOIN part ON p_partkey = g.key)"""


def long_events(spark: SparkSession, d: str) -> DataFrame:
    """key, day, field, value: largest event value per user, day and type."""
    return table(spark, d, "events").groupBy(
        F.col("user_id").alias("key"), F.to_date("ts").alias("day"), F.col("event_type").alias("field")
    ).agg(F.max("value").alias("value"))


LONG = """long AS (
  SELECT user_id AS key, CAST(ts AS DATE) AS day, event_type AS field, max(value) AS value
  FROM events GROUP BY 1, 2, 3)"""


def monthly_orders(spark: SparkSession, d: str) -> DataFrame:
    """field, day (first of month), value: mean order price by priority."""
    o = table(spark, d, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("field"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("day")).agg(
        F.round(F.avg("o_totalprice"), 4).alias("value")
    )


MONTHLY = """monthly AS (
  SELECT o_orderpriority AS field, CAST(date_trunc('month', o_orderdate) AS DATE) AS day, round(avg(o_totalprice), 4) AS value
  FROM orders GROUP BY 1, 2)"""


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})
