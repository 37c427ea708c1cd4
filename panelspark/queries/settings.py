"""Queries of scans of settings, configurations and earlier results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import models, training
from ..sources import scans
from ..sources.scans import table
from . import query
from .proxies import LONG, MONTHLY, WEEKLY, long_events, monthly_orders, weekly


@query(f"""WITH {LONG} SELECT key, day, max(CASE WHEN field = 'view' THEN value END) AS view, max(CASE WHEN field = 'click' THEN value END) AS click
FROM long WHERE field IN ('view', 'click') AND day >= DATE '2026-01-15' - 731 GROUP BY 1, 2""")
def s4_consensus_scan(spark, d):
    """Statement fields from the pre-roll on, none of them required."""
    rows = long_events(spark, d).withColumnsRenamed({"key": "ticker", "day": "trading_day"})
    return scans.statements(rows, ["view", "click"], "2026-01-15").withColumnsRenamed({"ticker": "key", "trading_day": "day"})


@query("""SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IS NOT NULL""")
def s5_attribute(spark, d):
    return scans.attribute(table(spark, d, "customer"), "c_mktsegment", "c_custkey")


@query("""SELECT DISTINCT p_type AS our_name FROM part WHERE p_size > 25""")
def s8_non_ratio_fields(spark, d):
    meta = table(spark, d, "part").select(F.col("p_type").alias("our_name"), (F.col("p_size") > 25).alias("non_ratio"))
    return scans.non_ratio_fields(meta)


@query(f"""WITH {LONG}, a AS (SELECT c_custkey AS key, c_mktsegment AS currency_code FROM customer WHERE c_acctbal > 0 AND c_mktsegment IN ('BUILDING', 'MACHINERY'))
SELECT l.key, day, currency_code, coalesce(max(CASE WHEN field = 'view' THEN value END), 0) AS view, coalesce(max(CASE WHEN field = 'click' THEN value END), 0) AS click
FROM long l JOIN a ON a.key = l.key WHERE field IN ('view', 'click') GROUP BY 1, 2, 3""")
def s12_factor_panel_filled(spark, d):
    """The panel that is clustered: missing ratios are zero."""
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("ticker"), F.col("c_mktsegment").alias("currency_code"), (F.col("c_acctbal") > 0).alias("is_active"))
    rows = long_events(spark, d).select(F.col("key").cast("string").alias("ticker"), F.col("day").alias("trading_day"), "field", "value")
    out = scans.factor_panel(rows, c, ["view", "click"], ["BUILDING", "MACHINERY"], fill=0.0)
    return out.select(F.col("ticker").cast("long").alias("key"), F.col("trading_day").alias("day"), "currency_code", "view", "click")


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderdate > TIMESTAMP '2000-01-01'""")
def s20_evaluation_results(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.col("o_orderpriority").alias("name_sql"), F.col("o_orderdate").alias("updated"))
    return scans.evaluation_results(rows, "1-URGENT").select("o_orderkey", "o_totalprice")


@query("""SELECT p_partkey, p_brand FROM part WHERE p_size = 4 AND p_type <> 'PROMO'""")
def s21_configs(spark, d):
    p = table(spark, d, "part").withColumns({"weeks_to_expire": F.col("p_size"), "id": (F.col("p_type") == "PROMO").cast("int")})
    return scans.configs(p, 4).select("p_partkey", "p_brand")


@query(f"""WITH {MONTHLY}, c AS (SELECT DISTINCT p_type AS pillar FROM part), f AS (SELECT p_type AS pillar, array_to_string(list_sort(list(DISTINCT p_brand)), ',') AS factors FROM part WHERE p_type <> 'PROMO' GROUP BY 1),
t AS (SELECT DISTINCT day AS testing_period FROM monthly ORDER BY 1 DESC LIMIT 3)
SELECT c.pillar, trees, testing_period, factors FROM c, (VALUES (10), (50)) o(trees), t LEFT JOIN f ON f.pillar = c.pillar WHERE NOT (c.pillar = 'ECONOMY' AND trees = 10)""")
def m12_j11_expand_configs(spark, d):
    """Options x pillars x the last periods with each pillar's factors, less what is done."""
    p = table(spark, d, "part").select(F.col("p_type").alias("pillar"), "p_brand")
    pillars = p.filter("pillar <> 'PROMO'").groupBy("pillar").agg(F.sort_array(F.collect_set("p_brand")).alias("factor_list"))
    options = training.option_grid(spark, {"trees": [10, 50]}).withColumn("trees", F.col("trees").cast("int"))
    periods = monthly_orders(spark, d).select(F.col("day").alias("testing_period")).distinct()
    done = options.filter("trees = 10").withColumn("pillar", F.lit("ECONOMY"))
    out = training.expand_configs(p.select("pillar").distinct(), options, periods, 3, pillars, done)
    return out.select("pillar", "trees", "testing_period", F.array_join("factor_list", ",").alias("factors"))


@query(f"""WITH {MONTHLY}, r AS (SELECT field, day, value / nullif(lag(value) OVER (PARTITION BY field ORDER BY day), 0) - 1 AS r FROM monthly),
m AS (SELECT field, k, day, r, CASE WHEN count(r) OVER w6 = 6 AND k = 6 THEN avg(r) OVER w6 WHEN count(r) OVER w12 = 12 AND k = 12 THEN avg(r) OVER w12 END AS u FROM r, (VALUES (6), (12)) v(k)
  WINDOW w6 AS (PARTITION BY field, k ORDER BY day ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), w12 AS (PARTITION BY field, k ORDER BY day ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)),
x AS (SELECT field, k, u > 0 AS p, r > 0 AS a, r FROM m WHERE u IS NOT NULL AND r IS NOT NULL)
SELECT field, k AS lookback, round(avg((p = a)::INT), 8) AS accuracy, round(sum((p AND a)::INT) / nullif(sum(p::INT), 0), 8) AS "precision", round(sum((p AND a)::INT) / nullif(sum(a::INT), 0), 8) AS recall,
  round(avg(CASE WHEN p THEN r END) - avg(CASE WHEN NOT p THEN r END), 8) AS avg_diff, round(avg(a::INT), 8) AS actual_up, round(avg(p::INT), 8) AS pred_up FROM x GROUP BY 1, 2""")
def m23_sign_backtest(spark, d):
    """Sign of the next return by the mean of the last ones, and how often it was right."""
    from ..operators.research import sign_backtest
    from .distribution import month_returns

    out = sign_backtest(month_returns(spark, d), ["field"], "day", "r", [6, 12])
    return out.select("field", "lookback", *[F.round(c, 8).alias(c) for c in ("accuracy", "precision", "recall", "avg_diff", "actual_up", "pred_up")])


@query(f"""WITH {WEEKLY} SELECT key, grp, count(*) AS n FROM weekly GROUP BY 1, 2""")
def m10_group_split(spark, d):
    """Whole keys validate: every row in one part, and no key in both."""
    parts = training.group_split(weekly(spark, d), ["key"], 0.3)
    return parts.groupBy("key", "grp").agg(F.count("*").alias("n"), F.count_distinct("part").alias("parts")).filter("parts = 1").drop("parts")


@query()
def m21_cluster_windows(spark, d):
    """Pillars of event types per segment and period, of the rows of a window before each."""
    from .shaping import wide

    c = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("currency_code"))
    panel = wide(spark, d).join(c, "key")
    periods = panel.select(F.to_date(F.date_trunc("week", "day")).alias("testing_period")).distinct()
    return models.cluster_windows(panel, periods, "currency_code", "day", ["view", "click", "purchase", "signup", "error"], 1, sub_at=1)
