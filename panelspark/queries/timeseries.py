"""Queries of the calendar and time-series operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import next_quarter_end, previous_quarter_end, ratio
from ..operators import calendar as cal
from ..operators.clean import every_weeks, on_weekday
from ..plans.jobs import last_weeks
from ..sources.scans import table
from . import query
from .proxies import DAILY, FILLED, LONG, MONTHLY, WEEKLY, daily, filled, long_events, monthly_orders, parts, rounded, ship_days, week_rows, weekly


@query(f"WITH {FILLED} SELECT key, day, px, vol FROM filled")
def t1_calendar_ffill(spark, d):
    return filled(spark, d)


@query(f"""WITH {DAILY}, days AS (
  SELECT CAST(unnest(generate_series(min(day), max(day) + INTERVAL 7 DAY, INTERVAL 1 DAY)) AS DATE) AS day FROM daily)
SELECT k.key, days.day, d.px FROM (SELECT DISTINCT key FROM daily) k CROSS JOIN days
LEFT JOIN daily d ON d.key = k.key AND d.day = days.day WHERE dayofweek(days.day) BETWEEN 1 AND 5""")
def t2_business_fill(spark, d):
    return cal.calendar_fill(daily(spark, d).select("key", "day", "px"), ["key"], "day", after=7, business=True)


@query(f"""WITH {LONG}, mondays AS (SELECT DISTINCT CAST(date_trunc('week', day) + INTERVAL 7 DAY AS DATE) AS day FROM long),
ev AS (SELECT key, day, max(CASE WHEN field = 'view' THEN value END) AS v, max(CASE WHEN field = 'error' THEN value END) AS e
       FROM long GROUP BY 1, 2),
g AS (SELECT key, m.day FROM (SELECT DISTINCT key FROM long), mondays m)
SELECT g.key, g.day,
  (SELECT arg_max(v, ev.day) FROM ev WHERE ev.key = g.key AND ev.day <= g.day AND v IS NOT NULL) AS view,
  (SELECT arg_max(e, ev.day) FROM ev WHERE ev.key = g.key AND ev.day <= g.day AND e IS NOT NULL) AS error
FROM g""")
def t3_as_of_join(spark, d):
    from ..operators.reshape import to_wide

    rows = long_events(spark, d)
    events = to_wide(rows, ["key", "day"], ["view", "error"])
    days = rows.select(F.date_add(F.to_date(F.date_trunc("week", "day")), 7).alias("day")).distinct()
    grid = rows.select("key").distinct().crossJoin(F.broadcast(days))  # a calendar
    return cal.as_of(grid, events, ["key"], "day", ["view", "error"])


@query(f"""WITH {DAILY}, a AS (SELECT key, arg_max(px, day) AS anchor FROM daily GROUP BY 1)
SELECT d.key, day, round(vol / nullif(anchor, 0) * px, 6) AS mcap FROM daily d JOIN a ON a.key = d.key""")
def t5_rescale_by_level(spark, d):
    out = daily(spark, d).select("key", "day", cal.rescale_by_last("vol", "px", ["key"], "day").alias("mcap"))
    return rounded(out, "mcap")


@query(f"""WITH {FILLED}, s AS (
  SELECT key, day, avg(px) OVER (PARTITION BY key ORDER BY day ROWS 6 PRECEDING) AS s FROM filled)
SELECT key, day, round(s / nullif(avg(s) OVER (PARTITION BY key ORDER BY day ROWS 90 PRECEDING), 0), 6) AS volume_ratio FROM s""")
def t6_volume_ratio(spark, d):
    return rounded(cal.volume_ratio(filled(spark, d), ["key"], "day", "px").select("key", "day", "volume_ratio"), "volume_ratio")


@query(f"""WITH {FILLED}
SELECT key, day, round(avg(px) OVER (PARTITION BY key ORDER BY day ROWS 6 PRECEDING) / px, 6) AS back7,
  round(CASE WHEN count(*) OVER (PARTITION BY key ORDER BY day ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING) = 7
        THEN avg(px) OVER (PARTITION BY key ORDER BY day ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING) END / px, 6) AS ahead7,
  round(CASE WHEN count(*) OVER (PARTITION BY key ORDER BY day ROWS BETWEEN CURRENT ROW AND 27 FOLLOWING) = 28
        THEN avg(px) OVER (PARTITION BY key ORDER BY day ROWS BETWEEN CURRENT ROW AND 27 FOLLOWING) END / px, 6) AS ahead28
FROM filled""")
def t7_rolling_levels(spark, d):
    level = lambda n: F.round(cal.rolling_level("px", ["key"], "day", n) / F.col("px"), 6)
    return filled(spark, d).select("key", "day", level(7).alias("back7"), level(-7).alias("ahead7"), level(-28).alias("ahead28"))


@query(f"""WITH {WEEKLY}
SELECT key, week, round(pow(lead(px, 2) OVER w / nullif(px, 0), 2.0) - 1, 6) AS y2, round(lead(px, 4) OVER w / nullif(px, 0) - 1, 6) AS y4,
  round(pow(lead(px, 26) OVER w / nullif(px, 0), 4.0 / 26) - 1, 6) AS y26
FROM weekly WINDOW w AS (PARTITION BY key ORDER BY week)""")
def t8_forward_returns(spark, d):
    y = lambda n: F.round(cal.forward_return("px", ["key"], "week", n), 6).alias(f"y{n}")
    return weekly(spark, d).select("key", "week", y(2), y(4), y(26))


@query(f"""WITH {WEEKLY}
SELECT key, week, round(px / nullif(lag(px, 1) OVER w, 0) - 1, 6) AS ww1_0, round(lag(px, 2) OVER w / nullif(lag(px, 4) OVER w, 0) - 1, 6) AS ww4_2,
  round(lag(px, 8) OVER w / nullif(lag(px, 26) OVER w, 0) - 1, 6) AS r6_2, round(lag(px, 30) OVER w / nullif(lag(px, 52) OVER w, 0) - 1, 6) AS r12_7
FROM weekly WINDOW w AS (PARTITION BY key ORDER BY week)""")
def t9_past_returns(spark, d):
    r = lambda a, b: F.round(cal.past_return("px", ["key"], "week", a, b), 6)
    return weekly(spark, d).select(
        "key", "week", r(0, 1).alias("ww1_0"), r(2, 4).alias("ww4_2"), r(8, 26).alias("r6_2"), r(30, 52).alias("r12_7")
    )


@query(f"""WITH {DAILY}, t AS (
  SELECT key, day, ln(hi / cl) * ln(hi / op) + ln(lo / cl) * ln(lo / op) AS t, row_number() OVER (PARTITION BY key ORDER BY day) AS rn FROM daily)
SELECT key, day, CASE WHEN rn >= 30 THEN round(sqrt(greatest(avg(t) OVER (PARTITION BY key ORDER BY day ROWS 29 PRECEDING), 0) * 256), 5) END AS volatility FROM t""")
def t10_range_volatility(spark, d):
    panel = daily(spark, d).withColumnsRenamed({"op": "open", "hi": "high", "lo": "low", "cl": "close"})
    out = cal.range_volatility(panel, ["key"], "day").select("key", "day", "volatility")
    return rounded(out, "volatility", digits=5)


@query(f"""WITH {WEEKLY}, r AS (
  SELECT key, week, px / nullif(lag(px) OVER w, 0) - 1 AS r, row_number() OVER w AS rn FROM weekly WINDOW w AS (PARTITION BY key ORDER BY week)),
s AS (SELECT key, week, rn, list(r) OVER (PARTITION BY key ORDER BY week ROWS 51 PRECEDING) AS x FROM r),
m AS (SELECT key, week, rn, list_filter(x, lambda v: v IS NOT NULL) AS x FROM s),
c AS (SELECT *, len(x) AS n, list_avg(x) AS mean FROM m),
k AS (SELECT *, list_avg(list_transform(x, lambda v: (v - mean) * (v - mean))) AS m2, list_avg(list_transform(x, lambda v: (v - mean) * (v - mean) * (v - mean))) AS m3 FROM c)
SELECT key, week, CASE WHEN rn >= 52 AND n >= 3 AND list_max(x) > list_min(x) THEN round(m3 / pow(m2, 1.5) * sqrt(n * (n - 1)) / (n - 2), 4) END AS skew FROM k""")
def t11_rolling_skewness(spark, d):
    days = ship_days(spark, d, "week", "week")
    runs = cal.carried_skewness(week_rows(spark, d), parts(spark, d).select("key"), "key", "week", "px", 52, step=7, days=days)
    return cal.run_days(runs.withColumn("skew", F.round("skew", 4)), "week", 7).select("key", "week", "skew")


@query(f"""WITH {MONTHLY}, m AS (SELECT *, avg(value) OVER (PARTITION BY field) > 80 AS large FROM monthly),
j AS (SELECT m.field, m.day, m.value, m.large, b.value AS before FROM m LEFT JOIN monthly b ON b.field = m.field AND b.day + INTERVAL 12 MONTH = m.day),
f AS (SELECT *, last_value(before IGNORE NULLS) OVER (PARTITION BY field ORDER BY day ROWS UNBOUNDED PRECEDING) AS b FROM j)
SELECT field, day, round(CASE WHEN large THEN value / nullif(b, 0) - 1 ELSE value END, 6) AS value FROM f""")
def t12_year_over_year(spark, d):
    return rounded(cal.year_over_year(monthly_orders(spark, d), "field", "day", "value"), "value")


@query("""WITH p AS (SELECT CAST(DATE '2001-10-28' - INTERVAL 4 WEEK - CAST(4 * i AS INTEGER) * INTERVAL 1 WEEK AS DATE) AS testing_period FROM range(24) t(i))
SELECT p.testing_period, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM p
JOIN orders ON CAST(o_orderdate AS DATE) <= p.testing_period AND CAST(o_orderdate AS DATE) > CAST(p.testing_period - INTERVAL 4 WEEK AS DATE) GROUP BY 1""")
def t13_period_grid(spark, d):
    """Orders of each testing period; periods divide the days evenly, so the
    period of an order is computed, not searched."""
    grid = cal.period_grid(spark, "2001-11-01", 4, 24)
    last = grid.agg(F.max("testing_period").alias("last"))
    o = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day"), "o_totalprice").crossJoin(F.broadcast(last))  # one row
    o = o.withColumn("testing_period", F.date_sub("last", (F.floor(F.datediff("last", "day") / 28) * 28).cast("int")))
    return o.join(grid, "testing_period").groupBy("testing_period").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(f"""WITH {MONTHLY}, g AS (SELECT CAST(unnest(generate_series(DATE '1996-01-07', DATE '2001-06-24', INTERVAL 28 DAY)) AS DATE) AS day)
SELECT f.field, g.day, (SELECT arg_max(value, m.day) FROM monthly m WHERE m.field = f.field AND CAST(m.day - INTERVAL 28 DAY AS DATE) <= g.day) AS value
FROM (SELECT DISTINCT field FROM monthly) f, g""")
def t15_macro_to_periods(spark, d):
    macro = cal.shift_days(monthly_orders(spark, d), "day", -28)
    days = F.sequence(F.lit("1996-01-07").cast("date"), F.lit("2001-06-24").cast("date"), F.expr("INTERVAL 28 DAY"))
    grid = macro.select("field").distinct().withColumn("day", F.explode(days))
    return cal.as_of(grid, macro, ["field"], "day", ["value"])


@query("""WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, 1 + CAST(o_custkey % 12 AS INTEGER) AS m FROM orders),
e AS (SELECT o_orderkey, day, last_day(CAST(last_day(make_date(year(day) - 1, m, 1)) + (3 * CAST(ceil(month(day) / 3.0) AS INTEGER)) * INTERVAL 1 MONTH AS DATE)) AS period_end FROM o),
q AS (SELECT *, last_day(CAST(date_trunc('quarter', period_end) + INTERVAL 2 MONTH AS DATE)) AS qe, CASE WHEN o_orderkey % 3 = 0 THEN day END AS report FROM e),
a AS (SELECT *, coalesce(report, CASE WHEN qe > period_end THEN qe ELSE last_day(CAST(date_trunc('quarter', period_end) + INTERVAL 5 MONTH AS DATE)) END) AS d0 FROM q)
SELECT o_orderkey, period_end, CASE WHEN d0 < period_end THEN CAST(date_trunc('quarter', d0) - INTERVAL 1 DAY AS DATE) ELSE d0 END AS available FROM a""")
def t17_t18_fiscal_dates(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"), (1 + F.col("o_custkey") % 12).cast("int").alias("m"))
    o = o.withColumn("period_end", cal.fiscal_period_end(F.col("day"), F.col("m")))
    report = F.when(F.col("o_orderkey") % 3 == 0, F.col("day"))
    return o.select("o_orderkey", "period_end", cal.available_day(report, F.col("period_end")).alias("available"))


@query("""SELECT o_orderkey, CASE WHEN qe > day THEN qe ELSE last_day(CAST(date_trunc('quarter', day) + INTERVAL 5 MONTH AS DATE)) END AS next_end,
  CAST(date_trunc('quarter', day) - INTERVAL 1 DAY AS DATE) AS last_end
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, last_day(CAST(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH AS DATE)) AS qe FROM orders)""")
def f6_quarter_ends(spark, d):
    day = F.to_date("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", next_quarter_end(day).alias("next_end"), previous_quarter_end(day).alias("last_end"))


@query(f"""WITH {FILLED} SELECT key, day, round(lead(px, 7) OVER w / nullif(px, 0) - 1, 6) AS r7, round(lead(px, 28) OVER w / nullif(px, 0) - 1, 6) AS r28
FROM filled WINDOW w AS (PARTITION BY key ORDER BY day)""")
def t21_simple_forward_returns(spark, d):
    w = cal.over(["key"], "day")
    r = lambda n: F.round(ratio(F.lead("px", n).over(w), F.col("px")) - 1, 6).alias(f"r{n}")
    return filled(spark, d).select("key", "day", r(7), r(28))


@query(f"""WITH {FILLED}, b AS (SELECT * FROM filled WHERE dayofweek(day) BETWEEN 1 AND 5),
l AS (SELECT key, day, ln(px / nullif(lag(px) OVER (PARTITION BY key ORDER BY day), 0)) AS l FROM b),
s AS (SELECT key, day, sum(l) OVER (PARTITION BY key ORDER BY day ROWS 19 PRECEDING) AS s FROM l),
h AS (SELECT key, day, exp(lead(s, 20) OVER (PARTITION BY key ORDER BY day) / 1.0) - 1 AS h FROM s)
SELECT key, day, round(h, 6) AS holding, round(avg(h) OVER (PARTITION BY key ORDER BY day RANGE BETWEEN CURRENT ROW AND INTERVAL 6 DAY FOLLOWING), 6) AS holding_7d FROM h""")
def t22_holding_return(spark, d):
    panel = filled(spark, d).filter(F.dayofweek("day").between(2, 6))
    out = cal.holding_return(panel, ["key"], "day", "px", 4).select("key", "day", "holding", "holding_7d")
    return rounded(out, "holding", "holding_7d")


@query(f"""WITH {FILLED}, r AS (SELECT key, day, px / nullif(lag(px, 7) OVER w, 0) - 1 AS w1, lag(px, 7) OVER w / nullif(lag(px, 14) OVER w, 0) - 1 AS w2,
  lag(px, 14) OVER w / nullif(lag(px, 21) OVER w, 0) - 1 AS w3, lag(px, 21) OVER w / nullif(lag(px, 28) OVER w, 0) - 1 AS w4,
  row_number() OVER (PARTITION BY key ORDER BY day DESC) AS rn FROM filled WINDOW w AS (PARTITION BY key ORDER BY day))
SELECT key, day, round(w1, 6) AS w1, round(w2, 6) AS w2, round(w3, 6) AS w3, round(w4, 6) AS w4 FROM r WHERE rn = 1""")
def t23_last_weeks(spark, d):
    return rounded(last_weeks(filled(spark, d), "key", "day", "px"), "w1", "w2", "w3", "w4")


@query(f"""WITH {MONTHLY}, x AS (SELECT field, day, value, lag(value, 1) OVER w AS x1, lag(value, 2) OVER w AS x2, lag(value, 3) OVER w AS x3
  FROM monthly WINDOW w AS (PARTITION BY field ORDER BY day)),
c AS (SELECT field, count(value) AS n, corr(value, x1) AS c1, corr(value, x2) AS c2, corr(value, x3) AS c3 FROM x GROUP BY 1)
SELECT field, n, CASE WHEN abs(c1) >= 1.96 / sqrt(n) THEN round(c1, 6) END AS lag_1, CASE WHEN abs(c2) >= 1.96 / sqrt(n) THEN round(c2, 6) END AS lag_2,
  CASE WHEN abs(c3) >= 1.96 / sqrt(n) THEN round(c3, 6) END AS lag_3 FROM c""")
def t24_t25_autocorrelation(spark, d):
    return rounded(cal.autocorrelation(monthly_orders(spark, d), ["field"], "day", "value", 3), "lag_1", "lag_2", "lag_3")


@query(f"""WITH {FILLED}, v AS (SELECT key, day, px, avg(vol) OVER (PARTITION BY key ORDER BY day ROWS 6 PRECEDING) AS v7, avg(vol) OVER (PARTITION BY key ORDER BY day ROWS 60 PRECEDING) AS v61,
  avg(vol) OVER (PARTITION BY key ORDER BY day ROWS 90 PRECEDING) AS v91, lead(px, 10) OVER w / nullif(px, 0) - 1 AS r10, lead(px, 20) OVER w / nullif(px, 0) - 1 AS r20
  FROM filled WINDOW w AS (PARTITION BY key ORDER BY day))
SELECT key, round(corr(v7 / nullif(v91, 0), r10), 5) AS corr_7_10, round(corr(v7 / nullif(v91, 0), r20), 5) AS corr_7_20,
  round(corr(v61 / nullif(v91, 0), r10), 5) AS corr_61_10, round(corr(v61 / nullif(v91, 0), r20), 5) AS corr_61_20 FROM v GROUP BY 1""")
def t26_volume_correlation(spark, d):
    out = cal.volume_horizons(filled(spark, d), ["key"], "day", "vol", "px").select("key", "corr_7_10", "corr_7_20", "corr_61_10", "corr_61_20")
    return rounded(out, "corr_7_10", "corr_7_20", "corr_61_10", "corr_61_20", digits=5)


@query(f"""WITH {MONTHLY}, r AS (SELECT field, day, value / nullif(lag(value) OVER (PARTITION BY field ORDER BY day), 0) - 1 AS r FROM monthly),
c AS (SELECT field, day, min(r) OVER w AS least, sum(ln(1 + coalesce(r, 0))) OVER w AS s FROM r WINDOW w AS (PARTITION BY field ORDER BY day ROWS UNBOUNDED PRECEDING))
SELECT field, day, CASE WHEN least > -1 THEN round(exp(s), 6) END AS level FROM c""")
def t27_cumulative_return(spark, d):
    m = monthly_orders(spark, d)
    m = m.withColumn("r", ratio(F.col("value"), F.lag("value").over(cal.over(["field"], "day"))) - 1)
    return m.select("field", "day", F.round(cal.cumulative_return("r", ["field"], "day"), 6).alias("level"))


@query(f"""WITH {DAILY} SELECT key, day, px FROM daily WHERE dayofweek(day) = 0 AND date_diff('day', day, DATE '2001-10-28') % 28 = 0 AND day <= DATE '2001-10-28'""")
def p4_p5_every_four_weeks(spark, d):
    rows = on_weekday(daily(spark, d).select("key", "day", "px"), "day")
    return every_weeks(rows, "day", 4, "2001-11-01")
