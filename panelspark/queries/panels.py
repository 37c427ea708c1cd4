"""Queries of whole jobs: premiums, ratios, selection, scores, portfolios."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio
from ..operators import calendar as cal
from ..operators.buckets import day_cells, premium_buckets, premium_of_cells
from ..operators.reshape import to_wide
from ..plans import jobs
from ..shipping import batches_by_rows
from ..sources.sinks import settle
from . import query
from .proxies import DAILY, WEEKLY, daily, parts, rounded, ship_days, week_prices, week_rows

RETURNS = """ret AS (
  SELECT key, week, grp, brand, px / nullif(lag(px, 4) OVER w, 0) - 1 AS factor, lead(px, 4) OVER w / nullif(px, 0) - 1 AS label
  FROM weekly WINDOW w AS (PARTITION BY key ORDER BY week))"""

BUCKETS = """x AS (SELECT grp, week, round(factor, 9) AS factor, round(label, 9) AS label FROM ret WHERE factor IS NOT NULL AND label IS NOT NULL),
q AS (SELECT grp, week, count(*) AS n, quantile_cont(factor, [0.0, 0.2, 0.3, 0.7, 0.8, 1.0]) AS q FROM x GROUP BY 1, 2),
e AS (SELECT grp, week, list_sort(list_distinct([q[1], CASE WHEN n > 65 THEN q[2] ELSE q[3] END, CASE WHEN n > 65 THEN q[5] ELSE q[4] END, q[6]])) AS e FROM q WHERE n >= 3),
b AS (SELECT x.*, CASE WHEN e IS NULL OR len(e) < 3 THEN NULL WHEN factor <= e[2] THEN 0 WHEN len(e) = 3 THEN 1 WHEN factor <= e[3] THEN 1 ELSE 2 END AS bucket
      FROM x LEFT JOIN e ON e.grp = x.grp AND e.week = x.week)"""


def return_runs(spark, d, digits=None):
    """Momentum of four weeks, where known, and the return of the next four, as runs of
    weeks; rounded if told."""
    runs = cal.carried_returns(week_prices(spark, d), ["key"], "week", "px", 4, step=7, days=ship_days(spark, d, "week", "week"))
    value = lambda c: F.col(c) if digits is None else F.round(c, digits)
    return runs.join(parts(spark, d), "key").select("key", "grp", "brand", value("past").alias("factor"), value("ahead").alias("label"), "from", "to")


def factor_runs(spark, d):
    """(key, grp, value, from, to): momentum of four weeks, where known, as runs of weeks."""
    runs = cal.carried_returns(week_prices(spark, d), ["key"], "week", "px", 4, step=7, days=ship_days(spark, d, "week", "week"), ahead=False)
    return runs.join(parts(spark, d), "key").select("key", "grp", F.col("past").alias("value"), "from", "to")


def returns(spark, d, digits=None):
    """The same as weekly rows."""
    return cal.run_days(return_runs(spark, d, digits), "week", step=7).select("key", "week", "grp", "brand", "factor", "label")


def return_cells(spark, d):
    """Counted factors of each group and week with their buckets; equal runs are counted
    before weeks are made."""
    runs = return_runs(spark, d, 9).dropna("any", subset=["factor", "label"])
    return premium_buckets(day_cells(runs, ["grp"], "week", ["factor"], 7, sum="label"), ["week", "grp"], "factor", count="n")


BRANDS = [f"b{i}" for i in range(1, 26)]


def brand_returns(spark, d, *keys):
    """Mean four-week return of each brand's parts per week (and ``keys``)."""
    days = ship_days(spark, d, "week", "week")
    x = cal.mean_returns(week_rows(spark, d), parts(spark, d), "key", [*keys, "brand"], "week", "px", 4, step=7, days=days)
    x = x.select(*keys, "brand", "week", F.round("mean", 7).alias("value"))
    with batches_by_rows(spark):
        return settle(x, "brand-returns")  # brands x weeks; models read it many times


def brand_premiums(spark, d):
    """Each brand's return of a week above the mean of all brands."""
    x = brand_returns(spark, d)
    return x.withColumn("value", F.round(F.col("value") - F.avg("value").over(Window.partitionBy("week")), 7))


def brand_panel(spark, d):
    """(grp, week, b1 ... b25): the brands' returns side by side."""
    x = brand_returns(spark, d, "grp").withColumn("brand", F.regexp_replace("brand", "Brand#", "b"))
    return to_wide(x, ["grp", "week"], BRANDS, "brand")


@query(f"""WITH {WEEKLY}, {RETURNS}, {BUCKETS}
SELECT grp, week, round(avg(CASE WHEN bucket = 0 THEN label END) - avg(CASE WHEN bucket = 2 THEN label END), 6) AS value, count(bucket) AS n
FROM b GROUP BY 1, 2 HAVING avg(CASE WHEN bucket = 0 THEN label END) - avg(CASE WHEN bucket = 2 THEN label END) IS NOT NULL""")
def a2_quantile_premium(spark, d):
    return rounded(premium_of_cells(return_cells(spark, d), ["grp", "week"]), "value")


@query(f"""WITH {WEEKLY}, {RETURNS}, {BUCKETS}
SELECT grp, week, bucket, count(*) AS n, round(avg(label), 7) AS label FROM b GROUP BY 1, 2, 3""")
def a4_premium_buckets(spark, d):
    out = return_cells(spark, d).groupBy("grp", "week", "bucket")
    return rounded(out.agg(F.sum("n").alias("n"), ratio(F.sum("sum"), F.sum("n")).alias("label")), "label", digits=7)


@query(f"""WITH {WEEKLY}, {RETURNS}, l AS (SELECT grp, week, 'mom' AS field, round(factor, 9) AS factor, round(label, 9) AS label FROM ret
  UNION ALL SELECT grp, week, 'rev', round(-factor, 9), round(label, 9) FROM ret),
x AS (SELECT * FROM l WHERE factor IS NOT NULL AND label IS NOT NULL),
q AS (SELECT grp, week, field, count(*) AS n, quantile_cont(factor, [0.0, 0.2, 0.3, 0.7, 0.8, 1.0]) AS q FROM x GROUP BY 1, 2, 3),
e AS (SELECT grp, week, field, list_sort(list_distinct([q[1], CASE WHEN n > 65 THEN q[2] ELSE q[3] END, CASE WHEN n > 65 THEN q[5] ELSE q[4] END, q[6]])) AS e FROM q WHERE n >= 3),
b AS (SELECT x.*, CASE WHEN e IS NULL OR len(e) < 3 THEN NULL WHEN factor <= e[2] THEN 0 WHEN len(e) = 3 THEN 1 WHEN factor <= e[3] THEN 1 ELSE 2 END AS bucket
      FROM x LEFT JOIN e ON e.grp = x.grp AND e.week = x.week AND e.field = x.field)
SELECT grp, week, field, 'label' AS y, round(avg(CASE WHEN bucket = 0 THEN label END) - avg(CASE WHEN bucket = 2 THEN label END), 6) AS value, count(bucket) AS n
FROM b GROUP BY 1, 2, 3 HAVING avg(CASE WHEN bucket = 0 THEN label END) - avg(CASE WHEN bucket = 2 THEN label END) IS NOT NULL""")
def a3_premium_job(spark, d):
    runs = return_runs(spark, d, 9).filter("label IS NOT NULL")  # weeks before the last four
    runs = runs.select("grp", "from", "to", F.col("factor").alias("mom"), (-F.col("factor")).alias("rev"), "label")
    return rounded(jobs.premium_job(runs, "grp", "week", ["mom", "rev"], ["label"], step=7), "value")


#: Added before rounding, so that means which end in 5 don't hang on the order of sums.
TIE = 1.7e-6


def _features_sql() -> str:
    """The features over a grid of all days."""
    mean = lambda n, x="tri": f"avg({x}) OVER (PARTITION BY key ORDER BY day ROWS {n})"
    full = lambda n: f"CASE WHEN count(*) OVER (PARTITION BY key ORDER BY day ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING) = {n} THEN {mean(f'BETWEEN CURRENT ROW AND {n - 1} FOLLOWING')} END"
    labels = [f'round(pow(lead(tri_avg_m{-x}, {k}) OVER w / nullif(tri_avg_m{-x}, 0), 4.0 / {k}) - 1, 3) AS "stock_return_y_w{k}_d{x}"' for k, of in jobs.LABELS.items() for x in of]
    past = [f"round((CASE WHEN {a} = 0 THEN tri_avg_7 ELSE lag(tri_avg_7, {a}) OVER w END) / nullif(lag(tri_avg_7, {b}) OVER w, 0) - 1, 3) AS stock_return_{n}" for n, (a, b) in jobs.PAST.items()]
    return f"""WITH {DAILY}, days AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM daily),
g AS (SELECT k.key, days.day, nullif(px, 0) AS tri, nullif(op, 0) AS open, nullif(hi, 0) AS high, nullif(lo, 0) AS low, nullif(cl, 0) AS close, vol AS volume, vol * 100 AS market_cap
  FROM (SELECT DISTINCT key FROM daily) k CROSS JOIN days LEFT JOIN daily d ON d.key = k.key AND d.day = days.day),
r AS (SELECT *, tri / lag(tri) OVER o - 1 AS r, ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open) AS t, {mean("6 PRECEDING", "volume")} AS short, row_number() OVER o AS rn FROM g WINDOW o AS (PARTITION BY key ORDER BY day)),
f AS (SELECT key, day, open, high, low, {", ".join(f"last_value({c} IGNORE NULLS) OVER o AS {c}" for c in jobs.CARRIED)}, short / nullif({mean("90 PRECEDING", "short")}, 0) AS volume_ratio,
  CASE WHEN rn >= 30 AND {mean("29 PRECEDING", "t")} IS NOT NULL THEN sqrt(greatest({mean("29 PRECEDING", "t")}, 0) * 256) END AS volatility, CASE WHEN rn >= 365 AND dayofweek(day) = 0 THEN list_filter(list(r) OVER (PARTITION BY key ORDER BY day ROWS 364 PRECEDING), lambda v: v IS NOT NULL) END AS x
  FROM r WINDOW o AS (PARTITION BY key ORDER BY day ROWS UNBOUNDED PRECEDING)),
l AS (SELECT *, {mean("6 PRECEDING")} AS tri_avg_7, {full(7)} AS tri_avg_m7, {full(28)} AS tri_avg_m28, last_value(tri IGNORE NULLS) OVER (PARTITION BY key ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_tri FROM f),
s AS (SELECT *, market_cap / nullif(last_tri, 0) * tri AS cap, len(x) AS n, list_avg(x) AS m FROM l WHERE dayofweek(day) = 0),
k AS (SELECT *, list_avg(list_transform(x, lambda v: (v - m) ** 2)) AS m2, list_avg(list_transform(x, lambda v: (v - m) ** 3)) AS m3 FROM s)
SELECT key AS ticker, day AS trading_day, tri, open, high, low, close, volume, round(cap, 4) AS market_cap, CASE WHEN n >= 3 AND m2 > 1e-12 THEN round(m3 / pow(m2, 1.5) * sqrt(n * (n - 1)) / (n - 2), 4) END AS skew, round(volatility, 5) AS volatility, round(volume_ratio, 6) AS volume_ratio,
  round(tri_avg_7 + {TIE}, 4) AS tri_avg_7, round(tri_avg_m7 + {TIE}, 4) AS tri_avg_m7, round(tri_avg_m28 + {TIE}, 4) AS tri_avg_m28, {", ".join(labels)}, {", ".join(past)} FROM k WINDOW w AS (PARTITION BY key ORDER BY day)"""


@query(_features_sql())
def t16_price_features_job(spark, d):
    """The whole feature job on suppliers."""
    panel = daily(spark, d).withColumnsRenamed({"key": "ticker", "day": "trading_day", "px": "tri", "op": "open", "hi": "high", "lo": "low", "cl": "close", "vol": "volume"})
    out = jobs.price_features(panel.withColumn("market_cap", F.col("volume") * 100), days=ship_days(spark, d, "day", "trading_day"))
    digits = {"market_cap": 4, "skew": 4, "volatility": 5, "volume_ratio": 6, "tri_avg_7": 4, "tri_avg_m7": 4, "tri_avg_m28": 4}
    made = [c for c in out.columns if c in digits or c.startswith("stock_return")]
    out = out.withColumn("skew", F.when(~F.isnan("skew"), F.col("skew"))).withColumn("volatility", F.nanvl("volatility", F.lit(0.0)))
    return out.withColumns({c: F.round(F.col(c) + (TIE if c.startswith("tri_avg") else 0.0), digits.get(c, 3)) for c in made})


@query(f"""WITH {DAILY}, ev AS (SELECT l_suppkey AS key, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS day, sum(l_quantity) AS q, max(l_tax) AS t FROM lineitem GROUP BY 1, 2)
SELECT d.key, d.day, d.px, e.q, e.t FROM daily d ASOF LEFT JOIN ev e ON d.key = e.key AND d.day >= e.day""")
def t16_j6_merge_statements(spark, d):
    from ..sources.scans import table

    li = table(spark, d, "lineitem")
    ev = li.groupBy(F.col("l_suppkey").alias("key"), F.to_date(F.date_trunc("quarter", "l_shipdate")).alias("day")).agg(F.sum("l_quantity").alias("q"), F.max("l_tax").alias("t"))
    return jobs.merge_statements(daily(spark, d).select("key", "day", "px"), ev, key="key", day="day")


@query(f"""WITH {WEEKLY}, {RETURNS}, c AS (SELECT * FROM ret WHERE label IS NOT NULL AND factor IS NOT NULL),
s AS (SELECT grp, week, key, brand, round(factor, 9) AS score, round(label, 9) AS ret, rank() OVER (PARTITION BY grp, week ORDER BY round(factor, 9) DESC) AS top, rank() OVER (PARTITION BY grp, week ORDER BY round(factor, 9)) AS low FROM c),
t AS (SELECT s.*, n AS top_n FROM s, (VALUES (-10), (10), (3)) v(n) WHERE (n > 0 AND top <= n) OR (n < 0 AND low <= -n)),
m AS (SELECT grp, week, top_n, brand AS mode, count(*) AS mode_count FROM t GROUP BY 1, 2, 3, 4 QUALIFY row_number() OVER (PARTITION BY grp, week, top_n ORDER BY count(*) DESC, brand) = 1),
a AS (SELECT grp, week, top_n, count(*) AS ticker_count, avg(ret) AS ret, avg((ret > 0)::INT) AS pos_pct, array_to_string(list_sort(list(key)), ',') AS tickers FROM t GROUP BY 1, 2, 3),
b AS (SELECT grp, week, avg(round(label, 9)) AS bm_ret, avg((round(label, 9) > 0)::INT) AS bm_pos_pct FROM c GROUP BY 1, 2)
SELECT a.grp, a.week, a.top_n, ticker_count, round(ret, 7) AS ret, round(pos_pct, 9) AS pos_pct, tickers, mode, mode_count, round(bm_ret, 7) AS bm_ret, round(bm_pos_pct, 9) AS bm_pos_pct
FROM a JOIN m ON m.grp = a.grp AND m.week = a.week AND m.top_n = a.top_n JOIN b ON b.grp = a.grp AND b.week = a.week""")
def a20_a21_portfolios(spark, d):
    rows = returns(spark, d, 9).dropna("any", subset=["factor", "label"])
    rows = rows.select("grp", "week", "key", "brand", F.col("factor").alias("score"), F.col("label").alias("ret"))
    out = jobs.portfolio_job(rows, ["grp", "week"], (-10, 10, 3), score="score", ret="ret", industry="brand", ticker="key")
    out = rounded(out.withColumn("tickers", F.array_join("tickers", ",")), "ret", "bm_ret", digits=7)
    return rounded(out, "pos_pct", "bm_pos_pct", digits=9)
