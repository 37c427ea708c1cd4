"""Queries of scans, reshaping, cleaning, joins and formulas."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.formula import Formula, apply_formulas
from ..functions.scalars import finite, month_number, row_mean, zero_to_null
from ..operators import clean, joins, reshape
from ..operators.calendar import forward_fill, over
from ..sources import scans
from . import query
from .proxies import DAILY, LONG, MONTHLY, WEEKLY, daily, long_events, monthly_orders, rounded, weekly

FIELDS = ["view", "click", "purchase", "signup", "error"]
WIDE = "SELECT key, day, " + ", ".join(f"max(CASE WHEN field = '{f}' THEN value END) AS {f}" for f in FIELDS) + " FROM long GROUP BY 1, 2"


def wide(spark, d):
    return reshape.to_wide(long_events(spark, d), ["key", "day"], FIELDS)


@query(f"""WITH {DAILY} SELECT d.key, d.day, d.px, s_nationkey AS nation, s_acctbal AS market_cap, n_name AS currency_code FROM daily d
LEFT JOIN supplier ON s_suppkey = d.key LEFT JOIN nation ON n_nationkey = s_nationkey WHERE d.day >= DATE '1998-01-01'""")
def s1_j1_price_scan(spark, d):
    s = scans.table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("market_cap"))
    n = scans.table(spark, d, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_name").alias("currency_code"))
    base = scans.window_of_days(daily(spark, d).select("key", "day", "px"), "day", "1998-01-01", 0)
    return joins.left_all(base, (s, ["key"]), (n, ["nation"])).select("key", "day", "px", "nation", "market_cap", "currency_code")


@query(f"""WITH {MONTHLY}, f AS (SELECT field, CAST(unnest(generate_series((SELECT min(day) FROM monthly), (SELECT max(day) FROM monthly), INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT DISTINCT field FROM monthly)),
g AS (SELECT f.field AS currency_code, f.day AS trading_day, CASE WHEN f.field = '1-URGENT' THEN 1.0 ELSE value END AS v FROM f LEFT JOIN monthly m ON m.field = f.field AND m.day = f.day)
SELECT currency_code, trading_day, last_value(v IGNORE NULLS) OVER (PARTITION BY currency_code ORDER BY trading_day ROWS UNBOUNDED PRECEDING) AS fx_rate FROM g""")
def s2_fx_rates(spark, d):
    raw = monthly_orders(spark, d).withColumnsRenamed({"field": "currency_code", "day": "trading_day", "value": "last_price"})
    return scans.fx_rates(raw, "1-URGENT")


@query(f"WITH {LONG} {WIDE}")
def r1_s3_to_wide(spark, d):
    return wide(spark, d)


@query(f"""WITH {LONG} SELECT key, day, field, value FROM long""")
def r2_to_long(spark, d):
    return reshape.to_long(wide(spark, d), ["key", "day"], FIELDS)


@query("""SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS position FROM orders""")
def r3_explode_list(spark, d):
    lists = scans.table(spark, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("o"))
    rows = lists.select("o_custkey", F.posexplode("o").alias("position", "o_orderkey"))
    return rows.select("o_custkey", "o_orderkey", (F.col("position") + 1).cast("long").alias("position"))


@query(f"""WITH {LONG} SELECT key, field, round(avg(value), 9) AS mean FROM long GROUP BY 1, 2""")
def r4_r10_maps(spark, d):
    means = long_events(spark, d).groupBy("key", "field").agg(F.round(F.avg("value"), 9).alias("mean"))
    maps = means.groupBy("key").agg(reshape.to_map("field", "mean").alias("m"))
    return reshape.explode_map(maps, "m", "field", "mean")


@query(f"""WITH {LONG}, m AS (SELECT key, field, round(avg(value), 9) AS mean FROM long GROUP BY 1, 2)
SELECT key, max(CASE WHEN field = 'view' THEN mean END) AS view, max(CASE WHEN field = 'click' THEN mean END) AS click FROM m GROUP BY 1""")
def r7_map_columns(spark, d):
    means = long_events(spark, d).groupBy("key", "field").agg(F.round(F.avg("value"), 9).alias("mean"))
    return reshape.map_columns(means.groupBy("key").agg(reshape.to_map("field", "mean").alias("m")), "m", ["view", "click"])


@query(f"""WITH {WEEKLY}, x AS (SELECT key, week, px AS a, lag(px) OVER (PARTITION BY key ORDER BY week) AS b FROM weekly)
SELECT key, week, 'p' AS field, b AS pred, a AS actual FROM x UNION ALL SELECT key, week, 'q', b * 2, a * 2 FROM x""")
def r5_stack_pairs(spark, d):
    before = F.lag("px").over(over(["key"], "week"))
    x = weekly(spark, d).select("key", "week", before.alias("p_pred"), F.col("px").alias("p_actual"), (before * 2).alias("q_pred"), (F.col("px") * 2).alias("q_actual"))
    return reshape.stack_pairs(x, ["key", "week"], ["p", "q"], "pred", "actual")


@query(f"""WITH {LONG} SELECT 'events' AS source, field, day, count(*) AS n, CAST(NULL AS DOUBLE) AS value FROM long GROUP BY 1, 2, 3
UNION ALL SELECT 'orders', o_orderpriority, CAST(date_trunc('month', o_orderdate) AS DATE), NULL, round(avg(o_totalprice), 4) FROM orders GROUP BY 1, 2, 3""")
def r8_union_sources(spark, d):
    a = long_events(spark, d).groupBy("field", "day").agg(F.count("*").alias("n")).withColumn("source", F.lit("events"))
    return reshape.union_all(a, monthly_orders(spark, d).withColumn("source", F.lit("orders")))


@query(f"""WITH {LONG}, a AS (SELECT key, count(*) AS views FROM long WHERE field = 'view' GROUP BY 1), b AS (SELECT key, count(*) AS errors FROM long WHERE field = 'error' GROUP BY 1)
SELECT coalesce(a.key, b.key) AS key, views, errors FROM a FULL JOIN b ON a.key = b.key""")
def r9_j5_beside(spark, d):
    n = lambda f, name: long_events(spark, d).filter(F.col("field") == f).groupBy("key").agg(F.count("*").alias(name))
    return reshape.beside(n("view", "views"), n("error", "errors"), ["key"])


@query("""SELECT o_orderpriority AS grp, array_to_string(list_sort(list(DISTINCT CAST(o_custkey AS VARCHAR))), ',') AS names, count(*) AS n
FROM orders GROUP BY 1""")
def r11_f8_concat_lists(spark, d):
    o = scans.table(spark, d, "orders")
    lists = o.groupBy("o_orderpriority", "o_orderstatus").agg(F.collect_set(F.col("o_custkey").cast("string")).alias("l"), F.count("*").alias("n"))
    out = lists.groupBy(F.col("o_orderpriority").alias("grp")).agg(reshape.concat_lists("l").alias("l"), F.sum("n").alias("n"))
    return out.select("grp", F.array_join(F.sort_array(F.array_distinct("l")), ",").alias("names"), "n")


@query("""SELECT l_orderkey, l_linenumber, nullif(l_discount, 0.0) AS discount, CASE WHEN l_tax <> 0 THEN l_discount / l_tax END AS ratio FROM lineitem""")
def p1_p2_clean_values(spark, d):
    inf = F.when(F.col("l_tax") == 0, F.lit(float("inf"))).otherwise(F.try_divide("l_discount", F.nullif("l_tax", F.lit(0.0))))
    return scans.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", zero_to_null(F.col("l_discount")).alias("discount"), finite(inf).alias("ratio"))


@query(f"""WITH {DAILY} SELECT key, day, px FROM daily WHERE day BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'""")
def p3_date_range(spark, d):
    return scans.window_of_days(daily(spark, d).select("key", "day", "px"), "day", "1997-01-01", 0, "1997-12-31")


@query(f"""WITH {LONG}, w AS ({WIDE}) SELECT * FROM w WHERE view IS NOT NULL AND click IS NOT NULL""")
def p8_complete_rows(spark, d):
    return wide(spark, d).dropna("any", subset=["view", "click"])


@query(f"""WITH {LONG}, w AS ({WIDE}), f AS (SELECT *, count(view) OVER o AS nv, count(error) OVER o AS ne FROM w WINDOW o AS (PARTITION BY key ORDER BY day ROWS UNBOUNDED PRECEDING))
SELECT key, day, view, click, purchase, signup, error FROM f WHERE nv > 0 AND ne > 0""")
def p9_after_first_known(spark, d):
    return clean.after_first(wide(spark, d), ["key"], "day", ["view", "error"])


@query(f"""WITH {DAILY}, q AS (SELECT key, quantile_cont(px, 0.05) AS a, quantile_cont(px, 0.95) AS b FROM daily GROUP BY 1)
SELECT d.key, day, round(least(greatest(px, a), b), 8) AS px FROM daily d JOIN q ON q.key = d.key""")
def p12_winsorize(spark, d):
    return rounded(clean.winsorize(daily(spark, d).select("key", "day", "px"), ["key"], "px", 0.05), "px", digits=8)


@query("""SELECT o_orderkey, o_totalprice - o_custkey AS net_debt, o_totalprice + 1.0 AS ttm_ebit, o_totalprice + 1.0 + o_custkey AS ttm_ebitda FROM orders""")
def p13_fill_statement(spark, d):
    o = scans.table(spark, d, "orders")
    none = F.lit(None).cast("double")
    s = o.select("o_orderkey", F.col("o_totalprice").alias("debt"), F.col("o_custkey").cast("double").alias("cash"), none.alias("net_debt"), none.alias("ttm_ebit"),
        F.col("o_totalprice").alias("ttm_pretax_income"), F.lit(1.0).alias("ttm_interest"), none.alias("ttm_ebitda"), F.col("o_custkey").cast("double").alias("ttm_dda"))
    return clean.fill_statement(s).select("o_orderkey", "net_debt", "ttm_ebit", "ttm_ebitda")


@query(f"""WITH {LONG}, w AS ({WIDE}), s AS (SELECT min(day) AS a FROM w WHERE ((view IS NULL)::INT + (click IS NULL)::INT + (purchase IS NULL)::INT + (signup IS NULL)::INT + (error IS NULL)::INT) / 5.0 < 0.3)
SELECT w.* FROM w, s WHERE day >= a""")
def p14_first_complete_period(spark, d):
    return clean.from_first_complete(wide(spark, d), "day", FIELDS, 0.3)


@query(f"""WITH {LONG} SELECT key, day, CASE WHEN field IN ('error', 'view') THEN field || '*' ELSE field END AS field, CASE WHEN field IN ('error', 'view') THEN -value ELSE value END AS value FROM long""")
def p11_flip_sign(spark, d):
    rows = long_events(spark, d).withColumn("neg_factor", F.array(F.lit("error"), F.lit("view")))
    return rows.select("key", "day", clean.flip_name("neg_factor").alias("field"), clean.flip_sign("value", "neg_factor").alias("value"))


@query("""SELECT p_partkey, CASE WHEN p_name LIKE 'red%' THEN 'index' WHEN p_size > 40 THEN 'etf' ELSE 'stock' END AS kind FROM part""")
def p6_ticker_class(spark, d):
    p = scans.table(spark, d, "part").withColumn("is_etf", F.col("p_size") > 40)
    p = p.withColumn("ticker", F.when(F.col("p_name").startswith("red"), F.concat(F.lit("."), "p_name")).otherwise(F.col("p_name")))
    return p.select("p_partkey", clean.ticker_class("ticker", "is_etf").alias("kind"))


@query("""SELECT o_custkey, count(*) AS n, avg(o_orderkey) AS ret, CASE WHEN avg(o_totalprice) IS NOT NULL THEN round(avg(CASE WHEN o_totalprice > 200000 THEN 1.0 ELSE 0.0 END), 2) * 100 END AS pos_pct
FROM orders GROUP BY 1""")
def p16_report_units(spark, d):
    o = scans.table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.avg("o_orderkey").alias("ret"), F.avg((F.col("o_totalprice") > 200000).cast("double")).alias("pos_pct"))
    return o.withColumn("pos_pct", clean.report_units()["pos_pct"])


@query(f"""WITH {LONG}, w AS ({WIDE}), n AS (SELECT *, (view IS NULL)::INT + (click IS NULL)::INT + (purchase IS NULL)::INT + (signup IS NULL)::INT + (error IS NULL)::INT AS z FROM w)
SELECT key, day, view, click, purchase, signup, error FROM n QUALIFY row_number() OVER (PARTITION BY key ORDER BY z, day) = 1""")
def d1_most_complete(spark, d):
    return clean.most_complete(wide(spark, d), ["key"], ["day"])


@query("""SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 1""")
def d2_duplicate_keys(spark, d):
    return reshape.duplicate_keys(scans.table(spark, d, "orders"), ["o_custkey", "o_orderstatus"])


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1""")
def d3_keep_first(spark, d):
    o = scans.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return clean.keep_first(o, ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")])


@query("""SELECT p_partkey, substr(p_name, 1, 3) AS head, rtrim(p_name || '**', '*') AS bare, split_part(p_brand, '#', 2) AS code, p_type || '_' || p_brand AS label FROM part""")
def d4_f7_strings(spark, d):
    p = scans.table(spark, d, "part")
    bare = F.regexp_replace(F.concat("p_name", F.lit("**")), r"\*+$", "")
    return p.select("p_partkey", F.substring("p_name", 1, 3).alias("head"), bare.alias("bare"), F.element_at(F.split("p_brand", "#"), 2).alias("code"), F.concat_ws("_", "p_type", "p_brand").alias("label"))


@query("""WITH fx AS (SELECT n_regionkey AS r, CAST(date_trunc('month', o_orderdate) AS DATE) AS m, avg(o_totalprice) / 100000 AS fx
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey <> 0 GROUP BY 1, 2)
SELECT o_orderkey, round(o_totalprice / nullif(fx, 0), 4) AS o_totalprice FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
JOIN fx ON r = n_regionkey AND m = CAST(date_trunc('month', o_orderdate) AS DATE)""")
def j2_j3_currency(spark, d):
    """Prices by a regional monthly rate; a region without rates vanishes."""
    c = scans.table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n"))
    n = scans.table(spark, d, "nation").select(F.col("n_nationkey").alias("n"), F.col("n_regionkey").alias("region"))
    o = scans.table(spark, d, "orders").join(c, "o_custkey").join(n, "n").withColumn("month", F.to_date(F.date_trunc("month", "o_orderdate")))
    fx = o.filter("region <> 0").groupBy(F.col("region").alias("currency_code"), F.col("month").alias("trading_day")).agg((F.avg("o_totalprice") / 100000).alias("fx_rate"))
    out = joins.convert_currency(o, fx, ["o_totalprice"], "region", "month").select("o_orderkey", "o_totalprice")
    return rounded(out, "o_totalprice", digits=4)


@query("""SELECT s_suppkey, coalesce(CASE WHEN n_regionkey < 3 THEN n_name END, 'OTHER') AS nation FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey""")
def j4_j12_lookup(spark, d):
    n = scans.table(spark, d, "nation").filter("n_regionkey < 3").withColumnRenamed("n_nationkey", "s_nationkey")
    return joins.lookup(scans.table(spark, d, "supplier"), n, "s_nationkey", "n_name", "nation", F.lit("OTHER")).select("s_suppkey", "nation")


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def j7_semi(spark, d):
    c = scans.table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return joins.only_in(scans.table(spark, d, "orders"), c, ["o_custkey"]).select("o_orderkey", "o_custkey")


@query("""SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def j8_anti(spark, d):
    done = scans.table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return joins.not_in(scans.table(spark, d, "customer"), done, ["c_custkey"]).select("c_custkey", "c_name")


@query("""SELECT p_type, r_name, i AS weeks, count(*) AS n FROM part, region, (VALUES (4), (8), (26)) w(i) GROUP BY 1, 2, 3""")
def j13_product(spark, d):
    groups = scans.table(spark, d, "part").groupBy("p_type").agg(F.count("*").alias("n"))
    weeks = spark.createDataFrame([(4,), (8,), (26,)], "weeks int")
    return joins.product(groups, scans.table(spark, d, "region").select("r_name"), weeks).select("p_type", "r_name", "weeks", "n")


@query("""SELECT o_orderkey, o_custkey, avg(o_orderkey) OVER (PARTITION BY o_custkey) AS actual FROM orders""")
def j14_group_mean(spark, d):
    o = scans.table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderkey").cast("double").alias("v"))
    return joins.with_group_mean(o, ["o_custkey"], "v", "actual").drop("v")


FORMULAS = [
    Formula("sum", "view + click - error"), Formula("product", "view * click"), Formula("ratio", "view + absent", "click"),
    Formula("grow_q", "view", "view"), Formula("other", "view", "view"),
]


@query(f"""WITH {LONG}, w AS ({WIDE}), f AS (SELECT key, day, view + coalesce(click, 0) - coalesce(error, 0) AS sum, view * click AS product, view / nullif(click, 0) AS ratio,
  view / nullif(lag(view, 12) OVER (PARTITION BY key ORDER BY day), 0) - 1 AS grow_q FROM w)
SELECT key, day, round(sum, 5) AS sum, round(product, 5) AS product, round(ratio, 9) AS ratio, round(grow_q, 9) AS grow_q FROM f WHERE coalesce(sum, product, ratio, grow_q) IS NOT NULL""")
def f1_f4_formulas(spark, d):
    out = apply_formulas(wide(spark, d), FORMULAS, over(["key"], "day"), ["key", "day"])
    return rounded(rounded(out, "sum", "product", digits=5), "ratio", "grow_q", digits=9)


@query(f"""WITH {LONG}, w AS ({WIDE}) SELECT key, day, round((coalesce(view, 0) + coalesce(click, 0) + coalesce(error, 0)) / nullif((view IS NOT NULL)::INT + (click IS NOT NULL)::INT + (error IS NOT NULL)::INT, 0), 6) AS mean,
  round(ln(1 + abs(view)), 6) AS l, round(sqrt(click), 6) AS s, CAST(ceil(error) AS BIGINT) AS c FROM w""")
def f5_math(spark, d):
    mean = row_mean([F.col("view"), F.col("click"), F.col("error")])
    return wide(spark, d).select("key", "day", F.round(mean, 6).alias("mean"), F.round(F.log1p(F.abs("view")), 6).alias("l"), F.round(F.sqrt("click"), 6).alias("s"), F.ceil("error").cast("long").alias("c"))


@query("""SELECT o_orderkey, month(o_orderdate)::INT AS m, CAST(o_orderdate AS DATE) AS day FROM orders""")
def f6_dates(spark, d):
    o = scans.table(spark, d, "orders")
    name = F.date_format("o_orderdate", "MMM")
    number = F.date_format("o_orderdate", "yyyyMMdd").cast("double")
    from ..functions.scalars import yyyymmdd

    return o.select("o_orderkey", month_number(name).alias("m"), yyyymmdd(number).alias("day"))


@query("""SELECT p_partkey, CASE p_brand WHEN 'Brand#1' THEN NULL WHEN 'Brand#2' THEN '101021' ELSE substr(p_brand, 1, 6) END AS code FROM part""")
def s6_industry_code(spark, d):
    raw = F.when(F.col("p_brand") == "Brand#1", "NA").otherwise(F.col("p_brand"))
    return scans.table(spark, d, "part").select("p_partkey", scans.industry_code(raw, {"Brand#2": "101021"}).alias("code"))


@query("""SELECT l_orderkey, l_partkey, p_brand AS brand FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size > 25""")
def s7_s9_s10_lookup_scan(spark, d):
    p = scans.table(spark, d, "part").filter("p_size > 25").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("brand"))
    return scans.table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(p, "l_partkey")


@query(f"""WITH {LONG} SELECT key, field || '_' || key AS field, day, value FROM long WHERE field IN ('view', 'click')""")
def s15_s16_series(spark, d):
    rows = long_events(spark, d).withColumn("ticker", F.col("key").cast("string")).withColumnRenamed("day", "trading_day")
    rows = rows.filter(F.col("field").isin("view", "click"))
    return rows.select("key", F.concat_ws("_", "field", "ticker").alias("field"), F.col("trading_day").alias("day"), "value")


@query("""SELECT max(CASE WHEN o_orderpriority = '5-LOW' THEN o_orderkey END) AS last_low, CAST(min(o_orderdate) AS DATE) AS restart FROM orders""")
def s22_s23_latest(spark, d):
    o = scans.table(spark, d, "orders")
    return o.agg(F.max_by("o_orderkey", F.when(F.col("o_orderpriority") == "5-LOW", F.col("o_orderkey"))).alias("last_low"), F.to_date(F.min("o_orderdate")).alias("restart"))


@query("""SELECT event_id, user_id, CAST(ts AS DATE) AS day, value FROM events WHERE dayofweek(ts) = 1 AND user_id IN (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase')""")
def s24_weekday_scan(spark, d):
    e = scans.table(spark, d, "events")
    buyers = e.filter("event_type = 'purchase'").select("user_id").distinct()
    return e.filter(F.dayofweek("ts") == 2).join(buyers, "user_id", "left_semi").select("event_id", "user_id", F.to_date("ts").alias("day"), "value")


@query(f"""WITH {LONG}, w AS ({WIDE}) SELECT key, day, last_value(view IGNORE NULLS) OVER o AS view, last_value(error IGNORE NULLS) OVER o AS error
FROM w WINDOW o AS (PARTITION BY key ORDER BY day ROWS UNBOUNDED PRECEDING)""")
def w1_forward_fill(spark, d):
    return forward_fill(wide(spark, d).select("key", "day", "view", "error"), ["key"], "day", ["view", "error"])
