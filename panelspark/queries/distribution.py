"""Queries of aggregates, ranks, buckets and research statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import buckets, evaluate, research, scores
from ..operators.calendar import over
from ..functions.scalars import ratio
from ..sources.scans import table
from . import query
from .panels import RETURNS, returns
from .proxies import LONG, MONTHLY, WEEKLY, long_events, monthly_orders, rounded
from .shaping import FIELDS, WIDE, wide

MONTHLY_RET = MONTHLY + ", mret AS (SELECT field, day, value, value / nullif(lag(value) OVER (PARTITION BY field ORDER BY day), 0) - 1 AS r FROM monthly)"


def month_returns(spark, d):
    m = monthly_orders(spark, d)
    return m.withColumn("r", ratio(F.col("value"), F.lag("value").over(over(["field"], "day"))) - 1)


@query(f"""WITH {LONG} SELECT field, round(avg(value), 5) AS mean, min(value) AS least, max(value) AS largest, round(stddev_samp(value), 5) AS std, count(value) AS n, round(quantile_cont(value, 0.5), 6) AS median FROM long GROUP BY 1""")
def a1_describe(spark, d):
    out = research.describe(long_events(spark, d), ["field"], "value")
    return rounded(rounded(out, "mean", "std", digits=5), "median")


@query("""WITH q AS (SELECT p_type, quantile_cont(p_retailprice, [0.25, 0.5, 0.75]) AS q FROM part GROUP BY 1)
SELECT p_partkey, (p_retailprice > q[1])::INT + (p_retailprice > q[2] AND q[2] > q[1])::INT + (p_retailprice > q[3] AND q[3] > q[2])::INT AS bucket FROM part JOIN q ON q.p_type = part.p_type""")
def a5_quantile_cut(spark, d):
    return buckets.quantile_cut(table(spark, d, "part"), ["p_type"], "p_retailprice", 4).select("p_partkey", "bucket")


@query("""SELECT o_orderkey, CASE WHEN o_totalprice <= 100000 THEN 0 WHEN o_totalprice <= 250000 THEN 1 WHEN o_totalprice <= 400000 THEN 2 ELSE 3 END AS bin FROM orders""")
def a6_fixed_cut(spark, d):
    return table(spark, d, "orders").select("o_orderkey", buckets.fixed_cut("o_totalprice", [100000.0, 250000.0, 400000.0]).alias("bin"))


@query("""SELECT o_orderkey, round(median(o_totalprice) OVER (PARTITION BY o_orderpriority, o_orderstatus), 4) AS m FROM orders""")
def a7_bucket_median(spark, d):
    out = buckets.bucket_median(table(spark, d, "orders"), ["o_orderpriority", "o_orderstatus"], "o_totalprice", "m")
    return rounded(out.select("o_orderkey", "m"), "m", digits=4)


@query(f"""WITH {WEEKLY}, {RETURNS}, x AS (SELECT grp, year(week)::INT AS y, round(factor, 9) AS f, round(label, 9) AS l FROM ret WHERE factor IS NOT NULL AND label IS NOT NULL),
q AS (SELECT grp, y, quantile_cont(f, [0.2, 0.4, 0.6, 0.8]) AS q FROM x GROUP BY 1, 2),
b AS (SELECT x.*, (f > q[1])::INT + (f > q[2] AND q[2] > q[1])::INT + (f > q[3] AND q[3] > q[2])::INT + (f > q[4] AND q[4] > q[3])::INT AS b FROM x JOIN q ON q.grp = x.grp AND q.y = x.y),
p AS (SELECT grp, y, avg(CASE WHEN b = 0 THEN l END) AS d0, avg(CASE WHEN b = 1 THEN l END) AS d1, avg(CASE WHEN b = 2 THEN l END) AS d2, avg(CASE WHEN b = 3 THEN l END) AS d3, avg(CASE WHEN b = 4 THEN l END) AS d4 FROM b GROUP BY 1, 2)
SELECT grp, y, round(d0, 5) AS d0, round(d1, 5) AS d1, round(d2, 5) AS d2, round(d3, 5) AS d3, round(d4, 5) AS d4, round(d4 - d0, 5) AS spread FROM p""")
def a8_decile_table(spark, d):
    x = returns(spark, d, 9).dropna("any", subset=["factor", "label"])
    x = x.select("grp", F.year("week").alias("y"), F.col("factor").alias("f"), F.col("label").alias("l"))
    return rounded(buckets.decile_table(x, ["grp", "y"], "f", "l", 5), "d0", "d1", "d2", "d3", "d4", "spread", digits=5)


@query("""SELECT p_partkey, CASE WHEN p_retailprice <= quantile_cont(p_retailprice, 0.3) OVER w THEN 0 WHEN p_retailprice <= quantile_cont(p_retailprice, 0.7) OVER w THEN 1 ELSE 2 END AS label
FROM part WINDOW w AS (PARTITION BY p_type)""")
def a9_tercile(spark, d):
    return table(spark, d, "part").select("p_partkey", buckets.tercile("p_retailprice", ["p_type"], 0.3).alias("label"))


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY rank() OVER (PARTITION BY o_custkey ORDER BY round(o_totalprice, -5) DESC) <= 2""")
def a19_top_with_ties(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", F.round("o_totalprice", -5).alias("s"))
    return evaluate.top_with_ties(o, ["o_custkey"], "s", 2).drop("s")


@query("""SELECT o_custkey, o_orderkey FROM orders QUALIFY o_orderdate = max(o_orderdate) OVER (PARTITION BY o_custkey)""")
def a18_latest(spark, d):
    return evaluate.latest(table(spark, d, "orders"), ["o_custkey"], "o_orderdate").select("o_custkey", "o_orderkey")


@query("""SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3""")
def a22_head(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    return table(spark, d, "orders").withColumn("rn", F.row_number().over(w)).filter("rn <= 3").select("o_custkey", "o_orderkey")


@query("""SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25""")
def a23_largest(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("""WITH r AS (SELECT p_partkey, p_type, rank() OVER (PARTITION BY p_type ORDER BY p_size) AS r, count(*) OVER (PARTITION BY p_type, p_size) AS c, count(*) OVER (PARTITION BY p_type) AS n FROM part)
SELECT p_partkey, round((r + (c - 1) / 2.0) / n, 8) AS pct FROM r""")
def a24_percent_rank(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(evaluate.percent_rank("p_size", ["p_type"]), 8).alias("pct"))


@query("""SELECT o_orderkey, round(o_totalprice / max(o_totalprice) OVER (PARTITION BY o_custkey), 8) AS share FROM orders""")
def a25_normalize(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.round(scores.normalize("o_totalprice", ["o_custkey"]), 8).alias("share"))


@query(f"""WITH {LONG}, m AS (SELECT key, field, sum(value) AS s FROM long GROUP BY 1, 2), b AS (SELECT key, field FROM m QUALIFY row_number() OVER (PARTITION BY key ORDER BY round(s, 5) DESC, field) = 1)
SELECT field, count(*) AS n FROM b GROUP BY 1""")
def a26_argmax_counts(spark, d):
    from ..operators.clean import keep_first

    m = long_events(spark, d).groupBy("key", "field").agg(F.round(F.sum("value"), 5).alias("s"))
    best = keep_first(m, ["key"], [F.col("s").desc(), F.col("field")])
    return best.groupBy("field").agg(F.count("*").alias("n"))


@query(f"""WITH {LONG}, w AS ({WIDE}), m AS (SELECT day, avg((view IS NULL)::INT) AS view, avg((click IS NULL)::INT) AS click, avg((error IS NULL)::INT) AS error FROM w GROUP BY 1)
SELECT day, field, round(missing, 8) AS missing FROM m UNPIVOT (missing FOR field IN (view, click, error))""")
def a27_missing_rate(spark, d):
    return rounded(research.missing_rate(wide(spark, d), ["day"], ["view", "click", "error"]), "missing", digits=8)


@query(f"""WITH {LONG} SELECT a.field AS a, b.field AS b, round(corr(a.value, b.value), 5) AS corr, count(*) AS n FROM long a JOIN long b ON a.key = b.key AND a.day = b.day AND a.field < b.field GROUP BY 1, 2""")
def a28_correlation_pairs(spark, d):
    return rounded(research.correlation_pairs(long_events(spark, d), ["key", "day"]), "corr", digits=5)


@query(f"""WITH {LONG}, p AS (SELECT a.field AS a, b.field AS b, corr(a.value, b.value) AS corr, count(*) AS n FROM long a JOIN long b ON a.key = b.key AND a.day = b.day AND a.field <> b.field GROUP BY 1, 2)
SELECT a, b, round(corr, 5) AS corr, n FROM p QUALIFY row_number() OVER (PARTITION BY a ORDER BY abs(corr) DESC, b) = 1""")
def a28_strongest_partner(spark, d):
    pairs = research.correlation_pairs(long_events(spark, d), ["key", "day"])
    return rounded(research.strongest_partner(pairs), "corr", digits=5)


@query(f"""WITH {LONG}, w AS ({WIDE}), c AS (SELECT key, corr(view, click) AS click, corr(view, error) AS error FROM w GROUP BY 1)
SELECT key, 'click' AS field, round(click, 5) AS corr FROM c UNION ALL SELECT key, 'error', round(error, 5) FROM c""")
def a29_grouped_correlation(spark, d):
    out = research.grouped_correlation(wide(spark, d), ["key"], "view", ["click", "error"])
    return out.withColumn("corr", F.round(F.when(~F.isnan("corr"), F.col("corr")), 5))


@query(f"""WITH {MONTHLY_RET} SELECT field, year(day)::INT AS y, round(avg(r) / nullif(stddev_samp(r), 0), 5) AS sharpe, count(r) AS n FROM mret GROUP BY 1, 2""")
def a30_sharpe(spark, d):
    return rounded(research.sharpe_by(month_returns(spark, d).withColumn("y", F.year("day")), ["field", "y"], "r"), "sharpe", digits=5)


@query(f"""WITH {MONTHLY_RET}, b AS (SELECT *, avg(r) OVER (PARTITION BY day) AS bm FROM mret), e AS (SELECT field, r - bm AS e FROM b)
SELECT field, round(avg(e) / nullif(sqrt(avg(e * e)), 0), 5) AS sharpe, round(avg(e) / nullif(sqrt(avg(pow(least(e, 0), 2))), 0), 5) AS sortino,
  round(quantile_cont(e, 0.05), 6) AS q05, round(quantile_cont(e, 0.1), 6) AS q10, round(min(e), 6) AS least FROM e WHERE e IS NOT NULL GROUP BY 1""")
def a31_against_benchmark(spark, d):
    from pyspark.sql import Window

    m = month_returns(spark, d).withColumn("bm", F.avg("r").over(Window.partitionBy("day"))).filter("r IS NOT NULL")
    out = m.groupBy("field").agg(*evaluate.against_benchmark("r", "bm"))
    return rounded(rounded(out, "sharpe", "sortino", digits=5), "q05", "q10", "least")


@query(f"""WITH {MONTHLY_RET} SELECT field, round(avg(CASE WHEN day >= DATE '2000-07-01' THEN r END), 6) AS mean_1y, round(avg(CASE WHEN day >= DATE '1998-07-01' THEN r END), 6) AS mean_3y,
  round(avg(CASE WHEN day >= DATE '2000-07-01' THEN abs(r) END), 6) AS abs_1y, round(avg(CASE WHEN day >= DATE '1998-07-01' THEN abs(r) END), 6) AS abs_3y FROM mret GROUP BY 1""")
def a32_mean_over_years(spark, d):
    out = research.mean_over_years(month_returns(spark, d), ["field"], "day", "r", "2001-07-01", (1, 3))
    return rounded(out, "mean_1y", "mean_3y", "abs_1y", "abs_3y")


@query("""SELECT o_orderpriority, min(o_totalprice) AS least, round(quantile_cont(o_totalprice, 0.25), 4) AS q1, round(quantile_cont(o_totalprice, 0.5), 4) AS median,
  round(quantile_cont(o_totalprice, 0.75), 4) AS q3, max(o_totalprice) AS largest, round(avg((o_totalprice > 300000)::INT), 6) AS share_above FROM orders GROUP BY 1""")
def a34_distribution(spark, d):
    out = research.distribution(table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice", 300000)
    return rounded(rounded(out, "q1", "median", "q3", digits=4), "share_above")


@query("""SELECT CASE WHEN o_totalprice < 0 THEN 0 WHEN o_totalprice >= 500000 THEN 21 ELSE CAST(floor(o_totalprice / 25000) AS BIGINT) + 1 END AS bin, count(*) AS n FROM orders GROUP BY 1""")
def a34_histogram(spark, d):
    return research.histogram(table(spark, d, "orders"), "o_totalprice", 0.0, 500000.0, 20)


@query("""WITH l AS (SELECT o_totalprice AS m, 'o_orderpriority' AS config, o_orderpriority AS setting FROM orders UNION ALL SELECT o_totalprice, 'o_orderstatus', o_orderstatus FROM orders)
SELECT config, setting, round(avg(m), 3) AS mean, count(*) AS n, round(avg((m < 1e-5)::INT), 6) AS share_tiny FROM l GROUP BY 1, 2""")
def a35_config_sensitivity(spark, d):
    out = research.config_sensitivity(table(spark, d, "orders"), ["o_orderpriority", "o_orderstatus"], "o_totalprice")
    return rounded(rounded(out, "mean", digits=3), "share_tiny")


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) = 1""")
def a36_best_trial(spark, d):
    return research.best_trial(table(spark, d, "orders"), "o_custkey", "o_totalprice", "o_orderkey")


@query(f"""WITH {MONTHLY_RET}, x AS (SELECT field, day, r, lag(r) OVER (PARTITION BY field ORDER BY day) AS p FROM mret), y AS (SELECT * FROM x WHERE r IS NOT NULL AND p IS NOT NULL),
t AS (SELECT *, CASE WHEN r <= quantile_cont(r, 0.3) OVER w THEN 0 WHEN r <= quantile_cont(r, 0.7) OVER w THEN 1 ELSE 2 END AS a, CASE WHEN p <= quantile_cont(p, 0.3) OVER w THEN 0 WHEN p <= quantile_cont(p, 0.7) OVER w THEN 1 ELSE 2 END AS b FROM y WINDOW w AS (PARTITION BY field))
SELECT field, round(avg((a - 1) * (b - 1)), 8) AS confusion, count(*) AS n FROM t GROUP BY 1""")
def a37_confusion(spark, d):
    m = month_returns(spark, d).withColumn("p", F.lag("r").over(over(["field"], "day"))).dropna(subset=["r", "p"])
    m = m.withColumns({"a": buckets.tercile("r", ["field"], 0.3), "b": buckets.tercile("p", ["field"], 0.3)})
    out = research.confusion_score(m, "b", "a").groupBy("field").agg(F.avg("confusion").alias("confusion"), F.count("*").alias("n"))
    return rounded(out, "confusion", digits=8)


@query(f"""WITH {MONTHLY_RET}, g AS (SELECT field, 6 AS lookback, CASE WHEN count(r) OVER a = 6 THEN r * sign(avg(r) OVER a) END AS g FROM mret WINDOW a AS (PARTITION BY field ORDER BY day ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)
  UNION ALL SELECT field, 12, CASE WHEN count(r) OVER b = 12 THEN r * sign(avg(r) OVER b) END FROM mret WINDOW b AS (PARTITION BY field ORDER BY day ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING))
SELECT field, lookback, round(avg(g), 6) AS gain FROM g GROUP BY 1, 2""")
def a41_moving_average_rule(spark, d):
    return rounded(research.moving_average_rule(month_returns(spark, d), ["field"], "day", "r", [6, 12]), "gain")


@query(f"""WITH {LONG}, p AS (SELECT key, avg(value) AS score, count(*)::DOUBLE AS ret FROM long GROUP BY 1) SELECT c_mktsegment AS industry, round(avg(score), 5) AS score, round(avg(ret), 5) AS ret, count(*) AS n FROM p JOIN customer ON c_custkey = key GROUP BY 1""")
def a42_industry_table(spark, d):
    p = long_events(spark, d).groupBy("key").agg(F.avg("value").alias("score"), F.count("*").cast("double").alias("ret"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("industry"))
    return rounded(research.industry_table(p, c, "key", "industry", ["score", "ret"]), "score", "ret", digits=5)


@query(f"""WITH {MONTHLY}, c AS (SELECT field, value FROM monthly WHERE day = (SELECT max(day) FROM monthly)), h AS (SELECT field, arg_max(value, day) AS l, avg(value) AS u FROM monthly WHERE day < (SELECT max(day) FROM monthly) GROUP BY 1)
SELECT c.field, value, round(value - l, 4) AS change, round(value - u, 4) AS drift FROM c JOIN h ON h.field = c.field""")
def a43_change_report(spark, d):
    m = monthly_orders(spark, d)
    last = m.agg(F.max("day").alias("last"))
    m = m.crossJoin(F.broadcast(last))  # one row
    out = research.change_report(m.filter("day = last").select("field", "value"), m.filter("day < last"), "field", "value", "day")
    return rounded(out, "change", "drift", digits=4)


@query(f"""WITH {LONG}, p AS (SELECT key, day, avg(value) AS value FROM long GROUP BY 1, 2), c AS (SELECT key, value FROM p WHERE day = (SELECT max(day) FROM p)),
h AS (SELECT key, arg_max(value, day) AS l FROM p WHERE day < (SELECT max(day) FROM p) GROUP BY 1), r AS (SELECT c.key, round(value - l, 6) AS change FROM c JOIN h ON h.key = c.key)
(SELECT key, change, 'largest' AS side FROM r WHERE change IS NOT NULL ORDER BY change DESC, key LIMIT 20) UNION ALL (SELECT key, change, 'smallest' FROM r WHERE change IS NOT NULL ORDER BY change, key LIMIT 20)""")
def a43_change_extremes(spark, d):
    """Users whose mean value changed most on the last day."""
    p = long_events(spark, d).groupBy("key", "day").agg(F.avg("value").alias("value"))
    p = p.crossJoin(F.broadcast(p.agg(F.max("day").alias("last"))))  # one row
    out = research.change_report(p.filter("day = last").select("key", "value"), p.filter("day < last").drop("last"), "key", "value", "day")
    return research.extremes(out.select("key", F.round("change", 6).alias("change")), "change", "key")


@query("""WITH x AS (SELECT p_brand AS grp, p_size AS cfg, p_partkey AS key, p_retailprice AS s, ps AS r FROM part JOIN (SELECT l_partkey, avg(l_discount) AS ps FROM lineitem GROUP BY 1) l ON l_partkey = p_partkey),
q AS (SELECT grp, quantile_cont(s, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM x GROUP BY 1),
b AS (SELECT x.grp, r, (SELECT count(*) FROM (SELECT DISTINCT unnest(q) AS e) WHERE s > e) AS b FROM x JOIN q ON q.grp = x.grp)
SELECT grp, round(avg(CASE WHEN b = 0 THEN r END), 7) AS d0, round(avg(CASE WHEN b = 4 THEN r END), 7) AS d4, round(avg(CASE WHEN b = 9 THEN r END), 7) AS d9, round(avg(CASE WHEN b = 9 THEN r END) - avg(CASE WHEN b = 0 THEN r END), 7) AS spread FROM b GROUP BY 1""")
def c11_score_deciles(spark, d):
    """Mean outcome by decile of the score, per configuration (brand)."""
    li = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.avg("l_discount").alias("r"))
    p = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("grp"), F.col("p_retailprice").alias("s"))
    out = buckets.decile_table(p.join(li, "p_partkey"), ["grp"], "s", "r").select("grp", "d0", "d4", "d9", "spread")
    return rounded(out, "d0", "d4", "d9", "spread", digits=7)


@query("""WITH t AS (SELECT p_type, CASE WHEN p_retailprice <= quantile_cont(p_retailprice, 0.3) OVER w THEN 0 WHEN p_retailprice <= quantile_cont(p_retailprice, 0.7) OVER w THEN 1 ELSE 2 END AS l FROM part WINDOW w AS (PARTITION BY p_brand))
SELECT p_type, 'S' AS side, round(avg(l), 8) AS rate, count(*) AS n FROM t GROUP BY 1 UNION ALL SELECT p_type, 'L', round(avg(2 - l), 8), count(*) FROM t GROUP BY 1""")
def a47_hit_rate(spark, d):
    p = table(spark, d, "part").withColumn("l", buckets.tercile("p_retailprice", ["p_brand"], 0.3))
    return rounded(research.hit_rate(p, ["p_type"], "l"), "rate", digits=8)


RULES = {"price": [(150000.0, 60000.0), (300000.0, 60000.0)], "month": [(4.0, 2.0), (9.0, 2.0)], "cust": [(500.0, 200.0)]}


def _nested_sql() -> str:
    """Every rule of the grid held against every row."""
    rows = ", ".join(f"('{x}', {t}::DOUBLE, {s}::DOUBLE)" for x, of in RULES.items() for t, s in of)
    value = "CASE {0} WHEN 'price' THEN price WHEN 'month' THEN month WHEN 'cust' THEN cust END"
    holds = "CASE op WHEN '>' THEN {v} > {t} WHEN '<' THEN {v} < {t} ELSE {v} > {t} - {s} AND {v} < {t} + {s} END"
    meets = lambda i: "coalesce(" + holds.format(v=f"({value.format(f'g{i}.x')})", t=f"g{i}.t", s=f"g{i}.s") + ", false)"
    return f"""WITH o AS (SELECT o_totalprice AS price, month(o_orderdate)::DOUBLE AS month, o_custkey::DOUBLE AS cust, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN CASE WHEN o_orderpriority < '3' THEN 1 ELSE 2 END ELSE 3 END AS best FROM orders),
g AS (SELECT * FROM (VALUES {rows}) v(x, t, s)), r AS (SELECT op, best, g1.x AS x1, g1.t AS t1, g2.x AS x2, g2.t AS t2, g3.x AS x3, g3.t AS t3, {meets(1)} AS p, CASE WHEN {meets(1)} THEN {meets(2)} ELSE {meets(3)} END AS q
FROM o, (VALUES ('>'), ('<'), ('~')) a(op), g g1, g g2, g g3 WHERE g1.x <> g2.x AND g1.x <> g3.x AND g2.x <> g3.x)
SELECT op, "first", x1, t1, x2, t2, x3, t3, round(avg((best = CASE WHEN "first" THEN p::INT + 2 * q::INT ELSE 2 * p::INT + q::INT END)::INT), 9) AS accuracy
FROM r, (VALUES (true), (false)) f("first") GROUP BY ALL"""


@query(_nested_sql())
def a40_nested_rules(spark, d):
    """Rules of three features and predicates for a choice of four."""
    best = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", F.when(F.col("o_orderpriority") < "3", 1).otherwise(2)).otherwise(3)
    o = table(spark, d, "orders").select(F.col("o_totalprice").alias("price"), F.month("o_orderdate").alias("month"), F.col("o_custkey").alias("cust"), best.alias("best"))
    return rounded(research.nested_rule_accuracy(o, RULES, "best"), "accuracy", digits=9)


@query(f"""WITH {MONTHLY_RET}, m AS (SELECT field, k, CASE WHEN count(r) OVER w3 = 3 AND k = 3 THEN r * sign(avg(r) OVER w3) WHEN count(r) OVER w6 = 6 AND k = 6 THEN r * sign(avg(r) OVER w6) WHEN count(r) OVER w12 = 12 AND k = 12 THEN r * sign(avg(r) OVER w12) END AS g FROM mret, (VALUES (3), (6), (12)) v(k)
  WINDOW w3 AS (PARTITION BY field, k ORDER BY day ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), w6 AS (PARTITION BY field, k ORDER BY day ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), w12 AS (PARTITION BY field, k ORDER BY day ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)),
a AS (SELECT field, k AS lookback, avg(g) AS gain FROM m GROUP BY 1, 2) SELECT field, lookback, round(gain, 8) AS gain FROM a QUALIFY row_number() OVER (PARTITION BY field ORDER BY gain DESC, lookback) = 1""")
def a41_best_lookback(spark, d):
    """The lookback whose moving average told the sign best, per field."""
    gains = research.moving_average_rule(month_returns(spark, d), ["field"], "day", "r", [3, 6, 12])
    return rounded(research.best_lookback(gains, ["field"]), "gain", digits=8)


@query(f"""WITH {MONTHLY_RET}, b AS (SELECT day, r AS b, value AS v FROM mret WHERE field = '1-URGENT') SELECT field, m.day, value, round(r, 6) AS r, round(value - v, 4) AS value_spread, round(r - b, 6) AS r_spread FROM mret m JOIN b ON b.day = m.day""")
def a39_t28_return_mix(spark, d):
    out = research.return_mix(month_returns(spark, d), "field", "1-URGENT", ["day"], ["value", "r"])
    return rounded(rounded(out, "r", "r_spread"), "value_spread", digits=4)


@query("""SELECT t AS threshold, round(avg(((o_totalprice > t) = (o_orderstatus = 'F'))::INT), 8) AS accuracy FROM orders, (VALUES (100000.0::DOUBLE), (200000.0), (300000.0)) v(t) GROUP BY 1""")
def a40_threshold_rules(spark, d):
    o = table(spark, d, "orders").withColumn("f", F.col("o_orderstatus") == "F")
    return rounded(research.threshold_rule_accuracy(o, "o_totalprice", "f", [100000.0, 200000.0, 300000.0]), "accuracy", digits=8)
