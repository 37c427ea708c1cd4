"""Further queries: scans of results, older scores, samples, research tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import correlation, ratio
from ..operators import calendar as cal
from ..operators import joins, research, scores
from ..plans import training, trees
from ..sources import scans
from ..sources.scans import table
from . import query
from .distribution import MONTHLY_RET, month_returns
from .panels import BRANDS, RETURNS, returns
from .proxies import LONG, MONTHLY, WEEKLY, long_events, monthly_orders, rounded, weekly
from .shaping import wide

SAMPLE = "SELECT grp, week, key, brand, round(factor, 9) AS f, round(label, 9) AS l FROM ret WHERE factor IS NOT NULL AND label IS NOT NULL"


def sample(spark, d):
    x = returns(spark, d, 9).dropna(subset=["factor", "label"])
    return x.select("grp", "week", "key", "brand", F.col("factor").alias("f"), F.col("label").alias("l"))


@query(f"""WITH {WEEKLY}, {RETURNS}, x AS ({SAMPLE}),
t AS (SELECT *, CASE WHEN f <= quantile_cont(f, 0.3) OVER w THEN 0 WHEN f <= quantile_cont(f, 0.7) OVER w THEN 1 ELSE 2 END AS t FROM x WINDOW w AS (PARTITION BY grp, week))
SELECT grp, week, round(avg(CASE WHEN t = 2 THEN l END) - avg(CASE WHEN t = 0 THEN l END), 7) AS premium, count(*) AS n FROM t GROUP BY 1, 2""")
def a33_expost_premium(spark, d):
    return rounded(research.expost_premium(sample(spark, d), ["grp", "week"], "f", "l", 0.3), "premium", digits=7)


@query(f"""WITH {WEEKLY}, {RETURNS}, x AS ({SAMPLE}), r AS (SELECT grp, abs(row_number() OVER (PARTITION BY grp, week ORDER BY f, key) - row_number() OVER (PARTITION BY grp, week ORDER BY l, key))::DOUBLE AS e FROM x)
SELECT grp, round(avg(e), 7) AS mae, quantile_cont(e, 0.5) AS median, count(*) AS n FROM r GROUP BY 1""")
def a38_rank_errors(spark, d):
    return rounded(research.error_statistics(sample(spark, d), ["grp"], ["grp", "week"], "f", "l", True, "key"), "mae", digits=7)


@query(f"""WITH {WEEKLY}, {RETURNS}, x AS ({SAMPLE}), p AS (SELECT grp, week, key FROM x QUALIFY row_number() OVER (PARTITION BY grp, week ORDER BY f DESC, key) <= 5)
SELECT p.grp, round(avg(x.l), 7) AS ret, round(avg(x.l) / nullif(stddev_samp(x.l), 0), 6) AS sharpe, count(*) AS n FROM p JOIN x ON x.key = p.key AND x.week = p.week GROUP BY 1""")
def a45_reprice_picks(spark, d):
    from pyspark.sql import Window

    x = sample(spark, d)
    w = Window.partitionBy("grp", "week").orderBy(F.desc("f"), "key")
    picks = x.withColumn("rn", F.row_number().over(w)).filter("rn <= 5").groupBy("grp", "week").agg(F.collect_list("key").alias("tickers"))
    out = research.reprice_picks(picks, x, ["grp"], "tickers", "key", "week", "l")
    return rounded(rounded(out, "ret", digits=7), "sharpe")


@query("""SELECT o_orderpriority, round(avg(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END), 6) AS f, round(avg(CASE WHEN o_orderstatus = 'O' THEN o_orderkey END), 6) AS o FROM orders GROUP BY 1""")
def a46_pick_summary(spark, d):
    out = research.pick_summary(table(spark, d, "orders"), ["o_orderpriority"], "o_orderstatus", ["F", "O"], "o_orderkey")
    return rounded(out.select("o_orderpriority", F.col("F").alias("f"), F.col("O").alias("o")), "f", "o")


@query(f"""WITH {WEEKLY}, {RETURNS}, x AS ({SAMPLE}), r AS (SELECT *, rank() OVER (PARTITION BY grp, week ORDER BY f DESC) AS top, rank() OVER (PARTITION BY grp, week ORDER BY f) AS low FROM x)
SELECT grp, week, round(avg(CASE WHEN top <= 20 THEN l END), 7) AS best, round(avg(CASE WHEN low <= 20 THEN l END), 7) AS worst, round(avg(l), 7) AS "all" FROM r GROUP BY 1, 2""")
def c11_score_evaluation(spark, d):
    return rounded(research.score_evaluation(sample(spark, d), ["grp", "week"], "f", "l", 20), "best", "worst", "all", digits=7)


@query(f"""WITH {LONG}, s AS (SELECT * FROM (VALUES ('view', 'max', 1.5), ('click', 'max', 0.5), ('error', 'min', 1.0)) v(field, side, z)), x AS (SELECT day, key, side, z, value FROM long JOIN s ON s.field = long.field),
g AS (SELECT day, key, avg(CASE WHEN side = 'max' THEN value END) - avg(CASE WHEN side = 'min' THEN value END) AS p, avg(CASE WHEN z >= 1 THEN value END) AS e FROM x GROUP BY 1, 2)
SELECT day, key, round(p, 8) AS pillar, round(e, 8) AS extra, round((coalesce(p, 0) + coalesce(e, 0)) / nullif((p IS NOT NULL)::INT + (e IS NOT NULL)::INT, 0), 8) AS total FROM g""")
def c6_list_score(spark, d):
    rows = long_events(spark, d).withColumnRenamed("field", "factor")
    ranks = spark.createDataFrame([("view", "max", 1.5), ("click", "max", 0.5), ("error", "min", 1.0)], "factor string, side string, pred_z double")
    ranks = rows.select("day").distinct().crossJoin(F.broadcast(ranks))  # three rows
    return rounded(scores.list_score(rows, ranks, ["day"], "key"), "pillar", "extra", "total", digits=8)


@query(f"""WITH {MONTHLY_RET}, q AS (SELECT field || '_' || month(day) AS field, day, r - 0.003 AS r FROM mret WHERE r IS NOT NULL), m AS (SELECT field FROM q GROUP BY 1 HAVING avg(r) < 0)
SELECT q.field, q.day, round(CASE WHEN m.field IS NOT NULL THEN -r ELSE r END, 8) AS value FROM q LEFT JOIN m ON m.field = q.field""")
def m7_reverse_factors(spark, d):
    x = month_returns(spark, d).filter("r IS NOT NULL")
    x = x.select(F.concat_ws("_", "field", F.month("day").cast("string")).alias("field"), "day", (F.col("r") - 0.003).alias("value"))
    return rounded(training.apply_reversal(x, training.reverse_factors(x, 1)), "value", digits=8)


@query(f"""WITH {LONG}, w AS (SELECT key, day, max(CASE WHEN field = 'view' THEN value END) AS view, max(CASE WHEN field = 'error' THEN value END) AS error FROM long GROUP BY 1, 2)
SELECT a.key, a.day, a.view, b.error AS y FROM w a JOIN w b ON b.key = a.key AND b.day = a.day + 1 WHERE a.view IS NOT NULL AND b.error IS NOT NULL""")
def m11_assemble_samples(spark, d):
    w = wide(spark, d)
    y = w.filter("error IS NOT NULL").select("key", F.date_sub("day", 1).alias("day"), F.col("error").alias("y"))
    return training.assemble_samples(w.filter("view IS NOT NULL").select("key", "day", "view"), y, ["key", "day"], ["view"])


@query()
def m26_shifted_label_forest(spark, d):
    """Whether turning an output round changes a forest: one predicts the next returns
    of four brands, one the same with the first turned; how their predictions of the
    first, for rows later than training, go together and with what came, per group."""
    from .modelling import CUT, ahead

    x = ahead(spark, d).withColumn("turned", -F.col("y1"))
    train, test = x.filter(F.col("known") < CUT), x.filter((F.col("week") >= CUT) & F.col("known").isNotNull())
    plain, turned = (
        trees.multi_output_forest(train, ["grp", "week"], BRANDS, outputs, trees=10, depth=3, bins=16, min_rows=10) for outputs in (["y1", "y2", "y3", "y4"], ["y2", "y3", "y4", "turned"])
    )
    a = plain.transform(test, ["grp", "week", "y1"]).select("grp", "week", "y1", F.col("prediction")[0].alias("p"))
    b = turned.transform(test, ["grp", "week"]).select("grp", "week", F.col("prediction")[3].alias("q"))
    both = a.join(b, ["grp", "week"])
    return both.groupBy("grp").agg(correlation("p", "q").alias("together"), correlation("p", "y1").alias("plain"), correlation("q", "y1").alias("turned"), F.count("*").alias("n"))


@query("""WITH p AS (SELECT CAST(DATE '2001-10-28' - INTERVAL 8 WEEK - CAST(8 * i AS INTEGER) * INTERVAL 1 WEEK AS DATE) AS period FROM range(10) t(i))
SELECT period, count(*) AS n FROM p JOIN orders ON CAST(o_orderdate AS DATE) = period GROUP BY 1""")
def t14_cluster_periods(spark, d):
    grid = cal.period_grid(spark, "2001-11-01", 8, 10, anchor=2, name="period")
    o = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("period"))
    return o.join(F.broadcast(grid), "period").groupBy("period").agg(F.count("*").alias("n"))  # ten rows


@query(f"""WITH {WEEKLY} SELECT key, week, round(px / nullif(lag(px, 52) OVER w, 0) - 1, 7) AS px_1yr, round(px / nullif(lag(px, 12) OVER w, 0) - 1, 7) AS px_1q FROM weekly WINDOW w AS (PARTITION BY key ORDER BY week)""")
def t19_f3_growth(spark, d):
    from ..functions.formula import Formula, compile_formulas

    x = weekly(spark, d)
    made, _ = compile_formulas(x, [Formula("px_1yr", "px", "px"), Formula("px_1q", "px", "px")], cal.over(["key"], "week"))
    return x.select("key", "week", *[F.round(e, 7).alias(n) for n, e in made.items()])


@query(f"""WITH {MONTHLY} SELECT field, day, value, lag(value, 1) OVER w AS x_1, lag(value, 3) OVER w AS x_3, round(avg(value) OVER (PARTITION BY field ORDER BY day ROWS 2 PRECEDING), 6) AS ma FROM monthly WINDOW w AS (PARTITION BY field ORDER BY day)""")
def t24_t29_lag_matrix(spark, d):
    m = monthly_orders(spark, d).withColumns(cal.lags("value", ["field"], "day", [1, 3]))
    return m.withColumn("ma", F.round(F.avg("value").over(cal.trailing(["field"], "day", 3)), 6))


@query(f"""WITH {LONG}, a AS (SELECT c_custkey AS key, c_mktsegment AS currency_code FROM customer WHERE c_acctbal > 0)
SELECT l.key, day, currency_code, max(CASE WHEN field = 'view' THEN value END) AS view, max(CASE WHEN field = 'click' THEN value END) AS click
FROM long l JOIN a ON a.key = l.key WHERE field IN ('view', 'click') AND day >= DATE '2024-01-10' AND currency_code IN ('BUILDING', 'MACHINERY') GROUP BY 1, 2, 3""")
def s11_s13_factor_panel(spark, d):
    """Long rows of active keys in two groups, wide by field."""
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("ticker"), F.col("c_mktsegment").alias("currency_code"), (F.col("c_acctbal") > 0).alias("is_active"))
    rows = long_events(spark, d).select(F.col("key").cast("string").alias("ticker"), F.col("day").alias("trading_day"), "field", "value")
    out = scans.factor_panel(rows, c, ["view", "click"], ["BUILDING", "MACHINERY"], "2024-01-10")
    return out.select(F.col("ticker").cast("long").alias("key"), F.col("trading_day").alias("day"), "currency_code", "view", "click")


@query("""SELECT l_orderkey, l_linenumber, coalesce(nullif(l_discount, 0.05), 0.0) AS pred FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderpriority = '1-URGENT' AND CAST(o_orderdate AS DATE) >= DATE '1999-01-01'""")
def s18_prediction_scan(spark, d):
    """Predictions joined with the runs that made them; missing ones are zero."""
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("uid"), "l_orderkey", "l_linenumber", F.nullif("l_discount", F.lit(0.05)).alias("pred"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("uid"), F.col("o_orderpriority").alias("name_sql"), F.to_date("o_orderdate").alias("testing_period"))
    return scans.predictions(li, o, "1-URGENT", "1999-01-01", 0).select("l_orderkey", "l_linenumber", "pred")


@query(f"""WITH {MONTHLY}, p AS (SELECT DISTINCT day FROM monthly WHERE month(day) = 1), w AS (SELECT day, max(CASE WHEN field = '1-URGENT' THEN value END) AS u, max(CASE WHEN field = '5-LOW' THEN value END) AS l FROM monthly GROUP BY 1)
SELECT w.day, u, l FROM w JOIN p ON p.day = w.day""")
def s17_s14_premium_matrix(spark, d):
    m = monthly_orders(spark, d)
    premium = m.select(F.lit("g").alias("group"), F.col("day").alias("testing_period"), "field", F.lit(4).alias("weeks_to_expire"), F.lit(-7).alias("average_days"), "value")
    periods = m.filter(F.month("day") == 1).select(F.col("day").alias("testing_period")).distinct()
    out = scans.premium_matrix(premium, periods, ["g"], 4, ["1-URGENT", "5-LOW"])
    return out.select(F.col("testing_period").alias("day"), F.col("1-URGENT").alias("u"), F.col("5-LOW").alias("l"))


@query(f"""WITH {MONTHLY}, b AS (SELECT day, avg(value) AS macro FROM monthly GROUP BY 1) SELECT m.field, m.day, m.value, round(b.macro, 6) AS macro FROM monthly m JOIN b ON b.day = m.day""")
def j10_complete_inner(spark, d):
    m = monthly_orders(spark, d)
    return rounded(joins.complete_inner(m, m.groupBy("day").agg(F.avg("value").alias("macro")), ["day"]), "macro")


@query("""SELECT o_custkey, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS n_now, sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS n_past FROM orders GROUP BY 1
HAVING sum(CASE WHEN o_orderstatus IN ('F', 'O') THEN 1 ELSE 0 END) > 0""")
def j15_outer_with_suffix(spark, d):
    n = lambda s: table(spark, d, "orders").filter(F.col("o_orderstatus") == s).groupBy("o_custkey").agg(F.count("*").alias("n"))
    return joins.outer_with_suffix(n("F"), n("O"), ["o_custkey"], "_now", "_past").na.fill(0, ["n_now", "n_past"])


@query("""SELECT t.o_orderkey, CASE WHEN v.o_orderpriority = '5-LOW' THEN 1 ELSE 0 END AS hit, round(t.o_totalprice / 2.0, 6) AS half FROM orders t JOIN orders v ON v.o_orderkey = t.o_orderkey""")
def j9_self_join(spark, d):
    o = table(spark, d, "orders")
    v = o.select("o_orderkey", (F.col("o_orderpriority") == "5-LOW").cast("int").alias("hit"))
    return o.join(v, "o_orderkey").select("o_orderkey", "hit", F.round(ratio(F.col("o_totalprice"), F.lit(2.0)), 6).alias("half"))
