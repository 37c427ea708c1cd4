"""Queries of selection, scoring and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean, evaluate, research, scores
from ..operators.buckets import day_cells
from ..operators.calendar import run_days
from ..operators.reshape import to_map
from ..sources.scans import table
from ..sources.sinks import PartitionedTable, SnapshotTable, settle
from . import query
from .proxies import LONG, WEEKLY, long_events, rounded, weekly
from .panels import RETURNS, factor_runs, returns

#: Predictions of factors: parts as factors, type and size as configuration.
PRED = """pred AS (SELECT p_type AS cfg, p_size AS period, p_partkey AS factor_name, p_brand AS subpillar,
  ((p_partkey * 7919) % 2003 - 1000) / 1000.0::DOUBLE AS pred, CASE WHEN p_partkey % 11 > 0 THEN ((p_partkey * 104729) % 1999 - 1000) / 1000.0::DOUBLE END AS actual FROM part)"""


def predictions(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select(
        F.col("p_type").alias("cfg"), F.col("p_size").alias("period"), k.alias("factor_name"), F.col("p_brand").alias("subpillar"),
        ((k * 7919 % 2003 - 1000) / 1000.0).alias("pred"), F.when(k % 11 > 0, (k * 104729 % 1999 - 1000) / 1000.0).alias("actual"),
    )


SIDES = """sides AS (SELECT *, CASE WHEN count(pred) OVER w = 1 THEN CASE WHEN pred > 0.005 THEN 'max' WHEN pred < -0.005 THEN 'min' END
  WHEN pred > quantile_cont(pred, 0.67) OVER w THEN 'max' WHEN pred < quantile_cont(pred, 0.33) OVER w THEN 'min' END AS side FROM pred WINDOW w AS (PARTITION BY cfg, period))"""
BEST = """best AS (SELECT * FROM sides WHERE side IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY cfg, period, side, subpillar ORDER BY CASE WHEN side = 'max' THEN -pred ELSE pred END, factor_name) = 1)"""


#: Yeo-Johnson as SQL.
POWER = """CASE WHEN {z} >= 0 THEN CASE WHEN abs({lam}) < 1e-9 THEN ln(1 + {z}) ELSE ((1 + {z}) ** {lam} - 1) / {lam} END
ELSE CASE WHEN abs({lam} - 2) < 1e-9 THEN -ln(1 - {z}) ELSE -((1 - {z}) ** (2 - {lam}) - 1) / (2 - {lam}) END END"""


def exponent_sql(rows: str, keys: str, x: str) -> str:
    """The search for the power transform's exponent per group, round by round: 17
    exponents around the best so far, then between its neighbours."""
    parts, step, i = [f"b0 AS (SELECT DISTINCT {keys}, 0.0::DOUBLE AS lam FROM {rows})"], 4.0, 0
    while True:
        at = f"(lam + {step} * k)"
        parts += [
            f"y{i} AS (SELECT {keys}, {at} AS l, {POWER.format(z=x, lam=at)} AS y, sign({x}) * ln(1 + abs({x})) AS j FROM {rows} JOIN b{i} USING ({keys}), range(-8, 9) t(k))",
            f"l{i} AS (SELECT {keys}, l, CASE WHEN var_pop(y) > 0 THEN -count(*) / 2.0 * ln(var_pop(y)) + (l - 1) * sum(j) END AS ll FROM y{i} GROUP BY {keys}, l)",
            f"b{i + 1} AS (SELECT {keys}, l AS lam FROM l{i} QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY ll DESC NULLS LAST, abs(l - 1), l DESC) = 1)",
        ]
        i += 1
        if step <= 2e-5:
            return ", ".join(parts) + f", b AS (SELECT * FROM b{i})"
        step = step / 8 if i >= 3 else step




@query(f"WITH {PRED}, {SIDES} SELECT cfg, period, factor_name, side FROM sides")
def a10_a11_good_and_bad(spark, d):
    return evaluate.good_and_bad(predictions(spark, d), ["cfg", "period"]).select("cfg", "period", "factor_name", "side")


@query(f"WITH {PRED}, {SIDES}, {BEST} SELECT cfg, period, side, subpillar, factor_name FROM best")
def a12_one_per_subpillar(spark, d):
    marked = evaluate.good_and_bad(predictions(spark, d), ["cfg", "period"])
    return evaluate.one_per_subpillar(marked, ["cfg", "period"]).select("cfg", "period", "side", "subpillar", "factor_name")


@query(f"""WITH {PRED}, x AS (SELECT cfg, pred AS p, pred - actual AS d FROM pred WHERE actual IS NOT NULL)
SELECT cfg, round(avg(abs(d)), 8) AS mae, round(avg(d * d), 8) AS mse, round(1 - sum(d * d) / (var_pop(p) * count(*)), 8) AS r2 FROM x GROUP BY 1""")
def a13_accuracy(spark, d):
    return rounded(predictions(spark, d).groupBy("cfg").agg(*evaluate.accuracy()), "mae", "mse", "r2", digits=8)


@query(f"""WITH {PRED}, {SIDES}, {BEST}, g AS (SELECT cfg, period, avg(actual) AS actual FROM pred GROUP BY 1, 2),
m AS (SELECT cfg, period, array_to_string(list_sort(list(factor_name)), ',') AS f, avg(actual) AS r FROM best WHERE side = 'max' GROUP BY 1, 2),
n AS (SELECT cfg, period, array_to_string(list_sort(list(factor_name)), ',') AS f, avg(actual) AS r FROM best WHERE side = 'min' GROUP BY 1, 2)
SELECT g.cfg, g.period, round(g.actual, 8) AS actual, m.f AS max_factor, n.f AS min_factor, round(m.r, 8) AS max_ret, round(n.r, 8) AS min_ret FROM g
LEFT JOIN m ON m.cfg = g.cfg AND m.period = g.period LEFT JOIN n ON n.cfg = g.cfg AND n.period = g.period""")
def a14_group_summary(spark, d):
    from ..plans.jobs import evaluation_job

    out = evaluation_job(predictions(spark, d), ["cfg", "period"])
    lists = {c: F.array_join(c, ",") for c in ("max_factor", "min_factor")}
    out = out.withColumns(lists).select("cfg", "period", "actual", "max_factor", "min_factor", "max_ret", "min_ret")
    return rounded(out, "actual", "max_ret", "min_ret", digits=8)


#: Configurations: market segments by nation; periods are quarters.
CONF = """conf AS (SELECT c_mktsegment AS grp, c_nationkey % 5 AS cfg, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS period, avg(o_custkey) AS metric, avg(o_orderkey) AS ret
  FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2, 3)"""


def configs(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("grp"), (F.col("c_nationkey") % 5).alias("cfg"))
    o = table(spark, d, "orders").join(c, "o_custkey")
    return o.groupBy("grp", "cfg", F.to_date(F.date_trunc("quarter", "o_orderdate")).alias("period")).agg(F.avg("o_custkey").alias("metric"), F.avg("o_orderkey").alias("ret"))


@query(f"""WITH {CONF}, p AS (SELECT *, CASE WHEN count(metric) OVER w = 3 THEN avg(metric) OVER w END AS past FROM conf WINDOW w AS (PARTITION BY grp, cfg ORDER BY period ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)),
q AS (SELECT *, quantile_cont(round(past, 7), 0.5) OVER (PARTITION BY grp, period) AS t FROM p)
SELECT grp, cfg, period, round(past, 5) AS past FROM q WHERE round(past, 7) >= round(t, 7)""")
def a16_top_configs(spark, d):
    out = evaluate.top_configs(configs(spark, d), ["grp"], ["cfg"], "period", "metric", 3, 0.5)
    return rounded(out.select("grp", "cfg", "period", "past"), "past", digits=5)


@query(f"""WITH {CONF}, u AS (SELECT grp, cfg, period, ret, metric, 2 AS n, CASE WHEN count(metric) OVER a = 2 THEN avg(metric) OVER a END AS past FROM conf WINDOW a AS (PARTITION BY grp, cfg ORDER BY period ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING)
  UNION ALL SELECT grp, cfg, period, ret, metric, 4, CASE WHEN count(metric) OVER b = 4 THEN avg(metric) OVER b END FROM conf WINDOW b AS (PARTITION BY grp, cfg ORDER BY period ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, quantile_cont(past, 0.75) OVER (PARTITION BY grp, period, n) AS hi, quantile_cont(past, 0.5) OVER (PARTITION BY grp, period, n) AS mid FROM u WHERE past IS NOT NULL),
l AS (SELECT grp, n, 0.25 AS share, ret FROM t WHERE past >= hi - 1e-7 UNION ALL SELECT grp, n, 0.5, ret FROM t WHERE past >= mid - 1e-7)
SELECT grp, n, share, round(avg(ret), 4) AS ret, count(ret) AS picks FROM l GROUP BY 1, 2, 3""")
def a44_grid_backtest(spark, d):
    out = research.grid_backtest(configs(spark, d), ["grp"], ["cfg"], "period", "metric", "ret", [2, 4], [0.25, 0.5])
    return rounded(out, "ret", digits=4)


@query("""WITH l AS (SELECT o_orderpriority AS grp, o_custkey, list(DISTINCT p_brand) AS names FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2),
t AS (SELECT grp, count(*) AS configs FROM l GROUP BY 1), c AS (SELECT grp, unnest(names) AS factor FROM l), v AS (SELECT grp, factor, count(*) AS votes FROM c GROUP BY 1, 2),
s AS (SELECT v.grp, v.factor, votes, configs, share FROM v JOIN t ON t.grp = v.grp, (SELECT unnest([0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1, 0.0])::DOUBLE AS share)),
k AS (SELECT grp, share FROM s GROUP BY 1, 2 HAVING sum((votes >= share * configs)::INT) >= 0.33 * count(*)), b AS (SELECT grp, max(share) AS share FROM k GROUP BY 1)
SELECT v.grp, v.factor, votes, configs, share, votes >= 0.9 * configs AS is_extra FROM v JOIN t ON t.grp = v.grp JOIN b ON b.grp = v.grp WHERE votes >= share * configs""")
def a17_vote(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("grp"))
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey"))
    rows = o.join(li, "o_orderkey").join(table(spark, d, "part").select("p_partkey", "p_brand"), "p_partkey")
    lists = rows.groupBy("grp", "o_custkey").agg(F.collect_set("p_brand").alias("names"))
    return evaluate.vote(lists, ["grp"], "names").select("grp", "factor", "votes", "configs", "share", "is_extra")


@query("""WITH o AS (SELECT o_orderpriority AS grp, o_custkey % 7 AS cfg, avg(o_custkey) AS max_ret, avg(o_orderkey) / 10 AS min_ret FROM orders GROUP BY 1, 2)
SELECT grp, round(avg(max_ret), 6) AS max_ret, round(avg(min_ret), 6) AS min_ret, round(avg(max_ret - min_ret), 6) AS net_ret, round(avg((2 * max_ret - min_ret) / 2), 6) AS avg_ret FROM o GROUP BY 1""")
def a15_combine_pillars(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("grp"), (F.col("o_custkey") % 7).alias("cfg"))
    rows = o.agg(F.avg("o_custkey").alias("max_ret"), (F.avg("o_orderkey") / 10).alias("min_ret"))
    rows = rows.withColumns({"max_factor": F.array(F.col("cfg").cast("string")), "min_factor": F.array(F.lit("x"))})
    out = evaluate.combine_pillars(rows, ["grp"]).drop("max_factor", "min_factor")
    return rounded(out, "max_ret", "min_ret", "net_ret", "avg_ret")


@query(f"""WITH {WEEKLY}, {RETURNS}, x AS (SELECT grp, week, key, factor AS v FROM ret WHERE factor IS NOT NULL),
q AS (SELECT grp, week, quantile_cont(v, [0.25, 0.5, 0.75]) AS q FROM x GROUP BY 1, 2),
r AS (SELECT x.*, (v - q[2]) / CASE WHEN q[3] - q[1] > 0 THEN q[3] - q[1] ELSE 1 END AS s FROM x JOIN q ON q.grp = x.grp AND q.week = x.week)
SELECT grp, week, key, round((s - min(s) OVER w) / CASE WHEN max(s) OVER w - min(s) OVER w > 0 THEN max(s) OVER w - min(s) OVER w ELSE 1 END * 10, 7) AS score FROM r WINDOW w AS (PARTITION BY grp, week)""")
def c4_robust_min_max(spark, d):
    x = returns(spark, d).filter("factor IS NOT NULL").select("grp", "week", "key", F.col("factor").alias("v"))
    return scores.robust_min_max(x, ["grp", "week"], "v").select("grp", "week", "key", F.round("v", 7).alias("score"))


@query(f"""WITH {WEEKLY}, {RETURNS}, x AS (SELECT grp, week, key, factor AS v FROM ret WHERE factor IS NOT NULL),
p AS (SELECT grp, week, avg(v) AS u, stddev_pop(v) AS d FROM x GROUP BY 1, 2),
s AS (SELECT x.grp, x.week, key, (v - u) / CASE WHEN d > 0 THEN d ELSE 1 END AS z FROM x JOIN p ON p.grp = x.grp AND p.week = x.week),
q AS (SELECT grp, week, quantile_cont(z, 0.01) AS a, quantile_cont(z, 0.99) AS b FROM s GROUP BY 1, 2),
c AS (SELECT s.grp, s.week, key, least(greatest(z, a), b) AS z FROM s JOIN q ON q.grp = s.grp AND q.week = s.week),
m AS (SELECT grp, week, avg(z) AS u, stddev_pop(z) AS d FROM c GROUP BY 1, 2),
k AS (SELECT c.grp, c.week FROM c JOIN m ON m.grp = c.grp AND m.week = c.week GROUP BY 1, 2 HAVING abs(avg(((z - u) / nullif(d, 0)) ** 3)) > 5),
z1 AS (SELECT c.* FROM c JOIN k USING (grp, week)), {exponent_sql("z1", "grp, week", "z")},
t AS (SELECT c.grp, c.week, key, CASE WHEN lam IS NULL THEN z ELSE {POWER.format(z="z", lam="lam")} END AS z FROM c LEFT JOIN b ON b.grp = c.grp AND b.week = c.week),
n AS (SELECT grp, week, avg(z) AS u, stddev_pop(z) AS d FROM t GROUP BY 1, 2),
o AS (SELECT t.grp, t.week, key, least(greatest(z, u - 2 * d), u + 2 * d) AS z FROM t JOIN n ON n.grp = t.grp AND n.week = t.week),
r AS (SELECT grp, week, min(z) AS a, max(z) - min(z) AS w FROM o GROUP BY 1, 2)
SELECT o.grp, o.week, 'mom' AS field, key, round(10 - (z - a) / CASE WHEN w > 0 THEN w ELSE 1 END * 10, 3) AS value FROM o JOIN r ON r.grp = o.grp AND r.week = o.week""")
def c1_c2_c3_fundamental_score(spark, d):
    """The whole score."""
    runs = settle(factor_runs(spark, d).withColumn("field", F.lit("mom")), "factor-runs")
    # equal runs are counted before weeks are made
    counted = day_cells(runs, ["grp", "field"], "week", ["value"], 7).groupBy("grp", "week", "field", "value").agg(F.sum("n").alias("n"))
    x = run_days(runs, "week", 7).select("grp", "week", "field", "key", "value")
    return rounded(scores.fundamental_score(x, ["grp", "week", "field"], counted=counted), "value", digits=3)


@query(f"""WITH x AS (SELECT o_orderpriority AS p, o_orderstatus AS s, pow(o_totalprice / 100000, 3) - 5 AS x FROM orders), {exponent_sql("x", "p, s", "x")} SELECT p, s, round(lam, 3) AS lam FROM b""")
def c3_exponents(spark, d):
    """The exponents that make cubed prices most normal, per priority and status."""
    x = table(spark, d, "orders").select(F.col("o_orderpriority").alias("p"), F.col("o_orderstatus").alias("s"), (F.pow(F.col("o_totalprice") / 100000, F.lit(3)) - 5).alias("x"))
    return rounded(scores.best_lambda(x, ["p", "s"], "x"), "lam", digits=3)


@query(f"""WITH {LONG}, q AS (SELECT field, quantile_cont(value, 0.01) AS a, quantile_cont(value, 0.99) AS b FROM long GROUP BY 1)
SELECT key, day, l.field, round(least(greatest(value, a), b), 7) AS value FROM long l JOIN q ON q.field = l.field""")
def c2_clip_by_factor(spark, d):
    return rounded(scores.clip_quantiles(long_events(spark, d), ["field"], "value", 0.01, 0.99, few=True), "value", digits=7)


@query(f"""WITH {LONG}, q AS (SELECT key, day, quantile_cont(value, 0.0001) AS a, quantile_cont(value, 0.0099) AS b FROM long GROUP BY 1, 2)
SELECT l.key, l.day, field, round(least(greatest(value, a), b), 7) AS value FROM long l JOIN q ON q.key = l.key AND q.day = l.day""")
def c2_clip_by_ticker(spark, d):
    """The bounds as the pipeline applies them: across a ticker's factors."""
    return rounded(scores.clip_quantiles(long_events(spark, d), ["key", "day"], "value", 0.0001, 0.0099), "value", digits=7)


@query(f"""WITH {LONG}, m AS (SELECT field, avg(value) AS u, stddev_pop(value) AS s FROM long GROUP BY 1),
k AS (SELECT l.field, abs(avg(((value - u) / nullif(s, 0)) ** 3)) > 5 AS strong FROM long l JOIN m ON m.field = l.field GROUP BY 1),
x AS (SELECT key, day, l.field, CASE WHEN strong THEN ln(1 + greatest(value, 0)) ELSE value END AS v FROM long l JOIN k ON k.field = l.field),
q AS (SELECT field, median(v) AS m, stddev_pop(v) AS s FROM x GROUP BY 1), c AS (SELECT key, day, x.field, CASE WHEN v IS NOT NULL THEN least(greatest(v, m - 2 * s), m + 2 * s) END AS v FROM x JOIN q ON q.field = x.field),
r AS (SELECT field, min(v) AS a, max(v) - min(v) AS z FROM c GROUP BY 1), y AS (SELECT key, day, c.field, (v - a) / CASE WHEN z > 0 THEN z ELSE 1 END * 10 AS v FROM c JOIN r ON r.field = c.field)
SELECT key, day, field, round(coalesce(v, 0.9 * avg(v) OVER (PARTITION BY field)), 6) AS value FROM y""")
def c5_plain_score(spark, d):
    """The older score, by event type."""
    return rounded(scores.plain_score(long_events(spark, d), ["field"], few=True), "value")


@query(f"""WITH {LONG}, w AS (SELECT key, day, max(CASE WHEN field = 'view' THEN value END) AS view, max(CASE WHEN field = 'error' THEN value END) AS ret FROM long GROUP BY 1, 2)
SELECT key, day, round(coalesce(view, avg(view) OVER (PARTITION BY day) * 0.9), 8) AS score FROM w WHERE ret IS NOT NULL""")
def c7_penalize_missing(spark, d):
    from .shaping import wide

    x = wide(spark, d).select("key", "day", F.col("view").alias("score"), F.col("error").alias("ret")).filter("ret IS NOT NULL")
    return rounded(scores.penalize_missing(x, ["day"], "score", "ret").select("key", "day", "score"), "score", digits=8)


@query(f"""WITH {LONG}, s AS (SELECT * FROM (VALUES ('view', 'max'), ('click', 'max'), ('error', 'min')) v(field, side)), x AS (SELECT key, day, side, value FROM long JOIN s ON s.field = long.field)
SELECT day, key, round(5 + avg(CASE WHEN side = 'max' THEN value END) - coalesce(avg(CASE WHEN side = 'min' THEN value END), 0), 8) AS score FROM x GROUP BY 1, 2""")
def c8_pillar_score(spark, d):
    rows = long_events(spark, d).withColumnRenamed("field", "factor")
    picked = spark.createDataFrame([("view", "max"), ("click", "max"), ("error", "min")], "factor string, side string")
    selected = rows.select("day").distinct().crossJoin(F.broadcast(picked))  # three rows
    return rounded(scores.pillar_score(rows, selected, ["day"], "key", "net_ret"), "score", digits=8)


@query(f"""WITH {LONG}, w AS (SELECT key, avg(CASE WHEN field = 'view' THEN value END) AS v, avg(CASE WHEN field = 'click' THEN value END) AS c, avg(CASE WHEN field = 'error' THEN value END) AS e, avg(CASE WHEN field = 'signup' THEN value END) AS s FROM long GROUP BY 1),
x AS (SELECT *, (coalesce(e, 0) + coalesce(s, 0)) / nullif((e IS NOT NULL)::INT + (s IS NOT NULL)::INT, 0) AS extra FROM w)
SELECT key, round(extra, 8) AS extra_score, round((coalesce(v, 0) + coalesce(c, 0) + coalesce(extra, 0)) / nullif((v IS NOT NULL)::INT + (c IS NOT NULL)::INT + (extra IS NOT NULL)::INT, 0), 8) AS ai_score FROM x""")
def c9_final_score(spark, d):
    from .shaping import wide

    names = {"view": "a_score", "click": "b_score", "error": "a_score_extra", "signup": "b_score_extra"}
    out = scores.final_score(wide(spark, d).withColumnsRenamed(names), ["key"], ["a", "b"])
    return rounded(out.select("key", "extra_score", "ai_score"), "extra_score", "ai_score", digits=8)


@query("""WITH r AS (SELECT p_type AS grp, p_brand AS factor, count(*) AS n FROM part WHERE p_type <> 'PROMO' AND p_brand < 'Brand#15' GROUP BY 1, 2)
SELECT * FROM r UNION ALL SELECT 'PROMO', factor, n FROM r WHERE grp = 'ECONOMY'""")
def c10_backfill_ranks(spark, d):
    p = table(spark, d, "part").withColumnRenamed("p_type", "grp")
    ranks = p.filter("grp <> 'PROMO' AND p_brand < 'Brand#15'").groupBy("grp", F.col("p_brand").alias("factor")).agg(F.count("*").alias("n"))
    return scores.backfill_ranks(ranks, p, "grp", "ECONOMY")


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN -1.0 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderstatus <> 'P' OR o_orderpriority = '5-LOW'""")
def s25_upsert(spark, d):
    """Keyed update of a table in parts: urgent rows replace their old state."""
    from ..sources.sinks import working_folder

    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    store = PartitionedTable(spark, working_folder(spark, "upsert"), F.pmod(F.xxhash64("o_orderkey"), F.lit(16)))
    store.upsert(o.filter("o_orderstatus <> 'P'").select("o_orderkey", "o_totalprice"), ["o_orderkey"])
    store.upsert(o.filter("o_orderpriority = '5-LOW'").select("o_orderkey", F.lit(-1.0).alias("o_totalprice")), ["o_orderkey"])
    return store.read()


@query("""WITH b AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, o_orderkey, o_orderpriority AS p FROM orders), n AS (SELECT * FROM b WHERE p = '5-LOW' AND day BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'),
s AS (SELECT min(day) AS a, max(day) AS z FROM n)
SELECT b.* FROM b, s WHERE NOT (day BETWEEN a AND z AND o_custkey IN (SELECT o_custkey FROM n)) UNION ALL SELECT * FROM n""")
def s26_replace_range(spark, d):
    from ..sources.sinks import working_folder

    o = table(spark, d, "orders").select("o_custkey", F.to_date("o_orderdate").alias("day"), "o_orderkey", F.col("o_orderpriority").alias("p"))
    store = SnapshotTable(spark, working_folder(spark, "range"))
    store.replace_range(o, "day", ["o_custkey"])
    new = o.filter("p = '5-LOW' AND day BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'")
    store.replace_range(new, "day", ["o_custkey"])
    return store.read()


@query("""SELECT o_orderpriority, n FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1) x, (VALUES (1), (2)) v(i)""")
def s27_s28_s29_append_and_history(spark, d):
    """Appended twice as history, written and read as CSV."""
    from ..sources.scans import csv_table
    from ..sources.sinks import export_csv, history, working_folder

    n = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    folder = working_folder(spark, "history")
    history(n, folder, "2024-01-01 00:00:00")
    history(n, folder, "2024-01-08 00:00:00")
    export_csv(spark.read.parquet(folder).select("o_orderpriority", "n"), f"{folder}-csv")
    return csv_table(spark, f"{folder}-csv", "o_orderpriority string, n long")


@query("""SELECT p_type AS pillar, count(*) AS n FROM part WHERE p_type LIKE 'S%' GROUP BY 1""")
def p7_s19_pillar_filter(spark, d):
    p = table(spark, d, "part").withColumn("pillar", F.when(F.col("p_type").startswith("S"), F.concat(F.lit("pillar_"), "p_type")).otherwise(F.col("p_type")))
    out = clean.pillar_filter(p, "cluster").groupBy("pillar").agg(F.count("*").alias("n"))
    return out.withColumn("pillar", F.substring("pillar", 8, 99))


@query(f"""WITH {WEEKLY}, w AS (SELECT key, brand, count(*) AS n FROM weekly GROUP BY 1, 2) SELECT brand, array_to_string(list_sort(list(key || ':' || n)), ',') AS m FROM w GROUP BY 1""")
def r6_r10_brand_maps(spark, d):
    w = weekly(spark, d).groupBy("key", "brand").agg(F.count("*").alias("n"))
    maps = w.groupBy("brand").agg(to_map("key", "n").alias("m"))
    entries = F.transform(F.map_entries("m"), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string")))
    return maps.select("brand", F.array_join(F.sort_array(entries), ",").alias("m"))
