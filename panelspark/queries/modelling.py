"""Queries of sample preparation and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calendar as cal
from ..operators.buckets import fixed_cut, quantile_edges
from ..plans import boosting, linear, models, training, trees
from ..sources.scans import table
from . import query
from .panels import BRANDS, RETURNS, brand_panel, brand_premiums, returns
from .proxies import MONTHLY, WEEKLY, monthly_orders, rounded

FACTORS = [f"f{i}" for i in range(64)]


def matrix(spark, d):
    """All components of the embeddings as factor columns."""
    e = table(spark, d, "embeddings")
    return e.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f) for i, f in enumerate(FACTORS)])


def vectors(spark, d, labels: int):
    """The first components as label columns, all others as the vector ``features``."""
    from pyspark.ml.functions import array_to_vector

    e = table(spark, d, "embeddings").filter("embedding IS NOT NULL")
    first = [F.col("embedding")[i].cast("double").alias(f) for i, f in enumerate(FACTORS[:labels])]
    rest = F.slice("embedding", labels + 1, len(FACTORS) - labels).cast("array<double>")
    return e.select("vec_id", "label", *first, array_to_vector(rest).alias("features"))


@query(f"""WITH {MONTHLY} SELECT field, day, CASE WHEN day = DATE '2001-01-01' THEN 'test' ELSE 'train' END AS part FROM monthly
WHERE day = DATE '2001-01-01' OR (day <= DATE '2001-01-01' - INTERVAL 28 DAY AND day >= DATE '1997-01-01')""")
def m1_split_by_period(spark, d):
    train, test = training.split_by_period(monthly_orders(spark, d).select("field", "day"), "day", "2001-01-01", 4, 4)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query(f"""WITH {MONTHLY}, y AS (SELECT field, CAST(day - INTERVAL 28 DAY AS DATE) AS d2, value FROM monthly), x AS (SELECT field, CAST(day + INTERVAL 3 DAY AS DATE) AS day FROM monthly)
SELECT x.field, x.day, y.value FROM x LEFT JOIN y ON y.field = x.field AND y.d2 = x.day""")
def m2_t20_shift_labels(spark, d):
    m = monthly_orders(spark, d)
    x = m.select("field", F.date_add("day", 3).alias("day"))
    return x.join(training.shift_labels(m, "day", 4), ["field", "day"], "left")


@query("""WITH t AS (SELECT o_orderkey, o_totalprice AS v FROM orders WHERE o_orderstatus <> 'P'), q AS (SELECT quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.5) AS b, quantile_cont(v, 0.75) AS c FROM t),
s AS (SELECT o_orderkey, v, (v > a)::INT + (v > b)::INT + (v > c)::INT AS bin FROM t, q)
SELECT o_orderkey, bin, round(median(v) OVER (PARTITION BY bin), 4) AS cut FROM s""")
def m3_cut_labels(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("v"), "o_orderstatus")
    train, _ = training.cut_labels(o.filter("o_orderstatus <> 'P'"), o.filter("o_orderstatus = 'P'"), "v", 4)
    return train.select("o_orderkey", F.col("v_bin").alias("bin"), F.round("v_cut", 4).alias("cut"))


@query(f"""WITH {MONTHLY}, r AS (SELECT field, day, value / nullif(lag(value) OVER (PARTITION BY field ORDER BY day), 0) - 1 - 0.003 AS r FROM monthly), q AS (SELECT field || '_' || month(day) AS f, r FROM r)
SELECT f AS field, round(avg(r), 8) AS mean FROM q GROUP BY 1 HAVING avg(r) < 0""")
def m4_reversed_by_mean(spark, d):
    from .distribution import month_returns

    m = month_returns(spark, d).select(F.concat_ws("_", "field", F.month("day").cast("string")).alias("field"), (F.col("r") - 0.003).alias("value"))
    return rounded(training.reversed_by_mean(m), "mean", digits=8)


@query("""SELECT p_brand || p_type AS name FROM (SELECT DISTINCT p_brand, p_type FROM part) WHERE NOT (CASE WHEN p_brand < 'Brand#20' THEN p_type < 'M' ELSE NOT p_type < 'M' END)""")
def m6_reversed_by_rule(spark, d):
    p = table(spark, d, "part").select("p_brand", "p_type").distinct().withColumn("name", F.concat("p_brand", "p_type"))
    formulas = p.select("name", F.when(F.col("p_brand") < "Brand#20", F.lit(None).cast("boolean")).otherwise(False).alias("smb_positive"))
    return training.reversed_by_rule(formulas, p.select("name", (F.col("p_type") < "M").alias("follow_heuristic")))


@query("""SELECT o_orderkey, CASE WHEN d >= DATE '1999-01-01' AND d < DATE '1999-01-01' + 200 THEN 'valid' WHEN d < DATE '1999-01-01' - 100 OR d >= DATE '1999-01-01' + 200 THEN 'train' END AS part
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""")
def m9_validation_split(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return training.validation_split(o, "day", 1999, 0.1, 2000).select("o_orderkey", "part")


@query(f"""WITH {MONTHLY}, c AS (SELECT quantile_cont(n, 0.8) AS c FROM (SELECT DISTINCT date_diff('day', DATE '1970-01-01', day) AS n FROM monthly))
SELECT field, day, CASE WHEN date_diff('day', DATE '1970-01-01', day) > c THEN 'valid' ELSE 'train' END AS part FROM monthly, c""")
def m10_chronological_split(spark, d):
    return training.chronological_split(monthly_orders(spark, d).select("field", "day"), "day", 0.2)


@query("""SELECT p, c, o AS objective, k AS trees FROM (SELECT DISTINCT o_orderpriority AS p, o_orderstatus AS c FROM orders WHERE o_orderstatus <> 'P'), (VALUES ('mse'), ('mae')) a(o), (VALUES (10), (50), (100)) b(k)""")
def j8_j13_option_product(spark, d):
    configs = table(spark, d, "orders").select(F.col("o_orderpriority").alias("p"), F.col("o_orderstatus").alias("c")).distinct()
    grid = training.option_grid(spark, {"objective": ["mse", "mae"], "trees": [10, 50, 100]})
    from ..operators.joins import not_in, product

    done = configs.filter("c = 'P'").select("c").distinct()
    return not_in(product(configs, grid), done, ["c"]).withColumn("trees", F.col("trees").cast("int")).select("p", "c", "objective", "trees")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN (l_discount - 0.05 + l_tax - 0.04) / 2 < 0 THEN 0.4 ELSE 0.6 END * CASE WHEN CAST(l_shipdate AS DATE) BETWEEN DATE '1998-01-01' AND DATE '1998-12-31' THEN 2.0 ELSE 1.0 END AS weight FROM lineitem""")
def m13_sample_weights(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("day"), (F.col("l_discount") - 0.05).alias("a"), "l_tax")
    # one column holds the row's whole return, so that both sides add in the same order
    li = li.withColumn("r", (F.col("a") + F.col("l_tax") - 0.04) / 2)
    w = training.ranged_weight(training.sample_weight(["r"], 0.4), "day", [("1998-01-01", "1998-12-31", 2.0)])
    return li.select("l_orderkey", "l_linenumber", w.alias("weight"))


@query(f"""WITH {WEEKLY}, {RETURNS}, x AS (SELECT grp, week, key, factor AS p, label AS a FROM ret WHERE factor IS NOT NULL AND label IS NOT NULL),
r AS (SELECT row_number() OVER (PARTITION BY grp, week ORDER BY a, key) - row_number() OVER (PARTITION BY grp, week ORDER BY p, key) AS d FROM x)
SELECT round(avg(CASE WHEN d > 0 THEN abs(d) ELSE d * d END), 6) AS rank_error FROM r""")
def m17_rank_error(spark, d):
    x = returns(spark, d).dropna(subset=["factor", "label"])
    return rounded(training.rank_error(x, ["grp", "week"], "factor", "label", "key"), "rank_error")


@query("""WITH e AS (SELECT i, embedding[2 * i + 1]::DOUBLE AS p, embedding[2 * i + 2]::DOUBLE AS a FROM embeddings, range(32) t(i)),
o AS (SELECT i, avg(abs(p - a)) AS mae, avg((p - a) * (p - a)) AS mse, 1 - sum((p - a) * (p - a)) / (var_pop(a) * count(*)) AS r2 FROM e GROUP BY 1)
SELECT round(avg(mae), 6) AS mae, round(avg(mse), 6) AS mse, round(avg(r2), 6) AS r2 FROM o""")
def m16_metrics(spark, d):
    """Even components as predictions of odd ones, averaged over 32 outputs."""
    return rounded(models.mean_metrics(matrix(spark, d), list(zip(FACTORS[::2], FACTORS[1::2]))), "mae", "mse", "r2")


@query()
def m8_principal_components(spark, d):
    """Components of standardized factors."""
    from pyspark.ml.functions import vector_to_array

    m = matrix(spark, d)
    transform, k, _ = models.principal_components(m, FACTORS, 0.6)
    out = transform(m).withColumn("c", vector_to_array("features"))
    return out.select("vec_id", *[F.col("c")[i].alias(f"pc{i}") for i in range(k)])


@query()
def m5_lasso_signs(spark, d):
    """The next four-week premium of each brand by a Lasso of its own."""
    x = brand_premiums(spark, d)
    return linear.lasso_forecasts(x, "brand", "week", "value", 1e-4, 12, 4)


@query()
def m14_m15_m19_forest_predictions(spark, d):
    """The best of sampled forests for two factors: predictions of the last fifth of
    the rows, which no model has seen."""
    m = vectors(spark, d, 2).withColumn("weight", F.when(F.col("f0") < 0, 0.4).otherwise(0.6))
    options = {
        "numTrees": [3, 5, 8], "maxDepth": [3, 4, 5], "minInstancesPerNode": [1, 5, 10], "minInfoGain": [0.0, 1e-4],
        "subsamplingRate": [0.7, 1.0], "featureSubsetStrategy": ["onethird", "sqrt"], "maxBins": [16, 32],
    }
    end = m.agg(F.max("vec_id")).first()[0] or 0
    train, valid, test = (m.filter(F.col("vec_id").between(a, b)) for a, b in ((0, 0.6 * end), (0.6 * end + 1, 0.8 * end), (0.8 * end + 1, end)))
    best = models.forests(train, valid, ["f0", "f1"], models.sample_grid(options, 10), weight="weight")
    out = None
    for name, (model, _, _) in best.items():
        rows = model.transform(test).select("vec_id", F.lit(name).alias("factor_name"), F.col(name).alias("actual"), F.col("prediction").alias("pred"))
        out = rows if out is None else out.unionByName(rows)
    return out


def ahead(spark, d, weeks: int = 4):
    """The brand panel with every brand's return ``weeks`` rows later (y1 ... y25)
    and the week that is known in."""
    w = cal.over(["grp"], "week")
    later = {f"y{b[1:]}": F.lead(b, weeks).over(w) for b in BRANDS}
    return brand_panel(spark, d).withColumns({**later, "known": F.lead("week", weeks).over(w)})


CUT = "2000-01-01"


@query()
def m14_m19_multi_output_forest(spark, d):
    """One forest predicts the returns of all brands at once, on rows later than any
    label that it was trained on."""
    x, outputs = ahead(spark, d), [f"y{b[1:]}" for b in BRANDS]
    train, test = x.filter(F.col("known") < CUT), x.filter((F.col("week") >= CUT) & F.col("known").isNotNull())
    model = trees.multi_output_forest(train, ["grp", "week"], BRANDS, outputs, trees=10, depth=3, bins=16, min_rows=10)
    scored = model.transform(test, ["grp", "week", *outputs])
    return trees.output_rows(scored, ["grp", "week"], BRANDS, outputs).withColumnsRenamed({"output": "factor_name"})


@query()
def m18_importance(spark, d):
    return models.importance_rows(spark, models.forest(vectors(spark, d, 1), "f0", numTrees=5, maxDepth=4), FACTORS[1:], "run")


@query()
def m20_m21_cluster_factors(spark, d):
    """Pillars of similar factors per label."""
    return models.cluster_factors(matrix(spark, d), ["label"], FACTORS)


@query()
def m22_variance_inflation(spark, d):
    return models.variance_inflation(matrix(spark, d), FACTORS)


@query()
def m24_threshold_returns(spark, d):
    """Returns by the probability of the upper tercile from a weighted forest of
    the other half of the rows."""
    x = models.class_weights(vectors(spark, d, 1).withColumn("y", fixed_cut("f0", [-0.05, 0.05]).cast("double")), "y")
    scored = models.crossed(x, ["vec_id"], lambda part: models.class_forest(part, "y", "weight", numTrees=5, maxDepth=4))
    return models.threshold_returns(scored, 2, "f0", [0.3, 0.35, 0.4])


@query()
def m24_boosted_configurations(spark, d):
    """Which configurations pay: three classes of an order's price against its month,
    by categories and macro columns; years before 1999 train, 1999 ends the rounds,
    later ones are reported beside it."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    x = o.join(c.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", F.col("c_nationkey").cast("string").alias("nation")), "o_custkey")
    x = x.withColumn("month", F.to_date(F.date_trunc("month", "o_orderdate")))
    monthly = x.groupBy("month").agg(F.avg("o_totalprice").alias("m"), F.count("*").alias("n"))
    w = cal.over([], "month")
    macro = monthly.select("month", F.lag("m").over(w).alias("level"), (F.lag("m").over(w) / F.lag("m", 2).over(w)).alias("change"), F.lag("n").over(w).cast("double").alias("runs"))
    x = x.join(monthly.select("month", "m"), "month").join(macro, "month").withColumn("ret", F.col("o_totalprice") / F.col("m") - 1)
    part = F.when(F.year("month") < 1999, "train").when(F.year("month") == 1999, "valid").otherwise("test")
    x = x.select("o_orderkey", "o_orderpriority", "o_orderstatus", "c_mktsegment", "nation", "level", "change", "runs", "ret", part.alias("part"))
    known = x.filter("part = 'train'")
    edges = quantile_edges(known, "ret", 3)
    codes = boosting.category_codes(known, ["o_orderpriority", "o_orderstatus", "c_mktsegment", "nation"], "ret")
    x = boosting.with_codes(x.withColumn("y", fixed_cut("ret", edges)), codes)
    features = [*[f"{k}_code" for k in codes], "level", "change", "runs"]
    train, valid = (x.filter(F.col("part") == p) for p in ("train", "valid"))
    weighted = models.class_weights(train, "y")
    model = boosting.softmax_boost(weighted, valid.withColumn("weight", F.lit(1.0)), ["o_orderkey"], features, "y", 3, rounds=8, depth=2, weight="weight", patience=2)
    scored = model.transform(x.filter("part <> 'train'"), ["part", "y", "ret"])
    return boosting.threshold_report(scored, ["part"], F.col("probability")[2], F.col("y") == 2, "ret", [0.2, 0.25, 0.33, 0.5])


@query()
def m23_lasso_walk_forward(spark, d):
    """Signs of the brands' next premiums by Lassos of lookbacks and strengths, each
    test week by a model of the weeks before it."""
    return linear.lasso_walk_forward(brand_premiums(spark, d), ["brand"], "week", "value", [4, 8, 12], [1e-4, 1e-3], 12)


@query()
def m23_logistic_walk_forward(spark, d):
    """The same by L1-penalised logistic models."""
    return linear.logistic_walk_forward(brand_premiums(spark, d), ["brand"], "week", "value", [4, 8], [1e-3, 1e-2], 6)


@query()
def m23_m25_linear_models(spark, d):
    """Sign predicted by an L1 classifier, value by ridge regression; each row by the
    models of the other half."""
    x = vectors(spark, d, 1).withColumn("up", (F.col("f0") > 0).cast("double"))
    a = models.crossed(x, ["vec_id"], lambda part: models.linear_classifier(part, "up")).select("vec_id", "up", F.col("prediction").alias("up_pred"))
    b = models.crossed(x, ["vec_id"], lambda part: models.ridge(part, "f0")).select("vec_id", F.col("f0").alias("value"), F.col("prediction").alias("value_pred"))
    return a.join(b, "vec_id")


@query("""WITH g AS (SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders), t AS (SELECT o_orderpriority, o_orderstatus, CAST(o_orderdate AS DATE) AS day, count(*) AS n, sum(o_totalprice) AS s FROM orders WHERE o_orderdate = TIMESTAMP '1998-06-07' GROUP BY 1, 2, 3)
SELECT g.o_orderpriority, g.o_orderstatus, DATE '1998-06-07' AS day, n, round(s, 2) AS s FROM g LEFT JOIN t ON t.o_orderpriority = g.o_orderpriority AND t.o_orderstatus = g.o_orderstatus""")
def m1_test_skeleton(spark, d):
    """Every group of a test period, with nulls where nothing is known yet."""
    o = table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))
    known = o.filter("o_orderdate = TIMESTAMP '1998-06-07'").groupBy("o_orderpriority", "o_orderstatus", "day").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("s"))
    return training.test_skeleton(o.select("o_orderpriority", "o_orderstatus"), known, "day", "1998-06-07")
