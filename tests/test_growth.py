"""Cases that only larger or odder tables hold."""

from __future__ import annotations

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from panelspark.operators import calendar, research, scores
from panelspark.operators.buckets import day_cells
from panelspark.plans import training


def test_correlation_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(1, 2.0, 1.0), (1, 2.0, 3.0), (2, 1.0, 1.0), (2, 3.0, 5.0), (2, None, 9.0), (3, 1.0, 1.0), (4, None, 1.0)], "k int, a double, b double")
    got = {r["k"]: r["corr"] for r in research.grouped_correlation(df, ["k"], "a", ["b"]).collect()}
    assert got[1] is None and abs(got[2] - 1) < 1e-12 and got[3] is None and got[4] is None
    flat = df.withColumn("day", F.col("b")).withColumn("v", F.lit(1.0))
    assert {r["lag_1"] for r in calendar.autocorrelation(flat, ["k"], "day", "v", 1).collect()} == {None}


def test_rank_error_of_a_large_row(spark):
    n = 70_000  # squares of the differences don't fit 32 bits
    df = spark.range(n).select(F.lit(1).alias("g"), F.col("id").alias("key"), F.col("id").cast("double").alias("p"), (-F.col("id")).cast("double").alias("a"))
    d = [n - 1 - 2 * i for i in range(n)]
    want = sum(x if x > 0 else x * x for x in d) / n
    got = training.rank_error(df, ["g"], "p", "a", "key").first()["rank_error"]
    assert got == want


def test_skewness_of_tiny_returns(spark):
    """A single return of a millionth is as skewed as one of a half; SQL says the same."""
    import duckdb

    from panelspark import queries

    queries.load()
    sql = queries.ORACLE["t11_rolling_skewness"]
    weeks = [dt.date(2024, 1, 1) + dt.timedelta(7 * i) for i in range(60)]
    rows = [(k, w, 1.0 if i < 30 else p) for k, p in ((1, 1.000001), (2, 1.5), (3, 1.0)) for i, w in enumerate(weeks)]
    con = duckdb.connect()
    con.execute("CREATE TABLE lineitem AS SELECT UNNEST(?) AS l_partkey, UNNEST(?)::TIMESTAMP AS l_shipdate, UNNEST(?)::DOUBLE AS l_extendedprice, 1.0 AS l_quantity", [list(c) for c in zip(*rows)])
    con.execute("CREATE TABLE part AS SELECT range AS p_partkey, 'a' AS p_type, 'b' AS p_brand FROM range(5)")
    want = {(k, w): s for k, w, s in con.execute(sql).fetchall()}
    df = spark.createDataFrame(rows, "key int, week date, px double")
    got = calendar.rolling_skewness(df, ["key"], "week", "px", 52).collect()
    assert len(got) == len(want) == 180
    for r in got:
        s = None if r["skew"] is None or np.isnan(r["skew"]) else round(r["skew"], 4)
        assert s == want[r["key"], r["week"]], r
    assert want[1, weeks[-1]] == want[2, weeks[-1]] == 7.2111 and want[3, weeks[-1]] is None


def panel(spark, seed=3):
    """Prices that move seldom, of twelve keys, in weeks."""
    r = np.random.default_rng(seed)
    rows = [(k, dt.date(2024, 1, 1) + dt.timedelta(7 * int(i)), float(r.integers(0, 6)) or None) for k in range(12) for i in r.choice(40, 1 + k, replace=False)]
    return spark.createDataFrame(rows, "key int, week date, px double")


def test_runs_of_returns_equal_windows(spark):
    df = panel(spark)
    weeks = calendar.calendar_carry(df, ["key"], "week", ["px"], step=7)
    past, ahead = calendar.past_return("px", ["key"], "week", 0, 4), calendar.forward_return("px", ["key"], "week", 4)
    want = weeks.select("key", "week", past.alias("past"), ahead.alias("ahead")).filter("past IS NOT NULL")
    runs = calendar.carried_returns(df, ["key"], "week", "px", 4, step=7)
    got = calendar.run_days(runs, "week", step=7).select("key", "week", "past", "ahead")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert runs.count() < got.count()
    assert "Window" in runs._jdf.queryExecution().toString() and "Window" not in calendar.run_days(runs.limit(0), "week", step=7)._jdf.queryExecution().optimizedPlan().toString()


def test_quantiles_of_counted_values(spark):
    from panelspark.operators.quantiles import exact_quantiles

    r = np.random.default_rng(1)
    rows = [(g, float(v)) for g in (1, 2, None) for v in np.round(r.normal(size=300), 1)] + [(3, None), (1, None)]
    df = spark.createDataFrame(rows, "g int, v double")
    counted = df.groupBy("g", "v").agg(F.count("*").alias("n"))
    shares = [0.0, 0.1, 0.37, 0.5, 0.99, 1.0]
    want = {x["g"]: x["q"] for x in df.groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, shares))).alias("q")).collect()}
    for small in (4, 4096):
        got = {x["g"]: x["q"] for x in exact_quantiles(counted, ["g"], "v", shares, small=small, cuts=4, count="n").collect()}
        assert got.keys() == want.keys()
        for g in want:
            assert (got[g] is None) == (want[g] is None) and (want[g] is None or np.allclose(got[g], want[g], atol=1e-12, rtol=0)), g


def test_scores_by_counted_values_equal_windows(spark):
    from panelspark.operators import scores

    r = np.random.default_rng(5)
    values = {1: np.round(r.normal(size=400), 1), 2: np.append(np.zeros(399), 50.0), 3: np.full(9, 0.1), 4: np.round(r.lognormal(0, 2.5, 900), 1)}
    rows = [(g, i, float(v)) for g, x in values.items() for i, v in enumerate(x)] + [(1, 1000, None)]
    df = spark.createDataFrame(rows, "g int, key int, value double")
    for quantiles in (None, (0.01, 0.99)):
        x = df.withColumn("value", scores.standardize("value", ["g"]))
        x = scores.clip_quantiles(x, ["g"], "value", *quantiles) if quantiles else x
        x = scores.trim_outliers(x, ["g"], "value")
        x = x.withColumn("value", scores.robust_scale("value", ["g"]))
        want = {tuple(t[:2]): t[2] for t in x.withColumn("value", 10 - scores.min_max("value", ["g"])).select("g", "key", "value").collect()}
        got = {tuple(t[:2]): t[2] for t in scores.fundamental_score(df, ["g"], "value", quantiles).select("g", "key", "value").collect()}
        assert got.keys() == want.keys()
        assert all((got[k] is None) == (want[k] is None) and (want[k] is None or abs(got[k] - want[k]) < 1e-4) for k in want)
    plain = df.withColumn("value", scores.robust_scale("value", ["g"]))
    want = sorted(map(str, plain.withColumn("value", scores.min_max("value", ["g"])).collect()))
    assert sorted(map(str, scores.robust_min_max(df, ["g"], "value").select(df.columns).collect())) == want


def test_best_and_worst_by_counted_scores(spark):
    from pyspark.sql import Window

    from panelspark.operators import evaluate

    r = np.random.default_rng(7)
    rows = [(g, i, f"b{i % 3}", float(r.integers(-4, 5)) if i % 9 else None, float(r.integers(-8, 9)) / 8 if i % 7 else None) for g in (1, 2) for i in range(40 * g)] + [(3, 1, "b1", None, 1.0)]
    df = spark.createDataFrame(rows, "g int, key int, brand string, s double, r double")
    w = Window.partitionBy("g")
    ranked = df.withColumns({"t": F.rank().over(w.orderBy(F.col("s").desc_nulls_last())), "l": F.rank().over(w.orderBy(F.col("s").asc_nulls_last()))})
    mean = lambda c: F.avg(F.when(F.col(c) <= 5, F.col("r")))
    want = ranked.groupBy("g").agg(mean("t").alias("best"), mean("l").alias("worst"), F.avg("r").alias("all"))
    assert sorted(map(tuple, research.score_evaluation(df, ["g"], "s", "r", 5).select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    members = {(x["g"], n): sorted(x["k"]) for n in (-6, 3) for x in ranked.filter(f"t <= {n}" if n > 0 else f"l <= {-n}").groupBy("g").agg(F.collect_list("key").alias("k")).collect()}
    got = evaluate.portfolio_stats(df, ["g"], [-6, 3], "s", "r", "brand", "key").collect()
    assert {(x["g"], x["top_n"]): x["tickers"] for x in got} == members
    all_ = {x["g"]: x["m"] for x in df.groupBy("g").agg(F.avg("r").alias("m")).collect()}
    assert all(x["bm_ret"] == all_[x["g"]] for x in got)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_means_of_runs_equal_those_of_days(spark):
    """Runs of equal days are added up before a row per day is made."""
    from panelspark.queries import panels, proxies

    df = panel(spark).repartition("key")
    runs = calendar.carried_returns(df, ["key"], "week", "px", 4, step=7).withColumn("odd", F.col("key") % 2)
    days = calendar.run_days(runs, "week", step=7)
    for c in ("past", "ahead"):
        want = {tuple(r[:2]): r[2] for r in days.groupBy("odd", "week").agg(F.avg(c)).collect()}
        got = {tuple(r[:2]): r[2] for r in calendar.run_means(runs, ["odd"], "week", c, step=7).select("odd", "week", "mean").collect()}
        assert got.keys() == want.keys()
        assert all((got[k] is None) == (want[k] is None) and (want[k] is None or abs(got[k] - want[k]) < 1e-12) for k in want)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        folder = "/root/testdata/sf0.001"
        assert exchanges(proxies.week_prices(spark, folder)) == 1
        assert exchanges(panels.return_runs(spark, folder, 9)) == 2  # rows and parts by key, each once
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_price_features_move_rows_once(spark):
    """One exchange by key, and sliding skewness over returns and Sundays alone."""
    from panelspark.queries import panels

    df = panels.t16_price_features_job(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert exchanges(df) == 1 and plan.count("Exchange SinglePartition") == 1 and "Union" not in plan
    lines = plan.splitlines()
    at = next(i for i, line in enumerate(lines) if "skewness" in line and "Window" in line)
    assert any("Filter" in line and "isnotnull(__r" in line for line in lines[at + 1 : at + 3])


def test_premiums_of_runs_equal_those_of_days(spark):
    """Equal runs are counted before days are made, and the days move once."""
    from panelspark.plans import jobs

    r = np.random.default_rng(11)
    start = dt.date(2024, 1, 1)
    some = lambda: [None, float("nan"), 0.0, 0.0, *np.round(r.normal(size=4), 1).tolist()][r.integers(0, 8)]
    rows = []
    for i in range(600):
        a = int(r.integers(0, 12))
        rows.append((f"g{i % 3}", start + dt.timedelta(7 * a), start + dt.timedelta(7 * (a + int(r.integers(0, 4)))), *(some() for _ in range(4))))
    runs = spark.createDataFrame(rows, "grp string, from date, to date, f double, g double, y double, z double")
    want = jobs.premium_job(calendar.run_days(runs, "week", 7), "grp", "week", ["f", "g"], ["y", "z"])
    got = jobs.premium_job(runs, "grp", "week", ["f", "g"], ["y", "z"], step=7)
    assert exchanges(got) == 2  # runs, then days; not the long rows
    assert got.columns == want.columns
    want, found = ({tuple(x[:4]): x[4:] for x in d.collect()} for d in (want, got))
    assert want and found.keys() == want.keys()
    assert all(found[k][1] == want[k][1] and abs(found[k][0] - want[k][0]) < 1e-9 for k in want)
    trimmed = [jobs.premium_job(x, "grp", "week", ["f"], ["y"], trim=0.05, **s).count() for x, s in ((runs, {"step": 7}), (calendar.run_days(runs, "week", 7), {}))]
    assert trimmed[0] == trimmed[1]


def test_mean_returns_of_lists_equal_those_of_runs(spark, monkeypatch):
    """Returns are added up from one list a series: no window, no row per change or day."""
    from panelspark.queries import panels

    odd = [(20, None, 5.0), (20, dt.date(2024, 1, 1), None), (21, dt.date(2024, 1, 8), 0.0), (21, dt.date(2024, 2, 5), 3.0), (21, dt.date(2024, 3, 4), 1e9)]
    odd += [(22, dt.date(2024, 1, 1), float("nan")), (22, dt.date(2024, 2, 26), 2.0), (23, dt.date(2024, 1, 1), 2.0), (None, dt.date(2024, 1, 1), 2.0)]
    known = panel(spark).filter("px IS NOT NULL")
    df = known.unionByName(spark.createDataFrame(odd, known.schema)).repartition(3, "key")
    groups = spark.createDataFrame([(k, None if k == 4 else f"b{k % 3}", k % 2) for k in range(30) if k != 7], "key int, brand string, odd int")
    days = panel(spark)
    runs = calendar.carried_returns(df.filter("week IS NOT NULL"), ["key"], "week", "px", 4, step=7, days=days).withColumn("past", F.round("past", 9))
    want = calendar.run_means(runs.join(groups, "key"), ["odd", "brand"], "week", "past", step=7)
    want = {tuple(r)[:3]: r["mean"] for r in want.collect()}
    assert len(want) > 150 and any(np.isnan(v) for v in want.values()) and any(k[1] is None for k in want)
    for held in (1, 100, calendar.HELD):
        monkeypatch.setattr(calendar, "HELD", held)
        out = calendar.mean_returns(df, groups, "key", ["odd", "brand"], "week", "px", 4, step=7, days=days)
        got = {tuple(r)[:3]: r["mean"] for r in out.collect()}
        assert got.keys() == want.keys()
        assert all(np.isclose(got[k], want[k], rtol=1e-12, atol=1e-9, equal_nan=True) for k in want)
    assert calendar.mean_returns(df.limit(0), groups, "key", ["brand"], "week", "px", 4, step=7).count() == 0
    monkeypatch.setattr(panels, "settle", lambda df, label: df)
    plan = panels.brand_returns(spark, "/root/testdata/sf0.001", "grp")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan


def test_mean_returns_of_rows_that_repeat_days(spark, monkeypatch):
    """Rows need not be one a key and day; a series may be longer than a batch, and one
    may be in two groups. No list of a series is made."""
    from panelspark import shipping
    from panelspark.queries import panels

    known = panel(spark).filter("px IS NOT NULL")
    less = known.withColumn("px", F.col("px") - 0.5)
    long = spark.range(25_000).select(F.lit(40).alias("key"), F.date_add(F.lit(dt.date(2024, 1, 1)), (7 * (F.col("id") % 33)).cast("int")).alias("week"), (F.col("id") % 101 + 1e-3).alias("px"))
    odd = spark.createDataFrame([(41, dt.date(2024, 1, 1), 2.0), (41, dt.date(2024, 1, 1), float("nan")), (42, dt.date(2024, 1, 8), 1e-9), (42, dt.date(2024, 2, 5), 1e9)], known.schema)
    df = known.unionByName(less).unionByName(long).unionByName(odd)
    groups = spark.createDataFrame([(k, f"b{k % 3}") for k in (*range(12), 40, 41, 42, 99)] + [(5, "b0"), (40, "b0"), (None, "b0")], "key int, brand string")
    once = df.groupBy("key", "week").agg(F.max("px").alias("px"))
    runs = calendar.carried_returns(once, ["key"], "week", "px", 4, step=7).withColumn("past", F.round("past", 9))
    want = {tuple(r)[:2]: r["mean"] for r in calendar.run_means(runs.join(groups, "key"), ["brand"], "week", "past", step=7).collect()}
    assert len(want) > 100 and any(np.isnan(v) for v in want.values()) and max(v for v in want.values() if v == v) > 1e16
    for held in (1000, calendar.HELD):
        monkeypatch.setattr(calendar, "HELD", held)
        got = {tuple(r)[:2]: r["mean"] for r in calendar.mean_returns(df, groups, "key", ["brand"], "week", "px", 4, step=7).collect()}
        assert got.keys() == want.keys()
        assert all(np.isclose(got[k], want[k], rtol=1e-12, atol=1e-9, equal_nan=True) for k in want)
    seen = []
    monkeypatch.setattr(panels, "settle", lambda df, label: seen.append(int(spark.conf.get(shipping.BYTES).rstrip("b"))) or df)
    before = spark.conf.get(shipping.BYTES)
    plan = panels.brand_returns(spark, "/root/testdata/sf0.001", "grp")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "Join" not in plan
    spark.conf.set(shipping.ROWS, "0")  # then bytes alone bound a batch
    try:
        panels.brand_returns(spark, "/root/testdata/sf0.001")
    finally:
        spark.conf.unset(shipping.ROWS)
    assert seen[0] == 2**31 - 1 and seen[1] < 2**31 - 1 and spark.conf.get(shipping.BYTES) == before


def test_score_by_runs_meets_one_table(spark):
    """Runs counted before weeks are made give the score of the rows, which take all
    steps in one join."""
    rng = np.random.default_rng(3)
    prices = [(k, dt.date(2020, 1, 6) + dt.timedelta(weeks=int(w)), float(rng.choice([1.0, 2.0, 2.5, 80.0]))) for k in range(30) for w in rng.choice(40, 9, False)]
    df = spark.createDataFrame(prices, "key long, week date, px double")
    both = calendar.carried_returns(df, ["key"], "week", "px", 4, step=7)
    past = calendar.carried_returns(df, ["key"], "week", "px", 4, step=7, ahead=False)
    rows = calendar.run_days(past.select("key", F.col("past").alias("value"), "from", "to"), "week", 7)
    want = calendar.run_days(both.select("key", F.col("past").alias("value"), "from", "to"), "week", 7)
    assert sorted(map(tuple, rows.select("key", "week", "value").collect())) == sorted(map(tuple, want.select("key", "week", "value").collect()))
    runs = past.select((F.col("key") % 2).alias("grp"), F.col("past").alias("value"), "from", "to")
    counted = day_cells(runs, ["grp"], "week", ["value"], 7).groupBy("grp", "week", "value").agg(F.sum("n").alias("n"))
    rows = rows.withColumn("grp", F.col("key") % 2)
    by_rows, by_runs = (scores.fundamental_score(rows, ["grp", "week"], counted=c) for c in (None, counted))
    joins = lambda x: x._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    assert joins(by_runs) == joins(rows) + 1
    got, want = ({(r["key"], r["week"]): r["value"] for r in x.collect()} for x in (by_runs, by_rows))
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-9 for k, v in want.items())


def test_skewness_by_runs(spark, monkeypatch):
    """Runs of equal skewness give the rows of the panel's windows: zero and missing levels,
    series of one level, none, no group, two groups, one longer than a task holds."""
    rng = np.random.default_rng(8)
    week = lambda w: dt.date(2020, 1, 6) + dt.timedelta(weeks=int(w))
    rows = [(k, week(w), float(rng.choice([0.0, 1.0, 1.000001, 2.0, 80.0]))) for k in range(40) for w in rng.choice(60, rng.integers(1, 12), False)]
    rows += [(50, week(w), float(1.5**w)) for w in range(60)] + [(51, week(3), None), (51, week(9), 2.0), (52, week(5), None)]
    df = spark.createDataFrame(rows, "key long, week date, px double")
    groups = spark.createDataFrame([(k,) for k in [*range(1, 53), 7, 99]], "key long")
    panel = calendar.rolling_skewness(calendar.calendar_carry(df, ["key"], "week", ["px"], 7), ["key"], "week", "px", 10)
    want = panel.join(groups, "key").select("key", "week", "skew").collect()
    twice = df.unionByName(df.withColumn("px", F.col("px") / 2))  # the largest of a week counts
    for held, source in ((250_000, df), (20, twice)):
        monkeypatch.setattr(calendar, "HELD", held)
        runs = calendar.carried_skewness(source, groups, "key", "week", "px", 10, step=7)
        got = calendar.run_days(runs, "week", 7).select("key", "week", "skew").collect()
        a, b = (sorted((r["key"], r["week"], 1e9 if r["skew"] is None or np.isnan(r["skew"]) else r["skew"]) for r in x) for x in (got, want))
        b = [(k, w, 1e9 if k == 50 else s) for k, w, s in b]  # all returns equal but for rounding
        a = [(k, w, 1e9 if k == 50 else s) for k, w, s in a]
        assert [x[:2] for x in a] == [x[:2] for x in b] and np.allclose([x[2] for x in a], [x[2] for x in b], rtol=1e-6, atol=1e-7)
    assert calendar.carried_skewness(df.limit(0), groups, "key", "week", "px", 10, step=7).count() == 0
