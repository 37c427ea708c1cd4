"""Small fixtures with known results for the panel operators."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.functions.formula import Formula, apply_formulas, compile_formulas
from panelspark.functions.scalars import finite, month_number, ratio
from panelspark.operators import buckets, calendar, clean, evaluate, joins, reshape, research, scores
from panelspark.plans import models, training
from panelspark.sources.sinks import PartitionedTable, SnapshotTable, working_folder


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(n)


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_finite_and_ratio(spark):
    df = spark.createDataFrame([(1.0, 2.0), (float("nan"), 0.0), (float("inf"), None)], "a double, b double")
    got = df.select(finite(F.col("a")).alias("f"), ratio(F.lit(1.0), F.col("b")).alias("r")).collect()
    assert [tuple(r) for r in got] == [(1.0, 0.5), (None, None), (None, None)]


def test_month_number(spark):
    df = spark.createDataFrame([("Dec",), ("Jan",), ("x",), (None,)], "m string")
    assert [r[0] for r in df.select(month_number(F.col("m"))).collect()] == [12, 1, None, None]


def test_formulas(spark):
    df = spark.createDataFrame([("k", 1, 4.0, None, 0.0), ("k", 2, 6.0, 2.0, 3.0)], "k string, d int, a double, b double, c double")
    fs = [Formula("s", "a + b - c"), Formula("m", "a * b"), Formula("q", "a", "c"), Formula("gone", "zz", "a"), Formula("x", "a", "a")]
    w = calendar.over(["k"], "d")
    got = apply_formulas(df, fs, w, ["k", "d"]).orderBy("d").collect()
    assert [(r["s"], r["m"], r["q"], r["gone"]) for r in got] == [(4.0, None, None, None), (5.0, 12.0, 2.0, None)]
    assert compile_formulas(df, fs, w)[1] == ["x"]
    with pytest.raises(ValueError):
        apply_formulas(df, [Formula("bad", "+ a")], w, ["k"])


def test_wide_and_long(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (2, "a", 3.0)], "k int, field string, value double")
    wide = reshape.to_wide(df, ["k"], ["a", "b", "none"])
    assert rows(wide, "k", "a", "b", "none") == [(1, 1.0, 2.0, None), (2, 3.0, None, None)]
    assert rows(reshape.to_long(wide, ["k"], ["a", "b"]), "k", "field", "value") == rows(df, "k", "field", "value")
    with pytest.raises(ValueError):
        reshape.assert_unique(df, ["k"])


def test_calendar_and_as_of(spark):
    df = spark.createDataFrame([("a", day(0), 1.0), ("a", day(3), None), ("b", day(2), 5.0)], "k string, day date, v double")
    full = calendar.forward_fill(calendar.calendar_fill(df, ["k"], "day", after=1), ["k"], "day", ["v"])
    got = {(r["k"], r["day"]): r["v"] for r in full.collect()}
    assert len(got) == 10 and got["a", day(4)] == 1.0 and got["b", day(1)] is None and got["b", day(3)] == 5.0
    carried = calendar.calendar_carry(df, ["k"], "day", ["v"])
    slow = calendar.forward_fill(calendar.calendar_fill(df, ["k"], "day"), ["k"], "day", ["v"])
    assert rows(carried.na.fill(-1.0), "k", "day", "v") == rows(slow.na.fill(-1.0), "k", "day", "v")
    grid = spark.createDataFrame([("a", day(0)), ("a", day(9)), ("c", day(1))], "k string, day date")
    assert rows(calendar.as_of(grid, df, ["k"], "day", ["v"]), "k", "v")[:2] == [("a", 1.0), ("a", 1.0)]


def test_windows_shorter_than_needed(spark):
    df = spark.createDataFrame([("a", i, float(i + 1)) for i in range(4)], "k string, d int, v double")
    out = df.select("d", calendar.rolling_level("v", ["k"], "d", -3).alias("x"), calendar.forward_return("v", ["k"], "d", 4).alias("y"))
    assert rows(out.filter("d < 2"), "d", "x", "y") == [(0, 2.0, None), (1, 3.0, None)]
    assert out.filter("d >= 2 AND x IS NOT NULL").count() == 0


@pytest.mark.parametrize("n", [2, 3, 65, 66])
def test_premium_bucket_edges(spark, n):
    df = spark.createDataFrame([("g", float(i)) for i in range(n)], "g string, f double")
    got = {r["bucket"]: r["count"] for r in buckets.premium_buckets(df, ["g"], "f").groupBy("bucket").count().collect()}
    share = 0.2 if n > 65 else 0.3
    if n < 3:
        assert got == {None: 2}
    else:
        low = sum(i <= share * (n - 1) + 1e-9 for i in range(n))
        assert got[0] == low and sum(got.values()) == n


def test_premium_bucket_ties_and_infinity(spark):
    values = [0.0] * 4 + [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, float("inf"), float("-inf")]
    df = spark.createDataFrame([("g", v) for v in values] + [("same", 1.0)] * 5, "g string, f double")
    out = buckets.premium_buckets(df, ["g"], "f")
    assert {r["bucket"] for r in out.filter("g = 'same'").collect()} == {None}
    got = {r["f"]: r["bucket"] for r in out.filter("g = 'g'").collect()}
    assert got[float("inf")] == 2 and got[float("-inf")] == 0 and got[0.0] == 0 and got[3.0] == 0 and got[4.0] == 1


def test_top_with_ties(spark):
    df = spark.createDataFrame([("g", 1.0), ("g", 2.0), ("g", 2.0), ("g", 3.0)], "g string, s double")
    assert evaluate.top_with_ties(df, ["g"], "s", 2).count() == 3
    assert evaluate.top_with_ties(df, ["g"], "s", -1).count() == 1
    assert evaluate.top_with_ties(df, ["g"], "s", 9).count() == 4


def test_past_mean_needs_all_periods(spark):
    df = spark.createDataFrame([("c", i, float(i)) for i in range(4)], "c string, p int, m double")
    assert rows(df.withColumn("x", evaluate.past_mean("m", ["c"], "p", 2)).filter("p >= 2"), "p", "x") == [(2, 0.5), (3, 1.5)]
    assert df.withColumn("x", evaluate.past_mean("m", ["c"], "p", 2)).filter("x IS NULL").count() == 2


def test_vote(spark):
    df = spark.createDataFrame([("g", ["a", "b"]), ("g", ["a"]), ("g", ["a", "c"]), ("g", None)], "g string, f array<string>")
    got = evaluate.vote(df, ["g"], "f")
    assert rows(got, "factor", "votes", "share") == [("a", 3, 0.7)]


def test_accuracy_and_weights(spark):
    df = spark.createDataFrame([(0.0, -1.0), (1.0, -1.0), (2.0, 0.0), (-1.0, 0.0), (-2.0, 4.0)], "roic double, book double")
    got = [r[0] for r in df.select(training.sample_weight(["roic", "book"], 0.4)).collect()]
    assert got == [0.4, 0.6, 0.6, 0.4, 0.6]
    one = df.limit(1).agg(*evaluate.accuracy("roic", "book")).first()
    assert tuple(one) == (None, None, None)


def test_yeo_johnson(spark):
    df = spark.createDataFrame([(-2.0, 0.5), (3.0, 0.0), (-1.0, 2.0), (3.0, 1.0)], "x double, l double")
    got = [r[0] for r in df.select(scores.power_transform(F.col("x"), F.col("l"))).collect()]
    want = [-(3**1.5 - 1) / 1.5, math.log(4), -math.log(2), 3.0]
    assert got == pytest.approx(want)


def test_score_range(spark):
    df = spark.createDataFrame([("g", "f", float(i * i)) for i in range(30)] + [("h", "f", 1.0)], "g string, field string, value double")
    got = [r["value"] for r in scores.fundamental_score(df, ["g", "field"]).collect()]
    assert len(got) == 31 and all(0 <= v <= 10 for v in got)


def test_duplicates_and_flips(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", 2.0, 2), ("b", 1.0, 3)], "k string, v double, t int")
    assert rows(clean.most_complete(df, ["k"], ["t"]), "k", "t") == [("a", 2), ("b", 3)]
    with pytest.raises(ValueError):
        joins.complete_inner(df, df.filter("k = 'a'"), ["k"])


def test_snapshot_table(spark):
    store = SnapshotTable(spark, working_folder(spark, "t"))
    store.upsert(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), ["k"])
    store.upsert(spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), ["k"])
    assert rows(store.read(), "k", "v") == [(1, "a"), (2, "c"), (3, "d")]
    store.delete(F.col("k") == 1)
    assert store.read().count() == 2


def test_partitioned_table(spark):
    """A change rewrites the parts it touches and leaves the others where they lie."""
    make = lambda x: spark.createDataFrame(x, "k int, day date, v string")
    store = PartitionedTable(spark, working_folder(spark, "t"), F.date_format("day", "yyyy-MM"))
    store.replace_range(make([]), "day", ["k"])
    assert store._lie() == {}
    store.replace_range(make([(k, day(n), "old") for k in (1, 2) for n in (0, 10, 40, 70)]), "day", ["k"])
    before = store._lie()
    assert set(before) == {"p2024-01", "p2024-02", "p2024-03"}
    store.replace_range(make([(1, day(5), "new"), (1, day(35), "new")]), "day", ["k"])
    left = {(1, 0), (1, 40), (1, 70), (2, 0), (2, 10), (2, 40), (2, 70)}
    want = {(k, day(n), "old") for k, n in left} | {(1, day(5), "new"), (1, day(35), "new")}
    assert {tuple(r) for r in store.read().collect()} == want
    now = store._lie()
    assert now["p2024-03"] == before["p2024-03"] and now["p2024-01"] != before["p2024-01"]
    keyed = PartitionedTable(spark, working_folder(spark, "t"), F.col("k") % 3)
    keyed.upsert(make([(k, day(k), "old") for k in range(9)]), ["k"])
    before = keyed._lie()
    keyed.upsert(make([(3, None, "new"), (30, day(0), "new")]), ["k"])
    assert {r["k"]: r["v"] for r in keyed.read().collect()} == {**{k: "old" for k in range(9)}, 3: "new", 30: "new"}
    assert {p for p, f in keyed._lie().items() if f != before[p]} == {"p0"}


def test_average_linkage():
    d = np.array([[0, 1, 5, 6], [1, 0, 5, 6], [5, 5, 0, 2], [6, 6, 2, 0]], float)
    merges = models.average_linkage(list("abcd"), d)
    assert [m[2] for m in merges] == [1.0, 2.0, 5.5]
    assert models.clusters_below(list("abcd"), merges, 2.0) == [["a", "b"], ["c", "d"]]


def test_empty_frames(spark):
    df = spark.createDataFrame([], "k string, day date, v double")
    assert calendar.calendar_fill(df, ["k"], "day").count() == 0
    assert research.describe(df, ["k"], "v").count() == 0
    assert buckets.quantile_premium(df.withColumn("w", F.col("v")), ["k"], "v", "w").count() == 0


def test_moments_and_windows_equal_numpy(spark):
    rng = np.random.default_rng(3)
    start = dt.date(2020, 1, 6)
    rows = [(g, start + dt.timedelta(days=7 * w), *(None if rng.random() < 0.1 else float(x) for x in rng.normal(size=4)), 1.0) for g in "ab" for w in range(60) for _ in range(3)]
    names = ["f0", "f1", "f2", "f3", "flat"]
    panel = spark.createDataFrame(rows, "grp string, day date, " + ", ".join(f"{f} double" for f in names)).repartition(5)
    sums = models.moments(panel, ["grp"], names).withColumn("r", models.pair_correlation()).collect()
    assert len(sums) == 2 * 10
    for r in sums:
        x = np.array([[v or 0.0 for v in row[2:]] for row in rows if row[0] == r["grp"]])
        want = np.corrcoef(x[:, r["i"]], x[:, r["j"]])[0, 1] if r["j"] < 4 else 0.0
        assert r["n"] == len(x) and abs(r["r"] - want) < 1e-9
    periods = spark.createDataFrame([(start + dt.timedelta(days=7 * w),) for w in (20, 40)], "testing_period date")
    got = models.cluster_windows(panel, periods, "grp", "day", names[:4], 2, years=1, sub_at=0).collect()
    assert {(r["grp"], r["testing_period"]) for r in got} == {(g, start + dt.timedelta(days=7 * w)) for g in "ab" for w in (20, 40)}
    for g in "ab":
        for w in (20, 40):
            end = start + dt.timedelta(days=7 * (w + 2))
            inside = [r for r in rows if r[0] == g and r[1] <= end and r[1] > end.replace(year=end.year - 1)]
            x = np.array([[v or 0.0 for v in r[2:6]] for r in inside])
            d = np.sqrt(np.maximum(0, 2 * len(x) * (1 - np.corrcoef(x.T))))
            first = min((d[i, j], i, j) for i in range(4) for j in range(i + 1, 4))
            pair = next(r for r in got if r["grp"] == g and r["testing_period"] == end - dt.timedelta(days=14) and r["pillar"] == "subpillar_0")
            assert pair["factor_list"] == [names[first[1]], names[first[2]]] and abs(pair["threshold"] - first[0]) < 1e-9


def test_average_linkage_equals_a_slow_version():
    rng = np.random.default_rng(4)
    names = [f"n{i}" for i in range(9)]
    x = rng.normal(size=(9, 3))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    clusters, want = [[i] for i in range(9)], []
    while len(clusters) > 1:
        h, a, b = min((np.mean([d[p, q] for p in u for q in v]), i, j) for i, u in enumerate(clusters) for j, v in enumerate(clusters) if i < j)
        want.append((sorted(clusters[a] + clusters[b]), h))
        clusters[a] = clusters[a] + clusters.pop(b)
    got = models.average_linkage(names, d)
    assert [sorted(names.index(n) for n in a + b) for a, b, _ in got] == [w for w, _ in want]
    assert np.allclose([h for _, _, h in got], [h for _, h in want])


def test_class_weights_and_group_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 9.0), ("b", 4.0), (None, 5.0)], "y string, v double")
    got = {(r["y"], r["v"]): r["weight"] for r in models.class_weights(df, "y").collect()}
    assert got == {("a", 1.0): 5 / 9, ("a", 2.0): 5 / 9, ("a", 9.0): 5 / 9, ("b", 4.0): 5 / 3, (None, 5.0): 5 / 3}
    for few in (False, True):
        out = scores.with_group_values(df, ["y"], {"m": F.max("v"), "q": F.percentile("v", F.lit(0.5))}, few)
        assert sorted((str(r["y"]), r["v"], r["m"], r["q"]) for r in out.collect()) == [
            ("None", 5.0, 5.0, 5.0), ("a", 1.0, 9.0, 2.0), ("a", 2.0, 9.0, 2.0), ("a", 9.0, 9.0, 2.0), ("b", 4.0, 4.0, 4.0),
        ]


def test_lasso_forecasts_only_later_rows(spark):
    start = dt.date(2020, 1, 1)
    rows = [(k, start + dt.timedelta(days=30 * i), (-1.0) ** i * (1 + 0.1 * len(k))) for k in ("u", "vv") for i in range(40)]
    panel = spark.createDataFrame(rows, "k string, day date, v double")
    got = models.lasso_signs(panel, "k", "day", "v", 0.001, [1, 2], ahead=1, share=0.25).collect()
    days = sorted({r[1] for r in rows})
    assert got and min(r["day"] for r in got) > days[int(39 * 0.75) - 1]
    assert all(r["is_reversed"] == (r["v"] > 0) for r in got)  # the next value has the other sign
    late = panel.withColumn("v", F.when(F.col("day") >= F.lit(days[31]), F.col("v") * 7 + 3).otherwise(F.col("v")))
    again = models.lasso_signs(late, "k", "day", "v", 0.001, [1, 2], ahead=1, share=0.25).filter(f"day <= DATE '{days[30]}'").collect()
    assert {(r["k"], r["day"]): round(r["prediction"], 9) for r in again} == {(r["k"], r["day"]): round(r["prediction"], 9) for r in got if r["day"] <= days[30]}
