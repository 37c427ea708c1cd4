"""Quantiles, correlations, searches and models against slow versions."""

from __future__ import annotations

import datetime as dt
import itertools
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import calendar as cal
from panelspark.operators import clean, quantiles, research, scores
from panelspark.functions.scalars import zero_to_null
from panelspark.plans import boosting, jobs, linear, models, trees

START = dt.date(2020, 1, 1)


def days(n):
    return START + dt.timedelta(days=n)


# quantiles


def same_number(a, b):
    return (a is None and b is None) or (a is not None and b is not None and (a == b or (a != a and b != b)))


@pytest.mark.parametrize("small,cuts", [(5, 4), (50, 8), (100_000, 64)])
def test_quantiles_equal_percentile(spark, small, cuts):
    rng = np.random.default_rng(1)
    rows = [("normal", float(x)) for x in rng.normal(size=900)]
    rows += [("ties", float(x)) for x in rng.integers(0, 3, 700)] + [("one", 4.0)] * 400
    rows += [("heavy", 7.0)] * 500 + [("heavy", float(x)) for x in rng.normal(7, 1, 100)]
    rows += [("odd", x) for x in (math.inf, -math.inf, math.nan, 0.0, 1e308, -1e308, 1e-308)] * 20 + [("odd", None)] * 30
    rows += [(None, float(x)) for x in rng.exponential(size=300)] + [("few", 2.0), ("few", None), ("none", None), ("skewed", 1e300)]
    rows += [("skewed", float(10.0**x)) for x in rng.uniform(-200, 200, 400)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    shares = [0.0, 0.01, 0.25, 0.5, 1 / 3, 0.999, 1.0]
    want = {r["k"]: r["q"] for r in df.groupBy("k").agg(F.percentile("v", F.array(*map(F.lit, shares))).alias("q")).collect()}
    got = {r["k"]: r["q"] for r in quantiles.exact_quantiles(df, ["k"], "v", shares, small=small, cuts=cuts).collect()}
    assert set(got) == set(want)
    for k, q in want.items():
        assert (q is None) == (got[k] is None) and all(map(same_number, q or [], got[k] or [])), (k, q, got[k])
    whole = df.agg(F.percentile("v", F.array(*map(F.lit, shares))).alias("q")).first()["q"]
    assert all(map(same_number, whole, quantiles.exact_quantiles(df, [], "v", shares, small=small, cuts=cuts).first()["q"]))
    beside = quantiles.with_quantiles(df, ["k"], "v", [0.5], "m")
    assert beside.count() == len(rows) and beside.columns == ["k", "v", "m"]


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([], "k string, v double")
    assert quantiles.exact_quantiles(df, ["k"], "v", [0.5]).count() == 0
    assert [r["q"] for r in quantiles.exact_quantiles(df, [], "v", [0.5]).collect()] == [None]


# correlations


def test_masked_correlation_equals_the_self_join(spark):
    rng = np.random.default_rng(2)
    rows = [(g, r, f, None if rng.random() < 0.05 else float(1e6 + rng.normal() + (r % 7 if f < "c" else 0))) for g in ("x", "y", None) for r in range(60) for f in "abcd" if rng.random() < 0.7]
    rows += [("x", r, "flat", 5.0) for r in range(40)] + [("x", 100, "alone", 1.0)]
    df = spark.createDataFrame(rows, "g string, row int, field string, value double").repartition(5)
    joined: dict = {}
    for (g, r, f, x), (h, q, e, y) in itertools.product([r for r in rows if r[3] is not None], repeat=2):
        if g == h and r == q and f < e:
            joined.setdefault((g, f, e), []).append((x, y))
    want = {}
    for k, v in joined.items():
        x, y = np.array(v).T
        want[k] = (None if np.ptp(x) == 0 or np.ptp(y) == 0 else float(np.corrcoef(x, y)[0, 1]), len(v))
    got = {(r["g"], r["a"], r["b"]): (r["corr"], r["n"]) for r in research.correlation_pairs(df, ["row"], groups=["g"]).collect()}
    assert set(got) == set(want)
    for k, (c, n) in want.items():
        assert got[k][1] == n and (got[k][0] is None) == (c is None) and (c is None or abs(c - got[k][0]) < 1e-6), (k, c, n, got[k])
    assert research.correlation_pairs(df.limit(0), ["row"], groups=["g"]).collect() == []
    assert {r["n"] for r in research.correlation_pairs(df.filter("g = 'x'"), ["row"]).filter("a = 'a' AND b = 'flat'").collect()} == {want["x", "a", "flat"][1]}


# the exponent of the power transform


def log_likelihood(x, lam):
    with np.errstate(all="ignore"):
        up = np.log1p(np.maximum(x, 0)) if abs(lam) < 1e-9 else ((np.maximum(x, 0) + 1) ** lam - 1) / lam
        m = np.maximum(-x, 0)
        down = -np.log1p(m) if abs(lam - 2) < 1e-9 else -((m + 1) ** (2 - lam) - 1) / (2 - lam)
        y = np.where(x >= 0, up, down)
        return -len(x) / 2 * np.log(y.var()) + (lam - 1) * (np.sign(x) * np.log1p(np.abs(x))).sum()


def slow_exponent(x):
    """Golden sections between the neighbours of the best of a grid."""
    grid = np.linspace(-60, 60, 481)
    at = int(np.argmax([log_likelihood(x, g) for g in grid]))
    a, b, r = grid[at] - 0.25, grid[at] + 0.25, (math.sqrt(5) - 1) / 2
    while b - a > 1e-9:
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if log_likelihood(x, c) > log_likelihood(x, d) else (c, b)
    return (a + b) / 2


def test_exponents_are_optimal(spark):
    rng = np.random.default_rng(3)
    groups = {
        "exp": rng.exponential(size=300), "normal": rng.normal(size=300), "left": -rng.exponential(size=200) ** 2,
        "steep": 1 + 0.02 * rng.normal(size=300) - 0.03 * rng.exponential(size=300), "falling": 0.5 + rng.pareto(5, 300) * 0.5, "both": rng.normal(size=300) ** 3,
    }
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [(None, float(x)) for x in groups["exp"] * 3] + [("exp", None)]
    got = {r["k"]: r["lam"] for r in scores.best_lambda(spark.createDataFrame(rows, "k string, x double").repartition(4), ["k"], "x").collect()}
    want = {**{k: slow_exponent(v) for k, v in groups.items()}, None: slow_exponent(groups["exp"] * 3)}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-4 for k in want), (got, want)
    assert max(want.values()) > 4 and min(want.values()) < -2


# rules


def test_nested_rules_equal_a_slow_version(spark):
    rng = np.random.default_rng(4)
    value = lambda: None if rng.random() < 0.1 else float(rng.integers(0, 8))
    rows = [(value(), value(), value(), value(), int(rng.integers(4))) for _ in range(300)]
    features = {"a": [(2.0, 1.0), (5.0, 2.0)], "b": [(3.0, 0.0)], "c": [(4.0, 3.0), (1.0, 1.0)], "d": [(3.5, 1.5)]}
    df = spark.createDataFrame([*rows, (1.0, 1.0, 1.0, 1.0, None)], "a double, b double, c double, d double, best int").repartition(3)
    got = {(r["op"], r["first"], r["x1"], r["t1"], r["x2"], r["t2"], r["x3"], r["t3"]): r["accuracy"] for r in research.nested_rule_accuracy(df, features, "best").collect()}
    meets = {">": lambda v, t, s: v > t, "<": lambda v, t, s: v < t, "~": lambda v, t, s: t - s < v < t + s}
    want = {}
    for op, f in meets.items():
        for x1, x2, x3 in itertools.permutations(features, 3):
            for (t1, s1), (t2, s2), (t3, s3) in itertools.product(features[x1], features[x2], features[x3]):
                right = [0, 0]
                for r in rows:
                    v = dict(zip("abcd", r))
                    holds = lambda x, t, s: v[x] is not None and f(v[x], t, s)  # noqa: E731, B023
                    p = holds(x1, t1, s1)
                    q = holds(x2, t2, s2) if p else holds(x3, t3, s3)
                    right[0] += r[4] == p + 2 * q
                    right[1] += r[4] == 2 * p + q
                for first in (True, False):
                    want[op, first, x1, t1, x2, t2, x3, t3] = right[not first] / len(rows)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in want)


# linkage


def slow_linkage(d):
    clusters, sizes, out = {i: [i] for i in range(len(d))}, {i: 1 for i in range(len(d))}, []
    sums = d.copy()
    while len(clusters) > 1:
        ids = sorted(clusters)
        h, a, b = min((sums[i, j] / (sizes[i] * sizes[j]), i, j) for x, i in enumerate(ids) for j in ids[x + 1 :])
        out.append((list(clusters[a]), list(clusters[b]), h))
        clusters[a] += clusters.pop(b)
        sizes[a] += sizes.pop(b)
        sums[a] += sums[b]
        sums[:, a] += sums[:, b]
    return out


@pytest.mark.parametrize("seed", range(6))
def test_linkage_with_ties(seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 4, (40, 2)).astype(float) if seed % 2 else rng.normal(size=(40, 2))
    d = np.abs(x[:, None] - x[None]).sum(axis=2)
    assert models.average_linkage(list(range(40)), d) == slow_linkage(d)


def test_linkage_of_many():
    x = np.random.default_rng(9).normal(size=(2000, 8))
    d = np.sqrt(np.maximum(0, ((x**2).sum(1)[:, None] + (x**2).sum(1) - 2 * x @ x.T)))
    begin = time.perf_counter()
    merges = models.average_linkage(list(range(2000)), d)
    assert len(merges) == 1999 and len(merges[-1][0]) + len(merges[-1][1]) == 2000
    assert time.perf_counter() - begin < 30


# weekly features


def slow_features(daily):
    """The features over a grid of all days."""
    key, day = "ticker", "trading_day"
    df = cal.calendar_fill(daily, [key], day)
    df = df.withColumns({c: zero_to_null(F.col(c)) for c in ("tri", "open", "high", "low", "close")})
    df = cal.range_volatility(cal.rolling_skewness(df, [key], day, "tri"), [key], day)
    df = cal.forward_fill(cal.volume_ratio(df, [key], day, "volume"), [key], day, ["market_cap", "tri", "close", "volume"])
    levels = {f"tri_avg_{d}".replace("-", "m"): cal.rolling_level("tri", [key], day, d) for d in (7, -7, -28)}
    df = clean.on_weekday(df.withColumns({"market_cap": cal.rescale_by_last("market_cap", "tri", [key], day), **levels}), day)
    labels = {f"stock_return_y_w{w}_d{d}": cal.forward_return(f"tri_avg_m{-d}", [key], day, w) for w, of in jobs.LABELS.items() for d in of}
    return df.withColumns({**labels, **{f"stock_return_{n}": cal.past_return("tri_avg_7", [key], day, a, b) for n, (a, b) in jobs.PAST.items()}})


@pytest.mark.parametrize("last", [419, 416])  # the last day is a Saturday or not
def test_price_features_equal_those_of_the_grid(spark, last):
    rng = np.random.default_rng(5)
    rows = []
    for k, chance in (("dense", 0.95), ("sparse", 0.05), ("late", 0.5)):
        for i in range(300 if k == "late" else 0, last + 1):
            if rng.random() < chance:
                p = float(np.round(100 * np.exp(rng.normal(0, 0.1)), 2))
                rows.append((k, days(i), *(None if rng.random() < 0.05 else v for v in (p, p * 1.01, p * 1.03, p * 0.97, 0.0 if rng.random() < 0.03 else p, float(rng.integers(0, 5)), p * 10))))
    rows += [("once", days(last), 5.0, 5.0, 6.0, 4.0, 5.0, 1.0, 9.0), ("dense", days(-2), 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0)]
    daily = spark.createDataFrame(rows, "ticker string, trading_day date, tri double, open double, high double, low double, close double, volume double, market_cap double")
    a, b = slow_features(daily), jobs.price_features(daily.repartition(3))
    assert set(a.columns) == set(b.columns)
    want, got = ({(r["ticker"], r["trading_day"]): r.asDict() for r in d.collect()} for d in (a, b))
    assert set(want) == set(got)
    for k, r in want.items():
        for c, v in r.items():
            g = got[k][c]
            if isinstance(v, float) and v == v:
                assert g is not None and abs(g - v) <= 1e-7 * max(1, abs(v)), (k, c, v, g)
            elif not isinstance(v, float):
                assert v == g, (k, c, v, g)
    plan = b._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence" in plan and "makedtinterval" not in plan.lower().replace("interval '7'", "")  # weeks only


# Lasso and logistic models


def slow_lasso(x, y, strength):
    """Proximal gradient on the mean squared error."""
    mx, my = x.mean(0), y.mean()
    a, b = x - mx, y - my
    step, w = 1 / (np.linalg.norm(a, 2) ** 2 / len(y) + 1e-12), np.zeros(x.shape[1])
    for _ in range(30_000):
        v = w - step * a.T @ (a @ w - b) / len(y)
        w = np.sign(v) * np.maximum(np.abs(v) - step * strength, 0)
    return my - mx @ w, w


def series(rng, n, scale=1.0):
    x = [float(rng.normal() * scale) for _ in range(3)]
    for _ in range(n - 3):
        x.append(0.6 * x[-1] - 0.3 * x[-3] + float(rng.normal() * scale))
    return x


def test_lasso_forecasts_equal_slow_models(spark):
    rng = np.random.default_rng(6)
    data = {k: series(rng, n) for k, n in (("a", 60), ("b", 50), ("c", 40), (None, 45), ("short", 6))}
    rows = [(k, days(7 * i), None if k == "a" and i == 20 else v) for k, x in data.items() for i, v in enumerate(x)]
    out = linear.lasso_forecasts(spark.createDataFrame(rows, "k string, day date, v double").repartition(3), "k", "day", "v", 0.02, 4, 3)
    got = {r["k"]: r for r in out.collect()}
    assert set(got) == {"a", "b", "c", None}
    for k in got:
        v = np.array([0.0 if k == "a" and i == 20 else x for i, x in enumerate(data[k])])
        windows = np.array([v[i : i + 7] for i in range(len(v) - 6)])  # four values, then the one three rows later
        b, w = slow_lasso(windows[:, :4], windows[:, -1], 0.02)
        assert got[k]["n"] == len(windows) and abs(got[k]["prediction"] - (b + w @ v[-4:])) < 1e-5
        assert got[k]["is_reversed"] == (got[k]["prediction"] < 0) and got[k]["day"] == days(7 * (len(v) - 1))


def windows_of(data, lookback):
    return [(i, v[i - lookback : i], v[i]) for v in data.values() for i in range(lookback, len(v))]


def slow_scores(test, up):
    y = np.array([r[2] for r in test])
    a = y > 0
    part = lambda c, of: float((c & of).sum() / of.sum()) if of.sum() else None
    return {
        "n": len(y), "accuracy": float((up == a).mean()), "precision": part(a, up), "recall": part(up, a),
        "avg_diff": float(np.where(up, y, -y).mean() - y.mean()), "actual_up": float(a.mean()), "pred_up": float(up.mean()),
    }


def slow_logistic(x, y, strength):
    z, w = np.column_stack([np.ones(len(x)), x]), np.zeros(x.shape[1] + 1)
    step = 4 / (np.linalg.norm(z, 2) ** 2 / len(y))
    for _ in range(30_000):
        v = w - step * z.T @ (1 / (1 + np.exp(-z @ w)) - y) / len(y)
        w = np.concatenate([v[:1], np.sign(v[1:]) * np.maximum(np.abs(v[1:]) - step * strength, 0)])
    return w


@pytest.mark.parametrize("kind", ["lasso", "logistic"])
def test_walk_forward_equals_slow_models(spark, kind):
    rng = np.random.default_rng(7)
    data = {k: series(rng, 50) for k in "abcdef"}
    panel = spark.createDataFrame([(k, days(7 * i), v) for k, x in data.items() for i, v in enumerate(x)], "k string, day date, v double").repartition(3)
    run = {"lasso": linear.lasso_walk_forward, "logistic": linear.logistic_walk_forward}[kind]
    got = {(r["lookback"], r["strength"], r["test_period"]): r.asDict() for r in run(panel, ["k"], "day", "v", [2, 4], [0.01, 0.1], 3).collect()}
    assert len(got) == 2 * 2 * 3
    for (d, s, period), scored in got.items():
        rows = windows_of(data, d)
        train, test = [r for r in rows if days(7 * r[0]) < period], [r for r in rows if days(7 * r[0]) == period]
        x, y, t = (np.array([r[i] for r in part]) for part, i in ((train, 1), (train, 2), (test, 1)))
        if kind == "lasso":
            b, w = slow_lasso(x, y, s)
        else:
            b, *w = slow_logistic(x, (y > 0).astype(float), s)
        for c, v in slow_scores(test, t @ np.array(w) + b > 0).items():
            assert (v is None and scored[c] is None) or abs(v - scored[c]) < 1e-9, (d, s, period, c)
    best = linear.best_setting(run(panel, ["k"], "day", "v", [2], [0.01, 0.1], 3), ["lookback", "strength"]).collect()
    assert [r["place"] for r in best] == [1, 2] and best[0]["avg_diff"] >= best[1]["avg_diff"]


def test_later_values_change_no_earlier_test_period(spark):
    rng = np.random.default_rng(8)
    rows = [(k, days(7 * i), v) for k in "abc" for i, v in enumerate(series(rng, 40))]
    panel = spark.createDataFrame(rows, "k string, day date, v double")
    late = panel.withColumn("v", F.when(F.col("day") >= F.lit(days(7 * 38)), F.col("v") * 5 - 2).otherwise(F.col("v")))
    for run in (linear.lasso_walk_forward, linear.logistic_walk_forward):
        a, b = ({(r["strength"], r["test_period"]): r["accuracy"] for r in run(p, ["k"], "day", "v", [3], [0.01], 4).collect() if r["test_period"] < days(7 * 38)} for p in (panel, late))
        assert a == b and len(a) == 2


# trees


def slow_tree(b, y, w, depth, min_rows):
    """{node: (feature, bin)} and {node: means}, by trying every split."""
    splits, values = {}, {}

    def grow(node, rows, left):
        n = w[rows].sum()
        values[node] = (y[rows] * w[rows, None]).sum(0) / n
        if not left:
            return
        loss = lambda r: ((y[r] - (y[r] * w[r, None]).sum(0) / w[r].sum()) ** 2 * w[r, None]).sum()
        best = None
        for f in range(b.shape[1]):
            for cut in np.unique(b[rows, f])[:-1]:
                a, c = rows[b[rows, f] <= cut], rows[b[rows, f] > cut]
                if w[a].sum() >= min_rows and w[c].sum() >= min_rows:
                    gain = np.float32((loss(rows) - loss(a) - loss(c)) / n)
                    if gain > 1e-9 and (best is None or gain > best[0]):
                        best = (gain, f, cut)
        if best:
            splits[node] = best[1:]
            grow(2 * node + 1, rows[b[rows, best[1]] <= best[2]], left - 1)
            grow(2 * node + 2, rows[b[rows, best[1]] > best[2]], left - 1)

    grow(0, np.flatnonzero(w > 0), depth)
    return splits, values


def tree_data(spark, seed, n=240):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 5)).round(2)
    x[rng.random(x.shape) < 0.05] = np.nan
    y = np.column_stack([np.where(x[:, 0] > 0.2, 3.0, 0.0) + rng.normal(0, 0.2, n), np.where(x[:, 1] > -0.4, -2.0, 1.0) + rng.normal(0, 0.2, n), rng.normal(size=n)]).round(3)
    w = rng.integers(1, 4, n).astype(float)
    rows = [(i, *(None if v != v else float(v) for v in a), *map(float, b), float(c)) for i, (a, b, c) in enumerate(zip(x, y, w))]
    names = [f"x{i}" for i in range(5)], [f"y{i}" for i in range(3)]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in (*names[0], *names[1], "w"))).repartition(4)
    return df, x, y, w, *names


@pytest.mark.parametrize("bagged", [None, 1.0])
def test_forest_equals_slow_trees(spark, bagged):
    df, x, y, w, features, outputs = tree_data(spark, 1)
    forest = trees.multi_output_forest(df, ["id"], features, outputs, trees=3, depth=3, bins=8, min_rows=12, subset=1.0, weight="w", bagged=bagged)
    b = forest.binned(x)
    assert b.max() < 8
    hashed = {r["id"]: r["h"] for r in df.select("id", F.xxhash64("id").alias("h")).collect()}
    import pandas as pd

    total = np.zeros(y.shape)
    for t in range(3):
        drawn = w if bagged is None else w * trees.draws(pd.Series([hashed[i] for i in range(len(x))]), t, 42, bagged)
        splits, values = slow_tree(b, y, drawn, 3, 12)
        assert {n: s for (u, n), s in forest.splits.items() if u == t} == splits
        at = forest.node(b, t)
        assert all(np.allclose(forest.values[t, n], values[n]) for n in np.unique(at))
        total += np.array([values[n] for n in at])
    got = {r["id"]: r["prediction"] for r in forest.transform(df, ["id"]).collect()}
    assert np.allclose([got[i] for i in range(len(x))], total / 3)
    assert abs(sum(forest.importance().values()) - 1) < 1e-9
    rows = trees.output_rows(forest.transform(df, ["id", *outputs]), ["id"], outputs, outputs).collect()
    assert len(rows) == 3 * len(x)


def test_samples_of_trees_are_poisson():
    import pandas as pd

    n = trees.draws(pd.Series(np.random.default_rng(0).integers(-(2**63), 2**63 - 1, 200_000)), 3, 42, 1.0)
    assert abs(n.mean() - 1) < 0.02 and abs(n.var() - 1) < 0.03
    again = trees.draws(pd.Series(np.random.default_rng(0).integers(-(2**63), 2**63 - 1, 200_000)), 4, 42, 1.0)
    assert abs(np.corrcoef(n, again)[0, 1]) < 0.02


def test_turned_output_mirrors_the_forest(spark):
    df, _, _, _, features, _ = tree_data(spark, 2)
    df = df.withColumn("turned", -F.col("y0"))
    one, two = (trees.multi_output_forest(df, ["id"], features, [o], trees=4, depth=2, bins=8) for o in ("y0", "turned"))
    a, b = ({r["id"]: r["prediction"][0] for r in m.transform(df, ["id"]).collect()} for m in (one, two))
    assert all(abs(a[i] + b[i]) < 1e-9 for i in a)


def test_boosting_learns_classes_and_stops(spark):
    rng = np.random.default_rng(10)
    kinds = ["red", "green", "blue", None]
    rows = []
    for i in range(900):
        k, m = kinds[rng.integers(4)], float(rng.normal())
        score = (k == "red") * 1.5 + (m > 0.3) * 1.0 + rng.normal(0, 0.3)
        rows.append((i, k, m, float(score), int(score > 0.6) + int(score > 1.4), "train" if i < 500 else "valid" if i < 700 else "test"))
    df = spark.createDataFrame(rows, "id long, kind string, macro double, ret double, y int, part string").repartition(3)
    codes = boosting.category_codes(df.filter("part = 'train'"), ["kind"], "ret")
    coded = boosting.with_codes(df, codes)
    assert coded.count() == 900 and coded.filter("kind_code IS NULL").count() == 0
    seen = {r["value"]: r["code"] for r in codes["kind"].collect()}
    mean = np.mean([r[3] for r in rows[:500]])
    for k in kinds:
        own = [r[3] for r in rows[:500] if r[1] == k]
        assert abs(seen[k] - (sum(own) + 20 * mean) / (len(own) + 20)) < 1e-9
    unseen = boosting.with_codes(spark.createDataFrame([(1, "new")], "id long, kind string"), codes).first()
    assert unseen["kind_code"] is None
    train, valid, test = (coded.filter(F.col("part") == p) for p in ("train", "valid", "test"))
    model = boosting.softmax_boost(train, valid, ["id"], ["kind_code", "macro"], "y", 3, rounds=10, depth=2, min_rows=5)
    out = model.transform(test, ["id", "y", "ret"]).collect()
    assert len(out) == 200 and all(abs(sum(r["probability"]) - 1) < 1e-9 for r in out)
    hit = np.mean([int(np.argmax(r["probability"])) == r["y"] for r in out])
    assert hit > 0.75
    scored = model.transform(test, ["id", "y", "ret"])
    report = {r["threshold"]: r for r in boosting.threshold_report(scored, [], F.col("probability")[2], F.col("y") == 2, "ret", [0.3, 0.6, 2.0]).collect()}
    top = [r for r in out if r["probability"][2] > 0.6]
    assert abs(report[0.6]["share"] - len(top) / 200) < 1e-9 and abs(report[0.6]["ret"] - np.mean([r["ret"] for r in top])) < 1e-9
    right = np.mean([r["probability"][2] > 0.6 for r in out if r["y"] == 2])
    wrong = np.mean([r["probability"][2] <= 0.6 for r in out if r["y"] != 2])
    assert abs(report[0.6]["balanced_accuracy"] - (right + wrong) / 2) < 1e-9 and report[2.0]["ret"] is None
