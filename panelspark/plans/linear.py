"""Many small linear models at once, from sums of products.

A model of d inputs needs its rows' d x d sums of products only. Tasks add up the
rows of each group as matrices and pass the cells on, Spark adds those up, and
each group's model is solved from its few cells: coordinate descent for the
Lasso, Newton steps (each one pass for all models) for the logistic one. Windows
that overlap add up the sums of days, not rows. Nothing is looped over groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio
from ..operators.calendar import over
from ..shipping import ship_package
from ..sources.sinks import settle

#: Groups whose sums a task holds at a time.
HELD = 256
TOLERANCE, SWEEPS, NEWTONS = 1e-10, 10_000, 30


def lagged(panel: DataFrame, keys: list[str], day: str, value: str, lookback: int, forward: int = 1) -> DataFrame:
    """(keys, day, x, y): the value as y, and as x the ``lookback`` values that end
    ``forward`` rows before it, oldest first; rows without all of them go."""
    w = over(keys, day)
    x = F.array(*[F.lag(value, forward + i).over(w).cast("double") for i in reversed(range(lookback))])
    out = panel.select(*keys, day, x.alias("x"), F.col(value).cast("double").alias("y"))
    return out.filter(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v)) & F.col("y").isNotNull() & ~F.isnan("y"))


def gram_sums(rows: DataFrame, keys: list[str], d: int) -> DataFrame:
    """(keys, cell, s) of rows (keys, x, y): the sums of products of (1, x, y), a
    (d + 2)-square matrix by rows."""
    ship_package(rows.sparkSession)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)

    def table(sums: dict) -> pd.DataFrame:
        out = [pd.DataFrame({"cell": np.arange((d + 2) ** 2), "s": g.ravel()}).assign(**dict(zip(keys, k))) for k, g in sums.items()]
        return pd.concat(out)[[*keys, "cell", "s"]]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for f in frames:
            if len(f):
                z = np.column_stack([np.ones(len(f)), np.array(f["x"].tolist(), float).reshape(len(f), d), f["y"].to_numpy(float)])
                for k, at in f.groupby(keys, dropna=False).indices.items():
                    k = k if isinstance(k, tuple) else (k,)
                    sums[k] = sums.get(k, 0.0) + z[at].T @ z[at]
            if len(sums) > HELD:
                yield table(sums)
                sums = {}
        if sums:
            yield table(sums)

    return rows.select(*keys, "x", "y").mapInPandas(run, f"{fields}, cell int, s double").groupBy(*keys, "cell").agg(F.sum("s").alias("s"))


def descend(g: np.ndarray, c: np.ndarray, strength: float, start: np.ndarray | None = None) -> np.ndarray:
    """Coordinate descent on w g w / 2 - c w + strength |w|."""
    w = np.zeros(len(c)) if start is None else start.copy()
    for _ in range(SWEEPS):
        most = 0.0
        for j in range(len(c)):
            if g[j, j] <= 0:
                continue
            r = c[j] - g[j] @ w + g[j, j] * w[j]
            new = np.sign(r) * max(abs(r) - strength, 0.0) / g[j, j]
            most, w[j] = max(most, abs(new - w[j])), new
        if most <= TOLERANCE * max(1.0, np.abs(w).max(initial=0)):
            break
    return w


def lasso(sums: np.ndarray, strength: float) -> tuple[float, np.ndarray]:
    """(intercept, weights) with the least mean squared error / 2 + strength * |w|."""
    n, mean = sums[0, 0], sums[0] / sums[0, 0]
    central = sums / n - np.outer(mean, mean)
    w = descend(central[1:-1, 1:-1], central[1:-1, -1], strength)
    return float(mean[-1] - mean[1:-1] @ w), w


def solved(sums: DataFrame, keys: list[str], d: int, strengths: list[float]) -> DataFrame:
    """(keys, strength, n, intercept, weights) of each group's sums."""
    ship_package(sums.sparkSession)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sums.select(*keys).schema)

    def fit(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        g = np.zeros((d + 2) ** 2)
        g[f["cell"]] = f["s"]
        g = g.reshape(d + 2, d + 2)
        models = [(s, *lasso(g, s)) for s in strengths]
        return pd.DataFrame([(*key, s, g[0, 0], b, w.tolist()) for s, b, w in models], columns=[*keys, "strength", "n", "intercept", "weights"])

    return sums.groupBy(*keys).applyInPandas(fit, f"{fields}, strength double, n double, intercept double, weights array<double>")


def predicted(x: str = "x") -> Column:
    return F.aggregate(F.zip_with("weights", x, lambda w, v: w * v), F.col("intercept"), lambda s, v: s + v)


def lasso_forecasts(panel: DataFrame, key: str, day: str, value: str, strength: float, lookback: int, forward: int = 1) -> DataFrame:
    """Each factor's next value by a Lasso of its own: (key, day, n, prediction,
    is_reversed), one row a factor, ``day`` being its last.

    A factor learns from all its windows of ``lookback`` values and the value
    ``forward`` rows later, and predicts from its last ``lookback`` values; what it
    predicts is in no window. Missing values count as zero.
    """
    panel = panel.select(key, day, F.coalesce(F.nanvl(F.col(value).cast("double"), F.lit(0.0)), F.lit(0.0)).alias("__v"))
    models = solved(gram_sums(lagged(panel, [key], day, "__v", lookback, forward), [key], lookback), [key], lookback, [strength])
    w = over([key], day)
    last = F.array(*[F.lag("__v", i).over(w) for i in reversed(range(lookback))])
    now = panel.select(key, day, last.alias("x"), F.lead(day).over(w).isNull().alias("__last")).filter("__last AND forall(x, v -> v IS NOT NULL)")
    out = now.join(models.select(F.col(key).alias("__of"), "n", "intercept", "weights"), F.col(key).eqNullSafe(F.col("__of")))
    return out.select(key, day, F.col("n").cast("long").alias("n"), predicted().alias("prediction")).withColumn("is_reversed", F.col("prediction") < 0)


def lasso_signs(panel: DataFrame, key: str, day: str, value: str, alpha: float, steps: list[int], ahead: int = 1, share: float = 0.25) -> DataFrame:
    """Forecasts of the value ``ahead`` rows later from a row's own lags, by a Lasso
    for each key; a negative one reverses the factor. Rows of the last ``share`` of
    the days are forecast by models of rows whose value ahead was known before them."""
    w = over([key], day)
    x = F.array(*[F.lag(value, i).over(w).cast("double") for i in steps])
    data = panel.select(key, day, value, x.alias("x"), F.lead(value, ahead).over(w).cast("double").alias("y"), F.lead(day, ahead).over(w).alias("__on"))
    cut = panel.select(day).distinct().agg(F.percentile(F.unix_date(day), F.lit(1 - share)).alias("__cut"))
    data = data.filter(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v))).crossJoin(F.broadcast(cut))  # one row
    known = data.filter(F.col("y").isNotNull() & (F.unix_date("__on") <= F.col("__cut")))
    models = solved(gram_sums(known, [key], len(steps)), [key], len(steps), [alpha]).select(F.col(key).alias("__of"), "intercept", "weights")
    out = data.filter(F.unix_date(day) > F.col("__cut")).join(models, F.col(key).eqNullSafe(F.col("__of")))
    return out.select(key, day, value, predicted().alias("prediction")).withColumn("is_reversed", F.col("prediction") < 0)


# walk-forward


def last_periods(panel: DataFrame, day: str, n: int) -> DataFrame:
    """The last ``n`` days of the panel."""
    return panel.select(F.col(day).alias("test_period")).distinct().orderBy(F.desc("test_period")).limit(n)


def sign_scores(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows (keys, y, up): how well ``up`` tells the sign of y; the difference
    that turning the others round makes to the mean of y."""
    p, a = F.col("up"), F.col("y") > 0
    share = lambda c: F.avg(c.cast("double"))
    n = lambda c: F.sum(c.cast("double"))
    return scored.groupBy(*keys).agg(
        F.count("*").alias("n"),
        share(p == a).alias("accuracy"),
        ratio(n(p & a), n(p)).alias("precision"),
        ratio(n(p & a), n(a)).alias("recall"),
        (F.avg(F.when(p, F.col("y")).otherwise(-F.col("y"))) - F.avg("y")).alias("avg_diff"),
        share(a).alias("actual_up"),
        share(p).alias("pred_up"),
    )


def lasso_walk_forward(panel: DataFrame, keys: list[str], day: str, value: str, lookbacks: list[int], strengths: list[float], tests: int) -> DataFrame:
    """Back-test of the sign of the next value, by Lassos over all keys together:
    scores per (lookback, strength, test_period). The model of a test period has
    seen the days before it only."""
    periods, out = last_periods(panel, day, tests), None
    for d in lookbacks:
        rows = lagged(panel, keys, day, value, d)
        daily = gram_sums(rows, [day], d)
        sums = daily.join(F.broadcast(periods), F.col(day) < F.col("test_period"))  # `tests` rows
        models = solved(sums.groupBy("test_period", "cell").agg(F.sum("s").alias("s")), ["test_period"], d, strengths)
        scored = rows.join(models, F.col(day) == F.col("test_period")).select("test_period", "strength", "y", (predicted() > 0).alias("up"))
        each = sign_scores(scored, ["strength", "test_period"]).withColumn("lookback", F.lit(d))
        out = each if out is None else out.unionByName(each)
    return out


def newton_cells(rows: DataFrame, day: str, d: int, models: dict, periods: list) -> list:
    """Per (test period, strength): sums for a Newton step at the present weights."""
    ship_package(rows.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = {m: np.zeros((d + 1, d + 2)) for m in models}
        for f in frames:
            if not len(f):
                continue
            z = np.column_stack([np.ones(len(f)), np.array(f["x"].tolist(), float).reshape(len(f), d)])
            y, on = (f["y"].to_numpy(float) > 0).astype(float), f[day].to_numpy()
            for (i, s), w in models.items():
                seen = on < periods[i]
                u = z[seen]
                p = 1 / (1 + np.exp(-np.clip(u @ w, -500, 500)))
                total[i, s][:, :-1] += (u * (p * (1 - p))[:, None]).T @ u
                total[i, s][:, -1] += u.T @ (y[seen] - p)
        for (i, s), g in total.items():
            yield pd.DataFrame({"i": i, "strength": s, "cell": np.arange(g.size), "s": g.ravel()})

    each = rows.select(day, "x", "y").mapInPandas(run, "i int, strength double, cell int, s double")
    return each.groupBy("i", "strength", "cell").agg(F.sum("s").alias("s")).collect()  # models x d squared


def logistic_fits(rows: DataFrame, day: str, d: int, strengths: list[float], periods: list, counts: list[int]) -> dict:
    """L1-logistic weights (intercept first, not penalised) of all (period,
    strength): least mean loss + strength * |w| over the days before the period.

    Each step is one pass for all models: gradients and curvatures are summed, and
    coordinate descent takes the penalised quadratic to its least point. A step is
    halved where the model's curvature has faded.
    """
    models = {(i, s): np.zeros(d + 1) for i in range(len(periods)) for s in strengths if counts[i]}
    done: dict = {}
    for _ in range(NEWTONS):
        if not models:
            break
        cells: dict = {m: np.zeros((d + 1) * (d + 2)) for m in models}
        for r in newton_cells(rows, day, d, models, periods):
            cells[r["i"], r["strength"]][r["cell"]] = r["s"]
        for (i, s), g in cells.items():
            g = g.reshape(d + 1, d + 2) / counts[i]
            w, h, grad = models[i, s], g[:, :-1] + 1e-9 * np.eye(d + 1), g[:, -1]
            new = penalised(h, h @ w + grad, s, w)
            step = np.abs(new - w).max()
            models[i, s] = new if step <= 2 else w + (new - w) * 2 / step
            if step < 1e-7:
                done[i, s] = models[i, s]
        models = {m: w for m, w in models.items() if m not in done}
    return done | models


def penalised(h: np.ndarray, c: np.ndarray, strength: float, start: np.ndarray) -> np.ndarray:
    """The least point of w h w / 2 - c w + strength * |w|, the first weight free."""
    # the free weight is what makes its gradient zero: eliminated, then put back
    a = h[1:, 1:] - np.outer(h[1:, 0], h[0, 1:]) / h[0, 0]
    w = descend(a, c[1:] - h[1:, 0] * c[0] / h[0, 0], strength, start[1:])
    return np.concatenate([[(c[0] - h[0, 1:] @ w) / h[0, 0]], w])


def logistic_walk_forward(panel: DataFrame, keys: list[str], day: str, value: str, lookbacks: list[int], strengths: list[float], tests: int) -> DataFrame:
    """As ``lasso_walk_forward``, with L1-penalised logistic models of the sign."""
    spark, out = panel.sparkSession, None
    periods = sorted(r["test_period"] for r in last_periods(panel, day, tests).collect())  # `tests` days
    for d in lookbacks:
        rows = settle(lagged(panel, keys, day, value, d), "lagged")
        before = [F.sum((F.col(day) < F.lit(p)).cast("long")).alias(f"n{i}") for i, p in enumerate(periods)]
        counts = [n or 0 for n in rows.agg(*before).first()] if periods else []
        fits = logistic_fits(rows, day, d, strengths, periods, counts)
        kind = rows.schema[day].dataType.simpleString()
        schema = f"test_period {kind}, strength double, intercept double, weights array<double>"
        models = spark.createDataFrame([(periods[i], s, float(w[0]), w[1:].tolist()) for (i, s), w in fits.items()], schema)
        scored = rows.join(models, F.col(day) == F.col("test_period")).select("test_period", "strength", "y", (predicted() > 0).alias("up"))
        each = sign_scores(scored, ["strength", "test_period"]).withColumn("lookback", F.lit(d))
        out = each if out is None else out.unionByName(each)
    return out


def best_setting(scores: DataFrame, settings: list[str], metric: str = "avg_diff") -> DataFrame:
    """Mean of the metrics over the test periods, best setting first by ``metric``."""
    metrics = ["accuracy", "precision", "recall", "avg_diff", "actual_up", "pred_up"]
    out = scores.groupBy(*settings).agg(F.count("*").alias("periods"), *[F.avg(m).alias(m) for m in metrics])
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.desc(metric), *settings)))
