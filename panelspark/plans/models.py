"""Models on Spark ML, and factor clustering."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.evaluate import accuracy
from ..shipping import ship_package
from .linear import lasso_signs  # noqa: F401
from .training import group_split

#: Fits of a search at a time, and groups whose moments a task holds.
PARALLEL, HELD = 4, 256


def assemble(df: DataFrame, columns: list[str], name: str = "features") -> DataFrame:
    """A vector column; rows with a missing value are left out."""
    return VectorAssembler(inputCols=columns, outputCol=name, handleInvalid="skip").transform(df)


def principal_components(train: DataFrame, columns: list[str], share: float) -> tuple:
    """Standardize and rotate, fitted on training rows only; keeps the fewest
    components whose share of variance exceeds ``share``. Returns a function
    that transforms frames, the count, and the shares."""
    vectors = assemble(train, columns, "raw")
    scaler = StandardScaler(withMean=True, inputCol="raw", outputCol="scaled").fit(vectors)
    scaled = scaler.transform(vectors)
    shares = PCA(k=len(columns), inputCol="scaled", outputCol="pc").fit(scaled).explainedVariance.toArray()
    k = int(np.searchsorted(np.cumsum(shares), share, side="right")) + 1
    k = min(k, len(columns))
    model = PCA(k=k, inputCol="scaled", outputCol="features").fit(scaled)
    return (lambda df: model.transform(scaler.transform(assemble(df, columns, "raw")))), k, shares.tolist()


def forest(train: DataFrame, label: str, weight: str | None = None, **options) -> object:
    """A random forest for one factor's label on the vector ``features``."""
    model = RandomForestRegressor(labelCol=label, seed=options.pop("seed", 42), **options)
    return (model.setWeightCol(weight) if weight else model).fit(train)


def forests(train: DataFrame, valid: DataFrame, labels: list[str], grid: list[dict], metric: str = "mse", weight: str | None = None) -> dict[str, tuple]:
    """For each label the (model, options, error) with the least validation
    error among the sampled option sets; ``PARALLEL`` fits run at a time."""
    train, valid = train.persist(), valid.persist()

    def rated(job: tuple[str, int]) -> tuple:
        label, i = job
        model = forest(train.filter(F.col(label).isNotNull()), label, weight, **grid[i])
        scored = model.transform(valid.filter(F.col(label).isNotNull()))
        return RegressionEvaluator(labelCol=label, metricName=metric).evaluate(scored), i, model

    jobs = [(label, i) for label in labels for i in range(len(grid))]
    with ThreadPoolExecutor(PARALLEL) as pool:
        results = list(pool.map(rated, jobs))
    train.unpersist()
    valid.unpersist()
    out = {}
    for label in labels:
        error, i, model = min((r for r, job in zip(results, jobs) if job[0] == label), key=lambda r: r[:2])
        out[label] = (model, grid[i], error)
    return out


def mean_metrics(df: DataFrame, outputs: list[tuple[str, str]]) -> DataFrame:
    """mae, mse and r2 averaged over several (prediction, actual) outputs."""
    pairs = [F.struct(F.lit(i).alias("i"), F.col(p).alias("p"), F.col(a).alias("a")) for i, (p, a) in enumerate(outputs)]
    rows = df.select(F.explode(F.array(*pairs)).alias("x")).select("x.*")
    each = rows.groupBy("i").agg(*accuracy("p", "a", swapped=False))
    return each.agg(*[F.avg(c).alias(c) for c in ("mae", "mse", "r2")])


def sample_grid(options: dict[str, list], trials: int, seed: int = 42) -> list[dict]:
    """Random option sets from choice lists."""
    rng = np.random.default_rng(seed)
    return [{k: v[int(rng.integers(len(v)))] for k, v in options.items()} for _ in range(trials)]


def importance_rows(spark, model, names: list[str], uid: str) -> DataFrame:
    rows = [(uid, n, float(v)) for n, v in zip(names, model.featureImportances.toArray())]
    return spark.createDataFrame(rows, "uid string, name string, split double").orderBy(F.desc("split"))


def class_forest(train: DataFrame, label: str, weight: str | None = None, **options):
    model = RandomForestClassifier(labelCol=label, seed=options.pop("seed", 42), **options)
    return (model.setWeightCol(weight) if weight else model).fit(train)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Rows weighted inversely to the size of their class; classes are few."""
    sizes = df.groupBy(F.col(label).alias("__class")).agg(F.count("*").alias("__n"))
    share = sizes.agg((F.sum("__n") / F.count("*")).alias("__share"))
    sizes = sizes.crossJoin(F.broadcast(share)).select("__class", (F.col("__share") / F.col("__n")).alias("weight"))  # one row
    return df.join(F.broadcast(sizes), F.col(label).eqNullSafe(F.col("__class"))).drop("__class")  # one row a class


def crossed(df: DataFrame, keys: list[str], fit: Callable[[DataFrame], object]) -> DataFrame:
    """Every row scored by a model of the other half, halves by hash of ``keys``."""
    halves = group_split(df, keys, 0.5)
    a, b = (halves.filter(F.col("part") == p) for p in ("train", "valid"))
    return fit(a).transform(b).unionByName(fit(b).transform(a)).drop("part")


def threshold_returns(scored: DataFrame, cls: int, ret: str, thresholds: list[float]) -> DataFrame:
    """Mean return of the rows whose class probability reaches each threshold."""
    p = vector_to_array("probability")[cls]
    tried = scored.select(p.alias("p"), ret, F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    return tried.filter("p >= threshold").groupBy("threshold").agg(F.avg(ret).alias("ret"), F.count("*").alias("n"))


def linear_classifier(train: DataFrame, label: str, l1: float = 1.0, strength: float = 0.01):
    return LogisticRegression(labelCol=label, elasticNetParam=l1, regParam=strength).fit(train)


def ridge(train: DataFrame, label: str, strength: float = 1.0):
    return LinearRegression(labelCol=label, elasticNetParam=0.0, regParam=strength).fit(train)


def correlation_matrix(df: DataFrame, columns: list[str]) -> np.ndarray:
    """F x F matrix; only that reaches the driver."""
    return Correlation.corr(assemble(df, columns), "features").head()[0].toArray()


def variance_inflation(df: DataFrame, columns: list[str]) -> DataFrame:
    """Diagonal of the inverse correlation matrix; singular ones give zero."""
    try:
        vif = np.diag(np.linalg.inv(correlation_matrix(df, columns)))
    except np.linalg.LinAlgError:
        vif = np.zeros(len(columns))
    rows = [(c, float(v) if np.isfinite(v) else 0.0) for c, v in zip(columns, vif)]
    return df.sparkSession.createDataFrame(rows, "field string, vif double")


def average_linkage(names: list[str], distance: np.ndarray) -> list[tuple[list[str], list[str], float]]:
    """Merges of average-linkage clustering in rising distance; ties go to the
    pair that comes first.

    Each cluster remembers the nearest of those behind it. A merge changes one row
    of distances, and only clusters whose nearest it took look for another, so the
    whole takes about the square of the names, not their cube.
    """
    n = len(names)
    sums, sizes = distance.astype(float).copy(), np.ones(n)  # of distances between members
    members, alive = {i: [i] for i in range(n)}, np.ones(n, bool)
    near, gap = np.zeros(n, int), np.full(n, np.inf)

    def look(i: int) -> None:
        behind = np.flatnonzero(alive[i + 1 :]) + i + 1
        if len(behind):
            mean = sums[i, behind] / (sizes[i] * sizes[behind])
            near[i], gap[i] = behind[mean.argmin()], mean.min()
        else:
            gap[i] = np.inf

    for i in range(n):
        look(i)
    out = []
    for _ in range(n - 1):
        a = int(np.argmin(np.where(alive, gap, np.inf)))
        b = int(near[a])
        out.append(([names[i] for i in members[a]], [names[i] for i in members[b]], float(gap[a])))
        members[a] += members.pop(b)
        sums[a] += sums[b]
        sums[:, a] += sums[:, b]
        sizes[a] += sizes[b]
        alive[b] = False
        look(a)
        before = np.flatnonzero(alive[:a])
        mean = sums[before, a] / (sizes[before] * sizes[a])
        nearer = (mean < gap[before]) | ((mean == gap[before]) & (a < near[before]))
        lost = alive.copy()
        lost[before[nearer]] = False
        near[before[nearer]], gap[before[nearer]] = a, mean[nearer]
        for i in np.flatnonzero(lost[:b] & np.isin(near[:b], (a, b))):
            if i != a:
                look(int(i))
    return out


def clusters_below(names: list[str], merges: list, threshold: float) -> list[list[str]]:
    """Groups of more than one name joined up to the threshold."""
    group = {n: frozenset([n]) for n in names}
    for a, b, d in merges:
        if d <= threshold:
            joined = frozenset(a) | frozenset(b)
            group.update(dict.fromkeys(joined, joined))
    return sorted(sorted(g) for g in set(group.values()) if len(g) > 1)


def cluster_factors(panel: DataFrame, keys: list[str], factors: list[str], sub_at: int = 5, pillar_at: int = -2) -> DataFrame:
    """Pillars of similar factors per group."""
    return cluster_moments(moments(panel, keys, factors), keys, factors, sub_at, pillar_at)


def moments(panel: DataFrame, keys: list[str], factors: list[str]) -> DataFrame:
    """(keys, i, j, n, a, b, aa, bb, ab) for each pair of factors: count, sums,
    sums of squares and of products; a null counts as zero.

    Tasks add up their rows by matrix products and pass sums on, which Spark
    adds up again; a task holds ``HELD`` groups at most.
    """
    ship_package(panel.sparkSession)
    kinds = panel.select(*keys).schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds)
    schema += ", i int, j int, n double, a double, b double, aa double, bb double, ab double"
    left, right = np.triu_indices(len(factors), 1)
    names = [*keys, "i", "j", "n", "a", "b", "aa", "bb", "ab"]

    def tables(sums: dict) -> pd.DataFrame:
        out = []
        for k, (n, s, g) in sums.items():
            t = pd.DataFrame({"i": left, "j": right, "n": float(n), "a": s[left], "b": s[right], "aa": g[left, left], "bb": g[right, right], "ab": g[left, right]})
            out.append(t.assign(**dict(zip(keys, k)))[names])
        return pd.concat(out)

    def run(frames):
        sums: dict = {}
        for f in frames:
            for k, part in f.groupby(keys, dropna=False):
                x = part[factors].fillna(0.0).to_numpy(float)
                n, s, g = sums.get(k, (0, 0.0, 0.0))
                sums[k] = (n + len(x), s + x.sum(axis=0), g + x.T @ x)
            if len(sums) > HELD:
                yield tables(sums)
                sums = {}
        if sums:
            yield tables(sums)

    rows = panel.select(*keys, *factors).mapInPandas(run, schema)
    return rows.groupBy(*keys, "i", "j").agg(*[F.sum(c).alias(c) for c in names[-6:]])


def pair_correlation() -> Column:
    """Of moments; zero where a factor is constant."""
    spread = lambda s, q: F.col("n") * F.col(q) - F.col(s) * F.col(s)
    both = spread("a", "aa") * spread("b", "bb")
    return F.when((spread("a", "aa") > 0) & (spread("b", "bb") > 0), (F.col("n") * F.col("ab") - F.col("a") * F.col("b")) / F.sqrt(both)).otherwise(0.0)


def cluster_windows(panel: DataFrame, periods: DataFrame, group: str, day: str, factors: list[str], weeks: int, years: int = 5, **limits: int) -> DataFrame:
    """Pillars per group and testing period, of the rows of the ``years`` that
    end ``weeks`` after the period. Rows are reduced to moments a day first, so
    windows that overlap add up days, not rows."""
    daily = moments(panel, [group, day], factors)
    end = F.date_add("testing_period", 7 * weeks)
    inside = (F.col(day) <= end) & (F.col(day) > F.add_months(end, -12 * years))
    rows = daily.join(F.broadcast(periods.select("testing_period").distinct()), inside)  # a list of periods
    sums = rows.groupBy(group, "testing_period", "i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "a", "b", "aa", "bb", "ab")])
    return cluster_moments(sums, [group, "testing_period"], factors, **limits)


def cluster_moments(sums: DataFrame, keys: list[str], factors: list[str], sub_at: int = 5, pillar_at: int = -2) -> DataFrame:
    """Pillars of similar factors per group of moments.

    Only an F x F table per group reaches Python. The distance of standardized
    columns is sqrt(2 n (1 - r)). Sub-pillars join up to the merge distance
    ``sub_at``, pillars up to ``pillar_at``.
    """
    ship_package(sums.sparkSession)
    distance = F.sqrt(F.greatest(F.lit(0.0), 2 * F.col("n") * (1 - pair_correlation())))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sums.select(*keys).schema)

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        d, rows = np.zeros((len(factors), len(factors))), []
        d[pdf["i"], pdf["j"]] = d[pdf["j"], pdf["i"]] = pdf["d"]
        merges = average_linkage(factors, d)
        limits = {"subpillar": merges[min(sub_at, len(merges) - 1)][2], "pillar": merges[max(pillar_at, -len(merges))][2]}
        for kind, limit in limits.items():
            for i, names in enumerate(clusters_below(factors, merges, limit)):
                rows.append((*key, f"{kind}_{i}", names, float(limit)))
        return pd.DataFrame(rows, columns=[*keys, "pillar", "factor_list", "threshold"])

    table = sums.select(*keys, "i", "j", distance.alias("d"))
    return table.groupBy(*keys).applyInPandas(merge, f"{schema}, pillar string, factor_list array<string>, threshold double")
