"""Forests with several outputs, and boosted trees, grown level by level.

Features become bins once. All trees of a forest grow together: a level is one
pass in which each task adds the weights and output sums of its rows up by (tree,
node, feature, bin) in arrays of a size set by the parameters; Spark adds these up,
takes running sums over the bins, and the best split of each node. The driver sees
one row per node. Rows aren't moved or copied, whatever the number of trees.

A split is the one that lowers the squared error of all outputs together the most;
of equal splits the first feature and the least bin. A leaf predicts the mean of
each output.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship_package
from ..sources.sinks import settle

#: The share of a node's squares that a split must gain, beyond rounding.
LEAST_GAIN = 1e-12


@dataclass
class Forest:
    """Trees over binned features; ``splits`` maps (tree, node) to (feature, bin),
    ``values`` to the means of the outputs. Node i has the children 2 i + 1 and
    2 i + 2."""

    features: list[str]
    edges: list[np.ndarray]
    outputs: int
    trees: int
    splits: dict = field(default_factory=dict)
    values: dict = field(default_factory=dict)
    gains: np.ndarray | None = None

    def binned(self, x: np.ndarray) -> np.ndarray:
        """Bins of the features; a missing value is in the first."""
        out = np.zeros(x.shape, np.int32)
        for j, e in enumerate(self.edges):
            out[:, j] = np.where(np.isnan(x[:, j]), 0, np.searchsorted(e, x[:, j], side="left"))
        return out

    def node(self, b: np.ndarray, tree: int) -> np.ndarray:
        """The node of each binned row so far."""
        at = np.zeros(len(b), np.int64)
        for n in sorted(n for t, n in self.splits if t == tree):
            here = np.flatnonzero(at == n)
            if len(here):
                f, cut = self.splits[tree, n]
                at[here] = np.where(b[here, f] <= cut, 2 * n + 1, 2 * n + 2)
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Means over the trees, rows by outputs."""
        return self.predict_bins(self.binned(x))

    def predict_bins(self, b: np.ndarray) -> np.ndarray:
        total = np.zeros((len(b), self.outputs))
        for t in range(self.trees):
            at = self.node(b, t)
            known, where = np.unique(at, return_inverse=True)
            total += np.array([self.values[t, n] for n in known]).reshape(len(known), -1)[where]
        return total / self.trees

    def transform(self, df: DataFrame, keep: list[str], name: str = "prediction") -> DataFrame:
        """``keep`` and an array of predictions per row; no shuffle."""
        ship_package(df.sparkSession)
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                out = f[keep].copy()
                out[name] = list(self.predict(f[self.features].to_numpy(float)))
                yield out

        return df.select(*dict.fromkeys([*keep, *self.features])).mapInPandas(run, f"{fields}, `{name}` array<double>")

    def importance(self) -> dict[str, float]:
        """Share of each feature in what all splits gained."""
        total = self.gains.sum() or 1.0
        return {f: float(g / total) for f, g in zip(self.features, self.gains)}


def feature_edges(df: DataFrame, features: list[str], bins: int) -> list[np.ndarray]:
    """Inner edges of at most ``bins`` bins of each feature, near its quantiles."""
    shares = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    row = df.agg(*[F.percentile_approx(F.when(~F.isnan(c), F.col(c)), shares, F.lit(100 * bins)).alias(f"e{i}") for i, c in enumerate(features)]).first()
    return [np.unique(np.array(row[f"e{i}"] or [], float)) for i in range(len(features))]


def draws(keys: pd.Series, tree: int, seed: int, share: float) -> np.ndarray:
    """How often a tree's sample holds each row: Poisson numbers of mean ``share``
    told by the row's hash, so a row is drawn alike wherever it is read."""
    own = np.uint64(0x9E3779B97F4A7C15 * (1 + tree + 1000 * seed) % 2**64)
    mixed = (keys.to_numpy(np.uint64) + own) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(31)
    u = ((mixed * np.uint64(0x94D049BB133111EB)) >> np.uint64(11)).astype(float) / 2.0**53
    term, total, out = np.exp(-share), np.exp(-share), np.zeros(len(u))
    for k in range(1, 12):
        out += u > total
        term *= share / k
        total += term
    return out


def grow(
    rows: DataFrame, forest: Forest, outputs: list[str], weight: str, depth: int, min_rows: float, subset: float = 1.0,
    bagged: float | None = None, min_gain: float = 0.0, seed: int = 42,
) -> Forest:
    """Grow ``forest`` on ``rows`` (``__bins``, ``__hash``, outputs, weight).

    ``subset`` is the share of features that a node may split by, ``bagged`` the
    mean number of times that a tree's sample holds a row (none: all rows once);
    ``min_rows`` the weight that a child needs."""
    ship_package(rows.sparkSession)
    n_features, n_bins, k = len(forest.features), max(len(e) for e in forest.edges) + 1, len(outputs)
    tried = max(1, round(subset * n_features))
    forest.gains = np.zeros(n_features)
    open_ = {(t, 0) for t in range(forest.trees)}
    sums = [f"s{i}" for i in range(k)]
    schema = "tree int, node bigint, feature int, bin int, w double, " + ", ".join(f"{s} double" for s in sums)

    def allowed(tree: int, node: int) -> np.ndarray:
        return np.sort(np.random.default_rng([seed, tree, node]).permutation(n_features)[:tried])

    for level in range(depth + 1):
        at_level = sorted(open_)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            slots = {key: i for i, key in enumerate(at_level)}
            total = np.zeros((len(slots), n_features, n_bins, k + 1))
            for f in frames:
                b, w = np.array(f["__bins"].tolist(), np.int64).reshape(len(f), -1), f[weight].to_numpy(float)
                y = np.column_stack([np.ones(len(f)), f[outputs].to_numpy(float)])
                for t in range(forest.trees):
                    v = w if bagged is None else w * draws(f["__hash"], t, seed, bagged)
                    at = forest.node(b, t)
                    for n in np.unique(at[v > 0]):
                        if (t, int(n)) in slots:
                            mine = np.flatnonzero((at == n) & (v > 0))
                            wy = y[mine] * v[mine, None]
                            for j in allowed(t, int(n)):
                                np.add.at(total[slots[t, int(n)], j], b[mine, j], wy)
            i, j, c = np.nonzero(total[..., 0])
            out = pd.DataFrame({"tree": [at_level[x][0] for x in i], "node": [at_level[x][1] for x in i], "feature": j, "bin": c, "w": total[i, j, c, 0]})
            for x, s in enumerate(sums):
                out[s] = total[i, j, c, x + 1]
            yield out

        cells = rows.mapInPandas(run, schema).groupBy("tree", "node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in ("w", *sums)])
        found = best_splits(cells, sums, min_rows).collect()  # one row a node
        children = set()
        for r in found:
            key, total = (r["tree"], r["node"]), [r["total"]["w"], *r["total"]["s"]]
            forest.values[key] = np.array(total[1:]) / total[0]
            if level < depth and r["best"] is not None and r["best"]["gain"] > min_gain:
                forest.splits[key] = (r["best"]["feature"], r["best"]["bin"])
                forest.gains[r["best"]["feature"]] += r["best"]["gain"]
                children |= {(key[0], 2 * key[1] + 1), (key[0], 2 * key[1] + 2)}
        for key in set(at_level) - {(r["tree"], r["node"]) for r in found}:
            forest.values[key] = np.zeros(k)  # a sample without rows
        if not children:
            break
        open_ = children
    return forest


def best_splits(cells: DataFrame, sums: list[str], min_rows: float) -> DataFrame:
    """(tree, node, total, best) of sums by (tree, node, feature, bin)."""
    w = Window.partitionBy("tree", "node", "feature")
    left = w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # bins of a feature
    run = cells.withColumns({f"l_{c}": F.sum(c).over(left) for c in ("w", *sums)} | {f"t_{c}": F.sum(c).over(w) for c in ("w", *sums)})
    other = F.col("t_w") - F.col("l_w")
    gain = sum((F.col(f"l_{s}") ** 2 / F.col("l_w") + (F.col(f"t_{s}") - F.col(f"l_{s}")) ** 2 / other - F.col(f"t_{s}") ** 2 / F.col("t_w") for s in sums), F.lit(0.0))
    squares = sum((F.col(f"t_{s}") ** 2 for s in sums), F.lit(0.0)) / F.col("t_w")
    fits = (F.col("l_w") >= min_rows) & (other >= min_rows) & (other > 0) & (gain > LEAST_GAIN * squares)
    # as a float, so that splits that gain alike are a tie whatever the order of their sums
    tried = F.when(fits, F.struct((gain / F.col("t_w")).cast("float").alias("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b")))
    out = run.groupBy("tree", "node").agg(
        F.first(F.struct(F.col("t_w").alias("w"), F.array(*[F.col(f"t_{s}") for s in sums]).alias("s"))).alias("total"), F.max(tried).alias("best")
    )
    best = F.when(F.col("best").isNotNull(), F.struct(F.col("best.gain").alias("gain"), (-F.col("best.f")).alias("feature"), (-F.col("best.b")).alias("bin")))
    return out.select("tree", "node", "total", best.alias("best"))


def prepared(train: DataFrame, forest: Forest, keys: list[str], outputs: list[str], weight: str | None) -> DataFrame:
    """Rows with their bins and hash, written once; rows without all outputs go."""
    ship_package(train.sparkSession)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = train.dropna("any", subset=outputs).select(
        F.xxhash64(*keys).alias("__hash"), w.alias("__w"), *[F.col(c).cast("double").alias(c) for c in dict.fromkeys([*outputs, *forest.features])]
    )
    schema = "__hash bigint, __w double, __bins array<int>, " + ", ".join(f"`{o}` double" for o in outputs)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = f[["__hash", "__w"]].copy()
            out["__bins"] = list(forest.binned(f[forest.features].to_numpy(float)))
            yield pd.concat([out, f[outputs]], axis=1)

    return settle(rows.mapInPandas(run, schema), "binned")


def multi_output_forest(
    train: DataFrame, keys: list[str], features: list[str], outputs: list[str], trees: int = 10, depth: int = 4, bins: int = 32,
    min_rows: float = 1, subset: float = 1 / 3, weight: str | None = None, bagged: float | None = 1.0, seed: int = 42,
) -> Forest:
    """One random forest for all ``outputs``; ``keys`` tell rows apart for the
    trees' samples. Rows without all outputs don't count; missing features are
    in the first bin."""
    forest = Forest(features, feature_edges(train, features, bins), len(outputs), trees)
    rows = prepared(train, forest, keys, outputs, weight)
    return grow(rows, forest, outputs, "__w", depth, min_rows, subset, bagged, seed=seed)


def output_rows(df: DataFrame, keys: list[str], outputs: list[str], actual: list[str], prediction: str = "prediction") -> DataFrame:
    """(keys, output, actual, pred): predictions of several outputs as rows."""
    each = F.array(*[F.struct(F.lit(o).alias("output"), F.col(a).alias("actual"), F.col(prediction)[i].alias("pred")) for i, (o, a) in enumerate(zip(outputs, actual))])
    return df.select(*keys, F.explode(each).alias("x")).select(*keys, "x.*")
