"""Softmax boosting over configuration and macro columns, and how far its
probabilities pay.

Each round grows one tree with an output per class on the gradient of the loss,
(class is k) - p_k, by ``trees.grow``. Rows keep their bins only: their scores are
worked out from the trees so far whenever they are read, so a round writes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ratio
from ..operators.quantiles import renamed, same
from ..shipping import ship_package
from .trees import Forest, feature_edges, grow, prepared


def category_codes(train: DataFrame, columns: list[str], outcome: str, prior_rows: float = 20.0) -> dict[str, DataFrame]:
    """For each category column a table (value, code): the mean outcome of the
    training rows of that value, drawn to the mean of all as by ``prior_rows`` rows."""
    mean = train.agg(F.avg(outcome).alias("__mean"))
    out = {}
    for c in columns:
        each = train.groupBy(F.col(c).alias("value")).agg(F.sum(outcome).alias("__s"), F.count(outcome).alias("__n"))
        code = (F.col("__s") + prior_rows * F.col("__mean")) / (F.col("__n") + prior_rows)
        out[c] = each.crossJoin(F.broadcast(mean)).select("value", F.coalesce(code, F.col("__mean")).alias("code"))  # one row
    return out


def with_codes(df: DataFrame, codes: dict[str, DataFrame], suffix: str = "_code") -> DataFrame:
    """``df`` with a number for each category; values not met in training are null."""
    for c, table in codes.items():
        named, pairs = renamed(table.withColumnRenamed("code", f"{c}{suffix}"), ["value"], "__of_")
        df = df.join(named, same([(c, pairs[0][1])]), "left").drop(pairs[0][1])
    return df


@dataclass
class Boosted:
    """Classes' log shares at first, and the trees of the rounds."""

    base: np.ndarray
    rate: float
    trees: list[Forest] = field(default_factory=list)

    def probabilities(self, b: np.ndarray) -> np.ndarray:
        score = np.tile(self.base, (len(b), 1))
        for t in self.trees:
            score += self.rate * t.predict_bins(b)
        e = np.exp(score - score.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def transform(self, df: DataFrame, keep: list[str], name: str = "probability") -> DataFrame:
        """``keep`` and an array of class probabilities per row; no shuffle."""
        ship_package(df.sparkSession)
        first = self.trees[0]
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                out = f[keep].copy()
                out[name] = list(self.probabilities(first.binned(f[first.features].to_numpy(float))))
                yield out

        return df.select(*dict.fromkeys([*keep, *first.features])).mapInPandas(run, f"{fields}, `{name}` array<double>")


def softmax_boost(
    train: DataFrame, valid: DataFrame, keys: list[str], features: list[str], label: str, classes: int, rounds: int = 20, depth: int = 3,
    rate: float = 0.3, bins: int = 32, min_rows: float = 20, weight: str | None = None, patience: int = 3,
) -> Boosted:
    """Boosted trees for the classes 0, 1, ... of ``label``; ends when the loss on
    ``valid`` hasn't fallen for ``patience`` rounds, and keeps the best number."""
    start = Forest(features, feature_edges(train, features, bins), classes, 1)
    rows, held = (prepared(d.withColumn("__y", F.col(label).cast("double")), start, keys, ["__y"], weight) for d in (train, valid))
    shares = {int(r["__y"]): r["w"] for r in rows.groupBy("__y").agg(F.sum("__w").alias("w")).collect()}  # classes
    share = np.array([shares.get(k, 0.0) for k in range(classes)]) + 1e-9
    model = Boosted(np.log(share / share.sum()), rate)
    outputs = [f"g{k}" for k in range(classes)]
    schema = "__hash bigint, __w double, __bins array<int>, " + ", ".join(f"{g} double" for g in outputs)

    def gradients(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            p = model.probabilities(np.array(f["__bins"].tolist(), np.int64).reshape(len(f), len(features)))
            left = pd.DataFrame(np.eye(classes)[f["__y"].to_numpy(int)] - p, columns=outputs, index=f.index)
            yield pd.concat([f[["__hash", "__w", "__bins"]], left], axis=1)

    def losses(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            p = model.probabilities(np.array(f["__bins"].tolist(), np.int64).reshape(len(f), len(features)))
            lost = -np.log(np.maximum(p[np.arange(len(f)), f["__y"].to_numpy(int)], 1e-15))
            yield pd.DataFrame({"loss": [float((lost * f["__w"]).sum())], "w": [float(f["__w"].sum())]})

    best, at = np.inf, 0
    for i in range(rounds):
        tree = Forest(features, start.edges, classes, 1)
        model.trees.append(grow(rows.mapInPandas(gradients, schema), tree, outputs, "__w", depth, min_rows, seed=i))
        r = held.mapInPandas(losses, "loss double, w double").agg(F.sum("loss").alias("loss"), F.sum("w").alias("w")).first()
        loss = r["loss"] / r["w"] if r["w"] else 0.0
        if loss < best:
            best, at = loss, i
        elif i - at >= patience:
            break
    del model.trees[at + 1 :]
    return model


def threshold_report(scored: DataFrame, keys: list[str], top: Column, actual_top: Column, ret: str, thresholds: list[float]) -> DataFrame:
    """Per ``keys`` and threshold: the rows whose probability of the top class lies
    above it, their share and mean return, the balanced accuracy of picking them,
    and the mean return of all."""
    tried = scored.select(*keys, top.alias("p"), actual_top.alias("a"), F.col(ret).alias("r"), F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    picked = F.col("p") > F.col("threshold")
    hit = lambda of, c: ratio(F.sum((of & c).cast("double")), F.sum(of.cast("double")))
    right, wrong = hit(F.col("a"), picked), hit(~F.col("a"), ~picked)
    return tried.groupBy(*keys, "threshold").agg(
        F.count("*").alias("n"),
        F.avg(picked.cast("double")).alias("share"),
        F.avg(F.when(picked, F.col("r"))).alias("ret"),
        # where only one class occurs, its hits
        ((F.coalesce(right, wrong) + F.coalesce(wrong, right)) / 2).alias("balanced_accuracy"),
        F.avg("r").alias("all_ret"),
    )
