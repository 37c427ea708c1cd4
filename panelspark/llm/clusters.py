"""Centroid clustering with Ptolemaic pivots.

Vectors become integers, so every distance and sum is exact and the result
doesn't depend on how rows are dealt out. Pivots are a few of the first
centroids, far apart. Each vector's distances to the pivots are taken once and
kept beside it. For a vector x, a centroid c and two pivots p and q, Ptolemy's
inequality gives

    d(x, c) >= |d(x, p) d(c, q) - d(x, q) d(c, p)| / d(p, q)

The largest such bound over fixed pairs of pivots, lowered by more than the
rounding of its arithmetic, screens the centroids: only those whose bound doesn't
exceed the nearest distance so far are compared exactly, beginning with the
centroid of the least bound.

A round reads the vectors where they lie and passes one row of sums per centroid
and task on; the driver sees one row per centroid (``k``, a parameter).

Edge cases: vectors that are null, of another number of components, or with null
or non-finite components take no part; integers beyond 2^25 are clamped to it;
fewer vectors than ``k`` give as many clusters; equal centroids are a tie, which
the smaller number wins; rows that repeat count as often as they appear (of equal
ids the one with the lesser vector starts first, a null id comes last); an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, materialize, prepare_python, table
from .vectors import LARGEST, all_finite, integers, lists, matrix

CLUSTERS, ROUNDS, COMPONENTS, SCALE, PIVOTS = 40, 5, 64, 256, 6
#: What a bound is lowered by, in proportion: some forty times the rounding of doubles.
SLACK = 1e-14
#: Sums of squares up to this are exact in doubles, hence by a matrix product.
EXACT = 2**52


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows, x by y."""
    d, most = x.shape[1], max(np.abs(x).max(initial=0), np.abs(y).max(initial=0))
    if 4 * d * int(most) ** 2 < EXACT:
        a, b = x.astype(float), y.astype(float)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(1) for c in y], axis=1)


def pick_pivots(points: np.ndarray, most: int = PIVOTS) -> np.ndarray:
    """Up to ``most`` points that differ, each the farthest from those before."""
    chosen = [0]
    near = squared(points, points[:1])[:, 0]
    while len(chosen) < most and near.max(initial=0) > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, squared(points, points[chosen[-1:]])[:, 0])
    return points[chosen]


class Ptolemy:
    """Lower bounds of squared distances from cached distances to pivots."""

    def __init__(self, pivots: np.ndarray):
        self.pivots = pivots
        self.apart = np.sqrt(squared(pivots, pivots).astype(float))
        self.pairs = list(combinations(range(len(pivots)), 2))

    def cache(self, x: np.ndarray) -> np.ndarray:
        """Distances of the rows to the pivots."""
        return np.sqrt(squared(x, self.pivots).astype(float))

    def bounds(self, x: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Of cached distances x and c: at most the squared distance, x by c."""
        best = np.zeros((len(x), len(c)))
        for p, q in self.pairs:
            a, b = np.outer(x[:, p], c[:, q]), np.outer(x[:, q], c[:, p])
            np.maximum(best, (np.abs(a - b) - SLACK * (a + b)) / (self.apart[p, q] * (1 + SLACK)), out=best)
        return best * best * (1 - SLACK)


def nearest(x: np.ndarray, cached: np.ndarray, centroids: np.ndarray, screen: Ptolemy) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid of each row (ties to the smaller number), its exact
    squared distance, and how many pairs were compared exactly."""
    low = screen.bounds(cached, screen.cache(centroids))
    at = low.argmin(axis=1)
    best = ((x - centroids[at]) ** 2).sum(axis=1)
    compared = len(x)
    for j, c in enumerate(centroids):
        left = np.flatnonzero((low[:, j] <= best) & (at != j))
        if not len(left):
            continue
        compared += len(left)
        d = squared(x[left], c[None, :])[:, 0]
        better = (d < best[left]) | ((d == best[left]) & (j < at[left]))
        at[left[better]], best[left[better]] = j, d[better]
    return at, best, compared


def prepared(rows: DataFrame, screen: Ptolemy) -> DataFrame:
    """(id, x) with the distances to the pivots beside, written once."""
    kind = rows.schema["id"].dataType.simpleString()
    fields = arrow_schema(rows.sparkSession, f"id {kind}, x array<bigint>, pivot array<double>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = matrix(b.column("x"))
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("x").cast(fields.field("x").type), lists(screen.cache(x)).cast(fields.field("pivot").type)], schema=fields)

    return materialize(rows.mapInArrow(run, f"id {kind}, x array<bigint>, pivot array<double>"), "pivot-distances")


def sums(data: DataFrame, centroids: np.ndarray, screen: Ptolemy) -> list:
    """(cluster, n, total) of the rows' nearest centroids, at most ``k`` rows."""
    parts = "cluster int, n bigint, total array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        fields = pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.int64()))])
        for b in batches:
            if b.num_rows:
                x = matrix(b.column("x"))
                at, _, _ = nearest(x, matrix(b.column("pivot"), float), centroids, screen)
                n += np.bincount(at, minlength=len(centroids))
                np.add.at(total, at, x)
        k = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(n[k]), lists(total[k]).cast(pa.list_(pa.int64()))], schema=fields)

    d = centroids.shape[1]
    each = data.select("x", "pivot").mapInArrow(run, parts)
    wide = lambda i: F.col("total")[i].cast("decimal(38,0)")  # noqa: E731  longs could overflow
    return each.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(wide(i)) for i in range(d)]).alias("total")).collect()


def first_centroids(rows: DataFrame, k: int) -> np.ndarray:
    """The ``k`` vectors with the least hash of their id (rows of ``k``)."""
    order = [F.sha2(F.concat(F.lit("2:"), F.col("id").cast("string")).cast("binary"), 256).asc_nulls_last(), F.col("x")]
    return np.array([r["x"] for r in rows.orderBy(*order).limit(k).collect()], np.int64)


def fit(data: DataFrame, centroids: np.ndarray, screen: Ptolemy, rounds: int = ROUNDS) -> np.ndarray:
    """The centroids after ``rounds`` of exact floor means; empty ones stay."""
    for _ in range(rounds):
        now = centroids.copy()
        for r in sums(data, centroids, screen):
            now[r["cluster"]] = [int(t) // r["n"] for t in r["total"]]
        if (now == centroids).all():
            break  # later rounds would change nothing
        centroids = now
    return centroids


def assign(data: DataFrame, centroids: np.ndarray, screen: Ptolemy) -> DataFrame:
    """(id, cluster, distance); no shuffle."""
    kind = data.schema["id"].dataType.simpleString()
    fields = arrow_schema(data.sparkSession, f"id {kind}, cluster int, distance bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at, best, _ = nearest(matrix(b.column("x")), matrix(b.column("pivot"), float), centroids, screen)
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(at, pa.int32()), pa.array(best, pa.int64())], schema=fields)

    return data.mapInArrow(run, f"id {kind}, cluster int, distance bigint")


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster_vectors(
    df: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, components: int = COMPONENTS, pivots: int = PIVOTS,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """One row per vector: its id, cluster, squared distance, the sums of the
    distances over its cluster and over all, and its centroid's digest."""
    spark = df.sparkSession
    prepare_python(spark)
    fine = all_finite(vector_col) & (F.size(F.col(f"`{vector_col}`")) == components)
    rows = df.filter(fine).select(F.col(f"`{id_col}`").alias("id"), integers(vector_col, scale).alias("x"))
    kind = rows.schema["id"].dataType.simpleString()
    start = first_centroids(rows, k)
    if not len(start):
        empty = f"`{id_col}` {kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
        return spark.createDataFrame([], empty)
    screen = Ptolemy(pick_pivots(start, pivots))
    data = prepared(rows, screen)
    centroids = fit(data, start, screen, rounds)
    out = materialize(assign(data, centroids, screen), "clusters")
    by = {r["cluster"]: r["s"] for r in out.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    about = [(i, int(s), sum(by.values()), digest(centroids[i])) for i, s in by.items()]
    about = spark.createDataFrame(about, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    named = F.col("id").alias(id_col)
    return out.join(F.broadcast(about), "cluster").select(named, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def op13_ptolemaic_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"))


def _sql(k: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, components: int = COMPONENTS) -> str:
    """The rounds written out one after the other."""
    clamp = f"greatest(-{LARGEST}.0, least({LARGEST}.0, x::DOUBLE * {scale}))"
    steps = [
        f"""v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({clamp})::BIGINT) AS x FROM embeddings
WHERE len(embedding) = {components} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {components})""",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), x) - 1 AS k, x FROM v ORDER BY k LIMIT {k})",
    ]
    apart = f"list_sum(list_transform(range(1, {components + 1}), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))"
    near = "SELECT vec_id, x, arg_min(k, (d, k)) AS k, min(d) AS d FROM (SELECT v.vec_id, v.x, c.k, {0} AS d FROM v, c{1} c) GROUP BY 1, 2"
    for i in range(rounds):
        steps += [
            f"a{i} AS ({near.format(apart, i)})",
            f"s{i} AS (SELECT k, i, floor(sum(x[i])::DOUBLE / count(*))::BIGINT AS m FROM a{i}, range(1, {components + 1}) t(i) GROUP BY 1, 2)",
            f"c{i + 1} AS (SELECT c.k, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN (SELECT k, list(m ORDER BY i) AS x FROM s{i} GROUP BY 1) m ON m.k = c.k)",
        ]
    steps.append(f"a AS ({near.format(apart, rounds)})")
    return f"""WITH {", ".join(s.replace(" AS (", " AS MATERIALIZED (", 1) for s in steps)}
SELECT vec_id, a.k::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY a.k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM a JOIN c{rounds} c ON c.k = a.k"""


OP13_SQL = _sql()
