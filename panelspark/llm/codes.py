"""Vector codes whose codebooks are learned over a trie of distinct parts.

Vectors become integers and are cut into equal parts. The distinct parts of each
position, with their counts, are sorted, so a run of neighbouring rows is a
stretch of the trie of their components in depth-first order. A node at depth j
carries the squared distances of its first j components to those of every
codebook entry; it adds one component's share to what its parent carries, so
parts with a common beginning share that work. A leaf takes the least distance
(ties to the lower index) and adds its components, times its count, to the sums
of that entry. A run is walked with the path of the last leaf of the run before
as its stack, and depth by depth as arrays.

All sums are of integers, so the result doesn't depend on how rows are dealt out.
Parts are counted with map-side combine and dealt by range, which puts a part that
a third of all rows have in one row. The rounds read these counts; each passes one
row of sums per entry and task on, and the driver sees the codebooks only (parts x
entries, both parameters). Rows are coded where they lie, by a trie of each batch.

Edge cases: rows whose vector is null, or holds null or non-finite components,
take no part, nor do those of another length than the kept row with the least
id, or all if that length isn't a multiple of the parts; integers beyond 2^25 are
clamped to it; of equal ids the lesser vector comes first, a null id last; fewer
rows than entries give shorter codebooks; equal entries are a tie, which the lower
index wins; rows that repeat each get their code; labels that are null are one
group; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, materialize, prepare_python, table
from .vectors import LARGEST, all_finite, integers, lists, matrix

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Leaves of a run.
RUN = 4096


class TrieWalk:
    """Depth-first walk over sorted, distinct parts of one position, in runs."""

    def __init__(self, codebook: np.ndarray):
        self.codebook = codebook  # entries x components
        self.path: np.ndarray | None = None  # components of the last leaf
        self.stack = [np.zeros((1, len(codebook)), np.int64) for _ in range(codebook.shape[1] + 1)]
        self.nodes = 0

    def __call__(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each part, and its squared distance."""
        n, depth = parts.shape
        before = np.empty_like(parts)
        before[1:], before[0] = parts[:-1], parts[0] if self.path is None else self.path
        new = np.zeros(n, bool)
        if self.path is None:
            new[0] = True
        parent = np.zeros(n, np.int64)  # of each leaf, its node at the depth above; 0 is the stack's
        above = self.stack[0]
        for j in range(depth):
            new = new | (parts[:, j] != before[:, j])
            first = np.flatnonzero(new)  # leaves that open a node at this depth
            nodes = np.empty((len(first) + 1, len(self.codebook)), np.int64)
            nodes[0] = self.stack[j + 1]
            nodes[1:] = above[parent[first]] + (parts[first, j, None] - self.codebook[None, :, j]) ** 2
            parent, above = np.cumsum(new), nodes
            self.stack[j + 1] = nodes[-1:] if len(first) else self.stack[j + 1]
            self.nodes += len(first)
        self.path = parts[-1]
        at = above.argmin(axis=1)
        return at[parent], above[np.arange(len(above)), at][parent]


def walk(parts: np.ndarray, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries and distances of parts in any order, by the trie of those that differ."""
    distinct, at = np.unique(parts, axis=0, return_inverse=True)  # sorted
    entry, error = TrieWalk(codebook)(distinct)
    return entry[at.ravel()], error[at.ravel()]


def distinct_parts(rows: DataFrame, parts: int, width: int) -> DataFrame:
    """(position, part, n), written once, sorted within ranges of both."""
    cut = F.array(*[F.slice("x", i * width + 1, width) for i in range(parts)])
    counted = rows.select(F.posexplode(cut).alias("position", "part")).groupBy("position", "part").agg(F.count("*").alias("n"))
    return materialize(counted.repartitionByRange("position", "part").sortWithinPartitions("position", "part"), "distinct-parts")


def sums(counted: DataFrame, codebooks: np.ndarray) -> list:
    """(position, entry, n, total) of the counted parts' nearest entries."""
    parts, entries, width = codebooks.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        position, trie = -1, None
        for b in batches:
            if not b.num_rows:
                continue
            at, x, count = b.column("position").to_numpy(), matrix(b.column("part")), b.column("n").to_numpy()
            for p in np.unique(at):  # rising, as rows are sorted
                if p != position or trie is None:
                    position, trie = p, TrieWalk(codebooks[p])
                mine = np.flatnonzero(at == p)
                for i in range(0, len(mine), RUN):
                    leaves = mine[i : i + RUN]
                    entry, _ = trie(x[leaves])
                    np.add.at(n[p], entry, count[leaves])
                    np.add.at(total[p], entry, x[leaves] * count[leaves, None])
        p, e = np.nonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(n[p, e]), lists(total[p, e])], names=["position", "entry", "n", "total"]
        )

    each = counted.mapInArrow(run, "position int, entry int, n bigint, total array<bigint>")
    wide = lambda i: F.col("total")[i].cast("decimal(38,0)")  # noqa: E731  longs could overflow
    return each.groupBy("position", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(wide(i)) for i in range(width)]).alias("total")).collect()


def fit(counted: DataFrame, codebooks: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts x entries x components) after ``rounds`` of exact floor
    means; entries without parts stay."""
    for _ in range(rounds):
        now = codebooks.copy()
        for r in sums(counted, codebooks):
            now[r["position"], r["entry"]] = [int(t) // r["n"] for t in r["total"]]
        if (now == codebooks).all():
            break  # later rounds would change nothing
        codebooks = now
    return codebooks


def encode(rows: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """(id, label, x) -> (id, label, code, error); no shuffle."""
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"id {types['id']}, label {types['label']}, code string, error bigint"
    fields = arrow_schema(rows.sparkSession, schema)
    parts, _, width = codebooks.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column("x")).reshape(-1, parts, width)
            found = [walk(x[:, p], codebooks[p]) for p in range(parts)]
            code = ["".join(f"{e:02x}" for e in row) for row in np.stack([e for e, _ in found], axis=1).tolist()]
            error = np.sum([d for _, d in found], axis=0)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array(code), pa.array(error)], schema=fields)

    return rows.mapInArrow(run, schema)


def digest(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def vector_codes(
    df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """One row per kept vector: its id, code, error, the error summed over equal
    labels, and the digest of the codebooks."""
    spark = df.sparkSession
    prepare_python(spark)
    named = [F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), integers(vector_col, scale).alias("x")]
    rows = df.filter(all_finite(vector_col)).select(*named)
    order = [F.col("id").asc_nulls_last(), F.col("x")]
    first = rows.orderBy(*order).limit(1).select(F.size("x").alias("d")).collect()
    d = first[0]["d"] if first else 0
    rows = rows.filter(F.size("x") == d)
    start = [r["x"] for r in rows.orderBy(*order).limit(entries).collect()]  # `entries` rows
    if not d or d % parts:
        kind = rows.schema["id"].dataType.simpleString()
        return spark.createDataFrame([], f"`{id_col}` {kind}, code string, error bigint, label_error bigint, codebooks_sha256 string")
    codebooks = np.array(start, np.int64).reshape(len(start), parts, -1).transpose(1, 0, 2)
    codebooks = fit(distinct_parts(rows, parts, d // parts), codebooks, rounds)
    out = materialize(encode(rows, codebooks), "vector-codes")
    totals = out.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    out = out.join(totals, F.col("label").eqNullSafe(F.col("of")))
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256"))


def op12_trie_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"))


def _sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The rounds written out one after the other."""
    clamp = f"greatest(-{LARGEST}.0, least({LARGEST}.0, x::DOUBLE * {scale}))"
    width = f"(len(x) // {parts})"
    apart = "list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - c.x[i]) * (p.x[i] - c.x[i])))"
    near = "SELECT p.vec_id, p.label, p.p, p.x, arg_min(c.k, ({0}, c.k)) AS k, min({0}) AS d FROM p JOIN c{1} c ON c.p = p.p GROUP BY ALL"
    steps = [
        f"""v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({clamp})::BIGINT) AS x FROM embeddings
WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding))""",
        f"p AS (SELECT vec_id, label, p, x[p * {width} + 1 : (p + 1) * {width}] AS x FROM v, range({parts}) t(p))",
        f"c0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS k, x FROM p QUALIFY k < {entries})",
    ]
    for i in range(rounds):
        steps += [
            f"a{i} AS ({near.format(apart, i)})",
            f"s{i} AS (SELECT p, k, i, floor(sum(x[i])::DOUBLE / count(*))::BIGINT AS m FROM a{i}, LATERAL (SELECT unnest(range(1, len(x) + 1)) AS i) GROUP BY 1, 2, 3)",
            f"c{i + 1} AS (SELECT c.p, c.k, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN (SELECT p, k, list(m ORDER BY i) AS x FROM s{i} GROUP BY 1, 2) m ON m.p = c.p AND m.k = c.k)",
        ]
    steps.append(f"a AS ({near.format(apart, rounds)})")
    return f"""WITH {", ".join(s.replace(" AS (", " AS MATERIALIZED (", 1) for s in steps)},
r AS (SELECT vec_id, label, string_agg(printf('%02x', k), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a GROUP BY 1, 2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
(SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, k)) FROM c{rounds}) AS codebooks_sha256 FROM r"""


OP12_SQL = _sql()
