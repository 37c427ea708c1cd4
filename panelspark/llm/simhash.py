"""SimHash near-dedup with a generalised pigeonhole.

64-bit fingerprints that differ in at most ``radius`` bits are linked. The
bits are grouped into partitions of correlated bits; partition i gets its own
threshold t_i, with the sum of (t_i + 1) equal to radius + 1. Two fingerprints
within the radius then agree up to t_i bits in some partition i (t_i = -1 means
that a partition isn't looked at). Dynamic programming allocates the
thresholds so that the estimated candidates and probes cost least; estimates
come from all fingerprints (bit correlations and frequencies of values).

Probing joins each partition's values with all values within t_i bits, and the
join condition verifies the distance. Values shared by very many fingerprints
would make that quadratic. Fingerprints that meet such a value are linked
another, equally exact way: two fingerprints are within 2 bits if and only if
some value is within 1 bit of both, so each of them is dealt to its 65
neighbouring values, and at most 65 fingerprints meet at one of them.

Copies share a fingerprint and are reduced to it first (map-side combine).

Edge cases: a null text counts as empty; texts without words have fingerprint
zero, which is linked like any other; repeated rows share their component; a
null id has a fingerprint and the least id of its component; an empty table
gives an empty result; other columns are ignored, whatever their names. Removing near copies by similarity is in ``similar``.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, map_rows, materialize, prepare_python, table
from .components import connected_components

SHINGLE, RADIUS, SEED, BITS = 3, 2, 42, 64
#: A value shared by more fingerprints is linked by neighbouring values.
CROWD = 64
#: Cost of a shuffled probe, in verified candidates.
PROBE_COST = 8.0
#: For each of 8 bytes and 256 values: its bits, most significant first.
_BIT_TABLE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_OFFSETS = np.arange(8) * 256


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of the word shingles, as a signed 64-bit integer.

    A-Z are lowered, words are runs of other than ASCII white space; a bit is 1
    if it is set in over half the XXH64 hashes.
    """
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    h = xxhash.xxh64_intdigest
    last = ends[min(shingle, len(words)) - 1 :].tolist()
    hashes = np.fromiter((h(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), last)), np.uint64, n)
    by_byte = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    counts = np.bincount((by_byte + _OFFSETS).ravel(), minlength=2048).reshape(8, 256)
    bits = (counts @ _BIT_TABLE).ravel() * 2 > n
    return int.from_bytes(np.packbits(bits).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, content, fp): ``content`` tells texts with the same id apart."""
    key = free_name(docs, "__content")
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))
    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(
        keyed,
        lambda: lambda r: [(r[id_col], r[key], fingerprint(r[text_col], shingle))],
        [id_col, key, text_col],
        f"doc_id {kind}, content long, fp long",
    )


@dataclass
class Plan:
    """Partitions as lists of bits (0 is the least significant) with thresholds."""

    parts: list[list[int]]
    thresholds: list[int]

    def used(self) -> list[tuple[int, int, list[int]]]:
        return [(mask_of(p), t, p) for p, t in zip(self.parts, self.thresholds) if t >= 0]


def mask_of(bits: list[int]) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >> 63 else m


def bit_moments(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """Count of fingerprints and how many have both bits i and j set.

    Each task sums up its own 64 x 64 counts; the sum of those is all that the
    driver sees.
    """

    def run(batches):
        total, both = 0, np.zeros((BITS, BITS))
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            bits = ((fps[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.float32)
            both += bits.T @ bits
            total += len(fps)
        if total:
            yield pa.RecordBatch.from_pydict(
                {"cell": np.arange(BITS * BITS + 1), "n": np.append(both.ravel(), total).astype(np.int64)}
            )

    prepare_python(nodes.sparkSession)
    cells = nodes.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    out = np.zeros(BITS * BITS + 1)
    for r in cells.collect():
        out[r["cell"]] = r["n"]
    return int(out[-1]), out[:-1].reshape(BITS, BITS)


def group_bits(total: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Greedy groups of equal width, each grown around its most correlated bits."""
    p = np.diag(both) / max(total, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((both / max(total, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    left, out = list(range(BITS)), []
    for i in range(parts):
        width = len(left) // (parts - i)
        sub = corr[np.ix_(left, left)]
        group = [left[int(np.argmax(sub.max(axis=1)))]]
        while len(group) < width:
            rest = [b for b in left if b not in group]
            group.append(rest[int(np.argmax(corr[np.ix_(rest, group)].mean(axis=1)))])
        out.append(sorted(group))
        left = [b for b in left if b not in group]
    return out


def allocate(costs: list[list[float]], radius: int) -> tuple[float, list[int]]:
    """Thresholds with the least cost; costs[i][t + 1] is that of threshold t."""
    best: list[tuple[float, list[int]] | None] = [(0.0, [])] + [None] * (radius + 1)
    for row in costs:
        new: list[tuple[float, list[int]] | None] = [None] * (radius + 2)
        for spent, state in enumerate(best):
            for t, cost in enumerate(row if state else []):
                if spent + t <= radius + 1 and (new[spent + t] is None or state[0] + cost < new[spent + t][0]):
                    new[spent + t] = (state[0] + cost, [*state[1], t - 1])
        best = new
    return best[radius + 1]


def plan_partitions(nodes: DataFrame, radius: int, counts: tuple[int, ...] | None = None) -> Plan:
    """The cheapest of several partitionings, with thresholds for each part."""
    total, both = bit_moments(nodes)
    options = [group_bits(total, both, m) for m in (counts or range(2, radius + 3))]
    masks = sorted({mask_of(p) for o in options for p in o})
    values = nodes.select(F.explode(F.array(*[F.lit(m) for m in masks])).alias("mask"), "fp")
    values = values.groupBy("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("value")).agg(F.count("*").alias("n"))
    rows = values.groupBy("mask").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("pairs")).collect()
    pairs = {r["mask"]: r["pairs"] for r in rows}  # one number for each of a few masks
    set_share = np.diag(both) / max(total, 1)
    differ = np.clip(2 * set_share * (1 - set_share), 1e-6, 0.5)
    found = []
    for parts in options:
        costs = []
        for p in parts:
            # elementary symmetric sums: chance of d differing bits against none
            odds, rise = differ[p] / (1 - differ[p]), np.zeros(radius + 1)
            rise[0] = 1
            for o in odds:
                rise[1:] += o * rise[:-1].copy()
            probes = np.cumsum([comb(len(p), d) for d in range(radius + 1)])
            candidates = pairs.get(mask_of(p), 0.0) * np.cumsum(rise)
            costs.append([0.0, *(candidates + PROBE_COST * total * probes)])
        found.append((*allocate(costs, radius), parts))
    _, thresholds, parts = min(found, key=lambda x: x[0])
    return Plan(parts, thresholds)


def _flips(bits: list[int], threshold: int) -> list[int]:
    from itertools import combinations

    return [mask_of(list(c)) for d in range(threshold + 1) for c in combinations(bits, d)]


def links(nodes: DataFrame, radius: int = RADIUS, plan: Plan | None = None) -> DataFrame:
    """(a, b) pairs of distinct fingerprints within ``radius`` (up to 2) whose
    links connect all that lie within it."""
    if not 0 <= radius <= 2:
        raise ValueError("crowded values are linked exactly for a radius of 2 at most")
    plan = plan or plan_partitions(nodes, radius)
    used = plan.used()
    value = lambda m: F.col("fp").bitwiseAND(F.lit(m))
    index = nodes.select(
        "fp", F.explode(F.array(*[F.struct(F.lit(i).alias("part"), value(m).alias("value")) for i, (m, _, _) in enumerate(used)])).alias("x")
    ).select("x.part", "x.value", "fp")
    index = materialize(index, "simhash-index")
    flips = F.create_map(*[y for i, (_, t, p) in enumerate(used) for y in (F.lit(i), F.array(*map(F.lit, _flips(p, t))))])
    probes = index.select("part", "value", "fp", F.explode(flips[F.col("part")]).alias("flip"))
    probes = probes.select("part", F.col("value").bitwiseXOR(F.col("flip")).alias("value"), "fp")
    crowded = index.groupBy("part", "value").agg(F.count("*").alias("n")).filter(F.col("n") > CROWD)
    crowded = materialize(crowded.select("part", "value"), "simhash-crowded")
    near = None
    if not crowded.isEmpty():
        among = materialize(probes.join(crowded, ["part", "value"], "left_semi").select("fp").distinct(), "simhash-among")
        index = index.join(crowded, ["part", "value"], "left_anti")
        probes = probes.join(crowded, ["part", "value"], "left_anti")
        near = neighbour_links(among, radius)
    a, b = index.select("part", "value", F.col("fp").alias("a")), probes.select("part", "value", F.col("fp").alias("b"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    found = a.join(b, (a.part == b.part) & (a.value == b.value) & (F.col("a") < F.col("b")) & close)
    found = found.select("a", "b")
    return (found if near is None else found.unionByName(near)).distinct()


def neighbour_links(nodes: DataFrame, radius: int) -> DataFrame:
    """Links by shared neighbouring values; at most 65 fingerprints meet at one."""
    flips = F.array(*[F.lit(mask_of([b] if b < BITS else [])) for b in range(BITS + 1)])
    met = nodes.select("fp", F.explode(flips).alias("flip"))
    met = met.groupBy(F.col("fp").bitwiseXOR(F.col("flip")).alias("value")).agg(F.collect_list("fp").alias("fps"))
    # within 1 bit only the value itself links those around it
    hub = F.array_min("fps") if radius == 2 else F.when(F.array_contains("fps", F.col("value")), F.col("value"))
    met = met.filter((F.size("fps") > 1) & (radius > 0)).select(hub.alias("a"), F.explode("fps").alias("b"))
    return met.filter("a <> b").distinct()


def simhash_components(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, content, fp) -> the same with component_id (least id)."""
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    labels = connected_components(links(nodes, radius)).withColumnRenamed("node", "fp")
    known = materialize(
        nodes.join(labels, "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label")), "simhash-labels"
    )
    least = known.groupBy("label").agg(F.min("least").alias("component_id"))
    of_print = known.join(least, "label").select("fp", "component_id")
    return prints.join(of_print, "fp").select("doc_id", "content", "fp", "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = materialize(fingerprints(table(spark, sf_dir, "documents")), "fingerprints")
    return simhash_components(prints).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
