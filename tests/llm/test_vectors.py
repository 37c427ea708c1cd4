"""The operators on embedding vectors against brute force and edge cases."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.llm import clusters, codes, neighbours
from panelspark.llm.vectors import LARGEST

KINDS = "vec_id long, embedding array<double>, label int, cluster string, id int, x string, code int"


def table_of(spark, rows):
    """(vec_id, vector, label) with columns whose names clash."""
    return spark.createDataFrame([(*r, "c", 1, "x", 2) for r in rows], KINDS)


def usable(v):
    return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v)


def whole(v, scale):
    return [math.floor(max(-LARGEST, min(LARGEST, x * scale))) for x in v]


def apart(x, y):
    return sum((a - b) ** 2 for a, b in zip(x, y))


def slow_centroids(points, centroids, rounds):
    def assigned():
        return [min((apart(x, c), k) for k, c in enumerate(centroids)) for x in points]

    for _ in range(rounds):
        at = [k for _, k in assigned()]
        for k in set(at):
            mine = [x for x, a in zip(points, at) if a == k]
            centroids[k] = [sum(col) // len(mine) for col in zip(*mine)]
    return assigned(), centroids


def slow_clusters(rows, k, rounds, scale, components):
    kept = [(i, whole(v, scale)) for i, v, _ in rows if usable(v) and len(v) == components]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(x) for _, x in order[:k]]
    found, centroids = slow_centroids([x for _, x in kept], centroids, rounds)
    total = sum(d for d, _ in found)
    by = {c: sum(d for d, a in found if a == c) for _, c in found}
    sha = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    return sorted(((i, a, d, by[a], total, sha(centroids[a])) for (i, _), (d, a) in zip(kept, found)), key=str)


def slow_codes(rows, parts, entries, rounds, scale):
    kept = sorted(((i, whole(v, scale), lab) for i, v, lab in rows if usable(v)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    w = len(kept[0][1]) // parts
    code, error, books = ["" for _ in kept], [0 for _ in kept], []
    for p in range(parts):
        cut = [x[p * w : (p + 1) * w] for _, x, _ in kept]
        found, book = slow_centroids(cut, [list(c) for c in cut[:entries]], rounds)
        books += [str(v) for c in book for v in c]
        for i, (d, a) in enumerate(found):
            code[i] += f"{a:02x}"
            error[i] += d
    sha = hashlib.sha256(",".join(books).encode()).hexdigest()
    by = {lab: sum(e for e, r in zip(error, kept) if r[2] == lab) for _, _, lab in kept}
    return sorted(((r[0], c, e, by[r[2]], sha) for r, c, e in zip(kept, code, error)), key=str)


def odd_vectors(rng, n, d):
    """Random vectors with ties, repeats, few distinct values, and unusable ones."""
    rows = [(i, rng.normal(0, 0.2, d).round(2).tolist(), int(rng.integers(3))) for i in range(n)]
    rows += [(n + i, rng.integers(-1, 2, d).astype(float).tolist(), None) for i in range(n // 2)]
    rows += [(n * 2 + i, [0.25] * d, 7) for i in range(n)]  # a third are equal
    rows += [rows[0], rows[0], (None, [0.5] * d, 1), (3, [0.5] * d, 1), (n * 3, [1e30] + [-1e300] * (d - 1), 0)]
    bad = [None, [], [None] * d, [1.0] * (d - 1) + [None], [float("nan")] * d, [0.0] * (d - 1) + [float("inf")], [1.0] * (d + 1)]
    return rows + [(n * 4 + i, v, 0) for i, v in enumerate(bad)]


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters_equal_a_slow_version(spark, seed):
    rows = odd_vectors(np.random.default_rng(seed), 60, 6)
    out = clusters.cluster_vectors(table_of(spark, rows).repartition(5), 7, 4, 256, 6, 4)
    assert sorted((tuple(r) for r in out.collect()), key=str) == slow_clusters(rows, 7, 4, 256, 6)


def test_clusters_of_few_and_none(spark):
    df = table_of(spark, [(5, [0.1] * 64, 1), (9, [0.1] * 64, 1), (1, None, 1)])
    got = clusters.cluster_vectors(df).collect()
    assert {r["vec_id"] for r in got} == {5, 9} and {(r["cluster"], r["distance"], r["inertia"]) for r in got} == {(0, 0, 0)}
    assert clusters.cluster_vectors(df.filter("vec_id = 1")).collect() == []
    assert clusters.cluster_vectors(df.limit(0)).count() == 0


def test_bounds_never_exceed_distances_and_spare_work():
    rng = np.random.default_rng(3)
    centers = rng.integers(-3000, 3000, (40, 16))
    x = centers[rng.integers(40, size=4000)] + rng.integers(-40, 40, (4000, 16))
    for scale in (1, 1000):  # beyond exact doubles too
        screen = clusters.Ptolemy(clusters.pick_pivots(centers * scale))
        low = screen.bounds(screen.cache(x * scale), screen.cache(centers * scale))
        assert (low <= clusters.squared(x * scale, centers * scale)).all()
    at, best, compared = clusters.nearest(x, screen.cache(x), centers, clusters.Ptolemy(clusters.pick_pivots(centers)))
    full = ((x[:, None, :] - centers[None]) ** 2).sum(2)
    screen = clusters.Ptolemy(clusters.pick_pivots(centers))
    at, best, compared = clusters.nearest(x, screen.cache(x), centers, screen)
    assert (at == full.argmin(1)).all() and (best == full.min(1)).all()
    assert compared < 0.5 * full.size  # the screen spares most comparisons
    same = clusters.Ptolemy(clusters.pick_pivots(np.ones((5, 4), int)))
    assert same.pairs == [] and (same.bounds(same.cache(x[:3, :4]), same.cache(centers[:, :4])) == 0).all()


@pytest.mark.parametrize("seed", [1, 2])
def test_codes_equal_a_slow_version(spark, seed):
    rows = odd_vectors(np.random.default_rng(seed), 50, 8)
    out = codes.vector_codes(table_of(spark, rows).repartition(5), 4, 6, 3, 16)
    assert sorted((tuple(r) for r in out.collect()), key=str) == slow_codes(rows, 4, 6, 3, 16)


def test_codes_of_few_and_none(spark):
    df = table_of(spark, [(5, [0.1] * 16, 1), (9, [0.2] * 16, None), (1, None, 1), (10, [0.1] * 7, 1)])
    got = {r["vec_id"]: r for r in codes.vector_codes(df).collect()}
    assert set(got) == {5, 9} and got[5]["code"] == "00" * 8 and got[9]["code"] == "01" * 8 and got[5]["error"] == 0
    assert codes.vector_codes(df.filter("vec_id = 10")).collect() == []
    assert codes.vector_codes(df.filter("vec_id = 1")).collect() == []
    assert codes.vector_codes(df.limit(0)).count() == 0


def test_trie_walk_shares_prefixes():
    rng = np.random.default_rng(4)
    book = rng.integers(-9, 9, (5, 4))
    parts = np.unique(rng.integers(-2, 3, (3000, 4)), axis=0)
    trie = codes.TrieWalk(book)
    runs = [trie(parts[i : i + 37]) for i in range(0, len(parts), 37)]  # the stack carries on from run to run
    full = ((parts[:, None, :] - book[None]) ** 2).sum(2)
    assert (np.concatenate([e for e, _ in runs]) == full.argmin(1)).all() and (np.concatenate([d for _, d in runs]) == full.min(1)).all()
    assert trie.nodes == sum(len(np.unique(parts[:, : j + 1], axis=0)) for j in range(4))  # each prefix once


def test_queries_take_odd_tables(spark, tmp_path):
    from panelspark.llm.common import shared_dir
    from panelspark.llm.queries import QUERIES

    rng = np.random.default_rng(5)
    rows = odd_vectors(rng, 30, 64)
    for name in ("op12_trie_codes", "op13_ptolemaic_clusters"):
        for made in (table_of(spark, rows), table_of(spark, rows).limit(0)):
            folder = shared_dir(spark, "tables")
            made.withColumn("embedding", F.col("embedding").cast("array<float>")).write.parquet(f"{folder}/embeddings.parquet")
            got = QUERIES[name](spark, folder)
            assert got.count() == sum(1 for r in made.collect() if usable(r["embedding"]) and len(r["embedding"]) == 64 and max(map(abs, r["embedding"])) < 1e38)


# nearest neighbours


def slow_nearest(rows, every, k):
    kept: dict = {}
    for i, v, _ in rows:
        if i is not None and usable(v) and any(v):
            kept[i] = min(kept.get(i, v), v)
    out = {}
    for q, v in kept.items():
        if q % every == 0:
            score = lambda w: math.fsum(a * b for a, b in zip(v, w))
            out[q] = sorted(((-round(score(w), 9), i) for i, w in kept.items() if i != q))[:k]
    return out


def found_nearest(out):
    got: dict = {}
    for r in sorted(out.collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((-round(r["score"], 9), r["vec_id"]))
        assert r["rank"] == len(got[r["query_id"]])
    return got


@pytest.mark.parametrize("n,k", [(60, 7), (2, 20), (1, 20)])
def test_nearest_of_small_tables_are_exact(spark, n, k):
    rows = [r for r in odd_vectors(np.random.default_rng(n), n, 6) if r[0] != n * 3] if n > 2 else [(i * 20, [1.0, float(i)], 0) for i in range(n)]
    rows += [(8000, [0.0] * 6, 1)]
    out = neighbours.nearest_of_table(table_of(spark, rows).repartition(3), 20, k)
    assert {q: v for q, v in found_nearest(out).items()} == {q: v for q, v in slow_nearest(rows, 20, k).items() if v}


def test_nearest_of_clouds_and_copies(spark):
    """Near copies, equal vectors and lengths that differ: recall, order and ties."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=24)
    rows = [(i, (rng.normal(size=24) * rng.uniform(0.5, 1.5)).tolist(), 0) for i in range(1500)]
    rows += [(1500 + i, (base + rng.normal(0, 0.05, 24)).tolist(), 0) for i in range(700)]  # a cloud
    rows += [(2200 + i, (base * 0.9).tolist(), 0) for i in range(800)]  # copies
    got, want = found_nearest(neighbours.nearest_of_table(table_of(spark, rows).repartition(4), 20, 20)), slow_nearest(rows, 20, 20)
    assert set(got) == set(want)
    for q, found in got.items():
        assert len(found) == 20 and found == sorted(found) and q not in [i for _, i in found]
    hit = [len(set(got[q]) & set(want[q])) / 20 for q in want]
    assert np.mean(hit) >= 0.95 and np.mean(hit[:75]) >= 0.95 and np.mean(hit[75:110]) >= 0.9
    assert [i for _, i in want[2400]] == [i for _, i in got[2400]]


def test_search_for_vectors_outside_the_index(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(2000, 12))
    index = neighbours.NearestNeighbours(table_of(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)]), neighbours=12)
    asked = rng.normal(size=(40, 12))
    out = index.search(spark.createDataFrame([(5000 + i, v.tolist()) for i, v in enumerate(asked)], "query long, v array<double>"), 10)
    got = {r["query"]: [f["vec_id"] for f in r["found"]] for r in out.collect()}
    want = np.argsort(-(asked @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(got[5000 + i]) & set(want[i])) / 10 for i in range(40)]) >= 0.95


def test_differences_keep_near_copies_apart():
    rng = np.random.default_rng(8)
    v = rng.normal(size=64)
    v /= np.linalg.norm(v)
    y = v + rng.normal(0, 0.002, (200, 64))
    small, scale = neighbours.shrink(y - v)
    assert np.abs(small * scale[:, None] + v - y).max() < 1e-4
    full, plain = y @ y[0], neighbours.unpacked(neighbours.packed(y)) @ y[0]
    near = v @ y[0] + scale * (small @ y[0])
    assert np.abs(near - full).max() < 0.1 * np.abs(plain - full).max()


@pytest.mark.parametrize("rows", [[], [(20, None, 0), (40, [0.0] * 64, 0), (None, [1.0] * 64, 0)]])
def test_no_vectors(spark, rows):
    from panelspark.llm.common import shared_dir

    folder = shared_dir(spark, "tables")
    table_of(spark, rows).withColumn("embedding", F.col("embedding").cast("array<float>")).write.parquet(f"{folder}/embeddings.parquet")
    assert neighbours.op11_nn_descent(spark, folder).count() == 0
