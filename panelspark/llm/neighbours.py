"""Approximate nearest neighbours by NN-descent and greedy search of the graph.

Rows with equal vectors are one node, named by their least id, so copies never
crowd a list; they come back when results are told (``NearestNeighbours.copies``).

The graph. Every node begins with its nearest of a few random cuts: vectors are
sorted by the sides on which they lie of random hyperplanes, and stretches of the
order are compared within. Then neighbours of neighbours are joined until few
lists still change (NN-descent): each node gathers its neighbours and a sample of
the nodes it is a neighbour of, compares those that are new to each other with all
others, and tells each what is nearer than the last of its list. Lists merge by a
grouping and a ranked window, which Spark limits before the shuffle as well, so a
node that many lists hold is no burden. Vectors travel as bytes of 8 bits a
component there.

The search. A row of the graph holds a node's vector, its neighbours, a bounded
number of nodes that it is a neighbour of, and their differences to it, again with
8 bits a component, scaled to each difference, so near copies stay apart. All
queries walk at once: a round joins the best nodes of each pool not yet looked into
with the graph and merges what is nearer into the pools. The pools' nodes are
compared by the original vectors, in double precision, in the end. Pools begin with
the nearest of ``ENTRIES`` nodes and, where the query's id is in the graph, its node.

Inner products of vectors of different length: for the graph each vector gets one
more component that makes all equally long, which turns the largest inner product
into the least distance; queries have zero there.

At scale all tables grow with the rows, and rounds of the search with the logarithm;
no list, pool or group is unbounded, and only ``ENTRIES`` vectors and counts reach
the driver.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite
components take no part, nor do rows without an id; shorter vectors count as ended
by zeros; of rows with equal ids one takes part, that with the least vector; equal
scores are a tie, which the smaller id wins; copies of the query are candidates,
the query's row isn't; fewer candidates than asked for give all; very large
components lose precision in the graph, not in the scores; an empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, prepare_python, table
from .vectors import all_finite

#: Neighbours of a list; nodes a list is gathered from in reverse; those in the graph.
NEIGHBOURS, REVERSE, BACK = 20, 20, 24
#: Random cuts at first, rows compared within one, hyperplanes of one.
CUTS, STRETCH, PLANES = 4, 1024, 40
#: The descent ends when a smaller share of the lists' places changes, or after so many rounds.
STILL, DESCENTS = 0.04, 10
#: Nodes of a pool, those looked into in a round, rounds at most, and entry nodes.
POOL, BEAM, STEPS, ENTRIES = 384, 128, 12, 256


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def dot(v: Column, w: Column) -> Column:
    """Inner product in double precision; what one of them lacks is zero."""
    product = lambda a, b: F.coalesce(a.cast("double") * b.cast("double"), F.lit(0.0))
    return F.aggregate(F.zip_with(v, w, product), F.lit(0.0), lambda s, x: s + x)


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of the rows that take part, one per id."""
    v = F.col(f"`{vector_col}`")
    rows = df.filter(all_finite(vector_col)).filter(F.exists(v, lambda x: x != 0)).filter(F.col(f"`{id_col}`").isNotNull())
    return rows.select(F.col(f"`{id_col}`").alias("vec_id"), v.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


# vectors as bytes


def padded(column: pa.Array, width: int) -> np.ndarray:
    """A list column as a matrix of doubles, zeros where rows are shorter."""
    counts = np.diff(column.offsets.to_numpy()) if isinstance(column, pa.ListArray) else np.array([len(x) for x in column])
    out = np.zeros((len(column), width))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out[np.arange(width) < counts[:, None]] = flat
    return out


def to_bytes(rows: np.ndarray) -> list[bytes]:
    return [r.tobytes() for r in np.ascontiguousarray(rows)]


def shrink(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows as 8-bit integers and the scale of each."""
    scale = np.maximum(np.abs(rows).max(axis=1, initial=0), 1e-30) / 127
    return np.rint(rows / scale[:, None]).astype(np.int8), scale.astype(np.float32)


def packed(rows: np.ndarray) -> list[bytes]:
    """Scale and 8-bit components of each row as bytes."""
    small, scale = shrink(rows)
    return [s.tobytes() + r.tobytes() for s, r in zip(scale, small)]


def unpacked(values: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(values), np.uint8).reshape(len(values), -1)
    return raw[:, 4:].view(np.int8) * np.ascontiguousarray(raw[:, :4]).view(np.float32)


def halves(values: list[bytes]) -> np.ndarray:
    if not values:
        return np.zeros((0, 0), np.float32)
    return np.frombuffer(b"".join(values), np.float16).reshape(len(values), -1).astype(np.float32)


def nearness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Half the squared distance of rounded rows, negative: as they are rounded,
    their length tells, too."""
    return a @ b.T - ((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :]) / 2


def rows_of(lists: list[tuple]) -> tuple[pa.Array, pa.Array, pa.Array]:
    """[(key, ids, values)] as columns."""
    sizes = np.cumsum([0, *(len(x[1]) for x in lists)])
    ids = np.concatenate([x[1] for x in lists]) if lists else np.zeros(0)
    values = np.concatenate([x[2] for x in lists]) if lists else np.zeros(0)
    offsets = pa.array(sizes, pa.int32())
    of = pa.ListArray.from_arrays
    return pa.array([x[0] for x in lists], pa.int64()), of(offsets, pa.array(ids, pa.int64())), of(offsets, pa.array(values, pa.float32()))


FOUND = "node bigint, ids array<bigint>, sims array<float>"
FIELDS = ["node", "ids", "sims"]


class NearestNeighbours:
    """A neighbour graph over the vectors of ``df``, and searches of it.

    ``vec_id`` must be a long. Everything that is kept lies in the shared folder.
    """

    def __init__(
        self, df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", neighbours: int = NEIGHBOURS,
        reverse: int = REVERSE, back: int = BACK, cuts: int = CUTS, still: float = STILL, descents: int = DESCENTS,
    ):
        self.spark = df.sparkSession
        prepare_python(self.spark)
        self.neighbours, self.reverse, self.back, self.cuts = neighbours, reverse, back, cuts
        rows = materialize(usable(df, id_col, vector_col), "vectors")
        classes = rows.groupBy("v").agg(F.min("vec_id").alias("node"), F.count("*").alias("n"))
        shared = classes.filter("n > 1").select("v", "node")
        #: (node, vec_id) of the nodes that several rows share.
        self.copies = materialize(rows.join(shared, "v").select("node", "vec_id"), "copies")
        about = rows.agg(F.max(norm(F.col("v"))).alias("length"), F.max(F.size("v")).alias("width")).first()
        self.length, self.width = about["length"] or 1.0, about["width"] or 0
        self.nodes = materialize(self._encoded(classes.select("node", "v")), "nodes")
        self.lists = self._descend(self._first_lists(), still, descents)
        self.entries = self._entries()
        self.graph = materialize(self._graph(), "graph")

    def _encoded(self, nodes: DataFrame) -> DataFrame:
        """(node, v, code, half, cut): the vector as bytes of 8 and 16 bits, and
        the sides of the hyperplanes of each cut."""
        length, width, cuts = self.length, self.width, self.cuts
        planes = np.random.default_rng(42).standard_normal((width + 1, cuts * PLANES))
        weights = 1 << np.arange(PLANES, dtype=np.int64)[::-1]
        kind = nodes.schema["v"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                y = extended(padded(b.column("v"), width) / length)
                sides = ((y @ planes) > 0).reshape(-1, cuts, PLANES) @ weights
                columns = [b.column("node"), b.column("v"), pa.array(packed(y), pa.binary()), pa.array(to_bytes(y.astype(np.float16)), pa.binary())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(list(sides), pa.list_(pa.int64()))], names=["node", "v", "code", "half", "cut"])

        return nodes.mapInArrow(run, f"node bigint, v {kind}, code binary, half binary, cut array<bigint>")

    def _first_lists(self) -> DataFrame:
        """The nearest within stretches of each cut, as (node, id, sim, new)."""
        keep = self.neighbours

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def found() -> pa.RecordBatch:
                y, names = unpacked(codes), np.array(ids)
                sim = nearness(y, y)
                np.fill_diagonal(sim, -np.inf)
                k = min(keep, len(names) - 1)
                at = np.argpartition(-sim, k - 1, axis=1)[:, :k] if k else np.zeros((len(names), 0), int)
                s = np.take_along_axis(sim, at, 1)
                return pa.RecordBatch.from_arrays([*rows_of([(n, names[a], x) for n, a, x in zip(ids, at, s)])], names=FIELDS)

            ids, codes = [], []
            for b in batches:
                ids += b.column("node").to_pylist()
                codes += b.column("code").to_pylist()
                if len(ids) >= STRETCH:
                    yield found()
                    ids, codes = [], []
            if ids:
                yield found()

        out = None
        for i in range(self.cuts):
            key = F.col("cut")[i].alias("side")
            near = self.nodes.select("node", "code", key).repartitionByRange("side", "node").sortWithinPartitions("side", "node")
            near = near.select("node", "code").mapInArrow(run, FOUND)
            out = near if out is None else out.unionByName(near)
        return materialize(self._merged(pairs(out).withColumn("new", F.lit(True))), "neighbours")

    def _merged(self, found: DataFrame) -> DataFrame:
        """The nearest of each node among (node, id, sim, new), which may repeat;
        what is there already isn't new."""
        once = found.groupBy("node", "id").agg(F.max("sim").alias("sim"), F.min("new").alias("new"))
        rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("sim"), "id"))
        return once.withColumn("rank", rank).filter(F.col("rank") <= self.neighbours)

    def _descend(self, lists: DataFrame, still: float, descents: int) -> DataFrame:
        places = lists.count()
        for turn in range(descents):
            told = self._told(lists, turn)
            known = lists.select("node", "id", "sim", F.lit(False).alias("new"))
            lists = materialize(self._merged(known.unionByName(pairs(told).withColumn("new", F.lit(True)))), "neighbours")
            if lists.filter("new").count() <= still * places:
                break
        return lists

    def _told(self, lists: DataFrame, turn: int) -> DataFrame:
        """What each node learns from the nodes that gathered it: (node, ids, sims)."""
        own = lists.select("node", F.col("id").alias("member"), "new")
        order = [F.desc("new"), F.xxhash64("member", F.lit(turn)), F.col("member")]
        rank = F.row_number().over(Window.partitionBy("node").orderBy(*order))
        back = own.select(F.col("member").alias("node"), F.col("node").alias("member"), "new")
        back = back.withColumn("rank", rank).filter(F.col("rank") <= self.reverse).drop("rank")
        last = lists.groupBy("node").agg(F.min("sim").alias("last"), F.count("*").alias("n"))
        full = F.when(F.col("n") == self.neighbours, F.col("last")).otherwise(F.lit(float("-inf")))
        member = last.join(self.nodes.select("node", "code"), "node").select(F.col("node").alias("member"), "code", full.cast("float").alias("last"))
        gathered = own.unionByName(back).join(member, "member")
        gathered = gathered.groupBy("node").agg(*[F.collect_list(c).alias(c) for c in ("member", "new", "code", "last")])  # neighbours + reverse
        gathered = gathered.filter(F.exists("new", lambda x: x))
        keep = self.neighbours

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for member, new, code, last in zip(*(b.column(c).to_pylist() for c in ("member", "new", "code", "last"))):
                    member, first = np.unique(member, return_index=True)
                    y = unpacked([code[i] for i in first])
                    sim, new = nearness(y, y), np.array(new)[first]
                    good = (sim > np.array(last)[first][:, None]) & (new[:, None] | new[None, :])
                    np.fill_diagonal(good, False)
                    for i in np.flatnonzero(good.any(axis=1)):
                        at = np.flatnonzero(good[i])
                        if len(at) > keep:
                            at = at[np.argpartition(-sim[i, at], keep - 1)[:keep]]
                        out.append((member[i], member[at], sim[i, at]))
                yield pa.RecordBatch.from_arrays([*rows_of(out)], names=FIELDS)

        return gathered.select("member", "new", "code", "last").mapInArrow(run, FOUND)

    def _entries(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids and vectors of up to ``ENTRIES`` nodes, picked by hash."""
        rows = self.nodes.select("node", "half").orderBy(F.xxhash64("node"), "node").limit(ENTRIES).collect()
        return np.array([r["node"] for r in rows], np.int64), halves([bytes(r["half"]) for r in rows])

    def _graph(self) -> DataFrame:
        """(node, half, ids, scales, steps): the neighbours' differences to the
        node as 8-bit integers, one after the other."""
        own = self.lists.select("node", F.col("id").alias("member"), "sim")
        rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("sim"), "member"))
        back = own.select(F.col("member").alias("node"), F.col("node").alias("member"), "sim")
        back = back.withColumn("rank", rank).filter(F.col("rank") <= self.back).drop("rank")
        near = own.unionByName(back).drop("sim").join(self.nodes.select(F.col("node").alias("member"), F.col("half").alias("other")), "member")
        near = near.groupBy("node").agg(F.collect_list("member").alias("ids"), F.collect_list("other").alias("others"))  # neighbours + back

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = [], [], []
                for half, ids, others in zip(*(b.column(c).to_pylist() for c in ("half", "ids", "others"))):
                    ids, first = np.unique(np.array(ids or [], np.int64), return_index=True)
                    y = halves([others[i] for i in first]) - halves([half]) if len(ids) else np.zeros((0, 1), np.float32)
                    steps, scale = shrink(y)
                    for kept, x in zip(out, (ids, scale, steps.tobytes())):
                        kept.append(x)
                columns = [pa.array(out[0], pa.list_(pa.int64())), pa.array(out[1], pa.list_(pa.float32())), pa.array(out[2], pa.binary())]
                yield pa.RecordBatch.from_arrays([b.column("node"), b.column("half"), *columns], names=["node", "half", "ids", "scales", "steps"])

        rows = self.nodes.select("node", "half").join(near, "node", "left")
        return rows.mapInArrow(run, "node bigint, half binary, ids array<bigint>, scales array<float>, steps binary")

    def _pools(self, states: DataFrame, pool: int, beam: int) -> DataFrame:
        """(query, vector, ids, sims, seen), one row a query with all that was found:
        the best ``pool``, the last one's nearness, and the nodes to look into next."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out: list[list] = [[] for _ in range(5)]
                for ids, sims, seen in zip(*(b.column(c).to_pylist() for c in ("ids", "sims", "seen"))):
                    ids, sims, seen = np.array(ids, np.int64), np.array(sims, np.float32), np.array(seen, bool)
                    order = np.lexsort((-sims, ~seen, ids))
                    order = order[np.r_[True, ids[order[1:]] != ids[order[:-1]]]] if len(order) else order
                    order = order[np.lexsort((ids[order], -sims[order]))][:pool]
                    ids, sims, seen = ids[order], sims[order], seen[order]
                    ahead = np.flatnonzero(~seen)[:beam]
                    seen[ahead] = True
                    for kept, x in zip(out, (ids, sims, seen, ids[ahead], sims[-1] if len(ids) == pool else -np.inf)):
                        kept.append(x)
                types = (pa.list_(pa.int64()), pa.list_(pa.float32()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.float32())
                columns = [pa.array(x, t) for x, t in zip(out, types)]
                yield pa.RecordBatch.from_arrays([b.column("query"), b.column("vector"), *columns], names=["query", "vector", "ids", "sims", "seen", "ahead", "last"])

        schema = "query bigint, vector binary, ids array<bigint>, sims array<float>, seen array<boolean>, ahead array<bigint>, last float"
        return materialize(states.select("query", "vector", "ids", "sims", "seen").mapInArrow(run, schema), "pools")

    def _begin(self, queries: DataFrame) -> DataFrame:
        """Queries (query, v) with the nearest entries and their own lists."""
        names, y = self.entries
        length, width = self.length, self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = padded(b.column("v"), width) / length
                x = np.hstack([x, np.zeros((len(x), 1))]).astype(np.float16)
                sims = x.astype(np.float32) @ y.T
                columns = [pa.array(to_bytes(x), pa.binary()), pa.array([names] * len(x), pa.list_(pa.int64())), pa.array(list(sims), pa.list_(pa.float32()))]
                yield pa.RecordBatch.from_arrays([b.column("query"), *columns], names=["query", "vector", "ids", "sims"])

        first = queries.mapInArrow(run, "query bigint, vector binary, ids array<bigint>, sims array<float>")
        none = F.transform("ids", lambda _: F.lit(False))
        # a list's distances aren't inner products, so the query's own node comes first and leads on to them
        own = queries.join(self.nodes.select("node"), F.col("query") == F.col("node"), "left_semi").select("query", F.lit(float("inf")).cast("float").alias("sim"))
        first = first.join(own, "query", "left").withColumn("seen", none)
        known = F.col("sim").isNotNull()
        ids = F.when(known, F.concat("ids", F.array("query"))).otherwise(F.col("ids"))
        sims = F.when(known, F.concat("sims", F.array("sim"))).otherwise(F.col("sims"))
        seen = F.when(known, F.concat("seen", F.array(F.lit(False)))).otherwise(F.col("seen"))
        return first.select("query", "vector", ids.alias("ids"), sims.alias("sims"), seen.alias("seen"))

    def _look(self, pools: DataFrame) -> DataFrame:
        """What the graph has at the nodes ahead: (query, ids, sims)."""
        ahead = pools.select("query", "vector", "last", F.explode("ahead").alias("node"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                q, own = halves(b.column("vector").to_pylist()), halves(b.column("half").to_pylist())
                ids, scale = b.column("ids"), b.column("scales").flatten().to_numpy()
                n = np.array([len(x) // q.shape[1] for x in b.column("steps").to_pylist()])
                at = np.repeat(np.arange(len(n)), n)
                steps = np.frombuffer(b"".join(b.column("steps").to_pylist()), np.int8).reshape(-1, q.shape[1])
                sims = (q * own).sum(1)[at] + scale * np.einsum("nd,nd->n", steps, q[at])
                good = sims > b.column("last").to_numpy()[at]
                names, ends = ids.flatten().to_numpy(), np.cumsum(np.bincount(at[good], minlength=len(n)))
                offsets = pa.array(np.r_[0, ends], pa.int32())
                of = pa.ListArray.from_arrays
                yield pa.RecordBatch.from_arrays(
                    [b.column("query"), of(offsets, pa.array(names[good], pa.int64())), of(offsets, pa.array(sims[good], pa.float32()))], names=["query", "ids", "sims"]
                )

        joined = ahead.join(self.graph, "node").select("query", "vector", "last", "half", "ids", "scales", "steps")
        return joined.mapInArrow(run, "query bigint, ids array<bigint>, sims array<float>").filter(F.size("ids") > 0)

    def pools(self, queries: DataFrame, pool: int = POOL, beam: int = BEAM, steps: int = STEPS) -> DataFrame:
        """(query, v) -> (query, node), the nodes of each query's pool in the end."""
        out = self._pools(self._begin(queries), pool, beam)
        for _ in range(steps):
            if out.filter(F.size("ahead") > 0).isEmpty():
                break
            found = self._look(out).withColumns({"vector": F.lit(None).cast("binary"), "seen": F.transform("ids", lambda _: F.lit(False))})
            both = out.select("query", "vector", "ids", "sims", "seen").unionByName(found)
            flat = [F.flatten(F.collect_list(c)).alias(c) for c in ("ids", "sims", "seen")]  # pool + beam lists
            out = self._pools(both.groupBy("query").agg(F.max("vector").alias("vector"), *flat), pool, beam)
        return out.select("query", F.explode("ids").alias("node"))

    def search(self, queries: DataFrame, k: int, **limits: int) -> DataFrame:
        """(query, v) -> (query, found): the nearest rows, at most ``k``, as an array
        of (score, vec_id), nearest first; ``query`` must not repeat.

        A node that several rows share gives its ``k`` least ids; copies of an
        indexed query are in its pool through its own node.
        """
        pools = self.pools(queries, **limits)
        near = pools.join(self.nodes.select("node", "v"), "node").join(queries.select("query", F.col("v").alias("q")), "query")
        scored = materialize(near.select("query", "node", dot(F.col("q"), F.col("v")).alias("score")), "scores")
        rank = F.row_number().over(Window.partitionBy("node").orderBy("vec_id"))
        copies = self.copies.withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank")
        single = scored.join(self.copies.select("node").distinct(), "node", "left_anti").select("query", "score", F.col("node").alias("vec_id"))
        several = scored.join(copies, "node").select("query", "score", "vec_id")
        best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
        kept = single.unionByName(several).withColumn("rank", best).filter(F.col("rank") <= k)
        found = F.sort_array(F.collect_list(F.struct("rank", "score", "vec_id")))
        return kept.groupBy("query").agg(found.alias("found"))


def extended(x: np.ndarray) -> np.ndarray:
    """Rows of length up to one, with a component that makes it one."""
    rest = np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1)))
    return np.hstack([x, rest[:, None]])


def pairs(found: DataFrame) -> DataFrame:
    """(node, ids, sims) -> (node, id, sim)."""
    each = found.select("node", F.explode(F.arrays_zip("ids", "sims")).alias("x"))
    return each.select("node", F.col("x.ids").alias("id"), F.col("x.sims").alias("sim"))


def nearest_of_table(df: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest of the rows whose id ``every`` divides, among all others:
    query_id, rank, vec_id, score. Queries with equal vectors are searched once."""
    index = NearestNeighbours(df.withColumn(id_col, F.col(f"`{id_col}`").cast("long")), id_col, vector_col)
    asked = lambda c: F.col(c) % every == 0
    single = index.nodes.select("node").join(index.copies.select("node").distinct(), "node", "left_anti")
    members = index.copies.filter(asked("vec_id")).unionByName(single.filter(asked("node")).withColumn("vec_id", F.col("node")))
    queries = index.nodes.join(members.select("node").distinct(), "node", "left_semi").select(F.col("node").alias("query"), "v")
    found = materialize(index.search(queries, k + 1), "found")
    each = members.join(found, F.col("node") == F.col("query")).select(F.col("vec_id").alias("query_id"), "found")
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    rows = each.select("query_id", F.posexplode(others).alias("rank", "x"))
    return rows.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def op11_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_of_table(table(spark, sf_dir, "embeddings"))
