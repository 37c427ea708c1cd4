"""Near-dedup by similarity: wide SimHash sketches under a generalised pigeonhole,
then exact Jaccard similarity of the pairs found.

Two texts are near copies if the Jaccard similarity of their sets of five-word
shingles is 0.8 or more. A 64-bit fingerprint can't tell 0.8 from 0.6, so the
sketch has 1024 bits (16 words); the share of differing bits estimates the
angle between two sets and, with both set sizes, their similarity, with a
standard error of about 0.03. The estimate is a screen only: pairs from
``similarity - WIDE`` on are held against the sets themselves, and link if their
exact similarity is high enough. Sets of hashes are made for the texts that have
such a pair (``partnered`` tells which), with one more shuffle of the texts;
``links`` among those alone then verifies the pairs.

Candidates come from partitions of correlated bits, each with a threshold of
its own: two sketches meet if some partition i differs in at most t_i bits.
Texts at exactly the stated similarity differ in 15 % of the bits, which no
affordable sum of thresholds covers in the worst case, so the dynamic
programming chooses widths and thresholds whose chance to meet such a pair is
``RECALL`` at the least estimated cost (candidates and probes, from the number
of sketches and their bits); more similar pairs meet more surely. Two further
words of the sketch screen the candidates, then all 16 verify them.

A large group of near copies would make candidates quadratic. So every value's
sketches are first compared with the least of them (as many candidates as
values). What has a partner then needs no further search in ``partnered``, and in
``links`` the links found make groups, of which only sketches of different groups
are compared. Shingles that only one of the sets has (``private_counts``) bound
its similarity to any other from above, without error, and so does what both sets
share with the hub of their value, a central member of its largest group
(``_possible_by_hub``); pairs below a bound are passed over before anything else,
which ends the search within a cloud of texts that share most of their words and
yet aren't copies. A value with many sketches carries the whole sketches, so that
its join gives no more rows than there are partners, is dealt out in blocks, and
doesn't compare its largest group with itself.

Edge cases: a null text counts as empty; texts without words are copies of each
other; fewer than five words are one shingle; texts with equal shingle sets are
copies; rows without an id stay; repeated rows share their fate; an empty table
gives an empty result; other columns are passed on whatever their names.
"""

from __future__ import annotations

from functools import reduce
from itertools import product
from math import acos, log, pi

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, free_name, map_rows, materialize, prepare_python
from .components import connected_components
from .simhash import PROBE_COST, group_bits, mask_of

SHINGLE, SIMILARITY, SEED = 5, 0.8, 42
#: How far below the similarity an estimate still goes on to the exact check:
#: about 2 standard errors of the estimate.
WIDE = 0.055
WORDS, BITS = 16, 1024
#: Chance that two texts at exactly the stated similarity meet.
RECALL = 0.96
#: Widths to choose from: a word of 64 bits in 2, 3 or 4 partitions.
PARTS = (2, 3, 4)
#: A value of more sketches is compared by whole sketches if it also has so many times
#: those that half of all rows meet at theirs, or more than a block has; in blocks of so many.
CROWD, TIMES, BLOCK = 32, 8, 1024
#: Rows of values and probes a sketch that are shuffled at once.
AT_ONCE = 32
#: Words of the screen and the differing bits that still pass it: about 3.7
#: standard deviations above the mean of texts at exactly the similarity.
SCREEN_WORDS, SCREEN = 4, 60
_BLOCK = 4096
_C = [f"c{k}" for k in range(SCREEN_WORDS)]
_FACTORS = np.array([xxhash.xxh64_intdigest(bytes([i]), SEED) | 1 for i in range(WORDS)], np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BIT_TABLE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float32)
_OFFSETS = np.arange(WORDS * 8) * 256


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The set of shingles as sorted 64-bit hashes."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    h, last = xxhash.xxh64_intdigest, ends[min(shingle, len(words)) - 1 :].tolist()
    return np.unique(np.fromiter((h(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), last)), np.uint64, n))


def sketch(text: str | None, shingle: int = SHINGLE) -> tuple[int, int, list[int]]:
    """(digest of the shingle set, its size, the sketch as 16 signed words)."""
    hashes = shingle_hashes(text, shingle)
    if not len(hashes):
        return 0, 0, [0] * WORDS
    counts = np.zeros(WORDS * 8 * 256, np.int64)
    for i in range(0, len(hashes), _BLOCK):
        x = hashes[i : i + _BLOCK, None] * _FACTORS
        x = (x ^ (x >> np.uint64(32))) * _MIX
        x ^= x >> np.uint64(29)
        counts += np.bincount((x.astype(">u8").view(np.uint8) + _OFFSETS).ravel(), minlength=len(counts))
    ones = counts.reshape(WORDS * 8, 256).astype(np.float32) @ _BIT_TABLE
    bits = np.packbits(ones.ravel() * 2 > len(hashes))
    digest = xxhash.xxh64_intdigest(hashes.tobytes(), SEED)
    return digest - (1 << 64) if digest >> 63 else digest, len(hashes), bits.view(">i8").tolist()


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, content, node, size, sketch); ``content`` tells texts with the
    same id apart, ``node`` is the digest of the shingle set."""
    key = free_name(docs, "__content")
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))
    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(
        keyed,
        lambda: lambda r: [(r[id_col], r[key], *sketch(r[text_col], shingle))],
        [id_col, key, text_col],
        f"doc_id {kind}, content long, node long, size long, sketch array<long>",
    )


def share_of(similarity: float) -> float:
    """The most bits, as a share, that differ at that similarity on average."""
    return acos(2 * similarity / (1 + similarity)) / pi


def bit_moments(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """Count of sketches and, for each word, how many have bits i and j set.

    Each task adds up its own counts; the driver sees their sum only.
    """

    def run(batches):
        total, both = 0, np.zeros((WORDS, 64, 64))
        for b in batches:
            words = b.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64).reshape(-1, WORDS)
            for w in range(WORDS):
                bits = ((words[:, w, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.float32)
                both[w] += bits.T @ bits
            total += len(words)
        if total:
            values = np.append(both.ravel(), total).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"cell": np.arange(len(values)), "n": values})

    prepare_python(nodes.sparkSession)
    cells = nodes.select("sketch").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    out = np.zeros(WORDS * 64 * 64 + 1)
    for r in cells.collect():
        out[r["cell"]] = r["n"]
    return int(out[-1]), out[:-1].reshape(WORDS, 64, 64)


def allocate(choices: list[list[tuple[float, float]]], target: float, steps: int = 300) -> list[int]:
    """One choice (cost, gain) per word: the cheapest that gain ``target`` in
    all, or the most gain if none do."""
    unit = target / steps
    best = np.full(steps + 1, np.inf)
    best[0] = 0.0
    back = []
    for row in choices:
        new, came = np.full(steps + 1, np.inf), np.zeros((steps + 1, 2), np.int64)
        for c, (cost, gain) in enumerate(row):
            g = int(gain / unit)
            for s in np.flatnonzero(np.isfinite(best)):
                to = min(steps, s + g)
                if best[s] + cost < new[to]:
                    new[to], came[to] = best[s] + cost, (s, c)
        best = new
        back.append(came)
    at, out = int(np.flatnonzero(np.isfinite(best))[-1]), []
    for came in reversed(back):
        at, c = came[at]
        out.append(int(c))
    return out[::-1]


def plan_partitions(nodes: DataFrame, similarity: float = SIMILARITY) -> list[tuple[int, int, list[int]]]:
    """(word, threshold, bits) for each partition that is looked at."""
    total, both = bit_moments(nodes)
    q, options, choices = share_of(similarity), [], []
    for w in range(WORDS):
        set_share = np.diag(both[w]) / max(total, 1)
        differ = np.clip(2 * set_share * (1 - set_share), 1e-6, 0.5)
        found: dict[tuple, tuple[float, float]] = {}
        for m in PARTS:
            parts = group_bits(total, both[w], m)
            values = []
            for p in parts:
                equal, odds = float(np.prod(1 - differ[p])), differ[p] / (1 - differ[p])
                hit = (1 - q) ** len(p)
                one = hit * (1 + len(p) * q / (1 - q))
                pairs = total * total / 2 * equal
                values.append(
                    {
                        -1: (0.0, 0.0),
                        0: (pairs + PROBE_COST * total, -log(1 - hit)),
                        1: (pairs * (1 + odds.sum()) + PROBE_COST * total * (1 + len(p)), -log(1 - one)),
                    }
                )
            for ts in product((-1, 0, 1), repeat=m):
                cost, gain = map(sum, zip(*(v[t] for v, t in zip(values, ts))))
                found[tuple((t, tuple(p)) for t, p in zip(ts, parts) if t >= 0)] = (cost, gain)
        options.append(list(found))
        choices.append(list(found.values()))
    picked = allocate(choices, -log(1 - RECALL))
    return [(w, t, list(p)) for w, c in enumerate(picked) for t, p in options[w][c]]


def _distance(a: str, b: str) -> Column:
    return sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(WORDS)), F.lit(0))


def _linked(a: str, b: str, n_a: str, n_b: str, least: float) -> Column:
    """Is the estimated similarity, from the shared part of both sets, high enough?"""
    enough = F.lit(least / (1 + least)) * (F.col(n_a) + F.col(n_b))
    angle = F.cos(_distance(a, b) * F.lit(pi / BITS))
    return (F.col(n_a) >= enough) & (F.col(n_b) >= enough) & (angle * F.sqrt(F.col(n_a) * F.col(n_b)) >= enough)


def slices(plan: list[tuple[int, int, list[int]]]) -> list[list[int]]:
    """The partitions in runs of at most ``AT_ONCE`` rows a sketch, or one partition."""
    out, rows = [], AT_ONCE
    for i, (_, t, bits) in enumerate(plan):
        more = 2 + t * len(bits)
        if rows + more > AT_ONCE:
            out, rows = [*out, []], 0
        out[-1].append(i)
        rows += more
    return out


def _values(nodes: DataFrame, plan: list[tuple[int, int, list[int]]], probe: bool, of: list[int] | None = None) -> DataFrame:
    """(key, node, size, label, private, c0, c1, ...): the values of a sketch,
    or those that it probes; label and private where nodes have them. Of all
    partitions, or those of the numbers ``of``.

    ``key`` hashes partition and value (a clash costs one candidate more); the
    c are other words, for the screen. Partitions and flipped bits are rows of
    constant arrays, so the code doesn't grow with the plan.
    """
    kept = [c for c in nodes.columns if c != "sketch"]
    parts = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(w).alias("w"), F.lit(mask_of(bits)).cast("long").alias("mask")) for i, (w, _, bits) in enumerate(plan) if of is None or i in of])
    out = nodes.select(*kept, "sketch", F.explode(parts).alias("p"))
    word = lambda k: F.element_at("sketch", (F.pmod(F.col("p.w") + k, F.lit(WORDS)) + 1).cast("int"))
    screen = [word(k + 1).alias(c) for k, c in enumerate(_C)]
    out = out.select(*kept, "p.i", word(0).bitwiseAND(F.col("p.mask")).alias("value"), *screen)
    if probe:
        flips = [F.array(*[F.lit(mask_of(f)).cast("long") for f in [[], *([b] for b in bits if t == 1)]]) for _, t, bits in plan]
        flips = F.element_at(F.array(*flips), F.col("i") + 1)
        out = out.select("*", F.explode(flips).alias("flip")).withColumn("value", F.col("value").bitwiseXOR(F.col("flip")))
    return out.select(F.xxhash64("i", "value").alias("key"), *kept, *_C)


def _screened(a: list[Column], b: list[Column]) -> Column:
    """Do these words of two sketches pass the screen?"""
    return sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b)), F.lit(0)) <= SCREEN


def _possible(n_a: Column, r_a: Column, n_b: Column, r_b: Column, similarity: float) -> Column:
    """Can sets of these sizes, with so many shingles that no other set has,
    reach the similarity? They share at most what isn't private to either."""
    return _enough(F.least(n_a - r_a, n_b - r_b), n_a, n_b, similarity)


def _enough(most: Column, n_a: Column, n_b: Column, similarity: float) -> Column:
    return most >= F.lit(similarity) * (n_a + n_b - most)


def _possible_by_hub(similarity: float) -> Column:
    """The same from what both sets share with a third (null: not known): they
    share within it at most the less of the two, and outside of it at most what
    isn't private."""
    rest = lambda x: F.col(f"n_{x}") - F.col(f"h_{x}") - F.col(f"r_{x}")
    most = F.least(F.col("h_a"), F.col("h_b")) + F.least(rest("a"), rest("b"))
    known = F.col("h_a").isNotNull() & F.col("h_b").isNotNull()
    return ~known | _enough(most, F.col("n_a"), F.col("n_b"), similarity)


def _ordered() -> list[Column]:
    return [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]


def _verified(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("size").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    found = pairs.join(side("a"), "a").join(side("b"), "b").filter(_linked("s_a", "s_b", "n_a", "n_b", least))
    return found.select("a", "b")


def shared_counts(pairs: DataFrame, hashes: DataFrame) -> DataFrame:
    """The pairs (a, b) with ``shared``, the hashes that their sets in ``hashes``
    (node, hashes) have in common, and the sizes n_a and n_b."""
    side = lambda x: hashes.select(F.col("node").alias(x), F.col("hashes").alias(f"h_{x}"))
    found = pairs.join(side("a"), "a").join(side("b"), "b")
    return found.select("a", "b", F.size(F.array_intersect("h_a", "h_b")).alias("shared"), F.size("h_a").alias("n_a"), F.size("h_b").alias("n_b"))


def exact_links(counts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Those of the counted pairs that have that Jaccard similarity or more."""
    return counts.filter(F.col("shared") >= F.lit(similarity) * (F.col("n_a") + F.col("n_b") - F.col("shared"))).select("a", "b")


def private_counts(hashes: DataFrame) -> DataFrame:
    """(node, private): how many of a set's hashes no other set has (none: no
    row). Combines on the map side, so a common hash makes no hot key."""
    of = hashes.select("node", F.explode("hashes").alias("h")).groupBy("h").agg(F.count("*").alias("n"), F.min("node").alias("node"))
    return of.filter("n = 1").groupBy("node").agg(F.count("*").alias("private"))


def hubs_of(index: DataFrame) -> DataFrame:
    """(key, n, h, ...): each value's count of sketches and least sketch."""
    least = F.min(F.struct("node", *[c for c in index.columns if c not in ("key", "node")])).alias("h")
    return materialize(index.groupBy("key").agg(F.count("*").alias("n"), least).filter("n > 1"), "similar-values")


def _could(a: dict[str, Column], b: dict[str, Column], similarity: float) -> Column:
    """Bound and screen of two rows of values."""
    none = F.lit(0)
    bound = _possible(a["size"], a.get("private", none), b["size"], b.get("private", none), similarity)
    return bound & _screened([a[c] for c in _C], [b[c] for c in _C])


def star_links(nodes: DataFrame, index: DataFrame, hubs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Links (by the estimate) of each value's least sketch with the others at that value."""
    names = [c for c in index.columns if c != "key"]
    own, hub = {c: F.col(c) for c in names}, {c: F.col("h")[c] for c in names}
    met = index.join(hubs, "key").filter((own["node"] != hub["node"]) & _could(own, hub, similarity))
    met = materialize(met.select(hub["node"].alias("a"), F.col("node").alias("b")).distinct(), "similar-stars")
    return _verified(met, nodes, similarity - WIDE)


def plain_links(
    nodes: DataFrame, probing: DataFrame, plan: list[tuple[int, int, list[int]]], crowded: DataFrame, similarity: float = SIMILARITY
) -> DataFrame:
    """Links (by the estimate) of ``probing`` with sketches of different labels at a
    value of few; the partitions come in ``slices``, whose shuffles don't add up."""
    few = lambda x: x.join(crowded, "key", "left_anti")
    found = []
    for of in slices(plan):
        index, probes = few(_values(nodes, plan, False, of)), few(_values(probing, plan, True, of))
        a, b = ({c: F.col(f"{x}.{c}") for c in index.columns} for x in "ab")
        label = "label" if "label" in a else "node"
        same = (a["key"] == b["key"]) & (a[label] != b[label]) & _could(a, b, similarity)
        pairs = index.alias("a").join(probes.alias("b"), same).select(a["node"].alias("a"), b["node"].alias("b"))
        found.append(materialize(pairs.select(*_ordered()).distinct(), "similar-pairs"))
    return _verified(reduce(DataFrame.unionByName, found).distinct(), nodes, similarity - WIDE)


def crowd_limit(hubs: DataFrame, rows: int) -> int:
    """How many sketches a value may have that isn't crowded. The more sketches there are,
    the more share a value that all bits alike make; only what stands out is crowded."""
    known = hubs.agg(F.sum("n")).first()[0] or 0
    single = hubs.sparkSession.range(1).select(F.lit(1).cast("long").alias("n"), F.lit(rows - known).cast("long").alias("times"))
    seen = hubs.select("n", F.col("n").alias("times")).unionByName(single)
    half = seen.agg(F.percentile("n", F.lit(0.5), F.col("times"))).first()[0] or 1
    return max(CROWD, min(BLOCK, int(TIMES * half)))


def crowded_values(index: DataFrame, hubs: DataFrame, limit: int | None = None) -> DataFrame:
    """(key, n, largest, hub) of the values of more than ``limit`` (``CROWD``) sketches: the
    largest group, and its member with the fewest private shingles."""
    crowded = hubs.filter(F.col("n") > (CROWD if limit is None else limit)).select("key", "n")
    most = F.min_by("node", F.struct("private", "node")).alias("hub")
    groups = index.join(crowded, "key").groupBy("key", "label").agg(F.count("*").alias("m"), most)
    groups = groups.groupBy("key").agg(F.max_by(F.struct("label", "hub"), F.struct("m", "label")).alias("g"))
    groups = groups.select("key", F.col("g.label").alias("largest"), F.col("g.hub").alias("hub"))
    return materialize(crowded.join(groups, "key"), "similar-crowded")


def crowded_links(
    nodes: DataFrame, index: DataFrame, probes: DataFrame, crowded: DataFrame, how: str, similarity: float = SIMILARITY, known: DataFrame | None = None
) -> DataFrame:
    """The same at the ``crowded`` values, by whole sketches within the join:
    (a, b), or with ``how`` "left_semi" only the ``node`` of probes.

    The probes of a value are dealt to blocks, the index to all of its blocks.
    Probes of a value's largest group meet only the index of other groups (turn
    1), all others the whole index (turn 0). ``known`` (hub, node, shared) tells
    what sets share with hubs.
    """
    blocks, own = F.ceil(F.col("n") / BLOCK).cast("int"), F.coalesce(F.col("label") == F.col("largest"), F.lit(False))
    names = (("node", ""), ("size", "n_"), ("private", "r_"), ("sketch", "s_"), ("label", "l_"), ("shared", "h_"))

    def side(rows: DataFrame, x: str, block: Column, turn: Column) -> DataFrame:
        rows = rows.join(crowded, "key")
        rows = rows.withColumn("shared", F.lit(None).cast("int")) if known is None else rows.join(known, ["hub", "node"], "left")
        rows = rows.select("key", "node", "label", "size", "private", "shared", "largest", block.alias("block"), own.alias("own"))
        rows = rows.withColumn("turn", turn).join(nodes.select("node", "sketch"), "node")
        return rows.select("key", "block", "turn", *[F.col(c).alias(f"{t}{x}") for c, t in names])

    b = side(probes, "b", F.pmod(F.xxhash64("node"), blocks).cast("int"), F.col("own").cast("int"))
    every = F.explode(F.sequence(F.lit(0), blocks - 1))
    once = F.col("own") | F.col("largest").isNull()  # without a largest group there is no turn 1
    a = side(index, "a", every, F.explode(F.when(once, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))))
    same = (a.key == b.key) & (a.block == b.block) & (a.turn == b.turn) & (F.col("l_a") != F.col("l_b"))
    could = _possible(F.col("n_a"), F.col("r_a"), F.col("n_b"), F.col("r_b"), similarity) & _possible_by_hub(similarity)
    near = _screened(*[[F.col(c)[k] for k in range(0, WORDS, WORDS // SCREEN_WORDS)] for c in ("s_a", "s_b")])
    found = b.join(a, same & could & near & _linked("s_a", "s_b", "n_a", "n_b", similarity - WIDE), how)
    return found.select(F.col("b").alias("node")).distinct() if how == "left_semi" else found.select(*_ordered()).distinct()


def partnered(nodes: DataFrame, plan: list[tuple[int, int, list[int]]], similarity: float = SIMILARITY) -> DataFrame:
    """(node,) with a partner by the estimate; (node, size, sketch) -> nodes."""
    index = _values(nodes, plan, False)
    hubs = hubs_of(index)
    both = F.explode(F.array("a", "b")).alias("node")
    linked = materialize(star_links(nodes, index, hubs, similarity).select(both).distinct(), "similar-linked")
    probing = nodes.join(linked, "node", "left_anti")
    none = F.lit(None).cast("long")
    crowded = hubs.filter(F.col("n") > crowd_limit(hubs, nodes.count() * len(plan))).select("key", "n", none.alias("largest"), none.alias("hub"))
    crowded = materialize(crowded, "similar-crowded")
    found = plain_links(nodes, probing, plan, crowded, similarity).select(both)
    single = lambda x: x.withColumns({"label": F.col("node"), "private": F.lit(0)})
    crowd = crowded_links(nodes, single(index), single(_values(probing, plan, True)), crowded, "left_semi", similarity)
    return linked.unionByName(found).unionByName(crowd).distinct()


def links(nodes: DataFrame, plan: list[tuple[int, int, list[int]]], hashes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(node, size, sketch) and the ``hashes`` of all of them -> (a, b), exact
    links that connect all near copies met."""
    counted = lambda pairs: materialize(shared_counts(materialize(pairs, "similar-screened"), hashes), "similar-counted")
    nodes = nodes.join(private_counts(hashes), "node", "left").select("node", "size", "sketch", F.coalesce("private", F.lit(0)).alias("private"))
    nodes = materialize(nodes, "similar-bounded")
    index = _values(nodes, plan, False)
    hubs = hubs_of(index)
    stars = counted(star_links(nodes, index, hubs, similarity))

    def labelled(counts: DataFrame) -> DataFrame:
        groups = connected_components(exact_links(counts, similarity))
        return materialize(nodes.join(groups, "node", "left").withColumn("label", F.coalesce("label", "node")), "similar-labelled")

    # what the hubs of crowded values link belongs together before the rest is compared
    first = labelled(stars)
    crowded = crowded_values(_values(first, plan, False), hubs, crowd_limit(hubs, nodes.count() * len(plan)))
    met = _values(first, plan, True).join(crowded, "key").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    known = counted(met.distinct())
    stars = stars.unionByName(known.filter("a <> b"))
    nodes = labelled(stars)
    known = known.select(F.col("a").alias("hub"), F.col("b").alias("node"), "shared")
    largest = nodes.select(F.col("node").alias("hub"), F.col("label").alias("largest"))
    crowded = materialize(crowded.drop("largest").join(largest, "hub"), "similar-crowded")
    index, probes = _values(nodes, plan, False), _values(nodes, plan, True)
    found = plain_links(nodes, nodes, plan, crowded, similarity)
    found = found.unionByName(crowded_links(nodes, index, probes, crowded, "inner", similarity, known)).distinct()
    return exact_links(stars.unionByName(counted(found)), similarity).select(*_ordered()).distinct()


def hash_sets(docs: DataFrame, wanted: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(node, hashes) of the ``wanted`` (node, doc_id, content): one text each."""
    i, c, n, key = (free_name(docs, x) for x in ("__id", "__c", "__node", "__content"))
    wanted = wanted.select(F.col("doc_id").alias(i), F.col("content").alias(c), F.col("node").alias(n))
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))).select(F.col(f"`{id_col}`"), key, F.col(f"`{text_col}`"))
    keyed = keyed.join(wanted, F.col(f"`{id_col}`").eqNullSafe(F.col(i)) & (F.col(key) == F.col(c)))
    spark = docs.sparkSession
    prepare_python(spark)
    schema = "node long, hashes array<long>"
    fields = arrow_schema(spark, schema)

    def run(batches):
        for batch in batches:
            sets = [shingle_hashes(t.as_py(), shingle).view(np.int64) for t in batch.column(1)]
            ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
            values = pa.array(np.concatenate([np.zeros(0, np.int64), *sets]))
            column = pa.ListArray.from_arrays(pa.array(ends), values).cast(fields[1].type)
            yield pa.RecordBatch.from_arrays([batch.column(0), column], schema=fields)

    out = keyed.select(n, F.col(f"`{text_col}`")).mapInArrow(run, schema)
    return out.dropDuplicates(["node"])  # rows of a repeated document


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, content, component_id), one row for each row of ``docs``;
    ``component_id`` is the least id of the near copies, itself included."""
    prints = materialize(sketches(docs, id_col, text_col), "sketches")
    of_node = F.min("doc_id").alias("least"), F.first("size").alias("size"), F.first("sketch").alias("sketch"), F.min(F.struct("doc_id", "content")).alias("text")
    nodes = materialize(prints.groupBy("node").agg(*of_node), "similar-nodes")
    plan = plan_partitions(nodes, similarity)
    sketched = nodes.select("node", "size", "sketch")
    screened = materialize(nodes.join(partnered(sketched, plan, similarity), "node", "left_semi"), "similar-screened")
    wanted = screened.select("node", F.col("text.doc_id").alias("doc_id"), F.col("text.content").alias("content"))
    hashes = materialize(hash_sets(docs, wanted, id_col, text_col), "similar-hashes")
    labels = connected_components(links(screened.select("node", "size", "sketch"), plan, hashes, similarity))
    known = nodes.select("node", "least").join(labels, "node", "left")
    known = materialize(known.select("node", "least", F.coalesce("label", "node").alias("label")), "similar-labels")
    least = known.groupBy("label").agg(F.min("least").alias("component_id"))
    of_node = known.join(least, "label").select("node", "component_id")
    return prints.select("doc_id", "content", "node").join(of_node, "node").select("doc_id", "content", "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The documents that stay: of each group of near copies the one with the
    least id. Rows without an id stay.

    The texts are shuffled once, for the anti-join with the ids that go.
    """
    gone = similar_components(docs, id_col, text_col, similarity).filter("doc_id <> component_id")
    i, c, key = free_name(docs, "__id"), free_name(docs, "__c"), free_name(docs, "__content")
    gone = gone.select(F.col("doc_id").alias(i), F.col("content").alias(c)).distinct()
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))
    kept = keyed.join(gone, (F.col(f"`{id_col}`") == F.col(i)) & (F.col(key) == F.col(c)), "left_anti")
    return kept.select(*[F.col(f"`{x}`") for x in docs.columns])
