"""Toxicity by a factorization machine over hashed terms.

Terms are words and their character 4- to 6-grams (with marks at both ends of
the word), hashed to buckets. The machine learns a weight per term and a vector
per term; the product of two vectors weighs the pair, so an insult beside the
mention of a group can count for more than the sum of both.

Fitting takes a bounded sample of labelled rows (SAMPLE_ROWS, those with the
least hash of the id). The tasks count terms per label; the TERMS that tell
labels apart best by themselves are kept. So are, up to PAIR_TERMS, words that
tell them apart only together: for all pairs of the PAIR_WORDS most frequent
words the share of label 1 with both, either and neither is compared. A word
that is rarer than those in the sample can't be seen to act in pairs; that is
the price of the bound. Occurrences of the kept terms in the sample (bounded by
both) are fitted with AdaGrad. Scoring takes every whole text and shuffles
nothing.

Edge cases: a null or empty text has no terms and gets the score of the bias
alone; labels that are null or whose document is missing are not used; repeated
labels of a document count once, the largest, and of texts with one id the
largest is learned from; without labels of both kinds all scores are 0.5 or the
plain share; repeated rows get equal scores, ties of terms go by their bucket; an
empty table gives no scores; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import TwoGenerations, arrow_schema, map_rows, materialize, prepare_python, table

#: The bounds of fitting, and the size of the hash.
SAMPLE_ROWS, TERMS, BUCKETS, LEAST_DOCS = 12000, 4096, 1 << 20, 5
FACTORS, EPOCHS, BATCH, RATE, DECAY, SEED = 8, 12, 32, 0.1, 1e-4, 8
FOLDS = 5
#: Words whose pairs are looked at, words kept for their pairs, and how many
#: standard errors the effect of a pair must stand from none.
PAIR_WORDS, PAIR_TERMS, PAIR_ERRORS = 2048, 512, 6.0
#: Chi-square that a term must reach, the 0.1 % quantile of no connection.
LEAST_CHI = 10.83
WORD = re.compile(r"\w+")


def word_bucket(word: str) -> int:
    return xxhash.xxh64_intdigest(f"^{word}$", SEED) % BUCKETS


def terms_of(word: str) -> list[int]:
    """Buckets of a lower-case word: the word itself and its n-grams."""
    marked = f"^{word}$"
    grams = {marked, *(marked[i : i + n] for n in (4, 5, 6) for i in range(len(marked) - n + 1))}
    return [xxhash.xxh64_intdigest(g, SEED) % BUCKETS for g in grams]


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo FOLDS."""
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % FOLDS


class Terms:
    """Maps a text to positions of the kept terms."""

    def __init__(self, buckets: list[int] | None = None):
        at = None if buckets is None else {b: i for i, b in enumerate(buckets)}
        find = (lambda w: tuple(terms_of(w))) if at is None else (lambda w: tuple({at[t] for t in terms_of(w) if t in at}))
        self.known = TwoGenerations(find, 150_000 if at is not None else 20_000)

    def __call__(self, text: str | None) -> set[int]:
        words = set(WORD.findall((text or "").lower()))
        return set().union(*map(self.known.__getitem__, words))


@dataclass
class Machine:
    buckets: list[int]
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def score(self, terms: set[int]) -> float:
        at = sorted(terms)
        v = self.vectors[at]
        pairs = 0.5 * float((v.sum(axis=0) ** 2 - (v**2).sum(axis=0)).sum()) if at else 0.0
        z = self.bias + float(self.weights[at].sum()) + pairs
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(rows: list[tuple[list[int], int]], buckets: list[int], epochs: int = EPOCHS, factors: int = FACTORS) -> Machine:
    """AdaGrad on the logistic loss; rows are (positions of terms, label).
    Without factors the model is additive."""
    rng, n = np.random.default_rng(SEED), len(buckets)
    w, v = np.zeros(n), rng.normal(0, 0.01, (n, factors))
    share = (sum(y for _, y in rows) + 0.5) / (len(rows) + 1)
    bias = float(np.log(share / (1 - share)))
    gw, gv, gb = np.full(n, 1e-6), np.full((n, factors), 1e-6), 1e-6
    rows = [(np.array(sorted(t), int), y) for t, y in rows]
    for _ in range(epochs if rows else 0):
        for chunk in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // BATCH)):
            labels = np.array([rows[i][1] for i in chunk], float)
            of = np.repeat(np.arange(len(chunk)), [len(rows[i][0]) for i in chunk])
            at = np.concatenate([rows[i][0] for i in chunk])
            vs = v[at]
            total, squares, linear = np.zeros((len(chunk), factors)), np.zeros(len(chunk)), np.zeros(len(chunk))
            np.add.at(total, of, vs)
            np.add.at(squares, of, (vs**2).sum(axis=1))
            np.add.at(linear, of, w[at])
            z = bias + linear + 0.5 * ((total**2).sum(axis=1) - squares)
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / len(chunk)
            gb += error.sum() ** 2
            bias -= RATE * error.sum() / np.sqrt(gb)
            once, place = np.unique(at, return_inverse=True)
            g = np.bincount(place, error[of], len(once)) + DECAY * w[once]
            gw[once] += g**2
            w[once] -= RATE * g / np.sqrt(gw[once])
            g = DECAY * v[once]
            np.add.at(g, place, error[of][:, None] * (total[of] - vs))
            gv[once] += g**2
            v[once] -= RATE * 0.5 * g / np.sqrt(gv[once])
    return Machine(buckets, bias, w, v)


def training_sample(
    docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"
) -> DataFrame:
    """(text, label) of at most ``rows`` documents outside the held-out fold."""
    of = F.col(f"`{id_col}`")
    known = labels.filter(F.col(f"`{label_col}`").isNotNull() & of.isNotNull()).filter(fold(id_col) != 0)
    known = known.groupBy(of.alias("id")).agg(F.max(f"`{label_col}`").cast("int").alias("label"))
    picked = known.orderBy(F.xxhash64("id"), "id").limit(rows)
    texts = docs.select(of.alias("id"), F.col(f"`{text_col}`").alias("text"))
    texts = texts.join(F.broadcast(picked), "id")  # at most ``rows`` rows
    texts = texts.groupBy("id").agg(F.max("text").alias("text"), F.max("label").alias("label"))
    return materialize(texts.select("text", "label"), "toxicity-sample")


def pick_terms(sample: DataFrame, terms: int = TERMS, words: int = PAIR_WORDS) -> tuple[list[int], list[int]]:
    """The buckets that tell the labels apart best (chi-square of presence), and
    those of the most frequent words."""
    spark = sample.sparkSession
    prepare_python(spark)
    schema = "bucket long, n0 long, n1 long, word boolean"
    fields = arrow_schema(spark, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, find, whole = np.zeros((2, BUCKETS), np.int64), Terms(), np.zeros(BUCKETS, bool)
        told: set[str] = set()
        for b in batches:
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                counts[int(label > 0), list(find(text))] += 1
                told.update(WORD.findall((text or "").lower()))
            whole[list(map(word_bucket, told))] = True
            told.clear()
        at = np.flatnonzero(counts.sum(axis=0))
        for part in np.array_split(at, max(1, len(at) // 10_000)):
            columns = [pa.array(x, pa.int64()) for x in (part, *counts[:, part])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(whole[part])], schema=fields)

    n = {r["y"]: r["n"] for r in sample.groupBy((F.col("label") > 0).alias("y")).agg(F.count("*").alias("n")).collect()}
    n0, n1 = n.get(False, 0), n.get(True, 0)
    if not n0 or not n1:
        return [], []
    sums = F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.max("word").alias("word")
    counts = sample.mapInArrow(run, schema).groupBy("bucket").agg(*sums).filter(F.col("n0") + F.col("n1") >= LEAST_DOCS)
    share = (F.col("n0") + F.col("n1")) / float(n0 + n1)
    apart = F.pow(F.col("n1") / float(n1) - F.col("n0") / float(n0), 2) / (share * (1 - share) + 1e-9) * (n0 * n1 / (n0 + n1))
    counts = materialize(counts.withColumn("chi", apart), "toxicity-terms")
    best = counts.filter(F.col("chi") >= LEAST_CHI).orderBy(F.desc("chi"), "bucket").limit(terms)
    often = counts.filter("word").orderBy(F.desc(F.col("n0") + F.col("n1")), "bucket").limit(words)
    return [r["bucket"] for r in best.collect()], [r["bucket"] for r in often.collect()]  # at most so many rows


def pair_words(rows: list[tuple[np.ndarray, int]], words: np.ndarray, most: int = PAIR_TERMS) -> list[int]:
    """Of the positions ``words`` those in pairs whose effect on the label isn't
    the sum of their own effects: with p the share of label 1 among texts with
    both, one or none, p11 - p10 - p01 + p00 is many standard errors from zero."""
    size = len(words)
    if size < 2:
        return []
    place = np.full(max(int(max((t.max(initial=0) for t, _ in rows), default=0)), int(words.max())) + 1, -1)
    place[words] = np.arange(size)
    n11, k11 = np.zeros((size, size), np.float32), np.zeros((size, size), np.float32)
    total, ones = len(rows), sum(y for _, y in rows)
    for i in range(0, total, 1000):
        part = rows[i : i + 1000]
        x = np.zeros((len(part), size), np.float32)
        for line, (terms, _) in zip(x, part):
            at = place[terms]
            line[at[at >= 0]] = 1
        n11 += x.T @ x
        x = x[[y > 0 for _, y in part]]
        k11 += x.T @ x
    n1, k1 = np.diag(n11).copy(), np.diag(k11).copy()
    best = np.zeros(size)
    for i in range(size):  # a word against all others
        n = n11[i], n1[i] - n11[i], n1 - n11[i], total - n1[i] - n1 + n11[i]
        k = k11[i], k1[i] - k11[i], k1 - k11[i], ones - k1[i] - k1 + k11[i]
        p = [(b + 0.5) / (a + 1) for a, b in zip(n, k)]
        error = np.sqrt(sum(q * (1 - q) / (a + 1) for a, q in zip(n, p)))
        z = np.abs(p[0] - p[1] - p[2] + p[3]) / error
        z[(np.minimum.reduce(n) < LEAST_DOCS) | (np.arange(size) == i)] = 0
        best[i] = z.max()
    order = np.argsort(-best, kind="stable")[:most]
    return [int(words[i]) for i in order if best[i] >= PAIR_ERRORS]


def training_rows(sample: DataFrame) -> tuple[list[tuple[np.ndarray, int]], list[int]]:
    """(positions of terms, label) for each text of the sample, and the buckets of the terms."""
    chosen, words = pick_terms(sample)
    known = list(dict.fromkeys([*chosen, *words]))

    def make():
        find = Terms(known)
        return lambda r: [(np.array(sorted(find(r["text"])), "<i4").tobytes(), int(r["label"] > 0))]

    rows = map_rows(sample, make, ["text", "label"], "terms binary, label int").collect()  # bounded by the sample
    rows = [(np.frombuffer(t, "<i4"), y) for t, y in sorted((bytes(r["terms"]), r["label"]) for r in rows)]
    at = {b: i for i, b in enumerate(known)}
    paired = pair_words(rows, np.array([at[b] for b in words], int))
    kept = np.array(sorted({*range(len(chosen)), *paired}), int)
    new = np.full(len(known), -1)
    new[kept] = np.arange(len(kept))
    return [(x[x >= 0], y) for x, y in ((new[t], y) for t, y in rows)], [known[i] for i in kept]


def train(docs: DataFrame, labels: DataFrame, factors: int = FACTORS) -> Machine:
    rows, buckets = training_rows(training_sample(docs, labels))
    return fit(rows, buckets, factors=factors)


def score_documents(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; no shuffle."""

    def make():
        find = Terms(machine.buckets)

        def row(r):
            score = machine.score(find(r[text_col]))
            name = "" if r[id_col] is None else str(r[id_col])
            return [(r[id_col], zlib.crc32(name.encode()) % FOLDS == 0, score, int(score >= 0.5))]

        return row

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs, make, [id_col, text_col], f"doc_id {kind}, held_out boolean, score double, predicted int")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
