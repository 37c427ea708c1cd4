"""Substring dedup by content-defined chunks.

A gear rolling hash over the last 16 bytes cuts a text where some of its bits
are zero, so the cuts depend on content alone and meet again shortly behind an
insertion. Chunks are deduplicated by a 128-bit digest: those that occur in two
documents or more are looked up, neighbouring ones are joined to spans, and
spans of enough words are reported, or removed from all documents but the first.

Counting digests combines on the map side. A digest that very many documents
share stands on the large side of an inner join with unique digests only, which
Spark splits where it is skewed.

Edge cases: a null text counts as empty and has no chunks; texts shorter than
the least chunk are one chunk; repeated rows (same id) are one document, in which
repeats aren't looked for; of documents that share a chunk the least id is the
first; rows with a null id are left out of the search and keep their text; an
empty table gives no spans; other columns are passed on or ignored, whatever
their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_schema, free_name, materialize, prepare_python, table

#: Least and largest chunk in bytes, zero bits that make a cut, words of a span.
LEAST, LARGEST, CUT_BITS, SPAN_WORDS = 24, 512, 5, 16
#: The gear: a random 64-bit number for each byte.
GEAR = np.random.default_rng(20).integers(0, 1 << 64, 256, dtype=np.uint64)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def cuts(data: np.ndarray, least: int = LEAST, largest: int = LARGEST, bits: int = CUT_BITS) -> list[int]:
    """Ends of the chunks of an array of bytes."""
    size = len(data)
    h = GEAR[data]
    for step in (1, 2, 4, 8):  # doubles the bytes that the hash has seen, to 16
        shifted = h[:-step] << np.uint64(step)
        h = h.copy()
        h[step:] += shifted
    mask = np.uint64(((1 << bits) - 1) << (16 - bits))  # bits that depend on all of the last bytes
    out, start = [], 0
    for end in (np.flatnonzero((h & mask) == 0) + 1).tolist():
        while end - start > largest:
            start += largest
            out.append(start)
        if end - start >= least:
            start = end
            out.append(end)
    while size - start > largest:
        start += largest
        out.append(start)
    if start < size:
        out.append(size)
    return out


def chunk_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, size, words, d1, d2): chunks with byte positions, words
    that begin in them, and the two halves of their digest."""
    spark = docs.sparkSession
    prepare_python(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, start int, size int, words int, d1 long, d2 long"
    fields = arrow_schema(spark, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = hashlib.blake2b
        for b in batches:
            ids, starts, sizes, words, digests = [], [], [], [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                raw = (text or "").encode("utf-8")
                data = np.frombuffer(raw, np.uint8)
                if not raw:
                    continue
                ends = cuts(data)
                begins = [0, *ends[:-1]]
                space = _SPACE[data]
                first = ~space
                first[1:] &= space[:-1]
                ids += [doc] * len(ends)
                starts += begins
                sizes += [e - s for s, e in zip(begins, ends)]
                words.append(np.add.reduceat(first, begins, dtype=np.int32))
                digests += [digest(raw[s:e], digest_size=16).digest() for s, e in zip(begins, ends)]
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            counts = np.concatenate(words) if words else np.zeros(0, np.int32)
            columns = (ids, starts, sizes, counts, halves[:, 0], halves[:, 1])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], schema=fields)

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).filter(F.col(f"`{id_col}`").isNotNull()).mapInArrow(run, schema)


def shared_spans(chunks: DataFrame, least_words: int = SPAN_WORDS) -> DataFrame:
    """(doc_id, start, length, n_words, first_doc_id, is_first): spans of
    neighbouring chunks that other documents have as well, and that begin in the
    same document. ``least_words`` counts the whole run of neighbouring shared
    chunks, so a run isn't dropped because it has several first documents."""
    counts = chunks.groupBy("d1", "d2").agg(F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("other"))
    counts = counts.filter("first_doc_id <> other").drop("other")
    found = chunks.join(counts, ["d1", "d2"]).select("doc_id", "start", "size", "words", "first_doc_id")
    found = found.repartition("doc_id").distinct()  # rows of a repeated document; the window needs the same exchange
    order = Window.partitionBy("doc_id").orderBy("start")
    found = found.withColumn("gap", F.col("start") != F.lag(F.col("start") + F.col("size"), 1, -1).over(order))
    found = found.withColumn("turn", F.col("gap") | (F.col("first_doc_id") != F.lag("first_doc_id").over(order)))
    found = found.withColumn("run", F.sum(F.col("gap").cast("int")).over(order))
    found = found.withColumn("span", F.sum(F.col("turn").cast("int")).over(order))
    spans = found.groupBy("doc_id", "run", "span").agg(
        F.min("start").cast("long").alias("start"),
        F.sum("size").alias("length"),
        F.sum("words").alias("n_words"),
        F.first("first_doc_id").alias("first_doc_id"),
    )
    whole = F.sum("n_words").over(Window.partitionBy("doc_id", "run"))
    spans = spans.withColumn("whole", whole).filter(F.col("whole") >= least_words).drop("run", "span", "whole")
    spans = spans.select("doc_id", "start", "length", "n_words", "first_doc_id")
    return spans.withColumn("is_first", F.col("doc_id") == F.col("first_doc_id"))


def remove_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the given byte spans (start, length)."""
    raw, out, at = text.encode("utf-8"), [], 0
    for start, length in sorted(spans):
        out.append(raw[at:start])
        at = start + length
    return b"".join([*out, raw[at:]]).decode("utf-8", errors="ignore")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with shared spans removed from all documents but the first."""
    chunks = materialize(chunk_table(docs, id_col, text_col), "chunks")
    gone = shared_spans(chunks).filter(~F.col("is_first"))
    doc, held = free_name(docs, "__doc"), free_name(docs, "__spans")
    gone = gone.groupBy(F.col("doc_id").alias(doc)).agg(F.collect_list(F.struct("start", "length")).alias(held))  # of one text

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        pairs = zip(texts, spans)
        return pd.Series([t if s is None or t is None else remove_spans(t, [(x["start"], x["length"]) for x in s]) for t, s in pairs])

    out = docs.join(gone, F.col(f"`{id_col}`") == F.col(doc), "left")
    return out.select(*[cut(F.col(f"`{c}`"), held).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def op4_substring_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = materialize(chunk_table(table(spark, sf_dir, "documents")), "chunks")
    return shared_spans(chunks)
