"""Sequence packing by Karmarkar-Karp multiway differencing.

Every document becomes token ids plus an end id. Full windows are cut off its
front; what is left, together with that of its neighbours in the same input
partition, is dealt out to windows: partial partitions (k partial sums each)
are merged so that the largest sums of one meet the smallest of the other, the
most unbalanced first. Beginning with the least count that could hold all
tokens, the count of windows rises until no window exceeds the capacity.

A few documents of each batch are cut into pieces of halving length down to
one token. They are differenced last and level the windows out.

Batches are bounded and stay within a task, so nothing is shuffled, no key can
be hot, and a lost task gives the same rows again. Sequence ids combine the
input partition with a count.

Edge cases: a null text counts as empty, that is the end id alone; repeated
rows are packed once each; a null id stays null; an empty table gives no rows;
other columns are ignored, whatever their names. A batch ends with its input
partition at the latest, so very small partitions pack less tightly.
"""

from __future__ import annotations

import bisect
import heapq
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import TwoGenerations, arrow_schema, prepare_python, table, to_batch

CAPACITY, END_ID = 2048, 1
#: Pieces that are packed together.
BATCH_PIECES = 1024
#: Of so many documents one is cut fine.
FINE_EVERY = 8
VOCABULARY = "word_bpe_49k.json"
SCHEMA = "`{id}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long"


class WordTokenizer:
    """Ids of whole texts, looked up by what stands between spaces.

    The tokenizer drops white space and never looks across it. What isn't
    known yet and consists of lower Latin letters, digits and ASCII marks is
    split by the tokenizer's own pattern and handed to its model word by word;
    anything else runs through the whole tokenizer.
    """

    #: Characters that neither composition nor, once lowered, lower case changes.
    PLAIN = re.compile("[\t\n\r !-@\\[-~ß-öø-ÿ]*")
    #: Characters for which str.lower() might differ from the tokenizer's rule.
    OTHER = re.compile("[^\u0000-\u012f\u0131-\u024f]")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path) as f:
            split, level = json.load(f)["pre_tokenizer"]["pretokenizers"]
        assert split["type"] == "Split" and split["behavior"] == "Removed" and level["type"] == "ByteLevel"
        self.find = regex.compile(split["pattern"]["Regex"]).findall
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model, self.level = self.tokenizer.model, self.tokenizer.pre_tokenizer[1]
        self.letters = TwoGenerations(self._letter, 1000)
        self.words = TwoGenerations(self._word, 200_000)
        self.known = TwoGenerations(self._chunk, 200_000)

    def _letter(self, letter: str) -> str:
        """The characters that stand for the bytes of a letter."""
        return self.level.pre_tokenize_str(letter)[0][0]

    def _word(self, word: str) -> bytes:
        if not word.isascii():
            word = "".join(map(self.letters.__getitem__, word))
        ids = [t.id for t in self.model.tokenize(word)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _chunk(self, chunk: str) -> bytes:
        if not self.PLAIN.fullmatch(chunk):
            ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        if chunk.isalpha():  # one word; the pattern would find just that
            return self.words[chunk]
        return b"".join([self.words[w] for w in self.find(chunk)])

    def ids(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not self.OTHER.search(text):
            text = text.lower()
        return b"".join(map(self.known.__getitem__, text.replace("\n", " ").split(" ")))


@lru_cache(2)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def cuts(tokens: int, fine: bool, capacity: int = CAPACITY) -> list[int]:
    """Lengths of a document's pieces: full windows, then the rest, whole or
    in halving steps."""
    out = [capacity] * (tokens // capacity)
    rest = tokens % capacity
    while fine and rest > 1:
        out.append(rest - rest // 2)
        rest //= 2
    return out + [rest] * (rest > 0)


def difference(lengths: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp: positions of ``lengths`` dealt out to ``k`` windows.

    A partial partition holds its windows that aren't empty as (sum, tie,
    members) in rising order; of the rest, up to k, each has the sum zero. The
    two with the largest difference of sums are merged until one is left.
    """
    heap = [(-n, i, [(n, i, [i])]) for i, n in enumerate(lengths)]
    heapq.heapify(heap)
    tie = len(lengths)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        if len(a) == 1:
            a, b = b, a
        if len(b) == 1:  # its one sum meets the smallest of the other
            total, _, members = b[0]
            if len(a) == k:
                least = a.pop(0)
                total, members = total + least[0], least[2] + members
            bisect.insort(a, (total, tie, members))
        else:
            falling = b[::-1]
            empty = k - len(a)  # so many windows of a are empty and take the largest of b as they are
            merged = falling[:empty] + [
                (x[0] + y[0], tie, x[2] + y[2]) for x, y in zip(a, falling[empty:])
            ]
            merged += a[max(0, len(falling) - empty) :]
            a = sorted((n, tie + i, members) for i, (n, _, members) in enumerate(merged))
            tie += k
        spread = a[-1][0] - (a[0][0] if len(a) == k else 0)
        heapq.heappush(heap, (-spread, tie, a))
        tie += 1
    return [w[2] for w in heap[0][2]] if heap else []


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Windows (lists of positions), none above ``capacity``."""
    k = -(-sum(lengths) // capacity)
    while True:
        windows = difference(lengths, k)
        over = sum(max(0, sum(lengths[i] for i in w) - capacity) for w in windows)
        if not over:
            return windows
        k += max(1, over // capacity)


def pack_documents(
    docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    prepare_python(spark)
    schema = SCHEMA.format(id=id_col, kind=docs.schema[id_col].dataType.simpleString())
    fields = arrow_schema(spark, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(path)
        sequence = TaskContext.get().partitionId() << 33
        end = np.array([END_ID], "<u4").tobytes()
        full: list[tuple] = []
        short: list[tuple] = []
        count = 0

        def packed() -> list[tuple]:
            nonlocal sequence
            out = []
            for window in pack([p[2] for p in short], capacity):
                at = 0
                for i in window:
                    out.append((*short[i], sequence, at))
                    at += short[i][2]
                sequence += 1
            short.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = tokenizer.ids(text or "") + end
                total, start, count = len(ids) // 4, 0, count + 1
                for n in cuts(total, count % FINE_EVERY == 0, capacity):
                    piece = (doc, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), total)
                    start += n
                    if n == capacity:
                        full.append((*piece, sequence, 0))
                        sequence += 1
                    else:
                        short.append(piece)
            if len(short) >= BATCH_PIECES:
                full += packed()
            yield to_batch(full, fields)
            full = []
        yield to_batch(packed(), fields)

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(run, schema)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
