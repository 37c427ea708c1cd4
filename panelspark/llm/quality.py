"""Quality rules by compression bands.

Zstandard ratios of the whole text and of its fixed chunks are held against
limits that depend on length: text below the band repeats itself (or is built
from a few symbols), text above it is noise. The low limit falls with the length,
since the ratio of clean prose does. Short texts have short chunks; where the
chunks don't come out even, a last one ends with the text, so every byte is
judged. The bands are those of one byte a character, so a text of another
alphabet is judged with one byte for each of its letters.

The limits leave room for prose that isn't from here: manuals and licences of the
same length. Random small letters compress like such prose below some 900 bytes, so
no ratio tells these; random letters with digits or signs are told from 100 bytes on.

Edge cases: a null text counts as empty and has no words; a text without words
fails the base rules; very long texts are judged whole; a ratio on a limit is inside
it; an empty table gives an empty result; rows that repeat are judged alike, each on its own; other
columns are passed on untouched, whatever their names.
"""

from __future__ import annotations

import codecs
import re
from bisect import bisect_right
from collections import Counter

import zstandard
from pyspark.sql import DataFrame, SparkSession

from .common import ddl, map_rows, prepare_python, table

#: (bytes from, lowest ratio, highest ratio) of a whole text.
BANDS = (
    (0, 0.0, 2.0),
    (96, 0.35, 0.98),
    (160, 0.45, 0.88),
    (224, 0.45, 0.79),
    (272, 0.45, 0.77),
    (360, 0.45, 0.745),
    (450, 0.44, 0.73),
    (600, 0.44, 0.69),
    (760, 0.43, 0.66),
    (900, 0.43, 0.62),
    (1024, 0.43, 0.612),
    (1500, 0.42, 0.59),
    (1800, 0.42, 0.575),
    (2048, 0.42, 0.57),
    (3072, 0.41, 0.55),
    (4096, 0.405, 0.53),
    (8192, 0.395, 0.50),
    (16384, 0.375, 0.49),
    (1 << 16, 0.355, 0.49),
    (1 << 18, 0.335, 0.49),
    (1 << 20, 0.315, 0.49),
    (1 << 22, 0.30, 0.49),
)
#: From so many bytes a character a text is recoded, if its most frequent letters
#: (as many as one byte has room for) make up that share of those beyond ASCII.
WIDE_BYTES, LETTERS, LETTER_SHARE = 1.2, 128, 0.95
#: (bytes of the text from, bytes of a chunk, its lowest and highest ratio); below
#: the first the text is one chunk. The share of chunks outside that rejects.
CHUNKS = ((512, 256, 0.40, 0.84), (1024, 1024, 0.45, 0.65), (5120, 1024, 0.45, 0.61), (16384, 4096, 0.42, 0.55))
BAD_SHARE = 0.2
LEVEL = 3
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
SYMBOLS = re.compile(r"[#*$%&|<>]")


def repeated_words(words: list[bytes]) -> int:
    """Words lying in a 3-word window that occurs twice or more in the text."""
    if len(words) < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    seen: set = set()
    twice = {w for w in windows if w in seen or seen.add(w)}
    count, covered = 0, 0  # words before position `covered` are counted already
    for i, w in enumerate(windows):
        if w in twice:
            count += i + 3 - max(i, covered)
            covered = i + 3
    return count


def duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.encode("utf-8").split()]
    return len(lines) - len(set(lines))


def one_byte_letters(text: str, data: bytes) -> bytes:
    """``data``, the UTF-8 of ``text``, or one byte a character for an alphabet
    beyond ASCII; scripts with too many characters for that stay in UTF-8."""
    if len(data) < WIDE_BYTES * len(text):
        return data
    counts = Counter(c for c in text if c > "\x7f")
    common = counts.most_common(LETTERS)
    if sum(n for _, n in common) < LETTER_SHARE * counts.total():
        return data
    table = {i: i for i in range(128)} | {ord(c): 128 + i for i, (c, _) in enumerate(sorted(common))}
    return codecs.charmap_encode(text, "replace", table)[0]


def in_band(ratio: float, n: int, bands=BANDS) -> bool:
    _, low, high = bands[bisect_right([b[0] for b in bands], n) - 1]
    return low <= ratio <= high


class CompressionBands:
    """The verdict of the method, with the ratios behind it."""

    def __init__(self, bands=BANDS, chunks=CHUNKS, bad_share=BAD_SHARE, level=LEVEL):
        self.bands, self.chunks, self.bad_share = bands, chunks, bad_share
        self.squeeze = zstandard.ZstdCompressor(level=level, write_checksum=False, write_content_size=False).compress

    def bad_chunks(self, data: bytes) -> float:
        """The share of chunks outside the band of their size."""
        n = len(data)
        at = bisect_right([c[0] for c in self.chunks], n)
        if not at:
            return 0.0
        _, size, low, high = self.chunks[at - 1]
        starts = [*range(0, n - size + 1, size), *([n - size] if n % size else [])]
        return sum(not low <= len(self.squeeze(data[i : i + size])) / size <= high for i in starts) / len(starts)

    def __call__(self, data: bytes) -> tuple[bool, float, float]:
        n = len(data)
        if not n:
            return True, 1.0, 0.0
        ratio, bad = len(self.squeeze(data)) / n, self.bad_chunks(data)
        return in_band(ratio, n, self.bands) and bad <= self.bad_share, ratio, bad


def judge(text: str | None, verdict: CompressionBands) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, ratio, bad chunk share) of a text."""
    text = text or ""
    data = text.encode("utf-8")
    words = data.split()  # at the white space of ASCII
    n = len(words)
    # code points of the words: those of the text less its white space
    chars = len(text) - (len(data) - sum(map(len, words)))
    repeat = repeated_words(words)
    failed = n < MIN_WORDS or 100 * repeat > MAX_REPEATED_PERCENT * n
    good, ratio, bad = verdict(one_byte_letters(text, data))
    return n, chars, len(SYMBOLS.findall(text)), duplicate_lines(text), repeat, failed, not failed and good, ratio, bad


def quality_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with base statistics, ratios and verdict; no shuffle."""

    def make():
        verdict = CompressionBands()
        return lambda r: [(r[id_col], *judge(r[text_col], verdict))]

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(
        docs,
        make,
        [id_col, text_col],
        f"`{id_col}` {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, kept boolean, zstd_ratio double, bad_chunk_share double",
    )


def quality_filter(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that the rules keep, with all their columns; no shuffle."""
    import pyarrow as pa

    prepare_python(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches):
        verdict = CompressionBands()
        for batch in batches:
            yield batch.filter(pa.array([judge(t.as_py(), verdict)[6] for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, ddl(docs))


def op9_quality_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"))
