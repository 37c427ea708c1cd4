"""Byte-level BPE encoding by prefix dynamic programming.

For every byte prefix of a piece there is exactly one encoding, so exactly one
last token. Storing that token per prefix gives the encoding by walking back
from the end; appending bytes only extends the table, and an edit recomputes
the table from the edited byte on, until it meets the old one again.

A token may follow the last token of the prefix before it only if BPE would
not merge across their border. A merge (x, y) across it happens when x stands
at the right edge of the left token and y at the left edge of the right token
at the time of that merge, that is before either takes part in a merge of its
own token (a merge of equal rank further left goes first).

Edge cases: a null text counts as empty and has no tokens (digests of nothing);
texts of any length are encoded piece by piece; repeated rows each get their
row; a null id stays null; an empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import TwoGenerations, map_rows, table

ENDLESS = 1 << 40
#: Bytes up to which a piece's prefixes are shared with those of other pieces, and
#: how many of them a task holds.
SHARED_BYTES, SHARED_PREFIXES = 48, 400_000
VOCABULARY = "byte_bpe_50k.tiktoken"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PrefixEncoder:
    """Encodes byte strings with the ranks of a byte-level BPE vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for b, r in ranks.items():
            self.bytes_of[r] = b
        self.longest = max(map(len, ranks))
        #: Rank of each token; -1 for a beginning of tokens that is none itself.
        self.known = {b[:n]: -1 for b in ranks for n in range(1, len(b))} | ranks
        self._edges: dict[int, tuple[list, list]] = {}
        self._valid: dict[int, bool] = {}
        self._last: dict[bytes, int] = {}

    def _split(self, token: bytes) -> tuple[bytes, bytes]:
        """The two parts whose merge makes the token (BPE on its own bytes)."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            ranked = [self.ranks.get(a + b, ENDLESS) for a, b in zip(parts, parts[1:])]
            i = ranked.index(min(ranked))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts[0], parts[1]

    def _edge(self, token: int) -> tuple[list, list]:
        """Tokens that stand at the left and at the right edge while the token
        grows, each with the rank of the merge that ends it."""
        if token not in self._edges:
            out = []
            for side in (0, 1):
                part, end, found = self.bytes_of[token], ENDLESS, []
                while True:
                    found.append((part, end))
                    if len(part) == 1:
                        break
                    end = self.ranks[part]
                    part = self._split(part)[side]
                out.append(found)
            self._edges[token] = (out[0], out[1])
        return self._edges[token]

    def may_follow(self, left: int, right: int) -> bool:
        """Whether BPE leaves these two tokens, side by side, as they are."""
        known = self._valid.get(left << 32 | right)
        if known is None:
            get = self.ranks.get
            known = True
            for x, x_end in self._edge(left)[1]:
                for y, y_end in self._edge(right)[0]:
                    merged = get(x + y)
                    if merged is not None and merged < x_end and merged <= y_end:
                        known = False
            if len(self._valid) > 300_000:
                self._valid.clear()
            self._valid[left << 32 | right] = known
        return known

    def extend(self, data: bytes, last: list[int]) -> list[int]:
        """Fill the table ``last`` (last token of each non-empty prefix) for
        all of ``data``; what it holds already is kept.

        From each start, in order, tokens are read off as long as some token
        continues; a token settles the prefix that it ends if it may follow.
        """
        known, size, follows = self.known, len(data), self._valid
        begin = max(0, len(last) - self.longest + 1)
        last += [-1] * (size - len(last))
        for start in range(begin, size):
            before = last[start - 1] if start else -1
            for end in range(start, size):
                token = known.get(data[start : end + 1])
                if token is None:
                    break
                if token >= 0 and last[end] < 0:
                    if start:
                        follow = follows.get(before << 32 | token)
                        if follow is None:
                            follow = self.may_follow(before, token)
                        if not follow:
                            continue
                    last[end] = token
        return last

    def last_token(self, data: bytes, last: list[int], size: int) -> int:
        """The last token of the prefix of ``size`` bytes, from shorter ones."""
        for start in range(max(0, size - self.longest), size):
            token = self.ranks.get(data[start:size])
            if token is not None and (start == 0 or self.may_follow(last[start - 1], token)):
                return token
        raise ValueError("the vocabulary lacks a byte")

    def tokens(self, last: list[int], end: int | None = None) -> list[int]:
        """The encoding of the first ``end`` bytes, read back from the table."""
        out, at = [], len(last) if end is None else end
        while at:
            out.append(last[at - 1])
            at -= len(self.bytes_of[last[at - 1]])
        return out[::-1]

    def last_of(self, prefix: bytes) -> int:
        """The last token of a short prefix. It doesn't depend on what follows,
        so all pieces that begin alike share one table of prefixes; only those
        before a possible last token are looked at."""
        last = self._last.get(prefix)
        if last is None:
            get, follows = self.ranks.get, self._valid
            last = get(prefix)
            for start in range(max(1, len(prefix) - self.longest), len(prefix)) if last is None else ():
                token = get(prefix[start:])
                if token is not None:
                    before = self.last_of(prefix[:start])
                    follow = follows.get(before << 32 | token)
                    if self.may_follow(before, token) if follow is None else follow:
                        last = token
                        break
            self._last[prefix] = last
        return last

    def encode(self, data: bytes) -> list[int]:
        if len(data) > SHARED_BYTES:
            whole = self.ranks.get(data)
            return [whole] if whole is not None else self.tokens(self.extend(data, []))
        if len(self._last) > SHARED_PREFIXES:
            self._last.clear()
        out = []
        while data:
            out.append(self.last_of(data))
            data = data[: -len(self.bytes_of[out[-1]])]
        return out[::-1]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class PrefixTable:
    """The table of one piece of bytes, for exact appends and edits."""

    def __init__(self, encoder: PrefixEncoder, data: bytes = b""):
        self.encoder, self.data, self.last = encoder, data, encoder.extend(data, [])

    def append(self, more: bytes) -> None:
        self.data += more
        self.encoder.extend(self.data, self.last)

    def edit(self, start: int, end: int, new: bytes) -> int:
        """Replace data[start:end]; returns how many prefixes were recomputed.

        Behind the edit, once as many tokens in a row as the longest token has
        bytes equal those of the old table, all further ones do.
        """
        old_last, shift = self.last, len(new) - (end - start)
        self.data = self.data[:start] + new + self.data[end:]
        self.last, same = old_last[:start], 0
        for i in range(start + 1, len(self.data) + 1):
            self.last.append(self.encoder.last_token(self.data, self.last, i))
            before = i - shift
            same = same + 1 if before > end and old_last[before - 1] == self.last[-1] else 0
            if same > self.encoder.longest:
                self.last += old_last[before:]
                return i - start
        return len(self.data) - start

    def tokens(self) -> list[int]:
        return self.encoder.tokens(self.last)


class TextEncoder:
    """Whole texts: each match of the pattern is encoded on its own."""

    #: A white-space character before a space: then a space doesn't surely start a piece.
    UNSURE = re.compile(r"\s ")

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.encoder = PrefixEncoder(ranks)
        self.find = regex.compile(pattern).findall
        self.pieces = TwoGenerations(self._piece, 200_000)
        self.chunks = TwoGenerations(self._chunk, 200_000)

    def _piece(self, piece: str) -> bytes:
        ids = self.encoder.encode(piece.encode("utf-8"))
        return struct.pack(f"<{len(ids)}I", *ids)

    def _chunk(self, chunk: str) -> bytes:
        if chunk[1:].isalpha() and chunk[0] == " ":  # the pattern would find just that
            return self.pieces[chunk]
        return b"".join([self.pieces[p] for p in self.find(chunk)])

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers.

        A space behind a character that isn't white space always starts a
        piece, so the text may be cut there and the parts looked up.
        """
        if self.UNSURE.search(text):
            parts = re.split(r"(?<=\S)(?= )", text)
        else:
            head, *rest = text.split(" ")
            parts = [head, *[" " + x for x in rest]]
        return b"".join(map(self.chunks.__getitem__, parts))

    def decode(self, ids: bytes) -> bytes:
        return self.encoder.decode(np.frombuffer(ids, "<u4").tolist())


@lru_cache(2)
def text_encoder(path: str, pattern: str) -> TextEncoder:
    return TextEncoder(load_ranks(path), pattern)


def bpe_round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode each text: id, n_tokens, digests of ids and bytes; no shuffle."""

    def make():
        coder = text_encoder(path, pattern)

        def row(r):
            ids = coder.encode(r[text_col] or "")
            back = coder.decode(ids)
            return [(r[id_col], len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest())]

        return row

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(
        docs, make, [id_col, text_col], f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN
    return bpe_round_trip(table(spark, sf_dir, "documents"), path, pattern)
