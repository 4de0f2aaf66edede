"""Encoding of a corpus by a byte-level BPE vocabulary, exact and in linear time.

The text is split by the vocabulary's published pattern. Each piece is encoded by backtracking: an Aho-Corasick automaton over
all tokens gives the longest token that starts at every byte; tokens are taken greedily, and a token is kept only when the pair
(previous, it) is one that the merges would leave alone (compatibility, derived from the merge order). Where no shorter prefix
of the token is compatible either, the previous token is taken back and its end is barred, so no state is visited twice.
Pieces repeat, so each worker keeps a bounded memo of encoded pieces. Decoding is a lookup in an offset table over one byte string.

Defined results: null and empty texts give an empty list; no normalisation; special tokens in a text are ordinary text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the public vocabulary files are, unless a caller says otherwise.
VOCABULARY_DIR = "/opt/tokenizers"
#: The published split pattern of the byte-level vocabularies (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces that a worker remembers; the memo starts anew when it is full, and longer pieces are never kept.
MEMO_PIECES, MEMO_BYTES = 200_000, 64
#: Pairs of tokens whose compatibility a worker remembers.
PAIRS = 2_000_000


def read_ranks(data: bytes) -> list[bytes]:
    """The tokens of a rank file by id."""
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    out = [b""] * len(ranks)
    for token, k in ranks.items():
        out[k] = token
    return out


class Encoder:
    """Exact byte-pair encoding over ``tokens`` (by id, in merge order)."""

    def __init__(self, tokens: list[bytes], pattern: str = PATTERN):
        self.tokens, self.split = tokens, regex.compile(pattern)
        self.id = {t: k for k, t in enumerate(tokens) if t}
        self.length = [len(t) for t in tokens]
        machine = ahocorasick.Automaton()
        for t, k in self.id.items():
            machine.add_word(t.decode("latin-1"), k)
        machine.make_automaton()
        self.machine = machine
        self.shorter = [self._prefix(t) for t in tokens]
        self.halves: list[tuple[int, int]] = [(k, k) for k in range(len(tokens))]
        self.merged: dict[tuple[int, int], int] = {}
        for k, t in enumerate(tokens):
            if len(t) > 1:
                self._split(k, t)
        self.memo: dict[str, list[int]] = {}
        self.pairs: dict[int, bool] = {}
        self.ends = np.cumsum([len(t) for t in tokens])
        self.flat = b"".join(tokens)

    def _prefix(self, t: bytes) -> int:
        for n in range(len(t) - 1, 0, -1):
            if (k := self.id.get(t[:n])) is not None:
                return k
        return -1

    def _split(self, k: int, t: bytes) -> None:
        """The two tokens whose merge made ``k``: both are older than ``k`` and stay apart until that merge."""
        for n in range(1, len(t)):
            a, b = self.id.get(t[:n]), self.id.get(t[n:])
            if a is not None and b is not None and a < k and b < k and (a, b) not in self.merged and self._apart(a, b):
                self.halves[k] = (a, b)
                self.merged[a, b] = k
                return

    def _compatible(self, a: int, b: int) -> bool:
        """:meth:`_apart` by a table of the pairs met so far, of bounded size."""
        key = a << 32 | b
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = self._apart(a, b)
        return found

    def _apart(self, a: int, b: int) -> bool:
        """Whether merging the bytes of tokens ``a`` and ``b`` side by side leaves the border between them: no merge across it
        may come due before the merges that build the two sides have hidden it."""
        left, right, due = a, b, len(self.tokens)
        while True:
            if self.merged.get((left, right), due) < due:
                return False
            newer_left = left > right
            for side in (newer_left, not newer_left):  # undo the newer side's last merge; where it is a byte, the other's
                if side:
                    due, half = left, self.halves[left][1]
                    if half != left:
                        left = half
                        break
                else:
                    due, half = right + 1, self.halves[right][0]
                    if half != right:
                        right = half
                        break
            else:
                return True

    def piece(self, text: str) -> list[int]:
        found = self.memo.get(text)
        if found is None:
            data = text.encode("utf-8", "replace")
            found = self._encode(data.decode("latin-1"))
            if len(data) <= MEMO_BYTES:
                if len(self.memo) >= MEMO_PIECES:
                    self.memo.clear()
                self.memo[text] = found
        return found

    def _encode(self, data: str) -> list[int]:
        n = len(data)
        longest, size = [-1] * n, self.length
        for end, k in self._matches(data):
            start = end - size[k] + 1
            if longest[start] < 0 or size[k] > size[longest[start]]:
                longest[start] = k
        open_end, out, at = bytearray(b"\x01") * (n + 1), [], 0
        token = longest[0] if n else -1
        while at < n:
            while token >= 0 and not (open_end[at + size[token]] and (not out or self._compatible(out[-1], token))):
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                at += size[token]
                token = longest[at] if at < n else -1
            else:
                open_end[at] = 0
                token = out.pop()
                at -= size[token]
        return out

    def _matches(self, data: str) -> Iterator[tuple[int, int]]:
        return self.machine.iter(data)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        for m in self.split.finditer(text):
            out += self.piece(m.group())
        return out

    def decode(self, ids: list[int]) -> str:
        ends, flat = self.ends, self.flat
        return b"".join(flat[ends[k] - len(self.tokens[k]) : ends[k]] for k in ids).decode("utf-8", "replace")


@cache
def encoder(data: bytes) -> Encoder:
    """One encoder a worker and rank file."""
    return Encoder(read_ranks(data))


def encode(df: DataFrame, text: str = "text", ids: str = "ids", vocabulary: str = f"{VOCABULARY_DIR}/byte_bpe_50k.tiktoken") -> DataFrame:
    """Replace ``text`` by ``ids``, an array of token ids. A narrow map: no shuffle, rows stay where they are.

    Every other column is kept as it is; an existing column named ``ids`` gives way.
    """
    rest = [c for c in df.columns if c not in (text, ids)]
    schema = T.StructType([df.schema[c] for c in rest] + [T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)])
    place = len(rest)
    ranks = df.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())  # one file of fixed size, under 1 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(ranks.value)
        for batch in batches:
            values, offsets = [], [0]
            for t in batch.column(place).to_pylist():
                values += own.encode(t)
                offsets.append(len(values))
            column = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:place], column], names=[*batch.schema.names[:place], ids])

    return df.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`")).mapInArrow(run, schema)
