"""Evaluation passages inside corpus texts, whole or in part and not letter for letter.

Texts are reduced to their letters and digits in lower case, so case, spacing, punctuation and line breaks don't matter; markup is
cut first. By the q-gram lemma two strings within an edit budget still share a number of q-grams on nearby diagonals:
  1. The q-grams of every passage are indexed by hash. The set of passages is a small table of fixed size, counted before it is
     shipped to the tasks; past PASSAGES of them it is split into parts, each searched on its own.
  2. Every text position whose q-gram the index knows gives (passage, diagonal). Hits are counted in diagonal bands of width BAND
     that overlap by half. A region is kept when its count reaches the bound of the lemma for the shortest stretch that counts
     (STRETCH words) with one word in EDIT_EVERY changed.
  3. A kept region is verified by alignment within the band: all diagonals of the band are compared letter by letter, their exact
     runs of RUN or more are chained where one word between them was changed, added or dropped. A chain counts when it spans
     STRETCH words of the passage, or all of it but one, and FAR words a run on average; every chain is tested, from each run on,
     so what precedes a stretch doesn't matter.
Passages of fewer than SHORT_WORDS words have too few q-grams for that: they are looked up whole, as a sequence of words.

Defined results: null and empty texts and passages match nothing; a text and passage are reported once however often they match;
a passage shorter than STRETCH words counts when it is held whole (from SHORT_WORDS words on, but for one word at its ends); texts
are searched whole; repeated rows are found alike. Of a stretch, words changed at its very ends don't count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: q-gram length in characters, width of a diagonal band, words of a stretch, and at most one changed word in so many.
Q, BAND, STRETCH, EDIT_EVERY = 12, 64, 25, 10
#: Shortest exact run, and how far two runs may overlap or lie apart (one changed, added or dropped word), in characters.
RUN, GAP = 6, 30
#: Share of a chain's characters that must match, and words a run of it must have on average: the edits are single and far apart.
MATCHED, FAR = 0.8, 7
#: Passages of fewer words are looked up whole.
SHORT_WORDS = 10
#: Passages shipped to the tasks at once.
PASSAGES = 20_000

_MARKUP = re.compile(r"<[^<>\n]{1,80}>|&(?:[a-z]{2,8}|#\d{1,6});")
_PIECE = re.compile(r"[^\W_]+")
_BITS = 22
#: What makes a diagonal positive, and the bits of its band; neither texts nor passages are that long.
_OFFSET, _BAND_BITS = 1 << 36, 36
_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def pieces_of(text: str) -> list[str]:
    """The words of a text without markup, each reduced to its letters and digits in lower case."""
    return [p for w in _MARKUP.sub(" ", text).lower().split() if (p := "".join(_PIECE.findall(w)))]


def reduce(text: str) -> str:
    """Letters and digits only, in lower case, without markup."""
    return "".join(_PIECE.findall(_MARKUP.sub(" ", text).lower()))


def letters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def codes(text: str) -> np.ndarray:
    """A 64-bit hash of every q-gram of a reduced text, by position."""
    x = letters(text).astype(np.uint64)
    n = len(x) - Q + 1
    if n < 1:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for k in range(Q):
            out = out * _P1 + x[k : k + n]
        out = (out ^ (out >> np.uint64(31))) * _P2
        return out ^ (out >> np.uint64(29))


@dataclass
class Index:
    """Passages by q-gram."""

    ids: np.ndarray
    texts: list[str]
    starts: list[np.ndarray]
    codes: np.ndarray
    first: np.ndarray
    passage: np.ndarray
    place: np.ndarray
    known: np.ndarray
    least: np.ndarray
    short: dict[str, list[int]]


def index(rows: list[tuple[int, str]]) -> Index:
    """The index of (id, text) passages."""
    ids, texts, starts, all_codes, owners, places, least, short = [], [], [], [], [], [], [], {}
    for i, text in rows:
        pieces = pieces_of(text or "")
        flat = "".join(pieces)
        c = codes(flat)
        if len(pieces) < SHORT_WORDS or not len(c):
            if pieces:
                short.setdefault(" ".join(_PIECE.findall(_MARKUP.sub(" ", text).lower())), []).append(i)
            continue
        sizes = np.array([len(p) for p in pieces])
        at = np.concatenate([[0], np.cumsum(sizes)])
        span = min(STRETCH, len(pieces))
        # the lemma: of length - Q + 1 q-grams each changed word costs those that touch it; the least over all stretches
        edits = span // EDIT_EVERY
        costly = np.sort(np.lib.stride_tricks.sliding_window_view(sizes, span), axis=1)[:, span - edits :].sum(axis=1)
        least.append(max(Q, int((at[span:] - at[: len(at) - span] - costly).min()) - (Q - 1) * (edits + 1)))
        all_codes.append(c)
        owners.append(np.full(len(c), len(ids)))
        places.append(np.arange(len(c)))
        ids.append(i)
        texts.append(flat)
        starts.append(at)
    known = np.zeros(1 << _BITS, bool)
    if not ids:
        return Index(np.empty(0, np.int64), [], [], *(np.empty(0, np.uint64) for _ in range(2)), *(np.empty(0, np.int64) for _ in range(2)), known, np.empty(0, np.int64), short)
    c, o, p = np.concatenate(all_codes), np.concatenate(owners), np.concatenate(places)
    order = np.argsort(c, kind="stable")
    c, o, p = c[order], o[order], p[order]
    distinct, first = np.unique(c, return_index=True)
    known[(distinct >> np.uint64(64 - _BITS)).astype(np.int64)] = True
    return Index(np.array(ids, np.int64), texts, starts, distinct, np.append(first, len(c)), o, p, known, np.array(least), short)


def hits(text: str, ix: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, place in the passage, place in the text) of every shared q-gram."""
    c = codes(text)
    at = np.flatnonzero(ix.known[(c >> np.uint64(64 - _BITS)).astype(np.int64)]) if len(c) else np.empty(0, np.int64)
    if not len(at):
        return at, at, at
    k = np.searchsorted(ix.codes, c[at])
    k[k == len(ix.codes)] = 0
    same = ix.codes[k] == c[at]
    at, k = at[same], k[same]
    sizes = ix.first[k + 1] - ix.first[k]
    rows = np.repeat(ix.first[k], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return ix.passage[rows], ix.place[rows], np.repeat(at, sizes)


def regions(passage: np.ndarray, place: np.ndarray, at: np.ndarray, ix: Index) -> list[tuple[int, int, int]]:
    """(passage, lowest diagonal, highest diagonal) of the bands that reach the lemma's bound."""
    if not len(at):
        return []
    diagonal = at - place + _OFFSET
    out = []
    for shift in (0, BAND // 2):
        band = (diagonal + shift) // BAND
        keys, n = np.unique(passage.astype(np.int64) << _BAND_BITS | band, return_counts=True)
        good = n >= ix.least[keys >> _BAND_BITS]
        for key in keys[good]:
            b = int(key & ((1 << _BAND_BITS) - 1)) * BAND - shift - _OFFSET
            out.append((int(key >> _BAND_BITS), b, b + BAND))
    return out


def runs_of(x: np.ndarray, y: np.ndarray, low: int, high: int) -> list[tuple[int, int, int]]:
    """(place in the text ``x``, place in the passage ``y``, length) of the exact runs of RUN or more on the diagonals low..high."""
    width, n = high - low, len(y)
    padded = np.zeros(width + n, np.uint32)  # no letter is 0
    a, z = max(0, low), min(len(x), high + n)
    if z <= a:
        return []
    padded[a - low : z - low] = x[a:z]
    same = np.zeros((width, n + 1), bool)
    same[:, :-1] = np.lib.stride_tricks.sliding_window_view(padded, n)[:width] == y
    flat = same.ravel()
    turn = np.flatnonzero(flat[1:] != flat[:-1]) + 1
    if flat[0]:
        turn = np.concatenate([[0], turn])
    head, tail = turn[::2], turn[1::2]
    long = tail - head >= RUN
    d, place = np.divmod(head[long], n + 1)
    return sorted(zip((d + low + place).tolist(), place.tolist(), (tail - head)[long].tolist(), strict=True))


def touched(starts: np.ndarray, a: int, z: int) -> int:
    """How many words lie in the characters a..z, in part or whole."""
    return 0 if z <= a else int(np.searchsorted(starts, z - 1, "right") - np.searchsorted(starts, a, "right")) + 1


def aligned(passage: int, low: int, high: int, text: np.ndarray, text_starts: np.ndarray, ix: Index) -> bool:
    """Whether the exact runs of a band chain to a stretch of the passage that counts."""
    runs = runs_of(text, letters(ix.texts[passage]), low - BAND // 2, high + BAND // 2)
    starts = ix.starts[passage]
    words = len(starts) - 1
    need = min(STRETCH, words - 1)
    most = max(1, words // FAR)  # longer chains are refused
    chains: list[dict[tuple[int, int], int]] = []  # (place in the passage where a chain began, its runs): most characters matched
    for k, (at, place, n) in enumerate(runs):
        own_chains = {(place, 1): n}
        for (at0, place0, n0), before in zip(reversed(runs[:k]), reversed(chains), strict=True):
            gap_text, gap_passage = at - (at0 + n0), place - (place0 + n0)
            if not (-Q <= gap_text <= GAP and -Q <= gap_passage <= GAP and place > place0 and at > at0):
                continue
            overlap = max(0, -gap_text, -gap_passage)
            cuts = ((0, overlap), (overlap, 0))  # letters that both runs claim belong to either
            if all(touched(starts, place0 + n0 - u, place + v) > 1 or touched(text_starts, at0 + n0 - u, at + v) > 2 for u, v in cuts):
                continue  # more than one word was changed
            for (begin, parts), matched in before.items():
                if parts < most and matched + n - overlap > own_chains.get((begin, parts + 1), 0):
                    own_chains[begin, parts + 1] = matched + n - overlap
        chains.append(own_chains)
        end = place + n
        last = int(np.searchsorted(starts, end, "right")) - 1
        for (begin, parts), matched in own_chains.items():
            # words of the passage that lie in the stretch whole
            inside = last - int(np.searchsorted(starts, begin))
            if inside >= need and matched >= MATCHED * (end - begin) and (parts == 1 or inside >= FAR * parts):
                return True
    return False


def leaked(text: str | None, ix: Index) -> list[int]:
    """The ids of the passages that a text holds."""
    if not text:
        return []
    flat = reduce(text)
    out: set[int] = set()
    some = regions(*hits(flat, ix), ix)
    if some:
        x, starts = letters(flat), np.cumsum([0] + [len(p) for p in pieces_of(text)])
        for passage, low, high in some:
            if passage not in out and aligned(passage, low, high, x, starts, ix):
                out.add(passage)
    found = [int(ix.ids[k]) for k in out]
    if ix.short:
        words = f" {' '.join(_PIECE.findall(_MARKUP.sub(' ', text).lower()))} "
        found += [i for passage, ids in ix.short.items() if f" {passage} " in words for i in ids]
    return sorted(found)


def search(documents: DataFrame, passages: DataFrame) -> DataFrame:
    """(doc_id, item_id) of ``documents`` (doc_id, text) that hold passages of ``passages`` (item_id, text)."""
    spark = documents.sparkSession
    known = passages.where("text is not null and text <> ''").select("item_id", "text")
    n = known.count()
    parts = max(1, -(-n // PASSAGES))
    out = None
    for part in range(parts):
        some = known if parts == 1 else known.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part)
        ix = spark.sparkContext.broadcast(index([tuple(r) for r in some.orderBy("item_id").collect()]))  # about PASSAGES passages

        def run(batches: Iterator[pa.RecordBatch], ix=ix) -> Iterator[pa.RecordBatch]:
            own = ix.value
            for batch in batches:
                ids, items = [], []
                for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    for item in leaked(text, own):
                        ids.append(i)
                        items.append(item)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(items, pa.int64())], names=["doc_id", "item_id"])

        one = documents.where("text is not null").select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, item_id bigint")
        out = one if out is None else out.union(one)
    return out
