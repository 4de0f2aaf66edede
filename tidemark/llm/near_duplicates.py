"""Versions of one article: near-duplicate texts found by an inverted join over signature coordinates.

Stages
1. ``shingled``    every text becomes the set of its word sequences (WORDS words, lower case, no punctuation), hashed to 32 bits,
                   and a print of the whole sequence. Texts with equal prints collapse to their least id.
2. ``signed``      minimum hashes over all shingles of a text: POSTS posting values of HASHES minima each, and COORDINATES single
                   minima, of which two bits each make its collision print (128 bits).
3. ``candidates``  a text is posted under each of its values; one shuffle brings a value's texts together, in order. Values that
                   one text has are skipped. Every two texts of a list have their colliding coordinates counted on the prints, in
                   blocks, and pairs that reach the match threshold are kept. Lists of more than LONG texts are counted alike, and
                   set aside where most of their pairs match (many versions of one story); values that more than BLOCK texts are
                   expected to have, by a sample, are set aside before the shuffle, so that no task holds such a list.
4. ``verified``    Jaccard similarity of the shingle sets: on 16-bit prints of the shingles, and on the shingles themselves where
                   that lies within MARGIN of the threshold or a set has more than WIDE prints, which then coincide too often.
5. ``components``  connected components by alternating large and small stars, each round written to the shared folder.
6. ``connected``   the lists set aside: their texts outside the list's largest component meet a text of it and one of their own, in
                   rounds, and in the end every two texts of such a list that aren't connected yet have their collisions counted,
                   in blocks. So every two texts under one value are counted or were connected already.

Defined results: null and empty texts and texts of fewer than WORDS words are in no group; exact copies are of one group; ids must
be unique; ties between representatives go to the least id; an empty table gives no rows.

Sets of Jaccard similarity s share a posting value with probability 1 - (1 - s**HASHES)**POSTS: 0.96 at 0.5, 0.99 at 0.55, 0.999 at
0.6; the match threshold keeps 0.999 of those at 0.5. No shingle is left out, however many texts hold it: where texts are put
together from the same phrases, single minima coincide for millions of unrelated pairs, four at once hardly ever do.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import broadcast_if_small, written

WORDS, THRESHOLD = 3, 0.5
#: Posting values a text, minima each; single-minimum coordinates on which collisions are counted.
POSTS, HASHES, COORDINATES = 50, 4, 64
#: How many standard deviations below the expected collisions of a pair at the threshold the match threshold lies.
DEVIATIONS = 3.1
#: Longer lists may be set aside (LONG), when so many times as many pairs match as they have texts (DENSE); at most so many texts of
#: a list are held and counted in a task (BLOCK).
LONG, DENSE, BLOCK = 200, 10, 10_000
#: Texts sampled to find the values of very long lists, and the least of them under such a value.
SAMPLE_TEXTS, SAMPLE_HITS = 20_000, 8
MARGIN, WIDE, ROUNDS = 0.02, 2_000, 12
#: Rounds of stars, which grow with the logarithm of the largest component's diameter.
MOST_ROUNDS = 200
#: Comparisons a posting of a list set aside, at most, for which the rounds before the comparison of all that is left are spared.
FEW = 50

_WORD = re.compile(r"[^\W_]+")
_RANDOM = np.random.default_rng(20240229)
_FACTORS = _RANDOM.integers(1, 1 << 32, size=POSTS * HASHES, dtype=np.uint32) | np.uint32(1)
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
#: ``grams`` holds a text's sorted distinct shingles as 32-bit integers.
GRAMS = "id bigint, print bigint, grams binary"
SIGNED = "id bigint, values array<bigint>, p bigint, q bigint"


class _Words(dict):
    """Word -> 32-bit hash, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        h = self[word] = zlib.crc32(word.encode("utf-8", "replace"))
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingle_sets(tokens: np.ndarray, counts: np.ndarray, size: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct 32-bit shingles of all texts in a row, their count by text, a 63-bit print of each text's token sequence) of
    texts whose word hashes follow each other in ``tokens``. Texts of fewer words than a shingle have none."""
    n = len(counts)
    owner = np.repeat(np.arange(n, dtype=np.uint64), counts)
    h = tokens.astype(np.uint64)
    with np.errstate(over="ignore"):
        place = np.arange(len(h), dtype=np.uint64) - np.repeat((np.cumsum(counts) - counts).astype(np.uint64), counts)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(h * _A + _mix(place * _B + _C)), dtype=np.uint64)])
        ends = np.cumsum(counts)
        prints = _mix(total[ends] - total[ends - counts] + counts.astype(np.uint64) * _C) >> np.uint64(1)
        if len(h) < size:
            return np.empty(0, np.uint32), np.zeros(n, np.int64), prints.view(np.int64)
        x = h[: len(h) - size + 1]
        for k in range(1, size):
            x = _mix(x * _A + h[k : len(h) - size + 1 + k] * _B + _C)
        whole = owner[: len(x)] == owner[size - 1 :]
        both = (owner[: len(x)][whole] << np.uint64(32)) | (x[whole] & np.uint64(0xFFFFFFFF))
        both.sort()
        both = both[np.concatenate([np.ones(min(1, len(both)), bool), both[1:] != both[:-1]])]
    return (both & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.bincount((both >> np.uint64(32)).astype(np.int64), minlength=n), prints.view(np.int64)


def gram_batch(ids: np.ndarray, tokens: np.ndarray, counts: np.ndarray, size: int = WORDS) -> tuple[pa.RecordBatch, np.ndarray]:
    """A batch of GRAMS for the texts that have a shingle, and which of the texts those are."""
    grams, sizes, prints = shingle_sets(tokens, counts, size)
    has = sizes > 0
    return pa.RecordBatch.from_arrays([pa.array(ids[has]), pa.array(prints[has]), _packed(grams, sizes[has])], names=["id", "print", "grams"]), has


def _packed(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary column of each row's values."""
    ends = np.concatenate([[0], np.cumsum(counts * values.itemsize)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])


def shingled(texts: DataFrame, size: int = WORDS) -> DataFrame:
    """(id, print, grams) of each text of (id bigint, text string) that has a shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            found = [_WORD.findall(t.lower()) if t else () for t in batch.column(1).to_pylist()]
            counts = np.array([len(f) for f in found], dtype=np.int64)
            tokens = np.fromiter((words[w] for f in found for w in f), dtype=np.uint32, count=int(counts.sum()))
            yield gram_batch(batch.column(0).to_numpy(zero_copy_only=False), tokens, counts, size)[0]

    return written(texts.where("text is not null").select(F.col("id").cast("bigint"), "text").mapInArrow(run, GRAMS), "shingles")


def _flat(batch: pa.RecordBatch, name: str, kind: type = np.uint32) -> tuple[np.ndarray, np.ndarray]:
    """The values of a packed column in a row, and their count by row."""
    parts = batch.column(batch.schema.get_field_index(name)).to_pylist()
    return np.frombuffer(b"".join(parts), kind), np.array([len(p) for p in parts], np.int64) // np.dtype(kind).itemsize


def signatures(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """POSTS 64-bit values a text, and its two words of collision prints, of texts whose shingles follow each other."""
    starts = np.cumsum(counts) - counts
    least, buffer = np.empty((len(_FACTORS), len(counts)), np.uint32), np.empty_like(grams)
    for k, a in enumerate(_FACTORS):  # shingles are hashes, so that a multiplication orders them well enough
        least[k] = np.minimum.reduceat(np.multiply(grams, a, out=buffer), starts)
    values, prints = np.empty((len(counts), POSTS), np.uint64), np.zeros((len(counts), 2), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(POSTS):
            x = np.full(len(counts), k, np.uint64)
            for part in least[HASHES * k : HASHES * (k + 1)]:
                x = _mix((x ^ part) * _A + _C)
            values[:, k] = x
        for k in range(COORDINATES):
            two = (least[k * len(least) // COORDINATES] * np.uint32(0x9E3779B1)) >> np.uint32(30)
            prints[:, k % 2] |= two.astype(np.uint64) << np.uint64(2 * (k // 2))
    return values.view(np.int64), prints.view(np.int64)


def signed(grams: DataFrame) -> DataFrame:
    """SIGNED: the posting values and the collision prints of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values, prints = signatures(*_flat(batch, "grams"))
                ends = pa.array(np.arange(0, values.size + 1, POSTS), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(values.ravel())), *(pa.array(np.ascontiguousarray(prints[:, k])) for k in (0, 1))], names=["id", "values", "p", "q"])

    return grams.select("id", "grams").mapInArrow(run, SIGNED)


def match_threshold(threshold: float) -> int:
    """Colliding coordinates, of COORDINATES, from which a pair is retained: two bits of unequal minima agree one time in four."""
    p = threshold + (1 - threshold) / 4
    return int(COORDINATES * p - DEVIATIONS * (COORDINATES * p * (1 - p)) ** 0.5)


_ODD = np.uint64(0x5555555555555555)


def _collide(p: np.ndarray, q: np.ndarray, x: np.ndarray | slice, y: np.ndarray | slice, least: int) -> np.ndarray:
    """Whether the prints ``x`` and ``y`` of (p, q) agree in ``least`` coordinates; slices are broadcast against each other."""
    apart = np.uint8(0)
    for words in (p, q):
        d = words[x] ^ words[y]
        apart = apart + np.bitwise_count((d | (d >> np.uint64(1))) & _ODD)
    return apart <= COORDINATES - least


def _list_pairs(ids: np.ndarray, p: np.ndarray, q: np.ndarray, least: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Every pair of one list that matches, counted in blocks."""
    out = []
    for k in range(0, len(ids), 256):
        rows = np.arange(k, min(k + 256, len(ids)))[:, None]
        i, j = np.nonzero(_collide(p, q, rows, np.arange(k, len(ids))[None, :], least))
        later = j > i
        out.append((ids[k + i[later]], ids[k + j[later]]))
    return out


def _merge(batches: Iterator[pa.RecordBatch], least: int, long: int, block: int) -> Iterator[pa.RecordBatch]:
    """Postings (value, id, p, q) in order of value to rows (value, a, b, p, q): pairs (a, b) that match, of no value, and postings
    (b null) of lists that are set aside."""
    none = np.empty(0, np.int64)

    def pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        gone = pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([gone, pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), gone, gone], names=["value", "a", "b", "p", "q"])

    def aside(value: np.ndarray, ids: np.ndarray, p: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(value), pa.array(ids), pa.nulls(len(ids), pa.int64()), pa.array(p.view(np.int64)), pa.array(q.view(np.int64))], names=["value", "a", "b", "p", "q"])

    def done(value: np.ndarray, ids: np.ndarray, p: np.ndarray, q: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The rows of whole lists."""
        heads = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]])) if len(value) else none
        sizes = np.diff(np.append(heads, len(value)))
        for h, n in zip(heads[sizes > long], sizes[sizes > long], strict=True):
            own = slice(h, h + n)
            found = _list_pairs(ids[own], p[own], q[own], least)
            if sum(len(a) for a, _ in found) > DENSE * n:
                yield aside(value[own], ids[own], p[own], q[own])
            else:
                yield pairs(np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found]))
        at, gap = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= long), sizes)), 1
        while len(at):  # every posting meets the one ``gap`` places further on in its list
            at = at[at + gap < len(value)]
            at = at[value[at] == value[at + gap]]
            good = at[_collide(p, q, at, at + gap, least)]
            if len(good):
                yield pairs(ids[good], ids[good + gap])
            gap += 1

    held: list[tuple[np.ndarray, ...]] = []
    streamed: int | None = None  # the value of a list that is too long to be held
    for batch in batches:
        cols = tuple(batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
        if not batch.num_rows:
            continue
        cols = (cols[0], cols[1], cols[2].view(np.uint64), cols[3].view(np.uint64))
        if streamed is not None:
            same = int(np.searchsorted(cols[0], streamed, "right"))
            if same:
                yield aside(*(c[:same] for c in cols))
            cols = tuple(c[same:] for c in cols)
            if not len(cols[0]):
                continue
            streamed = None
        held.append(cols)
        if sum(len(h[0]) for h in held) < 2 * block:
            continue
        whole = tuple(np.concatenate(c) for c in zip(*held, strict=True))
        cut = int(np.searchsorted(whole[0], whole[0][-1]))  # the last list may go on
        yield from done(*(c[:cut] for c in whole))
        held = [tuple(c[cut:] for c in whole)]
        if len(held[0][0]) > block:
            yield aside(*held[0])
            held, streamed = [], int(whole[0][-1])
    if held:
        yield from done(*(np.concatenate(c) for c in zip(*held, strict=True)))


def _hot(signs: DataFrame, block: int) -> DataFrame | None:
    """(value) of the lists that will have more than ``block`` texts, by a sample of bounded size; None if there are none."""
    rate = min(1.0, SAMPLE_TEXTS / max(signs.count(), 1))
    drawn = signs if rate == 1.0 else signs.where(F.pmod(F.xxhash64("id", F.lit(91)), F.lit(1 << 30)) < int(rate * (1 << 30)))
    hot = written(drawn.select(F.explode("values").alias("value")).groupBy("value").count().where(F.col("count") >= max(SAMPLE_HITS, int(rate * block))).select("value"), "hot")
    return F.broadcast(hot) if hot.limit(1).count() else None  # at most SAMPLE_TEXTS * POSTS / SAMPLE_HITS


def candidates(signs: DataFrame, long: int = LONG, threshold: float = THRESHOLD, block: int = BLOCK) -> tuple[DataFrame, DataFrame | None]:
    """(a, b) pairs of texts, a < b, of one list that reach the match threshold; and (value, id, p, q, size) of the lists set aside,
    if there are any."""
    least = match_threshold(threshold)
    posts = signs.select(F.explode("values").alias("value"), "id", "p", "q")
    hot = _hot(signs, block)
    cold = posts if hot is None else posts.join(hot, "value", "left_anti")
    met = cold.repartition("value").sortWithinPartitions("value").mapInArrow(lambda batches: _merge(batches, least, long, block), "value bigint, a bigint, b bigint, p bigint, q bigint")
    met = written(met, "met")
    lists = met.where("b is null").select("value", F.col("a").alias("id"), "p", "q")
    if hot is not None:
        lists = lists.union(posts.join(hot, "value", "left_semi").select("value", "id", "p", "q"))
    elif not lists.limit(1).count():
        lists = None
    if lists is not None:
        sizes = written(lists.groupBy("value").agg(F.count("*").alias("size")), "sizes")
        lists = written(lists.join(broadcast_if_small(sizes), "value"), "lists")
    return met.where("b is not null").select("a", "b").distinct(), lists


def _similar(pairs: DataFrame, kind: type) -> DataFrame:
    """(a, b, near, size): the Jaccard similarity of the packed sets ``pa`` and ``pb``, and the size of the larger one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            (x, nx), (y, ny) = _flat(batch, "pa", kind), _flat(batch, "pb", kind)
            rows = np.arange(batch.num_rows, dtype=np.uint64) << np.uint64(32)
            both = np.concatenate([np.repeat(rows, nx) | x, np.repeat(rows, ny) | y])
            both.sort()
            twice = both[1:][both[1:] == both[:-1]] >> np.uint64(32)
            shared = np.bincount(twice.astype(np.int64), minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared / np.maximum(nx + ny - shared, 1)), pa.array(np.maximum(nx, ny))], names=["a", "b", "near", "size"])

    return pairs.select("a", "b", "pa", "pb").mapInArrow(run, "a bigint, b bigint, near double, size bigint")


def id_filter(ids: DataFrame, most_bits: int = 1 << 27) -> tuple[int, np.ndarray]:
    """A Bloom filter of the ids, of bounded size: (its size in bits, its bytes)."""
    n = ids.count()
    bits = 1 << max(13, min(most_bits.bit_length() - 1, (16 * max(n, 1)).bit_length()))
    places = F.explode(F.array(*[F.pmod(F.xxhash64("id", F.lit(k)), F.lit(bits)) for k in range(3)])).alias("place")
    words = ids.select(places).select((F.col("place") / 32).cast("int").alias("word"), F.expr("shiftleft(1, cast(pmod(place, 32) as int))").alias("bit"))
    out = np.zeros(bits // 32, np.int32)
    for r in words.groupBy("word").agg(F.bit_or("bit").alias("bit")).toLocalIterator():  # at most most_bits / 32
        out[r[0]] = r[1]
    return bits, out


def _sets_of(grams: DataFrame, ids: DataFrame, kind: type) -> DataFrame:
    """(id, p): the shingle sets, cut to the width of ``kind``, of the texts whose id is one of ``ids``, and of a few others; this
    keeps the wide rows of all other texts out of the shuffle that follows."""
    bits, words = id_filter(ids)
    shared = grams.sparkSession.sparkContext.broadcast(words)
    most = np.uint32(np.iinfo(kind).max)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for k in range(3):
                p = batch.column(2 + k).to_numpy(zero_copy_only=False)
                keep &= (known[p >> 5] >> (p & 31)) & 1 != 0
            batch = batch.filter(pa.array(keep))
            sets = [np.unique(np.frombuffer(g, np.uint32) & most).astype(kind) for g in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), _packed(np.concatenate(sets) if sets else np.empty(0, kind), np.array([len(x) for x in sets], np.int64))], names=["id", "p"])

    return grams.select("id", "grams", *[F.pmod(F.xxhash64("id", F.lit(k)), F.lit(bits)).alias(f"__p{k}") for k in range(3)]).mapInArrow(run, "id bigint, p binary")


def _compared(pairs: DataFrame, grams: DataFrame, kind: type) -> DataFrame:
    used = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    sets = _sets_of(grams, used, kind)
    return _similar(pairs.join(sets.select(F.col("id").alias("a"), F.col("p").alias("pa")), "a").join(sets.select(F.col("id").alias("b"), F.col("p").alias("pb")), "b"), kind)


def verified(pairs: DataFrame, grams: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs whose shingle sets are similar."""
    wide = F.col("size") > WIDE
    x = written(_compared(written(pairs, "pairs"), grams, np.uint16).where(wide | (F.col("near") >= threshold - MARGIN)), "near")
    sure, doubt = x.where(~wide & (F.col("near") >= threshold + MARGIN)), x.where(wide | (F.col("near") < threshold + MARGIN)).select("a", "b")
    if not doubt.limit(1).count():
        return sure.select("a", "b")
    return sure.select("a", "b").union(_compared(doubt, grams, np.uint32).where(F.col("near") >= threshold).select("a", "b"))


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the least id that each end of an edge is connected with."""
    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    state = None
    for _ in range(MOST_ROUNDS):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        before, edges = edges, written(small, "stars")
        seen = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("bigint"))).first()
        if seen == state and not edges.join(before, ["u", "v"], "left_anti").limit(1).count():
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        state = seen
    raise RuntimeError("components did not settle")


def _match(x: str, y: str, least: int) -> Column:
    """Whether the prints of the structs ``x`` and ``y`` agree in ``least`` coordinates."""
    apart = F.lit(0)
    for c in ("p", "q"):
        d = F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}"))
        apart = apart + F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseAND(F.lit(int(_ODD))))
    return apart <= COORDINATES - least


def connected(edges: DataFrame, lists: DataFrame | None, grams: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(id, component) by ``edges`` and by every similar pair of the lists set aside (value, id, p, q, size)."""
    found = components(edges)
    if lists is None:
        return found
    least = match_threshold(threshold)
    posts = lists.count()
    for k in range(ROUNDS + 1):
        named = lists.join(found.withColumnRenamed("component", "c"), "id", "left").select("value", F.struct("id", "p", "q").alias("x"), "size", F.coalesce("c", "id").alias("c"))
        named = written(named, "named")
        drawn = F.xxhash64("x.id", F.lit(k))
        parts = named.groupBy("value", "c").agg(F.count("*").alias("n"), F.min_by("x", drawn).alias("centre"), F.min(drawn).alias("drawn"))
        main = parts.groupBy("value").agg(F.count("*").alias("parts"), F.max_by(F.struct("c", "centre"), F.struct("n", "c")).alias("m"))
        main = written(main.where("parts > 1").select("value", F.col("m.c").alias("main"), F.col("m.centre").alias("centre")), "main")
        others = named.join(broadcast_if_small(main), "value").where("c <> main")
        left = others.agg(F.sum("size")).first()[0]
        if left is None:  # all lists are connected
            return found
        last = k == ROUNDS or left <= FEW * posts
        if not last:
            own = parts.select("value", "c", F.col("centre").alias("pivot"), "drawn").join(broadcast_if_small(main.select("value", "main")), "value").where("c <> main")
            own = written(own.groupBy("value").agg(F.min_by("pivot", "drawn").alias("pivot")), "pivots")
            met = others.join(broadcast_if_small(own), "value").select("x", F.explode(F.array("centre", "pivot")).alias("y")).where(_match("x", "y", least))
            new = verified(met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).where("a < b").distinct(), grams, threshold)
            new = written(new, "joined")
            last = not new.limit(1).count()
        if last:
            blocks = F.ceil(F.col("size") / LONG).cast("int")
            outside = others.select("value", "x", F.col("c").alias("cx"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
            every = named.join(broadcast_if_small(main.select("value")), "value", "left_semi").select("value", F.col("x").alias("y"), F.col("c").alias("cy"), F.pmod(F.xxhash64("x.id"), blocks).cast("int").alias("block"))
            pairs = outside.join(every, ["value", "block"]).where("cx <> cy").where(_match("x", "y", least)).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
            new = verified(pairs, grams, threshold)
        found = components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).union(new))
        if last:
            return found


def groups_of(grams: DataFrame, threshold: float = THRESHOLD, without: DataFrame | None = None) -> DataFrame:
    """(id, group) of every group of two or more of the written table (id, print, grams), the group named by its least id;
    the ids of ``without`` take no part."""
    ids = grams.select("id", "print") if without is None else grams.select("id", "print").join(without, "id", "left_anti")
    copies = ids.groupBy("print").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    members = written(ids.join(copies, "print").select("id", "rep", "n"), "copies")
    signs = signed(grams).join(members.where("id = rep").select("id"), "id", "left_semi")
    met, lists = candidates(written(signs, "signatures"), threshold=threshold)
    found = connected(verified(met, grams, threshold), lists, grams, threshold)
    x = members.join(found.select(F.col("id").alias("rep"), "component"), "rep", "left")
    return x.where(F.col("component").isNotNull() | (F.col("n") > 1)).select("id", F.coalesce("component", "rep").alias("group"))


def groups(texts: DataFrame, threshold: float = THRESHOLD, size: int = WORDS) -> DataFrame:
    """(id, group): the members of every group of two or more versions of one text of (id, text)."""
    return groups_of(shingled(texts, size), threshold)


def pairs(members: DataFrame) -> DataFrame:
    """(a, b), a < b, of every two members of one group."""
    return members.select("group", F.col("id").alias("a")).join(members.select("group", F.col("id").alias("b")), "group").where("a < b").select("a", "b")
