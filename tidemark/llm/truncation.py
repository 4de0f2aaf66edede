"""Values cut off inside a word or a sentence.

A value's own text is what the page model leaves of it, without the marks and notices behind its end. A logistic regression over
hashed features of the close (last characters and words, punctuation, open quotes or markup, form of the last line, distance to a
length limit) gives the probability that it was cut. Positives are made by cutting intact values, at random places and at the
limits; negatives are intact values: closed ones, headlines, lists, tables and subheads at their line ends, and unclosed snippets
that are no part of their row's body (titles and summaries). Limits are the lengths that unclosed values pile up at, counted over
all rows. Examples are made of every row, equal ones are counted, and the classifier is fitted on all of them: its loss is convex, so
the weights depend neither on an order nor on how the rows are spread. Every value is scored. The features of values and examples are
made in one pass over the text. Their distinct sets are fitted on the driver when counted below BROADCAST_ROWS, on the tasks otherwise.

Defined results: null, empty and blank values are never cut; a body that holds no article is never cut; repeated rows are scored
alike; ids must be unique; with too few rows to fit (no example of either kind) only the closing punctuation decides.
"""

from __future__ import annotations

import random
import re
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import boilerplate as B
from tidemark.llm.page_lines import CUT_MARK, END_MARK
from tidemark.session import BROADCAST_ROWS, written

#: Hashed features, and the probability from which a value counts as cut.
FEATURES, CUT_FROM = 1 << 14, 0.5
#: Feature sets that a task counts before it hands them on. The fit ends when so many steps lower the loss by less than this share. Its
#: passes over a table run in so many tasks at most, since each hands the driver a gradient.
HELD, STEPS, GAIN, PARTS = 100_000, 5, 5e-3, 128
#: A length is a limit when so many unclosed values have it, and so many times as many as the lengths around it on average.
LIMIT_ROWS, LIMIT_EXCESS, AROUND = 8, 4.0, 10

#: Notices behind the end of a text (fixed values).
_NOTICE = re.compile(r"(?:\s*(?:Read more|More inside|Read on|Continue reading|Read the full story[^.\n]{0,40}|\((?:More details awaited|With inputs from|Edited by|Reporting by)[^()\n]{0,60}\)))+\s*$", re.I)
_INNER = re.compile(r"[.?!।॥][\"'”’»)\]]*\s+(?=[\"“‘A-Z0-9])")
_CLOSERS = "\"'”’»)]"
_MARKUP = re.compile(r"(?:<[^<>]{0,40}|&#?\w{0,6})$")
_ENDS = frozenset(".?!।॥")
#: What a line with a mark of an end at its end has one of, and what the first mark of a cut begins with.
_END_HINTS, _DASH = ("(ends)", "■", "/END", "###", "***", "-30-", "||", ">>", "»"), re.compile(r"[-–—] ?[A-Z]")
_CUT_STARTS = ("...", "…", "[+", "(more)", "\ufffd")
_BULLET = re.compile(r"^(?:[-*•–·▪>]|\(?\d{1,3}[.)])\s+")
_ZEROS = bytes.maketrans(b"123456789", b"000000000")


def _has(text: str, hints: tuple[str, ...]) -> bool:
    for h in hints:
        if h in text:
            return True
    return False


def _closed(line: str) -> bool:
    return line[-1:] in _ENDS or line.rstrip(_CLOSERS)[-1:] in _ENDS


def _without_cut_mark(text: str) -> str:
    """CUT_MARK.sub, which looks from where the first mark may begin."""
    first = min((at for h in _CUT_STARTS if (at := text.find(h)) >= 0), default=-1)
    if first < 0:
        return text
    if first and text[first - 1] == "[":
        first -= 1
    while first and text[first - 1].isspace():
        first -= 1
    m = CUT_MARK.search(text, first)
    return text[: m.start()] if m else text


@lru_cache(maxsize=4096)
def own_end(line: str) -> tuple[str, str]:
    """(the last line without marks and notices, which kinds of them there were)."""
    kinds, text = "", line.rstrip()
    while True:
        if "..." in text or "…" in text or "[+" in text or "(more)" in text or "\ufffd" in text:
            cut = _without_cut_mark(text)
            if cut != text:
                kinds, text = kinds + "c", cut.rstrip()
                continue
        tail = text[-90:].lower()  # the last notice is no longer
        if "read" in tail or "(" in tail or "more inside" in tail:
            cut = _NOTICE.sub("", text)
            if cut != text:
                kinds, text = kinds + "n", cut.rstrip()
                continue
        if not _closed(text) and (_has(text, _END_HINTS) or (("-" in text or "–" in text or "—" in text) and _DASH.search(text))):
            cut = END_MARK.sub("", text).rstrip()
            if cut != text and _closed(cut):  # what looks like an end mark may stand behind no end
                kinds, text = kinds + "e", cut
                continue
        return text, "".join(sorted(set(kinds))) if kinds else ""


def _slot(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "replace")) & (FEATURES - 1)


#: State of the hash behind the names of the slots of last characters and words.
_E, _W = zlib.crc32(b"e"), zlib.crc32(b"w")


@lru_cache(maxsize=65_536)
def _form_slots(closed: str, field: str, kind: str, several: bool, inner: int, base: str, kinds: str, near: str, quotes: bool, markup: bool, bracket: bool) -> array:
    """Slots of what doesn't depend on words; the same few come back."""
    return array("h", [_slot(n) for n in (
        "bias", f"c{closed}", f"f{field}{closed}", f"k{kind}{closed}", f"kf{kind}{closed}{field}{several}", f"l{base}", f"m{kinds}{closed}", f"i{inner}{closed}{field}", f"n{near}{closed}", f"nf{near}{closed}{field}",
        f"q{quotes}{closed}", f"u{markup}", f"p{bracket}{closed}",
    )])


def features(lines: list[str], size: int, limits: list[int], field: str) -> array | None:
    """Hashed feature slots of a value given by its own non-blank lines; None when nothing is left of it. ``limits`` are ascending."""
    return _close(lines[-1], len(lines) > 1, size, limits, field) if lines else None


def _below(limits: list[int], n: int) -> int:
    """How far the next limit is."""
    at = bisect_left(limits, n)
    return limits[at] - n if at < len(limits) else 999


def _close(line: str, more: bool, size: int, limits: list[int], field: str) -> array | None:
    """:func:`features` of the last line of a value, and whether there are others."""
    text, kinds = own_end(line)
    if not text:
        return None
    closed = "C" if _closed(text) else "O"
    last = text[-1]
    kind = "b" if _BULLET.match(text) else "p" if " | " in text else "s" if field == "body" and text.count(" ") < 4 else "t"
    inner = int(more)
    if m := _INNER.search(text):
        inner = 2 if more or _INNER.search(text, m.end()) else 1
    below = _below(limits, size)
    if len(text) < len(line):
        below = min(below, _below(limits, size - len(line) + len(text)))
    near = "0" if below == 0 else "a" if below <= 3 else "b" if below <= 12 else "c" if below <= 25 else "f"
    base = "a" if last.isalpha() else "0" if last.isdigit() else last
    quotes = text.count('"') % 2 or text.count("“") > text.count("”")
    tail = text[-48:]
    markup = ("<" in tail or "&" in tail) and bool(_MARKUP.search(tail)) or "\ufffd" in line[-6:]
    slots = _form_slots(closed, field, kind, inner > 0, inner, base, kinds, near, bool(quotes), markup, "(" in text and text.count("(") > text.count(")"))
    if closed == "C":
        return slots
    crc, most = zlib.crc32, FEATURES - 1
    low = text[-160:].lower()
    words = low.rsplit(None, 3)[-3:]
    if low.isascii():
        tail = low[-4:].encode()
        e2, e3, e4 = tail[-2:], tail[-3:], tail
        w3 = " ".join(words).encode().translate(_ZEROS)
        w1 = w3[-len(words[-1]) :]
        w2 = w3[len(words[0]) + 1 :] if len(words) > 2 else w3
    else:
        e2, e3, e4 = (text[-k:].lower().encode("utf-8", "replace") for k in (2, 3, 4))
        words = [w if w.isalpha() else "".join("0" if c.isdigit() else c for c in w) for w in words]
        w1, w2, w3 = (" ".join(words[-k:]).encode("utf-8", "replace") for k in (1, 2, 3))
    names = [crc(e2, _E) & most, crc(e3, _E) & most, crc(e4, _E) & most, crc(w1, _W) & most, crc(w2, _W) & most, crc(w3, _W) & most]
    return slots + array("h", [*names, crc(w1, _named("x" + kind + "012"[inner])) & most])


@lru_cache(maxsize=64)
def _named(name: str) -> int:
    return zlib.crc32(name.encode())


def _last(text: str) -> tuple[str, bool]:
    """(the last line that isn't blank, stripped; whether there are others)."""
    text = text.rstrip()
    at = text.rfind("\n")
    return text[at + 1 :].strip(), at >= 0 and not text[:at].isspace()


def _lines(text: str | None) -> list[str]:
    return [t for raw in (text or "").split("\n") if (t := raw.strip())]


def _letters(text: str) -> str:
    return re.sub(r"\W+", " ", text.lower()).strip()


def examples(rows: Iterable[tuple], limits: dict[str, list[int]]) -> Iterator[tuple[array, int]]:
    """Feature slots and labels from (id, headline, own body, snippet) rows."""
    for i, headline, body, snippet in rows:
        pick = random.Random(i)
        made: list[tuple[array | None, int]] = []

        def add(text: str, field: str, label: int) -> None:
            line, more = _last(text)
            if line:
                made.append((_close(line, more, len(text), limits[field], field), label))  # noqa: B023

        if headline and len(headline) > 20:
            add(headline.strip(), "snippet", 0)
        for field, value in (("body", body), ("snippet", snippet)):
            value = (value or "").strip()
            if not value:
                continue
            end, kinds = own_end(_last(value)[0])
            if not _closed(end):
                known = _letters(end)[:60]
                at_limit = any(0 <= limit - len(value) <= 12 for limit in limits[field])
                if field == "snippet" and body and not kinds and not at_limit and not _INNER.search(value) and known not in _letters(body):
                    add(value, field, 0)
                continue
            add(value, field, 0)
            if len(value) < 40:
                continue
            spots = [pick.randrange(20, len(value) - 2) for _ in range(2)]
            if field == "snippet":
                spots.append(pick.randrange(20, min(110, len(value) - 2)))
            spots += [limit for limit in limits[field] if limit < len(value) - 2 and pick.random() < 0.3][:2]
            for at in spots:
                cut = value[:at]
                if pick.random() < 0.4 and (end_ := cut.rfind(" ", 10)) >= 0:
                    cut = cut[:end_]
                tail, more = _last(cut)
                if _closed(tail) or _BULLET.match(tail) or " | " in tail or (at < len(value) and value[at] == "\n"):
                    continue
                mark = pick.choice(("", "", "", "...", "…", " […]", " … Read more"))
                if cut[-1:].isspace():
                    add(cut + mark, field, 1)
                elif tail:
                    made.append((_close(tail + mark, more, len(cut) + len(mark), limits[field], field), 1))
            if field == "body":
                size = -1
                lines = _lines(value)
                for k, t in enumerate(lines[:-1]):
                    size += len(t) + 1
                    if not _closed(t) and (t.count(" ") < 4 or " | " in t or _BULLET.match(t)):
                        made.append((_close(t, k > 0, size, limits[field], field), 0))
        yield from ((x, label) for x, label in made if x is not None)


#: Feature sets in a row of the table that the fit goes over.
SETS = 10_000
PACKED = "sets bigint, intact bigint, cut bigint, slots binary, sizes binary, whole binary, cuts binary"


def _slots_of(packed: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(the slots of all feature sets of a binary column, where each set begins and the last ends); none is null or empty."""
    ends = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1]
    return np.frombuffer(packed.buffers()[2], np.int16)[ends[0] // 2 : ends[-1] // 2], (ends - ends[0]) // 2


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(slots, intact, cut) as few large rows: distinct feature sets one after the other, their sizes, and how many intact and cut values
    each stands for. A pass over many small rows costs more for handing them on than for the sums."""
    for batch in batches:
        if not len(batch):
            continue
        slots, ends = _slots_of(batch.column(0))
        intact, cut = (batch.column(k).to_numpy() for k in (1, 2))
        for k in range(0, len(batch), SETS):
            at = ends[k : k + SETS + 1]
            own = [slots[at[0] : at[-1]], np.diff(at).astype(np.int16), intact[k : k + SETS], cut[k : k + SETS]]
            row = [len(own[1]), int(own[2].sum()), int(own[3].sum()), *(x.tobytes() for x in own)]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64() if j < 3 else pa.binary()) for j, x in enumerate(row)], names=["sets", "intact", "cut", "slots", "sizes", "whole", "cuts"])


def loss(batches: Iterable[pa.RecordBatch], w: np.ndarray) -> tuple[float, np.ndarray]:
    """Logistic loss and its gradient over batches of packed (slots, sizes, whole, cuts)."""
    total, grad = 0.0, np.zeros(FEATURES)
    for batch in batches:
        for slots, *parts in zip(*(batch.column(k) for k in range(4)), strict=True):
            flat = np.frombuffer(slots.as_buffer(), np.int16).astype(np.intp)
            sizes, intact, cut = (np.frombuffer(x.as_buffer(), kind) for x, kind in zip(parts, (np.int16, np.int64, np.int64), strict=True))
            z = np.add.reduceat(w[flat], np.r_[0, np.cumsum(sizes[:-1], dtype=np.int64)])  # no set is empty
            total += float(cut @ np.logaddexp(0, -z) + intact @ np.logaddexp(0, z))
            err = (intact + cut) * (1 + np.tanh(z / 2)) / 2 - cut
            grad += np.bincount(flat, weights=np.repeat(err, sizes), minlength=FEATURES)
    return total, grad


def minimised(f: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, scale: np.ndarray, rounds: int = 100, memory: int = 12) -> np.ndarray:
    """The minimum of a smooth convex function, given with its gradient, by L-BFGS; ``scale`` is about its curvature along each axis."""
    x, (fx, g) = start, f(start)
    pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
    values = [fx]
    for _ in range(rounds):
        d, back = -g, []
        for s, y, rho in reversed(pairs):
            back.append(rho * (s @ d))
            d = d - back[-1] * y
        d = d / scale
        if pairs:
            s, y, rho = pairs[-1]
            d = d / (rho * (y @ (y / scale)))
        for (s, y, rho), a in zip(pairs, reversed(back), strict=True):
            d = d + (a - rho * (y @ d)) * s
        slope, step = g @ d, 1.0
        while (new := f(x + step * d))[0] > fx + 1e-4 * step * slope and step > 1e-6:
            step /= 2
        if not new[0] < fx:
            break
        s, y = step * d, new[1] - g
        x, (fx, g) = x + s, new
        if s @ y > 0:
            pairs = [*pairs, (s, y, 1 / (s @ y))][-memory:]
        values.append(fx)
        if len(values) > STEPS and values[-1 - STEPS] - fx < GAIN * fx:
            break
    return x


def fit(counted: DataFrame, most: int = BROADCAST_ROWS) -> np.ndarray:
    """Weights of a logistic regression over hashed binary features, with a unit normal prior around what the punctuation alone says,
    on (slots, intact, cut): distinct feature sets and how many intact and cut values have them."""
    prior = np.zeros(FEATURES)
    prior[_slot("cO")], prior[_slot("cC")] = 2.0, -4.0  # where there is nothing to learn from, the punctuation decides
    packed = written(counted.select("slots", "intact", "cut").mapInArrow(_packed, PACKED), "examples")
    sets, intact, cut = packed.agg(F.sum("sets"), F.sum("intact"), F.sum("cut")).first()
    if not intact or not cut:
        return prior
    packed = packed.select("slots", "sizes", "whole", "cuts")
    held = packed.toArrow().to_batches() if sets <= most else None
    over = lambda w: _loss_of(packed, w) if held is None else loss(held, w)
    # how many examples have a feature: the gradient's change from calling none cut to calling all; most end up where the loss is flat
    every = np.zeros(FEATURES)
    every[_slot("bias")] = 40.0
    scale = (1 + over(every)[1] - over(-every)[1]) ** 0.7

    def whole(w: np.ndarray) -> tuple[float, np.ndarray]:
        value, grad = over(w)
        return value + float((w - prior) @ (w - prior)) / 2, grad + w - prior

    return minimised(whole, prior, scale)


def _loss_of(packed: DataFrame, w: np.ndarray) -> tuple[float, np.ndarray]:
    """:func:`loss` over a table, on the tasks."""
    shared = packed.sparkSession.sparkContext.broadcast(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, grad = loss(batches, shared.value)
        yield pa.RecordBatch.from_arrays([pa.array([np.r_[total, grad].tobytes()], pa.binary())], names=["part"])

    parts = packed.coalesce(PARTS).mapInArrow(run, "part binary").collect()
    out = np.sum([np.frombuffer(r.part) for r in parts], axis=0)
    shared.unpersist()
    return float(out[0]), out[1:]


def limits_of(rows: DataFrame) -> dict[str, list[int]]:
    """The lengths at which unclosed bodies and snippets pile up."""
    end = r"[\"'”’»)\]]*\s*$"

    def closed(text: str) -> Column:
        """Whether a text ends with a sentence: its last characters tell, unless there is nothing but closers among them."""
        tail = F.right(text, F.lit(64))
        return tail.rlike("[.?!]" + end) | (tail.rlike("^" + end) & F.col(text).rlike("[.?!]" + end))

    values = F.array(*[F.struct(F.lit(f).alias("field"), F.length(f).alias("n"), closed(f).alias("closed")) for f in ("body", "snippet")])
    open_ = rows.select(F.explode(values).alias("v")).select("v.*").where("n > 0 and not closed").groupBy("field", "n").agg(F.count("*").alias("k"))
    w = Window.partitionBy("field").orderBy("n").rangeBetween(-AROUND, AROUND)  # over lengths, not rows
    peaks = open_.withColumn("around", (F.sum("k").over(w) - F.col("k")) / (2 * AROUND)).where((F.col("k") >= LIMIT_ROWS) & (F.col("k") >= LIMIT_EXCESS * F.col("around")))
    out: dict[str, list[int]] = {"body": [], "snippet": []}
    for r in peaks.select("field", "n").orderBy("field", "n").collect():  # at most one a length
        out[r[0]].append(r[1])
    return out


def _own(pages: DataFrame, judged: DataFrame) -> DataFrame:
    cut = judged.select(F.col("id").alias("__id"), "drop", "no_article")
    lines = F.filter(F.split("body", "\n"), lambda _, i: ~F.array_contains(F.col("drop"), i + 1))
    body = F.when(~F.col("no_article"), F.array_join(lines, "\n"))
    return pages.join(cut, F.col("id") == F.col("__id")).select("id", "source", "headline", body.alias("own"), F.length("body").alias("size"), "snippet")


def scored(rows: DataFrame) -> DataFrame:
    """(id, source, field, cut probability) of every value of (id, source, headline, body, snippet, url)."""
    pages = rows.select("id", F.col("source").alias("host"), "body", "headline", "url")
    judged = written(B.judged(B.mark(pages)), "judged")
    limits = limits_of(rows)
    context = rows.sparkSession.sparkContext
    bounds = context.broadcast(limits)

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Feature sets of the values, and those of examples with their counts, which have no id."""
        seen: dict[bytes, list[int]] = {}

        def told(values: list[tuple], counts: dict[bytes, list[int]]) -> pa.RecordBatch:
            none = [None] * len(counts)
            i, source, field, sets = zip(*values, strict=True) if values else ((), (), (), ())
            columns = {
                "id": pa.array([*i, *none], pa.int64()), "source": pa.array([*source, *none], pa.string()), "field": pa.array([*field, *none], pa.string()), "slots": pa.array([*sets, *counts], pa.binary()),
                **{name: pa.array([None] * len(values) + [c[k] for c in counts.values()], pa.int64()) for k, name in enumerate(("intact", "cut"))},
            }
            return pa.RecordBatch.from_pydict(columns)

        near = bounds.value
        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("id", "source", "headline", "own", "size", "snippet")]
            values = []
            for i, source, headline, own, size, snippet in zip(*cols, strict=True):
                for field, text, n in (("body", own, size), ("snippet", snippet, len(snippet or ""))):
                    line, more = _last(text) if text else ("", False)
                    if line and (x := _close(line, more, n, near[field], field)) is not None:
                        values.append((i, source, field, x.tobytes()))
                for x, label in examples([(i, headline, own, snippet)], near):
                    c = seen.get(x := x.tobytes())
                    if c is None:
                        c = seen[x] = [0, 0]
                    c[label] += 1
            full = len(seen) > HELD
            yield told(values, seen if full else {})
            if full:
                seen.clear()
        yield told([], seen)

    own = _own(rows.select("id", "source", "headline", "body", "snippet"), judged)
    made = written(own.mapInArrow(slots, "id bigint, source string, field string, slots binary, intact bigint, cut bigint"), "slots")
    counted = made.where("intact is not null").groupBy("slots").agg(F.sum("intact").alias("intact"), F.sum("cut").alias("cut"))
    shared = context.broadcast(fit(counted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                slots, ends = _slots_of(batch.column(3))
                chance = 1 / (1 + np.exp(-np.add.reduceat(shared.value[slots], ends[:-1])))
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(chance, pa.float64())], names=["id", "source", "field", "probability"])

    return made.where("intact is null").select("id", "source", "field", "slots").mapInArrow(run, "id bigint, source string, field string, probability double")


def report(values: DataFrame) -> DataFrame:
    """(source, field, values, cut, share): how often each source cuts each field."""
    return values.groupBy("source", "field").agg(F.count("*").alias("values"), F.count_if(F.col("probability") >= CUT_FROM).alias("cut")).withColumn("share", F.round(F.col("cut") / F.col("values"), 6))
