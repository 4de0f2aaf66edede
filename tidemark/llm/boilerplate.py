"""Main content of web pages: element subtrees are hashed, counted per host, and deleted where they recur over its pages.

Stages
1. ``parse``     one pass over the text: every line's hashes and form bits (see page_lines), kept as compact arrays.
2. ``recurring`` rows per (host, exact hash) and per hash over all hosts; a subtree recurs when it stands in a share of the
                 rows (and in at least MIN_ROWS).
3. ``profile``   recurring subtrees, and the coarser hashes of all other lines, are counted with how often they stand inside an
                 article, that is between the first and the last long closed line that doesn't recur. Page matter stands
                 outside; subheads, lists and tables of articles stand inside, however often they recur.
4. ``vocabulary`` words of pages whose own lines have nothing in common with their address and title, against the words of the
                 other pages' own lines, over all pages: what errors, filler and notices are made of (see residue).
5. ``mark``      each line is decided by its most specific hash with support: page matter where most copies stand outside.
                 A labelled line whose copies stand inside ("Also read: ...") is decided by the shape of what follows the label.
                 A page whose own lines are made of that vocabulary holds no article, however long it is.

Defined results: null and empty bodies have no lines; a page that holds no article at all (a response or filler) has no page
matter; blank lines are never marked; repeated rows are marked alike; extra columns are ignored; a null host is a host of its own.

Sizes: what is collected in stage 3 is bounded by the support shares (at most lines-per-row / share entries). The recurring subtrees of
stage 2 per host, and what stage 3 knows of each, grow with the number of hosts, the words of stage 4 with the text: they are shipped to
the tasks only when counted below BROADCAST_ROWS (words: WORD_ROWS), and joined otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import residue as R
from tidemark.llm.page_lines import ANCHOR, NUMERIC, PROSE, SHORT, digest, form, small
from tidemark.session import BROADCAST_ROWS, written

#: Least rows, and least share of the host's rows / of all rows, for a subtree to recur.
MIN_ROWS, HOST_SHARE, ALL_SHARE = 3, 0.01, 0.001
#: Copies of one story repeat its lines as well. A subtree recurs only over different stories: at least MIN_ROWS, and this share
#: of its rows up to a number that versions of one story don't reach; over all hosts it takes more.
#: Where headlines have few words, stories run together: no more than this share of the stories known is asked for.
STORIES_HOST, STORIES_ALL, STORIES_KNOWN = (0.2, 40), (0.3, 100), 0.3
#: Least share of all rows, and least rows, for a coarser hash to decide.
SUPPORT_SHARE, SUPPORT_ROWS = 0.0005, 5
#: A hash whose copies stand inside articles at least this often is article; closed lines need far stronger evidence.
INSIDE, INSIDE_CLOSED = 0.5, 0.2
#: So many times as many article paragraphs as other lines make an opening one of articles.
PROSE_TIMES = 5
#: Levels of the profile.
EXACT, LABEL, OPENING, SHAPE, CLOSED_SHAPE, COARSE = range(6)

#: How far a word's evidence counts, and from which mean evidence on a page's or headline's words are no text. Hashed words that a task
#: counts before it hands them on; words shipped to the tasks (16 bytes each). Evidence is kept in millionths, so that sums are exact.
CLIP, PAGE_FROM, HEAD_FROM, HELD, WORD_ROWS, UNIT = 3.0, 0.4, 0.5, 300_000, 1_000_000, 1_000_000
#: Texts whose words are counted at once, and lines whose words are told apart at once.
TEXTS, LINES = 500, 10_000

PARSED = "id bigint, host string, exact array<bigint>, forms binary, tokens binary, head int, head_print bigint, head_tokens binary, story bigint"
#: What ``forms`` holds of each line, as 32-bit integers, one field after the other.
FIELDS = ("no", "label", "opening", "shape", "rest", "coarse", "bits", "words", "count")
MARKED = "id bigint, host string, drop array<int>, kept int, flags int, print bigint, head int, head_print bigint, head_score float, head_again float"
#: Bits of ``flags``: the page holds no article / has a placeholder / may be a response that only evidence over hosts can tell.
NO_ARTICLE, PLACEHOLDER, MAYBE = 1, 2, 4


def headline_bits(headline: str | None, slug: set[str], title: set[str]) -> tuple[int, int]:
    """Detector bits of a headline and the print under which copies of one response meet."""
    if not headline or not (h := headline.strip()):
        return 0, 0
    bits = R.HAS_PLACEHOLDER if R.unfilled(h) else 0
    if not slug.isdisjoint(title):
        bits |= R.SHARES_TERM
    elif slug:
        bits |= R.MISMATCHED
    if h.count(" ") < 8:
        bits |= SHORT
    return bits, digest(h.lower().encode().translate(None, b"0123456789").decode())


class _Tokens(dict):
    """Encoded word -> 32-bit hash, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        h = self[word] = small(word.decode())
        return h


_SPACED = bytes(b if b > 127 or b == 10 or chr(b).isalnum() else 32 for b in range(256))


def _hashed(lines: list[str], known: _Tokens) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of lines in lower case, one after the other, as :func:`residue.tokens` tells them apart; their count by line)."""
    told, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for k in range(0, len(lines), LINES):
        text = "\n".join([t if t.isascii() else " ".join(R.tokens(t)) for t in lines[k : k + LINES]])
        raw = np.frombuffer(text.encode().translate(_SPACED), np.uint8)
        word = (raw != 32) & (raw != 10)
        edges = np.flatnonzero(np.diff(np.r_[False, word, False]))
        starts, ends = edges[::2], edges[1::2]
        packed = [None, pa.py_buffer(np.r_[0, np.cumsum(ends - starts)].astype(np.int32)), pa.py_buffer(raw[word])]
        words = pa.Array.from_buffers(pa.binary(), len(starts), packed).dictionary_encode()
        told.append(np.array([known[w] for w in words.dictionary.to_pylist()], np.int32)[words.indices.to_numpy()])
        counts.append(np.diff(np.r_[0, np.searchsorted(starts, np.flatnonzero(raw == 10)), len(starts)]))
    return np.concatenate(told), np.concatenate(counts)


def _binary(parts: list[bytes]) -> pa.Array:
    """A binary column of the parts."""
    return pa.Array.from_buffers(pa.binary(), len(parts), [None, pa.py_buffer(np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)), pa.py_buffer(b"".join(parts))])


def _of_rows(hashes: np.ndarray, counts: np.ndarray, ends: list[int]) -> pa.Array:
    """The hashes of each row's lines as a binary column; ``ends`` has the places in ``counts`` at which rows begin and end."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((4 * np.r_[0, np.cumsum(counts)][ends]).astype(np.int32)), pa.py_buffer(hashes)])


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = _Tokens()
    for batch in batches:
        ids, hosts, bodies, heads, urls = (batch.column(k) for k in range(5))
        offsets, exact, rows, lows, hb, hp, ht, stories = [0], [], [], [], [], [], [], []
        for body, headline, url in zip(bodies.to_pylist(), heads.to_pylist(), urls.to_pylist(), strict=True):
            slug = R.slug_terms(url)
            title = R.terms(headline)
            bits, mark = headline_bits(headline, slug, title)
            about = {w for w in slug | title if len(w) > 4}
            stories.append(R.story(slug or title))
            low = body.lower() if body else ""
            about_here = [w for w in about if w in low]
            if about:
                bits |= R.ABOUT
            if not slug.isdisjoint(about_here):
                bits |= R.SIDES
            if not title.isdisjoint(about_here):
                bits |= R.IN_BODY
            hb.append(bits)
            hp.append(mark)
            ht.append(headline.lower().replace("\n", " ") if headline else "")
            sided = False
            if body:
                unfilled = R.unfilled(body, sure=False)
                for i, raw in enumerate(body.split("\n"), 1):
                    t = raw.strip()
                    if t:
                        e, label, opening, kind, rest, rough, b = form(t)
                        if unfilled and R.unfilled(t):
                            b |= R.HAS_PLACEHOLDER
                        small_ = t.lower()
                        # a part of a word decides once a paragraph of the article has a whole one
                        if about_here and _any_in(about_here, small_) and (sided or _whole_in(about_here, small_)):
                            b |= R.SHARES_TERM
                            sided = sided or bool(b & ANCHOR)
                        exact.append(e)
                        lows.append(small_)
                        rows.append((i, label, opening, kind, rest, rough, b, t.count(" ") + 1))
            offsets.append(len(exact))
        tokens, counts = _hashed(lows, known)
        table = np.c_[np.array(rows, np.int32).reshape(-1, len(FIELDS) - 1), counts.astype(np.int32)]
        forms = [np.ascontiguousarray(table[a:z].T).tobytes() for a, z in pairwise(offsets)]
        own = {"id": ids, "host": hosts, "exact": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(exact, pa.int64())), "forms": _binary(forms), "tokens": _of_rows(tokens, counts, offsets)}
        own |= {"head": pa.array(hb, pa.int32()), "head_print": pa.array(hp, pa.int64()), "head_tokens": _of_rows(*_hashed(ht, known), list(range(len(ht) + 1))), "story": pa.array(stories, pa.int64())}
        yield pa.RecordBatch.from_arrays(list(own.values()), names=list(own))


def _any_in(words: list[str], text: str) -> bool:
    for w in words:
        if w in text:
            return True
    return False


def _whole_in(words: list[str], text: str) -> bool:
    """Whether one of the words is a whole word of a text in lower case."""
    if not text.isascii():
        return not set(words).isdisjoint(R.tokens(text))
    return _any_in([f" {w} " for w in words], f" {text.encode().translate(_SPACED).decode()} ")


def parse(df: DataFrame) -> DataFrame:
    """``df`` is (id bigint, host string, body string, headline string, url string). The words of all pages are kept by line (32-bit
    hashes in ``tokens``, their count by line in the forms)."""
    narrow = df.select(F.col("id").cast("bigint").alias("id"), F.coalesce("host", F.lit("")).alias("host"), "body", "headline", "url")
    return written(narrow.mapInArrow(_parse, PARSED), "pages")


@dataclass
class Recurring:
    """Subtrees that recur: over all rows, and per host either as a set (when small) or as an ``id, hits`` table."""

    rows: int
    everywhere: set[int]
    per_host: set[tuple[str, int]] | None
    hits: DataFrame | None


def recurring(parsed: DataFrame, most: int = BROADCAST_ROWS) -> Recurring:
    told = written(parsed.groupBy("host", "story").agg(F.count("*").alias("k")), "stories")
    sizes = told.groupBy("host").agg(F.sum("k").alias("rows"), F.count("*").alias("all_stories"))
    n, all_stories = told.agg(F.sum("k"), F.countDistinct("story")).first()
    n = n or 0
    each = parsed.select("host", "story", F.explode(F.array_distinct("exact")).alias("exact"))

    def grouped(*by: str) -> DataFrame:
        """Rows and different stories by subtree; what stands once only is left out, it recurs nowhere."""
        return each.groupBy(*by, "story").agg(F.count("*").alias("k")).groupBy(*by).agg(F.sum("k").alias("k"), F.count("*").alias("stories")).where("k > 1")

    def spread(share: float, cap: int, known: Column) -> Column:
        return F.col("stories") >= F.greatest(F.lit(float(MIN_ROWS)), F.least(share * F.col("k"), F.lit(float(cap)), STORIES_KNOWN * known))

    over = grouped("exact").where((F.col("k") >= ALL_SHARE * n) & spread(*STORIES_ALL, F.lit(all_stories)))
    everywhere = {r[0] for r in over.select("exact").collect()}  # at most lines-per-row / ALL_SHARE
    hosts = grouped("host", "exact").where(F.col("k") >= MIN_ROWS).join(F.broadcast(sizes) if sizes.limit(most + 1).count() <= most else sizes, "host")
    hosts = hosts.where((F.col("k") >= HOST_SHARE * F.col("rows")) & spread(*STORIES_HOST, F.col("all_stories"))).select("host", "exact")
    hosts = written(hosts, "recurring")
    if hosts.limit(most + 1).count() <= most:
        return Recurring(n, everywhere, {(r[0], r[1]) for r in hosts.collect()}, None)
    x = parsed.select("id", "host", F.explode(F.array_distinct("exact")).alias("exact")).join(hosts, ["host", "exact"])
    return Recurring(n, everywhere, None, written(x.groupBy("id").agg(F.collect_set("exact").alias("hits")), "hits"))


@dataclass
class Page:
    """A parsed page; ``hits`` are its recurring lines, ``inner`` and ``outer`` those of them that mostly stand inside and outside of
    articles, and ``said`` the mean evidence of its own words, where these are joined to it."""

    host: str
    hits: list[int] | None
    inner: list[int] | None
    outer: list[int] | None
    said: float | None
    exact: list[int]
    forms: np.ndarray
    tokens: np.ndarray
    head: int
    head_tokens: np.ndarray


def _pages(batch: pa.RecordBatch) -> Iterator[Page]:
    """The pages of a batch. Columns that nothing was joined for are left out of it: sending arrays that are null costs more than the rest."""
    column = lambda n: batch.column(at) if (at := batch.schema.get_field_index(n)) >= 0 else None
    exact = column("exact")
    values, ends = exact.flatten().to_numpy(zero_copy_only=False).tolist(), exact.offsets.to_numpy().tolist()
    first = ends[0]
    some = [c.to_pylist() if c is not None and c.null_count < len(c) else [None] * len(batch) for c in map(column, ("hits", "inner", "outer", "said", "tokens", "head_tokens"))]
    for k, (h, blob, bits, hit, a, z, told, words, title) in enumerate(zip(*(column(n).to_pylist() for n in ("host", "forms", "head")), *some, strict=True)):
        yield Page(h, hit, a, z, told, values[ends[k] - first : ends[k + 1] - first], np.frombuffer(blob, np.int32).reshape(len(FIELDS), -1), np.frombuffer(words or b"", np.int32), bits, np.frombuffer(title or b"", np.int32))


def extent(exact: list[int], bits: list[int], recurs: set[int]) -> tuple[int, int] | None:
    """First and last line of the article: long closed lines that don't recur; else any prose that doesn't."""
    for kind in (ANCHOR, PROSE):
        at = [i for i, b in enumerate(bits) if b & kind and exact[i] not in recurs]
        if at:
            return at[0], at[-1]
    return None


def _recurring_of(page: Page, everywhere: set[int], per_host: set | None) -> set[int]:
    own = set(page.hits) if page.hits else {e for e in page.exact if (page.host, e) in per_host} if per_host else set()
    return own | everywhere.intersection(page.exact)


def profile(parsed: DataFrame, rec: Recurring) -> tuple[dict[tuple[int, int], float], DataFrame | None]:
    """(level, hash) -> the share of its copies that stand inside an article; only hashes with support, and recurring lines. Where the
    recurring lines are joined, what is known of them is a table (id, inner, outer) instead."""
    shared = parsed.sparkSession.sparkContext.broadcast((rec.everywhere, rec.per_host))  # bounded, see the module's text
    source = parsed.select("id", "host", "exact", "forms", "head")
    source = source.join(rec.hits, "id", "left") if rec.hits is not None else source

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        everywhere, per_host = shared.value
        seen: dict[tuple[int, int], list[int]] = {}

        def add(level: int, h: int, inside: bool, prose: bool = False) -> None:
            c = seen.get((level, h))
            if c is None:
                c = seen[level, h] = [0, 0, 0]
            if prose:
                c[2] += 1
            else:
                c[0] += 1
                c[1] += inside

        def told() -> pa.RecordBatch:
            keys = list(seen)
            out = pa.RecordBatch.from_pydict({
                "level": pa.array([k[0] for k in keys], pa.int32()), "h": pa.array([k[1] for k in keys], pa.int64()),
                "n": pa.array([seen[k][0] for k in keys], pa.int64()), "inside": pa.array([seen[k][1] for k in keys], pa.int64()), "prose": pa.array([seen[k][2] for k in keys], pa.int64()),
            })
            seen.clear()
            return out

        for batch in batches:
            for page in _pages(batch):
                exact, (_, label, opening, shape, _, rough, bits, _, _) = page.exact, page.forms.tolist()
                recurs = _recurring_of(page, everywhere, per_host)
                span = extent(exact, bits, recurs)
                if span is None:
                    continue
                a, z = span
                for i, b in enumerate(bits):
                    inside = a <= i <= z
                    if exact[i] in recurs:
                        add(EXACT, exact[i], inside)
                        continue
                    if label[i] and not b & NUMERIC:
                        add(LABEL, label[i], inside)
                    if b & ANCHOR:
                        add(OPENING, opening[i], inside, prose=True)
                        continue
                    if b & PROSE:
                        if shape[i]:
                            add(CLOSED_SHAPE, shape[i], inside)
                        continue
                    if opening[i]:
                        add(OPENING, opening[i], inside)
                    if shape[i]:
                        add(SHAPE, shape[i], inside)
                    if rough[i]:
                        add(COARSE, rough[i], inside)
            if len(seen) > HELD:
                yield told()
        if seen:
            yield told()

    found = source.mapInArrow(run, "level int, h bigint, n bigint, inside bigint, prose bigint").groupBy("level", "h").agg(F.sum("n").alias("n"), F.sum("inside").alias("inside"), F.sum("prose").alias("prose"))
    # an opening that article paragraphs have far more often than other lines is one of a cut paragraph
    share = F.when(F.col("prose") >= PROSE_TIMES * F.col("n"), 1.0).otherwise(F.col("inside") / F.col("n"))
    exact, supported = F.col("level") == EXACT, F.col("n") + F.col("prose") >= max(SUPPORT_ROWS, SUPPORT_SHARE * rec.rows)
    found = found.where(exact | supported).select("level", "h", share.alias("share"))
    if rec.hits is None:  # at most lines-per-row / SUPPORT_SHARE, and the recurring lines, which were counted
        return {(r[0], r[1]): r[2] for r in found.collect()}, None
    found = written(found, "profile")
    small_ = parsed.sparkSession.createDataFrame([(h,) for h in rec.everywhere], "h bigint")
    known = {(r[0], r[1]): r[2] for r in found.where(~exact).union(found.where(exact).join(F.broadcast(small_), "h", "left_semi").select("level", "h", "share")).collect()}
    told = rec.hits.select("id", F.explode("hits").alias("h")).join(found.where(exact).select("h", "share"), "h")
    sides = told.groupBy("id").agg(*[F.array_compact(F.collect_set(F.when(c, F.col("h")))).alias(n) for n, c in (("inner", F.col("share") >= INSIDE), ("outer", F.col("share") < INSIDE))])
    return known, written(sides, "sides")


def decide(label: int, opening: int, shape: int, rest: int, rough: int, bits: int, inside: bool, known: dict) -> bool:
    """Whether a line that doesn't recur exactly is page matter."""
    p = known.get((LABEL, label)) if label and not bits & NUMERIC else None
    if p is not None:
        if p < (INSIDE_CLOSED if bits & ANCHOR else INSIDE):
            return True
        if rest and not bits & PROSE:
            q = known.get((SHAPE, rest))
            if q is not None and q < INSIDE:
                return True
    if bits & PROSE:
        q = known.get((CLOSED_SHAPE, shape)) if shape and not bits & ANCHOR else None
        return q is not None and q < INSIDE_CLOSED
    if opening and not bits & NUMERIC:
        p = known.get((OPENING, opening))
        if p is not None:
            return p < INSIDE
    p = known.get((SHAPE, shape)) if shape else None
    if p is None and rest:
        p = known.get((SHAPE, rest))
    if p is None and rough:
        p = known.get((COARSE, rough))
    return p < INSIDE if p is not None else not inside and bool(bits & SHORT)


def own_lines(page: Page, everywhere: set[int], per_host: set | None, known: dict) -> tuple[list[int], list[int]]:
    """(lines of page matter, the page's own lines) by place."""
    _, label, opening, shape, rest, rough, bits, _, _ = page.forms.tolist()
    exact = page.exact
    recurs = _recurring_of(page, everywhere, per_host)
    span = extent(exact, bits, recurs)
    outer = set(page.outer or ())
    drop, own = [], []
    for i, b in enumerate(bits):
        e = exact[i]
        if e in recurs:
            share = known.get((EXACT, e))
            # what recurs on pages without an article only, and never beside one, isn't matter of pages
            out = share < INSIDE if share is not None else e in outer
        else:
            out = decide(label[i], opening[i], shape[i], rest[i], rough[i], b, span is not None and span[0] <= i <= span[1], known)
        (drop if out else own).append(i)
    if not own and span is None:  # nothing looks like text: what doesn't recur is all that the page says
        own = [i for i in drop if exact[i] not in recurs]
        drop = [i for i in drop if exact[i] in recurs]
    return drop, own


@dataclass
class Words:
    """What words say of a page, of a headline, and of a headline by those that several have: millionths, by hash in ascending order."""

    hashes: np.ndarray
    page: np.ndarray
    head: np.ndarray
    again: np.ndarray

    def of(self, kind: str, tokens: np.ndarray) -> np.ndarray:
        """The evidence of each token; unknown words speak for a text."""
        out = np.full(len(tokens), -int(CLIP * UNIT), np.int64)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, tokens), len(self.hashes) - 1)
            hit = self.hashes[at] == tokens
            out[hit] = getattr(self, kind)[at[hit]]
        return out


NO_WORDS = Words(*(np.zeros(0, np.int32) for _ in range(4)))


def evidence(tokens: np.ndarray, words: Words) -> float:
    """Mean evidence of the words on a page; 0 without words."""
    return int(words.of("page", tokens).sum()) / (len(tokens) * UNIT) if len(tokens) else 0.0


def head_evidence(titles: list[bytes], kind: str, words: Words) -> np.ndarray:
    """Mean evidence of the words of each headline of a batch."""
    sizes = np.array([len(t) // 4 for t in titles], np.int64)
    told = np.r_[0, np.cumsum(words.of(kind, np.frombuffer(b"".join(titles), np.int32)))]
    ends = np.cumsum(sizes)
    return (told[ends] - told[ends - sizes]) / (np.maximum(sizes, 1) * UNIT)


def words_of(page: Page, lines: list[int]) -> np.ndarray:
    """The words of some of a page's lines."""
    counts = page.forms[-1]
    keep = np.zeros(len(counts), bool)
    keep[lines] = True
    return page.tokens[np.repeat(keep, counts)]


def doubtful(own: list[int], bits: list[int]) -> bool:
    """Whether no paragraph of a page has a word of its address or title, so that the page is judged by its words."""
    return bool(own) and not any(bits[i] & ANCHOR and bits[i] & R.SHARES_TERM for i in own)


def mark_page(page: Page, everywhere: set[int], per_host: set | None, known: dict, weights: Words) -> tuple[list[int], int, int, int]:
    """(numbers of the lines of page matter, count of the others, flags, print of a possible response) of one page."""
    drop, own = own_lines(page, everywhere, per_host, known)
    no, bits, words = page.forms[0].tolist(), page.forms[6].tolist(), page.forms[7].tolist()
    flags = PLACEHOLDER if any(bits[i] & R.HAS_PLACEHOLDER for i in own) else 0
    mark = 0
    if doubtful(own, bits):
        score = evidence(words_of(page, own), weights) if page.said is None else page.said
        if score > PAGE_FROM or (flags and sum(words[i] for i in own) < 15):
            flags |= NO_ARTICLE
        elif score > 0 and not any(bits[i] & (R.SHARES_TERM | ANCHOR) for i in own):
            flags |= MAYBE
            mark = small("".join(str(page.exact[i]) for i in own if words[i] > 1))
    return [no[i] for i in drop], len(own), flags, mark


def vocabulary(pages: DataFrame, shared: Broadcast) -> DataFrame:
    """(word, page, head, again): what words say, see :class:`Words`; log ratios, clipped, of how many of all pages without a word in
    common with address and title have them and how many others. Words that say no more than unknown ones are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int | None, list[int]] = {}

        def add(texts: list[np.ndarray], k: int) -> None:
            """Count how many of the texts have each word."""
            each = [np.sort(t) for t in texts]
            each = [t[np.r_[True, t[1:] != t[:-1]]] if len(t) else t for t in each]
            words, counts = np.unique(np.concatenate(each), return_counts=True)
            for w, n in [(None, len(texts)), *zip(words.tolist(), counts.tolist(), strict=True)]:
                c = seen.get(w)
                if c is None:
                    c = seen[w] = [0, 0, 0, 0]
                c[k] += n

        def told() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int32()), *(pa.array([c[k] for c in seen.values()], pa.int64()) for k in range(4))], names=["word", "a", "z", "ah", "zh"])
            seen.clear()
            return out

        texts: list[list[np.ndarray]] = [[], [], [], []]

        def full(least: int) -> None:
            for k, of in enumerate(texts):
                if len(of) >= least:
                    add(of, k)
                    of.clear()

        for batch in batches:
            for page in _pages(batch):
                if len(page.exact) and page.head & R.ABOUT:
                    _, own = own_lines(page, *shared.value)
                    if own:
                        bits = page.forms[6]
                        texts[0 if (bits[own] & R.SHARES_TERM).any() else 1].append(words_of(page, own))
                if len(page.head_tokens):
                    texts[3 if page.head & R.MISMATCHED and not page.head & R.IN_BODY else 2].append(page.head_tokens)
                full(TEXTS)
            full(1)
            if len(seen) > HELD:
                yield told()
        if seen:
            yield told()

    found = pages.mapInArrow(run, "word int, a bigint, z bigint, ah bigint, zh bigint").groupBy("word").agg(*[F.sum(c).alias(c) for c in ("a", "z", "ah", "zh")])
    found = written(found.where("word is null or z > 0 or zh > 0"), "vocabulary")
    total = found.where("word is null").first() or {"a": 0, "z": 0, "ah": 0, "zh": 0}

    def ratio(k: str, n: int, m: Column, of: int) -> Column:
        value = F.log((F.col(k) + 0.1) / (n + 1)) - F.log((m + 0.1) / (of + 1))
        return F.when(F.col(k) > 0, F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), value))).otherwise(-CLIP)

    page, head = ratio("z", total["z"], F.col("a"), total["a"]), ratio("zh", total["zh"], F.col("a") + F.col("ah"), total["a"] + total["ah"])
    said = {"page": page, "head": head, "again": F.when(F.col("zh") > 1, head).otherwise(F.least(F.lit(0.0), head))}
    out = found.where("word is not null").select("word", *[F.round(v * UNIT).cast("int").alias(n) for n, v in said.items()])
    return written(out.where(F.greatest("page", "head") > -int(CLIP * UNIT)), "words")


def said_by(pages: DataFrame, shared: Broadcast, words: DataFrame) -> DataFrame:
    """(id, said, head_said, again_said): the mean evidence of pages that are judged by their words and of headlines, words joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, own_, word, count = [], [], [], []
            for i, page in zip(batch.column(batch.schema.get_field_index("id")).to_pylist(), _pages(batch), strict=True):
                _, own = own_lines(page, *shared.value)
                for is_own, tokens in ((True, words_of(page, own) if doubtful(own, page.forms[6].tolist()) else page.tokens[:0]), (False, page.head_tokens)):
                    w, k = np.unique(tokens, return_counts=True)
                    ids += [i] * len(w)
                    own_ += [is_own] * len(w)
                    word.append(w)
                    count.append(k)
            flat = lambda parts, kind: pa.array(np.concatenate(parts) if parts else np.zeros(0), kind)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(own_, pa.bool_()), flat(word, pa.int32()), flat(count, pa.int64())], names=["id", "own", "word", "k"])

    x = pages.mapInArrow(run, "id bigint, own boolean, word int, k bigint").join(words, "word", "left")
    mean = lambda c, own: F.coalesce(F.sum(F.when(own, F.col("k") * F.coalesce(c, F.lit(-int(CLIP * UNIT))))) / (F.sum(F.when(own, F.col("k"))) * UNIT), F.lit(0.0))
    return written(x.groupBy("id").agg(mean("page", F.col("own")).alias("said"), mean("head", ~F.col("own")).alias("head_said"), mean("again", ~F.col("own")).alias("again_said")), "said")


@dataclass
class Fitted:
    """Parsed pages with their recurring lines, and what marking them needs, shipped to the tasks (bounded, see the module's text)."""

    pages: DataFrame
    shared: Broadcast


def fit(df: DataFrame, most: int | None = None) -> Fitted:
    """Parse the pages of (id, host, body, headline, url) and learn what recurs on them, and what their words say."""
    context = df.sparkSession.sparkContext
    parsed = parse(df)
    rec = recurring(parsed)
    known, sides = profile(parsed, rec)
    pages = parsed.join(rec.hits, "id", "left").join(sides, "id", "left") if sides is not None else parsed
    learnt = context.broadcast((rec.everywhere, rec.per_host, known))
    words = vocabulary(pages, learnt)
    if words.count() > (WORD_ROWS if most is None else most):
        pages, held = pages.join(said_by(pages, learnt, words), "id", "left"), NO_WORDS
    else:
        told = words.orderBy("word").toArrow()  # counted
        held = Words(*(told.column(n).to_numpy().astype(np.int32) for n in ("word", "page", "head", "again")))
    return Fitted(pages, context.broadcast((rec.everywhere, rec.per_host, known, held)))


def mark_batch(batch: pa.RecordBatch, shared: tuple) -> list[tuple[list[int], int, int, int]]:
    """:func:`mark_page` of every row of a batch of parsed pages."""
    return [mark_page(page, *shared) for page in _pages(batch)]


def mark(df: DataFrame) -> DataFrame:
    """(id, host, drop: numbers of lines of page matter, kept: count of the others, flags, ...) of each row of
    (id, host, body, headline, url)."""
    fitted = fit(df)
    shared = fitted.shared

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = mark_batch(batch, shared.value)
            named = {n: batch.column(batch.schema.get_field_index(n)) for n in ("id", "host", "head", "head_print", "head_tokens")}
            titles = named["head_tokens"].to_pylist()
            scores = []
            for kind, n in (("head", "head_said"), ("again", "again_said")):
                said = pa.array(head_evidence(titles, kind, shared.value[-1]), pa.float64())
                at = batch.schema.get_field_index(n)
                scores.append((said if at < 0 else pc.coalesce(batch.column(at), said)).cast(pa.float32()))
            ends = np.cumsum([0, *(len(o[0]) for o in out)])
            drop = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array([v for o in out for v in o[0]], pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [named["id"], named["host"], drop, pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.int32()), pa.array([o[3] for o in out], pa.int64()), named["head"], named["head_print"], *scores],
                names=["id", "host", "drop", "kept", "flags", "print", "head", "head_print", "head_score", "head_again"],
            )

    return written(fitted.pages.mapInArrow(run, MARKED), "marked")


#: A print under so many different headlines, with no word in common with address or headline, is one response to many addresses.
RESPONSE_HEADLINES = 5


def judged(marked: DataFrame) -> DataFrame:
    """Add ``no_article``: known by its words, or a print leaning that way that many mismatched rows share."""
    shared = marked.where(F.col("flags").bitwiseAND(MAYBE) != 0).groupBy("print").agg(F.countDistinct("head_print").alias("print_rows")).where(F.col("print_rows") >= RESPONSE_HEADLINES)
    x = marked.join(shared, "print", "left")
    alone = (F.col("flags").bitwiseAND(MAYBE) != 0) & F.col("print_rows").isNotNull()
    return x.withColumn("no_article", (F.col("flags").bitwiseAND(NO_ARTICLE) != 0) | alone).drop("print_rows")


def page_matter(marked: DataFrame) -> DataFrame:
    """(id, line_no) of every line of page matter of pages that hold an article."""
    return judged(marked).where(~F.col("no_article")).select("id", F.explode("drop").alias("line_no")).select("id", F.col("line_no").cast("bigint"))


def main_content(df: DataFrame, marked: DataFrame, text: str = "body") -> DataFrame:
    """(id, article): the lines of ``text`` that are the page's own, in order; null where the page holds no article."""
    cut = judged(marked).select(F.col("id").alias("__id"), "drop", "no_article")
    x = df.select("id", F.col(text).alias("__text")).join(cut, F.col("id") == F.col("__id"))
    lines = F.filter(F.split("__text", "\n"), lambda _, i: ~F.array_contains(F.col("drop"), i + 1))
    return x.select("id", F.when(~F.col("no_article"), F.array_join(lines, "\n")).alias("article"))


