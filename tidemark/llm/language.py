"""The language of texts and of their lines, by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary. A word's probability in a language is the sum over
all its segmentations into pieces, by the forward algorithm over its bytes; a text's is the product over its words, and the
posterior over languages is its language with a confidence. Words repeat, so workers remember their scores up to a bound.

Piece probabilities are fitted by expectation-maximisation (forward-backward counts over segmentations) on a bounded sample of
labelled documents. A language that is written in several scripts has probabilities for each. Labels are noisy: scripts of few of
a language's words are left out, and after the first fit the sample's lines are assigned by the model and it is fitted again.
A line's language is weighed with what the other lines of its document speak for, so that short lines follow their document.

Labels: a code or name of a language in any spelling, with any region, is read as its two-letter code; labels that name no
language are missing. A label is right when it is the document's main language, and 'und' or 'zxx' for texts without words.

Defined results: null, empty and blank texts have no language and give no rows; lines without words are 'und'; the main language
is the one with most characters, ties going to the one first in the text; a text without a line in any language is 'und'; rows
that repeat are labelled alike; a language without a single labelled document in the sample is never assigned.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Languages told apart, with their names and three-letter codes (fixed values).
LANGUAGES = {
    "en": ("english", "eng"), "hi": ("hindi", "hin"), "mr": ("marathi", "mar"), "bn": ("bengali", "ben", "bangla"), "ta": ("tamil", "tam"),
    "de": ("german", "deu", "ger", "deutsch"), "fr": ("french", "fra", "fre", "français", "francais"), "es": ("spanish", "spa", "español", "espanol", "castilian"),
    "pt": ("portuguese", "por", "português", "portugues"), "id": ("indonesian", "ind", "bahasa indonesia"),
}
UNKNOWN = "und"
#: Labels that say there is no language (fixed values).
NO_LANGUAGE = ("und", "zxx")
#: Other languages' codes that a label may name (fixed values); anything else that isn't above names no language.
OTHER_CODES = frozenset("nl ne gl it tl te ms ml as gu pa kn or ur sa si my th vi zh ja ko ru uk pl cs sv da no nb nn fi hu ro el tr ar he fa ca eu af sq bg hr et lv lt mk sk sl sr sw".split())
OTHER_NAMES = frozenset("dutch nepali galician italian tagalog telugu malay malayalam assamese gujarati punjabi kannada odia urdu sanskrit chinese japanese korean russian polish swedish danish norwegian finnish turkish arabic catalan".split())

#: The public vocabulary and the bound of the sample: documents a language, and distinct words a language.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
SAMPLE_DOCUMENTS, SAMPLE_WORDS = 400, 20_000
#: Rounds of expectation-maximisation, smoothing mass a piece, longest piece in bytes, and words that a worker remembers.
ROUNDS, SMOOTHING, LONGEST, MEMO = 4, 0.02, 24, 300_000
#: How much one word can speak against a language, in nats: names and stray words of another script don't decide a line.
MOST = 12.0
#: Least share of a language's words for a script of it, and the words that every language is taken to have in other lines.
SCRIPT_SHARE, ELSEWHERE = 0.15, 0.05
#: Scripts by code point ranges (fixed values).
SCRIPTS = (("latin", 0x41, 0x24F), ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF), ("tamil", 0xB80, 0xBFF))

_WORD = regex.compile(r"[\p{L}\p{M}]+(?:['’][\p{L}\p{M}]+)*")


@lru_cache(maxsize=100_000)
def label_code(label: str | None) -> str | None:
    """The code that a label names, 'und' for labels that say there is none, None when it names no language."""
    text = (label or "").strip().lower().replace("_", "-")
    if not text:
        return None
    head = text.split("-")[0].strip()
    for t in (text, head):
        if t in LANGUAGES or t in NO_LANGUAGE or t in OTHER_CODES:
            return UNKNOWN if t in NO_LANGUAGE else t
        for code, names in LANGUAGES.items():
            if t in names or any(t.startswith(n + " ") or t.startswith(n + "(") for n in names):
                return code
        if t in OTHER_NAMES:
            return t
    return None


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def script_of(word: str) -> str:
    c = ord(word[0])
    return next((name for name, a, z in SCRIPTS if a <= c <= z), "other")


class Pieces:
    """The pieces of the vocabulary that words can be made of, by bytes."""

    def __init__(self, data: bytes):
        tokens = [base64.b64decode(line.split()[0]) for line in data.splitlines() if line]
        kept = sorted({t.strip().lower() for t in tokens if 0 < len(t.strip()) <= LONGEST} | {bytes([b]) for b in range(256)})
        self.id = {t: k for k, t in enumerate(kept)}
        self.most = max(map(len, kept))

    def lattice(self, word: bytes) -> list[list[tuple[int, int]]]:
        """For every end position the (start, piece) edges that end there."""
        n, ids = len(word), self.id
        out: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
        for i in range(n):
            for j in range(i + 1, min(n, i + self.most) + 1):
                k = ids.get(word[i:j])
                if k is not None:
                    out[j].append((i, k))
        return out


def forward(lattice: list[list[tuple[int, int]]], p: np.ndarray) -> np.ndarray:
    """Row i: the probability of the first i bytes in each language, summed over segmentations. ``p`` is pieces x languages."""
    a = np.zeros((len(lattice), p.shape[1]))
    a[0] = 1.0
    for j in range(1, len(lattice)):
        edges = lattice[j]
        if len(edges) == 1:
            a[j] = a[edges[0][0]] * p[edges[0][1]]
        elif edges:
            at, piece = zip(*edges, strict=True)
            a[j] = (a[list(at)] * p[list(piece)]).sum(axis=0)
    return a


class Model:
    """Piece probabilities by variant, that is a language in a script; ``languages`` has each variant's language."""

    def __init__(self, pieces: Pieces, languages: list[str], p: np.ndarray):
        self.pieces, self.languages, self.p = pieces, languages, p
        self.memo: dict[str, int] = {}
        self.rows = np.zeros((1024, len(languages)))
        self.names = list(dict.fromkeys(languages))
        self.variants = [[k for k, v in enumerate(languages) if v == n] for n in self.names]

    def _word(self, word: str) -> np.ndarray:
        """Log probability of a word in each variant, relative to the best one."""
        found = np.zeros(len(self.languages))
        data = word.encode("utf-8", "replace")
        for k in range(0, len(data), 96):  # very long words in parts, so that nothing underflows
            part = data[k : k + 96]
            found = found + np.log(forward(self.pieces.lattice(part), self.p)[-1] + 1e-300)
        return np.maximum(found - found.max(), -MOST)

    def scores(self, words: list[str]) -> np.ndarray:
        """The log probabilities of the words, words x variants."""
        if len(self.memo) >= MEMO:
            self.memo.clear()
        get = self.memo.get
        at = [get(w, -1) for w in words]
        if -1 in at:
            for k, w in enumerate(words):
                if at[k] >= 0:
                    continue
                row = get(w)
                if row is None:
                    row = self.memo[w] = len(self.memo)
                    if row >= len(self.rows):
                        self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
                    self.rows[row] = self._word(w)
                at[k] = row
        return self.rows[at]


def fit(pieces: Pieces, counts: dict[tuple[str, str], Counter]) -> tuple[Model, list[tuple[str, str]]]:
    """Expectation-maximisation of the piece probabilities from word counts by (language, script)."""
    total = Counter()
    for (language, _), words in counts.items():
        total[language] += words.total()
    variants = [v for v in sorted(counts) if counts[v].total() >= SCRIPT_SHARE * total[v[0]]]
    p = np.zeros((len(pieces.id), len(variants)))
    for c, variant in enumerate(variants):
        lattices = [(pieces.lattice(w.encode("utf-8", "replace")[:96]), n) for w, n in sorted(counts[variant].items(), key=lambda x: (-x[1], x[0]))[:SAMPLE_WORDS]]
        own = np.full(len(pieces.id), SMOOTHING)
        for lattice, n in lattices:
            for j, edges in enumerate(lattice):
                for i, k in edges:
                    own[k] += n * (j - i) ** 2 / len(lattice)  # a start that segments into long pieces
        own /= own.sum()
        for _ in range(ROUNDS):
            new = np.full(len(pieces.id), SMOOTHING)
            for lattice, n in lattices:
                a = [1.0] + [0.0] * (len(lattice) - 1)
                for j in range(1, len(lattice)):
                    a[j] = sum(a[i] * own[k] for i, k in lattice[j])
                if a[-1] <= 0:
                    continue
                b = [0.0] * (len(lattice) - 1) + [1.0]
                for j in range(len(lattice) - 1, 0, -1):
                    for i, k in lattice[j]:
                        x = own[k] * b[j]
                        new[k] += n * a[i] * x / a[-1]
                        b[i] += x
            own = new / new.sum()
        p[:, c] = own
    return Model(pieces, [v[0] for v in variants], p), variants


def count_words(text: str, language: str, counts: dict[tuple[str, str], Counter]) -> None:
    for w in words_of(text):
        counts.setdefault((language, script_of(w)), Counter())[w] += 1


def fit_twice(pieces: Pieces, sample: list[tuple[str, str]]) -> Model:
    """The model from (language label, text) rows whose labels may be wrong."""
    counts: dict[tuple[str, str], Counter] = {}
    for code, text in sample:
        count_words(text, code, counts)
    model, _ = fit(pieces, counts)
    counts = {}
    for k in range(0, len(sample), 256):
        texts = [text for _, text in sample[k : k + 256]]
        for text, parts in zip(texts, all_segments(texts, model), strict=True):
            by_number = dict(lines_of(text))
            for i, language, sure, _ in parts:
                if language != UNKNOWN and sure > 0.9:
                    count_words(by_number[i], language, counts)
    return fit(pieces, counts)[0]


def lines_of(text: str) -> list[tuple[int, str]]:
    """The non-blank lines with their numbers from 1."""
    return [(i, t) for i, raw in enumerate(text.split("\n"), 1) if (t := raw.strip())]


def segments(text: str, model: Model) -> list[tuple[int, str, float, int]]:
    """(line number, language, confidence, characters) of every non-blank line."""
    return all_segments([text], model)[0]


def all_segments(texts: list[str], model: Model) -> list[list[tuple[int, str, float, int]]]:
    """:func:`segments` of each text."""
    pages = [lines_of(t) for t in texts]
    if not model.languages:
        return [[(i, UNKNOWN, 0.0, len(t)) for i, t in lines] for lines in pages]
    words = [words_of(t) for lines in pages for _, t in lines]
    sizes = np.array([len(w) for w in words], np.int64)
    some = np.flatnonzero(sizes)
    post = np.zeros((len(words), len(model.names)))
    if len(some):
        owner = np.repeat(np.arange(len(pages)), [len(lines) for lines in pages])[some]
        each = model.scores([w for line in words for w in line])
        by_variant = np.add.reduceat(each, (np.cumsum(sizes) - sizes)[some])
        s = np.stack([by_variant[:, k].max(axis=1) for k in model.variants], axis=1)
        own = _posterior(s) * sizes[some][:, None]
        total = np.full((len(pages), len(model.names)), ELSEWHERE)
        np.add.at(total, owner, own)
        others = np.maximum(total[owner] - own, ELSEWHERE)
        post[some] = _posterior(s + np.log(others / others.sum(axis=1, keepdims=True)))
    best = post.argmax(axis=1)
    sure = post[np.arange(len(post)), best].tolist()
    out, at = [], 0
    for lines in pages:
        parts = []
        for i, t in lines:
            parts.append((i, model.names[best[at]], sure[at], len(t)) if sizes[at] else (i, UNKNOWN, 1.0, len(t)))
            at += 1
        out.append(parts)
    return out


def _posterior(s: np.ndarray) -> np.ndarray:
    x = np.exp(s - s.max(axis=-1, keepdims=True))
    return x / x.sum(axis=-1, keepdims=True)


def main_language(parts: list[tuple[int, str, float, int]]) -> tuple[str, float]:
    """(the language with most characters, its share of the characters in any language)."""
    size: dict[str, int] = {}
    for _, language, _, n in parts:
        if language != UNKNOWN:
            size[language] = size.get(language, 0) + n
    if not size:
        return UNKNOWN, 1.0
    best = max(size, key=lambda x: size[x])
    return best, size[best] / sum(size.values())


def sampled(documents: DataFrame, most: int) -> DataFrame:
    """(code, text) of ``most`` labelled documents a language, those least by hash, in one scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[str, list[tuple[int, int, str]]] = {}
        for batch in batches:
            for text, label, h, i in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                code = label_code(label)
                if code in LANGUAGES:
                    own = least.setdefault(code, [])
                    own.append((h, i, text))
                    if len(own) >= 2 * most:
                        own.sort()
                        del own[most:]
        rows = [(code, *x) for code, own in least.items() for x in sorted(own)[:most]]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["code", "h", "doc_id", "text"])

    kept = documents.where("text is not null and lang is not null").select("text", "lang", F.xxhash64("doc_id").alias("h"), F.col("doc_id").cast("bigint").alias("doc_id"))
    kept = kept.mapInArrow(run, "code string, h bigint, doc_id bigint, text string")  # at most that many a task
    return kept.withColumn("k", F.row_number().over(Window.partitionBy("code").orderBy("h", "doc_id"))).where(F.col("k") <= most).select("code", "text")


def train(documents: DataFrame, vocabulary: str = VOCABULARY) -> tuple[bytes, list[str], np.ndarray]:
    """The vocabulary file, the languages and their piece probabilities, from labelled rows of (doc_id, text, lang)."""
    data = Path(vocabulary).read_bytes()
    pieces = Pieces(data)
    sample = sorted(tuple(r) for r in sampled(documents, SAMPLE_DOCUMENTS).collect())  # at most SAMPLE_DOCUMENTS a language
    if not sample:
        return data, [], np.zeros((len(pieces.id), 0))
    model = fit_twice(pieces, sample)
    return data, model.languages, model.p


@lru_cache(maxsize=2)
def _worker_model(key: str, data: bytes, languages: tuple[str, ...], p: bytes) -> Model:
    return Model(Pieces(data), list(languages), np.frombuffer(p).reshape(-1, max(1, len(languages)))[:, : len(languages)])


def identified(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, lang, code, main, confidence, lines) of every non-blank document of (doc_id, text, lang); ``code`` is what
    its label names, '' if nothing; ``lines`` holds (line_no, lang, confidence) of each of its non-blank lines."""
    data, languages, p = train(documents, vocabulary)
    shared = documents.sparkSession.sparkContext.broadcast((data, tuple(languages), np.ascontiguousarray(p).tobytes()))  # fixed: pieces x languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data_, languages_, p_ = shared.value
        model = _worker_model(str(len(p_)), data_, languages_, p_)
        for batch in batches:
            rows = [r for r in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True) if r[1] and r[1].strip()]
            found: list = []
            for k in range(0, len(rows), 512):
                found += all_segments([r[1] for r in rows[k : k + 512]], model)
            mains = [main_language(parts) for parts in found]
            flat = [x for parts in found for x in parts]
            ends = np.cumsum([0, *(len(parts) for parts in found)])
            lines = pa.StructArray.from_arrays([pa.array([x[k] for x in flat], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.float64()))], names=["line_no", "lang", "confidence"])
            own = {"doc_id": pa.array([r[0] for r in rows], pa.int64()), "lang": pa.array([r[2] for r in rows], pa.string()), "code": pa.array([label_code(r[2]) or "" for r in rows], pa.string())}
            own |= {"main": pa.array([m[0] for m in mains], pa.string()), "confidence": pa.array([m[1] for m in mains], pa.float64()), "lines": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), lines)}
            yield pa.RecordBatch.from_arrays(list(own.values()), names=list(own))

    schema = "doc_id bigint, lang string, code string, main string, confidence double, lines array<struct<line_no: bigint, lang: string, confidence: double>>"
    return documents.select(F.col("doc_id").cast("bigint"), "text", "lang").mapInArrow(run, schema)


def corrections(found: DataFrame) -> DataFrame:
    """(doc_id, line_no, lang): line 0 with the main language where the label is missing or another's, and every line of documents
    in more than one language."""
    wrong = found.where("code <> main").select("doc_id", F.lit(0).cast("bigint").alias("line_no"), F.col("main").alias("lang"))
    several = F.size(F.array_distinct(F.filter("lines.lang", lambda v: v != UNKNOWN))) > 1
    each = found.where(several).select("doc_id", F.explode("lines").alias("x")).select("doc_id", "x.line_no", "x.lang")
    return wrong.union(each)
