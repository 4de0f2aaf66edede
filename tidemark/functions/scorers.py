"""Scorers of tone and emotion that a model can be plugged into, and small word-count ones that stand in where no model is installed.

A tone scorer takes a list of texts and gives (positive, negative, neutral) probabilities each; an emotion scorer gives a probability by
label each. A scorer is shipped to the tasks, made ready once a worker (``ready``), and sees Arrow batches of texts. Null and blank
texts are never shown to it: they have no score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as T

#: Words that the stand-ins count (fixed values).
GOOD = ("gained", "climbed", "jumped", "advanced", "added", "improved", "doubled", "widened")
BAD = ("fell", "dropped", "lost", "slid", "eased", "shed", "narrowed", "slipped")
MOODS = {"joy": ("record", "wins", "gains"), "fear": ("probe", "risk", "fears"), "surprise": ("sudden", "unexpected", "jumps"), "sadness": ("loss", "dies", "falls")}
#: Weight of the headline beside the body, the tone at which a label begins, and words of a chunk.
HEADLINE, LABEL_FROM, CHUNK = 0.6, 0.15, 300


class ToneScorer(Protocol):
    def ready(self) -> None: ...

    def __call__(self, texts: list[str]) -> list[tuple[float, float, float]]: ...


class EmotionScorer(Protocol):
    def ready(self) -> None: ...

    def __call__(self, texts: list[str]) -> list[dict[str, float]]: ...


class WordTone:
    """Good and bad words against one: a deterministic stand-in for a model."""

    def ready(self) -> None:
        self.good, self.bad = (re.compile(rf"\b(?:{'|'.join(w)})\b") for w in (GOOD, BAD))

    def __call__(self, texts: list[str]) -> list[tuple[float, float, float]]:
        out = []
        for t in texts:
            g, b = len(self.good.findall(t.lower())), len(self.bad.findall(t.lower()))
            out.append((g / (g + b + 1), b / (g + b + 1), 1 / (g + b + 1)))
        return out


class WordMoods:
    """A probability that grows with a mood's words; neutral is even: a deterministic stand-in for a model."""

    def ready(self) -> None:
        self.moods = {m: re.compile(rf"\b(?:{'|'.join(w)})\b") for m, w in MOODS.items()}

    def __call__(self, texts: list[str]) -> list[dict[str, float]]:
        return [{"neutral": 0.5} | {m: 1 - 0.6 ** len(p.findall(t.lower())) for m, p in self.moods.items()} for t in texts]


def _blank(t: object) -> bool:
    return not isinstance(t, str) or not t.strip()


def tone(column: Column, scorer: ToneScorer) -> Column:
    """A struct (score, confidence) of a text: positive less negative, and the largest probability; null for blank texts."""

    @F.pandas_udf("score double, confidence double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer.ready()
        for b in batches:
            out = pd.DataFrame({"score": [None] * len(b), "confidence": [None] * len(b)}, dtype="float64")
            at = [k for k, t in enumerate(b) if not _blank(t)]
            p = scorer([b.iloc[k] for k in at])
            out.loc[at, "score"], out.loc[at, "confidence"] = [x[0] - x[1] for x in p], [max(x) for x in p]
            yield out

    return run(column)


def emotions(column: Column, scorer: EmotionScorer) -> Column:
    """The probability by label of a text, as a map; null for blank texts."""

    @F.pandas_udf("map<string, double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer.ready()
        for b in batches:
            at = [k for k, t in enumerate(b) if not _blank(t)]
            found = dict(zip(at, scorer([b.iloc[k] for k in at]), strict=True))
            yield pd.Series([found.get(k) for k in range(len(b))])

    return run(column)


def blended(items: DataFrame, scorer: ToneScorer, size: int = CHUNK) -> DataFrame:
    """(seq, score, label) of (seq, headline, body): the headline's tone and that of the body's chunks, weighted by confidence. Without a
    scored chunk the headline counts alone, without a headline it counts 0."""
    parts = items.select("seq", F.posexplode_outer(T.chunks(F.col("body"), size)).alias("k", "chunk")).withColumn("t", tone(F.col("chunk"), scorer))
    body = parts.groupBy("seq").agg(F.try_divide(F.sum(F.col("t.score") * F.col("t.confidence")), F.sum("t.confidence")).alias("body_score"))
    x = items.select("seq", F.coalesce(tone(F.col("headline"), scorer)["score"], F.lit(0.0)).alias("head")).join(body, "seq")
    total = F.round(F.when(F.col("body_score").isNull(), F.col("head")).otherwise(HEADLINE * F.col("head") + (1 - HEADLINE) * F.col("body_score")), 4)
    return x.select("seq", total.alias("score"), F.when(total > LABEL_FROM, "positive").when(total < -LABEL_FROM, "negative").otherwise("neutral").alias("label"))
