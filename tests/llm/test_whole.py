"""What the page model and the classifier of cut values learn is counted over all rows."""

import random

import numpy as np
import pytest
from test_pages import PAGE, article

from tidemark.llm import boilerplate, residue_rows, truncation

VALUES = "id bigint, source string, headline string, body string, snippet string, url string"


@pytest.fixture(scope="module")
def pages():
    rnd = random.Random(8)
    rows = []
    for i in range(150):
        title, text = article(rnd)
        rows.append((i, "ab"[i % 2], "\n".join(text), title, f"https://a/{'-'.join(title.lower().split())}-{i}.html"))
    for i in range(200, 206):
        title, _ = article(rnd)
        rows.append((i, "a", f"The gantry refused your handshake {i} times. Kindly revisit after the tide.", title, f"https://a/{'-'.join(title.lower().split())}-{i}.html"))
        rows.append((i + 100, "b", rows[i - 200][2], "Kindly revisit the gantry", rows[i - 200][4]))
    return rows


@pytest.mark.parametrize("words", [boilerplate.__dict__.get("WORD_ROWS", 0), 0])
def test_words_of_all_pages(spark, pages, monkeypatch, words):
    """A page or headline is known by words of other pages, whichever those are; shipped words and joined ones say the same."""
    monkeypatch.setattr(boilerplate, "SAMPLE_PAGES", 1, raising=False)
    monkeypatch.setattr(boilerplate, "WORD_ROWS", words, raising=False)
    got = {(r.id, r.field) for r in residue_rows.found(spark.createDataFrame(pages, PAGE)).collect()}
    assert got == {(i, "body") for i in range(200, 206)} | {(i, "headline") for i in range(300, 306)}


def values(count):
    rnd = random.Random(4)
    words = "company board profit quarter plant order debt share margin bank court sale bond price unit loan port gas copper grain".split()
    rows = []
    for i in range(count):
        text = " ".join(" ".join(["The", *rnd.choices(words, k=9), "rose"]) + "." for _ in range(4))
        title = " ".join(w.capitalize() for w in rnd.choices(words, k=5)) + " Update"
        rows.append((i, "s", title, text, title if i % 2 else text[: rnd.randrange(60, 90)], f"https://s/{i}"))
    return rows


def test_every_row_is_an_example(spark, monkeypatch):
    """A close that only some rows teach is known wherever those stand: an unclosed title counts as whole."""
    monkeypatch.setattr(truncation, "SAMPLE_ROWS", 0, raising=False)
    scored = truncation.scored(spark.createDataFrame(values(200), VALUES)).where("field = 'snippet' and id % 2 = 1").collect()
    assert len(scored) == 100
    assert all(r.probability < truncation.CUT_FROM for r in scored)


def test_fit_on_tasks_equals_fit_on_driver(spark):
    counts: dict[bytes, list[int]] = {}
    for x, label in truncation.examples([(r[0], r[2], r[3], r[4]) for r in values(150)], {"body": [], "snippet": []}):
        counts.setdefault(np.array(x, np.int16).tobytes(), [0, 0])[label] += 1
    df = spark.createDataFrame([(bytearray(x), *c) for x, c in counts.items()], "slots binary, intact bigint, cut bigint").repartition(3)
    here, there = truncation.fit(df), truncation.fit(df, most=0)
    assert np.abs(here).sum() > 10
    assert np.allclose(here, there, atol=1e-6)
