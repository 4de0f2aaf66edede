"""What the passes over pages and examples hand on, and that the shorter ways in them say the same as the plain ones."""

import random

import numpy as np
from test_pages import PAGE, article
from test_whole import VALUES

from tidemark.llm import boilerplate, page_lines, residue, truncation


def test_pages_have_joined_columns_only(spark):
    """Arrays that are null for every page cost each pass more than the pages themselves."""
    rnd = random.Random(6)
    rows = [(i, "a", "\n".join(text), title, f"https://a/{'-'.join(title.lower().split())}.html") for i, (title, text) in enumerate(article(rnd) for _ in range(20))]
    assert not {"hits", "inner", "outer", "said", "head_said", "again_said"} & set(boilerplate.fit(spark.createDataFrame(rows, PAGE)).pages.columns)


def test_fit_passes_over_few_rows(spark, monkeypatch):
    sets = [(bytearray(np.array([0, k, 7000 + k % 50], np.int16).tobytes()), k % 3, 1 + k % 2) for k in range(1, 5000)]
    seen = []
    plain = truncation._loss_of
    monkeypatch.setattr(truncation, "_loss_of", lambda table, w: seen.append(table.count()) or plain(table, w))
    truncation.fit(spark.createDataFrame(sets, "slots binary, intact bigint, cut bigint").coalesce(1), most=0)
    assert seen and max(seen) == 1


def test_words_of_lines_at_once(monkeypatch):
    monkeypatch.setattr(boilerplate, "LINES", 3)
    lines = ["Profit_rose 5.5% (net)", "", "Ünïcode_text\tİstanbul ΟΔΟΣ", "…", "a\x1cb\rc", "नमस्ते दुनिया। 12³", "...", "x"]
    lows = [t.lower() for t in lines]
    hashes, counts = boilerplate._hashed(lows, boilerplate._Tokens())
    want = [[page_lines.small(w) for w in residue.tokens(t)] for t in lines]
    assert counts.tolist() == [len(w) for w in want]
    assert hashes.tolist() == [h for w in want for h in w]
    assert [len(x) for x in boilerplate._hashed([], boilerplate._Tokens())] == [0, 0]


def test_marks_of_cuts():
    rnd = random.Random(2)
    parts = ["...", "…", " ", "[", "]", "[+12 chars]", "chars]", "(more)", "�", "Read more", "word", ".", " \x1c", "\n"]
    for _ in range(20_000):
        text = "".join(rnd.choices(parts, k=rnd.randrange(9))).rstrip()
        assert truncation._without_cut_mark(text) == page_lines.CUT_MARK.sub("", text)


def test_limits_of_long_ends(spark):
    """Closers and blanks behind a sentence keep it closed, however many; an open text is none of a closed length."""
    rows = [(i, "s", None, "It rose." + ")" * 100 + " " * 20, "It rose" + ")" * 92 + "\n", None) for i in range(9)] + [(i, "s", None, None, "", None) for i in range(9, 12)]
    assert truncation.limits_of(spark.createDataFrame(rows, VALUES)) == {"body": [], "snippet": [100]}
