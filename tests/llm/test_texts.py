import os
import random

import pytest

from tidemark.llm import language, leakage, truncation

WORDS = [f"{a}{b}" for a in "bar cor den fal gam hul jin kor lem mon nar pel".split() for b in "o es ing ad ul ent".split()]


def text(rnd, n):
    return " ".join(rnd.choices(WORDS, k=n))


def test_leakage(spark):
    rnd = random.Random(1)
    items = [(k, text(rnd, 60)) for k in range(12)] + [(50, None), (51, ""), (52, "short one only")]
    w = items[0][1].split()
    edited = w[:]
    edited[15] = "changed"
    del edited[40]
    docs = [
        (1, text(rnd, 40) + " " + items[0][1] + " " + text(rnd, 30)),
        (2, text(rnd, 40) + "\n" + ", ".join(x.upper() for x in w[10:40]) + "\n" + text(rnd, 30)),
        (3, "<b>" + " ".join(edited).replace(" ", "\n", 5) + "</b>"),
        (4, text(rnd, 40) + " " + " ".join(w[5:20]) + " " + text(rnd, 40)),
        (5, text(rnd, 3000)), (6, None), (7, ""), (8, text(rnd, 20_000) + " " + items[3][1]),
        (9, " ".join(x + y for x, y in zip(w[::2], w[1::2], strict=True))),
    ]
    got = {tuple(r) for r in leakage.search(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert got == {(1, 0), (2, 0), (3, 0), (8, 3), (9, 0)}
    assert leakage.search(spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).count() == 0
    assert leakage.search(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([], "item_id bigint, text string")).count() == 0


def test_leakage_after_dense_edits():
    """A verbatim stretch counts whatever shorter runs precede it."""
    rnd = random.Random(12)
    w = [a + b for a, b in zip(text(rnd, 70).split(), text(rnd, 70).split(), strict=True)]
    ix = leakage.index([(1, " ".join(w))])
    dense = [f"other{k}" if k < 42 and k % 5 == 4 else x for k, x in enumerate(w)]
    assert leakage.leaked(" ".join(w[42:]), ix) == [1]
    assert leakage.leaked(" ".join(dense), ix) == [1]
    assert leakage.leaked(" ".join(dense[:42]), ix) == []


def test_leakage_of_short_passages(spark):
    """Passages too short for q-grams are found whole, as words."""
    items = [(1, "GDP grew 7%"), (2, "Profit rose sharply"), (3, "Hi"), (4, None), (5, "?!")]
    docs = [(1, "It said GDP grew\n7 %, again."), (2, "profit ROSE sharply"), (3, "Nonprofit rose sharply; GDP grew 75"), (4, "Profit rose"), (5, "hi"), (6, "Delhi")]
    got = {tuple(r) for r in leakage.search(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert got == {(1, 1), (2, 2), (5, 3)}


@pytest.mark.parametrize(("words", "changes", "least"), [(25, [], 0.98), (25, [12], 0.98), (30, [5], 0.98), (45, [7, 15, 23, 31, 39], 0.98), (28, [9, 18], 0.95), (20, [], 0.0), (40, [3, 7, 11, 15, 19, 23, 27, 31, 35], 0.0)])
@pytest.mark.parametrize("kind", ["changed", "missing", "added"])
def test_leakage_recall(words, changes, least, kind):
    """Stretches of 25 words or more with single words changed, missing or added; shorter or denser ones are no cases."""
    rnd = random.Random(12)
    pool = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=rnd.randrange(2, 10))) for _ in range(3000)]
    items = [(k, " ".join(rnd.choices(pool, k=70))) for k in range(120)]
    ix, found = leakage.index(items), 0
    for k, t in items:
        w = t.split()
        at = rnd.randrange(70 - words)
        s = w[at : at + words]
        for c in reversed(changes):
            s[c : c + (kind != "added")] = [] if kind == "missing" else [rnd.choice(pool)]
        found += k in leakage.leaked(" ".join(rnd.choices(pool, k=40) + s + rnd.choices(pool, k=40)), ix)
    assert found >= least * len(items) if least else found <= 0.02 * len(items)


def test_leakage_in_parts(spark, monkeypatch):
    rnd = random.Random(2)
    items = [(k, text(rnd, 40)) for k in range(9)]
    docs = [(k, text(rnd, 10) + " " + t) for k, t in items]
    monkeypatch.setattr(leakage, "PASSAGES", 2)
    got = {tuple(r) for r in leakage.search(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert got == {(k, k) for k in range(9)}


@pytest.mark.parametrize(("label", "code"), [("EN", "en"), ("en-IN", "en"), ("English", "en"), ("hin", "hi"), ("pt_BR", "pt"), ("zxx", "und"), ("und", "und"), ("n/a", None), ("unknown", None), ("", None), (None, None), ("xx", None), ("nl", "nl"), ("Indonesian", "id")])
def test_labels(label, code):
    assert language.label_code(label) == code


SAMPLES = {
    "en": "the company said that the board will meet again in the third quarter and the shares fell",
    "de": "die Firma sagte dass der Vorstand sich im dritten Quartal wieder trifft und die Aktie verlor",
    "es": "la empresa dijo que el consejo se reunirá de nuevo en el tercer trimestre y la acción cayó",
    "hi": "कंपनी ने कहा कि निदेशक मंडल तीसरी तिमाही में फिर बैठेगा और शेयर गिर गया",
    "mr": "कंपनीने सांगितले की संचालक मंडळ तिसऱ्या तिमाहीत पुन्हा भेटेल आणि समभाग घसरला",
}


@pytest.mark.skipif(not os.path.exists(language.VOCABULARY), reason="vocabulary files are not here")
def test_twenty_thousand_spellings_of_labels(spark):
    docs = spark.range(20_000).selectExpr("id as doc_id", f"'{SAMPLES['en']}' as text", "if(id % 2 = 0, concat('en-', id), if(id % 20 = 1, concat('label ', id), concat('English (', id, ')'))) as lang")
    assert {tuple(r) for r in language.corrections(language.identified(docs)).collect()} == {(k, 0, "en") for k in range(1, 20_000, 20)}


@pytest.mark.skipif(not os.path.exists(language.VOCABULARY), reason="vocabulary files are not here")
def test_languages(spark):
    rnd = random.Random(9)
    make = lambda c, n=14: " ".join(rnd.choices(SAMPLES[c].split(), k=n))
    rows = [(100 * k + i, "\n".join(make(c) for _ in range(4)), {"en": "English", "de": "deu"}.get(c, c)) for k, c in enumerate(SAMPLES) for i in range(30)]
    rows += [(9001, make("de", 30), "en"), (9002, make("es"), None), (9003, make("en", 40) + "\n\n" + make("de"), "en"), (9004, "12 ; 34\n5.6", "en"), (9005, "12 ; 34", "zxx"), (9006, "", "en"), (9007, None, None), (9008, " \n", "xx"), (9009, make("hi") + "\n" + make("hi"), "mr"), (9010, make("en") * 500, "n/a")]
    found = language.identified(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    got = {tuple(r) for r in language.corrections(found).where("doc_id > 9000").collect()}
    assert got == {(9001, 0, "de"), (9002, 0, "es"), (9003, 1, "en"), (9003, 3, "de"), (9004, 0, "und"), (9009, 0, "hi"), (9010, 0, "en")}
    assert {r.main for r in found.where("doc_id < 9000 and doc_id >= 300 and doc_id < 400").collect()} == {"hi"}


def test_forward_sums_all_segmentations():
    import base64
    from itertools import product

    import numpy as np

    data = b"\n".join(base64.b64encode(x) + b" 0" for x in (b"ab", b"abc", b"bc", b"c"))
    pieces = language.Pieces(data)
    p = np.random.default_rng(0).random((len(pieces.id), 2))
    word, total = b"abcab", np.zeros(2)
    for cuts in product([0, 1], repeat=len(word) - 1):
        parts, start = [], 0
        for k, c in enumerate((*cuts, 1), 1):
            if c:
                parts.append(word[start:k])
                start = k
        if all(x in pieces.id for x in parts):
            total += np.prod([p[pieces.id[x]] for x in parts], axis=0)
    assert np.allclose(language.forward(pieces.lattice(word), p)[-1], total)


def test_own_end():
    assert truncation.own_end("It rose 5%. (ends)")[0] == "It rose 5%."
    assert truncation.own_end("the bank of … Read more") == ("the bank of", "c")
    assert truncation.own_end("It rose. More inside")[0] == "It rose."
    assert truncation.own_end("in the�")[0] == "in the"


def test_truncation(spark):
    rnd = random.Random(3)
    line = lambda: "The " + text(rnd, 14) + " of the " + text(rnd, 3) + "."
    rows, want = [], set()
    for i in range(400):
        body = [line() + " " + line(), line(), line() + " " + line()]
        snippet = body[0]
        if i % 10 == 0:
            body[-1] = body[-1][: len(body[-1]) - rnd.randrange(5, 40)].rstrip(" .")
            want.add((i, "body"))
        if i % 7 == 0:
            snippet = snippet[:120].rstrip(" .") + rnd.choice(["", "...", "… Read more"])
            want.add((i, "snippet"))
        title = text(rnd, 8)
        tail = ["Follow us for live updates of all markets"] if i % 2 else []
        rows.append((i, "s", title, "\n".join(body + tail), snippet, f"https://s/{title.replace(' ', '-')}-{i}.html"))
    rows += [(900, None, None, None, None, None), (901, "s", "", "", "", ""), (902, "s", "x", " \n", " ", None)]
    scored = truncation.scored(spark.createDataFrame(rows, "id bigint, source string, headline string, body string, snippet string, url string"))
    got = {(r.id, r.field) for r in scored.where("probability >= 0.5").collect()}
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 3
    assert truncation.report(scored).where("source = 's'").count() == 2
    assert truncation.scored(spark.createDataFrame([], "id bigint, source string, headline string, body string, snippet string, url string")).count() == 0
