import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import boilerplate, repeated_lines, residue, residue_rows

PAGE = "id bigint, host string, body string, headline string, url string"
WORDS = "company board profit quarter plant order debt share margin bank court sale bond price unit loan port gas copper grain".split()


def sentence(rnd):
    return " ".join(["The", rnd.choice(WORDS), "said", "that", *rnd.choices(WORDS, k=12), "in", "the", rnd.choice(WORDS), "of", "its", rnd.choice(WORDS)]) + "."


def article(rnd):
    title = " ".join(x.capitalize() for x in rnd.choices(WORDS, k=7))
    return title, [sentence(rnd) for _ in range(3)]


@pytest.fixture(scope="module")
def site():
    rnd = random.Random(5)
    rows, matter = [], {}
    for i in range(240):
        host = "ab"[i % 2]
        title, text = article(rnd)
        top = ["Home | Markets | Money"] if host == "a" else ["<ul><li>Home</li><li>Tech</li></ul>"]
        bottom = [f"Tags: {rnd.choice(WORDS)}, {rnd.choice(WORDS)}", f"Follow Site {host.upper()} for live updates", "Copyright 2024 Some House. All rights reserved by the owner of this site and its many partners."]
        middle = ["What next"] if i % 3 == 0 else []
        lines = top + text[:2] + middle + text[2:] + bottom
        rows.append((i, host, "\n".join(lines), title, f"https://{host}/{'-'.join(title.lower().split())}-{i}.html"))
        matter[i] = {1} | set(range(len(lines) - 2, len(lines) + 1))
    return rows, matter


def test_page_matter(spark, site):
    rows, matter = site
    marked = boilerplate.mark(spark.createDataFrame(rows, PAGE))
    got: dict[int, set[int]] = {}
    for r in boilerplate.page_matter(marked).collect():
        got.setdefault(r.id, set()).add(r.line_no)
    assert got == matter


def test_join_path_equals_broadcast_path(spark, site, monkeypatch):
    rows, _ = site
    df = spark.createDataFrame(rows, PAGE)
    want = {tuple(r) for r in boilerplate.page_matter(boilerplate.mark(df)).collect()}
    original = boilerplate.recurring
    monkeypatch.setattr(boilerplate, "recurring", lambda parsed: original(parsed, most=0))
    assert {tuple(r) for r in boilerplate.page_matter(boilerplate.mark(df)).collect()} == want


def test_null_empty_long_and_repeated(spark, site):
    rows, _ = site
    extra = [(900, None, None, None, None), (901, "a", "", "", ""), (902, "a", "\n \n", "x", None), (903, "a", "word " * 60_000, None, None), (904, "a", "\n" * 9000, None, None)]
    df = spark.createDataFrame(rows + extra + rows[:1], PAGE)
    marked = boilerplate.mark(df)
    assert marked.count() == len(rows) + 6
    assert boilerplate.main_content(df.where("id = 901"), marked).first().article == ""
    assert boilerplate.mark(df.limit(0)).count() == 0


def test_residue_rows(spark, site):
    rows, _ = site
    odd = [
        (1001, "a", "Please enable JavaScript in your browser to go on reading.", "Some Title Here", "https://a/other-words-entirely-1.html"),
        (1002, "b", rows[0][2].replace(" said ", " said {{company}} "), rows[0][3], rows[0][4]),
        (1003, "b", rows[1][2], "Page not found", rows[1][4]),
        (1004, "a", "Lorem ipsum dolor sit amet. Replace this text.", rows[2][3], rows[2][4]),
        (1005, "a", rows[3][2] + "\nThe portal answered with a 404 error for ten minutes, the board said in a note to the holders.", rows[3][3], rows[3][4]),
        (1006, "a", None, None, None),
        (1007, "a", "Home | Markets | Money\nError 503\nThe server is busy right now. Please try again in a few minutes.", rows[4][3], rows[4][4]),
    ]
    got = {(r.id, r.field) for r in residue_rows.found(spark.createDataFrame(rows + odd, PAGE)).collect()}
    assert got == {(1001, "body"), (1002, "body"), (1003, "headline"), (1004, "body"), (1007, "body")}


def test_residue_in_any_wording(spark, site):
    """Responses, filler and notices in words that no list could hold, short and long, with page matter around or not; an article that
    uses the same words is none, nor is one whose address tells nothing."""
    rows, _ = site
    rnd = random.Random(3)
    made = "zorble gantry handshake refused kindly revisit tide quell nimbus vortan spindle lattice".split()
    odd, want = [], set()
    for k in range(8):
        title, _ = article(rnd)
        i = 2000 + k
        message = "The gantry refused your handshake. Kindly revisit after the tide." if k % 2 else " ".join(rnd.choices(made, k=90)).capitalize() + "."
        body = message if k < 4 else rows[k][2].split("\n")[0] + "\n" + message + "\n" + rows[k][2].split("\n")[-1]
        odd.append((i, "ab"[k % 2], body, title, f"https://a/{'-'.join(title.lower().split())}-{i}.html"))
        want.add((i, "body"))
        odd.append((i + 100, "ab"[k % 2], rows[k][2], "Kindly revisit the gantry", rows[k][4]))
        want.add((i + 100, "headline"))
    title, text = article(rnd)
    odd.append((3000, "a", "\n".join([*text, "The gantry refused the handshake, the board said of its tide plant.", text[0]]), title, f"https://a/{'-'.join(title.lower().split())}.html"))
    odd.append((3001, "a", "\n".join(text), title, None))
    assert {(r.id, r.field) for r in residue_rows.found(spark.createDataFrame(rows + odd, PAGE)).collect()} == want


@pytest.mark.parametrize("text", ["{{headline}}", "a %%LEDE%% b", "${story.summary}", "<%= title %>", "[INSERT QUOTE HERE]", "[[TICKER]]", "<!-- BODY_TEXT -->", "#{percent_change}", "rival {0} crore", "@@dateline@@", "TK TK", "$COMPANY_SHORT", "[object Object]", "TODO: add figures"])
def test_placeholders(text):
    assert residue.unfilled(f"before {text} after")


@pytest.mark.parametrize("text", ["Profit rose 5% to Rs 1,200 crore", "a $5 share", "the [sic] note", 'named "null" in error', "x < y and y > z", "up 10%, said the desk"])
def test_no_placeholders(text):
    assert not residue.unfilled(text)


def brute_repeated(rows):
    out, keys = set(), {}
    for i, s, t in rows:
        if s is not None:
            for n, line in enumerate((t or "").split("\n"), 1):
                k = "".join(c for c in line if c.isalpha()).lower()
                if k and t is not None:
                    keys.setdefault((s, k), {}).setdefault(i, []).append(n)
    for (s, _), held in keys.items():
        n = sum(1 for _, x, _ in rows if x == s)
        if len(held) >= 3 and len(held) * 20 >= n:
            out |= {(i, k) for i, ns in held.items() for k in ns}
    return out


def test_repeated_lines(spark):
    rnd = random.Random(2)
    rows = []
    for i in range(300):
        s = rnd.choice(["x", "x", "y", None])
        lines = [sentence(rnd), "** Follow us!! **" if rnd.random() < 0.3 else "follow  us", "Same everywhere 12", "...", "Rare note" if i < 2 else sentence(rnd)]
        rows.append((i, s, rnd.choice(["\n".join(lines)] * 8 + [None, ""])))
    df = spark.createDataFrame(rows, "id bigint, source string, text string")
    want = brute_repeated(rows)
    assert {tuple(r) for r in repeated_lines.repeated(df).collect()} == want
    freed = {r.id: r.text for r in repeated_lines.without_repeated(df).collect()}
    for i, s, t in rows:
        kept = t if t is None or s is None else "\n".join(x for n, x in enumerate(t.split("\n"), 1) if (i, n) not in want)
        assert freed[i] == kept
    assert repeated_lines.repeated(df.limit(0)).count() == 0


def test_extra_columns(spark, site):
    df = spark.createDataFrame(site[0][:40], PAGE).withColumn("drop", F.lit(1)).withColumn("flags", F.lit("x"))
    assert boilerplate.mark(df).count() == 40
