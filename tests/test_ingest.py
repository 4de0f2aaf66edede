from datetime import date

from pyspark.sql import functions as F

from tidemark import unlisted
from tidemark.functions import scorers as C
from tidemark.operators import indices, market, revisions
from tidemark.sources import discovery, feeds, pages, robots
from tidemark.sources import strategies as S

PAGES = "site string, page string, text string"
A, Z = date(2024, 2, 1), date(2024, 2, 3)


def urlset(*rows):
    return "<urlset>" + "".join(f"<url><loc>{u}</loc>{f'<lastmod>{d}</lastmod>' if d else ''}</url>" for u, d in rows) + "</urlset>"


def test_strategies(spark):
    rows = [
        ("s", "index.xml", "<sitemapindex><sitemap><loc>/2024-February-1.xml</loc></sitemap><sitemap><loc>/2024-March-1.xml</loc></sitemap></sitemapindex>"),
        ("s", "/2024-February-1.xml", urlset(("a&amp;1", "2024-02-02"), ("late", "2024-02-09"), ("undated", None))),
        ("s", "/2024-March-1.xml", urlset(("other", "2024-02-02"))),
        ("s", "d-2024-02-01", urlset(("one", None))), ("s", "d-2024-02-03", ""), ("s", "d-2024-02-02", None),
        ("s", "20240201_1", urlset(("p1", None))), ("s", "20240201_2", urlset(("p2", None))), ("s", "20240202_2", urlset(("gap", None))),
        ("s", "n-1.xml", urlset(("new", "2024-02-03"), ("undated", None))), ("s", "n-2.xml", urlset(("old", "2024-01-01"), ("edge", "2024-01-31"))), ("s", "n-3.xml", urlset(("never", "2024-02-02"))),
    ]
    found = spark.createDataFrame(rows, PAGES)
    got = lambda df: {r.url for r in df.collect()}
    assert got(S.by_index(found, ["index.xml"], r"/(\d{4}-[A-Za-z]+)-\d+\.xml$", S.months_of(A, Z, "%Y-%B"), A, Z)) == {"a&1", "undated"}
    assert got(S.by_day(found, "d-%Y-%m-%d", A, Z)) == {"one"}
    assert got(S.by_day_parts(found, "%Y%m%d_{part}", A, Z)) == {"p1", "p2"}
    assert got(S.by_walk(found, r"n-(\d+)\.xml$", A, Z)) == {"new", "edge"}
    assert got(S.by_walk(found, r"n-(\d+)\.xml$", A, Z, most=1)) == {"new"}
    assert S.by_walk(found.limit(0), r"n-(\d+)\.xml$", A, Z).count() == 0
    assert S.probe_days(A, A) == [A] and S.probe_days(A, date(2024, 2, 10)) == [A, date(2024, 2, 8), date(2024, 2, 10)]


def test_fetched_once_counts_every_address(spark):
    wanted = spark.createDataFrame([(1, "s", "a"), (2, "t", "a"), (3, "s", "b"), (4, "s", "c"), (5, "s", "d"), (6, "s", "e")], "seq bigint, source string, url string")
    shown = spark.createDataFrame([("a", 200, "t", "h"), ("b", -1, None, None), ("c", 404, "t", "h"), ("d", 200, None, "h"), ("e", 200, "t", "")], "url string, status int, text string, headline string")
    items, counts = S.fetched_once(wanted, shown)
    assert [(r.seq, r.url) for r in items.collect()] == [(1, "a")]
    assert {r.outcome: r.addresses for r in counts.collect()} == {"ok": 1, "robots": 1, "http": 1, "parse": 1, "empty": 1}


def test_failing_source_leaves_the_others(spark):
    good = spark.createDataFrame([("u", A)], "url string, hint_date date")
    found, status = discovery.discovered(spark, {"g": lambda: good, "r": lambda: good.withColumn("url", F.raise_error(F.lit("x"))), "a": lambda: good.select("no")}, ["r", "g", "a", "z"])
    assert found.count() == 1 and status["g"] == "ok" and status["z"] == "unknown source" and status["r"].startswith("failed") and status["a"].startswith("failed")


def test_cache_after_gaps(spark):
    day = lambda k: date(2024, 1, k)
    item = "symbol string, url string, seq bigint, day date"
    cached = spark.createDataFrame([("A", "x", 1, day(1)), ("A", "y", 2, day(5)), ("A", "z", 3, day(2))], item)
    fresh = spark.createDataFrame([("A", "y2", 9, day(5)), ("A", "z", 8, day(5)), ("A", "z", 7, day(5))], item)
    gaps = spark.createDataFrame([("A", day(4), day(6))], "symbol string, start date, end date")
    assert {tuple(r) for r in revisions.replaced(cached, fresh, gaps, "day").select("url", "seq").collect()} == {("x", 1), ("y2", 9), ("z", 8)}
    segments = spark.createDataFrame([("A", day(1), day(3), ["p", "q"]), ("A", day(4), day(6), ["p"])], "symbol string, start date, end date, sources array<string>")
    asked = spark.createDataFrame([("A", day(1), day(7), ["q"])], "symbol string, start date, end date, wanted array<string>")
    left = revisions.gaps(revisions.sufficient(segments, asked), asked.select("symbol", "start", "end"))
    assert [(r.start, r.end) for r in left.collect()] == [(day(4), day(7))]


def test_scorers_are_pluggable(spark):
    class Loud:
        def ready(self):
            self.made = True

        def __call__(self, texts):
            return [(1.0, 0.0, 0.0) if "!" in t else (0.0, 0.5, 0.5) for t in texts]

    rows = spark.createDataFrame([(1, "up!", "flat " * 400), (2, None, None), (3, " ", "x!")], "seq bigint, headline string, body string")
    got = {r.seq: (r.score, r.label) for r in C.blended(rows, Loud()).collect()}
    assert got == {1: (0.4, "positive"), 2: (0.0, "neutral"), 3: (0.4, "positive")}
    moods = rows.select("seq", C.emotions(F.col("headline"), C.WordMoods()).alias("m")).collect()
    assert moods[1].m is None and moods[2].m is None and moods[0].m["neutral"] == 0.5


def test_page_selectors_and_outlet_names():
    long = "word " * 60
    page = f"<html><head><title>Deal done - The Paper</title></head><body><nav>{long}</nav><div class='x story'><script>no</script>{long}</div><p>a</p></body></html>"
    assert pages.parsed(page, ("#none", "div.story"), ("The Paper",))[:2] == ("Deal done", long.strip())
    assert pages.selected("<div id=a>short</div>", ("#a",)) == "" and pages.cleaned("A | B", ()) == "A | B"


def test_order_book_states():
    row = lambda v: f"<section id='insights'><table><tr><td>Order Book <span>Rs</span></td><td>{v}</td></tr></table></section>"
    assert discovery.order_book(row("1,200")) == ("available", 1200.0)
    assert discovery.order_book(row("")) == ("masked", None)
    assert discovery.order_book("<table><tr><td>Order Book</td><td>5</td></tr></table>") == ("not applicable", None) and discovery.order_book(None)[0] == "not applicable"


def test_significance_and_blanket(spark):
    x = spark.createDataFrame([(2.228138852, 10), (0.0, 5), (None, 5), (1.0, 0)], "t_stat double, df int")
    p = [r.p_value for r in market.significant(x).collect()]
    assert abs(p[0] - 0.05) < 1e-6 and p[1] == 1.0 and p[2] is None and p[3] is None
    rules = robots.rules(spark.createDataFrame([("a", 200, "User-agent: *\nDisallow: /"), ("b", 200, "User-agent: *\nDisallow: /\nAllow: /x"), ("c", 200, ""), ("d", 500, None)], "origin string, status int, text string"))
    assert {r.origin for r in robots.blanket(rules).collect()} == {"a", "d"}


def test_weekdays_and_timeline(spark):
    days = spark.createDataFrame([(date(2024, 2, k),) for k in range(1, 8)], "d date").select(indices.next_weekday(F.col("d")).alias("n"))
    assert [r.n.day for r in days.collect()] == [2, 5, 5, 5, 6, 7, 8]
    frame = spark.createDataFrame([("A", date(2024, 1, 1), 10.0), ("A", date(2024, 1, 2), 10.0), ("A", date(2024, 1, 9), 13.0)], "symbol string, date date, close double")
    news = spark.createDataFrame([("A", 1, "<Big> deal", date(2024, 1, 5), 0.9, 0.9)], "symbol string, seq bigint, headline string, published_local_date date, sentiment_score double, relevance_score double")
    found = unlisted.bundle(spark, frame, news, "A", "2024-01-01", "2024-02-01")
    assert found["moves"][0]["size"] == "very large" and found["moves"][0]["headlines"] == ["<Big> deal"]
    assert "rose by 30.0%" in unlisted.narrative(found)[1] and "&lt;Big&gt;" in unlisted.html(found)


def test_provider_symbol(spark):
    got = spark.createDataFrame([("TCS.NS",), ("^IDX",), (None,)], "s string").select(feeds.provider_symbol(F.col("s")).alias("s")).collect()
    assert [r.s for r in got] == ["TCS.BSE", "IDX", None]
