from datetime import date

from pyspark.sql import functions as F

from tidemark.sources import feeds, pages, robots


def test_sitemap_forms(spark):
    xml = "<urlset><url><loc><![CDATA[ https://a/x?p=1&amp;q=2 ]]></loc><lastmod>2023-01-25T10:00:00Z</lastmod></url><url><loc>https://a/y</loc><lastmod>bad</lastmod></url><url><loc>https://a/z</loc></url></urlset>"
    df = spark.createDataFrame([(1, xml), (2, "<x><loc>https://b</loc></x>"), (3, ""), (4, None)], "id int, text string")
    assert sorted((r.url, r.lastmod) for r in feeds.blocks(df).where("id = 1").collect() if r.lastmod) == [("https://a/x?p=1&q=2", date(2023, 1, 25))]
    assert {r.url for r in feeds.blocks(df).collect()} == {"https://a/x?p=1&q=2", "https://a/y", "https://a/z", "https://b"}
    assert feeds.locations(df).count() == 4


def test_walk_and_unbroken(spark):
    files = spark.createDataFrame([(1, date(2024, 3, 1)), (2, date(2024, 2, 1)), (3, date(2024, 1, 1)), (4, date(2023, 12, 1))], "number int, oldest date")
    assert sorted(r.number for r in feeds.walked(files, "2024-02-15").collect()) == [1, 2]
    parts = spark.createDataFrame([("d", 1, True), ("d", 2, False), ("d", 3, True)], "day string, part int, found boolean")
    assert [r.part for r in feeds.unbroken(parts).collect()] == [1]


def test_robots(spark):
    text = "User-agent: *\nDisallow: /private\nAllow: /private/open\nCrawl-delay: 3\n\nUser-agent: NewsBot\nUser-agent: other\nDisallow: /*.pdf$\nDisallow: /x\nAllow: /x\n# end"
    r = robots.rules(spark.createDataFrame([("o", 200, text), ("shut", 500, None)], "origin string, status int, text string"))
    req = [(1, "o", "/private/a", "curl"), (2, "o", "/private/open/1", "curl"), (3, "o", "/a.pdf", "newsbot/2.0"), (4, "o", "/a.pdf?x", "newsbot/2.0"), (5, "o", "/x", "NewsBot"), (6, "shut", "/", "curl"), (7, "none", "/", "curl"), (8, "o", "/private/a", "newsbot")]
    got = {x.id: x.allowed for x in robots.decided(spark.createDataFrame(req, "id int, origin string, path string, agent string"), r).collect()}
    assert got == {1: False, 2: True, 3: False, 4: True, 5: True, 6: False, 7: True, 8: True}
    assert {x.delay for x in r.where("agent = '*' and origin = 'o'").collect()} == {3.0}


def test_pages(spark):
    body = "One sentence of the story that is long enough. " * 6
    ld = f'<html><script type="application/ld+json">{{"@graph":[{{"@type":["NewsArticle"],"headline":"H","articleBody":"{body}","datePublished":"2023-01-25T10:00:00+05:30"}}]}}</script></html>'
    dom = '<html><head><meta property="og:title" content="Meta title"><meta name="publish-date" content="2023-01-26"></head><body><nav><p>menu</p></nav><article><p>First para.</p><p>Second.</p><p>Third.</p></article><div><p>x</p></div></body></html>'
    df = spark.createDataFrame([("a", ld), ("b", dom), ("c", ""), ("d", None), ("e", "<script type='application/ld+json'>{bad</script><title>T | Site</title>")], "url string, text string")
    got = {r.url: r for r in pages.extracted(df).collect()}
    assert got["a"].headline == "H" and got["a"].body == body.strip() and got["a"].published.startswith("2023-01-25")
    assert got["b"].headline == "Meta title" and got["b"].body == "First para. Second. Third." and got["b"].published == "2023-01-26"
    assert got["c"].headline == "" and got["d"].body == "" and got["e"].headline == "T"


def test_price_files_and_series(spark, tmp_path):
    (tmp_path / "A.csv").write_text("Date,Close,Volume\n2024-01-02,10,5\n2024-01-03,,6\n")
    (tmp_path / "_idx_N.csv").write_text("Date,Close,Volume\n2024-01-02,7,\n")
    got = {(r.symbol, str(r.date)): (r.close, r.volume) for r in feeds.price_files(spark, str(tmp_path), "2024-01-01", "2024-01-03").collect()}
    assert got == {("A", "2024-01-02"): (10.0, 5.0), ("A", "2024-01-03"): (None, 6.0), ("^N", "2024-01-02"): (7.0, None)}
    page = spark.createDataFrame([("p", '[{"date":"2024-01-01","price":"5"},{"date":"2024-01-01","price":"6.5"},{"date":"2024-01-02","price":"7"}]')], "name string, text string")
    assert {(str(r.date), r.close) for r in feeds.embedded_series(page).collect()} == {("2024-01-01", 6.5), ("2024-01-02", 7.0)}


def test_bundle_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, "h1", "b1"), (2, "h2", None)], "seq bigint, headline string, body string").select("seq", "headline", "body", F.lit("2024-01-01T10:00:00+05:30").alias("published_at"))
    feeds.save_bundle(rows, str(tmp_path / "x"), "C", "C.NX")
    back = feeds.news_bundle(spark, str(tmp_path / "x" / "*.json")).orderBy("seq").collect()
    assert [(r.headline, r.body) for r in back] == [("h1", "b1"), ("h2", None)] and str(back[0].published_at) == "2024-01-01 04:30:00" and back[0].staleness_score is None


def test_answers(spark):
    chart = '{"chart":{"result":[{"meta":{"symbol":"A.NX"},"timestamp":[1704171600],"indicators":{"quote":[{"close":[5.5],"volume":[9]}]}}]}}'
    assert [(r.symbol, str(r.date), r.close) for r in feeds.chart_json(spark.createDataFrame([(chart,)], "text string")).collect()] == [("A.NX", "2024-01-02", 5.5)]
    daily = '{"Meta Data":{"2. Symbol":"A.B"},"Time Series (Daily)":{"2024-01-02":{"4. close":"3.5"}}}'
    assert [(r.symbol, r.close) for r in feeds.daily_map_json(spark.createDataFrame([(daily,)], "text string")).collect()] == [("A.B", 3.5)]
    snap = spark.createDataFrame([('{"archived_snapshots":{"closest":{"available":true,"url":"u","timestamp":"20230105120000"}}}', date(2023, 1, 1)), ('{"archived_snapshots":{"closest":{"available":true,"url":"u","timestamp":"bad"}}}', date(2023, 1, 1)), ("{}", date(2023, 1, 1))], "text string, requested date")
    assert [r.captured for r in feeds.closest_snapshots(snap).collect()] == [date(2023, 1, 5), date(2023, 1, 1), None]
