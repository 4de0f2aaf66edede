"""Discovery, fetching and caching queries. What would be fetched is made in the query from the tables: sitemaps that list the news
addresses by day, answers and pages that carry the rows' values. Sites are runs of a thousand seq, so that no page grows with the data."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import market as M
from tidemark.operators import revisions as V
from tidemark.plans import market as P
from tidemark.sources import discovery as D
from tidemark.sources import feeds, pages, robots
from tidemark.sources import strategies as S
from tidemark.session import table, written

START, END = date(2024, 2, 1), date(2024, 2, 15)
#: Rows that one page or answer lists at most.
PAGE = 1000


def _listed(spark: SparkSession, d: str) -> DataFrame:
    """(site, seq, url, day) of the dated news."""
    x = table(spark, d, "news").where("url is not null and url <> '' and published_local_date is not null")
    return x.select(F.floor(F.col("seq") / PAGE).cast("string").alias("site"), "seq", "url", F.col("published_local_date").alias("day"))


def _sitemap(rows: DataFrame, tag: str = "url", dated: bool = True) -> DataFrame:
    """One sitemap a (site, page) of (site, page, seq, url, day)."""
    escaped = F.replace("url", F.lit("&"), F.lit("&amp;"))
    stamp = F.concat(F.lit("<lastmod>"), F.col("day").cast("string"), F.lit("T08:00:00+05:30</lastmod>")) if dated else F.lit("")
    block = F.concat(F.lit(f"<{tag}><loc><![CDATA["), escaped, F.lit("]]></loc>"), F.coalesce(stamp, F.lit("")), F.lit(f"</{tag}>"))
    listed = rows.withColumn("b", block).groupBy("site", "page").agg(F.array_sort(F.collect_list(F.struct("seq", "b"))).alias("bs"))  # at most PAGE
    return listed.select("site", "page", F.concat(F.lit("<urlset>"), F.array_join(F.transform("bs", lambda x: x["b"]), ""), F.lit("</urlset>")).alias("text"))


def _index(parts: DataFrame, page: str, tag: str = "sitemap") -> DataFrame:
    """The index of the pages of (site, page, day), dated by their newest entry."""
    x = parts.groupBy("site", "page").agg(F.max("day").alias("day")).withColumns({"url": F.col("page"), "seq": F.xxhash64("page")})
    return _sitemap(x.withColumn("page", F.lit(page)), tag)


def s8_locations(spark, d):
    """Addresses of undated sitemaps."""
    x = _listed(spark, d).withColumn("page", F.lit("map.xml"))
    return feeds.locations(_sitemap(x, dated=False)).select("site", "url")


def s9_blocks(spark, d):
    """Addresses with their dates, which every seventh row lacks and every eleventh has in a bad form."""
    x = _listed(spark, d).withColumn("page", F.lit("map.xml")).withColumn("day", F.when(F.col("seq") % 7 != 0, F.when(F.col("seq") % 11 == 0, "soon").otherwise(F.col("day").cast("string"))))
    return feeds.blocks(_sitemap(x)).select("site", "url", "lastmod")


def s10_index(spark, d):
    """Part files of an index with their dates."""
    x = _listed(spark, d).withColumn("page", F.date_format("day", "yyyy-MM"))
    return feeds.blocks(_index(x, "index.xml"), "sitemap").select("site", "url", "lastmod")


def s12_month_parts(spark, d):
    x = _listed(spark, d).withColumn("page", F.concat(F.lit("maps/"), F.date_format("day", "yyyy-MMMM"), F.lit("-1.xml")))
    found = _sitemap(x).unionByName(_index(x, "index.xml"))
    return S.by_index(found, ["index.xml"], r"/(\d{4}-[A-Za-z]+)-\d+\.xml$", S.months_of(START, END, "%Y-%B"), START, END)


def s13_days_by_query(spark, d):
    x = _listed(spark, d).withColumn("page", F.date_format("day", "'sitemap.xml?yyyy='yyyy'&mm='MM'&dd='dd"))
    return S.by_day(_sitemap(x), "sitemap.xml?yyyy=%Y&mm=%m&dd=%d", START, END)


def s14_day_parts(spark, d):
    x = _listed(spark, d).withColumn("page", F.concat(F.date_format("day", "yyyyMMdd"), F.lit("_"), F.col("seq") % 4 + 1, F.lit(".xml")))
    return S.by_day_parts(_sitemap(x), "%Y%m%d_{part}.xml", START, END)


def s15_year_months(spark, d):
    x = _listed(spark, d).withColumn("page", F.concat(F.lit("post-"), F.date_format("day", "yyyy-MM"), F.lit(".xml")))
    found = _sitemap(x).unionByName(_index(x, "index-2024.xml"))
    return S.by_index(found, [f"index-{y}.xml" for y in range(START.year, END.year + 1)], r"post-(\d{4}-\d{2})\.xml$", S.months_of(START, END, "%Y-%m"), START, END)


def s16_days_with_margin(spark, d):
    """Pages a day whose entries were changed up to two days later."""
    x = _listed(spark, d).withColumn("page", F.date_format("day", "'stories.xml?d='yyyy-MM-dd")).withColumn("day", F.date_add("day", (F.col("seq") % 3).cast("int")))
    return S.by_day(_sitemap(x), "stories.xml?d=%Y-%m-%d", START, END, lastmod=True)


def s17_day_pages(spark, d):
    x = _listed(spark, d).withColumn("page", F.date_format("day", "'sitemap_'yyyy-MM-dd'.xml'"))
    return S.by_day(_sitemap(x), "sitemap_%Y-%m-%d.xml", START, END)


def s18_walk(spark, d):
    """Files of a week each, the newest first; one site lacks every second number."""
    x = _listed(spark, d)
    week = F.date_trunc("week", "day")
    x = x.withColumn("n", F.dense_rank().over(Window.partitionBy("site").orderBy(F.desc(week))))  # at most PAGE rows
    x = x.withColumn("page", F.concat(F.lit("article-"), F.when(F.col("site") != "1", F.col("n")).otherwise(2 * F.col("n") - 1).cast("string"), F.lit(".xml")))
    return S.by_walk(_sitemap(x), r"article-(\d+)\.xml$", START, END)


def s19_archive(spark, d):
    """Numbered files of ten days each, oldest first, and an unnumbered one that is never read."""
    x = _listed(spark, d).withColumn("n", F.floor(F.datediff("day", F.lit("2023-12-01")) / 10))
    x = x.withColumn("page", F.concat(F.lit("/post-sitemap"), F.when(F.col("n") == 5, "").otherwise(F.col("n").cast("string")), F.lit(".xml")))
    return S.by_archive(_sitemap(x).unionByName(_index(x, "index.xml")), "index.xml", r"/post-sitemap\d+\.xml$", START, END)


def s20_dispatch(spark, d):
    """Four sources: one lists its addresses, one has none, one fails while it runs, one is unknown."""
    x = _listed(spark, d).select("url", F.col("day").alias("hint_date"))
    made = {"good": lambda: x, "none": lambda: x.where("false"), "broken": lambda: x.withColumn("url", F.raise_error(F.lit("no answer")))}
    found, status = D.discovered(spark, made, ["good", "none", "broken", "other"])
    told = spark.createDataFrame(list(status.items()), "source string, status string")
    return told.join(found.groupBy("source").agg(F.count("*").alias("candidates")), "source", "left").select("source", F.substring_index("status", ":", 1).alias("status"), F.coalesce("candidates", F.lit(0)).alias("candidates"))


def s21_snapshots(spark, d):
    """Answers of an availability service, some without a snapshot and some with a bad stamp."""
    closest = F.struct((F.col("seq") % 5 != 0).alias("available"), F.concat(F.lit("http://archive/"), F.col("url")).alias("url"), F.when(F.col("seq") % 3 == 0, "bad").otherwise(F.date_format("day", "yyyyMMdd101500")).alias("timestamp"))
    x = _listed(spark, d).select("seq", F.lit("2024-03-01").cast("date").alias("requested"), F.to_json(F.struct(F.struct(closest.alias("closest")).alias("archived_snapshots"))).alias("text"))
    return feeds.closest_snapshots(x).select("seq", "snapshot", "captured")


def s22_topic_links(spark, d):
    """Archived listing pages of a day and site each; the links of those near the window."""
    x = _listed(spark, d).withColumns({"page": F.concat(F.lit("snap/"), F.col("site"), F.lit("/"), F.col("day").cast("string")), "link": F.concat(F.lit("https://paper.example/story/"), F.col("seq") % 977)})
    shown = x.groupBy("page", "day").agg(F.concat_ws(" ", F.collect_list(F.concat(F.lit('<a href="/web/20240101/'), F.col("link"), F.lit('">x</a>')))).alias("text"))  # at most PAGE
    snaps = shown.select(F.col("page").alias("snapshot"), F.date_add("day", 20).alias("captured"))
    return S.by_snapshots(snaps, shown.select("page", "text"), r"paper\.example", START, END, 10)


def s22_topic_slugs(spark, d):
    slug = F.trim(F.regexp_replace(F.lower("name"), "[^a-z0-9]+", "-"), F.lit("-"))
    return table(spark, d, "quotes").where("name is not null").select(slug.alias("slug")).where("slug <> ''").distinct()


def _fetched(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Candidates, and a page of each address: every thirteenth is blocked, every ninth fails, every eighth is without text."""
    news = table(spark, d, "news").where("url is not null")
    status = F.when(F.col("seq") % 13 == 0, -1).when(F.col("seq") % 9 == 0, 503).otherwise(200)
    shown = news.groupBy("url").agg(F.min_by(F.struct("seq", "headline", "body"), "seq").alias("p")).select("url", "p.seq", "p.headline", "p.body")
    return news.select("seq", "source", "url"), shown.select("url", status.alias("status"), F.when(F.col("seq") % 8 != 0, F.coalesce("body", F.lit(""))).alias("text"), "headline")


def c8_outcomes(spark, d):
    return S.fetched_once(*_fetched(spark, d))[1]


def c8_items(spark, d):
    return S.fetched_once(*_fetched(spark, d))[0].select("seq", "source", "url")


def s23_archived_items(spark, d):
    """Items read through their snapshots, by the address they had: snapshots that exist, answer and have a headline."""
    wanted, shown = _fetched(spark, d)
    first = wanted.groupBy("url").agg(F.min("seq").alias("seq"))
    x = first.where("seq % 5 <> 0").join(shown, "url", "left")
    kind = F.when(F.coalesce(F.col("status") != 200, F.lit(True)), "http").when(F.coalesce("headline", F.lit("")) == "", "empty").otherwise("ok")
    return x.groupBy(kind.alias("outcome")).agg(F.count("*").alias("addresses")).unionByName(first.where("seq % 5 = 0").agg(F.lit("unavailable").alias("outcome"), F.count("*").alias("addresses")))


def s24_provenance(spark, d):
    x = table(spark, d, "news").where("body is not null").select(F.col("seq").cast("string").alias("url"), F.lit(200).alias("status"), "fetched_at", F.col("body").alias("text"))
    return D.provenance(x)


def s25_robots(spark, d):
    """Rules of one agent group over the addresses: the longest pattern decides, allowing wins ties."""
    text = "User-agent: other\nDisallow: /\n\nUser-agent: *\nAllow: /\nDisallow: /*1*-\nAllow: /*12*- # longer\nDisallow: /*5$\n"
    rules = robots.rules(spark.createDataFrame([("all", 200, text)], "origin string, status int, text string"))
    x = table(spark, d, "news").where("url is not null").select(F.col("seq").alias("id"), F.lit("all").alias("origin"), F.regexp_replace("url", r"^[a-z]+://[^/]+", "").alias("path"), F.lit("reader/1.0").alias("agent"))
    return robots.decided(x, rules).select(F.col("id").alias("seq"), "allowed")


def s3_chart_json(spark, d):
    """Chart answers of a symbol's month each, read back."""
    x = M.frame(table(spark, d, "prices")).withColumn("m", F.trunc("date", "month"))
    row = F.struct("date", F.unix_timestamp(F.to_utc_timestamp(F.col("date").cast("timestamp"), "Asia/Kolkata")).alias("t"), "close", "volume")
    x = x.groupBy("symbol", "m").agg(F.array_sort(F.collect_list(row)).alias("r"))  # a month
    quote = F.array(F.struct(F.transform("r", lambda v: v["close"]).alias("close"), F.transform("r", lambda v: v["volume"]).alias("volume")))
    result = F.struct(F.struct("symbol").alias("meta"), F.transform("r", lambda v: v["t"]).alias("timestamp"), F.struct(quote.alias("quote")).alias("indicators"))
    return feeds.chart_json(x.select(F.to_json(F.struct(F.struct(F.array(result).alias("result")).alias("chart")), {"ignoreNullFields": "false"}).alias("text"))).select("symbol", "date", "close", "volume")


def s5_daily_map(spark, d):
    """Answers that map dates to fields, a symbol's month each; symbols as that provider writes them."""
    x = M.frame(table(spark, d, "prices")).withColumn("m", F.trunc("date", "month"))
    x = x.groupBy("symbol", "m").agg(F.map_from_entries(F.collect_list(F.struct(F.col("date").cast("string"), F.map_from_arrays(F.array(F.lit("4. close")), F.array(F.col("close").cast("string")))))).alias("r"))
    text = F.to_json(F.struct(F.map_from_arrays(F.array(F.lit("2. Symbol")), F.array(feeds.provider_symbol(F.concat("symbol", F.lit(".NS"))))).alias("Meta Data"), F.col("r").alias("Time Series (Daily)")))
    return feeds.daily_map_json(x.select(text.alias("text"))).select("symbol", "date", "close")


def s7_bundle(spark, d):
    """Items saved as bundles and loaded again."""
    from tidemark.session import shared_dir

    news = table(spark, d, "news")
    path = f"{shared_dir(spark)}/bundle-{spark.sparkContext.applicationId}-{abs(hash(d))}"
    feeds.save_bundle(news.select("seq", "source", "url", "headline", "body", F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("published_at"), "paywalled"), path, "all", "none")
    x = feeds.news_bundle(spark, path)
    return x.select("source", "url", "headline", F.md5("body").alias("body_md5"), F.unix_micros("published_at").alias("published_us"), "paywalled")


def s27_directory(spark, d):
    """A directory page of the quotes' names, a page a query."""
    card = F.concat(F.lit('<a class="card" href="/company/'), F.lower("symbol"), F.lit('"><h3>'), F.regexp_replace("name", "[<>&]", ""), F.lit("</h3></a>"))
    x = table(spark, d, "quotes").where("name is not null and trim(name) <> '' and symbol is not null").groupBy("query").agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("pos", "symbol", card.alias("c")))), lambda v: v["c"])).alias("text"))
    return D.directory(x)


def s29_embedded_series(spark, d):
    """Price pairs inside a page's script, a symbol's month each; a date given twice counts once, the last time."""
    x = table(spark, d, "prices").where("symbol is not null and date is not null and close is not null").withColumn("m", F.trunc("date", "month"))
    pair = F.concat(F.lit('{"date":"'), F.col("date").cast("string"), F.lit('T00:00:00","price":"'), F.format_string("%.4f", "close"), F.lit('"}'))
    x = x.groupBy("symbol", "m").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("seq", pair.alias("p")))), lambda v: v["p"])).alias("text"))
    return feeds.embedded_series(x).select("symbol", "date", "close")


def _last() -> Column:
    return F.ascii(F.right(F.col("symbol"), F.lit(1)))


def _quarter_pages(spark: SparkSession, d: str) -> DataFrame:
    """(ticker, text): a page a symbol with five quarters of figures made from its volumes and closes; every third symbol's page has
    another revenue label, every fourth no tax row, every fifth a masked order book and every sixth an open one."""
    x = M.frame(table(spark, d, "prices")).groupBy("symbol").agg(F.max_by("close", "date").alias("c"), F.count("*").alias("n"))
    heads = ("Mar 2023", "Jun 2023", "Sep 2023", "Dec 2023", "Mar 2024")
    cell = lambda v: F.concat(F.lit("<td>"), v, F.lit("</td>"))
    row = lambda label, f: F.concat(F.lit("<tr><td>"), label, F.lit("</td>"), *[cell(f(k)) for k in range(5)], F.lit("</tr>"))
    figure = lambda k: F.format_string("%,d", (F.floor("c") * (k + 2) + F.col("n")).cast("bigint"))
    text = F.concat(
        F.lit("<section id='quarters'><table><tr><th></th>" + "".join(f"<th>{h}</th>" for h in heads) + "</tr>"),
        row(F.when(_last() % 3 == 0, "Revenue +").otherwise("Sales +"), figure), row(F.lit("Operating Profit"), figure),
        F.when(_last() % 4 == 0, "").otherwise(row(F.lit("Tax %"), lambda k: F.lit(f"{20 + k}%"))), F.lit("</table></section>"),
        F.when(_last() % 5 == 0, "<section id='insights'><table><tbody><tr><td>Order Book <span>Rs</span></td><td></td></tr></tbody></table></section>")
        .when(_last() % 6 == 0, F.concat(F.lit("<section id='insights'><table><tbody><tr><td>Order Book <span>Rs</span></td><td>"), F.col("n").cast("string"), F.lit("</td></tr></tbody></table></section>"))).otherwise(""),
    )
    return x.select(F.col("symbol").alias("ticker"), text.alias("text"), "c", "n")


def s30_quarters(spark, d):
    return D.preferred(D.quarters(_quarter_pages(spark, d)), ("Revenue", "Sales")).select("ticker", "label", "quarter", "value")


def s30_order_book(spark, d):
    return D.order_books(_quarter_pages(spark, d))


def i9_nopat(spark, d):
    return P._rounded(D.nopat(D.quarters(_quarter_pages(spark, d))), 4)


def i10_financials(spark, d):
    """Latest revenue with its changes, operating income, tax rate and NOPAT of every ticker, whatever its page lacks."""
    x = _quarter_pages(spark, d)
    return P._rounded(D.financials(x.select("ticker").distinct(), D.quarters(x), ("Revenue", "Sales")), 4)


def s31_reading(spark, d):
    """A figure inside a page's prose."""
    x = M.frame(table(spark, d, "prices")).select("symbol", "date", F.concat(F.lit("The 10-year yield stood at "), F.format_string("%,.2f", "close"), F.lit(" per cent")).alias("text"))
    return D.reading(x, r"yield stood at ([\d,.]+) per").select("symbol", "date", "value")


def s32_verdicts(spark, d):
    """What each source's rows let one expect of it."""
    x = table(spark, d, "news").where("source is not null").groupBy("source").agg(
        (F.count("*") % 5 != 0).alias("allowed"), F.count("url").alias("candidates"), F.floor(F.avg(F.length("body"))).alias("body_chars"), F.coalesce(F.bool_or(F.col("published_at").isNotNull()), F.lit(False)).alias("has_time"), F.lit(False).alias("shell"),
    )
    return D.verdicts(x).select("source", "verdict")


def s32_prices(spark, d):
    """Whether each symbol's prices would do: rows, rows without a close, and the verdict."""
    x = table(spark, d, "prices").where("symbol is not null").groupBy("symbol").agg(F.count("*").alias("delivered"), F.count("close").alias("closes"), F.countDistinct("date").alias("days"))
    return x.withColumn("verdict", F.when(F.col("closes") == 0, "no prices").when(F.col("days") < 40, "too short").otherwise("usable"))


def s25_blanket(spark, d):
    """Sources whose robots file shuts everything: every third is shut, every third has an exception, the others are open."""
    x = table(spark, d, "outlets").select(F.col("source").alias("origin"), F.lit(200).alias("status"), F.when(F.length("source") % 3 == 0, "User-agent: *\nDisallow: /\n").when(F.length("source") % 3 == 1, "User-agent: *\nDisallow: /\nAllow: /news\n").otherwise("User-agent: *\nDisallow: /private\n").alias("text"))
    return robots.blanket(robots.rules(x))


def _html(spark: SparkSession, d: str) -> DataFrame:
    """(url, text): a page of every item, with its values as structured data; every second row has them in meta tags and paragraphs."""
    plain = lambda c: F.coalesce(F.regexp_replace(c, r"[<>&\p{Cc}\p{Z}]+", " "), F.lit(""))
    x = table(spark, d, "news").withColumns({"h": plain("headline"), "b": plain("body"), "s": plain("snippet"), "t": F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")})
    ld = F.to_json(F.struct(F.lit("NewsArticle").alias("@type"), F.col("h").alias("headline"), F.col("b").alias("articleBody"), F.col("s").alias("description"), F.col("t").alias("datePublished")))
    structured = F.concat(F.lit('<html><head><script type="application/ld+json">'), F.replace(ld, F.lit("</"), F.lit("<\\/")), F.lit("</script></head><body></body></html>"))
    quoted = lambda c: F.replace(c, F.lit('"'), F.lit("&quot;"))
    tagged = F.concat(
        F.lit('<html><head><meta property="og:title" content="'), quoted(F.col("h")), F.lit('"><meta property="og:description" content="'), quoted(F.col("s")), F.lit('"><meta property="article:published_time" content="'), F.coalesce("t", F.lit("")),
        F.lit('"></head><body><article><p>'), F.col("b"), F.lit("</p><p>Second.</p><p>Third.</p></article></body></html>"),
    )
    return x.select(F.col("seq").cast("string").alias("url"), F.when(F.col("seq") % 2 == 0, structured).otherwise(tagged).alias("text"))


def x8_articles(spark, d):
    x = pages.extracted(_html(spark, d))
    return x.select(F.col("url").cast("bigint").alias("seq"), "headline", F.md5("body").alias("body_md5"), "snippet", "published")


def x9_shells(spark, d):
    """Texts too short for a page, or that hint at scripts without an article."""
    x = table(spark, d, "news").where("body is not null").select("source", D.javascript_shell("body").alias("shell"))
    return x.groupBy("source", "shell").agg(F.count("*").alias("pages"))


def c1_alias_list(spark, d):
    """The names of a company to look for: its name and the short form, the longest first, each spelling once."""
    x = table(spark, d, "quotes").where("name is not null and trim(name) <> ''")
    return x.select("symbol", F.array_join(T.alias_list(F.array("name", "query", T.stripped_suffix(F.col("name")))), "|").alias("aliases"))


def c6_widened(spark, d):
    """The leading word of a name is an alias where it finds this company first."""
    q = table(spark, d, "quotes")
    words = F.filter(F.regexp_extract_all("name", F.lit("[A-Za-z][A-Za-z&]*"), F.lit(0)), lambda w: (F.length(w) > 2) & (F.lower(w) != "the"))
    names = q.where("name is not null").select("symbol", F.try_element_at(words, F.lit(1)).alias("word")).where("word is not null")
    base = lambda c: F.upper(F.element_at(F.split(c, r"\."), 1))
    w = Window.partitionBy("key").orderBy(F.col("pos"), "symbol")
    top = q.where("quote_type = 'EQUITY' and query is not null").withColumn("key", F.lower(F.element_at(F.split("query", " "), 1))).withColumn("rn", F.row_number().over(w)).where("rn = 1").select("key", base("symbol").alias("top"))
    return names.join(top, F.lower("word") == F.col("key")).where(base("symbol") == F.col("top")).select("symbol", F.col("word").alias("alias"))


def c9_counters(spark, d):
    """The funnel over all sources: what each stage had and lost."""
    x = table(spark, d, "news")
    has = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    outcomes = {k: F.count_if(F.col("outcome") == k).alias(f"errors_{k}") for k in ("robots", "http", "parse", "empty")}
    one = x.agg(
        F.count("*").alias("candidates"), F.countDistinct("url").alias("addresses"), F.count("body").alias("with_body"), F.count("published_at").alias("dated"), has(F.lower("timestamp_confidence") == "missing").alias("missing_timestamp"),
        has(F.col("relevance_score") >= 0.35).alias("relevant"), has(F.col("relevance_score") < 0.35).alias("dropped"), F.count_if(F.col("duplicate_of").isNull()).alias("unique"), F.count("duplicate_of").alias("duplicates"),
        has(F.col("paywalled")).alias("paywalled"), has(F.col("after_close")).alias("after_close"), F.count("trading_day").alias("attributed"),
    )
    wanted, shown = _fetched(spark, d)
    counted = S.fetched_once(wanted, shown)[1].agg(*[F.coalesce(F.sum(F.when(F.col("outcome") == k, F.col("addresses"))), F.lit(0)).alias(f"errors_{k}") for k in outcomes])
    return one.crossJoin(counted)  # one row each


def _cache(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(cached items, segments, requests, fresh items): what an earlier run kept, for which days and sources, what is asked for now,
    and what the sources give for it. The earlier run had the even seq and its segments are the recorded days."""
    news = table(spark, d, "news").where("symbol is not null and url is not null and published_local_date is not null").select("symbol", "seq", "url", F.col("published_local_date").alias("day"))
    days = table(spark, d, "daily_coverage").where("symbol is not null and day is not null")
    segments = days.select("symbol", F.col("day").alias("start"), F.col("day").alias("end"), F.array_sort(F.array_distinct(F.coalesce("sources", F.array()))).alias("sources"))
    requests = days.groupBy("symbol").agg(F.date_sub(F.min("day"), 2).alias("start"), F.date_add(F.max("day"), 2).alias("end"), F.min(F.get("sources", F.lit(0))).alias("one")).select("symbol", "start", "end", F.array_compact(F.array("one")).alias("wanted"))
    return news.where("seq % 2 = 0"), segments, requests, news


def v6_sufficient_gaps(spark, d):
    """Days that no segment with all wanted sources covers."""
    _, segments, requests, _ = _cache(spark, d)
    return V.gaps(V.sufficient(segments, requests), requests.select("symbol", "start", "end"))


def v9_after_gaps(spark, d):
    """The items kept after a run: cached ones outside its gaps, and the fresh ones, the last of an address."""
    cached, segments, requests, fresh = _cache(spark, d)
    gaps = written(V.gaps(V.sufficient(segments, requests), requests.select("symbol", "start", "end")), "gaps")
    return V.replaced(cached, V.inside(fresh, gaps, "day"), gaps, "day").select("symbol", "url", "seq")


def v9_segments(spark, d):
    """The segments after a run: its gaps count as covered by the wanted sources."""
    _, segments, requests, _ = _cache(spark, d)
    gaps = V.gaps(V.sufficient(segments, requests), requests.select("symbol", "start", "end"))
    new = gaps.join(requests.select("symbol", F.col("wanted").alias("sources")), "symbol").select("symbol", "start", "end", "sources")
    every = segments.unionByName(new).withColumn("sources", F.array_join("sources", ","))
    return V.merged(every, ["symbol", "sources"])


def v10_cached_ingest(spark, d):
    """What a cache-aware run reports by symbol: gap days crawled, days and items reused, new items."""
    cached, segments, requests, fresh = _cache(spark, d)
    asked = requests.select("symbol", "start", "end")
    gaps = written(V.gaps(V.sufficient(segments, requests), asked), "gaps")
    reused = V.outside(V.inside(cached, asked, "day"), gaps, "day").groupBy("symbol").agg(F.count("*").alias("reused"), F.countDistinct("day").alias("days_reused"))
    new = V.inside(fresh, gaps, "day").groupBy("symbol").agg(F.count("*").alias("crawled"))
    spans = gaps.groupBy("symbol").agg(F.count("*").alias("gaps"), F.sum(F.datediff("end", "start") + 1).alias("gap_days"))
    x = asked.select("symbol").join(spans, "symbol", "left").join(reused, "symbol", "left").join(new, "symbol", "left")
    return x.na.fill(0)


QUERIES = {f.__name__: f for f in (
    s3_chart_json, s5_daily_map, s7_bundle, s8_locations, s9_blocks, s10_index, s12_month_parts, s13_days_by_query, s14_day_parts, s15_year_months, s16_days_with_margin, s17_day_pages, s18_walk, s19_archive, s20_dispatch, s21_snapshots, s22_topic_links, s22_topic_slugs,
    s23_archived_items, s24_provenance, s25_robots, s27_directory, s29_embedded_series, s30_quarters, s30_order_book, i9_nopat, i10_financials, s31_reading, s25_blanket, s32_prices, s32_verdicts, x8_articles, x9_shells, c1_alias_list, c6_widened, c8_items, c8_outcomes, c9_counters,
    v6_sufficient_gaps, v9_after_gaps, v9_segments, v10_cached_ingest,
)}

_W = "DATE '2024-02-01' AND DATE '2024-02-15'"
_NEAR = "DATE '2024-01-31' AND DATE '2024-02-16'"
_L = "l AS (SELECT (seq // 1000)::VARCHAR AS site, seq, url, published_local_date AS day FROM news WHERE url IS NOT NULL AND url <> '' AND published_local_date IS NOT NULL)"
_FIRST = "f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY seq) AS rn FROM news WHERE url IS NOT NULL) WHERE rn = 1)"
_OUT = _FIRST + ", o AS (SELECT *, CASE WHEN seq % 13 = 0 THEN 'robots' WHEN seq % 9 = 0 THEN 'http' WHEN seq % 8 = 0 THEN 'parse' WHEN coalesce(headline, '') = '' THEN 'empty' ELSE 'ok' END AS outcome FROM f)"
_Q = P._PX + ", qx AS (SELECT symbol AS ticker, floor(arg_max(close, date)) AS c, count(*) AS n, ascii(right(symbol, 1)) AS last FROM px GROUP BY symbol)"
_PLAIN = r"trim(coalesce(regexp_replace({c}, '[<>&\p{{Cc}}\p{{Z}}]+', ' ', 'g'), ''))"
_REQ = """dc AS (SELECT symbol, day, list_sort(list_distinct(coalesce(sources, []))) AS sources FROM daily_coverage WHERE symbol IS NOT NULL AND day IS NOT NULL),
    rq AS (SELECT symbol, min(day) - 2 AS lo, max(day) + 2 AS hi, min(sources[1]) AS one FROM daily_coverage WHERE symbol IS NOT NULL AND day IS NOT NULL GROUP BY symbol),
    ok AS (SELECT DISTINCT dc.symbol, day FROM dc JOIN rq USING (symbol) WHERE one IS NULL OR list_contains(dc.sources, one)),
    gd AS (SELECT symbol, unnest(generate_series(lo, hi, INTERVAL 1 DAY))::DATE AS day FROM rq EXCEPT SELECT symbol, day FROM ok),
    nw AS (SELECT symbol, seq, url, published_local_date AS day FROM news WHERE symbol IS NOT NULL AND url IS NOT NULL AND published_local_date IS NOT NULL)"""
_ISLES = "(SELECT *, day - row_number() OVER (PARTITION BY {k} ORDER BY day)::INT AS g FROM {t})"

ORACLES = {
    "s3_chart_json": f"WITH {P._PX} SELECT symbol, date, close, volume FROM px",
    "s5_daily_map": f"WITH {P._PX} SELECT replace(symbol, '^', '') || '.BSE' AS symbol, date, close FROM px",
    "s7_bundle": "SELECT source, url, headline, md5(body) AS body_md5, epoch_us(published_at) AS published_us, paywalled FROM news",
    "s8_locations": f"WITH {_L} SELECT site, url FROM l",
    "s9_blocks": f"WITH {_L} SELECT site, url, CASE WHEN seq % 7 <> 0 AND seq % 11 <> 0 THEN day END AS lastmod FROM l",
    "s10_index": f"WITH {_L} SELECT site, strftime(day, '%Y-%m') AS url, max(day) AS lastmod FROM l GROUP BY ALL",
    "s12_month_parts": f"WITH {_L} SELECT site, url, day AS hint_date FROM l WHERE month(day) = 2 AND day BETWEEN {_NEAR}",
    "s13_days_by_query": f"WITH {_L} SELECT site, url, day AS hint_date FROM l WHERE day BETWEEN {_W}",
    "s14_day_parts": f"WITH {_L}, p AS (SELECT DISTINCT site, day, seq % 4 + 1 AS k FROM l), g AS (SELECT p.* FROM p WHERE k <= 3 AND (SELECT count(*) FROM p q WHERE q.site = p.site AND q.day = p.day AND q.k <= p.k) = p.k) SELECT site, url, day AS hint_date FROM l JOIN g USING (site, day) WHERE l.seq % 4 + 1 = g.k AND day BETWEEN {_W}",
    "s15_year_months": f"WITH {_L} SELECT site, url, day AS hint_date FROM l WHERE strftime(day, '%Y-%m') = '2024-02' AND day BETWEEN {_NEAR}",
    "s16_days_with_margin": f"WITH {_L} SELECT site, url, day + (seq % 3)::INT AS hint_date FROM l WHERE day BETWEEN {_W} AND day + (seq % 3)::INT BETWEEN {_NEAR}",
    "s17_day_pages": f"WITH {_L} SELECT site, url, day AS hint_date FROM l WHERE day BETWEEN {_W}",
    "s18_walk": f"""WITH {_L}, f0 AS (SELECT *, dense_rank() OVER (PARTITION BY site ORDER BY date_trunc('week', day) DESC) AS r FROM l), f AS (SELECT *, CASE WHEN site <> '1' THEN r ELSE 2*r - 1 END AS n FROM f0), e AS (SELECT site, n, min(day) AS oldest FROM f GROUP BY ALL),
        r AS (SELECT site, n FROM e WHERE n <= 200 AND (SELECT count(*) FROM e q WHERE q.site = e.site AND q.n <= e.n) = e.n AND NOT EXISTS (SELECT 1 FROM e q WHERE q.site = e.site AND q.n < e.n AND q.oldest < DATE '2024-01-31'))
        SELECT site, url, day AS hint_date FROM f JOIN r USING (site, n) WHERE day BETWEEN {_NEAR}""",
    "s19_archive": f"WITH {_L}, f AS (SELECT *, floor((day - DATE '2023-12-01') / 10.0)::INT AS n FROM l) SELECT site, url, day AS hint_date FROM f WHERE n >= 0 AND n <> 5 AND day BETWEEN {_NEAR}",
    "s20_dispatch": f"WITH {_L} SELECT * FROM (SELECT 'good' AS source, 'ok' AS status, count(*) AS candidates FROM l UNION ALL VALUES ('none', 'ok', 0), ('broken', 'failed', 0), ('other', 'unknown source', 0))",
    "s21_snapshots": f"WITH {_L} SELECT seq, CASE WHEN seq % 5 <> 0 THEN 'http://archive/' || url END AS snapshot, CASE WHEN seq % 5 = 0 THEN NULL WHEN seq % 3 = 0 THEN DATE '2024-03-01' ELSE day END AS captured FROM l",
    "s22_topic_links": f"WITH {_L} SELECT DISTINCT 'https://paper.example/story/' || (seq % 977) AS url FROM l WHERE day + 20 BETWEEN DATE '2024-01-22' AND DATE '2024-02-25'",
    "s22_topic_slugs": "SELECT DISTINCT slug FROM (SELECT trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM quotes WHERE name IS NOT NULL) WHERE slug <> ''",
    "s23_archived_items": f"WITH {_FIRST} SELECT CASE WHEN seq % 5 = 0 THEN 'unavailable' WHEN seq % 13 = 0 OR seq % 9 = 0 THEN 'http' WHEN coalesce(headline, '') = '' THEN 'empty' ELSE 'ok' END AS outcome, count(*) AS addresses FROM f GROUP BY 1",
    "s24_provenance": "SELECT seq::VARCHAR AS url, 200 AS status, fetched_at, length(body)::INT AS characters, sha256(body) AS sha256 FROM news WHERE body IS NOT NULL",
    "s25_robots": r"WITH p AS (SELECT seq, regexp_replace(url, '^[a-z]+://[^/]+', '') AS path FROM news WHERE url IS NOT NULL) SELECT seq, CASE WHEN regexp_matches(path, '^/.*12.*-') THEN TRUE WHEN regexp_matches(path, '^/.*1.*-') THEN FALSE WHEN regexp_matches(path, '^/.*5$') THEN FALSE ELSE TRUE END AS allowed FROM p",
    "s27_directory": "SELECT '/company/' || lower(symbol) AS href, trim(regexp_replace(name, '[<>&]', '', 'g')) AS name FROM quotes WHERE name IS NOT NULL AND trim(name) <> '' AND symbol IS NOT NULL",
    "s29_embedded_series": "SELECT symbol, date, round(arg_max(close, seq), 4) AS close FROM prices WHERE symbol IS NOT NULL AND date IS NOT NULL AND close IS NOT NULL GROUP BY symbol, date",
    "s30_quarters": f"WITH {_Q} SELECT ticker, CASE WHEN last % 3 = 0 THEN 'Revenue' ELSE 'Sales' END AS label, quarter, (c*k + n)::DOUBLE AS value FROM qx, (VALUES (2, 'Mar 2023'), (3, 'Jun 2023'), (4, 'Sep 2023'), (5, 'Dec 2023'), (6, 'Mar 2024')) AS h(k, quarter)",
    "s30_order_book": f"WITH {_Q} SELECT ticker, CASE WHEN last % 5 = 0 THEN 'masked' WHEN last % 6 = 0 THEN 'available' ELSE 'not applicable' END AS status, CASE WHEN last % 5 <> 0 AND last % 6 = 0 THEN n::DOUBLE END AS value FROM qx",
    "i9_nopat": f"WITH {_Q} SELECT ticker, CASE WHEN last % 4 <> 0 THEN round((c*6 + n)*0.76, 4) END AS nopat FROM qx",
    "i10_financials": f"WITH {_Q} SELECT ticker, CASE WHEN last % 3 = 0 THEN 'Revenue' ELSE 'Sales' END AS label, (c*6 + n)::DOUBLE AS revenue, round(c/(c*5 + n), 4) AS qoq, round(4*c/(c*2 + n), 4) AS yoy, CASE WHEN last % 4 <> 0 THEN 24::DOUBLE END AS tax_rate, CASE WHEN last % 4 <> 0 THEN round((c*6 + n)*0.76, 4) END AS nopat FROM qx",
    "s31_reading": f"WITH {P._PX} SELECT symbol, date, round(close, 2) AS value FROM px",
    "s32_verdicts": "SELECT source, CASE WHEN count(*) % 5 = 0 THEN 'blocked by robots' WHEN count(url) = 0 THEN 'nothing discovered' WHEN coalesce(floor(avg(length(body))), 0) < 600 THEN 'no usable text' WHEN count(published_at) = 0 THEN 'no timestamps' ELSE 'usable' END AS verdict FROM news WHERE source IS NOT NULL GROUP BY source",
    "x8_articles": f"""WITH p AS (SELECT seq, {_PLAIN.format(c='headline')} AS h, {_PLAIN.format(c='body')} AS b, {_PLAIN.format(c='snippet')} AS s, coalesce(strftime(published_at AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ'), '') AS t FROM news)
        SELECT seq, h AS headline, md5(CASE WHEN seq % 2 = 0 AND length(b) > 200 THEN b WHEN seq % 2 = 1 AND b <> '' THEN b || ' Second. Third.' ELSE '' END) AS body_md5, s AS snippet, t AS published FROM p""",
    "x9_shells": r"SELECT source, length(body) < 2000 OR (regexp_matches(lower(body), '__next_data__|ng-app|data-reactroot|enable javascript|window\.__initial_state__') AND NOT contains(lower(body), '<article')) AS shell, count(*) AS pages FROM news WHERE body IS NOT NULL GROUP BY ALL",
    "c1_alias_list": r"""WITH n AS (SELECT symbol, unnest([name, query, CASE WHEN regexp_matches(trim(name), '(?i)[\s,]+(private\.?\s+limited|pvt\.?\s+ltd|limited|ltd|incorporated|inc|corporation|corp|company|co|llc|plc)\.?$') THEN nullif(rtrim(regexp_replace(regexp_replace(trim(name), '(?i)[\s,]+(private\.?\s+limited|pvt\.?\s+ltd|limited|ltd|incorporated|inc|corporation|corp|company|co|llc|plc)\.?$', ''), ',+$', '')), '') END]) AS a, unnest([0, 1, 2]) AS i FROM quotes WHERE name IS NOT NULL AND trim(name) <> ''),
        r AS (SELECT symbol, trim(a) AS a, length(a) AS k, i, row_number() OVER (PARTITION BY symbol, lower(trim(a)) ORDER BY length(a) DESC, i) AS rn FROM n WHERE trim(coalesce(a, '')) <> '')
        SELECT symbol, string_agg(a, '|' ORDER BY k DESC, i) AS aliases FROM r WHERE rn = 1 GROUP BY symbol""",
    "c6_widened": r"""WITH n AS (SELECT symbol, list_filter(regexp_extract_all(name, '[A-Za-z][A-Za-z&]*'), lambda w: length(w) > 2 AND lower(w) <> 'the')[1] AS word FROM quotes WHERE name IS NOT NULL),
        t AS (SELECT lower(string_split(query, ' ')[1]) AS key, upper(string_split(symbol, '.')[1]) AS top, row_number() OVER (PARTITION BY lower(string_split(query, ' ')[1]) ORDER BY pos, symbol) AS rn FROM quotes WHERE quote_type = 'EQUITY' AND query IS NOT NULL)
        SELECT symbol, word AS alias FROM n JOIN t ON lower(word) = key AND rn = 1 WHERE upper(string_split(symbol, '.')[1]) = top""",
    "c8_items": f"WITH {_OUT} SELECT seq, source, url FROM o WHERE outcome = 'ok'",
    "c8_outcomes": f"WITH {_OUT} SELECT outcome, count(*) AS addresses FROM o GROUP BY outcome",
    "c9_counters": f"""WITH {_OUT} SELECT count(*) AS candidates, count(DISTINCT url) AS addresses, count(body) AS with_body, count(published_at) AS dated, count(*) FILTER (lower(timestamp_confidence) = 'missing') AS missing_timestamp,
        count(*) FILTER (relevance_score >= 0.35) AS relevant, count(*) FILTER (relevance_score < 0.35) AS dropped, count(*) FILTER (duplicate_of IS NULL) AS "unique", count(duplicate_of) AS duplicates, count(*) FILTER (paywalled) AS paywalled, count(*) FILTER (after_close) AS after_close,
        count(trading_day) AS attributed, """ + ", ".join(f"(SELECT count(*) FROM o WHERE outcome = '{k}') AS errors_{k}" for k in ("robots", "http", "parse", "empty")) + " FROM news",
    "v6_sufficient_gaps": f"WITH {_REQ} SELECT symbol, min(day) AS start, max(day) AS \"end\" FROM {_ISLES.format(k='symbol', t='gd')} GROUP BY symbol, g",
    "v9_after_gaps": f"WITH {_REQ}, b AS (SELECT nw.*, 1 AS fresh FROM nw SEMI JOIN gd USING (symbol, day) UNION ALL SELECT nw.*, 0 FROM nw ANTI JOIN gd USING (symbol, day) WHERE seq % 2 = 0) SELECT symbol, url, seq FROM (SELECT *, row_number() OVER (PARTITION BY symbol, url ORDER BY fresh DESC, seq DESC) AS rn FROM b) WHERE rn = 1",
    "v9_segments": f"WITH {_REQ}, a AS (SELECT DISTINCT * FROM (SELECT symbol, day, array_to_string(sources, ',') AS sources FROM dc UNION ALL SELECT symbol, day, coalesce(one, '') FROM gd JOIN rq USING (symbol))) SELECT symbol, sources, min(day) AS start, max(day) AS \"end\" FROM {_ISLES.format(k='symbol, sources', t='a')} GROUP BY symbol, sources, g",
    "v10_cached_ingest": f"""WITH {_REQ}, sp AS (SELECT symbol, count(DISTINCT g) AS gaps, count(*) AS gap_days FROM {_ISLES.format(k='symbol', t='gd')} GROUP BY symbol),
        re AS (SELECT symbol, count(*) AS reused, count(DISTINCT day) AS days_reused FROM nw JOIN rq USING (symbol) WHERE seq % 2 = 0 AND day BETWEEN lo AND hi AND (symbol, day) NOT IN (SELECT (symbol, day) FROM gd) GROUP BY symbol),
        cr AS (SELECT symbol, count(*) AS crawled FROM nw WHERE (symbol, day) IN (SELECT (symbol, day) FROM gd) GROUP BY symbol)
        SELECT symbol, coalesce(gaps, 0) AS gaps, coalesce(gap_days, 0) AS gap_days, coalesce(reused, 0) AS reused, coalesce(days_reused, 0) AS days_reused, coalesce(crawled, 0) AS crawled FROM rq LEFT JOIN sp USING (symbol) LEFT JOIN re USING (symbol) LEFT JOIN cr USING (symbol)""",
    "s32_prices": "SELECT symbol, count(*) AS delivered, count(close) AS closes, count(DISTINCT date) AS days, CASE WHEN count(close) = 0 THEN 'no prices' WHEN count(DISTINCT date) < 40 THEN 'too short' ELSE 'usable' END AS verdict FROM prices WHERE symbol IS NOT NULL GROUP BY symbol",
    "s25_blanket": "SELECT source AS origin, '*' AS agent FROM outlets WHERE length(source) % 3 = 0",
}
