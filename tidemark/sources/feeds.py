"""Price files, news bundles, sitemaps and archive answers as DataFrames: parsing only, fetching is a table (url, text)."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NEWS_ITEM = (
    "source string, url string, headline string, body string, snippet string, published_at string, timestamp_confidence string, paywalled boolean, relevance_score double, matched_aliases array<string>,"
    "headline_match boolean, sentiment_label string, sentiment_score double, sentiment_confidence double, event_category string, emotion_label string, emotion_score double, emotion_secondary array<string>,"
    "after_close boolean, fetched_at string, content_sha256 string, duplicate_of string, staleness_score double"
)


def _index_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for path in b["path"]:
            x = pd.read_csv(path).rename(columns=str.lower)
            x["date"] = pd.to_datetime(x["date"].astype(str).str[:10]).dt.date
            x["symbol"], x["seq"] = Path(path).stem.replace("_idx_", "^"), range(len(x))
            yield x.reindex(columns=["symbol", "date", "close", "volume", "seq"])


def price_files(spark: SparkSession, folder: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """CSV files ``<folder>/<symbol>.csv`` with date, close and perhaps volume, whatever the header's case; ``_idx_`` in a file name
    stands for ``^``. Both ends of the window count. ``seq`` is the order within a file."""
    raw = spark.read.option("header", True).csv(f"{folder}/*.csv", enforceSchema=False)
    named = {c.lower(): c for c in raw.columns}
    volume = F.col(named["volume"]).cast("double") if "volume" in named else F.lit(None).cast("double")
    symbol = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.csv$", 1)
    x = raw.select(symbol.alias("symbol"), F.to_date(F.substring(named["date"], 1, 10)).alias("date"), F.col(named["close"]).cast("double").alias("close"), volume.alias("volume"), F.monotonically_increasing_id().alias("seq"))
    hidden = [(str(p),) for p in sorted(Path(folder).glob("_idx_*.csv"))]  # Spark's readers skip names with a leading underscore
    if hidden:
        x = x.unionByName(spark.createDataFrame(hidden, "path string").mapInPandas(_index_files, "symbol string, date date, close double, volume double, seq bigint"))
    if start:
        x = x.where(F.col("date") >= F.lit(start).cast("date"))
    return x.where(F.col("date") <= F.lit(end).cast("date")) if end else x


def export_prices(frame: DataFrame, folder: str) -> None:
    """Write (symbol, date, close, volume) as CSV, a folder a symbol, each in order of date."""
    frame.repartition("symbol").sortWithinPartitions("symbol", "date").write.mode("overwrite").partitionBy("symbol").option("header", True).csv(folder)


def chart_json(df: DataFrame, text: str = "text", zone: str = "Asia/Kolkata") -> DataFrame:
    """(symbol, date, close, volume, seq) of chart answers: parallel arrays of epoch seconds, closes and volumes."""
    schema = "chart struct<result: array<struct<meta: struct<symbol: string>, timestamp: array<bigint>, indicators: struct<quote: array<struct<close: array<double>, volume: array<double>>>>>>>"
    r = F.from_json(text, schema)["chart"]["result"][0]
    q = r["indicators"]["quote"][0]
    x = df.select(r["meta"]["symbol"].alias("symbol"), F.posexplode(F.arrays_zip(r["timestamp"].alias("t"), q["close"].alias("c"), q["volume"].alias("v"))).alias("seq", "p"))
    return x.select("symbol", F.to_date(F.from_utc_timestamp(F.timestamp_seconds("p.t"), zone)).alias("date"), F.col("p.c").alias("close"), F.col("p.v").alias("volume"), F.col("seq").cast("bigint").alias("seq"))


def daily_map_json(df: DataFrame, text: str = "text") -> DataFrame:
    """(symbol, date, close) of answers that map each date to its fields."""
    schema = "`Meta Data` map<string, string>, `Time Series (Daily)` map<string, map<string, string>>"
    j = F.from_json(text, schema)
    x = df.select(j["Meta Data"]["2. Symbol"].alias("symbol"), F.explode(j["Time Series (Daily)"]).alias("day", "f"))
    return x.select("symbol", F.to_date("day").alias("date"), F.col("f")["4. close"].cast("double").alias("close"), F.lit(None).cast("double").alias("volume"))


def provider_symbol(symbol: Column) -> Column:
    """A symbol as the provider of date maps writes it: its own exchange suffix, no caret of indices."""
    return F.replace(F.regexp_replace(symbol, r"\.NS$", ".BSE"), F.lit("^"))


def news_bundle(spark: SparkSession, path: str) -> DataFrame:
    """The items of saved bundles, in order (``seq``); missing fields are null. The trading day is never read, it depends on the
    calendar at hand."""
    raw = spark.read.schema(f"company string, ticker string, items array<struct<{NEWS_ITEM}>>").option("multiLine", True).json(path)
    x = raw.select("company", F.posexplode("items").alias("seq", "i")).select("company", F.col("seq").cast("bigint").alias("seq"), "i.*")
    return x.withColumn("published_at", F.try_to_timestamp("published_at"))


def save_bundle(news: DataFrame, path: str, company: str, ticker: str, most: int = 10_000) -> None:
    """Bundles of a company's items in order, each of at most ``most`` (a run of seq), so that no task holds all of them."""
    fields = [c for c in news.columns if c != "seq"]
    items = news.groupBy(F.floor(F.col("seq") / most).alias("part")).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.struct(*fields).alias("i")))), lambda x: x["i"]).alias("items"))
    items.select(F.lit(company).alias("company"), F.lit(ticker).alias("ticker"), "items").write.mode("overwrite").option("maxRecordsPerFile", 1).json(path)


def unescaped(text: Column) -> Column:
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return F.trim(text)


_CDATA = r"(?is)<{tag}>\s*(?:<!\[CDATA\[)?\s*(.*?)\s*(?:\]\]>)?\s*</{tag}>"


def locations(pages: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``url``: every location of a sitemap, CDATA or not."""
    found = F.regexp_extract_all(text, F.lit(_CDATA.format(tag="loc")), F.lit(1))
    return pages.select("*", F.posexplode(found).alias("pos", "__loc")).withColumn("url", unescaped(F.col("__loc"))).drop("__loc")


def blocks(pages: DataFrame, tag: str = "url", text: str = "text") -> DataFrame:
    """Adds ``url`` and ``lastmod`` (a date, null where bad or absent) of every block of a sitemap (``url``) or sitemap index
    (``sitemap``); a sitemap without blocks gives its locations."""
    found = F.regexp_extract_all(text, F.lit(rf"(?is)<{tag}>(.*?)</{tag}>"), F.lit(1))
    whole = F.transform(F.regexp_extract_all(text, F.lit(_CDATA.format(tag="loc")), F.lit(1)), lambda u: F.concat(F.lit("<loc>"), u, F.lit("</loc>")))
    x = pages.select("*", F.posexplode(F.when(F.size(found) > 0, found).otherwise(whole)).alias("pos", "__b"))
    day = F.substring(F.regexp_extract("__b", _CDATA.format(tag="lastmod"), 1), 1, 10)
    return x.withColumn("url", unescaped(F.regexp_extract("__b", _CDATA.format(tag="loc"), 1))).withColumn("lastmod", F.try_to_timestamp(day, F.lit("yyyy-MM-dd")).cast("date")).where("url <> ''").drop("__b")


def walked(files: DataFrame, start: str) -> DataFrame:
    """Files of a numbered archive, newest first, until one whose oldest entry is more than a day before ``start`` or that has no
    dates: (number, oldest) in, the files that a walk reads out."""
    w = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)  # one row a file, some hundreds
    ends = F.col("oldest").isNull() | (F.col("oldest") < F.date_sub(F.lit(start).cast("date"), 1))
    return files.withColumn("__stop", F.coalesce(F.max(ends).over(w), F.lit(False))).where("not __stop").drop("__stop")


def unbroken(parts: DataFrame) -> DataFrame:
    """The parts (day, part, found) of each day before its first gap."""
    w = Window.partitionBy("day").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return parts.withColumn("__all", F.min("found").over(w)).where("__all").drop("__all")


def closest_snapshots(df: DataFrame, text: str = "text", requested: str = "requested") -> DataFrame:
    """Adds ``snapshot`` and ``captured`` of availability answers; a bad stamp falls back to the requested date."""
    j = F.from_json(text, "archived_snapshots struct<closest: struct<available: boolean, url: string, timestamp: string>>")["archived_snapshots"]["closest"]
    day = F.try_to_timestamp(F.substring(j["timestamp"], 1, 8), F.lit("yyyyMMdd")).cast("date")
    return df.withColumn("snapshot", F.when(j["available"], j["url"])).withColumn("captured", F.when(j["available"], F.coalesce(day, F.col(requested))))


def archived_links(df: DataFrame, site: str, text: str = "text") -> DataFrame:
    """Adds ``url``: the distinct article links of archived listing pages of a site, sorted."""
    pattern = rf"(?:/web/\d+(?:im_|id_)?/)?(https?://(?:www\.)?{site}/[^\"'<>\s]+)"
    return df.select("*", F.explode(F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))))).alias("url"))


def embedded_series(df: DataFrame, text: str = "text") -> DataFrame:
    """(date, close) of price pairs inside a page's script; of a date given twice the last counts."""
    pattern = r'\{\\?"date\\?":\s*\\?"(\d{4}-\d{2}-\d{2})[^"\\]*\\?",\s*\\?"price\\?":\s*\\?"?([\d.]+)'
    x = df.select(*[c for c in df.columns if c != text], F.posexplode(F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("d"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("p"))).alias("pos", "v"))
    keys = [c for c in df.columns if c != text]
    x = x.groupBy(*keys, F.to_date("v.d").alias("date")).agg(F.max_by("v.p", "pos").alias("close"))
    return x.withColumn("close", F.col("close").cast("double"))
