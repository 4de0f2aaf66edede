"""Ways to list a site's articles in a window from its sitemaps. Fetching is a table ``pages`` (site, page, text): whatever was fetched,
by address; every strategy runs for all sites in it at once and gives (site, url, hint_date).

A last-modified date may lie a day beside the publication, so windows are a day wider on both sides (MARGIN); entries without a date
stay in where the strategy says so. Pages that are missing, null or empty list nothing; an address listed twice is given twice.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources import feeds

#: Days by which a window is widened, parts of a day and files of a numbered archive that are asked for at most.
MARGIN, DAY_PARTS, FILES = 1, 3, 200


def days_of(start: date, end: date) -> list[date]:
    return [start + timedelta(days=k) for k in range((end - start).days + 1)]


def months_of(start: date, end: date, form: str) -> list[str]:
    """The names of the months that a window touches, in a ``strftime`` form."""
    return list(dict.fromkeys(d.strftime(form) for d in days_of(start, end)))


def near(column: str, start: date, end: date) -> Column:
    """Whether a date lies in the widened window; null for null."""
    return F.col(column).between(F.lit(start - timedelta(days=MARGIN)), F.lit(end + timedelta(days=MARGIN)))


def _there(pages: DataFrame) -> DataFrame:
    return pages.where("text is not null and text <> ''")


def _dated(listed: DataFrame, start: date, end: date, undated: bool = True) -> DataFrame:
    inside = F.coalesce(near("lastmod", start, end), F.lit(undated))
    return listed.where(inside).select("site", "url", F.col("lastmod").alias("hint_date"))


def by_index(pages: DataFrame, indexes: list[str], stem: str, months: list[str], start: date, end: date) -> DataFrame:
    """Index pages list part files; the parts whose name holds (``stem``, group 1) one of the ``months`` are read, and their entries in
    the window or without a date kept."""
    pages = _there(pages)
    parts = feeds.locations(pages.where(F.col("page").isin(indexes))).select("site", F.col("url").alias("page"))
    parts = parts.where(F.regexp_extract("page", stem, 1).isin(months))
    return _dated(feeds.blocks(pages.join(parts, ["site", "page"])), start, end)


def by_day(pages: DataFrame, template: str, start: date, end: date, lastmod: bool = False) -> DataFrame:
    """One page a day, at an address made by a ``strftime`` template. Its entries are of that day; with ``lastmod`` they have their own
    dates and are kept in the window or without one."""
    spark = pages.sparkSession
    wanted = spark.createDataFrame([(d.strftime(template), d) for d in days_of(start, end)], "page string, day date")
    x = _there(pages).join(wanted, "page")
    if lastmod:
        return _dated(feeds.blocks(x), start, end)
    return feeds.locations(x).select("site", "url", F.col("day").alias("hint_date"))


def by_day_parts(pages: DataFrame, template: str, start: date, end: date, most: int = DAY_PARTS) -> DataFrame:
    """Up to ``most`` parts a day ({part} in the template), up to the first one that is missing or lists nothing."""
    spark = pages.sparkSession
    wanted = spark.createDataFrame([(d.strftime(template).format(part=k), d, k) for d in days_of(start, end) for k in range(1, most + 1)], "page string, day date, part int")
    x = _there(pages).join(wanted, "page").where(F.regexp_like("text", F.lit("(?i)<loc>")))
    x = x.withColumn("__at", F.row_number().over(Window.partitionBy("site", "day").orderBy("part"))).where("__at = part")
    return feeds.locations(x).select("site", "url", F.col("day").alias("hint_date"))


def by_walk(pages: DataFrame, number: str, start: date, end: date, most: int = FILES) -> DataFrame:
    """Numbered files from the newest (1) on; the walk ends at a missing number, at a file without dates, after a file that reaches
    back before the window, and after ``most`` files. Entries need a date in the window."""
    files = _there(pages).withColumn("__n", F.try_to_number(F.nullif(F.regexp_extract("page", number, 1), F.lit("")), F.lit("999999999")).cast("int")).where("__n is not null")
    listed = feeds.blocks(files)
    ends = listed.groupBy("site", "__n").agg(F.min("lastmod").alias("oldest"), F.max("lastmod").alias("newest"))
    w = Window.partitionBy("site").orderBy("__n")
    stop = F.col("oldest").isNull() | (F.col("oldest") < F.lit(start - timedelta(days=MARGIN)))
    ends = ends.withColumn("__at", F.row_number().over(w)).withColumn("__stopped", F.coalesce(F.max(stop).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)))
    read = ends.where((F.col("__at") == F.col("__n")) & ~F.col("__stopped") & F.col("newest").isNotNull() & (F.col("__n") <= most)).select("site", "__n")
    return _dated(listed.join(read, ["site", "__n"]), start, end, undated=False)


def by_archive(pages: DataFrame, index: str, numbered: str, start: date, end: date) -> DataFrame:
    """An index dates its numbered files by their newest entry: files that end before the window are never read."""
    pages = _there(pages)
    files = feeds.blocks(pages.where(F.col("page") == index), "sitemap").where(F.col("url").rlike(numbered))
    files = files.where(F.coalesce(F.col("lastmod") >= F.lit(start - timedelta(days=MARGIN)), F.lit(True))).select("site", F.col("url").alias("page"))
    return _dated(feeds.blocks(pages.join(files, ["site", "page"])), start, end)


def probe_days(start: date, end: date, step: int = 7) -> list[date]:
    """Every ``step`` days from the start, and the end."""
    return sorted({start + timedelta(days=k) for k in range(0, (end - start).days + 1, step)} | {end})


def by_snapshots(snapshots: DataFrame, pages: DataFrame, site: str, start: date, end: date, margin: int = 30) -> DataFrame:
    """(url) of the article links on archived listing pages whose snapshot lies at most ``margin`` days outside the window; each address
    once. ``snapshots`` is (snapshot, captured)."""
    ok = snapshots.where(F.col("captured").between(F.lit(start - timedelta(days=margin)), F.lit(end + timedelta(days=margin)))).select(F.col("snapshot").alias("page")).distinct()
    return feeds.archived_links(_there(pages).join(ok, "page"), site).select("url").distinct()


def fetched_once(candidates: DataFrame, pages: DataFrame, limit: int = 0) -> tuple[DataFrame, DataFrame]:
    """Parse each candidate's page once: (the items, the counts of what went wrong). ``candidates`` is (seq, source, url), the first of
    an address counts; ``pages`` is (url, status, text, headline). An address is an error of kind ``robots`` (status -1), ``http`` (no
    page or another status than 200), ``parse`` (no text) or ``empty`` (no headline). ``limit`` keeps the first items by order."""
    first = candidates.groupBy("url").agg(F.min_by(F.struct("seq", "source"), "seq").alias("c")).select("url", "c.seq", "c.source")
    x = first.join(pages, "url", "left")
    kind = (
        F.when(F.col("status") == -1, "robots").when(F.coalesce(F.col("status") != 200, F.lit(True)), "http")
        .when(F.col("text").isNull(), "parse").when(F.coalesce(F.col("headline"), F.lit("")) == "", "empty").otherwise("ok")
    )
    x = x.withColumn("outcome", kind)
    items = x.where("outcome = 'ok'").select("seq", "source", "url", "headline")
    return (items.orderBy("seq").limit(limit) if limit else items), x.groupBy("outcome").agg(F.count("*").alias("addresses"))
