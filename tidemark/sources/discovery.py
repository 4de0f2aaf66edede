"""Candidates from many sources with a status each, directories, quarterly tables and feasibility findings; parsing of fetched text."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import written

CANDIDATE = "source string, url string, hint_date date, seq bigint"


def discovered(spark: SparkSession, sources: dict[str, Callable[[], DataFrame]], wanted: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """The union of the wanted sources' candidates, in the order given, and a status by source. A source that is unknown or fails,
    when it is planned or while it runs, gives a status and no candidates; the others aren't touched by it. Each source is written to
    the shared folder on its own for that."""
    out, status = spark.createDataFrame([], CANDIDATE), {}
    for k, name in enumerate(wanted):
        if name not in sources:
            status[name] = "unknown source"
            continue
        try:
            one = sources[name]().select(F.lit(name).alias("source"), "url", "hint_date", (F.lit(k).cast("bigint") * (1 << 40) + F.monotonically_increasing_id()).alias("seq"))
            out, status[name] = out.unionByName(written(one, "candidates")), "ok"
        except Exception as e:  # one source's failure is its status
            status[name] = f"failed: {type(e).__name__}"
    return out, status


def directory(pages: DataFrame, text: str = "text") -> DataFrame:
    """(name, href) of a directory's cards; the first name of an address counts."""
    pattern = r'(?is)<a[^>]+href="([^"]+)"[^>]*>\s*(?:<[^>]+>\s*)*([^<]+?)\s*<'
    links = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("href"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("name"))
    x = pages.select(F.posexplode(links).alias("pos", "l")).select("pos", "l.href", F.trim("l.name").alias("name"))
    return x.groupBy("href").agg(F.min_by("name", "pos").alias("name"))


def number(text: str | None) -> float | None:
    """A figure as printed: thousands separators, percent signs, brackets for negatives; None for masks and blanks."""
    t = (text or "").replace(",", "").replace("%", "").replace("₹", "").strip()
    negative = t.startswith("(") and t.endswith(")")
    t = t.strip("()")
    try:
        return -float(t) if negative else float(t)
    except ValueError:
        return None


class _Table(HTMLParser):
    """The cells of the first table whose header has dates."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list[str]] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "tr":
            self.rows.append([])
        if tag in ("td", "th") and self.rows:
            self.cell = []

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th") and self.cell is not None:
            self.rows[-1].append(re.sub(r"\s+", " ", "".join(self.cell)).strip())
            self.cell = None

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell.append(data)


_QUARTER = re.compile(r"^(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]* (\d{4})$", re.I)


def quarterly(html: str | None) -> list[tuple[str, str, float | None]]:
    """(label, quarter, value) of a page's quarterly table."""
    t = _Table()
    t.feed(html or "")
    head = next((r for r in t.rows if sum(bool(_QUARTER.match(c)) for c in r) >= 2), None)
    if head is None:
        return []
    at = [(k, c) for k, c in enumerate(head) if _QUARTER.match(c)]
    after = t.rows[t.rows.index(head) + 1 :]
    return [(r[0].rstrip(" +"), q, number(r[k]) if k < len(r) else None) for r in after if r and r[0] for k, q in at]


def quarters(pages: DataFrame) -> DataFrame:
    """(ticker, label, quarter, value) of (ticker, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(t, *r) for t, text in zip(b["ticker"], b["text"], strict=True) for r in quarterly(text)]
            yield pd.DataFrame(rows, columns=["ticker", "label", "quarter", "value"])

    return pages.select("ticker", "text").mapInPandas(run, "ticker string, label string, quarter string, value double")


def preferred(rows: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """Of the labels a ticker has any value for, the one preferred most."""
    rank = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("label"))
    best = rows.where((rank > 0) & F.col("value").isNotNull()).groupBy("ticker").agg(F.min_by("label", rank).alias("label"))
    return rows.join(best, ["ticker", "label"])


class _Insights(_Table):
    """The cells of the element named ``insights``, each as its first piece of text."""

    def __init__(self) -> None:
        super().__init__()
        self.depth, self.within = 0, False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.within:
            self.depth += tag == "section"
        elif dict(attrs).get("id") == "insights":
            self.within, self.depth = True, 1
        if self.within:
            super().handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        super().handle_endtag(tag)
        if self.within and tag == "section":
            self.depth -= 1
            self.within = self.depth > 0

    def handle_data(self, data: str) -> None:
        if self.within and self.cell is not None and not self.cell and data.strip():
            self.cell.append(data)


def order_book(html: str | None) -> tuple[str, float | None]:
    """(status, latest value): 'available', 'masked' where the row is there without a figure, 'not applicable' without such a row."""
    t = _Insights()
    t.feed(html or "")
    for row in t.rows:
        if row and row[0] == "Order Book":
            values = [number(c) for c in row[1:]]
            return ("available", values[-1]) if any(v is not None for v in values) else ("masked", None)
    return "not applicable", None


def order_books(pages: DataFrame) -> DataFrame:
    """(ticker, status, value) of (ticker, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(t, *order_book(text)) for t, text in zip(b["ticker"], b["text"], strict=True)], columns=["ticker", "status", "value"])

    return pages.select("ticker", "text").mapInPandas(run, "ticker string, status string, value double")


def _latest(quarters_: DataFrame) -> DataFrame:
    """(ticker, label, values): the values of each row in order of time; some dozens of quarters."""
    day = F.to_date(F.concat(F.lit("01 "), F.initcap(F.substring("quarter", 1, 3)), F.substring_index("quarter", " ", -1)), "dd MMMyyyy")
    x = quarters_.groupBy("ticker", "label").agg(F.array_sort(F.collect_list(F.struct(day.alias("day"), "value"))).alias("v"))
    return x.select("ticker", "label", F.transform("v", lambda q: q["value"]).alias("values"))


def _back(values: Column, k: int) -> Column:
    return F.try_element_at(values, F.lit(-1 - k))


def changed(values: Column, k: int) -> Column:
    """The change from ``k`` quarters back to the latest, relative to the size of the earlier; null where either is missing or 0."""
    return F.try_divide(_back(values, 0) - _back(values, k), F.abs(_back(values, k)))


def nopat(quarters_: DataFrame, income: tuple[str, ...] = ("Operating Profit", "Financing Profit"), tax: str = "Tax %") -> DataFrame:
    """(ticker, nopat): the latest operating income after the latest tax rate; null where either is missing."""
    own = _latest(preferred(quarters_, income)).select("ticker", _back(F.col("values"), 0).alias("income"))
    rate = _latest(quarters_.where(F.col("label") == tax)).select("ticker", _back(F.col("values"), 0).alias("rate"))
    return own.join(rate, "ticker", "left").select("ticker", (F.col("income") * (1 - F.col("rate") / 100)).alias("nopat"))


def financials(tickers: DataFrame, quarters_: DataFrame, revenue: tuple[str, ...]) -> DataFrame:
    """(ticker, label, revenue, qoq, yoy, tax_rate, nopat) of every ticker; what a page lacks is null."""
    rows = _latest(preferred(quarters_, revenue))
    v = F.col("values")
    own = rows.select("ticker", "label", _back(v, 0).alias("revenue"), changed(v, 1).alias("qoq"), changed(v, 4).alias("yoy"))
    rate = _latest(quarters_.where("label = 'Tax %'")).select("ticker", _back(v, 0).alias("tax_rate"))
    return tickers.join(own, "ticker", "left").join(rate, "ticker", "left").join(nopat(quarters_), "ticker", "left")


def reading(pages: DataFrame, pattern: str, text: str = "text") -> DataFrame:
    """Adds ``value``: the first figure that a pattern's group finds, null where it finds none."""
    return pages.withColumn("value", F.replace(F.regexp_extract(text, pattern, 1), F.lit(",")).try_cast("double"))


def javascript_shell(text: str = "text") -> Column:
    """Whether a page is a shell that scripts fill: very short, or a hint of one and no article."""
    low = F.lower(text)
    hint = low.rlike(r"__next_data__|ng-app|data-reactroot|enable javascript|window\.__initial_state__")
    return (F.length(text) < 2000) | (hint & ~F.contains(low, F.lit("<article")))


def verdicts(findings: DataFrame) -> DataFrame:
    """Adds ``verdict`` to (source, allowed, candidates, body_chars, has_time, shell): the first thing that stands in the way."""
    v = (
        F.when(~F.col("allowed"), "blocked by robots").when(F.coalesce("candidates", F.lit(0)) == 0, "nothing discovered").when(F.col("shell"), "needs scripts")
        .when(F.coalesce("body_chars", F.lit(0)) < 600, "no usable text").when(~F.coalesce("has_time", F.lit(False)), "no timestamps").otherwise("usable")
    )
    return findings.withColumn("verdict", v)


def provenance(pages: DataFrame) -> DataFrame:
    """(url, status, fetched_at, characters, sha256) of fetched pages; the length is in characters."""
    return pages.select("url", "status", "fetched_at", F.length("text").alias("characters"), F.sha2("text", 256).alias("sha256"))
