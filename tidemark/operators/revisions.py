"""Change points of a series, the moves between them, and interval arithmetic for caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def revisions(frame: DataFrame) -> DataFrame:
    """The rows at which the close changed; the first row counts, a return to an old level as well."""
    w = Window.partitionBy("symbol").orderBy("date")
    x = frame.withColumn("__before", F.lag("close").over(w)).withColumn("__first", F.row_number().over(w) == 1)
    return x.where(F.col("__first") | ~F.col("close").eqNullSafe(F.col("__before"))).drop("__before", "__first")


def moves(revised: DataFrame) -> DataFrame:
    """(symbol, start, end, start_close, end_close, change) between consecutive revisions."""
    w = Window.partitionBy("symbol").orderBy("date")
    x = revised.select("symbol", F.col("date").alias("start"), F.lead("date").over(w).alias("end"), F.col("close").alias("start_close"), F.lead("close").over(w).alias("end_close"))
    return x.where("end is not null").withColumn("change", F.try_divide(F.col("end_close") - F.col("start_close"), F.col("start_close")))


def merged(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Segments (start, end) that overlap or lie at most a day apart, as one, within ``keys``."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    seen = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    x = segments.withColumn("new", F.when(seen.isNull() | (F.col("start") > F.date_add(seen, 1)), 1).otherwise(0))
    x = x.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return x.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def gaps(segments: DataFrame, requests: DataFrame) -> DataFrame:
    """(symbol, start, end) of each request's days that no segment covers. Segments must already be those that suffice."""
    clipped = segments.join(requests.select("symbol", F.col("start").alias("lo"), F.col("end").alias("hi")), "symbol").where("end >= lo and start <= hi")
    m = merged(clipped.select("symbol", "lo", "hi", F.greatest("start", "lo").alias("start"), F.least("end", "hi").alias("end")), ["symbol", "lo", "hi"])
    w = Window.partitionBy("symbol", "lo", "hi").orderBy("start")
    m = m.withColumn("before", F.coalesce(F.date_add(F.lag("end").over(w), 1), F.col("lo"))).withColumn("last", F.lead("start").over(w).isNull())
    ahead = m.where("before < start").select("symbol", F.col("before").alias("start"), F.date_sub("start", 1).alias("end"))
    after = m.where("last and end < hi").select("symbol", F.date_add("end", 1).alias("start"), F.col("hi").alias("end"))
    whole = requests.join(clipped.select("symbol").distinct(), "symbol", "left_anti").select("symbol", "start", "end")
    return ahead.union(after).union(whole)


def outside(items: DataFrame, intervals: DataFrame, day: str) -> DataFrame:
    """The items whose day lies in no interval (start, end) of their symbol: intervals are spelled out as days and anti-joined."""
    days = intervals.select("symbol", F.explode(F.sequence("start", "end")).alias(day)).distinct()
    return items.join(days, ["symbol", day], "left_anti")


def inside(items: DataFrame, intervals: DataFrame, day: str) -> DataFrame:
    """The items whose day lies in an interval (start, end) of their symbol."""
    days = intervals.select("symbol", F.explode(F.sequence("start", "end")).alias(day)).distinct()
    return items.join(days, ["symbol", day], "left_semi")


def sufficient(segments: DataFrame, requests: DataFrame) -> DataFrame:
    """(symbol, start, end) of the segments whose ``sources`` hold all sources that the symbol's request has in ``wanted``."""
    x = segments.join(requests.select("symbol", "wanted"), "symbol")
    return x.where(F.size(F.array_except("wanted", "sources")) == 0).select("symbol", "start", "end")


def replaced(cached: DataFrame, fresh: DataFrame, gaps_: DataFrame, day: str) -> DataFrame:
    """What a cache holds after its gaps were filled: cached items outside them and the fresh ones. Of an address (symbol, url) a fresh
    item wins over a cached one, then the last one (seq)."""
    both = outside(cached, gaps_, day).withColumn("__fresh", F.lit(0)).unionByName(fresh.withColumn("__fresh", F.lit(1)))
    rest = [c for c in cached.columns if c not in ("symbol", "url")]
    x = both.groupBy("symbol", "url").agg(F.max_by(F.struct(*rest), F.struct("__fresh", "seq")).alias("x"))
    return x.select("symbol", "url", "x.*")
