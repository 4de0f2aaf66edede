"""As-of joins on dates. Only the distinct (symbol, date) pairs are sorted, a few thousand a symbol however many rows it has; the
result is a map that rows are equi-joined with, so no window ever holds a symbol's rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The close of the session, local to the exchange.
CLOSE, ZONE = "15:30:00", "Asia/Kolkata"


def session_map(days: DataFrame, sessions: DataFrame, forward: bool, strict: bool = False) -> DataFrame:
    """(symbol, date, session): for each distinct (symbol, date) of ``days`` the nearest session at or after it, or at or before it
    (``strict``: never the day itself). Dates beyond the last session have a null session."""
    left = days.where("symbol is not null and date is not null").select("symbol", "date").distinct().withColumn("session", F.lit(None).cast("date"))
    right = sessions.select("symbol", "date").distinct().withColumn("session", F.col("date"))
    side = F.when(F.col("session").isNotNull(), 1).otherwise(0)
    own_first = side if strict else -side  # strict: the day's own session is met after the day
    order = (F.desc("date"), own_first) if forward else (F.asc("date"), own_first)
    w = Window.partitionBy("symbol").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = left.unionByName(right).withColumn("found", F.last("session", ignorenulls=True).over(w))
    return x.where("session is null").select("symbol", "date", F.col("found").alias("session"))


def local(ts: Column) -> Column:
    return F.from_utc_timestamp(ts, ZONE)


def attributed(news: DataFrame, sessions: DataFrame) -> DataFrame:
    """Adds after_close and session: an item published at or after the close, with an exact time, belongs to the next session,
    any other to its day's session or the next one; without an instant, or past the last session, to none."""
    ts = local(F.col("published_at"))
    late = (F.coalesce(F.lower("timestamp_confidence"), F.lit("")) != "date-only") & (F.date_format(ts, "HH:mm:ss") >= CLOSE)
    x = news.withColumn("is_late", F.coalesce(late, F.lit(False))).withColumn("search_day", F.date_add(F.to_date(ts), F.col("is_late").cast("int")))
    found = session_map(x.select("symbol", F.col("search_day").alias("date")), sessions, forward=True)
    return x.join(found.withColumnRenamed("date", "search_day"), ["symbol", "search_day"], "left")
