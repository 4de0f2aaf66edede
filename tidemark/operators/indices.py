"""Reference indices beside the companies: their own event study on flagged days, their levels, and sessions of markets abroad."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import asof as A
from tidemark.operators import market as M


def next_weekday(day: Column) -> Column:
    """The first day after ``day`` from Monday to Friday: what stands in for the next session without a calendar."""
    k = F.weekday(day)  # Monday is 0
    return F.date_add(day, F.when(k == 4, 3).when(k == 5, 2).otherwise(1))


def described(frames: DataFrame, start: str) -> DataFrame:
    """(symbol, sessions, window_return) of each index from ``start`` on."""
    x = frames.where(F.col("date") >= F.lit(start).cast("date")).groupBy("symbol").agg(F.count("*").alias("sessions"), F.min_by("close", "date").alias("a"), F.max_by("close", "date").alias("z"))
    return x.select("symbol", "sessions", (F.try_divide("z", "a") - 1).alias("window_return"))


def studied(frames: DataFrame, benchmark: DataFrame, same: str, days: DataFrame, start: str, least: int = M.MIN_DAYS) -> DataFrame:
    """(symbol, day, ar, z, car, days): the event study of each index (symbol, date, close, volume) against the benchmark on (day), for
    days that are its sessions from ``start`` on. An index that is the benchmark itself (``same``) has none, and neither has one without
    prices; the others aren't touched by that."""
    x = M.aligned(frames.where(F.col("symbol") != same), benchmark)
    a = M.abnormal(x, M.models(x, start, least=least))
    at = a.where(F.col("date") >= F.lit(start).cast("date")).join(days.select(F.col("day").alias("date")), "date").select("symbol", F.col("date").alias("day"), "ar", "z")
    return at.join(M.cumulative(a, at.select("symbol", "day")).select("symbol", "day", "car", "days"), ["symbol", "day"])


def aligned(frames: DataFrame, days: DataFrame, same_day: dict[str, bool]) -> DataFrame:
    """(date, symbol, session, ret, z): for each of our days the latest session of each index known by our close: the day's own for those
    that trade at our time, else an earlier one. Returns and z are by the index's whole history; sessions without a return are left out."""
    own = Window.partitionBy("symbol")
    x = frames.where(F.col("symbol").isin(list(same_day))).withColumn("ret", M.simple_return("close"))
    mean, sd = F.avg("ret").over(own), F.stddev_samp("ret").over(own)
    x = x.select("symbol", F.col("date").alias("session"), "ret", F.when(sd > 0, (F.col("ret") - mean) / sd).otherwise(0.0).alias("z")).where("ret is not null")
    out = None
    for strict in (False, True):
        names = [n for n, same in same_day.items() if same != strict]
        each = days.select("date").withColumn("symbol", F.explode(F.array(*[F.lit(n) for n in names]))) if names else None
        if each is None:
            continue
        one = A.session_map(each, frames.where(F.col("symbol").isin(names)), forward=False, strict=strict)
        out = one if out is None else out.unionByName(one)
    return out.join(x, ["symbol", "session"])
