"""Price frames, returns, the market model and abnormal returns, for all symbols at once.

Every frame is keyed by (symbol, date). Windows are partitioned by symbol; per-symbol tables (models, thresholds) hold one row a
symbol and are joined by the planner's choice. Missing numbers are null, never NaN.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import t_equivalent, t_two_sided

ESTIMATION_DAYS, MIN_DAYS, GAP_DAYS = 120, 40, 5
EVENT_WINDOW = (-1, 3)
#: Calendar days loaded before and after a window.
LEAD_IN, TAIL = 200, 21


def by_day() -> Window:
    return Window.partitionBy("symbol").orderBy("date")


def frame(prices: DataFrame) -> DataFrame:
    """One row a symbol and date: the one delivered last wins, then rows without a close go."""
    last = Window.partitionBy("symbol", "date").orderBy(F.desc("seq"))
    x = prices.where("symbol is not null and date is not null").withColumn("rn", F.row_number().over(last))
    return x.where("rn = 1 and close is not null").select("symbol", "date", "close", "volume")


def market(frame_: DataFrame) -> DataFrame:
    """(date, benchmark_close): the mean close of all symbols."""
    return frame_.groupBy("date").agg(F.avg("close").alias("benchmark_close"))


def simple_return(close: str) -> Column:
    return F.try_divide(F.col(close), F.lag(close).over(by_day())) - 1


def aligned(frame_: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Both closes on common dates, and then both returns."""
    x = frame_.join(benchmark, "date").where("benchmark_close is not null")
    return x.select("symbol", "date", "close", "volume", "benchmark_close", simple_return("close").alias("ret"), simple_return("benchmark_close").alias("bret"))


def models(aligned_: DataFrame, start: str, days: int = ESTIMATION_DAYS, least: int = MIN_DAYS, gap: int = GAP_DAYS) -> DataFrame:
    """The market model of each symbol over the rows before ``start``; beta 1 and alpha 0 where it can't be fitted.

    The last ``gap`` rows are left out where there are more, then the last ``days`` are taken. (symbol, alpha, beta, residual_sd,
    observations, r_squared, fitted)
    """
    back = Window.partitionBy("symbol").orderBy(F.desc("date"))
    before = aligned_.where((F.col("date") < F.lit(start).cast("date")) & F.col("ret").isNotNull() & F.col("bret").isNotNull())
    x = before.withColumn("rn", F.row_number().over(back)).withColumn("n", F.count("*").over(Window.partitionBy("symbol")))
    skip = F.when(F.col("n") > gap, gap).otherwise(0)
    x = x.where((F.col("rn") > skip) & (F.col("rn") <= skip + days))
    s = x.groupBy("symbol").agg(
        F.count("*").alias("observations"), F.avg("bret").alias("mx"), F.avg("ret").alias("my"),
        (F.var_pop("bret") * F.count("*")).alias("sxx"), (F.var_pop("ret") * F.count("*")).alias("syy"), (F.covar_pop("bret", "ret") * F.count("*")).alias("sxy"),
    )
    fitted = (F.col("observations") >= least) & (F.col("sxx") > 0)
    beta = F.col("sxy") / F.col("sxx")
    ssr = F.greatest(F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx"), F.lit(0.0))
    s = aligned_.select("symbol").distinct().join(s, "symbol", "left").withColumn("observations", F.coalesce("observations", F.lit(0)))
    fitted = F.coalesce(fitted, F.lit(False))
    return s.select(
        "symbol",
        F.when(fitted, F.col("my") - beta * F.col("mx")).otherwise(0.0).alias("alpha"),
        F.when(fitted, beta).otherwise(1.0).alias("beta"),
        F.when(fitted & (F.col("observations") > 2), F.sqrt(ssr / (F.col("observations") - 2))).alias("residual_sd"),
        "observations",
        F.when(fitted & (F.col("syy") > 0), 1 - ssr / F.col("syy")).alias("r_squared"),
        fitted.alias("fitted"),
    )


def built(frame_: DataFrame, benchmark: DataFrame, start: str, end: str, lead_in: int = LEAD_IN, tail: int = TAIL, least: int = MIN_DAYS) -> DataFrame:
    """Abnormal returns of a window with what is needed around it: ``lead_in`` calendar days before it for the model, ``tail`` days after
    it for cumulative returns. ``in_window`` tells the window's own rows (both ends count)."""
    day = lambda d: F.lit(d).cast("date")
    near = F.col("date").between(F.date_sub(day(start), lead_in), F.date_add(day(end), tail))
    x = aligned(frame_.where(near), benchmark.where(near))
    return abnormal(x, models(x, start, least=least)).withColumn("in_window", F.col("date").between(day(start), day(end)))


def abnormal(aligned_: DataFrame, models_: DataFrame) -> DataFrame:
    """Expected and abnormal return of each day, and its z by the residual SD; where there is none, by the SD of the symbol's
    abnormal returns. Adds expected, ar, scale, scale_df, z."""
    x = aligned_.join(models_.select("symbol", "alpha", "beta", "residual_sd", "observations"), "symbol")
    x = x.withColumn("expected", F.col("alpha") + F.col("beta") * F.col("bret")).withColumn("ar", F.col("ret") - F.col("expected"))
    own = Window.partitionBy("symbol")
    usable = F.coalesce(F.col("residual_sd") > 0, F.lit(False))
    x = x.withColumn("scale", F.when(usable, F.col("residual_sd")).otherwise(F.stddev_samp("ar").over(own)))
    x = x.withColumn("scale_df", F.when(usable, F.greatest(F.col("observations") - 2, F.lit(0))).otherwise(F.greatest(F.count("*").over(own) - 1, F.lit(0))).cast("int"))
    return x.withColumn("z", F.when(F.col("scale") > 0, F.col("ar") / F.col("scale"))).drop("alpha", "beta", "residual_sd", "observations")


def thresholds(df_values: DataFrame, z: float) -> DataFrame:
    """(scale_df, threshold): the t value as rare as ``z``, for each distinct degree of freedom (at most one a row count)."""
    found = sorted(r[0] for r in df_values.select("scale_df").distinct().collect())
    return df_values.sparkSession.createDataFrame([(d, t_equivalent(z, d)) for d in found] or [(0, z)], "scale_df int, threshold double")


def grid_thresholds(df_values: DataFrame, cells: list[tuple[float, float]]) -> DataFrame:
    """(cell, coverage_z, scale_df, threshold) of every (coverage z, return z) cell and distinct degree of freedom."""
    found = sorted(r[0] for r in df_values.select("scale_df").distinct().collect())
    rows = [(k, c, d, t_equivalent(z, d)) for k, (c, z) in enumerate(cells) for d in found or [0]]
    return df_values.sparkSession.createDataFrame(rows, "cell int, coverage_z double, scale_df int, threshold double")


def cumulative(abnormal_: DataFrame, events: DataFrame, window: tuple[int, int] = EVENT_WINDOW) -> DataFrame:
    """The cumulative abnormal return around each event of (symbol, day), over trading-day offsets from the event day or the next
    session. (symbol, day, anchor, car, days, truncated, t_stat); events after the last session have none."""
    lo, hi = window
    rows = abnormal_.select("symbol", "date", "ar", "scale", F.row_number().over(by_day()).alias("pos"), F.count("*").over(Window.partitionBy("symbol")).alias("n"))
    anchored = anchor(events, rows.select("symbol", "date"))
    at = anchored.join(rows.select("symbol", F.col("date").alias("anchor"), F.col("pos").alias("at"), "n", "scale"), ["symbol", "anchor"])
    steps = at.withColumn("pos", F.explode(F.sequence(F.greatest(F.col("at") + lo, F.lit(1)), F.least(F.col("at") + hi, F.col("n")))))
    x = steps.join(rows.select("symbol", "pos", "ar"), ["symbol", "pos"])
    x = x.groupBy("symbol", "day", "anchor").agg(F.sum(F.coalesce("ar", F.lit(0.0))).alias("car"), F.count("*").alias("days"), F.max("scale").alias("scale"))
    return x.select("symbol", "day", "anchor", "car", "days", (F.col("days") < hi - lo + 1).alias("truncated"), F.when(F.col("scale") > 0, F.col("car") / (F.col("scale") * F.sqrt("days"))).alias("t_stat"))


@lru_cache(maxsize=100_000)
def _p_value(t: float, df: int) -> float:
    return t_two_sided(t, df)


def significant(cars: DataFrame) -> DataFrame:
    """Adds ``p_value`` to (t_stat, df): how often Student's t is as far from 0 on either side; null without a t or degrees of freedom."""

    @F.pandas_udf("double")
    def p(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([_p_value(float(a), int(b)) if pd.notna(a) and pd.notna(b) and b > 0 else None for a, b in zip(t, df, strict=True)], dtype="float64")

    return cars.withColumn("p_value", p("t_stat", "df"))


def anchor(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """The session on the event day or the next one after it: events and sessions in one sort a symbol, no theta join."""
    both = events.select("symbol", "day", F.col("day").alias("date"), F.lit(0).alias("side")).unionByName(sessions.select("symbol", F.lit(None).cast("date").alias("day"), "date", F.lit(1).alias("side")))
    back = Window.partitionBy("symbol").orderBy(F.desc("date"), F.desc("side")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = both.withColumn("anchor", F.last(F.when(F.col("side") == 1, F.col("date")), ignorenulls=True).over(back))
    return x.where("side = 0 and anchor is not null").select("symbol", "day", "anchor").distinct()


def permutation(abnormal_: DataFrame, flagged: DataFrame, cars: DataFrame, least: int = 10, most: int = 2000, seed: int = 42) -> DataFrame:
    """The share of all same-length windows of non-null abnormal returns, free of flagged days, whose sum is at least as large as
    the real one. (symbol, day, windows, p_value), p null where fewer than ``least`` windows are left. Of more than ``most``
    windows that many are drawn without replacement, by a seeded generator over their order in time."""
    marks = flagged.select("symbol", F.col("day").alias("date"), F.lit(1).alias("hit")).distinct()
    rows = abnormal_.where("ar is not null").select("symbol", "date", "ar").join(marks, ["symbol", "date"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    lengths = cars.select("days").distinct()  # at most the window's length
    out = None
    for n in sorted(r[0] for r in lengths.collect()):
        w = by_day().rowsBetween(0, n - 1)
        one = rows.select("symbol", "date", F.sum("ar").over(w).alias("s"), F.max("hit").over(w).alias("touched"), F.count("*").over(w).alias("k"), F.lit(n).cast("bigint").alias("days")).where(f"k = {n} and touched = 0")
        out = one if out is None else out.unionByName(one)
    if out is not None:
        out = _drawn(out, most, seed)
    if out is None:
        return cars.select("symbol", "day", F.lit(0).cast("bigint").alias("windows"), F.lit(None).cast("double").alias("p_value"))
    x = cars.join(out, ["symbol", "days"], "left").groupBy("symbol", "day").agg(F.count("s").alias("windows"), F.avg(F.when(F.abs("s") >= F.abs("car") - 1e-12, 1.0).when(F.col("s").isNotNull(), 0.0)).alias("share"))
    return x.select("symbol", "day", "windows", F.when(F.col("windows") >= least, F.col("share")).alias("p_value"))


def _drawn(windows: DataFrame, most: int, seed: int) -> DataFrame:
    """At most ``most`` windows of each symbol and length. The positions depend on the count of windows only."""
    keys = ["symbol", "days"]
    x = windows.withColumn("m", F.count("*").over(Window.partitionBy(*keys))).withColumn("i", F.row_number().over(Window.partitionBy(*keys).orderBy("date")) - 1)
    sizes = [r[0] for r in x.where(F.col("m") > most).select("m").distinct().collect()]  # at most one a series length
    if not sizes:
        return x.drop("m", "i", "date")
    picks = [(m, int(i)) for m in sizes for i in np.random.default_rng(seed).choice(m, size=most, replace=False)]
    chosen = windows.sparkSession.createDataFrame(picks, "m bigint, i int")
    return x.where(F.col("m") <= most).unionByName(x.where(F.col("m") > most).join(F.broadcast(chosen), ["m", "i"])).drop("m", "i", "date")
