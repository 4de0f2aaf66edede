"""Daily coverage, flagged days, their ranking and the statistics around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COVERAGE_Z, RETURN_Z, COVERED_DAYS, DIRECTION_BONUS = 1.0, 1.5, 10, 1.25
#: Emotion labels by valence (fixed values).
VALENCE = {
    "positive": ["admiration", "amusement", "approval", "caring", "desire", "excitement", "gratitude", "joy", "love", "optimism", "pride", "relief"],
    "negative": ["anger", "annoyance", "disappointment", "disapproval", "disgust", "embarrassment", "fear", "grief", "nervousness", "remorse", "sadness"],
    "ambiguous": ["confusion", "curiosity", "realization", "surprise"],
}


def valence(label: Column) -> Column:
    """The group of an emotion label, '' for neutral, blank and unknown ones."""
    out = F.lit("")
    for group, labels in VALENCE.items():
        out = F.when(label.isin(labels), group).otherwise(out)
    return out


def cluster_sizes(news: DataFrame) -> DataFrame:
    """(url, carriers): rows of each surviving item with its duplicates, by the survivor's url."""
    return news.groupBy("symbol", F.coalesce("duplicate_of", "url").alias("url")).agg(F.count("*").alias("carriers"))


def _dominant(news: DataFrame, label: str) -> DataFrame:
    """The most frequent non-blank label of a day; ties go to the one collected first."""
    x = news.where(F.col(label).isNotNull() & (F.col(label) != "")).groupBy("symbol", "trading_day", label).agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    return x.groupBy("symbol", "trading_day").agg(F.max_by(label, F.struct("n", -F.col("first"))).alias(f"dominant_{label}"))


def coverage(news: DataFrame) -> DataFrame:
    """One row a symbol and trading day: all items counted once, tone over items that are no duplicates."""
    attributed = news.where("trading_day is not null and symbol is not null")
    unique = attributed.where("duplicate_of is null")
    weighted = unique.join(cluster_sizes(news.where("symbol is not null")), ["symbol", "url"], "left").withColumn("w", F.greatest(F.coalesce("relevance_score", F.lit(0.0)), F.lit(0.01)) * F.coalesce("carriers", F.lit(1)))
    all_ = attributed.groupBy("symbol", "trading_day").agg(F.count("*").alias("item_count"), F.count_if(F.col("duplicate_of").isNull()).alias("unique_count"), F.count_if("after_close").alias("after_close_count"))
    tone = weighted.groupBy("symbol", "trading_day").agg(
        F.avg("sentiment_score").alias("mean_sentiment"), F.try_divide(F.sum(F.col("sentiment_score") * F.col("w")), F.sum(F.when(F.col("sentiment_score").isNotNull(), F.col("w")))).alias("weighted_sentiment"),
        F.min("sentiment_score").alias("min_sentiment"), F.max("sentiment_score").alias("max_sentiment"), F.avg("staleness_score").alias("mean_staleness"),
    )
    first = attributed.groupBy("symbol", "trading_day", "source").agg(F.min("seq").alias("first"))
    sources = first.groupBy("symbol", "trading_day").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "source"))), lambda s: s["source"]), ",").alias("sources"))
    keys = ["symbol", "trading_day"]
    return all_.join(tone, keys, "left").join(sources, keys, "left").join(_dominant(unique, "event_category"), keys, "left").join(_dominant(unique, "emotion_label"), keys, "left")


def _z(value: Column, mean: Column, sd: Column) -> Column:
    return F.coalesce(F.when(sd > 0, (value - mean) / sd), F.lit(0.0))


def daily(abnormal_: DataFrame, coverage_: DataFrame, start: str) -> DataFrame:
    """One row a session from ``start`` on: prices, coverage or zeros, and the z scores of coverage, tone and volume."""
    x = abnormal_.where(F.col("date") >= F.lit(start).cast("date")).join(coverage_.withColumnRenamed("trading_day", "date"), ["symbol", "date"], "left")
    x = x.fillna({"item_count": 0, "unique_count": 0, "mean_sentiment": 0.0, "weighted_sentiment": 0.0, "sources": "", "dominant_event_category": "", "dominant_emotion_label": ""})
    own = Window.partitionBy("symbol")
    covered = F.when(F.col("unique_count") > 0, F.col("weighted_sentiment"))
    return x.withColumns({
        "coverage_z": _z(F.col("unique_count").cast("double"), F.avg("unique_count").over(own), F.stddev_samp("unique_count").over(own)),
        "sentiment_z": F.when(F.col("unique_count") > 0, _z(F.col("weighted_sentiment"), F.avg(covered).over(own), F.stddev_samp(covered).over(own))).otherwise(0.0),
        "volume_z": F.when(F.col("volume").isNotNull(), _z(F.col("volume"), F.avg("volume").over(own), F.stddev_samp("volume").over(own))).otherwise(0.0),
        "covered_days": F.count_if(F.col("unique_count") > 0).over(own),
    })


def flags(daily_: DataFrame, thresholds_: DataFrame, coverage_z: float = COVERAGE_Z) -> DataFrame:
    """Adds coverage_unusual, return_unusual, candidate and the day's diagnostic bucket."""
    x = daily_.join(F.broadcast(thresholds_), "scale_df")  # one row a degree of freedom
    thin = F.col("covered_days") < COVERED_DAYS
    unusual = (F.col("unique_count") > 0) & (thin | (F.col("coverage_z") >= coverage_z) | (F.abs("sentiment_z") >= coverage_z))
    big = F.coalesce(F.abs("z") >= F.col("threshold"), F.lit(False))
    x = x.withColumns({"coverage_unusual": unusual, "return_unusual": big}).withColumn("candidate", F.col("coverage_unusual") & F.col("return_unusual"))
    bucket = F.when(F.col("candidate"), "candidate").when(F.col("coverage_unusual"), "coverage_only").when(F.col("return_unusual") & (F.col("unique_count") == 0), "no_coverage_big_move").when(F.col("return_unusual"), "return_only").otherwise("routine")
    return x.withColumn("bucket", bucket)


def incidents(flagged: DataFrame, top: int = 0) -> DataFrame:
    """The candidates with their score and rank within the symbol; ``top`` 0 means all."""
    agrees = (F.col("weighted_sentiment") * F.col("ar")) > 0
    score = F.abs("z") * (1 + F.greatest(F.col("coverage_z"), F.lit(0.0))) * (1 + F.abs("weighted_sentiment")) * F.when(agrees, DIRECTION_BONUS).otherwise(1.0)
    x = flagged.where("candidate").withColumns({"direction_agrees": agrees, "score": score})
    x = x.withColumn("rank", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("score"), "date")))
    return x.where(F.col("rank") <= top) if top else x


def diagnostics(flagged: DataFrame) -> DataFrame:
    """Days of each symbol by bucket."""
    names = ["candidate", "coverage_only", "return_only", "no_coverage_big_move", "routine"]
    return flagged.groupBy("symbol").agg(F.count("*").alias("days"), *[F.count_if(F.col("bucket") == n).alias(n) for n in names])


def pearson(x: Column, y: Column) -> tuple[Column, Column]:
    """(correlation of rows where both are given, their count); null for fewer than three or without variance."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    n = F.count_if(both)
    r = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return F.when(n >= 3, r), n


def lagged(daily_: DataFrame, horizons: tuple[int, ...] = (1, 5)) -> DataFrame:
    """The correlation of a covered day's tone with the abnormal return ``h`` rows later, by symbol and horizon."""
    order = Window.partitionBy("symbol").orderBy("date")
    x = daily_.select("symbol", "unique_count", F.col("weighted_sentiment").alias("tone"), *[F.lead("ar", h).over(order).alias(f"l{h}") for h in horizons])
    x = x.select("symbol", "unique_count", "tone", F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"l{h}").alias("later")) for h in horizons])).alias("p"))
    r, n = pearson(F.col("tone"), F.col("p.later"))
    return x.where("unique_count > 0").groupBy("symbol", F.col("p.horizon").alias("horizon")).agg(r.alias("r"), n.alias("n"))


def headlines(incidents_: DataFrame, news: DataFrame, limit: int = 5) -> DataFrame:
    """The ``limit`` strongest items that are no duplicates of each flagged day."""
    x = news.where("duplicate_of is null and trading_day is not null").join(incidents_.select("symbol", F.col("date").alias("trading_day")), ["symbol", "trading_day"])
    order = Window.partitionBy("symbol", "trading_day").orderBy(F.desc(F.abs("sentiment_score")), F.desc("relevance_score"), "seq")
    return x.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).select("symbol", "trading_day", "place", "seq", "headline")


def robustness(daily_: DataFrame, thresholds_: DataFrame) -> DataFrame:
    """How many cells of a grid of thresholds flag each day, in one pass: ``thresholds_`` is (cell, coverage_z, scale_df, threshold)."""
    x = daily_.join(F.broadcast(thresholds_.withColumnRenamed("coverage_z", "limit")), "scale_df")  # nine cells a degree of freedom
    unusual = (F.col("unique_count") > 0) & ((F.col("covered_days") < COVERED_DAYS) | (F.col("coverage_z") >= F.col("limit")) | (F.abs("sentiment_z") >= F.col("limit")))
    return x.where(unusual & (F.abs("z") >= F.col("threshold"))).groupBy("symbol", "date").agg(F.count("*").alias("cells"))
