"""Queries of the core's data-cleaning operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators import timestamps
from tidemark.session import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed, outlets = table(spark, sf_dir, "news_feed"), table(spark, sf_dir, "outlets")
    return timestamps.normalize(feed.select("feed_id", "source", "published_at"), outlets).select("feed_id", "instant_us", "confidence")


QUERIES = {"p3_found": p3_found}
ORACLES: dict[str, str] = {}
