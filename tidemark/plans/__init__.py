"""Named queries over the tables, by area; each module has QUERIES and ORACLES."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

AREAS = ("cleaning", "market", "news", "series", "ingest", "extension", "statistics", "streams")


def _all(what: str) -> dict:
    out: dict = {}
    for area in AREAS:
        out |= getattr(importlib.import_module(f"tidemark.plans.{area}"), what)
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _all("QUERIES")


def oracles() -> dict[str, str]:
    return _all("ORACLES")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["e2_daily"](spark, sf_dir)
