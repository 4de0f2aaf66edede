"""Choosing what to fetch: slug filter, interleaving, an evenly spaced cap, windows and funnel counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import broadcast_if_small

#: Words of a company name that tell nothing in a slug (fixed values).
COMMON_WORDS = ("ltd", "limited", "inc", "the", "and")


def slug_tokens(alias: Column) -> Column:
    """The distinct words of an alias of more than two characters, without common ones."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(alias), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: (F.length(w) > 2) & ~w.isin(*COMMON_WORDS)))


def prefilter(candidates: DataFrame, groups: str, skip: int = 0) -> DataFrame:
    """The candidates whose url holds two words (or the only one) of one of their token groups; sources of at most ``skip``
    candidates pass whole. ``groups`` is a column of arrays of words."""
    sizes = candidates.groupBy("source").agg(F.count("*").alias("__n"))
    url = F.lower("url")
    hit = F.exists(groups, lambda g: (F.size(g) > 0) & (F.size(F.filter(g, lambda t: F.contains(url, t))) >= F.least(F.lit(2), F.size(g))))
    return candidates.join(sizes, "source").where((F.col("__n") <= skip) | F.coalesce(hit, F.lit(False))).drop("__n")


def ranked(rows: DataFrame, key: str, seq: str, size: int = 100_000) -> DataFrame:
    """Adds ``__rn``, each row's place within ``key`` by ``seq`` (unique whole numbers). Windows hold a run of ``size`` seq of a key;
    what lies before a run is summed over the runs, so a key with most of the rows is many tasks."""
    x = rows.withColumn("__run", F.floor(F.col(seq) / size))
    runs = x.groupBy(key, "__run").agg(F.count("*").alias("__n"))
    before = runs.withColumn("__before", F.sum("__n").over(Window.partitionBy(key).orderBy("__run")) - F.col("__n")).drop("__n")  # one row a run
    own = F.row_number().over(Window.partitionBy(key, "__run").orderBy(seq))
    x = x.withColumn("__own", own).alias("x").join(before.alias("y"), (F.col(f"x.{key}").eqNullSafe(F.col(f"y.{key}"))) & (F.col("x.__run") == F.col("y.__run")))
    return x.select("x.*", "__before").withColumn("__rn", F.col("__own") + F.col("__before")).drop("__own", "__before", "__run")


def interleaved(candidates: DataFrame, seq: str = "seq") -> DataFrame:
    """Adds ``place``: round-robin over the sources in the order they were first seen. The place is a count over ranks, so nothing is
    sorted in one task."""
    x = ranked(candidates, "source", seq)
    first = candidates.groupBy("source").agg(F.min(seq).alias("first"), F.count("*").alias("n"))
    order = first.withColumn("__k", F.row_number().over(Window.orderBy("first")))  # one row a source
    # rows before (rn, k): all those of smaller ranks, and in rank rn the sources before k that reach it. Sources sorted by size give
    # the number of rows below a rank in one step for every rank between two sizes.
    steps = order.withColumn("__low", F.coalesce(F.lag("n").over(Window.orderBy("n", "__k")), F.lit(0))).withColumn("__left", F.count("*").over(Window.orderBy(F.desc("n"), F.desc("__k"))))
    steps = steps.withColumn("__below", F.sum((F.col("n") - F.col("__low")) * F.col("__left")).over(Window.orderBy("n", "__k")) - (F.col("n") - F.col("__low")) * F.col("__left"))
    steps = steps.where("n > __low").select("__low", F.col("n").alias("__high"), "__left", "__below")  # ranks low + 1 .. high
    reach = order.alias("o").join(order.alias("p"), F.col("p.__k") < F.col("o.__k")).groupBy(F.col("o.source").alias("source")).agg(F.sort_array(F.collect_list("p.n")).alias("__sizes"))
    x = x.join(order.select("source", "__k"), "source").join(reach, "source", "left")
    x = x.join(broadcast_if_small(steps), (F.col("__rn") > F.col("__low")) & (F.col("__rn") <= F.col("__high")))  # as many steps as sources at most
    ahead = F.size(F.filter(F.coalesce("__sizes", F.array().cast("array<bigint>")), lambda n: n >= F.col("__rn")))
    place = F.col("__below") + (F.col("__rn") - F.col("__low") - 1) * F.col("__left") + ahead + 1
    return x.withColumn("place", place.cast("bigint")).drop("__rn", "__k", "__sizes", "__low", "__high", "__left", "__below")


def capped(placed: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` rows, evenly spaced by ``place``: those at positions int(i * n / limit)."""
    n = placed.count()
    if n <= limit:
        return placed
    spots = placed.sparkSession.range(limit).select((F.floor(F.col("id") * F.lit(float(n)) / F.lit(float(limit))) + 1).alias("place"))
    return placed.join(spots, "place", "left_semi")
