"""Lines that one source prints in row after row.

Lines are compared by their letters in order, case dropped; lines without letters never count. For every (source, line) the rows
that hold it are counted, and its frequency inside the source is compared by log-likelihood ratio (G squared, one degree of
freedom) with its frequency outside. What every source prints has no excess over the outside frequency of the same line, so the
frequency inside is compared as well with what an ordinary line has outside (all line occurrences there, spread over all
different lines); the larger statistic counts. Over the (source, line) tests of MIN_ROWS rows the false-discovery rate is controlled by
Benjamini-Hochberg on a histogram of the statistic: its edges are logarithmic, so the histogram is small at any size, and lower
edges are used, so the control is on the safe side. Significant lines that also stand in MIN_ROWS rows and in SHARE of the
source's rows are the repeated ones; they are anti-joined and the rest is reassembled by position.

Defined results: null and empty texts have no lines; rows with a null source belong to no source and are left as they are; rows
without text count as rows of their source; a row counts once however often it holds a line; extra columns are kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import broadcast_if_small, written

MIN_ROWS, SHARE, FALSE_DISCOVERY = 3, 0.05, 0.05
#: Histogram bins a unit of ln(1 + statistic).
_BINS = 100


def _hashes(text: Column) -> Column:
    """The hash of each line's letters by position, null for lines without letters."""
    keys = F.transform(F.split(text, "\n"), lambda x: F.lower(F.regexp_replace(x, r"[^\p{L}]+", "")))
    return F.transform(keys, lambda k: F.when(k != "", F.xxhash64(k)))


def _likelihood(k: Column, n: Column, p: Column) -> Column:
    ln = lambda x: F.ln(F.greatest(x, F.lit(1e-300)))
    return k * ln(p) + (n - k) * ln(1 - p)


def scored(df: DataFrame) -> DataFrame:
    """(source, h, k, rows, statistic) of every line of a source that MIN_ROWS rows hold, with ``tests``, the count of them."""
    text = df.where("source is not null").select("source", _hashes(F.col("text")).alias("hs"))
    counts = text.select("source", F.explode(F.array_distinct(F.filter("hs", lambda h: h.isNotNull()))).alias("h")).groupBy("source", "h").agg(F.count("*").alias("k"))
    counts = written(counts, "line-counts")
    rows = written(df.where("source is not null").groupBy("source").agg(F.count("*").alias("rows")), "source-rows")
    total = rows.agg(F.sum("rows")).first()[0] or 0
    lines, different = counts.agg(F.sum("k"), F.countDistinct("h")).first()
    often = counts.where(F.col("k") >= MIN_ROWS)
    tests = often.count()  # what fewer rows hold is no hypothesis
    outside = counts.join(often.select("h").distinct(), "h", "left_semi").groupBy("h").agg(F.sum("k").alias("all"))
    x = often.join(outside, "h").join(broadcast_if_small(rows), "source")
    k1, n1 = F.col("k").cast("double"), F.col("rows").cast("double")
    k2, n2 = (F.col("all") - F.col("k")).cast("double"), F.lit(float(total)) - F.col("rows")
    p1, p2, p = k1 / n1, F.coalesce(F.try_divide(k2, n2), F.lit(0.0)), (k1 + k2) / F.lit(float(max(total, 1)))
    same_line = F.when(p1 > p2, 2 * (_likelihood(k1, n1, p1) + _likelihood(k2, n2, p2) - _likelihood(k1, n1, p) - _likelihood(k2, n2, p))).otherwise(0.0)
    ordinary = F.lit((lines or 0) / max(1, (different or 1) * max(total, 1)))
    any_line = F.when(p1 > ordinary, 2 * (_likelihood(k1, n1, p1) - _likelihood(k1, n1, ordinary))).otherwise(0.0)
    return x.select("source", "h", "k", "rows", F.greatest(same_line, any_line, F.lit(0.0)).alias("statistic"), F.lit(tests).alias("tests"))


def significant(lines: DataFrame, rate: float = FALSE_DISCOVERY) -> DataFrame:
    """The scored lines that the false-discovery control keeps."""
    lines = lines.withColumn("bin", F.floor(F.ln(1 + F.col("statistic")) * _BINS))
    found = lines.groupBy("bin").agg(F.count("*").alias("n"), F.max("tests").alias("tests")).collect()  # some thousand bins at most
    seen, least = 0, None
    for r in sorted(found, key=lambda r: -r["bin"]):
        seen += r["n"]
        edge = math.expm1(r["bin"] / _BINS)
        if math.erfc(math.sqrt(edge / 2)) <= rate * seen / r["tests"]:
            least = r["bin"]
    return lines.where(F.col("bin") >= least) if least is not None else lines.where(F.lit(False))


def _marked(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every line with letters as (id, source, line_no, h), and the repeated (source, h)."""
    repeated_ = significant(scored(df)).where((F.col("k") >= MIN_ROWS) & (F.col("k") / F.col("rows") >= SHARE - 1e-12)).select("source", "h")
    lines = df.where("source is not null").select("id", "source", F.posexplode(_hashes(F.col("text"))).alias("pos", "h"))
    return lines.select("id", "source", (F.col("pos") + 1).cast("bigint").alias("line_no"), "h"), written(repeated_, "repeated-lines")


def repeated(df: DataFrame) -> DataFrame:
    """(id, line_no) of every repeated line of ``df`` (id, source, text)."""
    lines, again = _marked(df)
    # at most lines-per-row / SHARE of them a source; the count decides on the broadcast
    return lines.where("h is not null").join(broadcast_if_small(again), ["source", "h"], "left_semi").select("id", "line_no")


def without_repeated(df: DataFrame) -> DataFrame:
    """``df`` with ``text`` freed from its source's repeated lines; a text of repeated lines only becomes empty."""
    _, again = _marked(df)
    # lines-per-row / SHARE hashes a source at most; texts stay where they are
    own = written(again.groupBy("source").agg(F.collect_set("h").alias("__again")).withColumnRenamed("source", "__source"), "repeated-by-source")
    x = df.join(broadcast_if_small(own), F.col("source") == F.col("__source"), "left")
    lines = F.arrays_zip(F.split("text", "\n").alias("line"), _hashes(F.col("text")).alias("h"))
    kept = F.filter(lines, lambda v: v["h"].isNull() | ~F.array_contains("__again", v["h"]))
    freed = F.when(F.col("text").isNull() | F.col("__again").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda v: v["line"]), "\n"))
    return x.withColumn("text", freed).select(*df.columns)
