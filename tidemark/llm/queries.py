"""Queries of the text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import article_versions, boilerplate, encoding, language, leakage, near_duplicates, nearest_time, repeated_lines, residue_rows, truncation
from tidemark.session import table, written


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.encode(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: The close that a day stands for, and how far an item may be from it, in microseconds.
CLOSE_US, TOLERANCE_US = 10 * 3_600_000_000, 20 * 3_600_000_000


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "news").select(F.col("symbol").alias("entity"), F.unix_micros("published_at").alias("t"), F.col("seq").alias("id"))
    days = table(spark, sf_dir, "daily_coverage").select(
        F.col("symbol").alias("entity"), (F.unix_date("day").cast("bigint") * 86_400_000_000 + CLOSE_US).alias("t"), F.col("cov_id").alias("id")
    )
    return nearest_time.nearest(items, days, TOLERANCE_US).select(F.col("left_id").alias("seq"), F.col("right_id").alias("cov_id"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News rows as pages: (id, host, body, headline, url)."""
    return table(spark, sf_dir, "news").select(F.col("seq").alias("id"), F.col("source").alias("host"), "body", "headline", "url")


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.scored(table(spark, sf_dir, "news").select(F.col("seq").alias("id"), "source", "headline", "body", "snippet", "url"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, sf_dir).where(F.col("probability") >= truncation.CUT_FROM).select(F.col("id").alias("seq"), "field")


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.report(_values(spark, sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "news").select(F.col("seq").alias("id"), "source", F.col("body").alias("text"))
    return repeated_lines.repeated(rows).select(F.col("id").alias("seq"), "line_no")


def p4_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "news").select(F.col("seq").alias("id"), "source", F.col("body").alias("text"))
    return repeated_lines.without_repeated(rows).select(F.col("id").alias("seq"), F.col("text").alias("body"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue_rows.found(_pages(spark, sf_dir)).select(F.col("id").alias("seq"), "field")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.page_matter(boilerplate.mark(_pages(spark, sf_dir))).select(F.col("id").alias("seq"), "line_no")


def p6_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir)
    return boilerplate.main_content(pages, boilerplate.mark(pages)).select(F.col("id").alias("seq"), "article")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = written(article_versions.groups(_pages(spark, sf_dir)), "groups")
    return near_duplicates.pairs(members).select(F.col("a").alias("seq_a"), F.col("b").alias("seq_b"))


def p7_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return article_versions.groups(_pages(spark, sf_dir)).select(F.col("id").alias("seq"), F.col("group").alias("first_seq"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "eval_items").select("item_id", "text"))


def p9_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents each passage leaked into."""
    return p9_found(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("documents"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.corrections(written(language.identified(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")), "languages"))


def p10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line's language with its confidence."""
    found = language.identified(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select("doc_id", F.explode("lines").alias("x")).select("doc_id", "x.line_no", F.col("x.lang").alias("lang"), F.round("x.confidence", 6).alias("confidence"))


QUERIES = {
    "p1_found": p1_found,
    "p1_report": p1_report,
    "p2_found": p2_found,
    "p4_found": p4_found,
    "p4_clean": p4_clean,
    "p5_found": p5_found,
    "p6_found": p6_found,
    "p6_content": p6_content,
    "p7_found": p7_found,
    "p7_groups": p7_groups,
    "p8_ids": p8_ids,
    "p9_found": p9_found,
    "p9_items": p9_items,
    "p10_found": p10_found,
    "p10_lines": p10_lines,
}
ORACLES: dict[str, str] = {
    "p4_found": r"""
        WITH l AS (SELECT seq, source, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS line_no FROM news WHERE body IS NOT NULL AND source IS NOT NULL),
        k AS (SELECT seq, source, line_no, lower(regexp_replace(line, '[^\p{L}]+', '', 'g')) AS key FROM l),
        n AS (SELECT source, count(*) AS rows FROM news WHERE source IS NOT NULL GROUP BY source),
        c AS (SELECT source, key, count(DISTINCT seq) AS k FROM k WHERE key <> '' GROUP BY source, key),
        r AS (SELECT c.source, c.key FROM c JOIN n USING (source) WHERE c.k >= 3 AND c.k * 20 >= n.rows)
        SELECT k.seq, k.line_no::BIGINT AS line_no FROM k JOIN r USING (source, key)""",
    "p4_clean": r"""
        WITH l AS (SELECT seq, source, unnest(string_split(body, chr(10))) AS line FROM news WHERE body IS NOT NULL AND source IS NOT NULL),
        k AS (SELECT seq, source, lower(regexp_replace(line, '[^\p{L}]+', '', 'g')) AS key FROM l),
        n AS (SELECT source, count(*) AS rows FROM news WHERE source IS NOT NULL GROUP BY source),
        c AS (SELECT source, key, count(DISTINCT seq) AS k FROM k WHERE key <> '' GROUP BY source, key),
        r AS (SELECT c.source, list(c.key) AS keys FROM c JOIN n USING (source) WHERE c.k >= 3 AND c.k * 20 >= n.rows GROUP BY c.source)
        SELECT seq, CASE WHEN body IS NULL OR keys IS NULL THEN body ELSE array_to_string(list_filter(string_split(body, chr(10)), lambda t: NOT list_contains(keys, lower(regexp_replace(t, '[^\p{L}]+', '', 'g')))), chr(10)) END AS body
        FROM news LEFT JOIN r USING (source)""",
    "p2_found": """
        WITH n AS (SELECT seq, symbol, epoch_us(published_at) AS t FROM news WHERE symbol IS NOT NULL AND published_at IS NOT NULL),
        d AS (SELECT symbol, epoch_us(day::TIMESTAMP) + 36000000000 AS t, min(cov_id) AS cov_id FROM daily_coverage WHERE symbol IS NOT NULL AND day IS NOT NULL GROUP BY ALL),
        b AS (SELECT n.seq, n.t, d.t AS bt, d.cov_id AS bid, n.symbol FROM n ASOF LEFT JOIN d ON n.symbol = d.symbol AND n.t >= d.t),
        a AS (SELECT b.*, d.t AS at_, d.cov_id AS aid FROM b ASOF LEFT JOIN d ON b.symbol = d.symbol AND b.t <= d.t),
        c AS (SELECT seq, CASE WHEN bt IS NOT NULL AND (at_ IS NULL OR t - bt <= at_ - t) THEN bid ELSE aid END AS cov_id,
              CASE WHEN bt IS NOT NULL AND (at_ IS NULL OR t - bt <= at_ - t) THEN t - bt ELSE at_ - t END AS far FROM a)
        SELECT seq, cov_id FROM c WHERE far <= 72000000000""",
}
