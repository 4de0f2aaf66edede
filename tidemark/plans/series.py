"""Queries over series and intervals: revisions, moves, gaps, indices, calendars, tickers."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import asof as A
from tidemark.operators import market as M
from tidemark.operators import revisions as V
from tidemark.plans import market as P
from tidemark.session import table

#: Policy rate changes, day and per cent (fixed values).
POLICY_RATES = (
    ("2015-01-15", 7.75), ("2015-03-04", 7.50), ("2015-06-02", 7.25), ("2015-09-29", 6.75), ("2016-04-05", 6.50), ("2016-10-04", 6.25), ("2017-08-02", 6.00),
    ("2018-06-06", 6.25), ("2018-08-01", 6.50), ("2019-02-07", 6.25), ("2019-04-04", 6.00), ("2019-06-06", 5.75), ("2019-08-07", 5.40), ("2019-10-04", 5.15),
    ("2020-03-27", 4.40), ("2020-05-22", 4.00), ("2022-05-04", 4.40), ("2022-06-08", 4.90), ("2022-08-05", 5.40), ("2022-09-30", 5.90), ("2022-12-07", 6.25),
    ("2023-02-08", 6.50), ("2025-02-07", 6.25), ("2025-04-09", 6.00), ("2025-06-06", 5.50), ("2025-12-05", 5.25),
)
#: Exchanges by preference.
EXCHANGES = ("NX", "BX")


def _stepped(spark: SparkSession, d: str) -> DataFrame:
    """Closes rounded to tens, so that levels hold for some days."""
    return M.frame(table(spark, d, "prices")).select("symbol", "date", F.round(F.col("close") / 10).alias("close"))


def v1_revisions(spark, d):
    return V.revisions(_stepped(spark, d))


def v2_moves(spark, d):
    return P._rounded(V.moves(V.revisions(_stepped(spark, d))))


def v3_overlapping(spark, d):
    """Moves that overlap the window, made from the whole history."""
    return v2_moves(spark, d).where("end >= date'2024-02-01' and start <= date'2024-02-15'")


def v4_news(spark, d):
    """Up to five items by strength within each move's (start, end]; moves are disjoint, so the day decides the move."""
    m = V.moves(V.revisions(_stepped(spark, d))).select("symbol", "start", "end")
    days = m.select("symbol", "start", F.explode(F.sequence(F.date_add("start", 1), "end")).alias("day"))
    n = table(spark, d, "news").where("symbol is not null").select("symbol", "seq", F.col("published_local_date").alias("day"), "sentiment_score", "relevance_score")
    w = Window.partitionBy("symbol", "start").orderBy(F.abs("sentiment_score").desc_nulls_last(), F.col("relevance_score").desc_nulls_last(), "seq")
    return n.join(days, ["symbol", "day"]).withColumn("place", F.row_number().over(w)).where("place <= 5").select("symbol", "start", "place", "seq")


def v5_ranked(spark, d):
    w = Window.partitionBy("symbol").orderBy(F.desc(F.abs("change")), "start")
    return v2_moves(spark, d).where("change is not null").withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("symbol", "rank", "start", "change")


def _segments(spark, d):
    """Runs of covered days: every recorded day is a segment of its symbol."""
    return table(spark, d, "daily_coverage").where("symbol is not null and day is not null").select("symbol", F.col("day").alias("start"), F.col("day").alias("end"), F.array_sort("sources").alias("sources"))


def _requests(spark, d):
    return table(spark, d, "daily_coverage").where("symbol is not null").groupBy("symbol").agg(F.date_sub(F.min("day"), 3).alias("start"), F.date_add(F.max("day"), 3).alias("end"))


def v6_gaps(spark, d):
    return V.gaps(_segments(spark, d).select("symbol", "start", "end"), _requests(spark, d))


def v7_coalesced(spark, d):
    """Segments of the same sources that touch, as one."""
    x = _segments(spark, d).where("sources is not null").select("symbol", F.array_join("sources", ",").alias("sources"), "start", "end")
    return V.merged(x, ["symbol", "sources"])


def v8_cached(spark, d):
    """Items on days that no gap holds."""
    n = table(spark, d, "news").where("symbol is not null and published_local_date is not null").select("symbol", "seq", F.col("published_local_date").alias("day"))
    return V.outside(n, v6_gaps(spark, d), "day").select("symbol", "seq")


def v9_upsert(spark, d):
    """One row a url, the last writer's."""
    w = Window.partitionBy("url").orderBy(F.desc("seq"))
    return table(spark, d, "news").where("url is not null").withColumn("rn", F.row_number().over(w)).where("rn = 1").select("url", "seq")


def i1_levels(spark, d):
    """The market level rebased to 100, its return within the window (none on its first day)."""
    m = M.market(M.frame(table(spark, d, "prices"))).where(f"date >= date'{P.START}'").select(F.lit("market").alias("symbol"), "date", F.col("benchmark_close").alias("close"))
    return P._rounded(m.select("date", (100 * F.col("close") / F.first("close").over(M.by_day())).alias("level"), M.simple_return("close").alias("ret")), 5)


def i3_same_direction(spark, d):
    """How often a symbol moves the way the market does; zero counts as down."""
    x = P._aligned(spark, d).where("ret is not null and bret is not null")
    same = F.count_if((F.col("ret") > 0) == (F.col("bret") > 0))
    return x.groupBy("symbol").agg(F.count("*").alias("n"), same.alias("same"), F.round(same / F.count("*"), 6).alias("rate"))


def i5_aligned_direction(spark, d):
    """Direction agreement of covered days with the symbol's latest session before the day."""
    days = table(spark, d, "daily_coverage").where("symbol is not null and day is not null").groupBy("symbol", F.col("day").alias("date")).agg(F.max("weighted_sentiment").alias("tone"))
    ret = P._aligned(spark, d).where("ret is not null").select("symbol", F.col("date").alias("session"), "ret")
    x = days.join(A.session_map(days, ret.withColumnRenamed("session", "date"), forward=False, strict=True), ["symbol", "date"]).join(ret, ["symbol", "session"])
    return x.where("tone is not null").groupBy("symbol").agg(F.count("*").alias("n"), F.count_if((F.col("tone") > 0) == (F.col("ret") > 0)).alias("same"))


def i6_policy(spark, d):
    rates = spark.createDataFrame(list(POLICY_RATES), "day string, rate double").select(F.col("day").cast("date").alias("day"), "rate")
    return rates.where("day between date'2022-01-01' and date'2023-12-31'")


def i7_summary(spark, d):
    """First and last close of each symbol in the window and the change between them."""
    x = M.frame(table(spark, d, "prices")).where(f"date >= date'{P.START}'").groupBy("symbol").agg(F.min_by("close", "date").alias("first_close"), F.max_by("close", "date").alias("last_close"))
    return P._rounded(x.withColumn("change", F.try_divide(F.col("last_close"), F.col("first_close")) - 1))


def i8_period_change(spark, d):
    """The last close of each week against one and four weeks back, relative to the size of the earlier one."""
    w = Window.partitionBy("symbol").orderBy("week")
    x = M.frame(table(spark, d, "prices")).groupBy("symbol", F.date_trunc("week", "date").cast("date").alias("week")).agg(F.max_by("close", "date").alias("close"))
    change = lambda k: F.try_divide(F.col("close") - F.lag("close", k).over(w), F.abs(F.lag("close", k).over(w)))
    return P._rounded(x.select("symbol", "week", change(1).alias("change_1"), change(4).alias("change_4")))


def s11_days(spark, d):
    return spark.range(1).select(F.explode(F.expr("sequence(date'2024-01-28', date'2024-03-03', interval 1 day)")).alias("day"))


def s11_months(spark, d):
    return spark.range(1).select(F.explode(F.expr("sequence(date'2023-11-01', date'2024-03-01', interval 1 month)")).alias("month"))


def s22_probes(spark, d):
    """Every seventh day of a range, and its end."""
    x = spark.range(1).select(F.expr("array_distinct(concat(sequence(date'2024-01-01', date'2024-02-07', interval 7 day), array(date'2024-02-07')))").alias("days"))
    return x.select(F.explode("days").alias("day"))


def s26_ticker(spark, d):
    """The preferred listing of each company: shares only, by exchange, then by position."""
    suffix = F.element_at(F.split("symbol", r"\."), -1)
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in EXCHANGES]), suffix), F.lit(0)), F.lit(99))
    w = Window.partitionBy("query").orderBy(rank, "pos", "symbol")
    return table(spark, d, "quotes").where("quote_type = 'EQUITY'").withColumn("rn", F.row_number().over(w)).where("rn = 1").select("query", "symbol")


def s28_name_match(spark, d):
    """The best name for each query, of all names: containment is 1, else the ratio of matching blocks; the first best wins, from
    0.5 on; a blank query or name matches nothing."""
    q = table(spark, d, "quotes")
    left = q.select("query").where("query is not null").distinct()
    names = q.where("name is not null").select("pos", "symbol", "name")

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([1.0 if x in y or y in x else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype=float)

    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    left, right = left.withColumn("a", plain("query")).where("a <> ''"), names.withColumn("b", plain("name")).where("b <> ''")
    # every query meets every name, spread by query; the ratio is 2 m / (x + y) with m of the shorter length at most, so this bound
    # spares only pairs that can't reach 0.5
    short, long = F.least(F.length("a"), F.length("b")), F.greatest(F.length("a"), F.length("b"))
    able = F.contains("a", F.col("b")) | F.contains("b", F.col("a")) | (short * 3 >= long)
    x = left.repartition("query").crossJoin(right).where(able).withColumn("score", ratio("a", "b"))
    w = Window.partitionBy("query").orderBy(F.desc("score"), "pos", "symbol")
    return x.where("score >= 0.5").withColumn("rn", F.row_number().over(w)).where("rn = 1").select("query", "symbol", F.round("score", 4).alias("score"))


def s6_fallback(spark, d):
    """The provider chain: of two providers' frames the first that has a symbol gives all of its rows."""
    p = M.frame(table(spark, d, "prices"))
    first = p.where("volume is not null").select("symbol", "date", "close", F.lit(1).alias("provider"))
    both = first.unionByName(p.select("symbol", "date", "close", F.lit(2).alias("provider")))
    best = both.groupBy("symbol").agg(F.min("provider").alias("provider"))
    return both.join(best, ["symbol", "provider"])


QUERIES = {f.__name__: f for f in (
    v1_revisions, v2_moves, v3_overlapping, v4_news, v5_ranked, v6_gaps, v7_coalesced, v8_cached, v9_upsert, i1_levels, i3_same_direction, i5_aligned_direction, i6_policy, i7_summary, i8_period_change,
    s11_days, s11_months, s22_probes, s26_ticker, s28_name_match, s6_fallback,
)}

_PX = P._PX
_ST = f"{_PX}, st AS (SELECT symbol, date, round(close/10) AS close FROM px)"
_RV = f"{_ST}, rv AS (SELECT symbol, date, close FROM (SELECT *, lag(close) OVER w AS b, row_number() OVER w AS rn FROM st WINDOW w AS (PARTITION BY symbol ORDER BY date)) WHERE rn = 1 OR close IS DISTINCT FROM b)"
_MV = f"""{_RV}, mv0 AS (SELECT symbol, date AS start, lead(date) OVER w AS "end", close AS start_close, lead(close) OVER w AS end_close FROM rv WINDOW w AS (PARTITION BY symbol ORDER BY date)),
    mv AS (SELECT *, round((end_close - start_close)/nullif(start_close, 0), 6) AS change FROM mv0 WHERE "end" IS NOT NULL)"""
_SEG = """sg AS (SELECT symbol, day, array_to_string(list_sort(sources), ',') AS sources FROM daily_coverage WHERE symbol IS NOT NULL AND day IS NOT NULL)"""
_GAP = f"""{_SEG}, rq AS (SELECT symbol, unnest(generate_series(min(day) - 3, max(day) + 3, INTERVAL 1 DAY))::DATE AS day FROM daily_coverage WHERE symbol IS NOT NULL GROUP BY symbol),
    mi AS (SELECT symbol, day FROM rq EXCEPT SELECT symbol, day FROM sg), is_ AS (SELECT symbol, day, day - row_number() OVER (PARTITION BY symbol ORDER BY day)::INT AS g FROM mi),
    gp AS (SELECT symbol, min(day) AS start, max(day) AS "end" FROM is_ GROUP BY symbol, g)"""
_RATES = ", ".join(f"(DATE '{a}', {b}::DOUBLE)" for a, b in POLICY_RATES)

ORACLES = {
    "v1_revisions": f"WITH {_RV} SELECT * FROM rv",
    "v2_moves": f"WITH {_MV} SELECT * FROM mv",
    "v3_overlapping": f"WITH {_MV} SELECT * FROM mv WHERE \"end\" >= DATE '2024-02-01' AND start <= DATE '2024-02-15'",
    "v4_news": f"WITH {_MV} SELECT symbol, start, place, seq FROM (SELECT mv.symbol, mv.start, n.seq, row_number() OVER (PARTITION BY mv.symbol, mv.start ORDER BY abs(sentiment_score) DESC NULLS LAST, relevance_score DESC NULLS LAST, seq) AS place FROM mv JOIN news n ON n.symbol = mv.symbol AND n.published_local_date > mv.start AND n.published_local_date <= mv.\"end\") WHERE place <= 5",
    "v5_ranked": f"WITH {_MV} SELECT symbol, rank, start, change FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY abs(change) DESC, start) AS rank FROM mv WHERE change IS NOT NULL) WHERE rank <= 3",
    "v6_gaps": f"WITH {_GAP} SELECT * FROM gp",
    "v7_coalesced": f"WITH {_SEG}, d AS (SELECT DISTINCT symbol, sources, day FROM sg WHERE sources IS NOT NULL), g AS (SELECT *, day - row_number() OVER (PARTITION BY symbol, sources ORDER BY day)::INT AS k FROM d) SELECT symbol, sources, min(day) AS start, max(day) AS \"end\" FROM g GROUP BY symbol, sources, k",
    "v8_cached": f"WITH {_GAP} SELECT symbol, seq FROM news n WHERE symbol IS NOT NULL AND published_local_date IS NOT NULL AND NOT EXISTS (SELECT 1 FROM gp WHERE gp.symbol = n.symbol AND n.published_local_date BETWEEN gp.start AND gp.\"end\")",
    "v9_upsert": "SELECT url, max(seq) AS seq FROM news WHERE url IS NOT NULL GROUP BY url",
    "i1_levels": f"WITH {_PX}, m AS (SELECT date, avg(close) AS close FROM px GROUP BY date HAVING date >= DATE '{P.START}') SELECT date, round(100*close/first_value(close) OVER w, 5) AS level, round(close/nullif(lag(close) OVER w, 0) - 1, 5) AS ret FROM m WINDOW w AS (ORDER BY date)",
    "i3_same_direction": f"WITH {P._AL} SELECT symbol, count(*) AS n, count(*) FILTER ((ret > 0) = (bret > 0)) AS same, round(count(*) FILTER ((ret > 0) = (bret > 0))/count(*)::DOUBLE, 6) AS rate FROM al WHERE ret IS NOT NULL AND bret IS NOT NULL GROUP BY symbol",
    "i5_aligned_direction": f"WITH {P._AL}, dd AS (SELECT symbol, day, max(weighted_sentiment) AS tone FROM daily_coverage WHERE symbol IS NOT NULL AND day IS NOT NULL GROUP BY ALL), j AS (SELECT dd.*, (SELECT max(date) FROM al WHERE al.symbol = dd.symbol AND al.ret IS NOT NULL AND al.date < dd.day) AS s FROM dd) SELECT j.symbol, count(*) AS n, count(*) FILTER ((tone > 0) = (ret > 0)) AS same FROM j JOIN al ON al.symbol = j.symbol AND al.date = j.s WHERE tone IS NOT NULL GROUP BY j.symbol",
    "i6_policy": f"SELECT day, rate FROM (VALUES {_RATES}) AS r(day, rate) WHERE day BETWEEN DATE '2022-01-01' AND DATE '2023-12-31'",
    "i7_summary": f"WITH {_PX}, s AS (SELECT symbol, arg_min(close, date) AS first_close, arg_max(close, date) AS last_close FROM px WHERE date >= DATE '{P.START}' GROUP BY symbol) SELECT symbol, round(first_close, 6) AS first_close, round(last_close, 6) AS last_close, round(last_close/nullif(first_close, 0) - 1, 6) AS change FROM s",
    "i8_period_change": f"WITH {_PX}, k AS (SELECT symbol, date_trunc('week', date)::DATE AS week, arg_max(close, date) AS close FROM px GROUP BY ALL) SELECT symbol, week, round((close - lag(close) OVER w)/nullif(abs(lag(close) OVER w), 0), 6) AS change_1, round((close - lag(close, 4) OVER w)/nullif(abs(lag(close, 4) OVER w), 0), 6) AS change_4 FROM k WINDOW w AS (PARTITION BY symbol ORDER BY week)",
    "s11_days": "SELECT unnest(generate_series(DATE '2024-01-28', DATE '2024-03-03', INTERVAL 1 DAY))::DATE AS day",
    "s11_months": "SELECT unnest(generate_series(DATE '2023-11-01', DATE '2024-03-01', INTERVAL 1 MONTH))::DATE AS month",
    "s22_probes": "SELECT DISTINCT day FROM (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-02-07', INTERVAL 7 DAY))::DATE AS day UNION ALL SELECT DATE '2024-02-07')",
    "s26_ticker": "SELECT query, symbol FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY CASE string_split(symbol, '.')[-1] WHEN 'NX' THEN 1 WHEN 'BX' THEN 2 ELSE 99 END, pos, symbol) AS rn FROM quotes WHERE quote_type = 'EQUITY') WHERE rn = 1",
    "s6_fallback": f"WITH {_PX}, b AS (SELECT symbol, date, close, 1 AS provider FROM px WHERE volume IS NOT NULL UNION ALL SELECT symbol, date, close, 2 FROM px) SELECT b.* FROM b JOIN (SELECT symbol, min(provider) AS provider FROM b GROUP BY symbol) m USING (symbol, provider)",
}
