"""Event-study queries over prices and news, with the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.stats import t_equivalent
from tidemark.operators import market as M
from tidemark.operators import study as S
from tidemark.session import table, written

#: First day of the analysis window, and the least estimation rows that suit the short price series of the tables.
START, LEAST = "2024-02-15", 15
GRID = (0.7, 1.0, 1.3)


def _frame(spark: SparkSession, d: str) -> DataFrame:
    return M.frame(table(spark, d, "prices"))


def _aligned(spark: SparkSession, d: str) -> DataFrame:
    f = _frame(spark, d)
    return M.aligned(f, M.market(f))


def _abnormal(spark: SparkSession, d: str) -> DataFrame:
    a = _aligned(spark, d)
    return M.abnormal(a, M.models(a, START, least=LEAST))


def _daily(spark: SparkSession, d: str) -> DataFrame:
    return S.daily(_abnormal(spark, d), S.coverage(table(spark, d, "news")), START)


def _flags(spark: SparkSession, d: str) -> DataFrame:
    x = written(_daily(spark, d), "daily")  # the thresholds need its degrees of freedom first
    return S.flags(x, M.thresholds(x, S.RETURN_Z))


def _rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def s2_price_frame(spark, d):
    return _frame(spark, d)


def m2_aligned_returns(spark, d):
    return _rounded(_aligned(spark, d).select("symbol", "date", "close", "ret", "bret"))


def m3_market_model(spark, d):
    return _rounded(M.models(_aligned(spark, d), START, least=LEAST))


def m4_market_adjusted(spark, d):
    """The production minimum of 40 rows, which the short series of small tables don't reach: beta 1 and alpha 0."""
    return _rounded(M.models(_aligned(spark, d), START))


def m5_abnormal_returns(spark, d):
    return _rounded(_abnormal(spark, d).select("symbol", "date", "expected", "ar", "scale", "scale_df", "z"), 5)


def m6_cumulative(spark, d):
    a = _abnormal(spark, d)
    events = a.where((F.col("date") >= START) & (F.dayofweek("date") == 4)).select("symbol", F.date_add("date", 3).alias("day"))
    return _rounded(M.cumulative(a, events), 5)


def m9_permutation(spark, d):
    a, f = _abnormal(spark, d), _flags(spark, d).where("candidate").select("symbol", F.col("date").alias("day"))
    return _rounded(M.permutation(a, f, M.cumulative(a, f)))


def m11_second_benchmark(spark, d):
    """The median close of all symbols as a second benchmark."""
    f = _frame(spark, d)
    second = M.aligned(f, f.groupBy("date").agg(F.median("close").alias("benchmark_close")))
    x = M.abnormal(second, M.models(second, START, least=LEAST))
    return _rounded(_daily(spark, d).select("symbol", "date").join(x.select("symbol", "date", F.col("ar").alias("ar2"), F.col("z").alias("z2")), ["symbol", "date"], "left"), 5)


def e1_coverage(spark, d):
    return _rounded(S.coverage(table(spark, d, "news")), 8)


def e2_daily(spark, d):
    return _rounded(_daily(spark, d).select("symbol", "date", "close", "item_count", "unique_count", "weighted_sentiment", "sources", "dominant_event_category", "coverage_z", "sentiment_z", "volume_z"), 5)


def e4_incidents(spark, d):
    return _rounded(S.incidents(_flags(spark, d)).select("symbol", "date", "rank", "score", "direction_agrees", "ar"), 5)


def e5_diagnostics(spark, d):
    return S.diagnostics(_flags(spark, d))


def e6_headlines(spark, d):
    return S.headlines(S.incidents(_flags(spark, d)), table(spark, d, "news")).select("symbol", "trading_day", "place", "seq")


def e7_tone_return(spark, d):
    r, n = S.pearson(F.col("weighted_sentiment"), F.col("ar"))
    x = _daily(spark, d).where("unique_count > 0").groupBy("symbol").agg(r.alias("r"), n.alias("n"))
    return x.select("symbol", F.round("r", 4).alias("r"), F.round(F.col("r") * F.col("r"), 4).alias("r_squared"), "n")


def e8_tone_volume(spark, d):
    r, n = S.pearson(F.abs("weighted_sentiment"), F.when(F.col("volume").isNotNull(), F.col("volume_z")))
    return _rounded(_daily(spark, d).where("unique_count > 0").groupBy("symbol").agg(r.alias("r"), n.alias("n")), 4)


def e9_lagged(spark, d):
    return _rounded(S.lagged(_daily(spark, d)), 4)


def e10_valence(spark, d):
    x = _daily(spark, d).where("unique_count > 0").withColumn("valence", S.valence(F.col("dominant_emotion_label"))).where("valence <> '' and ar is not null")
    return x.groupBy("valence").agg(F.count("*").alias("n"), F.round(F.avg("ar"), 5).alias("mean_ar"), F.round(F.avg("weighted_sentiment"), 4).alias("mean_tone"), F.array_join(F.array_sort(F.collect_set("dominant_emotion_label")), ",").alias("labels"))


def e11_robustness(spark, d):
    x = written(_daily(spark, d), "daily")
    cells = [(round(S.COVERAGE_Z * c, 4), round(S.RETURN_Z * r, 4)) for c in GRID for r in GRID]
    return S.robustness(x, M.grid_thresholds(x, cells))


def e12_caveats(spark, d):
    """Which caveats hold for a symbol: few estimation rows, few covered days, stale coverage, no candidate."""
    x = _flags(spark, d)
    s = x.groupBy("symbol").agg(F.max("scale_df").alias("df"), F.max("covered_days").alias("covered"), F.count_if("candidate").alias("candidates"), F.avg("mean_staleness").alias("stale"))
    rules = F.array(F.when(F.col("df") < M.MIN_DAYS - 2, "short baseline"), F.when(F.col("covered") < S.COVERED_DAYS, "thin coverage"), F.when(F.col("stale") >= 0.35, "stale coverage"), F.when(F.col("candidates") == 0, "nothing flagged"))
    return s.select("symbol", F.array_join(F.filter(rules, lambda c: c.isNotNull()), "; ").alias("caveats"))


def a1_calendar(spark, d):
    return _aligned(spark, d).select("symbol", "date").distinct()


def o4_rebased(spark, d):
    """Cumulative growth of close and benchmark, rebased to 100 on each symbol's first common date."""
    from pyspark.sql import Window

    w = Window.partitionBy("symbol").orderBy("date")
    x = _aligned(spark, d)
    return _rounded(x.select("symbol", "date", (100 * F.col("close") / F.first("close").over(w)).alias("level"), (100 * F.col("benchmark_close") / F.first("benchmark_close").over(w)).alias("benchmark_level")), 5)


def o5_bands(spark, d):
    """Magnitude and tone bands, and whether the move persisted, of each candidate."""
    a, f = _abnormal(spark, d), _flags(spark, d).where("candidate")
    car = M.cumulative(a, f.select("symbol", F.col("date").alias("day"))).select("symbol", F.col("day").alias("date"), "car")
    x = f.join(car, ["symbol", "date"], "left")
    size = F.when(F.abs("ar") >= 0.10, "very large").when(F.abs("ar") >= 0.05, "large").when(F.abs("ar") >= 0.02, "moderate").otherwise("small")
    tone = F.when(F.col("weighted_sentiment") >= 0.5, "very positive").when(F.col("weighted_sentiment") >= 0.15, "positive").when(F.col("weighted_sentiment") > -0.15, "neutral").when(F.col("weighted_sentiment") > -0.5, "negative").otherwise("very negative")
    stays = F.when(F.col("car").isNull(), "unknown").when(F.col("car") * F.col("ar") <= 0, "reversed").when(F.abs("car") >= F.abs("ar"), "extended").otherwise("faded")
    return x.select("symbol", "date", size.alias("size"), tone.alias("tone"), stays.alias("persistence"))


QUERIES = {f.__name__: f for f in (
    s2_price_frame, m2_aligned_returns, m3_market_model, m4_market_adjusted, m5_abnormal_returns, m6_cumulative, m9_permutation, m11_second_benchmark,
    e1_coverage, e2_daily, e4_incidents, e5_diagnostics, e6_headlines, e7_tone_return, e8_tone_volume, e9_lagged, e10_valence, e11_robustness, e12_caveats, a1_calendar, o4_rebased, o5_bands,
)}


def _models_sql(name: str, source: str, least: int) -> str:
    return f"""
    {name}_est AS (SELECT * FROM (SELECT symbol, ret, bret, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn, count(*) OVER (PARTITION BY symbol) AS n
        FROM {source} WHERE date < DATE '{START}' AND ret IS NOT NULL AND bret IS NOT NULL)
        WHERE rn > (CASE WHEN n > 5 THEN 5 ELSE 0 END) AND rn <= (CASE WHEN n > 5 THEN 5 ELSE 0 END) + 120),
    {name}_s AS (SELECT symbol, count(*) AS obs, avg(bret) AS mx, avg(ret) AS my, var_pop(bret)*count(*) AS sxx, var_pop(ret)*count(*) AS syy, covar_pop(bret, ret)*count(*) AS sxy FROM {name}_est GROUP BY symbol),
    {name}_f AS (SELECT y.symbol, coalesce(obs, 0) AS observations, mx, my, sxx, syy, sxy, coalesce(obs >= {least} AND sxx > 0, FALSE) AS fitted
        FROM (SELECT DISTINCT symbol FROM {source}) y LEFT JOIN {name}_s USING (symbol)),
    {name} AS (SELECT symbol, CASE WHEN fitted THEN my - sxy/sxx*mx ELSE 0 END AS alpha, CASE WHEN fitted THEN sxy/sxx ELSE 1 END AS beta,
        CASE WHEN fitted AND observations > 2 THEN sqrt(greatest(syy - sxy*sxy/sxx, 0)/(observations - 2)) END AS residual_sd, observations,
        CASE WHEN fitted AND syy > 0 THEN 1 - greatest(syy - sxy*sxy/sxx, 0)/syy END AS r_squared, fitted FROM {name}_f)"""


def _abnormal_sql(name: str, source: str, model: str) -> str:
    return f"""
    {name}0 AS (SELECT a.*, m.alpha + m.beta*a.bret AS expected, a.ret - (m.alpha + m.beta*a.bret) AS ar, m.residual_sd, m.observations FROM {source} a JOIN {model} m USING (symbol)),
    {name}1 AS (SELECT *, CASE WHEN coalesce(residual_sd > 0, FALSE) THEN residual_sd ELSE stddev_samp(ar) OVER (PARTITION BY symbol) END AS scale,
        CAST(CASE WHEN coalesce(residual_sd > 0, FALSE) THEN greatest(observations - 2, 0) ELSE greatest(count(*) OVER (PARTITION BY symbol) - 1, 0) END AS INT) AS scale_df FROM {name}0),
    {name} AS (SELECT *, CASE WHEN scale > 0 THEN ar/scale END AS z FROM {name}1)"""


_PX = """px AS (SELECT symbol, date, close, volume FROM (SELECT *, row_number() OVER (PARTITION BY symbol, date ORDER BY seq DESC) AS rn FROM prices WHERE symbol IS NOT NULL AND date IS NOT NULL) WHERE rn = 1 AND close IS NOT NULL)"""


def _aligned_sql(name: str, how: str) -> str:
    return f"""
    {name}_b AS (SELECT date, {how}(close) AS benchmark_close FROM px GROUP BY date),
    {name} AS (SELECT symbol, date, close, volume, benchmark_close, close/nullif(lag(close) OVER w, 0) - 1 AS ret, benchmark_close/nullif(lag(benchmark_close) OVER w, 0) - 1 AS bret
        FROM px JOIN {name}_b USING (date) WINDOW w AS (PARTITION BY symbol ORDER BY date))"""


_AL = _PX + ", " + _aligned_sql("al", "avg")
_AB = _AL + ", " + _models_sql("mm", "al", LEAST) + ", " + _abnormal_sql("ab", "al", "mm")
_COV = """
    att AS (SELECT * FROM news WHERE trading_day IS NOT NULL AND symbol IS NOT NULL),
    uni AS (SELECT * FROM att WHERE duplicate_of IS NULL),
    car_ AS (SELECT symbol, coalesce(duplicate_of, url) AS url, count(*) AS carriers FROM news WHERE symbol IS NOT NULL GROUP BY ALL),
    wei AS (SELECT uni.*, greatest(coalesce(relevance_score, 0), 0.01)*coalesce(carriers, 1) AS w FROM uni LEFT JOIN car_ USING (symbol, url)),
    c_all AS (SELECT symbol, trading_day, count(*) AS item_count, count(*) FILTER (duplicate_of IS NULL) AS unique_count, count(*) FILTER (after_close) AS after_close_count FROM att GROUP BY ALL),
    c_tone AS (SELECT symbol, trading_day, avg(sentiment_score) AS mean_sentiment, sum(sentiment_score*w)/nullif(sum(w) FILTER (sentiment_score IS NOT NULL), 0) AS weighted_sentiment,
        min(sentiment_score) AS min_sentiment, max(sentiment_score) AS max_sentiment, avg(staleness_score) AS mean_staleness FROM wei GROUP BY ALL),
    c_src AS (SELECT symbol, trading_day, string_agg(source, ',' ORDER BY first) AS sources FROM (SELECT symbol, trading_day, source, min(seq) AS first FROM att GROUP BY ALL) GROUP BY ALL),
    c_ev AS (SELECT symbol, trading_day, event_category AS dominant_event_category FROM (SELECT *, row_number() OVER (PARTITION BY symbol, trading_day ORDER BY n DESC, first) AS rn
        FROM (SELECT symbol, trading_day, event_category, count(*) AS n, min(seq) AS first FROM uni WHERE event_category <> '' GROUP BY ALL)) WHERE rn = 1),
    c_em AS (SELECT symbol, trading_day, emotion_label AS dominant_emotion_label FROM (SELECT *, row_number() OVER (PARTITION BY symbol, trading_day ORDER BY n DESC, first) AS rn
        FROM (SELECT symbol, trading_day, emotion_label, count(*) AS n, min(seq) AS first FROM uni WHERE emotion_label <> '' GROUP BY ALL)) WHERE rn = 1),
    cov AS (SELECT * FROM c_all LEFT JOIN c_tone USING (symbol, trading_day) LEFT JOIN c_src USING (symbol, trading_day) LEFT JOIN c_ev USING (symbol, trading_day) LEFT JOIN c_em USING (symbol, trading_day))"""
_DAILY = _AB + "," + _COV + f""",
    d0 AS (SELECT ab.symbol, ab.date, ab.close, ab.volume, ab.ar, ab.z, ab.scale, ab.scale_df, coalesce(item_count, 0) AS item_count, coalesce(unique_count, 0) AS unique_count, coalesce(mean_sentiment, 0) AS mean_sentiment,
        coalesce(weighted_sentiment, 0) AS weighted_sentiment, coalesce(sources, '') AS sources, coalesce(dominant_event_category, '') AS dominant_event_category, coalesce(dominant_emotion_label, '') AS dominant_emotion_label, mean_staleness
        FROM ab LEFT JOIN cov ON ab.symbol = cov.symbol AND ab.date = cov.trading_day WHERE ab.date >= DATE '{START}'),
    d1 AS (SELECT *, avg(unique_count) OVER w AS cm, stddev_samp(unique_count) OVER w AS cs, avg(CASE WHEN unique_count > 0 THEN weighted_sentiment END) OVER w AS sm, stddev_samp(CASE WHEN unique_count > 0 THEN weighted_sentiment END) OVER w AS ss,
        avg(volume) OVER w AS vm, stddev_samp(volume) OVER w AS vs, count(*) FILTER (unique_count > 0) OVER w AS covered_days FROM d0 WINDOW w AS (PARTITION BY symbol)),
    daily AS (SELECT *, coalesce(CASE WHEN cs > 0 THEN (unique_count - cm)/cs END, 0) AS coverage_z, CASE WHEN unique_count > 0 THEN coalesce(CASE WHEN ss > 0 THEN (weighted_sentiment - sm)/ss END, 0) ELSE 0 END AS sentiment_z,
        CASE WHEN volume IS NOT NULL THEN coalesce(CASE WHEN vs > 0 THEN (volume - vm)/vs END, 0) ELSE 0 END AS volume_z FROM d1)"""


def _thresholds_sql(z: float) -> str:
    return "(VALUES " + ", ".join(f"({k}, {t_equivalent(z, k)!r})" for k in range(400)) + ") AS th(scale_df, threshold)"


def _flags_sql(name: str, c: float, z: float) -> str:
    return f"""
    {name}0 AS (SELECT daily.*, unique_count > 0 AND (covered_days < 10 OR coverage_z >= {c} OR abs(sentiment_z) >= {c}) AS coverage_unusual, coalesce(abs(z) >= threshold, FALSE) AS return_unusual FROM daily JOIN {_thresholds_sql(z)} USING (scale_df)),
    {name} AS (SELECT *, coverage_unusual AND return_unusual AS candidate, CASE WHEN coverage_unusual AND return_unusual THEN 'candidate' WHEN coverage_unusual THEN 'coverage_only' WHEN return_unusual AND unique_count = 0 THEN 'no_coverage_big_move' WHEN return_unusual THEN 'return_only' ELSE 'routine' END AS bucket FROM {name}0)"""


_FL = _DAILY + "," + _flags_sql("fl", 1.0, 1.5)
_INC = _FL + """,
    inc AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY score DESC, date) AS rank FROM (SELECT *, weighted_sentiment*ar > 0 AS direction_agrees,
        abs(z)*(1 + greatest(coverage_z, 0))*(1 + abs(weighted_sentiment))*CASE WHEN weighted_sentiment*ar > 0 THEN 1.25 ELSE 1 END AS score FROM fl WHERE candidate))"""


def _car_sql(events: str) -> str:
    return f"""
    po AS (SELECT symbol, date, ar, scale, row_number() OVER (PARTITION BY symbol ORDER BY date) AS pos, count(*) OVER (PARTITION BY symbol) AS n FROM ab),
    ev AS ({events}),
    an AS (SELECT ev.symbol, ev.day, min(po.date) AS anchor FROM ev JOIN po ON ev.symbol = po.symbol AND po.date >= ev.day GROUP BY ALL),
    ca AS (SELECT an.symbol, an.day, an.anchor, sum(coalesce(q.ar, 0)) AS car, count(*) AS days, max(p.scale) AS scale FROM an JOIN po p ON an.symbol = p.symbol AND an.anchor = p.date
        JOIN po q ON q.symbol = p.symbol AND q.pos BETWEEN p.pos - 1 AND p.pos + 3 GROUP BY ALL)"""


def _r(cols: str, places: int) -> str:
    return ", ".join(f"round({c}, {places}) AS {c}" for c in cols.split())


_PEARSON = "CASE WHEN count(*) FILTER ({x} IS NOT NULL AND {y} IS NOT NULL) >= 3 THEN covar_pop({x}, {y})/nullif(sqrt(var_pop({x}) FILTER ({y} IS NOT NULL))*sqrt(var_pop({y}) FILTER ({x} IS NOT NULL)), 0) END"


def _pearson(x: str, y: str) -> str:
    return _PEARSON.replace("{x}", x).replace("{y}", y)


_VALENCE = "CASE " + " ".join(f"WHEN dominant_emotion_label IN ({', '.join(repr(x) for x in v)}) THEN '{k}'" for k, v in S.VALENCE.items()) + " ELSE '' END"

ORACLES = {
    "s2_price_frame": f"WITH {_PX} SELECT * FROM px",
    "m2_aligned_returns": f"WITH {_AL} SELECT symbol, date, {_r('close ret bret', 6)} FROM al",
    "m3_market_model": f"WITH {_AL}, {_models_sql('mm', 'al', LEAST)} SELECT symbol, {_r('alpha beta residual_sd r_squared', 6)}, observations, fitted FROM mm",
    "m4_market_adjusted": f"WITH {_AL}, {_models_sql('mm', 'al', 40)} SELECT symbol, {_r('alpha beta residual_sd r_squared', 6)}, observations, fitted FROM mm",
    "m5_abnormal_returns": f"WITH {_AB} SELECT symbol, date, {_r('expected ar scale z', 5)}, scale_df FROM ab",
    "m6_cumulative": f"WITH {_AB}, {_car_sql(f'SELECT symbol, date + 3 AS day FROM ab WHERE date >= DATE {START!r} AND dayofweek(date) = 3')} SELECT symbol, day, anchor, round(car, 5) AS car, days, days < 5 AS truncated, round(CASE WHEN scale > 0 THEN car/(scale*sqrt(days)) END, 5) AS t_stat FROM ca",
    "m9_permutation": f"""WITH {_FL}, {_car_sql('SELECT symbol, date AS day FROM fl WHERE candidate')},
        cl AS (SELECT ab.symbol, ab.date, ab.ar, CASE WHEN fl.candidate THEN 1 ELSE 0 END AS hit, row_number() OVER (PARTITION BY ab.symbol ORDER BY ab.date) AS p FROM ab LEFT JOIN fl ON ab.symbol = fl.symbol AND ab.date = fl.date WHERE ab.ar IS NOT NULL),
        wi AS (SELECT ca.symbol, ca.day, ca.car, a.p, sum(b.ar) AS s, max(b.hit) AS touched, count(*) AS k, max(ca.days) AS days FROM ca JOIN cl a ON ca.symbol = a.symbol JOIN cl b ON b.symbol = a.symbol AND b.p BETWEEN a.p AND a.p + ca.days - 1 GROUP BY ALL),
        ok AS (SELECT * FROM wi WHERE k = days AND touched = 0)
        SELECT ca.symbol, ca.day, count(ok.s) AS windows, CASE WHEN count(ok.s) >= 10 THEN round(avg(CASE WHEN abs(ok.s) >= abs(ca.car) - 1e-12 THEN 1.0 WHEN ok.s IS NOT NULL THEN 0.0 END), 6) END AS p_value FROM ca LEFT JOIN ok ON ca.symbol = ok.symbol AND ca.day = ok.day GROUP BY ca.symbol, ca.day""",
    "m11_second_benchmark": f"WITH {_DAILY}, {_aligned_sql('a2', 'median')}, {_models_sql('m2', 'a2', LEAST)}, {_abnormal_sql('b2', 'a2', 'm2')} SELECT daily.symbol, daily.date, round(b2.ar, 5) AS ar2, round(b2.z, 5) AS z2 FROM daily LEFT JOIN b2 ON daily.symbol = b2.symbol AND daily.date = b2.date",
    "e1_coverage": f"WITH {_COV} SELECT symbol, trading_day, item_count, unique_count, after_close_count, {_r('mean_sentiment weighted_sentiment min_sentiment max_sentiment mean_staleness', 8)}, sources, dominant_event_category, dominant_emotion_label FROM cov",
    "e2_daily": f"WITH {_DAILY} SELECT symbol, date, {_r('close weighted_sentiment coverage_z sentiment_z volume_z', 5)}, item_count, unique_count, sources, dominant_event_category FROM daily",
    "e4_incidents": f"WITH {_INC} SELECT symbol, date, rank, round(score, 5) AS score, direction_agrees, round(ar, 5) AS ar FROM inc",
    "e5_diagnostics": f"WITH {_FL} SELECT symbol, count(*) AS days, " + ", ".join(f"count(*) FILTER (bucket = '{b}') AS {b}" for b in ("candidate", "coverage_only", "return_only", "no_coverage_big_move", "routine")) + " FROM fl GROUP BY symbol",
    "e6_headlines": f"WITH {_INC} SELECT symbol, trading_day, place, seq FROM (SELECT n.symbol, n.trading_day, n.seq, row_number() OVER (PARTITION BY n.symbol, n.trading_day ORDER BY abs(n.sentiment_score) DESC NULLS LAST, n.relevance_score DESC NULLS LAST, n.seq) AS place FROM news n JOIN inc ON n.symbol = inc.symbol AND n.trading_day = inc.date WHERE n.duplicate_of IS NULL) WHERE place <= 5",
    "e7_tone_return": f"WITH {_DAILY}, c AS (SELECT symbol, {_pearson('weighted_sentiment', 'ar')} AS r, count(*) FILTER (weighted_sentiment IS NOT NULL AND ar IS NOT NULL) AS n FROM daily WHERE unique_count > 0 GROUP BY symbol) SELECT symbol, round(r, 4) AS r, round(r*r, 4) AS r_squared, n FROM c",
    "e8_tone_volume": f"WITH {_DAILY}, e AS (SELECT symbol, abs(weighted_sentiment) AS x, CASE WHEN volume IS NOT NULL THEN volume_z END AS y FROM daily WHERE unique_count > 0) SELECT symbol, round({_pearson('x', 'y')}, 4) AS r, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS n FROM e GROUP BY symbol",
    "e9_lagged": f"WITH {_DAILY}, l AS (SELECT symbol, unique_count, weighted_sentiment AS x, lead(ar, 1) OVER w AS l1, lead(ar, 5) OVER w AS l5 FROM daily WINDOW w AS (PARTITION BY symbol ORDER BY date)), m AS (SELECT symbol, unique_count, x, 1 AS horizon, l1 AS y FROM l UNION ALL SELECT symbol, unique_count, x, 5, l5 FROM l) SELECT symbol, horizon, round({_pearson('x', 'y')}, 4) AS r, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS n FROM m WHERE unique_count > 0 GROUP BY symbol, horizon",
    "e10_valence": f"WITH {_DAILY}, v AS (SELECT *, {_VALENCE} AS valence FROM daily WHERE unique_count > 0) SELECT valence, count(*) AS n, round(avg(ar), 5) AS mean_ar, round(avg(weighted_sentiment), 4) AS mean_tone, array_to_string(list_sort(list(DISTINCT dominant_emotion_label)), ',') AS labels FROM v WHERE valence <> '' AND ar IS NOT NULL GROUP BY valence",
    "e11_robustness": f"WITH {_DAILY}, " + ", ".join(_flags_sql(f"g{i}{j}", round(S.COVERAGE_Z * c, 4), round(S.RETURN_Z * r, 4)) for i, c in enumerate(GRID) for j, r in enumerate(GRID)) + " SELECT symbol, date, count(*) AS cells FROM (" + " UNION ALL ".join(f"SELECT symbol, date FROM g{i}{j} WHERE candidate" for i in range(3) for j in range(3)) + ") GROUP BY symbol, date",
    "e12_caveats": f"WITH {_FL}, s AS (SELECT symbol, max(scale_df) AS df, max(covered_days) AS covered, count(*) FILTER (candidate) AS candidates, avg(mean_staleness) AS stale FROM fl GROUP BY symbol) SELECT symbol, concat_ws('; ', CASE WHEN df < 38 THEN 'short baseline' END, CASE WHEN covered < 10 THEN 'thin coverage' END, CASE WHEN stale >= 0.35 THEN 'stale coverage' END, CASE WHEN candidates = 0 THEN 'nothing flagged' END) AS caveats FROM s",
    "a1_calendar": f"WITH {_AL} SELECT DISTINCT symbol, date FROM al",
    "o4_rebased": f"WITH {_AL} SELECT symbol, date, round(100*close/first_value(close) OVER w, 5) AS level, round(100*benchmark_close/first_value(benchmark_close) OVER w, 5) AS benchmark_level FROM al WINDOW w AS (PARTITION BY symbol ORDER BY date)",
    "o5_bands": f"WITH {_FL}, {_car_sql('SELECT symbol, date AS day FROM fl WHERE candidate')} SELECT fl.symbol, fl.date, CASE WHEN abs(ar) >= 0.10 THEN 'very large' WHEN abs(ar) >= 0.05 THEN 'large' WHEN abs(ar) >= 0.02 THEN 'moderate' ELSE 'small' END AS size, CASE WHEN weighted_sentiment >= 0.5 THEN 'very positive' WHEN weighted_sentiment >= 0.15 THEN 'positive' WHEN weighted_sentiment > -0.15 THEN 'neutral' WHEN weighted_sentiment > -0.5 THEN 'negative' ELSE 'very negative' END AS tone, CASE WHEN car IS NULL THEN 'unknown' WHEN car*ar <= 0 THEN 'reversed' WHEN abs(car) >= abs(ar) THEN 'extended' ELSE 'faded' END AS persistence FROM fl LEFT JOIN ca ON fl.symbol = ca.symbol AND fl.date = ca.day WHERE candidate",
}
