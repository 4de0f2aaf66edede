"""Significance, reference indices and further statistics, each as a DataFrame plan with SQL of another form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import indices as X
from tidemark.operators import market as M
from tidemark.operators import study as S
from tidemark.plans import market as P
from tidemark.plans import news as N
from tidemark.plans import series as SERIES
from tidemark.session import table, written

#: Names that the text detectors look for (fixed values).
UNCERTAIN = "may|might|could|uncertain|uncertainty|approximately|possibly|risk|risks|unclear|depends"
NEGATED = r"\b(?:no|not|never|denied|denies|refuted|without)\b(?:\W+\w+){0,3}?\W+(?:loss|fraud|probe|default|cut|cuts|breach)\b"
FILING_TIERS = (("tier 1", r"\b(results|acquisition|merger|default|resign\w*)\b"), ("tier 2", r"\b(board|dividend|rating|order|contract)\b"), ("tier 3", r"\b(meeting|notice|update|newsletter)\b"))
ESG = (("environment", r"\b(emission|climate|water|pollution|renewable)\w*\b"), ("social", r"\b(union|worker|safety|customer|community)\w*\b"), ("governance", r"\b(board|audit|director|regulator|disclosure)\w*\b"))
RED_FLAGS = r"\b(auditor|restated|pledge[ds]?|related party|whistle|resign\w*|probe|investigation)\b"
GUIDANCE = r"(?i)\b(raised|cut|kept|lowered)\b[^.]{0,60}\b(guidance|forecast|estimate|outlook)\b"


def _events(spark: SparkSession, d: str) -> DataFrame:
    """(symbol, day) of every flagged day."""
    return written(P._flags(spark, d).where("candidate").select("symbol", F.col("date").alias("day"), "ar", "dominant_event_category"), "flagged")


def _steps(spark: SparkSession, d: str, offsets: tuple[int, int]) -> DataFrame:
    """(symbol, day, step, ar) of the sessions around each flagged day."""
    rows = P._abnormal(spark, d).select("symbol", "date", "ar", F.row_number().over(M.by_day()).alias("pos"))
    at = _events(spark, d).join(rows.select("symbol", F.col("date").alias("day"), F.col("pos").alias("at")), ["symbol", "day"]).select("symbol", "day", "at")
    wide = at.withColumn("step", F.explode(F.sequence(F.lit(offsets[0]), F.lit(offsets[1])))).withColumn("pos", F.col("at") + F.col("step"))
    return wide.join(rows.select("symbol", "pos", "ar"), ["symbol", "pos"]).select("symbol", "day", "step", F.coalesce("ar", F.lit(0.0)).alias("ar"))


def _sum(low: int, high: int) -> Column:
    return F.sum(F.when(F.col("step").between(low, high), F.col("ar")))


def m8_significance(spark, d):
    """The two-sided p-value of each cumulative return, by Student's t with the scale's degrees of freedom."""
    a = P._abnormal(spark, d)
    events = a.where((F.col("date") >= P.START) & (F.dayofweek("date") == 4)).select("symbol", F.date_add("date", 3).alias("day"))
    df = a.groupBy("symbol").agg(F.max("scale_df").alias("df"))
    x = M.significant(M.cumulative(a, events).join(df, "symbol"))
    return P._rounded(x.select("symbol", "day", "df", "p_value"), 5)


def a2_weekdays(spark, d):
    """The next weekday after each recorded day, which stands in where there is no calendar."""
    days = table(spark, d, "daily_coverage").where("day is not null").select("day").distinct()
    return days.select("day", X.next_weekday(F.col("day")).alias("session"))


def m10_window(spark, d):
    """A window's abnormal returns, with the lead-in for its model and the tail behind it."""
    f = P._frame(spark, d)
    x = M.built(f, M.market(f), P.START, "2024-03-01", lead_in=60, tail=7, least=P.LEAST)
    return P._rounded(x.select("symbol", "date", "in_window", "ar", "z"), 5)


def o6_moves(spark, d):
    """Moves between revisions in words."""
    from tidemark import unlisted
    from tidemark.operators import revisions as V
    from tidemark.plans.series import _stepped

    return unlisted.told(V.moves(V.revisions(_stepped(spark, d)))).select("symbol", "start", "end", "direction", "size", "pace")


def e6_summaries(spark, d):
    """The strongest headlines of each flagged day with a summary: the snippet, else the body's beginning, else nothing."""
    news = table(spark, d, "news")
    x = S.headlines(S.incidents(P._flags(spark, d)), news).select("symbol", "trading_day", "place", "seq")
    text = F.coalesce(F.nullif(F.trim("snippet"), F.lit("")), F.col("body"), F.lit(""))
    return x.join(news.select("seq", T.excerpt(text).alias("summary")), "seq")


def _indices(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(frames of three made indices, the benchmark): the mean close, the median close and the largest close of a day."""
    f = P._frame(spark, d)
    made = f.groupBy("date").agg(F.avg("close").alias("mean"), F.median("close").alias("median"), F.max("close").alias("top"))
    long = made.select("date", F.explode(F.array(*[F.struct(F.lit(n).alias("symbol"), F.col(n).alias("close")) for n in ("mean", "median", "top")])).alias("i"))
    return long.select("i.symbol", "date", "i.close", F.lit(None).cast("double").alias("volume")), made.select("date", F.col("mean").alias("benchmark_close"))


def i2_index_study(spark, d):
    """Abnormal and cumulative returns of each index on the companies' flagged days; the benchmark itself is only described."""
    frames, benchmark = _indices(spark, d)
    days = _events(spark, d).select("day").distinct()
    return P._rounded(X.studied(frames, benchmark, "mean", days, P.START, P.LEAST), 5)


def i2_index_returns(spark, d):
    frames, _ = _indices(spark, d)
    return P._rounded(X.described(frames, P.START), 6)


def i4_global(spark, d):
    """Each market day beside the latest session of two indices known by its close: one trades the same day, one closes later."""
    frames, _ = _indices(spark, d)
    thin = frames.where("symbol <> 'mean' and dayofmonth(date) % 3 <> 0")  # indices have other holidays
    days = P._frame(spark, d).where(F.col("date") >= P.START).select("date").distinct()
    return P._rounded(X.aligned(thin, days, {"median": True, "top": False}), 6)


def o10_levels(spark, d):
    """The market's level rebuilt from its returns, from 24,000 on."""
    x = P._aligned(spark, d).where("bret is not null").select("date", "bret").distinct()
    first = x.groupBy("date").agg(F.max("bret").alias("bret"))
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one row a session
    return first.select("date", F.round(24000 * F.exp(F.sum(F.log1p("bret")).over(w)), 4).alias("level"))


def _two_factors(spark: SparkSession, d: str) -> DataFrame:
    """(symbol, date, y, f1, f2): returns, the market's, and the median's less the market's."""
    f = P._frame(spark, d)
    a = M.aligned(f, M.market(f))
    b = M.aligned(f, f.groupBy("date").agg(F.median("close").alias("benchmark_close"))).select("symbol", "date", F.col("bret").alias("b2"))
    return a.join(b, ["symbol", "date"]).where("ret is not null and bret is not null and b2 is not null").select("symbol", "date", F.col("ret").alias("y"), F.col("bret").alias("f1"), (F.col("b2") - F.col("bret")).alias("f2"))


def _betas(x: DataFrame) -> DataFrame:
    """(symbol, n, beta1, beta2, alpha) by the normal equations of two factors; null where these don't vary apart."""
    cov = lambda a, b: F.covar_pop(a, b)
    s = x.groupBy("symbol").agg(F.count("*").alias("n"), cov("f1", "f1").alias("s11"), cov("f2", "f2").alias("s22"), cov("f1", "f2").alias("s12"), cov("f1", "y").alias("s1y"), cov("f2", "y").alias("s2y"), F.avg("f1").alias("m1"), F.avg("f2").alias("m2"), F.avg("y").alias("my"))
    det = F.col("s11") * F.col("s22") - F.col("s12") * F.col("s12")
    b1, b2 = F.try_divide(F.col("s1y") * F.col("s22") - F.col("s2y") * F.col("s12"), det), F.try_divide(F.col("s2y") * F.col("s11") - F.col("s1y") * F.col("s12"), det)
    return s.where("n >= 10").select("symbol", "n", b1.alias("beta1"), b2.alias("beta2"), (F.col("my") - b1 * F.col("m1") - b2 * F.col("m2")).alias("alpha"))


def b4_two_factors(spark, d):
    return P._rounded(_betas(_two_factors(spark, d)), 4)


def b21_attribution(spark, d):
    """Each day's return as the parts of both factors (their beta times their return), alpha and the rest."""
    x = _two_factors(spark, d)
    x = x.join(_betas(x), "symbol")
    own = F.col("y") - F.col("alpha") - F.col("beta1") * F.col("f1") - F.col("beta2") * F.col("f2")
    return P._rounded(x.select("symbol", "date", (F.col("beta1") * F.col("f1")).alias("market_part"), (F.col("beta2") * F.col("f2")).alias("breadth_part"), own.alias("own_part")), 5)


def b11_trajectory(spark, d):
    """Shock over (-1, 1) and drift over (2, 5) of each flagged day: continued, reversed, or contained under a quarter of the shock."""
    x = _steps(spark, d, (-1, 5)).groupBy("symbol", "day").agg(F.coalesce(_sum(-1, 1), F.lit(0.0)).alias("shock"), F.coalesce(_sum(2, 5), F.lit(0.0)).alias("drift"))
    kind = F.when(F.abs("drift") < 0.25 * F.abs("shock"), "contained").when(F.col("drift") * F.col("shock") > 0, "continued").otherwise("reversed")
    return P._rounded(x.withColumn("kind", kind), 5)


def b45_cone(spark, d):
    """Cumulative returns from the day on over four horizons, and how much of the longest the first two days took."""
    x = _steps(spark, d, (0, 10)).groupBy("symbol", "day").agg(*[_sum(0, h).alias(f"car_{h}") for h in (1, 3, 5, 10)])
    return P._rounded(x.withColumn("absorbed", F.try_divide("car_1", "car_10")), 4)


def b47_categories(spark, d):
    """Cumulative returns over (-1, 3) by the day's main event category."""
    x = _steps(spark, d, (-1, 3)).groupBy("symbol", "day").agg(F.sum("ar").alias("car")).join(_events(spark, d).select("symbol", "day", "dominant_event_category"), ["symbol", "day"])
    return P._rounded(x.groupBy("dominant_event_category").agg(F.count("*").alias("events"), F.sum("car").alias("car"), F.avg("car").alias("mean_car")), 5)


def b51_variances(spark, d):
    """The variance of ten sessions after a flagged day against that of ten before."""
    s = F.col("step")
    x = _steps(spark, d, (-10, 10)).groupBy("symbol", "day").agg(F.var_samp(F.when(s > 0, F.col("ar"))).alias("after"), F.var_samp(F.when(s < 0, F.col("ar"))).alias("before"), F.count_if(s > 0).alias("n_after"), F.count_if(s < 0).alias("n_before"))
    return x.select("symbol", "day", F.round(F.try_divide("after", "before"), 4).alias("ratio"), "n_after", "n_before")


def b59_rank_test(spark, d):
    """A rank test of the flagged days: the mean of their ranks' distance from the middle over its deviation."""
    a = P._abnormal(spark, d).where("ar is not null")
    n = F.count("*").over(Window.partitionBy("symbol"))
    k = a.select("symbol", "date", ((F.rank().over(Window.partitionBy("symbol").orderBy("ar")) + (F.count("*").over(Window.partitionBy("symbol", "ar")) - 1) / 2) / (n + 1) - 0.5).alias("k"))
    sd = k.groupBy("symbol").agg(F.sqrt(F.avg(F.col("k") * F.col("k"))).alias("sd"))
    x = k.join(_events(spark, d).select("symbol", F.col("day").alias("date")), ["symbol", "date"]).groupBy("symbol").agg(F.count("*").alias("events"), F.avg("k").alias("mean_k")).join(sd, "symbol")
    return x.select("symbol", "events", F.round(F.col("mean_k") / (F.col("sd") / F.sqrt("events")), 4).alias("statistic"))


def b29_dyadic(spark, d):
    """Variance of returns by scale: differences of means over 1, 2, 4 and 8 sessions."""
    w = lambda n: M.by_day().rowsBetween(-n + 1, 0)
    x = P._aligned(spark, d).where("ret is not null").select("symbol", "date", *[F.avg("ret").over(w(n)).alias(f"m{n}") for n in (1, 2, 4, 8)], F.row_number().over(M.by_day()).alias("rn")).where("rn >= 8")
    return P._rounded(x.groupBy("symbol").agg(*[F.var_samp(F.col(f"m{n}") - F.col(f"m{2 * n}")).alias(f"scale_{n}") for n in (1, 2, 4)]), 9)


def b34_stress(spark, d):
    """Three shocks of the market and their effect by beta."""
    m = M.models(P._aligned(spark, d), P.START, least=P.LEAST).select("symbol", "beta")
    shocks = F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(v).alias("shock")) for n, v in (("crash", -0.2), ("slump", -0.1), ("rally", 0.1))])
    return m.select("symbol", "beta", F.explode(shocks).alias("s")).select("symbol", "s.scenario", F.round(F.col("beta") * F.col("s.shock"), 6).alias("effect"))


def b42_half_life(spark, d):
    """Days in which the size of a symbol's tone halves, by a line through its logarithm over covered days; null where it doesn't fall."""
    x = P._daily(spark, d).where("unique_count > 0 and abs(weighted_sentiment) > 0.001").select("symbol", F.datediff("date", F.lit(P.START)).alias("t"), F.ln(F.abs("weighted_sentiment")).alias("y"))
    s = x.groupBy("symbol").agg(F.count("*").alias("n"), F.try_divide(F.covar_pop("t", "y"), F.var_pop("t")).alias("slope")).where("n >= 5")
    return s.select("symbol", "n", F.when(F.col("slope") < 0, F.round(-F.ln(F.lit(2.0)) / F.col("slope"), 3)).alias("half_life"))


def b52_spillover(spark, d):
    """How changes of a symbol's five-day volatility go with the market's of the day before."""
    w = M.by_day().rowsBetween(-4, 0)
    x = P._aligned(spark, d).where("ret is not null and bret is not null").select("symbol", "date", F.stddev_samp("ret").over(w).alias("s"), F.stddev_samp("bret").over(w).alias("b"), F.row_number().over(M.by_day()).alias("rn")).where("rn >= 5")
    x = x.select("symbol", "date", (F.col("s") - F.lag("s").over(M.by_day())).alias("y"), (F.col("b") - F.lag("b").over(M.by_day())).alias("db"))
    x = x.select("symbol", "y", F.lag("db").over(M.by_day()).alias("x")).where("x is not null and y is not null")
    return x.groupBy("symbol").agg(F.count("*").alias("n"), F.round(F.try_divide(F.covar_pop("x", "y"), F.var_pop("x")), 4).alias("spillover"))


def b8_clusters(spark, d):
    """Runs of sessions on which the pressure of return and volume together is 1.5 or more."""
    own = Window.partitionBy("symbol")
    vz = F.try_divide(F.col("volume") - F.avg("volume").over(own), F.stddev_samp("volume").over(own))
    x = P._abnormal(spark, d).select("symbol", "date", F.sqrt(F.col("z") * F.col("z") + vz * vz).alias("adi"), F.row_number().over(M.by_day()).alias("pos")).where("adi >= 1.5")
    x = x.withColumn("run", F.col("pos") - F.row_number().over(M.by_day()))
    return x.groupBy("symbol", "run").agg(F.min("date").alias("start"), F.max("date").alias("end"), F.count("*").alias("sessions"), F.round(F.max("adi"), 4).alias("peak")).drop("run")


def b16_cone(spark, d):
    """Value at risk at 95 % over four horizons by the Cornish-Fisher expansion."""
    x = P._aligned(spark, d).where("ret is not null").groupBy("symbol").agg(F.avg("ret").alias("mu"), F.stddev_samp("ret").alias("sd"), F.skewness("ret").alias("s"), F.kurtosis("ret").alias("k"))
    x = x.withColumn("h", F.explode(F.array(*[F.lit(h) for h in (1, 5, 10, 21)])))
    z, s, k = F.lit(-1.6448536269514722), F.col("s") / F.sqrt("h"), F.col("k") / F.col("h")
    q = z + (z * z - 1) * s / 6 + (z * z * z - 3 * z) * k / 24 - (2 * z * z * z - 5 * z) * s * s / 36
    return x.select("symbol", "h", F.round(-(F.col("mu") * F.col("h") + q * F.col("sd") * F.sqrt("h")), 6).alias("value_at_risk"))


def b18_chow(spark, d):
    """Whether the market model changed halfway: the F statistic of two halves against one line."""
    x = P._aligned(spark, d).where("ret is not null and bret is not null")
    x = x.select("symbol", "ret", "bret", (F.row_number().over(M.by_day()) * 2 <= F.count("*").over(Window.partitionBy("symbol"))).cast("int").alias("half"))
    ssr = F.var_pop("ret") * F.count("*") - F.try_divide(F.pow(F.covar_pop("bret", "ret"), F.lit(2)) * F.count("*"), F.var_pop("bret"))
    parts = x.groupBy("symbol", "half").agg(ssr.alias("ssr")).groupBy("symbol").agg(F.sum("ssr").alias("apart"))
    y = x.groupBy("symbol").agg(ssr.alias("ssr"), F.count("*").alias("n")).join(parts, "symbol").where("n >= 10")
    return y.select("symbol", "n", F.round(F.when(F.col("apart") > 1e-12, (F.col("ssr") - F.col("apart")) / 2 / (F.col("apart") / (F.col("n") - 4))), 4).alias("f"))  # without residuals there is no statistic


def b31_recovery(spark, d):
    """Sessions after a flagged day until the close is back at that of the session before it, within twenty."""
    rows = P._abnormal(spark, d).select("symbol", "date", "close", F.row_number().over(M.by_day()).alias("pos"), F.lag("close").over(M.by_day()).alias("base"))
    at = rows.join(_events(spark, d).select("symbol", F.col("day").alias("date")), ["symbol", "date"]).where("base is not null").select("symbol", F.col("date").alias("day"), F.col("pos").alias("at"), "base")
    x = at.withColumn("pos", F.explode(F.sequence(F.col("at"), F.col("at") + 20))).join(rows.select("symbol", "pos", "close"), ["symbol", "pos"])
    return x.groupBy("symbol", "day").agg(F.round(F.min(F.col("close") / F.col("base") - 1), 6).alias("drawdown"), F.min(F.when(F.col("close") >= F.col("base"), F.col("pos") - F.col("at"))).alias("sessions"))


def b32_cone(spark, d):
    """Yearly volatility over three windows: the latest, and the quarters of its range."""
    out = None
    for n in (10, 20, 30):
        w = M.by_day().rowsBetween(-n + 1, 0)
        x = P._aligned(spark, d).where("ret is not null").select("symbol", "date", (F.stddev_samp("ret").over(w) * F.sqrt(F.lit(252.0))).alias("v"), F.count("*").over(w).alias("n")).where(F.col("n") == n)
        one = x.groupBy("symbol").agg(F.lit(n).alias("window"), F.round(F.max_by("v", "date"), 5).alias("latest"), *[F.round(F.percentile("v", F.lit(q)), 5).alias(f"p{int(100 * q)}") for q in (0.25, 0.5, 0.75)])
        out = one if out is None else out.unionByName(one)
    return out


def b36_cascades(spark, d):
    """Days on which items arrive two or more times faster than the mean of the three recorded days before."""
    x = table(spark, d, "news").where("trading_day is not null and symbol is not null").groupBy("symbol", "trading_day").agg(F.count("*").alias("n"))
    m = F.coalesce(F.avg("n").over(Window.partitionBy("symbol").orderBy("trading_day").rowsBetween(-3, -1)), F.lit(0.0))
    v = (F.col("n") - m) / F.greatest(F.lit(1.0), m)
    return x.select("symbol", "trading_day", F.round(v, 5).alias("velocity")).where("velocity >= 2")


def b43_betas(spark, d):
    """Betas on days on which the market rose and fell."""
    x = P._aligned(spark, d).where("ret is not null and bret is not null")
    up, down = F.col("bret") > 0, F.col("bret") < 0
    beta = lambda c: F.try_divide(F.covar_pop(F.when(c, F.col("bret")), F.when(c, F.col("ret"))), F.var_pop(F.when(c, F.col("bret"))))
    return P._rounded(x.groupBy("symbol").agg(beta(up).alias("up_beta"), beta(down).alias("down_beta")), 4)


def b48_ncskew(spark, d):
    """Negative coefficient of skewness of abnormal returns."""
    x = P._abnormal(spark, d).where("ar is not null").groupBy("symbol").agg(F.count("*").alias("n"), F.skewness("ar").alias("s")).where("n >= 10")
    # skewness is m3 / m2^1.5 with means; the coefficient has sums and the sample's corrections
    return x.select("symbol", F.round(-F.col("s") * (F.col("n") - 1) * F.sqrt(F.col("n") - 1.0) * F.sqrt("n") / ((F.col("n") - 1) * (F.col("n") - 2)) * 1.0, 5).alias("ncskew"))


def b57_impact(spark, d):
    """Price impact of signed volume, and the mean imbalance of buying and selling volume over five sessions."""
    x = P._aligned(spark, d).where("volume is not null").select("symbol", "date", "volume", (F.col("close") - F.lag("close").over(M.by_day())).alias("dp")).where("dp is not null")
    x = x.withColumn("signed", F.signum("dp") * F.col("volume"))
    w = M.by_day().rowsBetween(-4, 0)
    x = x.select("symbol", "dp", "signed", F.when(F.count("*").over(w) == 5, F.try_divide(F.abs(F.sum("signed").over(w)), F.sum("volume").over(w))).alias("imbalance"))
    return x.groupBy("symbol").agg(F.round(F.try_divide(F.covar_pop("signed", "dp"), F.var_pop("signed")) * 1e9, 4).alias("impact"), F.round(F.avg("imbalance"), 5).alias("imbalance"))


def b23_decoupled(spark, d):
    """Windows (-1, 3) of flagged days that would overlap end and begin at the middle between them."""
    rows = P._abnormal(spark, d).select("symbol", "date", "ar", F.row_number().over(M.by_day()).alias("pos"))
    e = rows.join(_events(spark, d).select("symbol", F.col("day").alias("date")), ["symbol", "date"]).select("symbol", F.col("date").alias("day"), "pos")
    w = Window.partitionBy("symbol").orderBy("pos")
    middle = lambda a, b: F.floor((a + b) / 2)
    low = F.greatest(F.col("pos") - 1, F.coalesce(middle(F.lag("pos").over(w), F.col("pos")) + 1, F.col("pos") - 1))
    high = F.least(F.col("pos") + 3, F.coalesce(middle(F.col("pos"), F.lead("pos").over(w)), F.col("pos") + 3))
    e = e.select("symbol", "day", F.least(low, F.col("pos")).alias("low"), F.greatest(high, F.col("pos")).alias("high"))
    x = e.select("symbol", "day", F.explode(F.sequence("low", "high")).alias("pos")).join(rows.select("symbol", "pos", "ar"), ["symbol", "pos"])
    return x.groupBy("symbol", "day").agg(F.count("*").alias("sessions"), F.round(F.sum(F.coalesce("ar", F.lit(0.0))), 5).alias("car"))


def b6_sentences(spark, d):
    """Sentences of a body that name the company by the first word of its name."""
    q = table(spark, d, "quotes").where("name is not null").select(F.split("symbol", r"[.\-]")[0].alias("symbol"), F.lower(F.split("name", " ")[0]).alias("word")).groupBy("symbol").agg(F.max("word").alias("word"))
    x = table(spark, d, "news").where("body is not null").select("symbol", "seq", F.split(F.regexp_replace("body", r"\s+", " "), r"(?<=[.!?]) ").alias("s")).join(q, "symbol")
    return x.select("seq", F.size("s").alias("sentences"), F.size(F.filter("s", lambda t: F.contains(F.lower(t), F.col("word")))).alias("naming"))


def _first_match(column: str, rules: tuple[tuple[str, str], ...]) -> Column:
    out = None
    for name, pattern in rules:
        hit = F.coalesce(F.col(column).rlike(f"(?i){pattern}"), F.lit(False))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("")


def b17_filing_tiers(spark, d):
    return table(spark, d, "news").groupBy("source", _first_match("headline", FILING_TIERS).alias("tier")).agg(F.count("*").alias("items"))


def b35_esg(spark, d):
    return table(spark, d, "news").groupBy("symbol", _first_match("headline", ESG).alias("pillar")).agg(F.count("*").alias("items"))


def b19_negation(spark, d):
    """Bodies in which a bad word stands in the scope of a negation."""
    x = table(spark, d, "news").where("body is not null")
    return x.select("seq", F.regexp_count(F.lower("body"), F.lit(NEGATED)).alias("negated")).where("negated > 0")


def b44_uncertainty(spark, d):
    """Uncertain words a hundred words of body."""
    x = table(spark, d, "news").where("body is not null and trim(body) <> ''")
    words = F.size(F.regexp_extract_all("body", F.lit(r"[A-Za-z0-9]+"), F.lit(0)))
    return x.select("seq", F.round(100 * F.regexp_count(F.lower("body"), F.lit(rf"\b({UNCERTAIN})\b")) / F.greatest(words, F.lit(1)), 4).alias("density"))


def b49_guidance(spark, d):
    """What became of a guidance or forecast that a headline speaks of."""
    x = table(spark, d, "news").where(F.col("headline").rlike(GUIDANCE))
    return x.select("seq", F.lower(F.regexp_extract("headline", GUIDANCE, 1)).alias("move"), F.lower(F.regexp_extract("headline", GUIDANCE, 2)).alias("subject"))


def b54_red_flags(spark, d):
    x = table(spark, d, "news").where("symbol is not null and body is not null")
    return x.groupBy("symbol").agg(F.sum(F.regexp_count(F.lower("body"), F.lit(RED_FLAGS))).alias("flags"), F.count("*").alias("items"))


def b58_fog(spark, d):
    """Fog of a body: words a sentence and the share of words of three or more vowel groups."""
    x = table(spark, d, "news").where("body is not null").select("seq", F.size(F.regexp_extract_all("body", F.lit(r"[.!?]+"), F.lit(0))).alias("ends"), F.regexp_extract_all(F.lower("body"), F.lit("[a-z]+"), F.lit(0)).alias("w"))
    long = F.size(F.filter("w", lambda t: F.regexp_like(t, F.lit("[aeiouy]+[^aeiouy]+[aeiouy]+[^aeiouy]+[aeiouy]+"))))
    n = F.size("w")
    return x.where(n > 0).select("seq", F.round(0.4 * (n / F.greatest("ends", F.lit(1)) + 100 * long / n), 3).alias("fog"))


def b22_salience(spark, d):
    """Items by source that fall under the salience of 0.2."""
    x = N.r2_relevance(spark, d).join(table(spark, d, "news").select("seq", "source"), "seq")
    return x.groupBy("source").agg(F.count("*").alias("items"), F.count_if(F.col("score") < 0.2).alias("dropped"))


QUERIES = {f.__name__: f for f in (
    m8_significance, m10_window, o6_moves, e6_summaries, a2_weekdays, i2_index_study, i2_index_returns, i4_global, o10_levels, b4_two_factors, b21_attribution, b11_trajectory, b45_cone, b47_categories, b51_variances, b59_rank_test, b29_dyadic, b34_stress, b42_half_life, b52_spillover,
    b8_clusters, b16_cone, b18_chow, b31_recovery, b32_cone, b36_cascades, b43_betas, b48_ncskew, b57_impact, b23_decoupled, b6_sentences, b17_filing_tiers, b35_esg, b19_negation, b44_uncertainty, b49_guidance, b54_red_flags, b58_fog, b22_salience,
)}

_EV = f"{P._FL}, evs AS (SELECT symbol, date AS day, dominant_event_category FROM fl WHERE candidate), pos AS (SELECT symbol, date, ar, row_number() OVER (PARTITION BY symbol ORDER BY date) AS pos FROM ab), st AS (SELECT evs.symbol, evs.day, evs.dominant_event_category, b.pos - a.pos AS step, coalesce(b.ar, 0) AS ar FROM evs JOIN pos a ON a.symbol = evs.symbol AND a.date = evs.day JOIN pos b ON b.symbol = a.symbol)"
_THETA = "atan(abs(t)/sqrt(df))"
_TP = f"""1 - CASE WHEN df = 1 THEN 2*{_THETA}/pi() WHEN df % 2 = 0 THEN sin({_THETA})*list_sum(list_transform(range(0, df // 2), lambda k: coalesce(list_product(list_transform(range(1, k + 1), lambda j: (2*j - 1)/(2.0*j))), 1)*pow(cos({_THETA}), 2*k)))
    ELSE 2/pi()*({_THETA} + sin({_THETA})*list_sum(list_transform(range(1, (df - 1) // 2 + 1), lambda k: coalesce(list_product(list_transform(range(1, k), lambda j: 2.0*j/(2*j + 1))), 1)*pow(cos({_THETA}), 2*k - 1)))) END"""
_IX = f"{P._PX}, ix AS (SELECT 'mean' AS symbol, date, avg(close) AS close FROM px GROUP BY date UNION ALL SELECT 'median', date, median(close) FROM px GROUP BY date UNION ALL SELECT 'top', date, max(close) FROM px GROUP BY date)"
_IXA = "ia AS (SELECT x.symbol, x.date, x.close, NULL AS volume, b.close AS benchmark_close, x.close/nullif(lag(x.close) OVER w, 0) - 1 AS ret, b.close/nullif(lag(b.close) OVER w, 0) - 1 AS bret FROM ix x JOIN ix b ON b.symbol = 'mean' AND b.date = x.date WINDOW w AS (PARTITION BY x.symbol ORDER BY x.date))"
_TWO = f"{P._PX}, {P._aligned_sql('al', 'avg')}, {P._aligned_sql('a2', 'median')}, tf AS (SELECT al.symbol, al.date, al.ret AS y, al.bret AS f1, a2.bret - al.bret AS f2 FROM al JOIN a2 ON al.symbol = a2.symbol AND al.date = a2.date WHERE al.ret IS NOT NULL AND al.bret IS NOT NULL AND a2.bret IS NOT NULL)"
# two factors by regressing what each leaves of the other (residuals on residuals)
_FWL = _TWO + """, g AS (SELECT symbol, count(*) AS n, regr_slope(y, f1) AS y1, regr_intercept(y, f1) AS y0, regr_slope(f2, f1) AS z1, regr_intercept(f2, f1) AS z0 FROM tf GROUP BY symbol HAVING count(*) >= 10),
    r2 AS (SELECT tf.symbol, regr_slope(y - y0 - y1*f1, f2 - z0 - z1*f1) AS beta2 FROM tf JOIN g USING (symbol) GROUP BY tf.symbol),
    be AS (SELECT g.symbol, n, y1 - beta2*z1 AS beta1, beta2, y0 - beta2*z0 AS alpha FROM g JOIN r2 USING (symbol))"""


def _ladder(column: str, rules: tuple[tuple[str, str], ...]) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(coalesce({column}, ''), '(?i){p}') THEN '{n}'" for n, p in rules) + " ELSE '' END"


ORACLES = {
    "m8_significance": f"""WITH {P._AB}, {P._car_sql(f'SELECT symbol, date + 3 AS day FROM ab WHERE date >= DATE {P.START!r} AND dayofweek(date) = 3')}, z AS (SELECT ca.symbol, ca.day, (SELECT max(scale_df) FROM ab WHERE ab.symbol = ca.symbol) AS df, CASE WHEN scale > 0 THEN car/(scale*sqrt(days)) END AS t FROM ca)
        SELECT symbol, day, df, round(CASE WHEN df > 0 THEN {_TP} END, 5) AS p_value FROM z""",
    "a2_weekdays": "SELECT DISTINCT day, (SELECT min(day + k) FROM range(1, 5) r(k) WHERE isodow(day + k::INT) < 6)::DATE AS session FROM daily_coverage WHERE day IS NOT NULL".replace("min(day + k)", "min(day + k::INT)"),
    "i2_index_study": f"""WITH {P._FL}, {_IX[len(P._PX) + 2 :]}, {_IXA}, {P._models_sql('im', 'ia', P.LEAST)}, {P._abnormal_sql('ib', 'ia', 'im')}, dy AS (SELECT DISTINCT date AS day FROM fl WHERE candidate),
        ip AS (SELECT symbol, date, ar, z, scale, row_number() OVER (PARTITION BY symbol ORDER BY date) AS pos FROM ib WHERE symbol <> 'mean')
        SELECT a.symbol, dy.day, round(max(a.ar), 5) AS ar, round(max(a.z), 5) AS z, round(sum(coalesce(b.ar, 0)), 5) AS car, count(*) AS days FROM dy JOIN ip a ON a.date = dy.day JOIN ip b ON b.symbol = a.symbol AND b.pos BETWEEN a.pos - 1 AND a.pos + 3 WHERE dy.day >= DATE '{P.START}' GROUP BY a.symbol, dy.day""",
    "i2_index_returns": f"WITH {_IX}, w AS (SELECT * FROM ix WHERE date >= DATE '{P.START}') SELECT symbol, count(*) AS sessions, round(arg_max(close, date)/arg_min(close, date) - 1, 6) AS window_return FROM w GROUP BY symbol",
    "i4_global": f"""WITH {_IX}, th AS (SELECT symbol, date, close/nullif(lag(close) OVER (PARTITION BY symbol ORDER BY date), 0) - 1 AS ret FROM ix WHERE symbol <> 'mean' AND day(date) % 3 <> 0),
        st AS (SELECT symbol, avg(ret) AS m, stddev_samp(ret) AS s FROM th GROUP BY symbol), dd AS (SELECT DISTINCT date FROM px WHERE date >= DATE '{P.START}'),
        al AS (SELECT dd.date, s.symbol, (SELECT max(th.date) FROM th WHERE th.symbol = s.symbol AND (th.date < dd.date OR (th.date = dd.date AND s.symbol = 'median'))) AS session FROM dd, (VALUES ('median'), ('top')) s(symbol))
        SELECT al.date, al.symbol, al.session, round(th.ret, 6) AS ret, round(CASE WHEN s > 0 THEN (ret - m)/s ELSE 0 END, 6) AS z FROM al JOIN th ON th.symbol = al.symbol AND th.date = al.session JOIN st ON st.symbol = al.symbol WHERE th.ret IS NOT NULL""",
    "o10_levels": f"WITH {P._AL}, m AS (SELECT date, max(bret) AS r FROM al WHERE bret IS NOT NULL GROUP BY date) SELECT date, round(24000*product(1 + r) OVER (ORDER BY date), 4) AS level FROM m",
    "b4_two_factors": f"WITH {_FWL} SELECT symbol, n, {P._r('beta1 beta2 alpha', 4)} FROM be",
    "b21_attribution": f"WITH {_FWL} SELECT symbol, date, round(beta1*f1, 5) AS market_part, round(beta2*f2, 5) AS breadth_part, round(y - alpha - beta1*f1 - beta2*f2, 5) AS own_part FROM tf JOIN be USING (symbol)",
    "b11_trajectory": f"WITH {_EV}, t AS (SELECT symbol, day, coalesce(sum(ar) FILTER (step BETWEEN -1 AND 1), 0) AS shock, coalesce(sum(ar) FILTER (step BETWEEN 2 AND 5), 0) AS drift FROM st GROUP BY symbol, day) SELECT symbol, day, round(shock, 5) AS shock, round(drift, 5) AS drift, CASE WHEN abs(drift) < 0.25*abs(shock) THEN 'contained' WHEN drift*shock > 0 THEN 'continued' ELSE 'reversed' END AS kind FROM t",
    "b45_cone": f"WITH {_EV}, t AS (SELECT symbol, day, " + ", ".join(f"sum(ar) FILTER (step BETWEEN 0 AND {h}) AS car_{h}" for h in (1, 3, 5, 10)) + f" FROM st GROUP BY symbol, day) SELECT symbol, day, {P._r('car_1 car_3 car_5 car_10', 4)}, round(car_1/nullif(car_10, 0), 4) AS absorbed FROM t",
    "b47_categories": f"WITH {_EV}, t AS (SELECT symbol, day, dominant_event_category, sum(ar) AS car FROM st WHERE step BETWEEN -1 AND 3 GROUP BY ALL) SELECT dominant_event_category, count(*) AS events, round(sum(car), 5) AS car, round(avg(car), 5) AS mean_car FROM t GROUP BY 1",
    "b51_variances": f"WITH {_EV} SELECT symbol, day, round(var_samp(ar) FILTER (step BETWEEN 1 AND 10)/nullif(var_samp(ar) FILTER (step BETWEEN -10 AND -1), 0), 4) AS ratio, count(*) FILTER (step BETWEEN 1 AND 10) AS n_after, count(*) FILTER (step BETWEEN -10 AND -1) AS n_before FROM st GROUP BY symbol, day",
    "b59_rank_test": f"""WITH {_EV}, k AS (SELECT a.symbol, a.date, ((SELECT count(*) FROM ab b WHERE b.symbol = a.symbol AND b.ar < a.ar) + ((SELECT count(*) FROM ab b WHERE b.symbol = a.symbol AND b.ar = a.ar) + 1)/2.0)/((SELECT count(ar) FROM ab b WHERE b.symbol = a.symbol) + 1) - 0.5 AS k FROM ab a WHERE ar IS NOT NULL),
        sd AS (SELECT symbol, sqrt(avg(k*k)) AS sd FROM k GROUP BY symbol) SELECT k.symbol, count(*) AS events, round(avg(k)/(max(sd)/sqrt(count(*))), 4) AS statistic FROM k JOIN evs ON evs.symbol = k.symbol AND evs.day = k.date JOIN sd ON sd.symbol = k.symbol GROUP BY k.symbol""",
    "b29_dyadic": f"WITH {P._AL}, r AS (SELECT symbol, ret, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn FROM al WHERE ret IS NOT NULL), m AS (SELECT a.symbol, a.rn, " + ", ".join(f"avg(b.ret) FILTER (b.rn > a.rn - {n}) AS m{n}" for n in (1, 2, 4, 8)) + " FROM r a JOIN r b ON a.symbol = b.symbol AND b.rn BETWEEN a.rn - 7 AND a.rn WHERE a.rn >= 8 GROUP BY a.symbol, a.rn) SELECT symbol, " + ", ".join(f"round(var_samp(m{n} - m{2 * n}), 9) AS scale_{n}" for n in (1, 2, 4)) + " FROM m GROUP BY symbol",
    "b34_stress": f"WITH {P._AL}, {P._models_sql('mm', 'al', P.LEAST)} SELECT symbol, scenario, round(beta*shock, 6) AS effect FROM mm, (VALUES ('crash', -0.2::DOUBLE), ('slump', -0.1::DOUBLE), ('rally', 0.1::DOUBLE)) AS s(scenario, shock)",
    "b42_half_life": f"WITH {P._DAILY}, t AS (SELECT symbol, count(*) AS n, regr_slope(ln(abs(weighted_sentiment)), date - DATE '{P.START}') AS slope FROM daily WHERE unique_count > 0 AND abs(weighted_sentiment) > 0.001 GROUP BY symbol HAVING count(*) >= 5) SELECT symbol, n, CASE WHEN slope < 0 THEN round(-ln(2)/slope, 3) END AS half_life FROM t",
    "b52_spillover": f"""WITH {P._AL}, r AS (SELECT symbol, ret, bret, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn FROM al WHERE ret IS NOT NULL AND bret IS NOT NULL), v AS (SELECT a.symbol, a.rn, stddev_samp(b.ret) AS s, stddev_samp(b.bret) AS b FROM r a JOIN r b ON a.symbol = b.symbol AND b.rn BETWEEN a.rn - 4 AND a.rn WHERE a.rn >= 5 GROUP BY a.symbol, a.rn),
        c AS (SELECT x.symbol, x.s - y.s AS y, y.b - z.b AS x FROM v x JOIN v y ON x.symbol = y.symbol AND y.rn = x.rn - 1 JOIN v z ON x.symbol = z.symbol AND z.rn = x.rn - 2) SELECT symbol, count(*) AS n, round(regr_slope(y, x), 4) AS spillover FROM c GROUP BY symbol""",
    "b6_sentences": r"WITH q AS (SELECT string_split_regex(symbol, '[.-]')[1] AS symbol, max(lower(string_split(name, ' ')[1])) AS word FROM quotes WHERE name IS NOT NULL GROUP BY 1), s AS (SELECT symbol, seq, string_split(regexp_replace(regexp_replace(body, '\s+', ' ', 'g'), '([.!?]) ', '\1' || chr(1), 'g'), chr(1)) AS s FROM news WHERE body IS NOT NULL) SELECT seq, len(s)::INT AS sentences, len(list_filter(s, lambda t: contains(lower(t), word)))::INT AS naming FROM s JOIN q USING (symbol)",
    "b17_filing_tiers": f"SELECT source, {_ladder('headline', FILING_TIERS)} AS tier, count(*) AS items FROM news GROUP BY 1, 2",
    "b35_esg": f"SELECT symbol, {_ladder('headline', ESG)} AS pillar, count(*) AS items FROM news GROUP BY 1, 2",
    "b19_negation": f"SELECT seq, len(regexp_extract_all(lower(body), '{NEGATED}'))::INT AS negated FROM news WHERE body IS NOT NULL AND regexp_matches(lower(body), '{NEGATED}')",
    "b44_uncertainty": rf"SELECT seq, round(100*len(regexp_extract_all(lower(body), '\b({UNCERTAIN})\b'))/greatest(len(regexp_extract_all(body, '[A-Za-z0-9]+')), 1)::DOUBLE, 4) AS density FROM news WHERE body IS NOT NULL AND trim(body) <> ''",
    "b49_guidance": f"SELECT seq, lower(regexp_extract(headline, '{GUIDANCE}', 1)) AS move, lower(regexp_extract(headline, '{GUIDANCE}', 2)) AS subject FROM news WHERE regexp_matches(headline, '{GUIDANCE}')",
    "b54_red_flags": f"SELECT symbol, sum(len(regexp_extract_all(lower(body), '{RED_FLAGS}')))::BIGINT AS flags, count(*) AS items FROM news WHERE symbol IS NOT NULL AND body IS NOT NULL GROUP BY symbol",
    "b58_fog": r"WITH w AS (SELECT seq, len(regexp_extract_all(body, '[.!?]+')) AS ends, regexp_extract_all(lower(body), '[a-z]+') AS w FROM news WHERE body IS NOT NULL) SELECT seq, round(0.4*(len(w)/greatest(ends, 1)::DOUBLE + 100*len(list_filter(w, lambda t: regexp_matches(t, '[aeiouy]+[^aeiouy]+[aeiouy]+[^aeiouy]+[aeiouy]+')))/len(w)::DOUBLE), 3) AS fog FROM w WHERE len(w) > 0",
    "b22_salience": f"{N._REL} SELECT source, count(*) AS items, count(*) FILTER (score < 0.2) AS dropped FROM rel JOIN news USING (seq) GROUP BY source",
    "b8_clusters": f"""WITH {P._AB}, v AS (SELECT symbol, avg(volume) AS m, stddev_samp(volume) AS s FROM ab GROUP BY symbol), p AS (SELECT symbol, date, sqrt(z*z + power((volume - m)/nullif(s, 0), 2)) AS adi, row_number() OVER (PARTITION BY symbol ORDER BY date) AS pos FROM ab JOIN v USING (symbol)),
        h AS (SELECT * FROM p WHERE adi >= 1.5), f AS (SELECT h.*, (SELECT max(g.pos) FROM h g WHERE g.symbol = h.symbol AND g.pos <= h.pos AND NOT EXISTS (SELECT 1 FROM h k WHERE k.symbol = g.symbol AND k.pos = g.pos - 1)) AS head FROM h)
        SELECT symbol, min(date) AS start, max(date) AS "end", count(*) AS sessions, round(max(adi), 4) AS peak FROM f GROUP BY symbol, head""",
    "b16_cone": f"""WITH {P._AL}, m AS (SELECT symbol, ret, avg(ret) OVER (PARTITION BY symbol) AS mu FROM al WHERE ret IS NOT NULL), g AS (SELECT symbol, max(mu) AS mu, stddev_samp(ret) AS sd, avg(power(ret - mu, 3))/power(var_pop(ret), 1.5) AS s, avg(power(ret - mu, 4))/power(var_pop(ret), 2) - 3 AS k FROM m GROUP BY symbol),
        q AS (SELECT symbol, h::INT AS h, mu, sd, s/sqrt(h) AS s, k/h AS k, -1.6448536269514722::DOUBLE AS z FROM g, unnest([1, 5, 10, 21]) u(h)) SELECT symbol, h, round(-(mu*h + (z + (z*z - 1)*s/6 + (power(z, 3) - 3*z)*k/24 - (2*power(z, 3) - 5*z)*s*s/36)*sd*sqrt(h)), 6) AS value_at_risk FROM q""",
    "b18_chow": f"""WITH {P._AL}, r AS (SELECT symbol, ret, bret, row_number() OVER (PARTITION BY symbol ORDER BY date)*2 <= count(*) OVER (PARTITION BY symbol) AS half FROM al WHERE ret IS NOT NULL AND bret IS NOT NULL), f AS (SELECT symbol, half, regr_slope(ret, bret) AS b, regr_intercept(ret, bret) AS a FROM r GROUP BY symbol, half), w AS (SELECT symbol, regr_slope(ret, bret) AS b, regr_intercept(ret, bret) AS a, count(*) AS n FROM r GROUP BY symbol),
        e AS (SELECT r.symbol, max(n) AS n, sum(power(ret - w.a - w.b*bret, 2)) AS one, sum(power(ret - f.a - f.b*bret, 2)) AS apart FROM r JOIN f ON f.symbol = r.symbol AND f.half = r.half JOIN w ON w.symbol = r.symbol GROUP BY r.symbol) SELECT symbol, n, CASE WHEN apart > 1e-12 THEN round((one - apart)/2/(apart/(n - 4)), 4) END AS f FROM e WHERE n >= 10""",
    "b31_recovery": f"""WITH {_EV}, c AS (SELECT symbol, date, close, row_number() OVER (PARTITION BY symbol ORDER BY date) AS pos FROM ab), x AS (SELECT e.symbol, e.day, q.pos - p.pos AS k, q.close/b.close - 1 AS r FROM evs e JOIN c p ON p.symbol = e.symbol AND p.date = e.day JOIN c b ON b.symbol = p.symbol AND b.pos = p.pos - 1 JOIN c q ON q.symbol = p.symbol AND q.pos BETWEEN p.pos AND p.pos + 20)
        SELECT symbol, day, round(min(r), 6) AS drawdown, (min(k) FILTER (r >= 0))::INT AS sessions FROM x GROUP BY symbol, day""",
    "b32_cone": f"""WITH {P._AL}, r AS (SELECT symbol, ret, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn FROM al WHERE ret IS NOT NULL), v AS (SELECT a.symbol, a.rn, n AS "window", stddev_samp(b.ret)*sqrt(252) AS v FROM r a, unnest([10, 20, 30]) u(n), r b WHERE a.rn >= n AND b.symbol = a.symbol AND b.rn > a.rn - n AND b.rn <= a.rn GROUP BY ALL)
        SELECT symbol, "window", round(arg_max(v, rn), 5) AS latest, round(quantile_cont(v, 0.25), 5) AS p25, round(quantile_cont(v, 0.5), 5) AS p50, round(quantile_cont(v, 0.75), 5) AS p75 FROM v GROUP BY ALL""",
    "b36_cascades": "WITH c AS (SELECT symbol, trading_day, count(*) AS n FROM news WHERE trading_day IS NOT NULL AND symbol IS NOT NULL GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trading_day) AS rn FROM c), m AS (SELECT a.symbol, a.trading_day, a.n, coalesce(avg(b.n), 0) AS m FROM n a LEFT JOIN n b ON b.symbol = a.symbol AND b.rn BETWEEN a.rn - 3 AND a.rn - 1 GROUP BY ALL) SELECT symbol, trading_day, round((n - m)/greatest(1, m), 5) AS velocity FROM m WHERE round((n - m)/greatest(1, m), 5) >= 2",
    "b43_betas": f"WITH {P._AL} SELECT symbol, round(regr_slope(ret, bret) FILTER (bret > 0), 4) AS up_beta, round(regr_slope(ret, bret) FILTER (bret < 0), 4) AS down_beta FROM al WHERE ret IS NOT NULL AND bret IS NOT NULL GROUP BY symbol",
    "b48_ncskew": f"WITH {P._AB}, c AS (SELECT symbol, ar - avg(ar) OVER (PARTITION BY symbol) AS e FROM ab WHERE ar IS NOT NULL), s AS (SELECT symbol, count(*)::DOUBLE AS n, sum(power(e, 3)) AS s3, sum(e*e) AS s2 FROM c GROUP BY symbol HAVING count(*) >= 10) SELECT symbol, round(-n*power(n - 1, 1.5)*s3/((n - 1)*(n - 2)*power(s2, 1.5)), 5) AS ncskew FROM s",
    "b57_impact": f"""WITH {P._AL}, r AS (SELECT symbol, date, volume, close - lag(close) OVER (PARTITION BY symbol ORDER BY date) AS dp FROM al WHERE volume IS NOT NULL), g AS (SELECT symbol, dp, volume, CASE WHEN dp > 0 THEN volume WHEN dp < 0 THEN -volume ELSE 0 END AS sv, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn FROM r WHERE dp IS NOT NULL),
        i AS (SELECT a.symbol, a.rn, abs(sum(b.sv))/nullif(sum(b.volume), 0) AS imbalance FROM g a JOIN g b ON b.symbol = a.symbol AND b.rn BETWEEN a.rn - 4 AND a.rn WHERE a.rn >= 5 GROUP BY a.symbol, a.rn) SELECT g.symbol, round(regr_slope(dp, sv)*1e9, 4) AS impact, (SELECT round(avg(imbalance), 5) FROM i WHERE i.symbol = g.symbol) AS imbalance FROM g GROUP BY g.symbol""",
    "b23_decoupled": f"""WITH {_EV}, e AS (SELECT evs.symbol, evs.day, pos.pos FROM evs JOIN pos ON pos.symbol = evs.symbol AND pos.date = evs.day), n AS (SELECT e.*, (SELECT max(p.pos) FROM e p WHERE p.symbol = e.symbol AND p.pos < e.pos) AS before, (SELECT min(p.pos) FROM e p WHERE p.symbol = e.symbol AND p.pos > e.pos) AS after FROM e)
        SELECT n.symbol, n.day, count(*) AS sessions, round(sum(coalesce(ar, 0)), 5) AS car FROM n JOIN pos ON pos.symbol = n.symbol AND pos.pos BETWEEN least(n.pos, greatest(n.pos - 1, coalesce((before + n.pos) // 2 + 1, n.pos - 1))) AND greatest(n.pos, least(n.pos + 3, coalesce((n.pos + after) // 2, n.pos + 3))) GROUP BY n.symbol, n.day""",
    "m10_window": f"WITH {P._PX.replace('close IS NOT NULL)', f'close IS NOT NULL AND date BETWEEN DATE {P.START!r} - 60 AND DATE {chr(39)}2024-03-08{chr(39)})')}, {P._aligned_sql('al', 'avg')}, {P._models_sql('mm', 'al', P.LEAST)}, {P._abnormal_sql('ab', 'al', 'mm')} SELECT symbol, date, date BETWEEN DATE '{P.START}' AND DATE '2024-03-01' AS in_window, round(ar, 5) AS ar, round(z, 5) AS z FROM ab",
    "o6_moves": f"WITH {SERIES._MV} SELECT symbol, start, \"end\", CASE WHEN change > 0 THEN 'rose' WHEN change < 0 THEN 'fell' ELSE 'held' END AS direction, CASE WHEN abs(change) >= 0.25 THEN 'very large' WHEN abs(change) >= 0.10 THEN 'large' WHEN abs(change) >= 0.03 THEN 'moderate' ELSE 'small' END AS size, CASE WHEN \"end\" - start > 30 THEN 'slowly' ELSE 'at once' END AS pace FROM mv",
    "e6_summaries": rf"""WITH {P._INC}, h AS (SELECT n.symbol, n.trading_day, n.seq, row_number() OVER (PARTITION BY n.symbol, n.trading_day ORDER BY abs(n.sentiment_score) DESC NULLS LAST, n.relevance_score DESC NULLS LAST, n.seq) AS place, trim(regexp_replace(coalesce(nullif(trim(snippet), ''), body, ''), '\s+', ' ', 'g')) AS t FROM news n JOIN inc ON n.symbol = inc.symbol AND n.trading_day = inc.date WHERE n.duplicate_of IS NULL)
        SELECT symbol, trading_day, place, seq, CASE WHEN length(t) <= 220 THEN t ELSE rtrim(regexp_replace(substr(t, 1, 220), '\s+\S*$', '')) || '…' END AS summary FROM h WHERE place <= 5""",
}
