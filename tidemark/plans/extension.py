"""Further market statistics as one SELECT each over the abnormal-return frame ``ab`` (symbol, date, close, volume, benchmark_close,
ret, bret, ar, z) and the news; they run as Spark SQL over views of the DataFrames, and on the oracle over the same frame."""

from __future__ import annotations

from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import fits
from tidemark.plans import market as P
from tidemark.session import table

#: Publisher weights: from 0.7 for the one with fewest items to 1.5 for the one with most; a table of weights can take its place.
AUTHORITY = "(SELECT source, CASE WHEN max(n) OVER () > min(n) OVER () THEN 0.7 + 0.8*(n - min(n) OVER ())/(max(n) OVER () - min(n) OVER ()) ELSE 1e0 END AS weight FROM (SELECT source, count(*) AS n FROM news WHERE source IS NOT NULL GROUP BY source) c)"
_REG = "covar_pop({x}, {y})/nullif(var_pop({x}), 0)"


def _reg(x: str, y: str) -> str:
    return _REG.format(x=x, y=y)


SELECTS = {
    "b3_value_at_risk": "SELECT symbol, round(avg(ret) - 1.6448536269514722*stddev_samp(ret), 6) AS normal_95, round(avg(ret) - 2.3263478740408408*stddev_samp(ret), 6) AS normal_99, round((avg(ret) - 1.6448536269514722*stddev_samp(ret))*sqrt(10), 6) AS normal_95_10d FROM ab WHERE ret IS NOT NULL GROUP BY symbol",
    "b5_peer_shocks": "SELECT date, count(*) AS peers, round(avg(ar), 6) AS mean_ar FROM ab WHERE abs(z) >= 1.5 GROUP BY date HAVING count(*) >= 2",
    "b5_correlation": "SELECT a.symbol AS symbol, b.symbol AS peer, count(*) AS n, round(covar_pop(a.ar, b.ar)/nullif(stddev_pop(a.ar)*stddev_pop(b.ar), 0), 5) AS r FROM ab a JOIN ab b ON a.date = b.date AND a.symbol < b.symbol WHERE a.ar IS NOT NULL AND b.ar IS NOT NULL GROUP BY a.symbol, b.symbol HAVING count(*) >= 20",
    "b7_discontinuity": "SELECT symbol, date, round(ret, 6) AS ret FROM ab WHERE abs(ret + 0.5) < 0.03 OR abs(ret + 0.6667) < 0.03 OR abs(ret + 0.8) < 0.03 OR abs(ret + 0.9) < 0.03",
    "b8_pressure": "SELECT symbol, date, round(sqrt(z*z + vz*vz), 5) AS adi FROM (SELECT symbol, date, z, (volume - avg(volume) OVER (PARTITION BY symbol))/nullif(stddev_samp(volume) OVER (PARTITION BY symbol), 0) AS vz FROM ab) t WHERE z IS NOT NULL AND vz IS NOT NULL",
    "b9_illiquidity": "SELECT symbol, round(avg(abs(ret)/(close*volume))*1e9, 6) AS illiquidity FROM ab WHERE ret IS NOT NULL AND volume > 0 GROUP BY symbol",
    "b15_average_path": "SELECT date, round(avg(ar), 6) AS aar, count(ar) AS n, round(sum(avg(ar)) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS caar FROM ab WHERE ar IS NOT NULL GROUP BY date",
    "b16_cornish_fisher": "SELECT symbol, round(m, 6) AS mean, round(m3/nullif(v*sqrt(v), 0), 4) AS skew, round(m4/nullif(v*v, 0) - 3, 4) AS excess FROM (SELECT symbol, max(mu) AS m, avg((ret - mu)*(ret - mu)) AS v, avg((ret - mu)*(ret - mu)*(ret - mu)) AS m3, avg((ret - mu)*(ret - mu)*(ret - mu)*(ret - mu)) AS m4 FROM (SELECT symbol, ret, avg(ret) OVER (PARTITION BY symbol) AS mu FROM ab WHERE ret IS NOT NULL) t GROUP BY symbol) u",
    "b18_rolling_beta": f"SELECT symbol, date, CASE WHEN n >= 20 THEN round(c/nullif(v, 0), 4) END AS beta FROM (SELECT symbol, date, count(ret) OVER w AS n, covar_pop(bret, ret) OVER w AS c, var_pop(bret) OVER w AS v FROM ab WHERE ret IS NOT NULL AND bret IS NOT NULL WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)) t",
    "b26_lead_lag": "SELECT symbol, tau, count(*) AS n, round(covar_pop(x, y)/nullif(stddev_pop(x)*stddev_pop(y), 0), 4) AS r FROM (SELECT symbol, 0 AS tau, ret AS x, bret AS y FROM ab UNION ALL SELECT symbol, 1, ret, lag(bret, 1) OVER (PARTITION BY symbol ORDER BY date) FROM ab UNION ALL SELECT symbol, -1, ret, lead(bret, 1) OVER (PARTITION BY symbol ORDER BY date) FROM ab UNION ALL SELECT symbol, 2, ret, lag(bret, 2) OVER (PARTITION BY symbol ORDER BY date) FROM ab) t WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY symbol, tau",
    "b28_source_variance": "SELECT symbol, trading_day, count(*) AS sources, round(var_samp(tone), 9) AS variance FROM (SELECT symbol, trading_day, source, avg(sentiment_score) AS tone FROM news WHERE trading_day IS NOT NULL AND symbol IS NOT NULL AND sentiment_score IS NOT NULL GROUP BY symbol, trading_day, source) t GROUP BY symbol, trading_day HAVING count(*) >= 2",
    "b31_drawdown": "SELECT symbol, date, round(close/max(close) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1, 6) AS drawdown FROM ab",
    "b32_volatility": "SELECT symbol, date, CASE WHEN n = 20 THEN round(s*sqrt(252), 5) END AS volatility FROM (SELECT symbol, date, count(ret) OVER w AS n, stddev_samp(ret) OVER w AS s FROM ab WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) t",
    "b33_category_response": "SELECT event_category, count(*) AS items, round(avg(ar), 6) AS mean_ar, round(avg(abs(ar)), 6) AS mean_size FROM news n JOIN ab ON n.symbol = ab.symbol AND n.trading_day = ab.date WHERE ar IS NOT NULL AND duplicate_of IS NULL GROUP BY event_category",
    "b36_velocity": "SELECT symbol, trading_day, round((n - m)/greatest(1, m), 5) AS velocity FROM (SELECT symbol, trading_day, n, coalesce(avg(n) OVER (PARTITION BY symbol ORDER BY trading_day ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0) AS m FROM (SELECT symbol, trading_day, count(*) AS n FROM news WHERE trading_day IS NOT NULL AND symbol IS NOT NULL GROUP BY symbol, trading_day) t) u",
    "b38_authority": f"SELECT symbol, round(sum(sentiment_score*weight)/sum(weight), 6) AS tone FROM news JOIN {AUTHORITY} w ON news.source = w.source WHERE symbol IS NOT NULL AND sentiment_score IS NOT NULL GROUP BY symbol",
    "b39_risk_parity": "SELECT symbol, round((1/s)/sum(1/s) OVER (), 8) AS weight FROM (SELECT symbol, stddev_samp(ret) AS s FROM ab GROUP BY symbol) t WHERE s > 0",
    "b40_elasticity": f"SELECT symbol, round({_reg('bret', 'ret')}, 5) AS elasticity FROM ab WHERE ret IS NOT NULL AND bret IS NOT NULL GROUP BY symbol",
    "b43_up_down": "SELECT symbol, round(avg(CASE WHEN bret > 0 THEN ret END)/nullif(avg(CASE WHEN bret > 0 THEN bret END), 0), 5) AS up_capture, round(avg(CASE WHEN bret < 0 THEN ret END)/nullif(avg(CASE WHEN bret < 0 THEN bret END), 0), 5) AS down_capture FROM ab WHERE ret IS NOT NULL AND bret IS NOT NULL GROUP BY symbol",
    "b46_echo": "SELECT symbol, count(*) AS items, sum(CASE WHEN duplicate_of IS NOT NULL THEN 1 ELSE 0 END) AS echoes, round(sum(CASE WHEN duplicate_of IS NOT NULL THEN 1e0 ELSE 0e0 END)/nullif(sum(CASE WHEN duplicate_of IS NULL THEN 1 ELSE 0 END), 0), 6) AS amplification FROM news WHERE symbol IS NOT NULL GROUP BY symbol",
    "b48_crash_risk": "SELECT symbol, round(ln((nu - 1)*d/nullif((nd - 1)*u, 0)), 5) AS duvol FROM (SELECT symbol, sum(CASE WHEN ar > mu THEN 1 ELSE 0 END) AS nu, sum(CASE WHEN ar < mu THEN 1 ELSE 0 END) AS nd, sum(CASE WHEN ar > mu THEN (ar - mu)*(ar - mu) ELSE 0 END) AS u, sum(CASE WHEN ar < mu THEN (ar - mu)*(ar - mu) ELSE 0 END) AS d FROM (SELECT symbol, ar, avg(ar) OVER (PARTITION BY symbol) AS mu FROM ab WHERE ar IS NOT NULL) t GROUP BY symbol) v WHERE nu > 1 AND nd > 1 AND u > 0 AND d > 0",
    "b50_variance_ratio": "SELECT symbol, round(var_samp(r5)/nullif(5*var_samp(ret), 0), 5) AS vr5 FROM (SELECT symbol, ret, CASE WHEN count(ret) OVER w = 5 THEN sum(ret) OVER w END AS r5 FROM ab WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) t GROUP BY symbol",
    "b53_coskewness": "SELECT symbol, round(avg((ret - mr)*(bret - mb)*(bret - mb))/nullif(stddev_pop(ret)*var_pop(bret), 0), 4) AS coskew, round(avg((ret - mr)*(bret - mb)*(bret - mb)*(bret - mb))/nullif(stddev_pop(ret)*var_pop(bret)*stddev_pop(bret), 0), 4) AS cokurt FROM (SELECT symbol, ret, bret, avg(ret) OVER (PARTITION BY symbol) AS mr, avg(bret) OVER (PARTITION BY symbol) AS mb FROM ab WHERE ret IS NOT NULL AND bret IS NOT NULL) t GROUP BY symbol",
    "b56_tail_dependence": "SELECT symbol, count(*) AS n, round(sum(CASE WHEN pr <= 0.2 AND pb <= 0.2 THEN 1e0 ELSE 0e0 END)/nullif(sum(CASE WHEN pb <= 0.2 THEN 1 ELSE 0 END), 0), 5) AS lower_tail, round(sum(CASE WHEN pr >= 0.8 AND pb >= 0.8 THEN 1e0 ELSE 0e0 END)/nullif(sum(CASE WHEN pb >= 0.8 THEN 1 ELSE 0 END), 0), 5) AS upper_tail FROM (SELECT symbol, percent_rank() OVER (PARTITION BY symbol ORDER BY ret) AS pr, percent_rank() OVER (PARTITION BY symbol ORDER BY bret) AS pb FROM ab WHERE ret IS NOT NULL AND bret IS NOT NULL) t GROUP BY symbol",
    "b57_roll_spread": "SELECT symbol, round(2*sqrt(greatest(-covar_samp(d, e), 0)), 5) AS spread FROM (SELECT symbol, d, lag(d) OVER (PARTITION BY symbol ORDER BY date) AS e FROM (SELECT symbol, date, close - lag(close) OVER (PARTITION BY symbol ORDER BY date) AS d FROM ab) t) u WHERE d IS NOT NULL AND e IS NOT NULL GROUP BY symbol",
    "b60_bipower": "SELECT symbol, round(sum(ret*ret), 8) AS realised, round(1.5707963267948966*sum(abs(ret)*abs(prev)), 8) AS bipower FROM (SELECT symbol, ret, lag(ret) OVER (PARTITION BY symbol ORDER BY date) AS prev FROM ab WHERE ret IS NOT NULL) t GROUP BY symbol",
}


def _run(select: str, spark: SparkSession, d: str) -> DataFrame:
    # the frame and the news are named once each, as common table expressions over the DataFrames
    return spark.sql("WITH ab AS (SELECT * FROM {frame}), news AS (SELECT * FROM {items}) " + select, frame=P._abnormal(spark, d), items=table(spark, d, "news"))


def b10_fits(spark: SparkSession, d: str) -> DataFrame:
    """Conditional variance, regimes and the most likely break of each symbol's returns."""
    return fits.fitted(P._aligned(spark, d))


def b2_distance_to_default(spark: SparkSession, d: str) -> DataFrame:
    """Distance to default at a debt of 40 % of each symbol's last close, from its yearly volatility."""
    x = P._aligned(spark, d).groupBy("symbol").agg(F.max_by("close", "date").alias("equity"), (F.stddev_samp("ret") * F.sqrt(F.lit(252.0))).alias("volatility")).where("volatility > 0 and equity > 0")

    @F.pandas_udf("double")
    def distance(equity: pd.Series, volatility: pd.Series) -> pd.Series:
        return pd.Series([fits.merton(e, v, 0.4 * e)[2] for e, v in zip(equity, volatility, strict=True)])

    return x.select("symbol", F.round(distance("equity", "volatility"), 5).alias("distance"))


QUERIES = {name: partial(_run, select) for name, select in SELECTS.items()} | {"b2_distance_to_default": b2_distance_to_default, "b10_fits": b10_fits}
ORACLES = {name: f"WITH {P._AB} {select}" for name, select in SELECTS.items()}
