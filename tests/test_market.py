import math
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.stats import t_equivalent, t_two_sided
from tidemark.operators import asof, market, revisions, study


def weekdays(n, start=date(2022, 6, 1)):
    out, d = [], start
    while len(out) < n:
        if d.weekday() < 5:
            out.append(d)
        d += timedelta(days=1)
    return out


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(7)
    m = rng.normal(0.0002, 0.009, 200)
    c = 0.0005 + 1.4 * m + rng.normal(0, 0.004, 200)
    days = weekdays(200)
    rows = [("A", d, float(x), 1.0, i) for i, (d, x) in enumerate(zip(days, 100 * np.cumprod(1 + c), strict=True))]
    bench = [(d, float(x)) for d, x in zip(days, 100 * np.cumprod(1 + m), strict=True)]
    frame = market.frame(spark.createDataFrame(rows, "symbol string, date date, close double, volume double, seq bigint"))
    return days, market.aligned(frame, spark.createDataFrame(bench, "date date, benchmark_close double")), c, m


def test_frame_keeps_last_then_drops_null(spark):
    rows = [("A", date(2024, 1, 2), 1.0, None, 1), ("A", date(2024, 1, 2), None, None, 2), ("A", date(2024, 1, 1), 5.0, None, 3), (None, date(2024, 1, 1), 5.0, None, 4)]
    got = market.frame(spark.createDataFrame(rows, "symbol string, date date, close double, volume double, seq bigint")).collect()
    assert [(r.date, r.close) for r in got] == [(date(2024, 1, 1), 5.0)]


def test_model_recovers_beta(series):
    days, aligned, c, m = series
    row = market.models(aligned, str(days[180])).first()
    x, y = m[1:180][:-5][-120:], c[1:180][:-5][-120:]
    beta, alpha = np.polyfit(x, y, 1)
    assert row.fitted and row.observations == 120
    assert math.isclose(row.beta, beta, rel_tol=1e-9) and math.isclose(row.alpha, alpha, abs_tol=1e-12)
    assert math.isclose(row.residual_sd, float(np.std(y - alpha - beta * x, ddof=2)), rel_tol=1e-9)


def test_short_series_falls_back(series):
    days, aligned, _, _ = series
    row = market.models(aligned, str(days[30])).first()
    assert not row.fitted and row.beta == 1.0 and row.alpha == 0.0 and row.residual_sd is None


def test_constant_benchmark_falls_back(spark, series):
    days, aligned, _, _ = series
    flat = aligned.withColumn("bret", F.lit(0.0))
    assert not market.models(flat, str(days[180])).first().fitted


def test_cumulative_rolls_forward_and_clamps(spark, series):
    days, aligned, _, _ = series
    ab = market.abnormal(aligned, market.models(aligned, str(days[150])))
    ar = {r.date: r.ar for r in ab.collect()}
    saturday = next(d for d in (days[160] + timedelta(days=k) for k in range(7)) if d.weekday() == 5)
    events = spark.createDataFrame([("A", saturday), ("A", days[-1]), ("A", days[-1] + timedelta(days=9))], "symbol string, day date")
    got = {r.day: r for r in market.cumulative(ab, events).collect()}
    at = next(i for i, d in enumerate(days) if d > saturday)
    assert got[saturday].anchor == days[at] and math.isclose(got[saturday].car, sum(ar[d] for d in days[at - 1 : at + 4]), abs_tol=1e-12)
    assert got[days[-1]].truncated and got[days[-1]].days == 2
    assert days[-1] + timedelta(days=9) not in got


def test_permutation_matches_loop(spark, series):
    days, aligned, _, _ = series
    ab = market.abnormal(aligned, market.models(aligned, str(days[150])))
    flagged = spark.createDataFrame([("A", days[170])], "symbol string, day date")
    cars = market.cumulative(ab, flagged)
    row, car = market.permutation(ab, flagged, cars).first(), cars.first().car
    rows = [(r.date, r.ar) for r in ab.orderBy("date").collect() if r.ar is not None]
    sums = [sum(a for _, a in rows[i : i + 5]) for i in range(len(rows) - 4) if days[170] not in [d for d, _ in rows[i : i + 5]]]
    drawn = market.permutation(ab, flagged, cars, most=50).first()
    picked = [sums[i] for i in np.random.default_rng(42).choice(len(sums), size=50, replace=False)]
    assert drawn.windows == 50 and math.isclose(drawn.p_value, sum(abs(s) >= abs(car) - 1e-12 for s in picked) / 50, abs_tol=1e-9)
    assert row.windows == len(sums) and math.isclose(row.p_value, sum(abs(s) >= abs(car) - 1e-12 for s in sums) / len(sums), abs_tol=1e-9)


def test_t_distribution():
    assert math.isclose(t_equivalent(1.5, 98), 1.51254, abs_tol=1e-4) and math.isclose(t_equivalent(1.5, 5), 1.78913, abs_tol=1e-4)
    assert t_equivalent(1.5, 0) == 1.5 and math.isclose(t_two_sided(0.0, 7), 1.0)
    assert all(t_equivalent(1.5, k) > t_equivalent(1.5, k + 1) for k in range(1, 60))


def test_session_map_never_looks_the_wrong_way(spark):
    sessions = spark.createDataFrame([("A", date(2024, 1, d)) for d in (2, 3, 8)], "symbol string, date date")
    days = spark.createDataFrame([("A", date(2024, 1, d)) for d in range(1, 11)] + [("B", date(2024, 1, 1)), (None, None)], "symbol string, date date")
    for forward, strict in ((True, False), (True, True), (False, False), (False, True)):
        got = {(r.symbol, r.date): r.session for r in asof.session_map(days, sessions, forward, strict).collect()}
        for (s, d), found in got.items():
            ok = [x for x in (date(2024, 1, k) for k in (2, 3, 8)) if s == "A" and ((x > d or (x == d and not strict)) if forward else (x < d or (x == d and not strict)))]
            assert found == ((min(ok) if forward else max(ok)) if ok else None)


def test_close_is_inclusive_and_date_only_never_late(spark):
    sessions = spark.createDataFrame([("A", date(2023, 1, d)) for d in (25, 27)], "symbol string, date date")
    rows = [(1, "2023-01-25 09:59:59", "exact"), (2, "2023-01-25 10:00:00", "exact"), (3, "2023-01-25 12:00:00", "date-only"), (4, None, "missing"), (5, "2023-01-28 12:00:00", "exact")]
    news = spark.createDataFrame(rows, "seq int, t string, timestamp_confidence string").select(F.lit("A").alias("symbol"), "seq", F.col("t").cast("timestamp").alias("published_at"), "timestamp_confidence")
    got = {r.seq: (r.is_late, r.session) for r in asof.attributed(news, sessions).collect()}
    assert got == {1: (False, date(2023, 1, 25)), 2: (True, date(2023, 1, 27)), 3: (False, date(2023, 1, 25)), 4: (False, None), 5: (True, None)}


def test_buckets_partition_days(spark, series):
    days, aligned, _, _ = series
    ab = market.abnormal(aligned, market.models(aligned, str(days[100])))
    news = spark.createDataFrame([("A", days[k], 1, "s", f"u{k}", None, False, 0.5, 0.9, None, "x", "joy") for k in range(101, 120)], "symbol string, trading_day date, seq int, source string, url string, duplicate_of string, after_close boolean, relevance_score double, sentiment_score double, staleness_score double, event_category string, emotion_label string")
    d = study.daily(ab, study.coverage(news), str(days[100]))
    f = study.flags(d, market.thresholds(d, 1.5))
    row = study.diagnostics(f).first()
    assert row.days == row.candidate + row.coverage_only + row.return_only + row.no_coverage_big_move + row.routine == 100


def test_gaps_and_cover_make_the_request(spark):
    segs = spark.createDataFrame([("A", date(2024, 1, 3), date(2024, 1, 5)), ("A", date(2024, 1, 6), date(2024, 1, 7)), ("A", date(2024, 1, 12), date(2024, 1, 30))], "symbol string, start date, end date")
    req = spark.createDataFrame([("A", date(2024, 1, 1), date(2024, 1, 15)), ("B", date(2024, 1, 1), date(2024, 1, 2))], "symbol string, start date, end date")
    got = sorted((r.symbol, r.start.day, r.end.day) for r in revisions.gaps(segs, req).collect())
    assert got == [("A", 1, 2), ("A", 8, 11), ("B", 1, 2)]


def test_revisions_count_returns_to_an_old_level(spark):
    rows = [("A", date(2024, 1, k), c) for k, c in enumerate((5.0, 5.0, 6.0, 5.0, 5.0), 1)]
    x = revisions.revisions(spark.createDataFrame(rows, "symbol string, date date, close double"))
    assert [r.date.day for r in x.orderBy("date").collect()] == [1, 3, 4]
    assert [(r.start.day, r.end.day, round(r.change, 4)) for r in revisions.moves(x).orderBy("start").collect()] == [(1, 3, 0.2), (3, 4, -0.1667)]
