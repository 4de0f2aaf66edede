from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.streaming import coverage as C


def test_stream_equals_batch(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(k, start + timedelta(minutes=7 * k), k % 3, "ab"[k % 2], float(k), "{}") for k in range(200)] + [(5, start + timedelta(minutes=35), 2, "b", 5.0, "{}")]
    df = spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string")
    df.coalesce(1).write.parquet(str(tmp_path / "x"))
    next((tmp_path / "x").glob("*.parquet")).rename(tmp_path / "events.parquet")
    got = C.drained(C.tumbling(C.events(spark, str(tmp_path))), "t", "complete")
    want = df.groupBy(F.date_trunc("hour", "ts").alias("h"), "event_type").agg(F.count("*").alias("n"))
    assert {(r.window.start, r.event_type, r.n) for r in got.collect()} == {(r.h, r.event_type, r.n) for r in want.collect()}
    assert C.drained(C.distinct(C.events(spark, str(tmp_path))), "d").count() == 200
    assert {(r.user_id, r.n) for r in C.drained(C.running_counts(C.events(spark, str(tmp_path))), "r", "update", ["user_id"]).collect()} == {(0, 67), (1, 67), (2, 67)}
    assert C.drained(C.sessions(C.events(spark, str(tmp_path)), "10 minutes"), "s", "complete").count() >= 1
