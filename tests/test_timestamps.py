from datetime import datetime
from zoneinfo import ZoneInfo

import pytest

from tidemark.operators.timestamps import normalize, zone_abbreviations

US = 1_000_000


def micros(*parts, zone="UTC"):
    return int(datetime(*parts, tzinfo=ZoneInfo(zone)).timestamp() * US)


CASES = [
    ("in", "2024-04-30T13:49:21+05:30", micros(2024, 4, 30, 8, 19, 21), "exact"),
    ("in", "1700345633", 1700345633 * US, "exact"),
    ("in", "1655821627050", 1655821627050 * 1000, "exact"),
    ("in", "1678606206138137", 1678606206138137, "exact"),
    ("in", "20230915052959", micros(2023, 9, 15, 5, 29, 59, zone="Asia/Kolkata"), "exact"),
    ("in", "20241125T222616Z", micros(2024, 11, 25, 22, 26, 16), "exact"),
    ("in", "20230630", micros(2023, 6, 30, zone="Asia/Kolkata"), "date-only"),
    ("in", "2024-03-15T17:07:39.2967891Z", micros(2024, 3, 15, 17, 7, 39) + 296789, "exact"),
    ("us", "01/16/2022 02:04 AM", micros(2022, 1, 16, 2, 4, zone="America/New_York"), "exact"),
    ("in", "11/03/2024", micros(2024, 3, 11, zone="Asia/Kolkata"), "date-only"),
    ("us", "22.10.2022 02:50 UTC-4", micros(2022, 10, 22, 6, 50), "exact"),
    ("us", "10 March 2024, 01:01 EST", micros(2024, 3, 10, 6, 1), "exact"),
    ("us", "Nov 5, 2024 11.23 a.m. ET", micros(2024, 11, 5, 11, 23, zone="America/New_York"), "exact"),
    ("de", "28. März 2022, 12:46 Uhr", micros(2022, 3, 28, 12, 46, zone="Europe/Berlin"), "exact"),
    ("in", "FIRST PUBLISHED - OCTOBER 29, 2023 9.19 A.M. IST", micros(2023, 10, 29, 3, 49), "exact"),
    ("in", "Posted on Sat 3 Jun 2023 at 21:36", micros(2023, 6, 3, 16, 6), "exact"),
    ("in", "2023-05-10\xa016:15 ", micros(2023, 5, 10, 10, 45), "exact"),
    ("us", "2023-03-12 02:30", micros(2023, 3, 12, 7, 30), "exact"),  # skipped by the clock change
    ("us", "2023-11-05 01:30", micros(2023, 11, 5, 5, 30), "exact"),  # twice: the first
    ("us", "05-Nov-23 01:30:00 EST", micros(2023, 11, 5, 6, 30), "exact"),  # twice: the text says which
]


def test_forms(spark):
    feed = spark.createDataFrame([(i, s, t) for i, (s, t, _, _) in enumerate(CASES)], "feed_id bigint, source string, published_at string")
    outlets = spark.createDataFrame([("in", "Asia/Kolkata", "DMY"), ("us", "America/New_York", "MDY"), ("de", "Europe/Berlin", "DMY")], "source string, home_zone string, date_order string")
    got = {r.feed_id: (r.instant_us, r.confidence) for r in normalize(feed, outlets).collect()}
    for i, (_, text, us, kind) in enumerate(CASES):
        assert got.get(i) == (us, kind), text


@pytest.mark.parametrize("text", [None, "", "yesterday", "2 hours ago", "[date]", "2024-02-30 10:15:00", "2023-13-45T10:00:00Z", "31/04/2023 09:00", "N/A", "2024-05-08 25:00", "2024-05-08T10:61:00Z", "x" * 5000])
def test_no_case(spark, text):
    feed = spark.createDataFrame([(1, "in", text)], "feed_id bigint, source string, published_at string")
    outlets = spark.createDataFrame([("in", "Asia/Kolkata", "DMY")], "source string, home_zone string, date_order string")
    assert normalize(feed, outlets).count() == 0


def test_unknown_zone_extra_columns_and_empty(spark):
    feed = spark.createDataFrame([(1, "?", "2024-01-01 10:00", 5, "kept"), (2, "?", "2024-01-01T10:00:00Z", 6, "kept")], "feed_id bigint, source string, published_at string, instant_us int, confidence string")
    outlets = spark.createDataFrame([("in", "Nowhere/Land", "DMY"), (None, None, None)], "source string, home_zone string, date_order string")
    rows = normalize(feed, outlets).collect()
    assert [(r.feed_id, r.instant_us) for r in rows] == [(2, micros(2024, 1, 1, 10))]
    assert normalize(feed.limit(0), outlets.limit(0)).count() == 0


def test_abbreviations():
    found = {(z, a): m for z, a, m in zone_abbreviations(["America/New_York", "Asia/Kolkata", "No/Zone"])}
    assert found["America/New_York", "est"] == -300 and found["America/New_York", "edt"] == -240 and found["Asia/Kolkata", "ist"] == 330
