from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from chronoloom.functions.timestamps import utc_of_local, with_utc_millis
from chronoloom.operators.instants import article_instants, renormalised


def ms(*a):
    return int(datetime(*a, tzinfo=timezone.utc).timestamp() * 1000)


CASES = [
    ("2024-01-02T03:04:05Z", "UTC", "MDY", ms(2024, 1, 2, 3, 4, 5)),
    (" 2024-01-02 03:04:05\n", "America/New_York", "MDY", ms(2024, 1, 2, 8, 4, 5)),
    ("2024-01-02T03:04:05.678901+05:30", "UTC", "MDY", ms(2024, 1, 1, 21, 34, 5) + 678),
    ("2024-01-02 03:04:05 -0800", "UTC", "MDY", ms(2024, 1, 2, 11, 4, 5)),
    ("2024-07-02 03:04:05 Europe/Berlin", "UTC", "MDY", ms(2024, 7, 2, 1, 4, 5)),
    ("2024-07-02 03:04:05 America/New_York", "UTC", "MDY", ms(2024, 7, 2, 7, 4, 5)),
    ("Tue, 02 Jan 2024 03:04:05 GMT", "Asia/Tokyo", "MDY", ms(2024, 1, 2, 3, 4, 5)),
    ("Jan 2, 2024 12:30 AM EST", "UTC", "MDY", ms(2024, 1, 2, 5, 30)),
    ("January 2, 2024", "UTC", "MDY", ms(2024, 1, 2)),
    ("2 January 2024, 13:05", "Europe/London", "MDY", ms(2024, 1, 2, 13, 5)),
    ("03/04/2024 01:15 PM", "UTC", "MDY", ms(2024, 3, 4, 13, 15)),
    ("03/04/2024 13:15", "UTC", "DMY", ms(2024, 4, 3, 13, 15)),
    ("3/4/24 9:15", "UTC", "DMY", ms(2024, 4, 3, 9, 15)),
    ("03.04.2024 13:15", "UTC", "MDY", ms(2024, 4, 3, 13, 15)),
    ("20240304", "UTC", "MDY", ms(2024, 3, 4)),
    ("20240304T050607Z", "UTC", "MDY", ms(2024, 3, 4, 5, 6, 7)),
    ("1709532000", "Asia/Tokyo", "MDY", 1709532000000),
    ("1709532000123", "Asia/Tokyo", "MDY", 1709532000123),
    # the hour that comes twice is the first; the one that is skipped is read with the offset before
    ("2024-11-03 01:30:00", "America/New_York", "MDY", ms(2024, 11, 3, 5, 30)),
    ("2024-03-10 02:30:00", "America/New_York", "MDY", ms(2024, 3, 10, 7, 30)),
    *[(t, "UTC", "MDY", None) for t in ("2023-02-30", "2024-13-05T08:00:00Z", "0000-00-00 00:00:00", "yesterday", "", "n/a", None, "2024-01-02 25:00:00", "13:00 PM", "x" * 100_000, "9" * 40)],
    ("2024-01-02 03:04:05", None, "MDY", None),
    ("2024-01-02 03:04:05", "Mars/Olympus", "MDY", None),
    ("03/04/2024", "UTC", None, None),
]


def test_cascade(spark):
    df = spark.createDataFrame([(i, t, z, o) for i, (t, z, o, _) in enumerate(CASES)], "i int, t string, z string, o string")
    got = {r["i"]: r["ms"] for r in with_utc_millis(df, "t", F.col("z"), F.col("o"), "ms").collect()}
    assert {(CASES[i][0], CASES[i][1]): v for i, v in got.items()} == {(t, z): e for t, z, _, e in CASES if (t, z) != ("2024-01-02 03:04:05", None)} | {("2024-01-02 03:04:05", None): None}


@pytest.mark.parametrize(("policy", "twice", "gap"), [(("first", "before"), "05:30", "07:30"), (("last", "after"), "06:30", "06:30"), (("null", "null"), None, None)])
def test_clock_changes(spark, policy, twice, gap):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2024-11-03 01:30:00' AS twice, TIMESTAMP_NTZ'2024-03-10 02:30:00' AS gap, TIMESTAMP_NTZ'2024-06-01 02:30:00' AS plain")
    r = df.select(*[F.date_format(utc_of_local(F.col(c), F.lit("America/New_York"), *policy), "HH:mm").alias(c) for c in df.columns]).first()
    assert tuple(r) == (twice, gap, "06:30")


def test_edges(spark, rows):
    schema = "article_id bigint, feed string, published_at string, as_of string, extra int"
    feeds = spark.createDataFrame([("a", "Asia/Tokyo", "DMY"), ("a", "Asia/Tokyo", "DMY")], "feed string, zone_name string, date_order string")
    df = spark.createDataFrame([(1, "a", "2024-01-02 09:00:00", "2024-01-02", 1), (2, None, "2024-01-02 09:00:00", "02 Jan 2024", 1), (3, "b", None, None, None)], schema)
    assert rows(renormalised(df, feeds)) == [(1, "published_at", ms(2024, 1, 2)), (2, "as_of", ms(2024, 1, 2))]
    assert article_instants(df, feeds).count() == 3
    assert renormalised(df.limit(0), feeds.limit(0)).count() == 0


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
def test_a_line_end_is_not_the_normal_form(spark, rows, end):
    schema = "article_id bigint, feed string, published_at string, as_of string"
    feeds = spark.createDataFrame([("a", "Asia/Tokyo", "DMY")], "feed string, zone_name string, date_order string")
    df = spark.createDataFrame([(1, "a", "2024-01-02T03:04:05Z" + end, "2024-01-02" + end), (2, "a", "2024-01-02T03:04:05Z", "2024-01-02")], schema)
    assert rows(renormalised(df, feeds)) == [(1, "as_of", ms(2024, 1, 2)), (1, "published_at", ms(2024, 1, 2, 3, 4, 5))]
