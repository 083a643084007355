from datetime import datetime, timedelta

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronoloom.operators.validity import DAY_US, as_known, dyadic_cover, interval_join

T0 = datetime(2024, 1, 1)


def day(n, h=0):
    return T0 + timedelta(days=n, hours=h)


def test_cover_tiles_the_interval(spark):
    pairs = [(a, b) for a in (-70, -3, 0, 1, 5, 64) for b in (-70, -2, 0, 1, 7, 63, 64, 200, 1000)]
    df = spark.createDataFrame(pairs, "a bigint, b bigint")
    for levels in (1, 4, 8):
        for r in df.withColumn("n", dyadic_cover("a", "b", levels)).collect():
            ticks = [t for x in r["n"] for t in range(x["node"] << x["level"], (x["node"] + 1) << x["level"])]
            assert sorted(ticks) == list(range(r["a"], r["b"])), (r, levels)
            assert len(r["n"]) <= 2 * levels + max(0, r["b"] - r["a"]) // (1 << (levels - 1))


def brute(bars, scores):
    out = set()
    for b, t, d in bars:
        c = [(cd, sa, s) for s, tk, cd, p, sa in scores if None not in (tk, cd, p, sa, t, d) and tk == t and cd < d and sa <= d]
        if c:
            out.add((b, max(c)[2]))
    return out


bar = st.tuples(st.sampled_from(["A", "B", None]), st.integers(0, 40))
score = st.tuples(st.sampled_from(["A", "B", None]), st.integers(0, 40) | st.none(), st.sampled_from([0.5, None]), st.integers(0, 400), st.integers(0, 23))


@settings(max_examples=6, deadline=None)
@given(st.lists(bar, max_size=30), st.lists(score, max_size=30))
def test_as_known_is_brute_force(spark, bars, scores):
    b = [(i, t, day(d)) for i, (t, d) in enumerate(bars)]
    s = [(i, t, None if d is None else day(d), p, None if k == 400 else day(k // 10, h)) for i, (t, d, p, k, h) in enumerate(scores)]
    bdf = spark.createDataFrame(b, "bar_id bigint, ticker string, date timestamp_ntz").withColumn("level", F.lit(1)).withColumn("pos_mean", F.lit("clash"))
    sdf = spark.createDataFrame(s, "score_id bigint, ticker string, call_date timestamp_ntz, pos_mean double, scored_at timestamp_ntz").withColumn("node", F.lit(1))
    got = [(r["bar_id"], r["score_id"]) for r in as_known(bdf, sdf).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(b, s)


def test_half_open_and_overlapping(spark, rows):
    e = spark.createDataFrame([("k", t, t) for t in (0, 9, 10, 19, 20)], "k string, at bigint, id int")
    f = spark.createDataFrame([("k", 0, 10, "a"), ("k", 5, 20, "b"), ("k", 7, 7, "empty"), ("k", 9, 3, "turned"), (None, 0, 99, "n")], "k string, s bigint, e bigint, name string")
    got = interval_join(e, f, ["k"], "at", "s", "e", tick_us=4, levels=3)
    assert rows(got, "id", "name") == [(0, "a"), (10, "b"), (19, "b"), (9, "a"), (9, "b")]
    assert DAY_US == 86_400 * 10**6


def test_future_scores_change_nothing(spark, rows):
    bars = spark.createDataFrame([(i, "A", day(i)) for i in range(20)], "bar_id bigint, ticker string, date timestamp_ntz")
    old = [(1, "A", day(2), 0.1, day(3)), (2, "A", day(8), 0.2, day(8, 5))]
    schema = "score_id bigint, ticker string, call_date timestamp_ntz, pos_mean double, scored_at timestamp_ntz"
    before = rows(as_known(bars, spark.createDataFrame(old, schema)).where("bar_id < 12"))
    after = rows(as_known(bars, spark.createDataFrame([*old, (3, "A", day(9), 9.0, day(12)), (4, "A", day(12), 9.0, day(1))], schema)).where("bar_id < 12"))
    assert before == after


def test_cover_by_levels_some_steps_apart(spark):
    pairs = [(a, b) for a in (-70, -9, 0, 1, 5, 64) for b in (-70, -2, 0, 1, 7, 63, 64, 200, 1000)]
    df = spark.createDataFrame(pairs, "a bigint, b bigint")
    for levels in ((0, 3, 6), (0, 2), (0, 5)):
        step = max(b - a for a, b in zip(levels, levels[1:], strict=False))
        for r in df.withColumn("n", dyadic_cover("a", "b", levels)).collect():
            ticks = [t for x in r["n"] for t in range(x["node"] << x["level"], (x["node"] + 1) << x["level"])]
            assert sorted(ticks) == list(range(r["a"], r["b"])) and {x["level"] for x in r["n"]} <= set(levels), (r, levels)
            assert len(r["n"]) <= 2 * len(levels) * (1 << step) + max(0, r["b"] - r["a"]) // (1 << levels[-1])
