from datetime import datetime, timedelta

from hypothesis import given, settings
from hypothesis import strategies as st

from chronoloom.llm import tick_join
from chronoloom.llm.tick_join import HOUR_US, nearest_join

T0 = datetime(2024, 1, 1)
at = lambda m: None if m is None else T0 + timedelta(minutes=m)
side = st.lists(st.tuples(st.sampled_from(["A", "B", None]), st.integers(-3000, 6000) | st.sampled_from([0, 720, 2160]) | st.none()), max_size=30)


@settings(max_examples=8, deadline=None)
@given(side, side, st.sampled_from([None, HOUR_US * 30, HOUR_US // 2]))
def test_is_brute_force(spark, left, right, tick):
    ls, rs = ([(i, k, at(m), "x") for i, (k, m) in enumerate(x)] for x in (left, right))
    schema = "id bigint, k string, t timestamp_ntz, tick string"
    got = nearest_join(spark.createDataFrame(ls, schema), spark.createDataFrame(rs, schema), ["k"], "t", "id", "t", "id", 36 * HOUR_US, tick)
    want = []
    for i, k, t, _ in ls:
        c = [(abs(rt - t), rt, j) for j, rk, rt, _ in rs if None not in (k, t, rk, rt) and k == rk and abs(rt - t) <= timedelta(hours=36)]
        if c:
            want.append((i, min(c)[2]))
    assert sorted((r["left_id"], r["right_id"]) for r in got.collect()) == want


def test_hot_ticks_are_shared_out(spark, monkeypatch):
    schema = "id bigint, k string, t timestamp_ntz"
    left = spark.createDataFrame([(i, "A", at(i % 50)) for i in range(200)], schema)
    right = spark.createDataFrame([(i, "A", at(7 * i)) for i in range(9)], schema)
    run = lambda: sorted(tuple(r) for r in nearest_join(left, right, ["k"], "t", "id", "t", "id", 36 * HOUR_US).collect())
    want = run()
    monkeypatch.setattr(tick_join, "HOT_ROWS", 20)
    assert run() == want and len(want) == 200
