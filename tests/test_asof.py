from datetime import datetime, timedelta

from hypothesis import given, settings
from hypothesis import strategies as st

from chronoloom.operators.asof import asof_join, asof_nearest

T0 = datetime(2024, 1, 1)
at = lambda h: None if h is None else T0 + timedelta(hours=h)
key, hour = st.sampled_from(["A", "B", None]), st.integers(0, 4000) | st.none()


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(key, hour), max_size=25), st.lists(st.tuples(key, hour, st.integers(0, 9)), max_size=25))
def test_directions_match_brute_force(spark, left, right):
    ls = [(i, k, at(h)) for i, (k, h) in enumerate(left)]
    rs = [(i, k, at(h)) for i, (k, h, _) in enumerate(right)]
    ldf, rdf = spark.createDataFrame(ls, "id int, k string, t timestamp_ntz"), spark.createDataFrame(rs, "id int, k string, t timestamp_ntz")
    for strict in (False, True):
        for forward in (False, True):
            got = {r["id"]: r["match"] and r["match"]["id"] for r in asof_join(ldf, rdf, ["k"], "t", "t", strict=strict, forward=forward, precedence=["id"]).collect()}
            want = {}
            for i, k, t in ls:
                ok = [(r_t, r_i) for r_i, r_k, r_t in rs if None not in (k, t, r_k, r_t) and k == r_k and ((r_t > t if forward else r_t < t) or (not strict and r_t == t))]
                want[i] = None if not ok else max(x for x in ok if x[0] == (min(ok)[0] if forward else max(ok)[0]))[1]
            assert got == want, (strict, forward)


def test_nearest_prefers_the_earlier(spark):
    l_ = spark.createDataFrame([(1, "A", at(12)), (2, "A", at(0)), (3, "A", at(99)), (4, "C", at(1))], "id int, k string, t timestamp_ntz")
    r = spark.createDataFrame([("A", at(10)), ("A", at(14)), ("A", at(14))], "k string, t timestamp_ntz")
    got = {x["id"]: x["match"] and x["match"]["t"] for x in asof_nearest(l_, r, ["k"], "t", "t").collect()}
    assert got == {1: at(10), 2: at(10), 3: at(14), 4: None}


def test_plan_has_no_quadratic_join_and_whole_rows_are_carried(spark):
    l_ = spark.createDataFrame([(1, "A", at(12))], "id int, k string, t timestamp_ntz")
    r = spark.createDataFrame([("A", at(9), 5.0), ("A", at(10), None)], "k string, t timestamp_ntz, v double")
    out = asof_join(l_, r, ["k"], "t", "t")
    plan = out._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert out.first()["match"]["v"] is None and out.first()["match"]["t"] == at(10)
    assert asof_join(l_.limit(0), r, ["k"], "t", "t").count() == 0
    assert asof_join(l_, r.limit(0), ["k"], "t", "t").first()["match"] is None
