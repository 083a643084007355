from datetime import datetime, timedelta

from pyspark.sql import functions as F

from chronoloom.operators import rolling
from chronoloom.operators.blocks import blocked_row_number, blocked_scan

T0 = datetime(2024, 1, 1)


def test_totals_match_brute_force(spark, monkeypatch):
    data = {("A", 0): 1.5, ("A", 3): 2.25, ("A", 70): -4.0, ("A", 71): None, ("B", 5): 0.1, ("B", 6): 0.2}
    df = spark.createDataFrame([(k, d, v) for (k, d), v in data.items()] + [(None, 3, 1.0), ("C", None, 1.0)], "k string, day int, v double").withColumn("own", F.lit("clash"))
    monkeypatch.setattr(rolling, "BLOCK_DAYS", 8)
    got = {(r["k"], r["day"]): r for r in rolling.trailing_totals(df, ["k"], ["v"]).collect()}
    assert set(got) == {("A", d) for d in range(72)} | {("B", 5), ("B", 6)}
    for (k, d), r in got.items():
        for p in (7, 30):
            vs = [data[k, x] for x in range(d - p + 1, d + 1) if data.get((k, x)) is not None]
            total = round(sum(vs), 6)
            assert r[f"v_sum_{p}"] == total and r[f"v_days_{p}"] == len(vs)
            assert r[f"v_avg_{p}"] == total / p and r[f"v_mean_{p}"] == (total / len(vs) if vs else None)


def test_quiet_and_recent(spark, rows):
    schema = "news_id bigint, ticker string, as_of timestamp_ntz, news_count bigint, loaded_at timestamp_ntz"
    at = lambda d, h=0: T0 + timedelta(days=d, hours=h)
    data = [(1, "A", at(0, 5), 3, at(0)), (2, "A", at(0, 6), 0, at(-1)), (3, "A", at(20), None, at(20)), (4, None, at(1), 5, at(1)), (5, "B", at(1), 2, None), (6, "B", at(1), 4, None)]
    got = rows(rolling.quiet_and_recent(spark.createDataFrame(data, schema)))
    iso = lambda d: at(d).strftime("%Y-%m-%d")
    assert got == sorted([("A", iso(d), "all_recent") for d in range(7)] + [("A", iso(d), "silent") for d in range(7, 21)] + [("B", iso(1), "all_recent")], key=repr)
    assert rolling.quiet_and_recent(spark.createDataFrame([], schema)).count() == 0


def test_names_precedence_and_exactness(spark):
    schema = "day int, block string, part string, own double, v0 bigint, rank int"
    data = [(0, "A", "x", 0.1, 5, 1), (0, "A", "x", 9.0, 7, 0), (1, "A", None, 0.2, None, 1), (2, "A", "y", float("nan"), 1, 1), (3, "A", "y", 1e18, 1, 1), (4, "A", "y", 0.30000000000000004, 1, None), (4, "A", "y", 0.3, 2, 0)]
    df = spark.createDataFrame(data, schema)
    got = {r["day"]: r for r in rolling.trailing_totals(df, ["block"], ["own", "v0"], (2, 400), precedence=["rank"]).collect()}
    assert [got[d]["own_sum_2"] for d in range(5)] == [0.1, 0.3, 0.2, 0.0, 0.3] and got[4]["own_sum_400"] == 0.6
    assert [got[d]["v0_sum_400"] for d in range(5)] == [5, 5, 6, 7, 9] and got[3]["own_days_2"] == 0 and got[3]["own_mean_2"] is None
    spoken = rolling.trailing_totals(df.withColumn("part", F.lit("v0")), ["block"], ["own", "v0"], (7,), precedence=["rank"], part="part").where("day = 4").first()
    assert spoken["own_sum_7"] == 0 and spoken["v0_sum_7"] == 9


def test_blocked_scans(spark):
    data = [("A", i // 4, i, (i * 7) % 5 if i % 3 else None) for i in range(23)] + [(None, 0, 1, 1), ("B", 9, 1, None)]
    df = spark.createDataFrame(data, "k string, b int, o int, v int")
    specs = {x: (x, "v") for x in ("sum", "min", "max", "last")}
    got = {(r["k"], r["o"]): tuple(r[x] for x in specs) for r in blocked_scan(df, ["k"], "b", ["o"], specs).collect()}
    assert len(got) == 24 and got["B", 1] == (None,) * 4
    for i in range(23):
        vs = [v for k, _, o, v in data if k == "A" and o <= i and v is not None]
        assert got["A", i] == ((sum(vs), min(vs), max(vs), vs[-1]) if vs else (None,) * 4)
    before = {r["o"]: r["m"] for r in blocked_scan(df.where("k = 'A'"), ["k"], "b", ["o"], {"m": ("max", "o")}, upto=-1).collect()}
    assert before == {0: None} | {i: i - 1 for i in range(1, 23)}
    assert {r["o"]: r["rn"] for r in blocked_row_number(df.where("k = 'A'"), ["k"], "b", ["o"]).collect()} == {i: i + 1 for i in range(23)}
