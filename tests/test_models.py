"""Learners behind the walk-forward, and statistics by ranks."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.operators import eda, models
from chronoloom.operators import evaluate as ev

T0 = datetime(2021, 1, 4)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    rows = []
    for t, (n, start) in {"A": (60, 0), "B": (40, 35), "C": (9, 0)}.items():
        x = rng.normal(0, 1, (n, 3))
        y = 0.5 + 2 * x[:, 0] - x[:, 1] + rng.normal(0, 0.1, n)
        for i in range(n):
            a, b, c = (None if (i + k) % 13 == 5 else float(v) for k, v in enumerate(x[i]))
            rows.append((t, i + 1, T0 + timedelta(days=start + i), 0.01, 0.02, a, b, c, None if i % 17 == 3 else float(y[i])))
    return rows


def folded(spark, data):
    return ev.with_fold(spark.createDataFrame(data, "ticker string, rn bigint, date timestamp_ntz, returns double, ret_lag_1 double, a double, b double, c double, target_rv5 double"))


SETS = {"two": ("a", "b"), "all": ("a", "b", "c"), "none": ()}


def test_linear_sets_are_least_squares(spark, data):
    df = folded(spark, data)
    got = {(r["model"], r["ticker"], r["date"]): r["pred"] for r in models.linear_sets(df, SETS).collect()}
    rows = [r.asDict() for r in df.collect()]
    want = {}
    for n, s in SETS.items():
        whole = [r for r in rows if r["target_rv5"] is not None and all(r[c] is not None for c in s)]
        for k in range(1, 6):
            test = [r for r in whole if r["fold"] == k]
            begin = min(r["date"] for r in rows if r["fold"] == k)
            train = [r for r in whole if r["fold"] < k and r["date"] < begin]
            x = lambda rs, s=s: np.array([[1.0, *[r[c] for c in s]] for r in rs])
            b = np.linalg.lstsq(x(train), np.array([r["target_rv5"] for r in train]), rcond=None)[0]
            want |= {(n, r["ticker"], r["date"]): p for r, p in zip(test, (x(test) @ b).tolist() if test else [], strict=True)}
    assert got.keys() == want.keys() and len(want) > 40
    for key, p in want.items():
        assert got[key] == pytest.approx(p, abs=1e-9), key
    one = {(r["ticker"], r["date"]): r["pred"] for r in models.walk_forward(df, models.Linear(), SETS["all"]).collect()}
    assert one == {k[1:]: pytest.approx(p, abs=1e-9) for k, p in want.items() if k[0] == "all"}


def test_nothing_is_learned_from_what_comes_later(spark, data):
    seen = []

    class Spy:
        name = "spy"

        def fit(self, train, features, target):
            last = train.agg(F.max("date")).first()[0]

            def predict(test):
                assert target not in test.columns
                seen.append((last, test.agg(F.min("date")).first()[0]))
                return test.withColumn("pred", F.lit(1.0))

            return predict

    df = folded(spark, data)
    got = models.walk_forward(df, Spy(), SETS["two"])
    assert got.where("pred <> 1 or model <> 'spy'").count() == 0
    assert len(seen) == 5 and all(a < b for a, b in seen if b)
    # what comes after a fold's first date changes none of its predictions
    begin = df.where("fold = 4").agg(F.min("date")).first()[0]
    later = df.withColumn("target_rv5", F.when(F.col("date") >= begin, F.col("target_rv5") * 99).otherwise(F.col("target_rv5")))
    preds = lambda d: {(r["ticker"], r["date"]): r["pred"] for r in models.walk_forward(d, models.Linear(), SETS["all"]).where("fold = 4").collect()}
    assert preds(df) == {k: pytest.approx(v, abs=1e-9) for k, v in preds(later).items()} and preds(df)
    gap = models.fold_rows(df, "target_rv5", embargo=5)
    assert gap.where("role = 'train'").count() < models.fold_rows(df, "target_rv5").where("role = 'train'").count()
    with pytest.raises(ValueError, match="no column"):
        models.fold_rows(df, "nothing")


def test_learners(spark, data):
    df = folded(spark, data).withColumn("realized_vol_5d", F.col("a"))
    p = models.walk_forward(df, models.Persistence(), ("realized_vol_5d",))
    assert p.where("pred is null").count() == 0
    trees = models.gbt_forecasts(df, SETS["two"], maxIter=2)
    assert trees.count() == models.walk_forward(df, models.Persistence("a"), SETS["two"]).count() and trees.where("pred is null").count() == 0
    empty = models.walk_forward(df.withColumn("a", F.when(F.col("fold") > 0, F.col("a"))), models.Linear(), ("a",)).where("fold = 1")
    assert empty.count() > 0 and empty.where("pred is not null").count() == 0


def test_percentiles_are_exact(spark, monkeypatch):
    rng = np.random.default_rng(0)
    groups = {"one": [4.0], "two": [1.0, 2.0], "ties": [1.0] * 50 + [2.0] * 3, "many": rng.normal(0, 1, 500).round(2).tolist(), "none": [None, None]}
    rows = [(k, v, "x") for k, vs in groups.items() for v in vs] + [("many", None, "x"), ("many", float("nan"), "x")]
    df = spark.createDataFrame(rows, "k string, v double, range string")
    clean = df.where("v is null or not isnan(v)")
    at = {"lo": 0.01, "q": 0.25, "m": 0.5, "hi": 0.99, "top": 1.0}
    for ranges in (64, 3):
        monkeypatch.setattr(eda, "RANGES", ranges)
        got = {r["k"]: [r[n] for n in at] for r in eda.percentiles(clean, ["k"], "v", at).collect()}
        assert got.pop("none") == [None] * 5
        for k, q in got.items():
            assert q == pytest.approx(np.quantile([v for v in groups[k] if v is not None], list(at.values())).tolist()), k
    assert eda.describe(clean.where("k = 'two'"), ["k"], "v").first()["p50"] == 1.5
    assert eda.percentiles(clean.limit(0), ["k"], "v", at).count() == 0


def test_shapes(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_t(8, 4000)
    df = spark.createDataFrame([("A", i + 1, float(v)) for i, v in enumerate(x)] + [("B", 1, 1.0), ("B", 2, 1.0)], "k string, rn int, x double")
    r = {r["k"]: r for r in eda.fitted_shapes(df, ["k"], "x").collect()}
    assert 5 < r["A"]["t_degrees"] < 20 and r["A"]["t_scale"] < r["A"]["std"] and r["B"]["t_degrees"] is None
    q = eda.quantile_pairs(df.where("k = 'A'"), ["k"], "x", 3).orderBy("p").collect()
    assert [round(z["p"], 2) for z in q] == [0.25, 0.5, 0.75] and q[0]["sample"] == pytest.approx(np.quantile(x, 0.25)) and abs(q[1]["normal"] - x.mean()) < 1e-9
    a = eda.annualised(df.where("k = 'A'"), ["k"], "x").first()
    assert a["mean_per_year"] == pytest.approx(x.mean() * 252) and a["std_per_year"] == pytest.approx(x.std(ddof=1) * 252**0.5)
    b = eda.acf_with_bands(df.where("k = 'A'"), ["k"], "x", (1,)).first()
    assert b["band"] == pytest.approx(1.96 / 4000**0.5) and b["stands_out"] == (abs(b["acf"]) > b["band"])


def test_guardrail(spark):
    m = spark.createDataFrame([("persistence", 0, 0.024), ("persistence", 1, 9.0), ("har", 0, 0.02)], "model string, fold int, mae double")
    r = ev.guardrail(m, "persistence", 0.02).collect()
    assert len(r) == 1 and r[0]["relative_error"] == pytest.approx(0.2) and r[0]["within"] is False
    assert ev.guardrail(m, "har", 0.02).first()["within"] is True
