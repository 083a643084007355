import math
from datetime import datetime, timedelta

import numpy as np
import pytest

from chronoloom.operators import evaluate as ev

T0 = datetime(2021, 1, 4)


def numbered(spark, n, tickers=("A",)):
    return spark.createDataFrame([(t, i + 1, T0 + timedelta(days=i)) for t in tickers for i in range(n)], "ticker string, rn bigint, date timestamp_ntz")


@pytest.mark.parametrize(("n", "fraction", "folds"), [(60, 0.30, 5), (40, 0.165, 5), (1255, 0.165, 5), (7, 0.5, 3), (2, 0.5, 5)])
def test_fold_geometry(spark, n, fraction, folds):
    got = [r["fold"] for r in ev.with_fold(numbered(spark, n), folds=folds, fraction=fraction).orderBy("rn").collect()]
    split = max(1, min(n - 1, int(n * (1 - fraction))))
    parts = np.array_split(np.arange(split, n), folds)
    assert got == [0] * split + [k + 1 for k, p in enumerate(parts) for _ in p]
    with pytest.raises(ValueError, match="folds"):
        ev.with_fold(numbered(spark, 3), folds=0)


def test_train_lengths(spark, rows):
    c = ev.valid_counts(ev.with_fold(numbered(spark, 60), fraction=0.30).withColumn("y", ev.F.col("rn") * 1.0), [], "y")
    assert [r[1] for r in rows(c, "eval_fold", "train_rows")] == [42, 46, 50, 54, 57]


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([("m", 1, 0.1, 0.1, 0.01, 0.02), ("m", 1, 0.2, 0.1, -0.01, None), ("m", 2, 1.0, None, 0.0, 1.0), ("m", 2, 1.0, 3.0, 0.0, 1.0)], "model string, fold int, actual double, pred double, returns double, ret_lag_1 double")
    m = {r["fold"]: r for r in ev.metrics(df).collect()}
    assert m[1]["mae"] == pytest.approx(0.05) and m[1]["qlike"] == pytest.approx((0.25 - math.log(0.25) - 1) / 2)
    assert m[1]["directional_accuracy"] == 0.5  # an unknown lag counts as wrong
    assert m[2]["directional_accuracy"] is None and m[2]["n_test"] == 1
    assert m[0]["mae"] == pytest.approx((0.1 + 2) / 3)  # rows are pooled
    wide = ev.ablation_table(ev.metrics(df)).first()
    assert wide["fold_2_mae"] == 2.0 and wide["fold_3_mae"] is None
    d = {r["fold"]: r for r in ev.relative_to(ev.metrics(df), "m").collect()}
    assert d[1]["delta_abs"] == 0 and d[1]["delta_rel"] == 0
    assert ev.within_guardrail(1.04, 1.0) and not ev.within_guardrail(1.2, 1.0)


def test_har_recovers_coefficients_and_takes_complete_cases(spark):
    rng = np.random.default_rng(0)
    x = rng.uniform(0.1, 1, (160, 3))
    rows = [("A", i + 1, T0 + timedelta(days=i), *map(float, x[i]), None if i % 17 == 3 else float(0.5 + 2 * x[i, 0] - x[i, 1])) for i in range(160)]
    flat = [("B", i + 1, T0 + timedelta(days=i), 1.0, 1.0, 1.0, 2.0) for i in range(30)]
    df = spark.createDataFrame(rows + flat, "ticker string, rn bigint, date timestamp_ntz, rv_d double, rv_w double, rv_m double, target_rv5 double")
    got = ev.har_coefficients(ev.with_fold(df)).collect()
    for r in got:
        if r["ticker"] == "A":
            np.testing.assert_allclose([r[f"b{k}"] for k in range(4)], [0.5, 2, -1, 0], atol=1e-9)
        else:
            assert r["b1"] is None  # collinear
    assert len(got) == 10
