from datetime import datetime, timedelta

import numpy as np
import pytest

from chronoloom.operators import spikes

T0 = datetime(2024, 1, 1)
SCHEMA = "bar_id bigint, ticker string, date timestamp_ntz, close double, volume double, chunk string"


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(1)
    return (100 * np.exp(np.cumsum(rng.normal(0, 0.01, 120)))).tolist(), (1e6 * np.exp(rng.normal(0, 0.2, 120))).tolist()


def found(spark, close, volume, extra=()):
    rows = [(i, "A", T0 + timedelta(days=i), c, v, "x") for i, (c, v) in enumerate(zip(close, volume, strict=True))]
    return {(r["bar_id"], r["field_name"]): r["kind"] for r in spikes.implausible(spark.createDataFrame([*rows, *extra], SCHEMA)).collect()}


def test_kinds(spark, series, monkeypatch):
    close, volume = list(series[0]), list(series[1])
    close[20] *= 3  # one bar
    close[40:43] = [c / 2 for c in close[40:43]]  # three bars
    for i in range(60, 120):
        close[i] *= 1.3  # a jump that stays
    close[80:84] = [c * 2 for c in close[80:84]]  # four bars are no spike
    close[100:106] = [close[100]] * 6
    close[110:113] = [close[110]] * 3  # too short to be stuck
    volume[5], volume[6], volume[30], volume[50] = 0.0, -4.0, volume[30] * 100, None
    want = {(20, "close"): "spike", **{(i, "close"): "spike" for i in (40, 41, 42)}, **{(i, "close"): "stuck" for i in range(101, 106)}, (5, "volume"): "impossible", (6, "volume"): "impossible", (30, "volume"): "spike"}
    copy = (500, "A", T0 + timedelta(days=20), close[20], volume[20], None)
    unkeyed = [(501, None, T0, 5.0, 5.0, None), (502, "A", None, -1.0, float("nan"), None), (None, "B", T0, 1.0, None, None)]
    want |= {(500, "close"): "spike", (502, "close"): "impossible"}
    assert found(spark, close, volume, [copy, *unkeyed]) == want
    # the same over small chunks: runs and spikes lie across their borders
    monkeypatch.setattr(spikes, "CHUNK", 20)
    assert found(spark, close, volume, [copy, *unkeyed]) == want


def test_empty_and_tiny(spark):
    assert found(spark, [], []) == {}
    assert found(spark, [1.0, 1.0], [0.0, None]) == {(0, "volume"): "impossible"}
