import math
import statistics
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.operators import bars, features

T0 = datetime(2021, 1, 4)
SCHEMA = "ticker string, date timestamp_ntz, close double, volume double"


def frame(spark, close, volume=None, ticker="A"):
    volume = volume or [1000.0 + i for i in range(len(close))]
    return spark.createDataFrame([(ticker, T0 + timedelta(days=i), c, v) for i, (c, v) in enumerate(zip(close, volume, strict=True))], SCHEMA)


def walk(n, seed=0):
    rng = np.random.default_rng(seed)
    return (100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))).tolist(), np.exp(rng.normal(10, 0.3, n)).tolist()


def defined(close, volume):
    """Each feature of each bar from its definition, bar by bar."""
    n = len(close)
    r = [None] + [math.log(close[i] / close[i - 1]) for i in range(1, n)]

    def seen(x, i, k):
        """The known values among the k bars up to bar i."""
        return [v for v in x[max(0, i - k + 1) : i + 1] if v is not None]

    def root(i, least):
        v = seen(r, i, 5)
        return math.sqrt(sum(x * x for x in v)) if len(v) >= least else None

    def before(x, k):
        return [x[i - k] if 0 <= i - k < n else None for i in range(n)]

    def mean(x, i, k):
        v = seen(x, i, k)
        return sum(v) / k if len(v) == k else None

    up = down = None
    strength = [None] * n
    for i in range(1, n):
        move = close[i] - close[i - 1]
        gain, loss = max(move, 0.0), max(-move, 0.0)
        up, down = (gain, loss) if up is None else (up + (gain - up) / 14, down + (loss - down) / 14)
        if i >= 14:
            strength[i] = (100.0 * up / (up + down)) if up + down > 0 else 50.0
    z = [None] * n
    for i in range(20, n):
        logs = [math.log(v) for v in volume[i - 20 : i + 1]]
        z[i] = (logs[-1] - statistics.fmean(logs)) / statistics.pstdev(logs)
    rv = [root(i, 4) for i in range(n)]
    out = {"returns": r, "realized_vol_5d": rv, "rv5_strict": [root(i, 5) for i in range(n)], "rsi_14": before(strength, 1), "vol_zscore_21": before(z, 1), "target_rv5": before(rv, -5), "rv_d": before(rv, 1)}
    out["ann_vol_21"] = [statistics.stdev(v) * math.sqrt(252) if len(v := seen(r, i, 21)) == 21 else None for i in range(n)]
    out |= {f"ret_lag_{k}": before(r, k) for k in (1, 5, 21)} | {f"vol_lag_{k}": before(rv, k) for k in (5, 21)}
    out |= {f"rv_{name}": [mean(out["rv_d"], i, k) for i in range(n)] for name, k in (("w", 5), ("m", 22))}
    return {c: np.array([np.nan if v is None else v for v in x]) for c, x in out.items()}


@pytest.mark.parametrize("chunk", [4096, 50])
def test_features_match_their_definitions(spark, monkeypatch, chunk):
    monkeypatch.setattr(features, "CHUNK", chunk)
    if chunk == 50:  # the overlap must stay below a chunk's neighbours; the average then reaches 49 bars back
        monkeypatch.setattr(features, "BEHIND", 49)
    close, volume = walk(180)
    got = features.bar_features(frame(spark, close, volume)).orderBy("date").toPandas()
    want = defined(close, volume)
    for c in want:
        if chunk == 50 and c == "rsi_14":
            continue
        np.testing.assert_allclose(got[c].astype(float), want[c], rtol=1e-8, atol=1e-10, err_msg=c)
    assert [int(got[c].isna().sum()) for c in ("returns", "realized_vol_5d", "ret_lag_1", "ret_lag_21", "vol_lag_5", "vol_lag_21", "rsi_14", "vol_zscore_21")] == [1, 4, 2, 22, 9, 25, 15, 21]


def test_rsi_over_chunk_borders(spark, monkeypatch):
    monkeypatch.setattr(features, "CHUNK", 700)
    close, volume = walk(1500, 3)
    got = features.bar_features(frame(spark, close, volume)).orderBy("date").toPandas()
    np.testing.assert_allclose(got.rsi_14.astype(float), defined(close, volume)["rsi_14"], rtol=1e-9)
    assert len(got) == 1500


def test_rising_close_gives_100_and_flat_50(spark):
    up = features.bar_features(frame(spark, [float(i) for i in range(1, 41)])).agg(F.min("rsi_14"), F.max("rsi_14")).first()
    flat = features.bar_features(frame(spark, [5.0] * 40, [7.0] * 40)).agg(F.min("rsi_14"), F.max("rsi_14"), F.count("vol_zscore_21")).first()
    assert tuple(up) == (100.0, 100.0) and tuple(flat) == (50.0, 50.0, 0)


def test_the_future_changes_nothing_and_entities_are_apart(spark):
    close, volume = walk(80)
    cols = ["ticker", "date", *features.PRICE_FEATURES, "realized_vol_5d", "rv_m"]
    until = T0 + timedelta(days=50)
    take = lambda df: features.bar_features(df).where((F.col("date") <= F.lit(until)) & (F.col("ticker") == "A")).select(cols).orderBy("date").collect()
    base = frame(spark, close, volume)
    changed = base.withColumn("close", F.when(F.col("date") > F.lit(until), F.col("close") * 99).otherwise(F.col("close")))
    assert take(base) == take(changed) == take(base.unionByName(frame(spark, *walk(60, 5), ticker="B")))


def test_edges(spark):
    assert features.bar_features(frame(spark, [])).count() == 0
    df = frame(spark, [1.0, 2.0, 3.0], [0.0, None, 5.0]).unionByName(spark.createDataFrame([(None, T0, 1.0, 1.0), ("A", None, 1.0, 1.0)], SCHEMA))
    assert features.bar_features(df).count() == 3


def test_clean_bars_and_contract(spark, rows):
    schema = "bar_id bigint, ticker string, date timestamp_ntz, open double, high double, low double, close double, volume double, loaded_at timestamp_ntz"
    data = [(1, "A", T0, 1.0, 2.0, 0.5, 1.5, 9.0, T0), (2, "A", T0, 1.0, 2.0, 0.5, 1.6, 9.0, T0), (3, "A", T0, 1.0, 2.0, 0.5, 1.7, 9.0, None), (4, "A", T0 + timedelta(1), 1.0, 0.1, 0.5, -1.0, 0.0, T0), (5, None, T0, 1.0, 2.0, 0.5, 1.5, None, T0)]
    df = spark.createDataFrame(data, schema)
    assert rows(bars.clean_bars(df), "ticker", "close") == [("A", 1.6)]
    broken = {r["violation"]: r["n_rows"] for r in bars.bar_violations(df).collect()}
    assert broken == {"null_key": 1, "null_value": 1, "not_positive": 1, "high_below_low": 1, "repeated_key": 2}
    with pytest.raises(ValueError, match="null_key"):
        bars.require(bars.bar_violations(df))
    bars.require(bars.bar_violations(df.limit(0)))
