"""Lagged, rolling and exponentially weighted features of bar series.

Series are numbered by blocked scans and cut into chunks with an overlap behind and ahead that covers every
frame, so all features share one exchange and no entity has to fit into one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.operators.blocks import blocked_row_number

CHUNK, BEHIND, AHEAD = 4096, 640, 32
PRICE_FEATURES = ("ret_lag_1", "ret_lag_5", "ret_lag_21", "vol_lag_5", "vol_lag_21", "rsi_14", "vol_zscore_21")
ALPHA = 1 / 14


def framed(df: DataFrame, by: Sequence[str], time: str) -> tuple[DataFrame, Window]:
    """Rows with rn (number in the series, from 1), chunk and core, and a window spec for bounded frames.

    After the features are computed over the window, keep the rows with core; frames may reach BEHIND rows
    back and AHEAD rows on. Rows with a null entity or time are left out.
    """
    df = blocked_row_number(df.na.drop(subset=[*by, time]).withColumn("__block", F.floor(F.unix_date(F.col(time).cast("date")) / 64)), by, "__block", [time]).drop("__block")
    at = lambda k: F.floor((F.col("rn") - 1 + k) / CHUNK)
    df = df.withColumn("chunk", F.explode(F.array_distinct(F.array(at(0), at(BEHIND), at(-AHEAD))))).withColumn("core", F.col("chunk") == at(0))
    return df, Window.partitionBy(*by, "chunk").orderBy(time)


def full(agg: Column, count_of: str, w: Window, least: int) -> Column:
    """A rolling value where its frame has at least so many non-null observations."""
    return F.when(F.count(count_of).over(w) >= least, agg)


def _wilder(df: DataFrame, w: Window) -> DataFrame:
    """Add rsi: Wilder's index over 14 bars, not lagged.

    The exponential averages are running sums in closed form over the chunk; what lies before its overlap
    of 640 bars would weigh less than 1e-20.
    """
    q = 1 - ALPHA
    seen = w.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("move", F.col("close") - F.lag("close").over(w)).withColumn("k", F.count("move").over(seen) - 1)
    for name, size in (("gain", F.greatest(F.col("move"), F.lit(0.0))), ("loss", F.greatest(-F.col("move"), F.lit(0.0)))):
        weighed = F.when(F.col("move").isNotNull(), size * F.when(F.col("k") == 0, 1.0).otherwise(ALPHA) * F.pow(F.lit(q), -F.col("k")))
        df = df.withColumn(name, F.sum(weighed).over(seen) * F.pow(F.lit(q), F.col("k")))
    rs = F.when(F.col("loss") == 0, F.when(F.col("gain") == 0, 50.0).otherwise(100.0)).otherwise(100 - 100 / (1 + F.try_divide("gain", "loss")))
    return df.withColumn("rsi", F.when(F.col("rn") >= 15, rs)).drop("move", "k", "gain", "loss")


def bar_features(bars: DataFrame, by: Sequence[str] = ("ticker",), time: str = "date") -> DataFrame:
    """Bars with returns, realised volatility, price features, the regressors of HAR and the target.

    bars: unique by entity and time, with a positive close; volume may be null or not positive. Warm-up values are null.
    returns: log return. realized_vol_5d: root of the sum of squares over 5 bars, from 4 on; rv5_strict: from 5
    on. ret_lag_*, vol_lag_*: lags. rsi_14, vol_zscore_21 (of log volume): lagged by one bar. ann_vol_21:
    annualised deviation over 21 bars. rv_d, rv_w, rv_m: last value and means over 5 and 22 bars before.
    target_rv5: realized_vol_5d five bars on. rn: the bar's number.
    """
    df, w = framed(bars, by, time)
    back = lambda n: w.rowsBetween(1 - n, 0)
    df = df.withColumns({"returns": F.log("close") - F.lag(F.log("close")).over(w), "log_volume": F.when(F.col("volume") > 0, F.log("volume"))})
    df = _wilder(df, w)
    squares = F.sum(F.col("returns") * F.col("returns")).over(back(5))
    spread = F.stddev_pop("log_volume").over(back(21))
    df = df.withColumns({
        "realized_vol_5d": full(F.sqrt(squares), "returns", back(5), 4),
        "rv5_strict": full(F.sqrt(squares), "returns", back(5), 5),
        "ann_vol_21": full(F.stddev_samp("returns").over(back(21)), "returns", back(21), 21) * F.sqrt(F.lit(252.0)),
        "zscore": full((F.col("log_volume") - F.avg("log_volume").over(back(21))) / F.when(spread > 1e-12, spread), "log_volume", back(21), 21),
    })
    df = df.withColumns({f"ret_lag_{k}": F.lag("returns", k).over(w) for k in (1, 5, 21)} | {f"vol_lag_{k}": F.lag("realized_vol_5d", k).over(w) for k in (5, 21)} | {
        "rsi_14": F.lag("rsi").over(w), "vol_zscore_21": F.lag("zscore").over(w), "rv_d": F.lag("realized_vol_5d").over(w), "target_rv5": F.lead("realized_vol_5d", 5).over(w),
    })
    df = df.withColumns({f"rv_{n}": full(F.avg("rv_d").over(back(k)), "rv_d", back(k), k) for n, k in (("w", 5), ("m", 22))})
    return df.where("core").drop("core", "chunk", "rsi", "zscore", "log_volume")
