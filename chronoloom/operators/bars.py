"""Bar series: one sound bar per entity and date, contracts, and bars built from orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BAR_COLUMNS = ("open", "high", "low", "close", "volume")


def clean_bars(bars: DataFrame) -> DataFrame:
    """One bar per ticker and date with a positive close: that loaded last, then the largest bar_id.

    Bars without ticker, date or positive close are left out. Combined before the shuffle.
    """
    sound = bars.where("ticker is not null and date is not null and close > 0 and not isnan(close)")
    best = F.max(F.struct("loaded_at", "bar_id", *BAR_COLUMNS)).alias("b")
    return sound.groupBy("ticker", "date").agg(best).select("ticker", "date", *[f"b.{c}" for c in BAR_COLUMNS])


def order_bars(orders: DataFrame) -> DataFrame:
    """Daily open, high, low, close and volume from single trades (orders), in the order of their keys."""
    day = F.to_date("o_orderdate").alias("day")
    return orders.where("o_orderdate is not null").groupBy("o_orderpriority", day).agg(
        F.min_by("o_totalprice", "o_orderkey").alias("open"), F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"),
        F.max_by("o_totalprice", "o_orderkey").alias("close"), F.count(F.lit(1)).cast("double").alias("volume"),
    )


def bar_violations(bars: DataFrame) -> DataFrame:
    """(violation, n_rows) of the raw bar contract, found in one pass; no row means that the contract holds."""
    checks = {
        "null_key": "ticker IS NULL OR date IS NULL",
        "null_value": "open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL OR volume IS NULL",
        "not_positive": "close <= 0 OR volume <= 0",
        "high_below_low": "high < low",
    }
    counts = bars.agg(*[F.count_if(F.expr(c)).alias(n) for n, c in checks.items()])
    repeated = bars.groupBy("ticker", "date").agg((F.count(F.lit(1)) - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("repeated_key"))
    rows = counts.unpivot([], list(checks), "violation", "n_rows").unionByName(repeated.unpivot([], ["repeated_key"], "violation", "n_rows"))
    return rows.where("n_rows > 0")


def require(violations: DataFrame) -> None:
    """Raise if a contract is broken. Reads one row per kind of violation."""
    found = {r["violation"]: r["n_rows"] for r in violations.collect()}
    if found:
        raise ValueError(f"contract broken: {found}")
