"""Descriptive statistics of series, as aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.operators.blocks import blocked_scan


def moments(df: DataFrame, by: Sequence[str], x: str) -> DataFrame:
    """n, mean, std (sample), biased skewness and excess kurtosis, and the Jarque-Bera
    statistic with its p-value (chi-square, 2 degrees of freedom). Nulls are passed over."""
    g = df.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.skewness(x).alias("skew"), F.kurtosis(x).alias("kurt"))
    jb = F.col("n") / 6 * (F.col("skew") ** 2 + F.col("kurt") ** 2 / 4)
    return g.withColumn("jarque_bera", jb).withColumn("p_value", F.exp(-F.col("jarque_bera") / 2))


#: A group's distinct values are ranked in so many ranges.
RANGES = 64


def percentiles(df: DataFrame, by: Sequence[str], x: str, at: dict[str, float]) -> DataFrame:
    """(by, name..): exact percentiles of each group, linear between neighbours; null for a group without values.

    Equal values are counted first (combined before the shuffle), distinct ones are ranked by running sums within ranges of values:
    neither a large group nor a frequent value has to fit into one task.
    """
    keys = [f"__k{i}" for i in range(len(by))]
    given = df.select(*[F.col(c).alias(k) for k, c in zip(keys, by, strict=True)], F.col(x).cast("double").alias("x"))
    every = given.groupBy(*keys).agg(F.count("x").alias("n"))
    values = given.where("x is not null and not isnan(x)").na.drop(subset=keys).groupBy(*keys, "x").agg(F.count(F.lit(1)).alias("times"))
    ends = values.groupBy(*keys).agg(F.percentile_approx("x", [i / RANGES for i in range(1, RANGES)], 1000).alias("ends"))
    ranged = values.join(ends, keys).withColumn("range", F.size(F.filter("ends", lambda e: e < F.col("x")))).drop("ends")
    run = blocked_scan(ranged, keys, "range", ["x"], {"upto": ("sum", "times")}).join(every, keys)
    reached = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("x")))
    found = []
    for i, p in enumerate(at.values()):
        rank = (F.col("n") - 1) * F.lit(p)
        found += [reached(F.floor(rank)).alias(f"lo{i}"), reached(F.least(F.floor(rank) + 1, F.col("n") - 1)).alias(f"hi{i}")]
    out = every.join(run.groupBy(*keys).agg(*found), keys, "left")
    share = [(F.col("n") - 1) * F.lit(p) - F.floor((F.col("n") - 1) * F.lit(p)) for p in at.values()]
    return out.select(*[F.col(k).alias(c) for k, c in zip(keys, by, strict=True)], *[(F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * f).alias(n) for i, (n, f) in enumerate(zip(at, share, strict=True))])


def describe(df: DataFrame, by: Sequence[str], x: str) -> DataFrame:
    """count, mean, std, min, quartiles, 1 % and 99 % (linear interpolation) and max of each group."""
    plain = df.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
    return plain.join(percentiles(df, by, x, {"p01": 0.01, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p99": 0.99}), list(by))


def autocorrelation(df: DataFrame, by: Sequence[str], x: str, lags: Sequence[int]) -> DataFrame:
    """(by, lag, acf): correlation of x with itself `lag` rows before; pairs with a null are left out.

    df has rn, the row's number in its series: the pairs are an equi-join on it, so no window is needed.
    """
    rows = df.where(F.col(x).isNotNull()).select(*by, "rn", F.col(x).alias("x"))
    before = rows.select(*by, "rn", F.col("x").alias("y"), F.explode(F.array(*[F.lit(k) for k in lags])).alias("lag")).withColumn("rn", F.col("rn") + F.col("lag"))
    return rows.join(before, [*by, "rn"]).groupBy(*by, "lag").agg(F.corr("x", "y").alias("acf"))


def simple_ols(df: DataFrame, by: Sequence[str], y: str, x: str) -> DataFrame:
    """(by, n, slope, intercept, r) of y on x over the pairs without a null."""
    return df.groupBy(*by).agg(F.regr_count(y, x).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(y, x).alias("r"))


def skill(df: DataFrame, by: Sequence[str], actual: str, naive: str) -> DataFrame:
    """Errors of a naive forecast against those of the mean: naive_mae, naive_rmse, mean_mae, skill."""
    mean = df.groupBy(*by).agg(F.avg(actual).alias("__m"))
    e = F.col(actual) - F.col(naive)
    out = df.join(mean, list(by)).groupBy(*by).agg(F.avg(F.abs(e)).alias("naive_mae"), F.sqrt(F.avg(e * e)).alias("naive_rmse"), F.avg(F.abs(F.col(actual) - F.col("__m"))).alias("mean_mae"))
    return out.withColumn("skill", 1 - F.try_divide("naive_mae", "mean_mae"))


def histogram(df: DataFrame, by: Sequence[str], x: str, lo: float, hi: float, bins: int) -> DataFrame:
    """(by, bin, n): equal bins 1..bins between lo and hi; 0 and bins + 1 hold what lies outside."""
    return df.where(F.col(x).isNotNull()).groupBy(*by, F.width_bucket(x, F.lit(lo), F.lit(hi), F.lit(bins)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def regime_means(df: DataFrame, by: Sequence[str], time: str, x: str, regimes: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(by, regime, n, mean): x over named date ranges, both ends included; the first that holds a date wins."""
    name = F.lit(None).cast("string")
    for n, lo, hi in reversed(regimes):
        name = F.when(F.to_date(time).between(lo, hi), n).otherwise(name)
    return df.withColumn("regime", name).where("regime is not null").groupBy(*by, "regime").agg(F.count(x).alias("n"), F.avg(x).alias("mean"))


def calendar_gaps(df: DataFrame, by: Sequence[str], time: str) -> DataFrame:
    """(by, day): weekdays between an entity's first and last day without a row."""
    days = df.select(*by, F.to_date(time).alias("day")).na.drop().distinct()
    span = days.groupBy(*by).agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    every = span.select(*by, F.explode(F.sequence("lo", "hi")).alias("day")).where(F.weekday("day") < 5)
    return every.join(days, [*by, "day"], "left_anti")


def total_return(df: DataFrame, by: Sequence[str], time: str, price: str) -> DataFrame:
    """(by, total_return): last price over first, less one."""
    return df.groupBy(*by).agg((F.max_by(price, time) / F.min_by(price, time) - 1).alias("total_return"))


def annualised(df: DataFrame, by: Sequence[str], returns: str, per_year: int = 252) -> DataFrame:
    """(by, n, mean_per_year, std_per_year): the mean return times, and its deviation times the root of, the periods in a year."""
    return df.groupBy(*by).agg(F.count(returns).alias("n"), (F.avg(returns) * per_year).alias("mean_per_year"), (F.stddev_samp(returns) * F.sqrt(F.lit(float(per_year)))).alias("std_per_year"))


def acf_with_bands(df: DataFrame, by: Sequence[str], x: str, lags: Sequence[int], z: float = 1.96) -> DataFrame:
    """autocorrelation() with the band (z over the root of the number of values) outside of which it stands out."""
    n = df.groupBy(*by).agg(F.count(x).alias("n"))
    band = F.try_divide(F.lit(z), F.sqrt(F.col("n")))
    return autocorrelation(df, by, x, lags).join(n, list(by)).select(*by, "lag", "acf", band.alias("band"), (F.abs("acf") > band).alias("stands_out"))


def fitted_shapes(df: DataFrame, by: Sequence[str], x: str) -> DataFrame:
    """(by, n, mean, std, t_degrees, t_scale): the normal distribution and Student's t with the same variance and excess kurtosis.

    By moments: degrees 4 + 6 / excess kurtosis; where that is not positive (no heavier than normal) degrees and scale are null.
    """
    m = moments(df, by, x)
    degrees = F.when(F.col("kurt") > 0, 4 + 6 / F.col("kurt"))
    return m.select(*by, "n", "mean", "std", degrees.alias("t_degrees"), (F.col("std") * F.sqrt((degrees - 2) / degrees)).alias("t_scale"))


def quantile_pairs(df: DataFrame, by: Sequence[str], x: str, points: int = 19) -> DataFrame:
    """(by, p, sample, normal): quantiles of each group beside those of a normal distribution of its mean and deviation, at equal steps of p."""
    from statistics import NormalDist

    at = {f"q{i}": i / (points + 1) for i in range(1, points + 1)}
    shape = df.groupBy(*by).agg(F.avg(x).alias("__m"), F.stddev_samp(x).alias("__s"))
    both = percentiles(df, by, x, at).join(shape, list(by))
    rows = F.array(*[F.struct(F.lit(p).alias("p"), F.col(n).alias("sample"), (F.col("__m") + F.col("__s") * F.lit(NormalDist().inv_cdf(p))).alias("normal")) for n, p in at.items()])
    return both.select(*by, F.inline(rows))


def day_windows(lo: str, hi: str) -> str:
    """SQL of the UTC days from lo to hi with their first and last second; raises if hi is before lo."""
    if hi < lo:
        raise ValueError("the last day lies before the first")
    return f"SELECT d AS day, CAST(d AS TIMESTAMP_NTZ) AS day_start, CAST(d AS TIMESTAMP_NTZ) + INTERVAL 1 DAY - INTERVAL 1 SECOND AS day_end FROM (SELECT explode(sequence(DATE'{lo}', DATE'{hi}')) AS d)"
