"""Readings that cannot be right: spikes, stuck values and impossible ones, by each source's own habit.

An undecimated wavelet decomposition along each source's log readings. Level 0 is the Haar detail, the step from bar
to bar. Level w (1, 2, 3) is the symmetric detail of width w: the mean of w bars less that of the two bars beside them; it is
blind to a level that stays and to a slope, and largest where w bars stand out and come back. Each level has its own
robust scale per source (1.4826 times the median size of its details that are not zero). A spike of w bars is a detail of level w
above DETAIL scales of its level, all of whose steps in and out are above STEP scales of level 0. Runs of zero details
are stuck readings; bounds catch the impossible ones.

Series are numbered in blocks and cut into chunks of rows with an overlap on both sides, so that no
source has to fit into one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.session import cut

BLOCK_DAYS, CHUNK, OVERLAP = 512, 1024, 16
#: Levels of symmetric details: the widths of spikes, in bars.
WIDTHS = (1, 2, 3)
#: How many robust scales of its level a detail, and of level 0 a spike's steps, must exceed.
DETAIL, STEP = 8.0, 7.5
#: Bars on each side whose median is the level that a spike comes back to.
SIDE = 7
#: A stuck run has at least so many bars.
STUCK = 5


@dataclass(frozen=True)
class Reading:
    """field: a column. least: the least detail in logs that counts, whatever the scale, for readings whose
    ordinary busy days are far from quiet ones (2.0: by a factor of seven)."""

    field: str
    least: float = 0.0


READINGS = (Reading("close"), Reading("volume", least=2.0))


def _series(bars: DataFrame, by: str, time: str, readings: tuple[Reading, ...]) -> DataFrame:
    """(by, time, field, v, rn, rp): the positive readings, one per source, field and time; rn numbers all times of a
    source from 1, rp the positive readings of a field."""
    fields = range(len(readings))
    largest = [F.max(F.when((F.col(r.field) > 0) & ~F.isnan(r.field), F.col(r.field)).cast("double")).alias(f"v{i}") for i, r in enumerate(readings)]
    once = bars.na.drop(subset=[by, time]).select(F.col(by).alias("by"), F.col(time).alias("time"), *[r.field for r in readings]).groupBy("by", "time").agg(*largest)
    # the filters that the join below would add to one side only are given here, and both sides use all columns, so that they share one exchange
    once = once.withColumn("block", F.floor(F.unix_date(F.col("time").cast("date")) / BLOCK_DAYS)).where("by is not null and block is not null")
    w = Window.partitionBy("by", "block").orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    inner = once.withColumns({"rn": F.count(F.lit(1)).over(w)} | {f"rp{i}": F.count(f"v{i}").over(w) for i in fields})
    counts = ["rn", *[f"rp{i}" for i in fields]]
    # a block's counts are its last row's, which come out of the same exchange; a row per block carries the earlier ones' on
    w_carry = Window.partitionBy("by").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carry = inner.groupBy("by", "block").agg(*[F.max(c).alias(f"b_{c}") for c in counts])
    carry = carry.select("by", "block", *[F.coalesce(F.sum(f"b_{c}").over(w_carry), F.lit(0)).alias(f"c_{c}") for c in counts])
    rows = inner.join(carry, ["by", "block"])
    each = F.array(*[F.struct(F.lit(i).alias("field"), F.col(f"v{i}").alias("v"), (F.col(f"rp{i}") + F.col(f"c_rp{i}")).alias("rp")) for i in fields])
    return rows.select("by", "time", (F.col("rn") + F.col("c_rn")).alias("rn"), F.inline(each)).where("v > 0")


def details(series: DataFrame) -> DataFrame:
    """(by, time, field, v, rp, h, d1.., m1.., stuck) of each positive reading.

    h: the detail of level 0. d<w>: the size of the detail of level w whose w bars begin here. m<w>: the least of their steps in and
    out, if all lie on one side of both bars beside them and these are less than half as far from each other; else null.
    stuck: the reading is part of a run of STUCK or more equal ones on bars in a row, and not its first.
    """
    n = F.col("rp")
    at = lambda k: F.floor((n + k) / CHUNK)
    df = series.withColumn("chunk", F.explode(F.array_distinct(F.array(at(0), at(OVERLAP), at(-OVERLAP))))).withColumn("core", F.col("chunk") == at(0)).withColumn("x", F.log("v"))
    w = Window.partitionBy("by", "field", "chunk").orderBy("rp")
    df = df.withColumns({"x_-1": F.lag("x").over(w), "rn_before": F.lag("rn").over(w)} | {f"x_{k}": F.lead("x", k).over(w) for k in range(1, max(WIDTHS) + 1)})
    x = lambda k: F.col(f"x_{k}" if k else "x")
    df = df.withColumn("h", x(0) - x(-1)).withColumn("same", F.when((F.col("h") == 0) & (F.col("rn") == F.col("rn_before") + 1), 1).otherwise(0))
    df = df.withColumn("full", F.sum("same").over(w.rowsBetween(0, STUCK - 2)))
    df = df.withColumn("stuck", (F.col("same") == 1) & (F.max("full").over(w.rowsBetween(2 - STUCK, 0)) == STUCK - 1)).where("core")
    out = {}
    for k in WIDTHS:
        left, right, inside = x(-1), x(k), [x(i) for i in range(k)]
        detail = sum(inside[1:], inside[0]) / k - (left + right) / 2
        out[f"d{k}"] = F.abs(detail)
        ways = F.signum(detail)
        least = F.least(*[(c - beside) * ways for c in inside for beside in (left, right)])
        shaped = (least > 0) & (F.abs(right - left) < 0.5 * F.least(*[F.abs(c - left) for c in inside], F.lit(float("inf"))))
        out[f"m{k}"] = F.when(left.isNotNull() & right.isNotNull() & shaped, least)
    return df.select("by", "time", "field", "v", "rp", "h", "stuck", *[c.alias(name) for name, c in out.items()])


def _spikes(found: DataFrame, readings: tuple[Reading, ...]) -> DataFrame:
    """(by, field, time, v) of the bars of spikes."""
    middle = lambda c: (1.4826 * F.percentile_approx(F.when(F.col(c) != 0, F.abs(c)), F.lit(0.5), F.lit(1_000)))
    scales = found.groupBy("by", "field").agg(middle("h").alias("s0"), *[middle(f"d{k}").alias(f"s{k}") for k in WIDTHS])
    least: Column = F.lit(0.0)
    for i, r in enumerate(readings):
        least = F.when(F.col("field") == i, F.lit(r.least)).otherwise(least)
    peaks = found.where(" or ".join(f"m{k} is not null" for k in WIDTHS)).join(scales, ["by", "field"])
    stands = {k: (F.col(f"d{k}") >= F.greatest(DETAIL * F.col(f"s{k}"), least)) & (F.col(f"m{k}") >= STEP * F.col("s0")) for k in WIDTHS}
    peaks = peaks.select("by", "field", F.col("rp").alias("first"), F.explode(F.array_compact(F.array(*[F.when(stands[k], k) for k in WIDTHS]))).alias("width"))
    # a quiet stretch between two spikes looks like a spike the other way: what holds is the one that leaves the level around it, the
    # median of the bars beside. Only the few bars around a peak are fetched
    near = peaks.withColumn("rp", F.explode(F.sequence(F.col("first") - SIDE, F.col("first") + F.col("width") + SIDE - 1)))
    near = near.join(found.select("by", "field", "rp", "time", "v"), ["by", "field", "rp"]).withColumn("inside", F.col("rp").between(F.col("first"), F.col("first") + F.col("width") - 1))
    beside = (F.col("rp") == F.col("first") - 1) | (F.col("rp") == F.col("first") + F.col("width"))
    x = F.log("v")
    whole = near.groupBy("by", "field", "first", "width").agg(
        F.median(F.when(~F.col("inside"), x)).alias("around"), F.avg(F.when(F.col("inside"), x)).alias("mean"), F.avg(F.when(beside, x)).alias("beside"),
        F.collect_list(F.when(F.col("inside"), F.struct("time", "v"))).alias("bars"),  # as many as the spike is wide
    )
    held = whole.where((F.col("mean") - F.col("around")) * F.signum(F.col("mean") - F.col("beside")) >= 0.5 * F.abs(F.col("mean") - F.col("beside")))
    return held.select("by", "field", F.inline("bars"))


def implausible(bars: DataFrame, by: str = "ticker", time: str = "date", key: str = "bar_id", readings: tuple[Reading, ...] = READINGS) -> DataFrame:
    """(key, field_name, kind): each reading that cannot be right; kind is impossible, stuck or spike.

    impossible: zero or negative. spike: leaves the source's usual range for one to three bars and comes
    back. stuck: in a run of five or more bars of one value, but not its first. Copied bars (same source
    and time) count once in a series and are reported each, if they carry the reading; of differing ones
    the largest value stands for the series. Nulls and NaN are no readings: spikes are sought across them,
    runs end at them. Bars without source or time are only held against the bounds. A source whose median
    detail is unknown has no habit to leave. Medians are approximate, to a rank error of 1 in 1,000.
    """
    named = F.array(*[F.struct(F.lit(i).alias("field"), F.lit(r.field).alias("field_name"), F.col(r.field).cast("double").alias("v")) for i, r in enumerate(readings)])
    rows = bars.select(F.col(key).alias("key"), F.col(by).alias("by"), F.col(time).alias("time"), F.inline(named)).where("v is not null and not isnan(v)")
    impossible = rows.where("v <= 0").select("key", "field_name", F.lit("impossible").alias("kind"))
    # a table, as it is read for the scales, for the spikes and for the bars around them
    found = cut(details(_series(bars, by, time, readings)), "details")
    spikes = _spikes(found, readings).withColumn("kind", F.lit("spike"))
    odd = spikes.unionByName(found.where("stuck").select("by", "field", "time", "v", F.lit("stuck").alias("kind"))).groupBy("by", "field", "time", "v").agg(F.min("kind").alias("kind"))
    # of differing copies only those that carry the series' reading
    carried = rows.where("v > 0").join(odd, ["by", "field", "time", "v"]).select("key", "field_name", "kind")
    return impossible.unionByName(carried).groupBy(F.col("key").alias(key), "field_name").agg(F.min("kind").alias("kind"))
