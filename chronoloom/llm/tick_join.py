"""Nearest match in time within a tolerance, by tick expansion.

Time is cut into ticks. A right record is told to every tick within the tolerance of its own; per entity
and tick only the nearest one before, the nearest one after, and the first and last one inside are kept. A left record
then equi-joins its tick. Ticks are coarser than times, so where a tick holds more than two right records, those
inside it are compared by exact time in a pass of their own; what is kept of the other ticks is exact already, as it
lies wholly before or after.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.operators.validity import micros

HOUR_US = 3_600_000_000
#: An entity's tick with at least so many left rows is hot: there are at most left rows / HOT_ROWS of those.
HOT_ROWS = 200_000
#: A hot tick's left rows are shared out among so many tasks, each with all right times of that tick.
PARTS = 32


def _sided(df: DataFrame, by: Sequence[str], befores: Column, afters: Column, before: str, after: str) -> DataFrame:
    """Per entity and tick the latest time (with its id) of `befores` rows and the earliest of `afters` rows; plain numbers, so that it is hashed."""
    b, a = F.when(befores, F.col(before)), F.when(afters, F.col(after))
    return df.groupBy(*by, "tick").agg(
        F.max(b).alias("bt"), F.max_by(f"{before}_id", b).alias("bi"), F.min(a).alias("at"), F.min_by(f"{after}_id", a).alias("ai"),
        F.max(F.when(F.col("k") == 0, F.col("first"))).alias("ft"), F.max(F.when(F.col("k") == 0, F.col("first_id"))).alias("fi"),
        F.max(F.when(F.col("k") == 0, F.col("last"))).alias("lt"), F.max(F.when(F.col("k") == 0, F.col("last_id"))).alias("li"),
    )


def nearest_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, left_id: str, right_time: str, right_id: str, tolerance_us: int, tick_us: int | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """(keep, left_id, right_id, distance_us): for each left row the nearest right row of the same entity.

    At most tolerance_us away, both ends included; at equal distance the earlier, then the smaller id.
    Rows with a null entity, time or id match nothing; left rows without a match give no row; ids should be
    unique (with `keep`, columns of the left, unique together with them). tick_us: the tolerance, or what is
    given. Per (entity, tick) only the first and last right time are expanded, so a hot tick costs no more than a quiet one.
    """
    tick_us = tick_us or max(1, tolerance_us)
    reach = -(-tolerance_us // tick_us)
    tick = F.floor(F.col("t") / tick_us)
    names, kept = list(by), list(keep)
    # the caller's names could clash with those in here
    by, keep = [f"__by{i}" for i in range(len(names))], [f"__keep{i}" for i in range(len(kept))]
    own = lambda df: [F.col(c).alias(b) for b, c in zip(by, names, strict=True) if c in df.columns]
    lefts = left.select(*own(left), *[F.col(c).alias(k) for k, c in zip(keep, kept, strict=True)], micros(F.col(left_time)).alias("t"), F.col(left_id).alias("left_id")).na.drop(subset=[*by, "t", "left_id"]).withColumn("tick", tick)
    # one row per entity and time: the smallest id
    rights = right.select(*own(right), micros(F.col(right_time)).alias("t"), F.col(right_id).alias("right_id")).na.drop(subset=[*by, "t", "right_id"])
    rights = rights.groupBy(*by, "t").agg(F.min("right_id").alias("right_id")).withColumn("tick", tick)
    ends = rights.groupBy(*by, "tick").agg(F.min("t").alias("first"), F.min_by("right_id", "t").alias("first_id"), F.max("t").alias("last"), F.max_by("right_id", "t").alias("last_id"), F.count(F.lit(1)).alias("n"))
    told = ends.select(*by, "tick", "first", "first_id", "last", "last_id", F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("k")).withColumn("tick", F.col("tick") + F.col("k"))
    nearest = _sided(told, by, F.col("k") > 0, F.col("k") < 0, "last", "first")
    met = lefts.join(nearest, [*by, "tick"])
    sides = [F.struct(F.col(f"{x}t").alias("rt"), F.col(f"{x}i").alias("right_id")) for x in "bafl"]
    outside = met.select(*keep, "left_id", "t", F.explode(F.array(*sides)).alias("r"))
    inside = _inside(lefts, rights, ends.where("n > 2").select(*by, "tick"), by, keep)

    near = outside.unionByName(inside).select(*keep, "left_id", "t", "r.rt", "r.right_id").where("right_id is not null").withColumn("distance_us", F.abs(F.col("rt") - F.col("t")))
    # of equal distances the earlier one: twice the distance, and one more for the later side
    rank = F.col("distance_us") * 2 + (F.col("rt") > F.col("t")).cast("int")
    best = near.where(F.col("distance_us") <= tolerance_us).groupBy(*keep, "left_id").agg(F.min(rank).alias("m"), F.min_by("right_id", rank).alias("right_id"))
    return best.select(*[F.col(k).alias(c) for k, c in zip(keep, kept, strict=True)], "left_id", "right_id", F.floor(F.col("m") / 2).alias("distance_us"))


def _inside(lefts: DataFrame, rights: DataFrame, dense: DataFrame, by: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """(keep, left_id, t, r): in ticks with several right records, the ones before and after each left one within the tick."""
    lefts, rights = lefts.join(dense, [*by, "tick"], "left_semi"), rights.join(dense, [*by, "tick"], "left_semi")
    hot = lefts.groupBy(*by, "tick").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= HOT_ROWS).select(*by, "tick", F.lit(True).alias("hot"))
    lefts = lefts.join(hot, [*by, "tick"], "left").withColumn("part", F.when(F.col("hot"), F.pmod(F.xxhash64("left_id"), F.lit(PARTS))).otherwise(0).cast("int"))
    parts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0)))
    rights = rights.join(hot, [*by, "tick"], "left").withColumn("part", F.explode(parts))
    both = lefts.select(*by, *keep, "tick", "part", "t", "left_id").unionByName(rights.select(*by, "tick", "part", "t", "right_id"), allowMissingColumns=True)
    w = Window.partitionBy(*by, "tick", "part")
    hit = F.when(F.col("right_id").isNotNull(), F.struct(F.col("t").alias("rt"), "right_id"))
    up, down = w.orderBy("t", F.col("right_id").isNull()).rowsBetween(Window.unboundedPreceding, 0), w.orderBy(F.desc("t"), F.col("right_id").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumns({"p": F.last(hit, ignorenulls=True).over(up), "n": F.last(hit, ignorenulls=True).over(down)}).where("left_id is not null")
    return inside.select(*keep, "left_id", "t", F.explode(F.array("p", "n")).alias("r"))


def pairings(calls: DataFrame, bars: DataFrame, news: DataFrame, tolerance_us: int = 36 * HOUR_US) -> DataFrame:
    """(pairing, left_id, right_id, distance_us) of calls with bars, calls with news and news with bars.

    The two that look for bars are looked up together, so that bars are expanded once.
    """
    side = lambda df, time, key, name: df.select("ticker", F.col(time).alias("time"), F.col(key).alias("key"), F.lit(name).alias("pairing"))
    to_bars = side(calls, "call_date", "call_id", "call_bar").unionByName(side(news, "as_of", "news_id", "news_bar"))
    one = nearest_join(to_bars, bars, ["ticker"], "time", "key", "date", "bar_id", tolerance_us, keep=["pairing"])
    two = nearest_join(side(calls, "call_date", "call_id", "call_news"), news, ["ticker"], "time", "key", "as_of", "news_id", tolerance_us, keep=["pairing"])
    return one.unionByName(two)
