"""As-of joins without pairs: one union, one running 'last' per entity, in blocks of time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.operators.blocks import blocked_scan
from chronoloom.operators.validity import DAY_US, micros

BLOCK_DAYS = 64


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_on: str, right_on: str, *, strict: bool = False, forward: bool = False, precedence: Sequence[str] = (), out: str = "match") -> DataFrame:
    """The left rows, each with `out`: a struct of the right row nearest before (or after) it in time.

    strict: a right row of the same time does not count. forward: the nearest after. Of right rows of the
    same time the greatest by precedence counts (with forward as well). All left rows and columns
    stay; `out` is null where there is no match and for rows without entity or time. `out` has all the
    right's columns, so names cannot clash. Nulls in the right row's other columns are carried as they are.
    """
    sign = -1 if forward else 1
    value = F.struct(*[F.col(c) for c in right.columns])
    l_side, r_side = (0, 1) if strict else (1, 0)
    lefts = left.select(F.struct(*left.columns).alias("__row"), *by, (micros(F.col(left_on)) * sign).alias("__t"))
    rights = right.na.drop(subset=[*by, right_on]).select(value.alias("__v"), *by, (micros(F.col(right_on)) * sign).alias("__t"), *[F.col(p).alias(f"__p{i}") for i, p in enumerate(precedence)])
    rights = rights.withColumn("__side", F.lit(r_side))
    whole = lefts.na.drop(subset=[*by, "__t"]).withColumn("__side", F.lit(l_side))
    both = whole.unionByName(rights, allowMissingColumns=True).withColumn("__block", F.floor(F.col("__t") / (BLOCK_DAYS * DAY_US)))
    run = blocked_scan(both, by, "__block", ["__t", "__side", *[f"__p{i}" for i in range(len(precedence))]], {out: ("last", "__v")}).where("__row is not null")
    lost = lefts.where(" OR ".join(f"`{c}` IS NULL" for c in [*by, "__t"])).select("__row", F.lit(None).cast(both.schema["__v"].dataType).alias(out))
    return run.select("__row", out).unionByName(lost).select("__row.*", out)


def asof_nearest(left: DataFrame, right: DataFrame, by: Sequence[str], left_on: str, right_on: str, *, out: str = "match") -> DataFrame:
    """The left rows with the right row nearest in time on either side; at equal distance the earlier one."""
    there = asof_join(left, right, by, left_on, right_on, out="__b")
    there = asof_join(there, right, by, left_on, right_on, forward=True, out="__f")
    t = micros(F.col(left_on))
    db, df_ = t - micros(F.col(f"__b.{right_on}")), micros(F.col(f"__f.{right_on}")) - t
    return there.withColumn(out, F.when(F.col("__f").isNull() | (db <= df_), F.col("__b")).otherwise(F.col("__f"))).drop("__b", "__f")
