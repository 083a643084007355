"""Running aggregates over long series without a task per series.

A window partitioned by entity alone puts a hot entity into one task. Here a series is cut into blocks
(time slices or ranges of row numbers): each block is scanned by itself, one row per block carries the
earlier blocks' total, and the two are combined. Only the per-block rows of an entity meet in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("sum", "min", "max", "last")


def _agg(kind: str, value: Column, order: Column | None) -> Column:
    """The aggregate of one block. last: the value of the greatest order that has one."""
    if kind == "last":
        return F.max(F.when(value.isNotNull(), F.struct(order.alias("o"), value.alias("v"))))["v"]
    return getattr(F, kind)(value)


def _over(kind: str, value: Column, w: Window) -> Column:
    return (F.last(value, ignorenulls=True) if kind == "last" else getattr(F, kind)(value)).over(w)


def _combine(kind: str, carried: Column, own: Column) -> Column:
    if kind == "sum":
        return F.when(carried.isNull(), own).when(own.isNull(), carried).otherwise(carried + own)
    if kind == "min":
        return F.least(carried, own)
    if kind == "max":
        return F.greatest(carried, own)
    return F.coalesce(own, carried)


def blocked_scan(df: DataFrame, by: Sequence[str], block: str, order: Sequence[str], specs: dict[str, tuple[str, str]], upto: int = 0) -> DataFrame:
    """Add running aggregates from the series' start to the current row.

    by: entity columns (rows with a null in them are left out: they belong to no series). block: a column
    that grows with order within an entity. order: a total order, ascending. specs: output name ->
    (kind, column), kind one of sum, min, max, last; nulls are passed over; a running value is null
    before the first non-null one. upto: 0 takes the current row in, -1 stops before it. Ties in order that are not total are broken arbitrarily.
    """
    df = df.na.drop(subset=list(by))
    w_in = Window.partitionBy(*by, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, upto)
    inner = df.withColumns({f"__in_{o}": _over(k, F.col(c), w_in) for o, (k, c) in specs.items()})
    at = F.struct(*[F.col(c) for c in order])
    blocks = df.groupBy(*by, block).agg(*[_agg(k, F.col(c), at).alias(f"__b_{o}") for o, (k, c) in specs.items()])
    w_carry = Window.partitionBy(*by).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    carry = blocks.select(*by, block, *[_over(k, F.col(f"__b_{o}"), w_carry).alias(f"__c_{o}") for o, (k, _) in specs.items()])
    out = inner.join(carry, [*by, block], "left")
    return out.select(*df.columns, *[_combine(k, F.col(f"__c_{o}"), F.col(f"__in_{o}")).alias(o) for o, (k, _) in specs.items()])


def blocked_row_number(df: DataFrame, by: Sequence[str], block: str, order: Sequence[str], out: str = "rn") -> DataFrame:
    """Row numbers from 1 along the series, by two levels; see blocked_scan."""
    return blocked_scan(df.withColumn("__one", F.lit(1).cast("bigint")), by, block, order, {out: ("sum", "__one")}).drop("__one")
