"""Totals over trailing calendar periods, by event-contribution deltas.

Each day's amount is added on its day and taken off again when it leaves the period; the running sum of
these deltas along the calendar is the total. Amounts are summed exactly (whole numbers as such, others as
decimals), so that a total is exactly zero again once all amounts have left.

A series is cut into blocks of days. An amount whose period reaches into the next block is told to that one too, and
added there on its first day: what a block needs of its past lies within one period before it, so each block is
summed by itself and no total is carried from block to block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

#: Days of a block, or the longest period where that is more.
BLOCK_DAYS = 256
EXACT = "decimal(38,18)"


def day_number(time: Column) -> Column:
    """Days since 1970 of a timestamp or date."""
    return F.unix_date(time.cast("date"))


def trailing_totals(rows: DataFrame, by: Sequence[str], values: Sequence[str], periods: Sequence[int] = (7, 30), precedence: Sequence[str] = (), part: str | None = None) -> DataFrame:
    """For each entity and each day from its first to its last: totals, counts and averages.

    rows: by, day (days since 1970), the values (numbers) and the columns of precedence. Of several rows of an entity
    and day, each value is that of the row that is greatest by precedence (with `part`, a column: among the rows that name the value
    there), then the greatest value; a null in
    precedence is least, and a null in the greatest row stays null. Columns: by, day and for each value v and period p
    v_sum_p (0 if nothing fell in it), v_days_p (days with a value), v_avg_p (sum over p, quiet days as 0) and v_mean_p
    (sum over v_days_p, null if that is 0). Amounts are exact to 18 decimal places and must be below 1e17 in size;
    NaN, infinite and larger ones count as no value. Rows without entity or day are left out; an empty table gives no rows.
    """
    block = max(BLOCK_DAYS, *periods)
    whole = {v: isinstance(rows.schema[v].dataType, IntegralType) for v in values}
    amount = lambda v: F.col(v).cast("bigint") if whole[v] else F.when(F.abs(F.col(v)) < 1e17, F.col(v)).try_cast(EXACT)
    speaks = lambda v: F.col(part) == v if part else F.lit(True)
    told = [F.when(speaks(v), F.struct(*[F.col(c).alias(f"p{i}") for i, c in enumerate(precedence)], amount(v).alias("v"))).alias(f"r{i}") for i, v in enumerate(values)]
    # the caller's names could clash with those in here
    names, by = list(by), [f"__by{i}" for i in range(len(by))]
    rows = rows.select(*[F.col(c).alias(b) for c, b in zip(names, by, strict=True)], F.col("day").cast("int").alias("day"), *told).na.drop(subset=[*by, "day"])
    # one row per entity and day before the shuffle that brings blocks together: a day of very many rows costs a row per task
    daily = rows.groupBy(*by, "day").agg(*[F.max(f"r{i}")["v"].alias(f"v{i}") for i in range(len(values))])
    at = F.floor(F.col("day") / block)
    guest = F.floor((F.col("day") + max(periods) - 1) / block)  # the block that the longest period reaches
    each = daily.select(*by, F.explode(F.array_distinct(F.array(at, guest))).alias("block"), F.array("day").alias("days"), F.lit(False).alias("own"), *[f"v{i}" for i in range(len(values))])
    # the calendar: each block knows which of its days are the entity's
    span = rows.groupBy(*by).agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    calendar = span.select(*by, "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor(F.col("hi") / block))).alias("block"))
    first, end = F.col("block") * block, (F.col("block") + 1) * block
    days = F.sequence(F.greatest(F.col("lo"), first).cast("int"), F.least(F.col("hi"), end - 1).cast("int"))
    calendar = calendar.select(*by, "block", days.alias("days"), F.lit(True).alias("own"))
    both = each.unionByName(calendar, allowMissingColumns=True).repartition(*by, "block")
    # from here on all is within one block
    known = both.withColumn("day", F.explode("days")).groupBy(*by, "block", "day").agg(F.max("own").alias("own"), *[F.max(f"v{i}").alias(f"v{i}") for i in range(len(values))])
    zero = [F.lit(0).cast("bigint" if whole[v] else EXACT) for v in values]
    deltas = [F.struct(F.greatest("day", first).cast("int").alias("day"), F.col("own"), *_moves(values, zero, periods, lambda p: F.col("day") + p > first, 1))]
    deltas += [F.struct((F.col("day") + p).cast("int").alias("day"), F.lit(False).alias("own"), *_moves(values, zero, periods, lambda q, p=p: (F.col("day") + p > first) & (F.col("day") + p < end) if q == p else None, -1)) for p in periods]
    moved = known.select(*by, "block", F.inline(F.array(*deltas)))
    sums = [f"{k}{i}_{p}" for i in range(len(values)) for p in periods for k in "sn"]
    moved = moved.groupBy(*by, "block", "day").agg(F.max("own").alias("own"), *[F.sum(n).cast(moved.schema[n].dataType).alias(n) for n in sums])
    w = Window.partitionBy(*by, "block").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    run = moved.select(*by, "day", "own", *[F.sum(n).over(w).alias(n) for n in sums]).where("own")
    out = []
    for i, v in enumerate(values):
        for p in periods:
            total, seen = F.col(f"s{i}_{p}").cast("double"), F.col(f"n{i}_{p}").cast("bigint")
            out += [total.alias(f"{v}_sum_{p}"), seen.alias(f"{v}_days_{p}"), (total / p).alias(f"{v}_avg_{p}"), F.when(seen > 0, total / seen).alias(f"{v}_mean_{p}")]
    return run.select(*[F.col(b).alias(c) for c, b in zip(names, by, strict=True)], "day", *out)


def _moves(values: Sequence[str], zero: list[Column], periods: Sequence[int], when, sign: int) -> list[Column]:  # noqa: ANN001
    """Sums and counts that a day adds (sign 1) or takes off (-1) for each value and period; `when` gives the condition, None for never."""
    out = []
    for i in range(len(values)):
        for p in periods:
            ok = when(p)
            moves = F.lit(False) if ok is None else ok & F.col(f"v{i}").isNotNull()
            out += [F.when(moves, F.col(f"v{i}") if sign > 0 else -F.col(f"v{i}")).otherwise(zero[i]).alias(f"s{i}_{p}"), F.when(moves, sign).otherwise(0).cast("bigint").alias(f"n{i}_{p}")]
    return out


def quiet_and_recent(news: DataFrame) -> DataFrame:
    """(ticker, news_day, case_kind): days on which the last 7 days had no news but the last 30 had
    (silent), or on which all news of the last 30 days fell in the last 7 (all_recent)."""
    rows = news.select("ticker", day_number(F.col("as_of")).alias("day"), "news_count", "loaded_at", "news_id")
    t = trailing_totals(rows, ["ticker"], ["news_count"], precedence=["loaded_at", "news_id"])
    week, month = F.col("news_count_sum_7"), F.col("news_count_sum_30")
    kind = F.when((week == 0) & (month > 0), "silent").when((week == month) & (week > 0), "all_recent")
    return t.select("ticker", F.date_format(F.date_from_unix_date("day"), "yyyy-MM-dd").alias("news_day"), kind.alias("case_kind")).where("case_kind is not null")


def ticker_totals(news: DataFrame, bars: DataFrame, features: DataFrame) -> DataFrame:
    """Trailing totals and averages of news_count, close and realized_vol_5d for each ticker and day.

    A day's bar is that with the latest loaded_at, then largest bar_id; of repeated feature rows the
    greatest value counts.
    """
    none = F.lit(None)
    sources = ((news, "as_of", "news_count", F.col("loaded_at"), F.col("news_id")), (bars, "date", "close", F.col("loaded_at"), F.col("bar_id")), (features, "date", "realized_vol_5d", none.cast("timestamp_ntz"), none.cast("bigint")))
    kinds = {"news_count": "bigint", "close": "double", "realized_vol_5d": "double"}
    rows = None
    for df, time, value, loaded, key in sources:
        one = df.select("ticker", day_number(F.col(time)).alias("day"), F.lit(value).alias("part"), loaded.alias("loaded_at"), key.alias("key"), *[(F.col(v) if v == value else none).cast(t).alias(v) for v, t in kinds.items()])
        rows = one if rows is None else rows.unionByName(one)
    out = trailing_totals(rows, ["ticker"], list(kinds), precedence=["loaded_at", "key"], part="part")
    return out.withColumn("day", F.date_format(F.date_from_unix_date("day"), "yyyy-MM-dd"))
