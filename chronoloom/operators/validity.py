"""Attributes as known at event time, by dyadic decomposition of validity intervals.

A fact is valid from the moment it is known until a better one is. Each half-open interval [start, end) is
cut into dyadic nodes of a time line in ticks (as the nodes of a segment tree); an event lies in one node
per level in use, so events and facts meet by an equi-join on (entity, level, node). A hot entity spreads over its
nodes. Matches are then held against the exact interval.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.operators.blocks import blocked_scan

DAY_US = 86_400_000_000
#: Levels of nodes: 1, 8 and 64 ticks. Every event is told to each level in use and every interval to at most 2 * (2^step - 1)
#: nodes of each, so where events are many and intervals few, levels some steps apart move fewer rows than all.
LEVELS = (0, 3, 6)


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, whatever the session's zone."""
    seconds = F.unix_date(ts.cast("date")).cast("bigint") * 86_400 + F.hour(ts) * 3_600 + F.minute(ts) * 60
    return seconds * 1_000_000 + (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")


def _levels(levels: int | Sequence[int]) -> list[int]:
    """The node levels in use, ascending from 0: a number stands for that many in a row."""
    out = list(range(levels)) if isinstance(levels, int) else list(levels)
    if not out or out[0] != 0 or out != sorted(set(out)):
        raise ValueError("levels must ascend from 0")
    return out


def dyadic_cover(lo: str, hi: str, levels: int | Sequence[int]) -> Column:
    """The nodes (level, node) of the given levels that tile the ticks [lo, hi), the largest that fit; the top level in full."""
    use = _levels(levels)
    parts = []
    for i, level in enumerate(use):
        low, high = f"shiftright({lo} + shiftleft(1L, {level}) - 1, {level})", f"shiftright({hi}, {level})"
        nodes = lambda a, b, level=level: f"transform(if({a} < {b}, sequence({a}, {b} - 1), array()), n -> struct({level} AS level, n AS node))"
        if i + 1 == len(use):
            parts.append(nodes(low, high))
            continue
        up, step = use[i + 1], use[i + 1] - level
        first, end = f"shiftright({lo} + shiftleft(1L, {up}) - 1, {up})", f"shiftright({hi}, {up})"
        # what the next level leaves over: all of it, or a piece on either side
        parts.append(f"if({first} < {end}, concat({nodes(low, f'shiftleft({first}, {step})')}, {nodes(f'shiftleft({end}, {step})', high)}), {nodes(low, high)})")
    return F.expr(f"concat({', '.join(parts)})")


def enclosing_nodes(tick: str, levels: int | Sequence[int]) -> Column:
    """The one node of each level in which a tick lies."""
    return F.expr(f"array({', '.join(f'struct({level} AS level, shiftright({tick}, {level}) AS node)' for level in _levels(levels))})")


def interval_join(events: DataFrame, facts: DataFrame, by: Sequence[str], at: str, start: str, end: str, tick_us: int = DAY_US, levels: int | Sequence[int] = LEVELS) -> DataFrame:
    """Inner join of events with the facts of the same entity for which start <= at < end (microseconds).

    Columns: by, then the events' other columns, then the facts' other ones (names must not clash: rename
    before). Null entity, time or bound: no match. Overlapping facts all match. Neither side is broadcast
    by force; an interval has at most 2 * (2^step - 1) nodes of each level but the top, where it has its length / 2^level.
    """
    cover = facts.na.drop(subset=[*by, start, end]).where(F.col(start) < F.col(end))
    cover = cover.withColumn("__lo", F.floor(F.col(start) / tick_us)).withColumn("__hi", F.ceil(F.col(end) / tick_us))
    cover = cover.select("*", F.inline(dyadic_cover("__lo", "__hi", levels))).drop("__lo", "__hi")
    points = events.na.drop(subset=[*by, at]).withColumn("__tick", F.floor(F.col(at) / tick_us))
    points = points.select("*", F.inline(enclosing_nodes("__tick", levels))).drop("__tick")
    met = points.join(cover, [*by, "level", "node"])
    return met.where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("level", "node")


def known_intervals(facts: DataFrame, by: Sequence[str], effective: str, known: str, precedence: Sequence[str], horizon: DataFrame) -> DataFrame:
    """Add start_us and end_us: when each fact is the one in force.

    A fact counts from the later of just after `effective` and `known` (columns in microseconds). Of those
    that count, the greatest by (effective, known, *precedence) is in force; a fact ends when a greater one
    begins. horizon: (by, last_us), the last event of each entity, to which open intervals reach.
    Facts without entity, effective or known are left out. The result's intervals do not overlap.
    """
    order = [effective, known, *precedence]
    f = facts.na.drop(subset=[*by, effective, known]).withColumn("start_us", F.greatest(F.col(effective) + 1, F.col(known)))
    # the earliest start among the greater facts: a running minimum against the order
    f = f.withColumns({f"__d{i}": -F.col(c) for i, c in enumerate(order)})
    f = f.withColumn("__block", F.floor(F.col("__d0") / (256 * DAY_US)))
    f = blocked_scan(f, by, "__block", [f"__d{i}" for i in range(len(order))], {"__next": ("min", "start_us")}, upto=-1)
    past = F.col("last_us") + 1
    return f.join(horizon, list(by)).withColumn("end_us", F.least(F.coalesce("__next", past), past)).drop("__block", "__next", "last_us", *[f"__d{i}" for i in range(len(order))])


def as_known(bars: DataFrame, scores: DataFrame) -> DataFrame:
    """(bar_id, score_id, pos_mean): each bar with the score that was in force on its date.

    A score counts once call_date is before the bar's date and scored_at not after it; the latest call
    wins, then the latest scoring, then the largest score_id. Scores with a null in ticker, call_date,
    pos_mean or scored_at and bars without ticker or date take no part; bars without a score give no row.
    """
    events = bars.select("ticker", "bar_id", micros(F.col("date")).alias("at_us"))
    facts = scores.where("pos_mean is not null").select("ticker", "score_id", "pos_mean", micros(F.col("call_date")).alias("call_us"), micros(F.col("scored_at")).alias("scored_us"))
    horizon = events.groupBy("ticker").agg(F.max("at_us").alias("last_us"))
    spans = known_intervals(facts, ["ticker"], "call_us", "scored_us", ["score_id"], horizon).select("ticker", "score_id", "pos_mean", "start_us", "end_us")
    return interval_join(events, spans, ["ticker"], "at_us", "start_us", "end_us").select("bar_id", "score_id", "pos_mean")
