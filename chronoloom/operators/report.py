"""What reports are made of: fixed orders, families, formatted numbers, plain and markdown tables, and sentences about differences."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_category_order(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """A row for each category of the order, with `position` from 1; categories without a row have nulls, rows of others are left out.

    The order is a handful of names of the caller's. Repeated rows of a category stay.
    """
    names = df.sparkSession.createDataFrame([(n, i) for i, n in enumerate(order, 1)], f"`{key}` string, position int")
    return names.join(df, key, "left").select(*df.columns, "position")


def number_text(c: Column, places: int = 6) -> Column:
    """A number with so many places, nan for null."""
    return F.when(c.isNotNull(), F.format_string(f"%.{places}f", c.cast("double"))).otherwise("nan")


def share_text(c: Column) -> Column:
    """A share as a signed percentage with two places."""
    return F.when(c.isNotNull(), F.concat(F.when(c >= 0, "+").otherwise("-"), F.format_string("%.2f", F.abs(c) * 100), F.lit("%")))


def day_text(c: Column) -> Column:
    """A time as its day, yyyy-MM-dd; null for null."""
    return F.date_format(c, "yyyy-MM-dd")


def delta_sentence(name: Column, delta: Column, baseline: str, value: str = "MAE") -> Column:
    """What a model does to an error against the baseline's, in words; null where the difference is unknown."""
    verb = F.when(delta >= 0, "raises").otherwise("lowers")
    change = F.concat(name, F.lit(" "), verb, F.lit(f" {value} by "), F.format_string("%.2f", F.abs(delta) * 100), F.lit(f" % against {baseline}"))
    return F.when(name == baseline, F.concat(name, F.lit(" is the baseline"))).when(delta.isNotNull(), change)


def _cell(v: object) -> str:
    if v is None or isinstance(v, float) and math.isnan(v):
        return "nan"
    return f"{v:.6f}" if isinstance(v, float) else str(v)


def markdown_table(df: DataFrame, most: int = 100) -> str:
    """The rows of a small result as a markdown table; raises if there are more than `most`."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    line = lambda cells: f"| {' | '.join(cells)} |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *[line([_cell(v) for v in r]) for r in rows]])


def plain_table(df: DataFrame, title: str, most: int = 100) -> str:
    """The same in columns of equal width, under a title."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    if not rows:
        return f"{title}\n  (no rows)"
    cells = [df.columns, *[[_cell(v) for v in r] for r in rows]]
    widths = [max(len(r[k]) for r in cells) for k in range(len(df.columns))]
    return "\n".join([title, *["  ".join(v.rjust(w) for v, w in zip(r, widths, strict=True)) for r in cells]])
