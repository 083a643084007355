"""Articles: common form, deduplication, tags, daily aggregates, and resumable scoring runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.operators.blocks import blocked_scan

# The topic tags, in their canonical order.
TAGS = ("earnings", "guidance", "ai_demand", "datacenter", "china", "supply_chain", "competition", "regulation", "macro", "other")
KEY = ("url", "title", "published_at")
#: White space of any script.
WHITE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def normalise_tags(tags: Column) -> Column:
    """The known tags of an array, each once, in canonical order; null for null."""
    return F.filter(F.array(*[F.lit(t) for t in TAGS]), lambda t: F.array_contains(tags, t))


def first_text(*values: Column, strip: str = WHITE) -> Column:
    """The first value that is neither null nor empty, without white space (or the characters to strip) around it; else an empty text."""
    return F.trim(F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit("")), F.lit(strip))


def daily_news(articles: DataFrame, day: Column, by: Sequence[str] = ("ticker",)) -> DataFrame:
    """Per entity and day: mean sentiment, largest risk, number of articles and of each topic's.

    Rows without entity or day are left out. A repeated tag counts once per article.
    """
    topics = [F.sum(F.coalesce(F.array_contains("topic_tags", t), F.lit(False)).cast("bigint")).alias(f"news_topic_{t}") for t in TAGS]
    rows = articles.withColumn("as_of_day", day).na.drop(subset=[*by, "as_of_day"])
    return rows.groupBy(*by, "as_of_day").agg(F.avg("sentiment_score").alias("news_sent_mean"), F.max("risk_score").alias("news_risk_max"), F.count(F.lit(1)).alias("news_count"), *topics)


def first_wins(df: DataFrame, key: Sequence[Column], order: str) -> DataFrame:
    """Of rows with equal keys that with the least `order` (unique); nulls are equal to each other. Combined before the shuffle."""
    names = [f"__k{i}" for i in range(len(key))]
    best = df.select(*[k.alias(n) for n, k in zip(names, key, strict=True)], F.struct(F.col(order).alias("__o"), F.struct(*df.columns).alias("r")).alias("s"))
    return best.groupBy(*names).agg(F.min_by("s.r", "s.__o").alias("r")).select("r.*")


def last_wins(df: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """Of rows with equal keys that with the greatest `order`, with first_seen: the least order of the key."""
    rest = F.struct(*[c for c in df.columns if c not in key])
    return df.groupBy(*key).agg(F.max_by(rest, order).alias("r"), F.min(order).alias("first_seen")).select(*key, "r.*", "first_seen")


def pending(articles: DataFrame, done: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Articles whose key has not been scored; null parts of a key are equal to each other."""
    on = [articles[k].eqNullSafe(done[k]) for k in key]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return articles.join(done.select(*key).distinct(), cond, "left_anti")


def in_given_order(scores: DataFrame, order: DataFrame, key: str, rank: str) -> DataFrame:
    """Add position: the rank that the order table gives a key (of repeated keys the last); unknown keys come last."""
    ranks = order.groupBy(key).agg(F.max(rank).alias("__rank"))
    return scores.join(ranks, key, "left").withColumn("position", F.coalesce(F.col("__rank"), F.lit((1 << 63) - 1))).drop("__rank")


def running_total(df: DataFrame, by: Sequence[str], order: Sequence[str], block: str, value: str, out: str = "running") -> DataFrame:
    """Running sum in order within an entity, by blocks; see blocked_scan."""
    return blocked_scan(df, by, block, order, {out: ("sum", value)})


def crossings(df: DataFrame, by: Sequence[str], order: Sequence[str], running: str, cap: float, fractions: Sequence[float]) -> DataFrame:
    """(by, fraction, at): the first row at which a running total reaches each fraction of a cap.

    A running total of amounts that are not negative doesn't fall, so the first row is the least in order.
    """
    at = F.struct(*order)
    hit = F.filter(F.array(*[F.lit(float(f)) for f in sorted(set(fractions))]), lambda f: F.col(running) >= f * cap)
    return df.select(*by, at.alias("__at"), F.explode(hit).alias("fraction")).groupBy(*by, "fraction").agg(F.min("__at").alias("__at")).select(*by, "fraction", "__at.*")


def alert_fractions(text: str) -> tuple[float, ...]:
    """Comma-separated positive numbers, each once, ascending; raises for others."""
    values = sorted({float(p) for p in (x.strip() for x in text.split(",")) if p})
    if any(v <= 0 for v in values):
        raise ValueError("fractions must be positive")
    return tuple(values)


def common_article(source: str) -> dict[str, Column]:
    """Columns that bring a raw article record of vendor A or B to the common form."""
    if source == "A":
        return {"source_name": first_text(F.col("source.name")), "title": first_text(F.col("title")), "body": first_text(F.col("content"), F.col("description")), "url": first_text(F.col("url")), "published_at": first_text(F.col("publishedAt"))}
    if source == "B":
        return {"source_name": first_text(F.col("publisher"), F.col("site")), "title": first_text(F.col("title")), "body": first_text(F.col("text")), "url": first_text(F.col("url")), "published_at": first_text(F.col("publishedDate"))}
    raise ValueError(f"unknown source {source!r}")


def score_violations(scores: DataFrame) -> DataFrame:
    """(violation, n_rows) of the article-score contract, in one pass; no row means that it holds."""
    tags = ", ".join(f"'{t}'" for t in TAGS)
    checks = {
        "null_key": "url IS NULL OR title IS NULL",
        "null_score": "sentiment_score IS NULL OR risk_score IS NULL",
        "sentiment_range": "NOT sentiment_score BETWEEN -1 AND 1",
        "risk_range": "NOT risk_score BETWEEN 0 AND 1",
        "negative_tokens": "least(input_tokens, output_tokens, cache_creation_input_tokens, cache_read_input_tokens) < 0",
        "negative_cost": "total_cost_usd < 0",
        "unknown_tag": f"exists(topic_tags, t -> t NOT IN ({tags}))",
        "repeated_tag": "size(array_distinct(topic_tags)) < size(topic_tags)",
    }
    return scores.agg(*[F.count_if(F.expr(c)).alias(n) for n, c in checks.items()]).unpivot([], list(checks), "violation", "n_rows").where("n_rows > 0")
