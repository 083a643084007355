"""The instants of articles: texts in the habits of many feeds, brought to UTC."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.functions.timestamps import with_utc_millis

#: A lookup of feeds up to this size is sent to every executor; a larger one is joined by shuffle.
LOOKUP_BYTES = 8 << 20
#: Texts that are in the wanted form already, to the letter: field -> pattern. `$` would let a final line end pass.
NORMAL = {"published_at": r"\A\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z\z", "as_of": r"\A\d{4}-\d{2}-\d{2}\z"}


def with_feed(articles: DataFrame, feeds: DataFrame) -> DataFrame:
    """Add zone_name and date_order of each article's feed; null where the feed is unknown or null.

    Spark broadcasts the lookup only below its own size threshold; repeated feeds count once (the least
    zone and order).
    """
    look = feeds.groupBy("feed").agg(F.min("zone_name").alias("__zone"), F.min("date_order").alias("__order"))
    return articles.join(look, "feed", "left")


def article_instants(articles: DataFrame, feeds: DataFrame, fields: tuple[str, ...] = ("published_at", "as_of"), **policy: str) -> DataFrame:
    """The articles with published_ms and as_of_ms: milliseconds since 1970 UTC, null where none is named.

    published_at without a zone is on the clock of its feed; as_of in UTC.
    """
    df = with_feed(articles, feeds)
    for f in fields:
        zone = F.col("__zone") if f == "published_at" else F.lit("UTC")
        df = with_utc_millis(df, f, zone, F.col("__order"), f.removesuffix("_at") + "_ms", **policy)
    return df.drop("__zone", "__order")


def renormalised(articles: DataFrame, feeds: DataFrame) -> DataFrame:
    """(article_id, field_name, utc_ms) of each value that names an instant and is not in normal form yet."""
    odd = {f: F.when(~F.col(f).rlike(p), F.col(f)) for f, p in NORMAL.items()}
    df = article_instants(articles.select("article_id", "feed", *[c.alias(f) for f, c in odd.items()]), feeds)
    each = [F.struct(F.lit(f).alias("field_name"), F.col(ms).alias("utc_ms")) for f, ms in (("published_at", "published_ms"), ("as_of", "as_of_ms"))]
    return df.select("article_id", F.inline(F.array(*each))).where("utc_ms is not null")
