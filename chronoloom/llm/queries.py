"""The llm problems' queries and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.functions.timestamps import EDGES
from chronoloom.llm import canonical, leakage, packing, spans, tick_join, vector_cells
from chronoloom.plans.general import instants_sql
from chronoloom.sources.tables import table

RECORD = ("url", "title", "source_name")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    found = canonical.copies(table(spark, d, "article_score"), "article_id", RECORD)
    return found.select(F.col("first_id").alias("article_id"), "copy_id")


def p1_record_counts(spark: SparkSession, d: str) -> DataFrame:
    out = canonical.duplicate_counts(table(spark, d, "article_score"), "article_id", RECORD)
    return out.select(F.col("first_id").alias("article_id"), "n_copies", "collided")


_P1_KEYS = """
WITH v AS (SELECT article_id AS id, url, title, source_name,
  regexp_extract(url, '(?s)^([^?#]*)\\?([^#]*)(.*)$', 1) AS u1, regexp_extract(url, '(?s)^([^?#]*)\\?([^#]*)(.*)$', 2) AS u2,
  regexp_extract(url, '(?s)^([^?#]*)\\?([^#]*)(.*)$', 3) AS u3 FROM article_score
  WHERE url IS NOT NULL AND title IS NOT NULL AND source_name IS NOT NULL),
c AS (SELECT id, CASE WHEN regexp_matches(url, '(?s)^([^?#]*)\\?([^#]*)(.*)$') THEN
    regexp_replace(lower(u1), '[^\\p{L}\\p{Nd}]+', '', 'g')
    || array_to_string(list_sort(list_transform(string_split(u2, '&'), lambda x: regexp_replace(lower(x), '[^\\p{L}\\p{Nd}]+', '', 'g'))), '')
    || regexp_replace(lower(u3), '[^\\p{L}\\p{Nd}]+', '', 'g')
  ELSE regexp_replace(lower(url), '[^\\p{L}\\p{Nd}]+', '', 'g') END AS u,
  regexp_replace(lower(title), '[^\\p{L}\\p{Nd}]+', '', 'g') AS t, regexp_replace(lower(source_name), '[^\\p{L}\\p{Nd}]+', '', 'g') AS s FROM v),
k AS (SELECT id, array_to_string(list_sort([u, t, s]), chr(10)) AS whole FROM c)
"""

def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return vector_cells.replay(table(spark, d, "article_score"), table(spark, d, "feeds"))


def p5_nearest(spark: SparkSession, d: str) -> DataFrame:
    """Per article of a later batch, the nearest address that an earlier batch brought at about the same time."""
    return vector_cells.replay_nearest(table(spark, d, "article_score"), table(spark, d, "feeds"))


def p5_batches(spark: SparkSession, d: str) -> DataFrame:
    """Per batch, the articles that earlier batches had brought already."""
    batch = table(spark, d, "article_score").select("article_id", "batch_id")
    return p5_found(spark, d).join(batch, "article_id").groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_known"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _p7(spark, d).drop("distance_us")


def p7_distances(spark: SparkSession, d: str) -> DataFrame:
    """Per pairing and distance in whole hours, the number of pairs."""
    hours = F.floor(F.col("distance_us") / tick_join.HOUR_US).alias("hours")
    return _p7(spark, d).groupBy("pairing", hours).agg(F.count(F.lit(1)).alias("n_pairs"))


def _p7(spark: SparkSession, d: str) -> DataFrame:
    return tick_join.pairings(table(spark, d, "transcript_manifest"), table(spark, d, "nvda_prices"), table(spark, d, "news_scores"))


def _p7_pair(name: str, left: str, lt: str, li: str, right: str, rt: str, ri: str) -> str:
    return f"""SELECT '{name}' AS pairing, l.{li} AS left_id, r.{ri} AS right_id, abs(epoch_us(r.{rt}) - epoch_us(l.{lt})) AS us,
  row_number() OVER (PARTITION BY l.{li} ORDER BY abs(epoch_us(r.{rt}) - epoch_us(l.{lt})), r.{rt}, r.{ri}) AS rn
FROM {left} l JOIN {right} r ON r.ticker = l.ticker AND r.{rt} >= l.{lt} - INTERVAL 36 HOUR AND r.{rt} <= l.{lt} + INTERVAL 36 HOUR"""


_P7 = " UNION ALL ".join(
    _p7_pair(*x)
    for x in (
        ("call_bar", "transcript_manifest", "call_date", "call_id", "nvda_prices", "date", "bar_id"),
        ("call_news", "transcript_manifest", "call_date", "call_id", "news_scores", "as_of", "news_id"),
        ("news_bar", "news_scores", "as_of", "news_id", "nvda_prices", "date", "bar_id"),
    )
)


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed_documents(table(spark, d, "documents"))


def p8_cover(spark: SparkSession, d: str) -> DataFrame:
    """For each document with a text: are all its tokens placed, once each, and split only if they are more than a container holds?"""
    counts = packing.token_counts(table(spark, d, "documents")).where("n_tokens > 0")
    placed = p8_packed(spark, d)
    full = placed.groupBy("container_id").agg(F.sum("n_tokens").alias("in_container"))
    per = placed.join(full, "container_id").groupBy("doc_id").agg(F.sum("n_tokens").alias("placed"), F.count(F.lit(1)).alias("parts"), F.countDistinct("first_token").alias("starts"), F.max("in_container").alias("fullest"))
    whole = (F.col("placed") == F.col("n_tokens")) & (F.col("parts") == F.col("starts")) & (F.col("parts") == F.ceil(F.col("n_tokens") / packing.CAPACITY))
    return counts.join(per, "doc_id", "left").select("doc_id", F.coalesce(whole, F.lit(False)).alias("whole"), F.coalesce(F.col("fullest") <= packing.CAPACITY, F.lit(False)).alias("fits"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """One row: containers, tokens in them, and the share of room that is left."""
    per = p8_packed(spark, d).groupBy("container_id").agg(F.sum("n_tokens").alias("n"))
    total = per.agg(F.count(F.lit(1)).alias("n_containers"), F.sum("n").alias("n_tokens"), F.max("n").alias("fullest"))
    return total.withColumn("room_left", 1 - F.try_divide("n_tokens", F.col("n_containers") * packing.CAPACITY))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Passages within two edits by bands and alignment, and of these the ones that agree word for word."""
    return leakage.leaked_pairs(table(spark, d, "documents"), table(spark, d, "eval_items"), edits=2, exact=True)


def p9_near(spark: SparkSession, d: str) -> DataFrame:
    """Leaks of 13 words in which up to two bytes are edited."""
    return leakage.leaked_pairs(table(spark, d, "documents"), table(spark, d, "eval_items"), edits=2)


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    """Per test item, in how many documents it leaked."""
    return p9_found(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_pairs(table(spark, d, "documents"))


def p10_shared_share(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_share(table(spark, d, "documents"))


_P9 = """
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
dk AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM d WHERE len(w) >= 13),
ik AS (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS k FROM i WHERE len(w) >= 13),
dg AS (SELECT doc_id, array_to_string(w[k:k + 12], ' ') AS g FROM dk), ig AS (SELECT item_id, array_to_string(w[k:k + 12], ' ') AS g FROM ik)
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)"""


_EDGES = "' ' || " + " || ".join(f"chr({ord(c)})" for c in EDGES if c != " ")
_P5 = f"""
WITH i AS ({instants_sql("SELECT article_id, feed, 'published_at' AS field, published_at AS value FROM article_score WHERE published_at IS NOT NULL AND url IS NOT NULL")}),
u AS (SELECT article_id, batch_id, utc_ms AS ms, lower(trim(url, {_EDGES})) AS u FROM article_score JOIN i USING (article_id) WHERE url IS NOT NULL AND batch_id IS NOT NULL),
p AS (SELECT *, regexp_extract(u, '^(?:[a-z][a-z0-9+.-]*:)?/*([^/?#]*)([^?#]*)', 1) AS host, regexp_extract(u, '^(?:[a-z][a-z0-9+.-]*:)?/*([^/?#]*)([^?#]*)', 2) AS path, regexp_extract(u, '^[^?#]*[?]([^#]*)', 1) AS q FROM u),
a AS (SELECT article_id, batch_id, ms, array_to_string(list_transform([regexp_replace(regexp_replace(host, ':[0-9]*$', ''), '^(www|m|amp)[.]', ''), path, regexp_extract(q, '(?:^|&)id=([^&]*)', 1), regexp_extract(q, '(?:^|&)page=([^&]*)', 1)],
  lambda x: regexp_replace(x, '[^\\p{{L}}\\p{{Nd}}]+', '', 'g')), chr(10)) AS address FROM p)
SELECT min(k.article_id) AS kept_id, a.article_id FROM a JOIN a k ON k.address = a.address AND k.batch_id < a.batch_id AND abs(k.ms - a.ms) <= 600000 WHERE a.batch_id >= 1 GROUP BY a.article_id"""
# a stretch of 300 characters holds one of the blocks of 150 that a text is made of; windows are compared for the documents with such a block only.
# Texts as lists of characters, so that a window costs its own length, wherever it begins
_P10_WINDOWS = """
WITH t AS (SELECT doc_id, text FROM documents WHERE length(text) >= 300),
b AS (SELECT doc_id, substr(text, 150 * unnest(range(0, length(text) // 150)) + 1, 150) AS block FROM t),
o AS (SELECT block, min(doc_id) AS lo, max(doc_id) AS hi FROM b GROUP BY block),
x AS (SELECT DISTINCT t.doc_id AS a, o.block FROM o JOIN t ON contains(t.text, o.block) AND (o.lo <> t.doc_id OR o.hi <> t.doc_id)),
near AS (SELECT a AS doc_id FROM x UNION SELECT b.doc_id FROM b WHERE block IN (SELECT block FROM x)),
d AS (SELECT doc_id, string_split(text, '') AS c FROM t SEMI JOIN near USING (doc_id)),
k AS (SELECT doc_id, c, unnest(range(1, len(c) - 298)) AS k FROM d),
w AS (SELECT doc_id, k, md5_number(array_to_string(c[k:k + 299], '')) AS h FROM k),
r AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) <> max(doc_id)), m AS (SELECT doc_id, k, h FROM w JOIN r USING (h)),
s AS (SELECT h, list(DISTINCT doc_id ORDER BY doc_id) AS docs FROM m GROUP BY h), g AS (SELECT DISTINCT docs FROM s),
e AS (SELECT docs, unnest(docs) AS doc_id FROM g)"""
_P10 = f"""{_P10_WINDOWS}
SELECT DISTINCT doc_id, other_doc_id FROM (SELECT doc_id, unnest(docs) AS other_doc_id FROM e) WHERE doc_id < other_doc_id"""
_P10_SHARE = f"""{_P10_WINDOWS},
cls AS (SELECT doc_id, length(text) AS n_chars, min(doc_id) OVER (PARTITION BY text) AS class_id, count(*) OVER (PARTITION BY text) AS n_copies FROM documents WHERE text IS NOT NULL),
links AS (SELECT y.class_id, count(DISTINCT z.class_id) AS n_links FROM (SELECT doc_id, unnest(docs) AS other FROM e) p JOIN cls y ON y.doc_id = p.doc_id JOIN cls z ON z.doc_id = p.other WHERE y.class_id <> z.class_id GROUP BY y.class_id),
part AS (SELECT doc_id, CAST(sum(least(300, coalesce(after - k, 300))) AS BIGINT) AS shared FROM (SELECT doc_id, k, lead(k) OVER (PARTITION BY doc_id ORDER BY k) AS after FROM m) GROUP BY doc_id)
SELECT doc_id, class_id, n_chars, n_copies, coalesce(n_links, 0) AS n_links, coalesce(shared, 0) AS shared_chars, CASE WHEN n_chars > 0 THEN coalesce(shared, 0) / n_chars ELSE 0.0 END AS shared_share
FROM cls LEFT JOIN links USING (class_id) LEFT JOIN part USING (doc_id)"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_record_counts": p1_record_counts,
    "p5_found": p5_found,
    "p5_nearest": p5_nearest,
    "p5_batches": p5_batches,
    "p7_found": p7_found,
    "p7_distances": p7_distances,
    "p8_packed": p8_packed,
    "p8_cover": p8_cover,
    "p8_fill": p8_fill,
    "p9_found": p9_found,
    "p9_near": p9_near,
    "p9_items": p9_items,
    "p10_found": p10_found,
    "p10_shared_share": p10_shared_share,
}

SQL: dict[str, str] = {
    "p1_found": _P1_KEYS
    + "SELECT first_id AS article_id, id AS copy_id FROM (SELECT id, min(id) OVER (PARTITION BY whole) AS first_id FROM k) WHERE id <> first_id",
    "p1_record_counts": _P1_KEYS + "SELECT min(id) AS article_id, count(*) AS n_copies, false AS collided FROM k GROUP BY whole",
    "p5_found": _P5,
    "p5_batches": f"SELECT batch_id, count(*) AS n_known FROM ({_P5}) JOIN article_score USING (article_id) GROUP BY batch_id",
    "p7_found": f"SELECT pairing, left_id, right_id FROM ({_P7}) WHERE rn = 1",
    "p7_distances": f"SELECT pairing, us // 3600000000 AS hours, count(*) AS n_pairs FROM ({_P7}) WHERE rn = 1 GROUP BY ALL",
    "p8_cover": "SELECT doc_id, true AS whole, true AS fits FROM documents WHERE text <> ''",
    "p9_found": _P9,
    "p9_items": f"SELECT item_id, count(*) AS n_docs FROM ({_P9}) GROUP BY item_id",
    "p10_found": _P10,
    "p10_shared_share": _P10_SHARE,
}
