"""Queries of the general data-preparation problems, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chronoloom.functions.timestamps import ABBREVIATIONS, MONTHS
from chronoloom.operators import instants, rolling, spikes, validity
from chronoloom.sources.tables import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return instants.renormalised(table(spark, d, "article_score"), table(spark, d, "feeds"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return validity.as_known(table(spark, d, "nvda_prices"), table(spark, d, "finbert_scores")).select("bar_id", "score_id")


def p3_bars_with_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every bar, with the pos_mean known on its date (null before the first)."""
    bars = table(spark, d, "nvda_prices")
    known = validity.as_known(bars, table(spark, d, "finbert_scores"))
    return bars.select("bar_id", "ticker", "date").join(known, "bar_id", "left")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return spikes.implausible(table(spark, d, "nvda_prices")).drop("kind")


def p4_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Implausible readings by field and kind."""
    return spikes.implausible(table(spark, d, "nvda_prices")).groupBy("field_name", "kind").agg({"bar_id": "count"}).withColumnRenamed("count(bar_id)", "n_readings")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return rolling.quiet_and_recent(table(spark, d, "news_scores"))


def p6_rolling_totals(spark: SparkSession, d: str) -> DataFrame:
    return rolling.ticker_totals(table(spark, d, "news_scores"), table(spark, d, "nvda_prices"), table(spark, d, "price_features"))


_P4_SPIKE = " UNION ALL ".join(
    f"""SELECT ticker, f, unnest([{", ".join(["date", "d1", "d2"][:k])}]) AS date, habit FROM s, LATERAL (SELECT {" + ".join(xs[:k])} AS total) WHERE
  {" AND ".join(f"sign({x} - p) = sign(x - p)" for x in xs[:k])} AND sign(x - p) <> 0
  AND abs(x{k} - p) < 0.5 * least({", ".join(f"abs({x} - p)" for x in xs[:k])})
  AND least(abs(total / {k} - (p + x{k}) / 2), {", ".join(f"abs({x} - p), abs({x} - x{k})" for x in xs[:k])}, {", ".join(["off", "off1", "off2"][:k])}) >= greatest(7.5 * habit, CASE WHEN f = 'volume' THEN 2.0 ELSE 0.0 END)"""
    for k, xs in ((k, ["x", "x1", "x2"]) for k in (1, 2, 3))
)
_P4 = f"""
WITH r AS (SELECT bar_id, ticker, date, 'close' AS f, close AS v FROM nvda_prices UNION ALL SELECT bar_id, ticker, date, 'volume', volume FROM nvda_prices),
u AS (SELECT ticker, f, date, max(v) AS v FROM r WHERE ticker IS NOT NULL AND date IS NOT NULL GROUP BY ALL),
e AS (SELECT *, CASE WHEN v = lag(v) OVER (PARTITION BY ticker, f ORDER BY date) THEN 0 ELSE 1 END AS fresh FROM u),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY ticker, f ORDER BY date) AS run FROM e),
stuck AS (SELECT ticker, f, date FROM (SELECT *, count(*) OVER (PARTITION BY ticker, f, run) AS n FROM g) WHERE n >= 5 AND fresh = 0 AND v > 0),
x0 AS (SELECT ticker, f, date, ln(v) AS x FROM u WHERE v > 0),
x1 AS (SELECT *, lag(x) OVER w AS p, lead(x, 1) OVER w AS x1, lead(x, 2) OVER w AS x2, lead(x, 3) OVER w AS x3, lead(date, 1) OVER w AS d1, lead(date, 2) OVER w AS d2,
  abs(x - median(x) OVER (PARTITION BY ticker, f ORDER BY date ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING)) AS off FROM x0 WINDOW w AS (PARTITION BY ticker, f ORDER BY date)),
x2 AS (SELECT *, lead(off, 1) OVER w AS off1, lead(off, 2) OVER w AS off2 FROM x1 WINDOW w AS (PARTITION BY ticker, f ORDER BY date)),
h AS (SELECT ticker, f, 1.4826 * median(abs(x - p)) AS habit FROM x2 WHERE x <> p GROUP BY ALL),
s AS (SELECT x2.*, habit FROM x2 JOIN h USING (ticker, f)),
spike AS ({_P4_SPIKE}),
odd AS (SELECT ticker, f, date, 'spike' AS kind FROM spike UNION SELECT ticker, f, date, 'stuck' FROM stuck),
o AS (SELECT bar_id, f, 'impossible' AS kind FROM r WHERE v <= 0 UNION ALL SELECT bar_id, r.f, kind FROM r JOIN odd ON odd.ticker = r.ticker AND odd.f = r.f AND odd.date = r.date WHERE r.v > 0)
SELECT bar_id, f AS field_name, min(kind) AS kind FROM o GROUP BY ALL"""

_P3 = """
SELECT b.bar_id, s.score_id, s.pos_mean,
  row_number() OVER (PARTITION BY b.bar_id ORDER BY s.call_date DESC, s.scored_at DESC, s.score_id DESC) AS rn
FROM nvda_prices b JOIN finbert_scores s ON s.ticker = b.ticker AND s.call_date < b.date AND s.scored_at <= b.date
WHERE s.pos_mean IS NOT NULL
"""

_P6_NEWS = """
n AS (SELECT ticker, CAST(as_of AS DATE) AS d, news_count FROM (SELECT *, row_number() OVER
  (PARTITION BY ticker, CAST(as_of AS DATE) ORDER BY loaded_at DESC, news_id DESC) AS rn FROM news_scores WHERE ticker IS NOT NULL AND as_of IS NOT NULL) WHERE rn = 1)
"""


def _p6_totals() -> str:
    cols = []
    for v in ("news_count", "close", "realized_vol_5d"):
        for p in (7, 30):
            w = f"OVER (PARTITION BY ticker ORDER BY d ROWS BETWEEN {p - 1} PRECEDING AND CURRENT ROW)"
            s, c = f"CAST(coalesce(sum(CAST(round({v} * 1000000) AS BIGINT)) {w}, 0) AS DOUBLE) / 1000000", f"count({v}) {w}"
            cols.append(f"{s} AS {v}_sum_{p}, {c} AS {v}_days_{p}, ({s}) / {p} AS {v}_avg_{p}, CASE WHEN {c} > 0 THEN ({s}) / {c} END AS {v}_mean_{p}")
    return f"""
WITH {_P6_NEWS},
b AS (SELECT ticker, CAST(date AS DATE) AS d, close FROM (SELECT *, row_number() OVER
  (PARTITION BY ticker, CAST(date AS DATE) ORDER BY loaded_at DESC, bar_id DESC) AS rn FROM nvda_prices WHERE ticker IS NOT NULL AND date IS NOT NULL) WHERE rn = 1),
f AS (SELECT ticker, CAST(date AS DATE) AS d, max(realized_vol_5d) AS realized_vol_5d FROM price_features WHERE ticker IS NOT NULL AND date IS NOT NULL GROUP BY ALL),
span AS (SELECT ticker, min(d) AS lo, max(d) AS hi FROM (SELECT ticker, d FROM n UNION ALL SELECT ticker, d FROM b UNION ALL SELECT ticker, d FROM f) GROUP BY ticker),
cal AS (SELECT ticker, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS d FROM span),
j AS (SELECT ticker, d, news_count, close, realized_vol_5d FROM cal LEFT JOIN n USING (ticker, d) LEFT JOIN b USING (ticker, d) LEFT JOIN f USING (ticker, d))
SELECT ticker, strftime(d, '%Y-%m-%d') AS day, {", ".join(cols)} FROM j"""


# Problem 2 in SQL has its own way to read: one pattern for a date, one for a clock and one for a zone, taken off the text from the end, and a
# table of every zone's offsets by hour instead of zone functions on local times
_OFFSETS = "{" + ", ".join(f"'{k.lower()}': {(60 * int(v[1:3]) + int(v[4:])) * (-1 if v[0] == '-' else 1)}" for k, v in ABBREVIATIONS.items()) + "}"
_MONTHS = "['" + "', '".join(MONTHS) + "']"
_CLOCK = r"[0-9]{1,2}:[0-9]{2}(:[0-9]{2}([.,][0-9]{1,9})?)?([ ]*[ap]m\b)?"
_TAIL = rf"(t|,?\s+)({_CLOCK})(\s*(z|[a-z]{{2,5}}|[+-][0-9]{{2}}:?[0-9]{{2}}|[a-z]+(/[a-z0-9_+-]+)+))?$"
def instants_sql(values: str) -> str:
    """(article_id, field_name, utc_ms) of the values (article_id, feed, field, value) that name an instant."""
    return rf"""
WITH raw AS ({values}),
v AS (SELECT article_id, field, lower(trim(value, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || chr(8201) || chr(8203) || chr(65279))) AS v, CASE WHEN field = 'as_of' THEN 'UTC' ELSE zone_name END AS home, date_order FROM raw JOIN feeds USING (feed)),
b AS (SELECT *, regexp_replace(v, '^([0-9]{{4}})([0-9]{{2}})([0-9]{{2}})t([0-9]{{2}})([0-9]{{2}})([0-9]{{2}})', '\1-\2-\3t\4:\5:\6') AS w FROM v),
c AS (SELECT *, regexp_extract(w, '{_TAIL}', 2) AS clock, regexp_extract(w, '{_TAIL}', 7) AS zone, regexp_replace(w, '{_TAIL}', '') AS day FROM b),
e AS (SELECT *, regexp_replace(day, '^(mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+', '') AS d FROM c),
f AS (SELECT *, CASE
  WHEN regexp_full_match(d, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN string_split(d, '-')
  WHEN regexp_full_match(d, '[0-9]{{8}}') AND clock = '' THEN [d[1:4], d[5:6], d[7:8]]
  WHEN regexp_full_match(d, '[0-9]{{1,2}}/[0-9]{{1,2}}/([0-9]{{4}}|[0-9]{{2}})') THEN CASE date_order WHEN 'MDY' THEN [string_split(d, '/')[3], string_split(d, '/')[1], string_split(d, '/')[2]] WHEN 'DMY' THEN list_reverse(string_split(d, '/')) END
  WHEN regexp_full_match(d, '[0-9]{{1,2}}\.[0-9]{{1,2}}\.([0-9]{{4}}|[0-9]{{2}})') THEN list_reverse(string_split(d, '.'))
  WHEN regexp_full_match(d, '[0-9]{{1,2}}\s+[a-z]{{3,9}}\.?,?\s+([0-9]{{4}}|[0-9]{{2}})') THEN [regexp_extract(d, '([0-9]+)$', 1), list_position({_MONTHS}, regexp_extract(d, '[a-z]{{3}}', 0))::VARCHAR, regexp_extract(d, '^[0-9]+', 0)]
  WHEN regexp_full_match(d, '[a-z]{{3,9}}\.?\s+[0-9]{{1,2}},?\s+[0-9]{{4}}') THEN [regexp_extract(d, '([0-9]+)$', 1), list_position({_MONTHS}, regexp_extract(d, '^[a-z]{{3}}', 0))::VARCHAR, regexp_extract(d, '[0-9]+', 0)] END AS ymd FROM e),
g AS (SELECT *, TRY_CAST(CASE WHEN length(ymd[1]) = 2 THEN '20' || ymd[1] ELSE ymd[1] END AS INTEGER) AS y, TRY_CAST(ymd[2] AS INTEGER) AS m, TRY_CAST(ymd[3] AS INTEGER) AS dd,
  TRY_CAST(nullif(regexp_extract(clock, '^([0-9]+)', 1), '') AS INTEGER) AS h0, TRY_CAST(nullif(regexp_extract(clock, '^[0-9]+:([0-9]+)', 1), '') AS INTEGER) AS mi, TRY_CAST(nullif(regexp_extract(clock, '^[0-9]+:[0-9]+:([0-9]+)', 1), '') AS INTEGER) AS se,
  rpad(regexp_extract(clock, '[.,]([0-9]+)', 1)[1:3], 3, '0') AS ms, regexp_extract(clock, '[ap]m', 0) AS half FROM f),
k AS (SELECT *, CASE half WHEN '' THEN h0 ELSE CASE WHEN h0 BETWEEN 1 AND 12 THEN h0 % 12 + CASE WHEN half = 'pm' THEN 12 ELSE 0 END ELSE 99 END END AS h FROM g),
t0 AS (SELECT *, TRY_CAST(lpad(y::VARCHAR, 4, '0') || '-' || lpad(m::VARCHAR, 2, '0') || '-' || lpad(dd::VARCHAR, 2, '0') || ' ' || lpad(coalesce(h, 0)::VARCHAR, 2, '0') || ':' || lpad(coalesce(mi, 0)::VARCHAR, 2, '0') || ':' || lpad(coalesce(se, 0)::VARCHAR, 2, '0') AS TIMESTAMP) AS wall,
  CASE WHEN clock = '' AND d <> w AND d <> day THEN '' ELSE zone END AS z FROM k WHERE coalesce(h, 0) < 24 AND coalesce(mi, 0) < 60 AND coalesce(se, 0) < 60),
t AS (SELECT t0.* REPLACE (coalesce(n.name, home) AS home, CASE WHEN n.name IS NOT NULL THEN '' ELSE z END AS z) FROM t0 LEFT JOIN (SELECT DISTINCT name FROM pg_timezone_names() WHERE contains(name, '/')) n ON lower(n.name) = z),
u AS (SELECT *, CASE WHEN z = '' THEN NULL WHEN regexp_full_match(z, '[+-][0-9]{{2}}:?[0-9]{{2}}') THEN (z[2:3]::INTEGER * 60 + right(z, 2)::INTEGER) * CASE z[1] WHEN '-' THEN -1 ELSE 1 END ELSE map_extract_value(MAP {_OFFSETS}, z) END AS fixed FROM t),
homes AS (SELECT DISTINCT home AS zone FROM t), hours AS (SELECT unnest(generate_series(TIMESTAMP '2015-01-01', TIMESTAMP '2031-01-01', INTERVAL 1 HOUR)) AS hour),
o AS (SELECT zone, hour, date_diff('minute', hour, timezone(zone, timezone('UTC', hour))) AS off FROM homes, hours),
n AS (SELECT zone, hour + to_minutes(off) AS local, off, hour FROM o),
-- of the offsets in force within a day around, the first instant whose clock shows the local time; where none does, the offset before
near AS (SELECT u.article_id, u.field, u.wall, min(u.wall - to_minutes(o.off)) FILTER (x.off = o.off) AS shown, arg_min(o.off, o.hour) AS before_
  FROM u JOIN o ON u.fixed IS NULL AND u.z = '' AND o.zone = u.home AND o.hour IN (date_trunc('hour', u.wall - INTERVAL 1 DAY), date_trunc('hour', u.wall + INTERVAL 1 DAY))
  LEFT JOIN o x ON x.zone = u.home AND x.hour = date_trunc('hour', u.wall - to_minutes(o.off)) WHERE u.wall IS NOT NULL GROUP BY ALL),
r AS (SELECT u.article_id, u.field, u.ms, CASE WHEN u.fixed IS NOT NULL THEN u.wall - to_minutes(u.fixed) WHEN u.z = '' THEN coalesce(near.shown, u.wall - to_minutes(near.before_)) END AS utc
  FROM u LEFT JOIN near ON near.article_id = u.article_id AND near.field = u.field WHERE u.wall IS NOT NULL)
SELECT article_id, field AS field_name, epoch_ms(utc) + coalesce(TRY_CAST(ms AS BIGINT), 0) AS utc_ms FROM r WHERE utc IS NOT NULL
UNION ALL SELECT article_id, field, CASE WHEN length(v) < 12 THEN v::BIGINT * 1000 ELSE v::BIGINT END FROM v WHERE regexp_full_match(v, '[0-9]{{1,15}}') AND length(v) <> 8"""


_P2 = instants_sql("""SELECT article_id, feed, field, value FROM (SELECT article_id, feed, 'published_at' AS field, published_at AS value FROM article_score UNION ALL SELECT article_id, feed, 'as_of', as_of FROM article_score)
  WHERE value IS NOT NULL AND NOT (field = 'published_at' AND regexp_full_match(value, '[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z')) AND NOT (field = 'as_of' AND regexp_full_match(value, '[0-9]{4}-[0-9]{2}-[0-9]{2}'))""")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p3_bars_with_scores": p3_bars_with_scores,
    "p4_found": p4_found,
    "p4_kinds": p4_kinds,
    "p6_found": p6_found,
    "p6_rolling_totals": p6_rolling_totals,
}

SQL: dict[str, str] = {
    "p2_found": _P2,
    "p3_found": f"SELECT bar_id, score_id FROM ({_P3}) WHERE rn = 1",
    "p3_bars_with_scores": f"SELECT b.bar_id, b.ticker, b.date, k.score_id, k.pos_mean FROM nvda_prices b LEFT JOIN (SELECT * FROM ({_P3}) WHERE rn = 1) k ON k.bar_id = b.bar_id",
    "p4_found": f"SELECT bar_id, field_name FROM ({_P4})",
    "p4_kinds": f"SELECT field_name, kind, count(bar_id) AS n_readings FROM ({_P4}) GROUP BY ALL",
    "p6_found": f"""
WITH {_P6_NEWS},
span AS (SELECT ticker, min(d) AS lo, max(d) AS hi FROM n GROUP BY ticker),
cal AS (SELECT ticker, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS d FROM span),
t AS (SELECT ticker, d, coalesce(sum(news_count) OVER (PARTITION BY ticker ORDER BY d ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 0) AS w,
  coalesce(sum(news_count) OVER (PARTITION BY ticker ORDER BY d ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), 0) AS m FROM cal LEFT JOIN n USING (ticker, d))
SELECT ticker, strftime(d, '%Y-%m-%d') AS news_day, CASE WHEN w = 0 AND m > 0 THEN 'silent' ELSE 'all_recent' END AS case_kind
FROM t WHERE (w = 0 AND m > 0) OR (w = m AND w > 0)""",
    "p6_rolling_totals": _p6_totals(),
}
