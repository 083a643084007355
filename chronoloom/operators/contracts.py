"""Contracts of tables: schema, order-free conditions counted in one pass, and an error that names what is broken."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, NumericType, StructType

from chronoloom.operators.bars import BAR_COLUMNS, require
from chronoloom.operators.news import TAGS

LOADED_BARS = "date timestamp_ntz, " + ", ".join(f"{c} double" for c in (*BAR_COLUMNS, "returns", "realized_vol_5d"))
CALL_COLUMNS = ("pos_mean", "neg_mean", "neu_mean", "pos_frac", "neg_frac")
CALL_SCORES = "call_date timestamp_ntz, " + ", ".join(f"{c} double" for c in CALL_COLUMNS)
NEWS_COUNTS = ("news_count", *[f"news_topic_{t}" for t in TAGS])


def violations(df: DataFrame, checks: dict[str, Column | str], unique: Sequence[Sequence[str]] = ()) -> DataFrame:
    """(violation, n_rows) of the rows for which a check's condition holds and of repeated keys; no row where all is well.

    One pass for all checks, and one aggregation for each key. A condition that is null does not hold; an empty table breaks nothing.
    """
    names = list(checks)
    counts = df.agg(F.lit(0).cast("bigint").alias("__none"), *[F.count_if(F.expr(c) if isinstance(c, str) else c).alias(f"c{i}") for i, c in enumerate(checks.values())])
    pairs = [F.struct(F.lit(n).alias("violation"), F.col(f"c{i}").alias("n_rows")) for i, n in enumerate(names)]
    out = counts.select(F.inline(F.array(*pairs))) if pairs else None
    for key in unique:
        repeated = df.groupBy(*key).agg((F.count(F.lit(1)) - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))
        one = repeated.select(F.lit("repeated_" + "_".join(key)).alias("violation"), "n_rows")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("nothing to check")
    return out.where("n_rows > 0")


def _missing(columns: Sequence[str]) -> dict[str, str]:
    return {f"null_{c}": f"`{c}` IS NULL" for c in columns}


def require_schema(df: DataFrame, schema: str | StructType, extras: bool = False) -> None:
    """Raise unless df has these columns and types, in this order; with extras, at least these, in any order."""
    want = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    have: dict[str, DataType] = {f.name: f.dataType for f in df.schema}
    wrong = [f.name for f in want if have.get(f.name) != f.dataType]
    if wrong or not extras and df.columns != want.names:
        raise ValueError(f"expected {want.simpleString()}, got {df.schema.simpleString()}" + (f"; missing or of another type: {wrong}" if wrong else ""))


def check_loaded_bars(bars: DataFrame) -> None:
    """Bars as loaded: exact columns in order, dates present and unique, values present but for the derived ones. That dates ascend is a
    matter of windows here, not of the table."""
    require_schema(bars, LOADED_BARS)
    require(violations(bars, _missing(["date", *BAR_COLUMNS]), [["date"]]))


def check_join_frame(bars: DataFrame, by: Sequence[str] = ()) -> None:
    """Bars that features are joined to: the loaded columns must be there, in any order; others are kept. Entity and date unique."""
    require_schema(bars, LOADED_BARS, extras=True)
    require(violations(bars, _missing([*by, "date"]), [[*by, "date"]]))


def whole_number(c: str) -> Column:
    """Is a value present, finite and without a fraction?"""
    v = F.col(c).cast("double")
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")) & (v == F.floor(v))


def check_call_scores(scores: DataFrame) -> None:
    """Call scores: exact columns in order and types."""
    require_schema(scores, CALL_SCORES)


def check_news_scores(scores: DataFrame) -> None:
    """Daily news as read for a join: columns in order, as_of a time, means numeric, counts integers or numbers without a fraction."""
    want = ["as_of", "news_sent_mean", "news_risk_max", *NEWS_COUNTS]
    if scores.columns != want:
        raise ValueError(f"expected columns {want}, got {scores.columns}")
    kinds = {f.name: f.dataType for f in scores.schema}
    if kinds["as_of"].typeName() not in ("timestamp_ntz", "timestamp"):
        raise ValueError("as_of must be a timestamp")
    if words := [c for c in want[1:] if not isinstance(kinds[c], NumericType)]:
        raise ValueError(f"must be numeric: {words}")
    require(violations(scores, {f"not_whole_{c}": ~whole_number(c) for c in NEWS_COUNTS}))


def daily_news_violations(daily: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The daily aggregate's contract: nothing null, counts not negative, days unique per entity."""
    checks = _missing([*by, "as_of", "news_sent_mean", "news_risk_max", *NEWS_COUNTS]) | {f"negative_{c}": f"`{c}` < 0" for c in NEWS_COUNTS}
    return violations(daily, checks, [[*by, "as_of"]])


def manifest_violations(manifest: DataFrame, by: Sequence[str] = (), unique: Sequence[str] = ("call_date", "filename", "fiscal_period")) -> DataFrame:
    """The manifest's contract per entity: no call without a date, and call dates, file names and periods unique; nulls are not compared."""
    out = violations(manifest, _missing(["call_date"]))
    for c in unique:
        out = out.unionByName(violations(manifest.where(F.col(c).isNotNull()), {}, [[*by, c]]))
    return out


def check_manifest(manifest: DataFrame, by: Sequence[str] = ()) -> None:
    """Raise if the manifest is empty or its contract is broken."""
    if manifest.isEmpty():
        raise ValueError("the manifest is empty")
    require(manifest_violations(manifest, by))


def transcript_faults(text: Column, year: Column, markers: Sequence[str], least_chars: int = 8000) -> Column:
    """What a transcript lacks: too_short, no_<marker>, no_call_year; an empty array where nothing is wrong, too_short for a null text."""
    t = F.coalesce(text, F.lit(""))
    faults = [F.when(F.length(t) < least_chars, "too_short"), *[F.when(~F.contains(t, F.lit(m)), f"no_{m}") for m in markers], F.when(~F.contains(t, year.cast("string")), "no_call_year")]
    return F.array_compact(F.array(*faults))


def check_finite(table: DataFrame) -> None:
    """Raise if a number of a summary is null, NaN or infinite: such a summary must not replace a good one."""
    numbers = [f.name for f in table.schema if isinstance(f.dataType, NumericType)]
    odd = {f"not_finite_{c}": F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf")) for c in numbers}
    if odd:
        require(violations(table, odd))


def payload_violations(payloads: DataFrame, profile: dict) -> DataFrame:
    """(file, violation) of raw payloads against a profile; no row where all are sound.

    payloads: file, metadata (JSON text), articles (array of JSON texts), as from files.read_payloads. profile: `equal` (path in the
    metadata -> value, as text), `present` (paths), `lists` (paths of arrays that must not be empty), `each` (path of an array ->
    fields that all of its objects need), `not_after` (a pair of paths: the first date must not be after the second), and for
    articles `article_equal` (field -> value) and `article_range` (field, from path, to path).
    """
    m = lambda path: F.get_json_object("metadata", "$." + path)
    items = lambda path: F.from_json(m(path), "array<string>")
    differs = lambda field, value: lambda a: ~F.get_json_object(a, f"$.{field}").eqNullSafe(F.lit(value))
    lacks = lambda field: lambda x: F.get_json_object(x, f"$.{field}").isNull()
    checks: dict[str, Column] = {"no_metadata": F.col("metadata").isNull()}
    for path, value in profile.get("equal", {}).items():
        checks[f"not_equal_{path}"] = ~m(path).eqNullSafe(F.lit(value))
    for path in profile.get("present", ()):
        checks[f"missing_{path}"] = m(path).isNull()
    for path in profile.get("lists", ()):
        checks[f"empty_{path}"] = F.coalesce(F.size(items(path)), F.lit(0)) < 1
    for path, fields in profile.get("each", {}).items():
        for field in fields:
            checks[f"missing_{path}.{field}"] = F.exists(items(path), lacks(field))
    for first, second in profile.get("not_after", ()):
        checks[f"{first}_after_{second}"] = m(first).try_cast("date") > m(second).try_cast("date")
    if "article_equal" in profile or "article_range" in profile:
        checks["no_articles"] = F.coalesce(F.size("articles"), F.lit(0)) < 1
        checks["article_not_object"] = F.exists("articles", lambda a: ~F.coalesce(F.ltrim(a).startswith("{"), F.lit(False)))
    for field, value in profile.get("article_equal", {}).items():
        checks[f"article_{field}"] = F.exists("articles", differs(field, value))
    if "article_range" in profile:
        field, lo, hi = profile["article_range"]
        day = lambda a: F.substring(F.get_json_object(a, f"$.{field}"), 1, 10).try_cast("date")
        checks["article_out_of_range"] = F.exists("articles", lambda a: ~F.coalesce(day(a).between(m(lo).try_cast("date"), m(hi).try_cast("date")), F.lit(False)))
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), n) for n, c in checks.items()]))
    return payloads.select("file", F.explode(found).alias("violation"))


def check_payloads(payloads: DataFrame, profiles: dict[str, dict]) -> dict[str, str]:
    """file -> source of payloads whose metadata names one of the profiles' sources; raises for other sources and broken payloads."""
    of = {r["file"]: r["source"] for r in payloads.select("file", F.get_json_object("metadata", "$.source").alias("source")).collect()}
    if unknown := sorted({str(s) for s in of.values() if s not in profiles}):
        raise ValueError(f"unsupported sources: {unknown}")
    for source, profile in profiles.items():
        mine = payloads.where(F.get_json_object("metadata", "$.source") == source)
        if broken := [tuple(r) for r in payload_violations(mine, profile).limit(20).collect()]:
            raise ValueError(f"broken payloads: {broken}")
    return of
