"""Timestamps in mixed formats and zones, brought to one UTC instant.

The text is matched against an ordered cascade of anchored patterns; the first that matches decides how
it is read, and reading is strict (30 February or 25:00 name no instant). A zone in the text holds;
otherwise a default zone applies, usually from a lookup by source. Wall-clock times that occur twice or
not at all at a clock change follow an explicit policy.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Zone abbreviations and their offsets from UTC.
ABBREVIATIONS = {
    "Z": "+00:00", "UTC": "+00:00", "GMT": "+00:00", "WET": "+00:00",
    "BST": "+01:00", "CET": "+01:00", "WEST": "+01:00", "CEST": "+02:00", "EET": "+02:00", "EEST": "+03:00",
    "IST": "+05:30", "JST": "+09:00", "KST": "+09:00", "AEST": "+10:00", "AEDT": "+11:00",
    "EST": "-05:00", "EDT": "-04:00", "CST": "-06:00", "CDT": "-05:00",
    "MST": "-07:00", "MDT": "-06:00", "PST": "-08:00", "PDT": "-07:00",
}
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

_MONTH = r"(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\.?"
_DAY = r"(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?(?:\s*([ap]m)(?![a-z]))?"
_ZONE = r"(?:\s*(z|[a-z]{2,5}|[+-]\d{2}:?\d{2}|[a-z]+(?:/[a-z0-9_+\-]+)+))?"
_TIME = rf"(?:(?:t|,?\s+){_CLOCK}{_ZONE})?"


@dataclass(frozen=True)
class Pattern:
    """regex: anchored, matched without regard to case. year, month, day: its groups of the date; in ordered
    ones date_order decides which of the two is the month. The clock's five groups and the zone follow."""

    name: str
    regex: str
    year: int = 1
    month: int = 2
    day: int = 3
    ordered: bool = False


PATTERNS = (
    Pattern("iso", rf"(?i)^(\d{{4}})-(\d{{2}})-(\d{{2}}){_TIME}$"),
    Pattern("basic", rf"(?i)^(\d{{4}})(\d{{2}})(\d{{2}})(?:t(\d{{2}})(\d{{2}})(\d{{2}})?(?:[.,](\d{{1,9}}))?([ap]m)?{_ZONE})?$"),
    Pattern("day_month_name", rf"(?i)^(?:{_DAY})?(\d{{1,2}})\s+{_MONTH},?\s+(\d{{4}}|\d{{2}}){_TIME}$", year=3, month=2, day=1),
    Pattern("month_name_day", rf"(?i)^(?:{_DAY})?{_MONTH}\s+(\d{{1,2}}),?\s+(\d{{4}}){_TIME}$", year=3, month=1, day=2),
    Pattern("slashed", rf"(?i)^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}|\d{{2}}){_TIME}$", year=3, month=1, day=2, ordered=True),
    Pattern("dotted", rf"(?i)^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}|\d{{2}}){_TIME}$", year=3, month=2, day=1),
)
EDGES = " \t\r\n\v\f\u00a0\u2009\u200b\ufeff"


def _fields(s: Column, date_order: Column, patterns: tuple[Pattern, ...]) -> Column:
    """year|month|day|hour|minute|second|fraction|am or pm|zone, unchecked, by the first pattern that matches."""
    out = F.lit(None).cast("string")
    for p in reversed(patterns):
        as_is = F.regexp_replace(s, p.regex, f"${p.year}|${p.month}|${p.day}|$4|$5|$6|$7|$8|$9")
        if p.ordered:
            turned = F.regexp_replace(s, p.regex, f"${p.year}|${p.day}|${p.month}|$4|$5|$6|$7|$8|$9")
            as_is = F.when(date_order == "MDY", as_is).when(date_order == "DMY", turned)
        out = F.when(s.rlike(p.regex), as_is).otherwise(out)
    return out


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def utc_of_local(local: Column, zone: Column, ambiguous: str = "first", nonexistent: str = "before") -> Column:
    """The UTC wall clock (TIMESTAMP_NTZ) of a local one.

    ambiguous (times that occur twice): first, last or null. nonexistent (times that are skipped): before
    or after (read with the offset before or after the change) or null. zone: an IANA name or an offset.
    """
    plain = F.call_function("convert_timezone", zone, F.lit("UTC"), local)  # first; before
    if (ambiguous, nonexistent) == ("first", "before"):
        return plain
    day = F.expr("interval 1 day")
    back = lambda u: F.call_function("convert_timezone", F.lit("UTC"), zone, u)
    old, new = back(plain - day) - (plain - day), back(plain + day) - (plain + day)
    early, late = local - old, local - new
    gap = back(plain) != local
    twice = ~gap & (old != new) & (back(early) == local) & (back(late) == local)
    return (
        F.when(gap, {"before": plain, "after": late, "null": F.lit(None).cast("timestamp_ntz")}[nonexistent])
        .when(twice, {"first": plain, "last": F.greatest(early, late), "null": F.lit(None).cast("timestamp_ntz")}[ambiguous])
        .otherwise(plain)
    )


def millis(ntz: Column) -> Column:
    """Milliseconds since 1970 of a UTC wall clock, whatever the session's zone."""
    seconds = F.date_part(F.lit("SECOND"), ntz)
    whole = F.unix_date(ntz.cast("date")).cast("bigint") * 86_400_000 + F.hour(ntz) * 3_600_000 + F.minute(ntz) * 60_000
    return whole + F.floor(seconds * 1000).cast("bigint")


def with_utc_millis(df: DataFrame, text: str, default_zone: Column, date_order: Column, out: str, *, ambiguous: str = "first", nonexistent: str = "before", patterns: tuple[Pattern, ...] = PATTERNS) -> DataFrame:
    """Add `out`: milliseconds since 1970 UTC of the instant that the column `text` names, or null if none.

    Surrounding white space is passed over; null, blank and unknown texts give null. default_zone: used
    where the text has no zone; where it is null or unknown too, the text names no instant. date_order:
    MDY or DMY for slashed dates; with anything else those name no instant. Eight digits are a day; other
    runs of digits are seconds (under 12 digits) or milliseconds since 1970. Zones in the text are offsets,
    known abbreviations or IANA names. No time of day means midnight. Rows and other columns stay as they are.
    """
    names = ", ".join(f"'{n}'" for n in sorted(df.sparkSession._jvm.java.time.ZoneId.getAvailableZoneIds()))
    s, parts, local, zone, fixed, rule, wall = (f"__{x}_{out}" for x in ("s", "parts", "local", "zone", "fixed", "rule", "wall"))
    part = lambda i: F.element_at(F.col(parts), i)

    df = df.withColumn(zone, default_zone).withColumn(s, F.trim(F.col(text), F.lit(EDGES)))
    df = df.withColumn(parts, F.split(_fields(F.col(s), date_order, patterns), r"\|"))

    year = F.when(F.length(part(1)) == 2, F.concat(F.lit("20"), part(1))).otherwise(part(1))
    month = F.when(part(2).rlike(r"^\d"), F.lpad(part(2), 2, "0")).otherwise(_lookup({m: f"{i:02}" for i, m in enumerate(MONTHS, 1)}, F.lower(F.substring(part(2), 1, 3))))
    number = part(4).try_cast("int")
    half = F.lower(part(8))
    hour = F.when(part(4) == "", F.lit(0)).when(half == "", number).when(number.between(1, 12), number % 12 + F.when(half == "pm", 12).otherwise(0))
    two = lambda c: F.when(c == "", F.lit("00")).otherwise(c)
    clock = F.concat(F.lpad(hour.cast("string"), 2, "0"), F.lit(":"), two(part(5)), F.lit(":"), two(part(6)), F.lit("."), F.rpad(F.substring(part(7), 1, 6), 6, "0"))
    written = F.when(hour < 24, F.concat(year, F.lit("-"), month, F.lit("-"), F.lpad(part(3), 2, "0"), F.lit(" "), clock))
    # a fixed offset is arithmetic; only named zones with a history need the zone rules
    signed = F.regexp_replace(part(9), r"^([+-]\d{2}):?(\d{2})$", "$1$2").try_cast("int")
    minutes = {k: str((60 * int(v[1:3]) + int(v[4:])) * (-1 if v[0] == "-" else 1)) for k, v in ABBREVIATIONS.items()}
    df = df.withColumns({local: written.try_cast("timestamp_ntz"), zone: F.when(part(9) == "", F.col(zone)).otherwise(part(9))})
    df = df.withColumn(
        fixed,
        F.when(F.col(zone).rlike(r"^[+-](?:0\d|1[0-7]):?[0-5]\d$|^[+-]18:?00$"), F.signum(signed) * (F.floor(F.abs(signed) / 100) * 60 + F.abs(signed) % 100))
        .when(F.length(zone) <= 5, _lookup(minutes, F.upper(F.col(zone))).cast("int"))
        .cast("bigint"),
    )
    rules = F.when(F.col(fixed).isNull(), F.when(F.expr(f"`{zone}` IN ({names})"), F.col(zone)))
    df = df.withColumn(rule, rules)
    text_, size = F.col(s), F.length(F.col(s))
    count = F.when(text_.rlike(r"^\d{1,15}$") & (size != 8), text_.cast("bigint"))
    epoch = F.when(size < 12, count * 1000).otherwise(count)
    # a step of its own, so that it is computed once
    df = df.withColumn(wall, F.when(F.col(fixed).isNotNull(), F.col(local)).when(F.col(rule).isNotNull(), utc_of_local(F.col(local), F.col(rule), ambiguous, nonexistent)))
    value = F.coalesce(epoch, millis(F.col(wall)) - F.coalesce(F.col(fixed), F.lit(0)) * 60_000)
    # out of a generator, so that no filter on it is pushed below and all steps are computed there again
    return df.select("*", F.explode(F.array(value)).alias(out)).drop(s, parts, local, zone, fixed, rule, wall)
