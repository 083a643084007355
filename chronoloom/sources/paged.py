"""Sources behind requests: pages until there are no more, backfills to a first day, and what the answers of a service mean.

Only fetch_text opens connections, by a function that can be replaced; all else is given a function that fetches one page, so that it runs
against fakes.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import date, timedelta
from urllib.error import HTTPError, URLError
from urllib.request import Request, urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.operators.bars import BAR_COLUMNS
from chronoloom.operators.news import first_text, first_wins


class SourceError(RuntimeError):
    """A request that failed; status: the service's code."""

    def __init__(self, message: str, status: int | None = None) -> None:
        super().__init__(message)
        self.status = status


class TooMany(SourceError):
    """The service gives no more results (426)."""


class NotAllowed(SourceError):
    """The key or the plan does not allow it (401, 402, 403)."""


class Busy(SourceError):
    """Too many requests (429): wait and try again."""


class Unavailable(SourceError):
    """The service has failed for now (408, 5xx): try again."""


def error_of(status: int, detail: str = "") -> SourceError:
    """The error that an HTTP status stands for."""
    kinds = {426: TooMany, 401: NotAllowed, 402: NotAllowed, 403: NotAllowed, 429: Busy, 408: Unavailable}
    kind = kinds.get(status, Unavailable if status >= 500 else SourceError)
    return kind(f"HTTP {status}: {detail}", status)


def fetch_text(url: str, headers: dict[str, str] | None = None, timeout: float = 60.0, opener: Callable = urlopen) -> str:
    """What a URL answers, as text; raises the error that its status stands for, or Unavailable where there is no answer."""
    try:
        with opener(Request(url, headers=headers or {}), timeout=timeout) as answer:
            return answer.read().decode("utf-8", "replace")
    except HTTPError as e:
        raise error_of(e.code, e.read().decode("utf-8", "replace")[:200] if e.fp else str(e.reason)) from e
    except URLError as e:
        raise Unavailable(f"no answer: {e.reason}") from e


def fetch_json(url: str, **kw: object) -> object:
    """The same, read as JSON; an answer that is none is an error."""
    text = fetch_text(url, **kw)
    try:
        return json.loads(text)
    except ValueError as e:
        raise SourceError(f"no JSON: {text[:80]!r}") from e


def required_key(name: str, environment: dict[str, str]) -> str:
    """A key from the environment; raises if it is missing or blank."""
    if not (value := environment.get(name, "").strip()):
        raise ValueError(f"{name} is not set")
    return value


@dataclass
class Pages:
    """What a paged source gave: the records, the size of each page, why it stopped, and whether more were to be had."""

    records: list[dict] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    stop: str = ""
    capped: bool = False


def read_pages(fetch: Callable[[int, int], tuple[Sequence[dict], int | None]], page_size: int, most: int) -> Pages:
    """Pages 1, 2, .. of fetch(page, size) -> (records, total or None), `most` records at the most.

    Stops at an empty page, at the total, at a page shorter than asked for, at the cap, or where the service gives no more.
    """
    out = Pages()
    page = 0
    while len(out.records) < most:
        page, want = page + 1, min(page_size, most - len(out.records))
        try:
            records, total = fetch(page, want)
        except TooMany:
            out.stop = "no_more_given"
            return out
        out.sizes.append(len(records))
        out.records += records[:want]
        out.capped = out.capped or (total is not None and total > most)
        stops = (("empty_page", not records), ("total", total is not None and len(out.records) >= total), ("short_page", len(records) < want))
        if found := next((n for n, hit in stops if hit), ""):
            out.stop = found
            return out
    out.stop = "cap"
    return out


def read_days(fetch: Callable[[date, int, int], tuple[Sequence[dict], int | None]], first: date, last: date, page_size: int, most: int) -> tuple[dict[date, Pages], list[date]]:
    """Pages of each day from first to last, and the days whose results were cut off by the cap: with any, the collection is not complete."""
    if last < first:
        raise ValueError("the last day lies before the first")
    days = {}
    for k in range((last - first).days + 1):
        day = first + timedelta(days=k)
        days[day] = read_pages(lambda page, size, day=day: fetch(day, page, size), page_size, most)
    return days, [d for d, p in days.items() if p.capped]


@dataclass
class Backfill:
    """pages: records by page. complete: the oldest record is not after the first day wanted."""

    pages: list[Sequence[dict]]
    stop: str
    oldest: date | None
    newest: date | None
    complete: bool


def backfill(fetch: Callable[[int], Sequence[dict]], day_of: Callable[[dict], date], first: date, max_pages: int) -> Backfill:
    """Pages 0, 1, .. (newest first) until one's oldest record lies before `first` or a page is empty; raises if max_pages end before."""
    pages: list[Sequence[dict]] = []
    oldest = newest = None
    for page in range(max_pages):
        records = fetch(page)
        if not records:
            return Backfill(pages, "empty_page", oldest, newest, oldest is not None and oldest <= first)
        pages.append(records)
        days = [day_of(r) for r in records]
        oldest, newest = min([*days, *[d for d in (oldest,) if d]]), max([*days, *[d for d in (newest,) if d]])
        if min(days) < first:
            return Backfill(pages, "oldest_before_requested_start", oldest, newest, True)
    raise SourceError(f"{max_pages} pages do not reach {first}")


def collect_days(source: str, fetch: Callable[[date, int, int], tuple[Sequence[dict], int | None]], first: date, last: date, page_size: int, most: int, write: Callable[[dict], None]) -> int:
    """Collect a source day by day and write one payload {metadata, articles}; the exit status.

    Where the service does not allow it, an empty payload with a note is written (0). Where a day was cut off by the cap, nothing is written and what is
    there stays (1).
    """
    about: dict = {"source": source, "requested_range": {"from": first.isoformat(), "to": last.isoformat()}}
    try:
        days, cut_off = read_days(fetch, first, last, page_size, most)
    except NotAllowed as e:
        write({"metadata": about | {"collection_complete": False, "note": str(e)}, "articles": []})
        return 0
    if cut_off:
        return 1
    windows = [{"day": d.isoformat(), "result_count": len(p.records), "hit_record_cap": p.capped} for d, p in days.items()]
    chunking = {"strategy": "utc_day", "window_days": 1, "windows": windows}
    write({"metadata": about | {"collection_complete": True, "chunking": chunking}, "articles": [r for p in days.values() for r in p.records]})
    return 0


def retained(records: DataFrame, time: str, first: str, last: str, order: str, title: Sequence[str] = ("title", "headline"), stamp: Sequence[str] = ("publishedAt", "publishedDate", "date")) -> DataFrame:
    """Of collected records those from first to last (days, both included), and of equal ones (by title and time) the first by `order`."""
    inside = records.where(F.substring(F.col(time), 1, 10).try_cast("date").between(first, last))
    have = lambda names: [F.col(n) for n in names if n in records.columns]
    return first_wins(inside, [first_text(*have(title)), first_text(*have(stamp))], order)


def coverage(records: DataFrame, day: str, first: str, last: str) -> DataFrame:
    """One row: n_records, oldest, newest, n_days with records, and the days between first and last without any."""
    d = F.substring(F.col(day), 1, 10).try_cast("date")
    got = records.agg(F.count(F.lit(1)).alias("n_records"), F.min(d).alias("oldest"), F.max(d).alias("newest"), F.coalesce(F.collect_set(F.when(d.between(first, last), d)), F.array().cast("array<date>")).alias("days"))
    span = F.expr(f"sequence(DATE'{first}', DATE'{last}')")
    return got.select("n_records", "oldest", "newest", F.size("days").alias("n_days"), F.array_sort(F.array_except(span, "days")).alias("missing_days"))


def bars_of_download(rows: Sequence[dict], spark: SparkSession, columns: Sequence[str | tuple[str, ...]]) -> DataFrame:
    """Bars (date, open, high, low, close, volume) from a vendor's table: names may have levels (the first counts) and any case.

    Raises if it is empty or lacks a column; others are left out, rows come sorted by date.
    """
    if not rows:
        raise SourceError("no bars came back")
    names = {(c if isinstance(c, str) else c[0]).lower(): c for c in columns}
    if missing := [c for c in ("date", *BAR_COLUMNS) if c not in names]:
        raise SourceError(f"missing columns: {missing}")
    data = [(r[names["date"]], *[None if r[names[c]] is None else float(r[names[c]]) for c in BAR_COLUMNS]) for r in rows]
    return spark.createDataFrame(data, "date timestamp_ntz, " + ", ".join(f"{c} double" for c in BAR_COLUMNS)).orderBy("date")


def collect_transcripts(manifest: Sequence[dict], fetch: Callable[[str], str], extract: Callable[[str], str], faults: Callable[[str, dict], Sequence[str]], write: Callable[[str, str, bool], bool], exists: Callable[[str], bool], force: bool = False) -> dict[str, str]:
    """Fetch, extract, check and write the transcript of each manifest row; file name -> written, there, or what was wrong.

    Files that are there are not fetched again unless force; a page that fails its checks is not written.
    """
    out = {}
    for row in manifest:
        name = row["filename"]
        if exists(name) and not force:
            out[name] = "there"
            continue
        try:
            text = extract(fetch(row["source_url"]))
        except SourceError as e:
            out[name] = f"failed: {e}"
            continue
        wrong = list(faults(text, row))
        out[name] = f"rejected: {', '.join(wrong)}" if wrong else "written" if write(name, text, force) else "there"
    return out
