"""Resumable scoring of articles by an outside model: prompts, answers, costs, retries, limits and promotion.

A run goes in waves. Each wave takes the next pending articles (those whose key no checkpoint has), scores them in as many
tasks as requests may run at once, and appends the results to the checkpoint; between waves the driver adds up costs and
looks at the limits. A lost executor or a stopped run costs one wave. Prices, models and services are the caller's: a scorer is any
function of a prompt that gives (answer, usage).
"""

from __future__ import annotations

import json
import threading
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.operators import news
from chronoloom.operators.jobs import RateLimiter, drop_rate_exceeded, run_record, with_retries
from chronoloom.sources.files import append_checkpoint, load_checkpoint, promote, promote_all

TOKENS = ("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")
SCORES = "url string, title string, source_name string, published_at timestamp_ntz, sentiment_score double, risk_score double, topic_tags array<string>, " + ", ".join(f"{t} bigint" for t in TOKENS) + ", total_cost_usd double, seq bigint"
ANSWER = "sentiment_score double, risk_score double, topic_tags array<string>"


class Unreadable(Exception):
    """An answer that does not have the wanted form; asked for again, then dropped."""


class Refused(ConnectionError):
    """The service has too much to do; the rate goes down and the request is made again."""


class Fatal(Exception):
    """No further request makes sense; the run stops and keeps what it has."""


Scorer = Callable[[str], tuple[str, Mapping[str, int]]]


def answer_of_blocks(response: Mapping) -> tuple[str, dict[str, int]]:
    """(answer, usage) of a response whose content is a list of blocks, one of them with the parsed output."""
    for block in response.get("content") or ():
        if isinstance(block, Mapping) and block.get("parsed_output") is not None:
            usage = response.get("usage") or {}
            return json.dumps(block["parsed_output"]), {t: int(usage.get(t) or 0) for t in TOKENS}
    raise Unreadable("no parsed output")


def answer_of_candidates(response: Mapping) -> tuple[str, dict[str, int]]:
    """(answer, usage) of a response with candidates, the first of which holds the answer as text; without usage it is unreadable."""
    try:
        text = response["candidates"][0]["content"]["parts"][0]["text"]
        usage = response["usageMetadata"]
        counts = {"input_tokens": int(usage.get("promptTokenCount") or 0), "output_tokens": int(usage.get("candidatesTokenCount") or 0)}
    except (KeyError, IndexError, TypeError, AttributeError) as e:
        raise Unreadable(f"no candidate: {e!r}") from e
    if not isinstance(text, str) or not text.strip():
        raise Unreadable("an empty text")
    return text, counts


def prompt(task: str, fields: Mapping[str, Column]) -> Column:
    """A task and the named fields, a line each; null fields are empty."""
    return F.concat_ws("\n", F.lit(task), F.lit(""), *[F.concat(F.lit(f"{n}: "), F.coalesce(c.cast("string"), F.lit(""))) for n, c in fields.items()])


def parsed_answer(text: Column) -> Column:
    """A struct of sentiment_score, risk_score and topic_tags (known ones, in canonical order) from an answer in JSON.

    Null where the answer is no object of that form, a score is missing or out of range (-1..1, 0..1), or a tag is unknown.
    Missing tags are none.
    """
    a = F.from_json(text, ANSWER, {"mode": "PERMISSIVE"})
    tags = F.coalesce(a["topic_tags"], F.array().cast("array<string>"))
    # a value of another type would be read as null, and so is told from one that is not there
    listed = F.get_json_object(text, "$.topic_tags").isNull() | a["topic_tags"].isNotNull()
    known = F.forall(tags, lambda t: F.coalesce(t.isin(*news.TAGS), F.lit(False)))
    good = a["sentiment_score"].between(-1, 1) & a["risk_score"].between(0, 1) & listed & known
    return F.when(F.coalesce(good, F.lit(False)), F.struct(a["sentiment_score"].alias("sentiment_score"), a["risk_score"].alias("risk_score"), news.normalise_tags(tags).alias("topic_tags")))


def read_answer(text: str) -> dict:
    """parsed_answer() of one answer, in a task, where an unreadable one is asked for again."""
    try:
        a = json.loads(text)
        number = lambda k, lo: lo <= a[k] <= 1 and not isinstance(a[k], bool)
        tags = a.get("topic_tags", [])
        if number("sentiment_score", -1) and number("risk_score", 0) and isinstance(tags, list) and set(tags) <= set(news.TAGS):
            return {"sentiment_score": float(a["sentiment_score"]), "risk_score": float(a["risk_score"]), "topic_tags": [t for t in news.TAGS if t in tags]}
    except (ValueError, TypeError, KeyError, AttributeError):
        pass
    raise Unreadable(str(text)[:200])


def token_cost(rates: Mapping[str, float]) -> Column:
    """The cost of a row's tokens: for each token column its rate per million. Null counts are 0."""
    return sum((F.coalesce(F.col(t), F.lit(0)) / 1_000_000 * F.lit(float(r)) for t, r in rates.items()), F.lit(0.0))


def cost_totals(scores: DataFrame, n_articles: int, n_dropped: int, cap: float) -> DataFrame:
    """One row: scored, dropped, remaining, tokens, cost, and what share of the cap it is (infinite for a cap of 0 or less, 0 if there is no cost either)."""
    sums = scores.agg(F.count(F.lit(1)).alias("scored"), F.coalesce(F.sum("total_cost_usd"), F.lit(0.0)).alias("total_cost_usd"), *[F.coalesce(F.sum(t), F.lit(0)).alias(t) for t in TOKENS[:2]])
    share = F.col("total_cost_usd") / cap if cap > 0 else F.when(F.col("total_cost_usd") > 0, float("inf")).otherwise(0.0)
    return sums.select("scored", F.lit(n_dropped).cast("bigint").alias("dropped"), F.greatest(F.lit(n_articles) - F.col("scored") - n_dropped, F.lit(0)).alias("remaining"), *TOKENS[:2], "total_cost_usd", share.alias("cap_share"))


@dataclass(frozen=True)
class Limits:
    """cost_cap: stop at this cost or more. max_drop_rate: of all articles. max_new: articles at most in this run. wave: articles
    between two looks at the limits. at_once: requests that run at the same time. retries: after refusals."""

    cost_cap: float
    max_drop_rate: float = 0.01
    max_new: int | None = None
    wave: int = 256
    at_once: int = 16
    per_minute: float = 600.0
    least_per_minute: float = 60.0
    retries: int = 5
    pause: float = 1.0
    longest_pause: float = 60.0
    alerts: Sequence[float] = ()

    def __post_init__(self) -> None:
        if min(self.wave, self.at_once, self.per_minute, self.least_per_minute) <= 0 or self.per_minute < self.least_per_minute:
            raise ValueError("wave, at_once and rates must be positive, and the rate not below the least")
        if self.retries < 0 or self.pause < 0 or self.longest_pause < 0 or (self.max_new is not None and self.max_new < 0):
            raise ValueError("retries, pauses and max_new must not be negative")


@dataclass
class Outcome:
    """status: done, partial (max_new reached), cap, drops, failed or nothing. code: 0 for done and partial, else 1."""

    status: str
    code: int
    scored: int = 0
    dropped: int = 0
    resumed: int = 0
    cost: float = 0.0
    message: str = ""
    alerts: list[float] = field(default_factory=list)


def score_wave(pending: DataFrame, scorer: Scorer, limits: Limits, rates: Mapping[str, float], attempts: int = 2) -> DataFrame:
    """The pending rows (SCORES' keys, seq and prompt) with their scores; `problem` says why there is none: unreadable, or fatal with a text.

    Each task has its share of the rate and lowers it on refusals. A task that meets a fatal error makes no further request.
    """
    rate, least, tasks = limits.per_minute / limits.at_once, limits.least_per_minute / limits.at_once, limits.at_once

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        limiter = RateLimiter(rate, least, rate)
        stop = ""

        def one(text: str) -> dict:
            answer, usage = with_retries(lambda: scorer(text), limiter, limits.retries, limits.pause, limits.longest_pause, Refused)
            tokens = {t: int(usage.get(t) or 0) for t in TOKENS}
            return read_answer(answer) | tokens | {"total_cost_usd": sum(tokens[t] / 1_000_000 * r for t, r in rates.items())}

        for pdf in batches:
            rows = []
            for text in pdf["prompt"].tolist():
                row: dict = {"problem": f"fatal: {stop}"} if stop else {"problem": "unreadable"}
                for _ in range(0 if stop else attempts):
                    try:
                        row = one(text) | {"problem": None}
                        break
                    except Unreadable:
                        continue
                    except Exception as e:  # a refusal after all retries, or what the scorer can't go on from
                        stop = f"{type(e).__name__}: {e}"
                        row = {"problem": f"fatal: {stop}"}
                        break
                rows.append(row)
            out = pd.DataFrame(rows, columns=["sentiment_score", "risk_score", "topic_tags", *TOKENS, "total_cost_usd", "problem"])
            out["topic_tags"] = pd.Series([r.get("topic_tags") for r in rows], dtype=object)  # None, not NaN
            for t in TOKENS:
                out[t] = out[t].astype("Int64")
            yield pd.concat([pdf.drop(columns="prompt").reset_index(drop=True), out], axis=1)

    kept = "url string, title string, source_name string, published_at timestamp_ntz, seq bigint"
    spread = pending.select("url", "title", "source_name", "published_at", "seq", "prompt").repartitionByRange(tasks, "seq")
    order = [c.split()[0] for c in SCORES.split(", ")]
    return spread.mapInPandas(run, f"{kept}, {ANSWER}, " + ", ".join(f"{t} bigint" for t in TOKENS) + ", total_cost_usd double, problem string").select(*order, "problem")


def next_pending(articles: DataFrame, done: DataFrame, most: int | None, order: str = "seq") -> DataFrame:
    """The first `most` articles, in order, whose key is not among the done ones; of one key the first. A negative limit is an error."""
    if most is not None and most < 0:
        raise ValueError("the limit must not be negative")
    left = news.first_wins(news.pending(articles, done), [F.col(k) for k in news.KEY], order).orderBy(order)
    return left if most is None else left.limit(most)


def run_scoring(
    articles: DataFrame, scorer: Scorer, limits: Limits, rates: Mapping[str, float], checkpoint: str, raw_path: str, daily_path: str,
    resume: bool = True, run_id: str = "run", alert: Callable[[float, Outcome], None] | None = None, log: Callable[[str], None] | None = None,
) -> Outcome:
    """Score the articles (SCORES' key columns, seq, prompt) and promote the raw and the daily table together.

    Nothing is promoted, and what is there stays, if the cost reaches the cap, too many articles are dropped, none is scored, an error is
    fatal, or max_new leaves some for a later run; the checkpoint keeps what was scored, and a run that resumes goes on from it. Each alert
    share of the cap is told once, and not if the checkpoint had reached it before. Articles without url, title and published_at are
    scored like others; repeated keys once.
    """
    spark: SparkSession = articles.sparkSession
    compact, lines = f"{checkpoint}/compact", f"{checkpoint}/lines-{run_id}"
    kept = load_checkpoint(spark, compact, lines, SCORES, news.KEY) if resume else spark.createDataFrame([], f"{SCORES}, first_seen bigint")
    kept = kept.drop("first_seen")
    n_articles = articles.select(*news.KEY).distinct().count()
    out = Outcome("nothing", 1)

    def totals(scores: DataFrame) -> None:
        r = cost_totals(scores, n_articles, out.dropped, limits.cost_cap).first()
        out.scored, out.cost = r["scored"], r["total_cost_usd"]
        if log:
            log(run_record(run_id, **r.asDict()))
        for share in sorted(limits.alerts):
            if r["cap_share"] >= share and share not in reached:
                reached.add(share)
                if alert and told[0]:
                    out.alerts.append(share)
                    alert(share, out)

    reached: set[float] = set()
    told = [False]  # what the checkpoint had reached is no news
    totals(kept)
    told[0], out.resumed = True, out.scored

    def ended(status: str, message: str = "") -> Outcome:
        out.status, out.code, out.message = status, int(status not in ("done", "partial")), message
        return out

    if out.cost >= limits.cost_cap:
        return ended("cap", "the checkpoint has reached the cost cap")
    new, scores, dropped = 0, kept, spark.createDataFrame([], "url string, title string, published_at timestamp_ntz")
    seen = kept.select(*news.KEY)
    while True:
        most = limits.wave if limits.max_new is None else min(limits.wave, limits.max_new - new)
        wave = next_pending(articles, seen, most)
        path = f"{checkpoint}/waves-{run_id}/{new}-{out.dropped}-{out.scored}"
        promote(score_wave(wave, scorer, limits, rates), path)  # asked for once, whatever reads it
        got = spark.read.parquet(path)
        n, bad, fatal = got.agg(F.count_if(F.col("problem").isNull()), F.count_if(F.col("problem") == "unreadable"), F.min(F.when(F.col("problem").startswith("fatal"), F.col("problem")))).first()
        good = got.where("problem is null").drop("problem")
        append_checkpoint(good, lines, run_id)
        scores = load_checkpoint(spark, compact if resume else None, lines, SCORES, news.KEY).drop("first_seen")
        dropped = dropped.unionByName(got.where("problem = 'unreadable'").select(*news.KEY))
        seen = scores.select(*news.KEY).unionByName(dropped)
        new, out.dropped = new + n + bad, out.dropped + bad
        totals(scores)
        if out.cost >= limits.cost_cap:
            return ended("cap", f"cost {out.cost:.6f} has reached the cap {limits.cost_cap:.2f}")
        if fatal:
            return ended("failed", fatal)
        if n + bad < most or (limits.max_new is not None and new >= limits.max_new):
            break
    promote(scores, compact)
    if not out.scored:
        return ended("nothing", "no article was scored")
    if drop_rate_exceeded(out.dropped, n_articles, limits.max_drop_rate):
        return ended("drops", f"{out.dropped} of {n_articles} were dropped")
    if out.scored + out.dropped < n_articles:
        return ended("partial", f"{n_articles - out.scored - out.dropped} are left for a later run")
    raw = spark.read.parquet(compact).orderBy("seq")
    day = F.date_trunc("day", F.col("published_at")).cast("timestamp_ntz")
    daily = news.daily_news(raw, day, by=()).withColumnRenamed("as_of_day", "as_of")
    promote_all({raw_path: raw, daily_path: daily})
    return ended("done")


def submit_bounded(calls: Sequence[Callable[[], object]], at_once: int) -> list[object]:
    """The results of calls made on the driver, at most `at_once` at a time, in the order given; after the first that fails no other
    begins, and its error is raised. For requests that must not run in tasks."""
    if at_once < 1:
        raise ValueError("at_once must be positive")
    out: list[object] = [None] * len(calls)
    rest, lock, failed = iter(enumerate(calls)), threading.Lock(), []

    def work() -> None:
        while not failed:
            with lock:
                item = next(rest, None)
            if item is None:
                return
            try:
                out[item[0]] = item[1]()
            except Exception as e:
                failed.append(e)

    threads = [threading.Thread(target=work) for _ in range(min(at_once, len(calls)))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    if failed:
        raise failed[0]
    return out


def score_transcripts(manifest: DataFrame, texts: DataFrame, scorer: Callable[[list[str]], list[tuple[float, float, float]]]) -> DataFrame:
    """Per call of the manifest (call_date, filename): the aggregate of its transcript's sentences, ordered by call_date.

    texts: (file, text), as from files.read_texts; a file belongs to the manifest row whose filename it ends with. Raises if a transcript is
    missing or has no sentence of four words: such a call must not silently drop out.
    """
    from chronoloom.functions import text as tx

    named = texts.select(F.element_at(F.split("file", "/"), -1).alias("filename"), "text")
    each = manifest.select("call_date", "filename").join(named, "filename", "left").withColumn("sentence", tx.sentences(F.col("text")))
    empty = each.where(F.coalesce(F.size("sentence"), F.lit(0)) < 1).select("filename").limit(5).collect()
    if empty:
        raise ValueError(f"no transcript or no sentences: {sorted(r['filename'] for r in empty)}")
    scored = tx.score_sentences(each.select("call_date", F.explode("sentence").alias("sentence")), "sentence", scorer)
    return tx.call_aggregate(scored, "call_date").drop("n_sentences").orderBy("call_date")
