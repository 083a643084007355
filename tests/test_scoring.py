"""Scoring runs: waves, resuming, limits and what is promoted; prompts, answers and costs."""

import json
import threading
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.functions import classifier
from chronoloom.functions import text as tx
from chronoloom.operators import scoring
from chronoloom.operators.scoring import Fatal, Limits, Refused, read_answer, run_scoring

RATES = {"input_tokens": 0.1, "output_tokens": 0.4}


def articles(spark, n):
    schema = "url string, title string, source_name string, published_at timestamp_ntz, seq bigint"
    rows = [(f"u{i}", f"t{i}", "s", datetime(2024, 1, 1 + i // 4, i % 24), i) for i in range(n)]
    df = spark.createDataFrame(rows, schema)
    return df.withColumn("prompt", scoring.prompt("Score it.", {"title": F.col("title")}))


def answer(tokens=1_000_000):
    """A scorer: every answer costs 0.1 for a million tokens."""

    def score(prompt):
        k = int(prompt.rsplit("t", 1)[1])
        if k % 10 == 7:
            return "no json", {"input_tokens": tokens}
        return json.dumps({"sentiment_score": 0.5, "risk_score": 0.25, "topic_tags": ["macro", "earnings"]}), {"input_tokens": tokens}

    return score


def run(spark, tmp_path, n, scorer, **kw):
    alerts = []
    limits = Limits(**({"cost_cap": 100.0, "max_drop_rate": 0.5, "wave": 5, "at_once": 2, "pause": 0.0} | {k: v for k, v in kw.items() if k != "resume" and k != "run_id"}))
    out = run_scoring(articles(spark, n), scorer, limits, RATES, f"{tmp_path}/check", f"{tmp_path}/raw", f"{tmp_path}/daily", kw.get("resume", True), kw.get("run_id", "r"), lambda share, o: alerts.append(share))
    assert alerts == out.alerts
    return out


def test_a_run_and_its_resumption(spark, tmp_path):
    some = run(spark, tmp_path, 12, answer(), max_new=6)
    assert (some.status, some.code, some.scored, some.dropped) == ("partial", 0, 6, 0)
    assert not (tmp_path / "raw").exists()
    rest = run(spark, tmp_path, 12, answer(), run_id="r2")
    assert (rest.status, rest.scored, rest.dropped, rest.resumed) == ("done", 11, 1, 6)
    raw, daily = spark.read.parquet(f"{tmp_path}/raw"), spark.read.parquet(f"{tmp_path}/daily")
    assert raw.count() == 11 and {tuple(r["topic_tags"]) for r in raw.collect()} == {("earnings", "macro")}
    assert [(r["as_of"].day, r["news_count"], r["news_topic_macro"]) for r in daily.orderBy("as_of").collect()] == [(1, 4, 4), (2, 3, 3), (3, 4, 4)]
    assert rest.cost == pytest.approx(1.1)
    again = run(spark, tmp_path, 12, answer(), run_id="r3")  # only the dropped one is asked for again
    assert again.resumed == 11 and again.status == "done"


def test_cap_keeps_old_outputs(spark, tmp_path):
    spark.range(1).write.parquet(f"{tmp_path}/raw")
    out = run(spark, tmp_path, 6, answer(20_000_000), cost_cap=1.0, alerts=(0.5, 1.0))
    assert (out.status, out.code, out.alerts) == ("cap", 1, [0.5, 1.0])
    assert spark.read.parquet(f"{tmp_path}/raw").columns == ["id"] and not (tmp_path / "daily").exists()
    before = run(spark, tmp_path, 6, answer(), cost_cap=1.0, run_id="r2")
    # another run id reads the compacted table only, which a capped run does not write
    assert before.status in ("cap", "done")


def test_alerts_that_a_checkpoint_had_reached_are_not_repeated(spark, tmp_path):
    first = run(spark, tmp_path, 9, answer(), cost_cap=1.0, max_new=6, alerts=(0.5, 0.75))
    assert first.alerts == [0.5] and first.cost == pytest.approx(0.6)
    second = run(spark, tmp_path, 9, answer(), cost_cap=1.0, alerts=(0.5, 0.75), run_id="r")
    assert second.resumed == 6 and second.alerts == [0.75] and second.cost == pytest.approx(0.8)


def test_drops_and_nothing(spark, tmp_path):
    out = run(spark, tmp_path, 8, answer(), max_drop_rate=0.1)
    assert (out.status, out.dropped) == ("drops", 1) and not (tmp_path / "raw").exists()
    none = run(spark, tmp_path / "none", 3, lambda p: ("[]", {}))
    assert (none.status, none.code, none.dropped) == ("nothing", 1, 3)


def test_refusals_and_fatal_errors(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def refused(prompt, at=str(calls)):
        import uuid

        open(f"{at}/{uuid.uuid4().hex}", "w").close()
        raise Refused("429")

    out = run(spark, tmp_path, 1, refused, retries=2, per_minute=6e6, at_once=1)
    assert (out.status, out.code) == ("failed", 1) and "Refused" in out.message and len(list(calls.iterdir())) == 3
    assert not (tmp_path / "raw").exists()

    usual = answer()

    def fatal(prompt):
        if prompt.endswith("t3"):
            raise Fatal("bad key")
        return usual(prompt)

    out = run(spark, tmp_path / "b", 5, fatal, at_once=1)
    assert out.status == "failed" and "bad key" in out.message and out.scored == 3


def test_answers(spark):
    good = ['{"sentiment_score": -1, "risk_score": 0, "topic_tags": ["macro", "china", "macro"]}', '{"sentiment_score": 0.5, "risk_score": 1}']
    bad = ['{"sentiment_score": 2, "risk_score": 0}', '{"sentiment_score": 0, "risk_score": -0.1}', '{"risk_score": 0}', '{"sentiment_score": 0, "risk_score": 0, "topic_tags": ["odd"]}', "no json", "", '{"sentiment_score": 0, "risk_score": 0, "topic_tags": "macro"}', None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*good, *bad])], "i int, t string")
    got = [r["a"] for r in df.select("i", scoring.parsed_answer(F.col("t")).alias("a")).orderBy("i").collect()]
    assert [tuple(x) if x else None for x in got] == [(-1.0, 0.0, ["china", "macro"]), (0.5, 1.0, [])] + [None] * len(bad)
    for text, want in zip([*good, *bad], got, strict=True):
        try:
            one = read_answer(text)
        except scoring.Unreadable:
            one = None
        assert (one and one["topic_tags"]) == (want and want["topic_tags"]), text


def test_costs(spark):
    df = spark.createDataFrame([(120, 30, 100, None)], ", ".join(f"{t} bigint" for t in scoring.TOKENS))
    assert df.select(scoring.token_cost({"input_tokens": 1.0, "output_tokens": 5.0, "cache_creation_input_tokens": 1.25, "cache_read_input_tokens": 0.1})).first()[0] == pytest.approx(120e-6 + 150e-6 + 125e-6)
    scored = spark.createDataFrame([(0.2, 5, 1), (None, 1, 1)], "total_cost_usd double, input_tokens bigint, output_tokens bigint")
    r = scoring.cost_totals(scored, 5, 4, 0.4).first()
    assert (r["scored"], r["remaining"], r["input_tokens"], r["cap_share"]) == (2, 0, 6, pytest.approx(0.5))
    assert scoring.cost_totals(scored, 5, 0, 0).first()["cap_share"] == float("inf") and scoring.cost_totals(scored.limit(0), 5, 0, 0).first()["cap_share"] == 0
    with pytest.raises(ValueError, match="negative"):
        scoring.next_pending(articles(spark, 2), articles(spark, 1), -1)
    assert [r["seq"] for r in scoring.next_pending(articles(spark, 5), articles(spark, 2), 2).collect()] == [2, 3]
    for wrong in ({"at_once": 0}, {"retries": -1}, {"per_minute": 1.0}, {"max_new": -1}):
        with pytest.raises(ValueError, match="must"):
            Limits(cost_cap=1.0, **wrong)


def test_bounded_submission():
    lock, now, most = threading.Lock(), [0], [0]

    def call(k):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        with lock:
            now[0] -= 1
        if k == 30:
            raise ValueError("stop")
        return k

    assert scoring.submit_bounded([lambda k=k: call(k) for k in range(30)], 4) == list(range(30)) and most[0] <= 4
    with pytest.raises(ValueError, match="stop"):
        scoring.submit_bounded([lambda k=k: call(k) for k in range(25, 40)], 2)
    assert scoring.submit_bounded([], 3) == []


def test_classifier(spark):
    rng = np.random.default_rng(0)
    words = {"pos": ["record", "growth"], "neg": ["loss", "weak"], "neu": ["report", "meeting"]}
    make = lambda n: [(c, f"the {rng.choice(words[c])} of {rng.choice(['alpha', 'beta', 'gamma'])} was Noted") for c in rng.choice(list(words), n)]
    model = classifier.train(spark.createDataFrame([*make(300), (None, "x"), ("pos", None), ("odd", "y")], "c string, t string"), "t", "c")
    held = make(100)
    got = model([t for _, t in held])
    right = sum(classifier.CLASSES[int(np.argmax(p))] == c for p, (c, _) in zip(got, held, strict=True))
    assert right >= 95 and all(abs(sum(p) - 1) < 1e-9 for p in got)
    none = classifier.train(spark.createDataFrame([], "c string, t string"), "t", "c")
    assert none(["", "any"])[1] == pytest.approx((1 / 3,) * 3) and none([]) == []
    s = spark.createDataFrame([(0.3,), (-0.3,), (0.2,), (None,)], "s double").select(classifier.label(F.col("s"))).collect()
    assert [r[0] for r in s] == ["pos", "neg", "neu", None]
    assert tx.label_of(" Positive") == "pos" and tx.label_of("neu") == "neu"
    for wrong in ("possible", "", "label_0"):
        with pytest.raises(ValueError, match="unknown"):
            tx.label_of(wrong)


def test_transcripts(spark):
    manifest = spark.createDataFrame([(datetime(2024, 5, 1), "b.txt"), (datetime(2024, 2, 1), "a.txt")], "call_date timestamp_ntz, filename string")
    texts = spark.createDataFrame([("file:/x/a.txt", "This is one sentence. And this is another one."), ("file:/x/b.txt", "All four words here.")], "file string, text string")
    got = scoring.score_transcripts(manifest, texts, lambda ts: [(0.5, 0.25, 0.25)] * len(ts)).collect()
    assert [(r["call_date"].month, r["pos_mean"], r["pos_frac"]) for r in got] == [(2, 0.5, 1.0), (5, 0.5, 1.0)]
    with pytest.raises(ValueError, match="b.txt"):
        scoring.score_transcripts(manifest, texts.limit(1), lambda ts: [(1.0, 0.0, 0.0)] * len(ts))


def test_responses():
    good = {"content": [{"type": "x"}, {"parsed_output": {"risk_score": 0.5}}], "usage": {"input_tokens": 3, "cache_read_input_tokens": None}}
    text, usage = scoring.answer_of_blocks(good)
    assert json.loads(text) == {"risk_score": 0.5} and usage["input_tokens"] == 3 and usage["cache_read_input_tokens"] == 0
    for bad in ({}, {"content": []}, {"content": [{"parsed_output": None}]}):
        with pytest.raises(scoring.Unreadable):
            scoring.answer_of_blocks(bad)
    whole = {"candidates": [{"content": {"parts": [{"text": "{}"}]}}], "usageMetadata": {"promptTokenCount": 200, "candidatesTokenCount": 40}}
    assert scoring.answer_of_candidates(whole) == ("{}", {"input_tokens": 200, "output_tokens": 40})
    for bad in ({}, {"candidates": []}, whole | {"usageMetadata": None}, whole | {"candidates": [{"content": {"parts": [{"text": " "}]}}]}, {"candidates": [5]}):
        with pytest.raises(scoring.Unreadable):
            scoring.answer_of_candidates(bad)
