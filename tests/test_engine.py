"""Statistics, articles, texts, files, jobs, stream, and the driver's contract."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from chronoloom.functions import text as tx
from chronoloom.operators import eda, jobs, news
from chronoloom.sources import files
from chronoloom.streaming.daily import daily_counts, event_stream

T0 = datetime(2024, 1, 1)


def test_statistics(spark):
    df = spark.createDataFrame([("A", i + 1, float(v)) for i, v in enumerate((1, 2, 4, 8, 16))] + [("B", 1, None)], "k string, rn bigint, x double")
    m = {r["k"]: r for r in eda.moments(df, ["k"], "x").collect()}
    assert m["A"]["n"] == 5 and m["A"]["mean"] == 6.2 and m["B"]["mean"] is None
    acf = eda.autocorrelation(df, ["k"], "x", (1, 9)).collect()
    assert [(r["lag"], round(r["acf"], 6)) for r in acf] == [(1, 1.0)]
    assert {r["bin"]: r["n"] for r in eda.histogram(df, ["k"], "x", 0.0, 10.0, 5).collect()} == {1: 1, 2: 1, 3: 1, 5: 1, 6: 1}
    with pytest.raises(ValueError, match="before"):
        eda.day_windows("2024-01-02", "2024-01-01")


def test_articles(spark, rows):
    schema = "id int, title string, published_at string, url string, topic_tags array<string>"
    df = spark.createDataFrame([(1, " A", "t1", "u", ["guidance", "earnings", "earnings", "odd"]), (2, "A", "t1", "v", None), (3, None, None, None, []), (4, "", None, "w", ["macro"])], schema)
    assert rows(news.first_wins(df, [news.first_text(F.col("title")), news.first_text(F.col("published_at"))], "id"), "id") == [(1,), (3,)]
    assert df.select(news.normalise_tags(F.col("topic_tags"))).first()[0] == ["earnings", "guidance"]
    assert rows(news.pending(df, df.where("id in (1, 3)")), "id") == [(2,), (4,)]
    assert [r["position"] for r in news.in_given_order(df, spark.createDataFrame([("u", 7), ("u", 9)], "url string, rank bigint"), "url", "rank").orderBy("id").collect()][:2] == [9, (1 << 63) - 1]
    spent = news.running_total(spark.createDataFrame([("r", i, i // 2, 0.2) for i in range(3)], "run string, i int, b int, cost double"), ["run"], ["i"], "b", "cost")
    assert rows(news.crossings(spent, ["run"], ["i"], "running", 1.0, (0.2, 0.4, 0.6))) == [("r", 0.2, 0), ("r", 0.4, 1), ("r", 0.6, 2)]
    assert news.alert_fractions(" .5, .25,.5") == (0.25, 0.5)
    with pytest.raises(ValueError, match="positive"):
        news.alert_fractions("0")
    with pytest.raises(ValueError, match="unknown"):
        news.common_article("C")


def test_texts(spark):
    long = "This is one sentence. This is yet another one! short one.\nAnd so it goes on\n\nno end here.\n\nnew para begins right here"
    df = spark.createDataFrame([(1, long), (2, None), (3, ""), (4, "w " * 50_000)], "id int, t string")
    got = {r["id"]: r["s"] for r in df.select("id", tx.sentences(F.col("t")).alias("s")).collect()}
    assert got[1] == ["This is one sentence.", "This is yet another one! short one.", "And so it goes on no end here.", "new para begins right here"] and got[2] is None and got[3] == []
    assert tx.visible_text("<h1>A</h1><p>x <b>y</b> z&amp;</p><script>no</script>") == "A\nxyz&\n"
    assert [r[0] for r in tx.visible(df.where("id > 1 and id < 4"), "t", "v").orderBy("id").select("v").collect()] == [None, "\n"]
    pages = {
        "<div>one</div>two<br>three<BR/>four": "one\ntwo\nthree\nfour\n", "<p>a &lt; b\n  c</p><!-- <p>no</p> --><noscript><p>no</p></noscript><li>d": "a < b c\nd\n",
        '<a title="x > y">shown</a> <b>and</b>this<style>p {}</style>': "shownandthis\n", "<script>never closed <p>x": "\n", "1 < 2 and 3 > 2": "1 < 2 and 3 > 2\n", "<!DOCTYPE html><section>s</section>": "s\n",
    }
    assert {p: tx.visible_text(p) for p in pages} == pages and tx.visible_text(None) is None
    ends = spark.createDataFrame([("one two three $497.6. Two three four 5.\n\nsix seven eight 1.\nnine",)], "t string").select(tx.sentences(F.col("t"))).first()[0]
    assert ends == ["one two three $497.6.", "Two three four 5.", "six seven eight 1. nine"]
    t = spark.createDataFrame([("a Prepared Remarks b Stocks Mentioned c",), ("none",)], "t string")
    assert [r[0] for r in t.select(tx.trimmed(F.col("t"))).collect()] == ["Prepared Remarks b", "none"]
    scored = spark.createDataFrame([(1, 0.7, 0.2, 0.1), (1, 0.5, 0.25, 0.25), (1, 0.4, 0.4, 0.2)], "id int, p double, n double, u double").select("id", F.struct(F.col("p").alias("pos"), F.col("n").alias("neg"), F.col("u").alias("neu")).alias("score"))
    r = tx.call_aggregate(scored, "id").first()
    assert r["pos_frac"] == 1 and r["neg_frac"] == 0 and r["n_sentences"] == 3
    s = tx.score_sentences(df.where("id < 3"), "t", lambda texts: [(1 / 3, 1 / 3, 1 / 3)] * len(texts)).orderBy("id").collect()
    assert s[0]["score"]["pos"] == pytest.approx(1 / 3) and (s[1]["score"] is None or s[1]["score"]["pos"] is None)


def test_files(spark, tmp_path, rows):
    df = spark.createDataFrame([(1, "a")], "i int, s string")
    files.write_new(df, f"{tmp_path}/new")
    with pytest.raises(Exception, match="(?i)exists"):
        files.write_new(df, f"{tmp_path}/new")
    files.promote(df.unionByName(df), f"{tmp_path}/new")
    assert spark.read.parquet(f"{tmp_path}/new").count() == 2
    files.append_checkpoint(df, f"{tmp_path}/log", "r1")
    files.append_checkpoint(df, f"{tmp_path}/log", "r2")
    assert spark.read.json(f"{tmp_path}/log").count() == 2
    (tmp_path / "p.json").write_text('{"metadata": {"source": "x"}, "articles": [{"title": "t", "source": {"name": "n"}}, 5, null]}')
    p = files.read_payload(spark, f"{tmp_path}/p.json", "title string, content string, description string, url string, publishedAt string, source struct<name: string>")
    assert rows(p.select(*[c.alias(k) for k, c in news.common_article("A").items()]), "source_name", "title", "body")[0] == ("n", "t", "")
    files.require_columns(df, "i int, s string")
    with pytest.raises(ValueError, match="expected"):
        files.require_columns(df, "s string, i int")
    (tmp_path / "a.txt").write_text("x\ny")
    assert files.read_texts(spark, f"{tmp_path}/a.txt").first()["text"] == "x\ny"
    df.write.option("header", True).csv(f"{tmp_path}/csv")
    assert files.read_csv(spark, f"{tmp_path}/csv", "i int, s string", ("i",)).first()["s"] == "a"


def test_jobs():
    now, slept = [0.0], []
    limiter = jobs.RateLimiter(600, 60, 600, clock=lambda: now[0], sleep=lambda s: (slept.append(s), now.__setitem__(0, now[0] + s)))
    limiter.refused()
    assert limiter.rate == 300
    for _ in range(100):
        limiter.succeeded()
    assert limiter.rate == pytest.approx(330)
    for _ in range(9):
        limiter.refused()
    assert limiter.rate == 60
    assert [jobs.backoff(k, 1, 5) for k in (1, 2, 3, 4)] == [1, 2, 4, 5] and jobs.backoff(1, 0, 5) == 0
    calls = []

    def refuse():
        calls.append(1)
        raise ConnectionError

    with pytest.raises(ConnectionError):
        jobs.with_retries(refuse, limiter, 2)
    assert len(calls) == 3
    assert jobs.drop_rate_exceeded(2, 100, 0.01) and not jobs.drop_rate_exceeded(0, 0, 0.01)
    assert jobs.run_record("r", n=1) == '{"n": 1, "run": "r"}'


def test_stream_equals_batch(spark, tmp_path, rows):
    schema = "event_id bigint, ts timestamp_ntz, event_type string, value double"
    data = [(i % 7, datetime(2024, 1, 1 + i % 3, i), "ab"[i % 2], float(i % 7)) for i in range(14)]
    data = [(i, t, k, float(i)) for i, (_, t, k, _) in enumerate(data)] + [(3, *data[3][1:3], 3.0)]
    df = spark.createDataFrame(data, schema)
    df.write.parquet(f"{tmp_path}/in")
    q = daily_counts(event_stream(spark, f"{tmp_path}/in", schema), "ts", ["event_id"]).writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("daily")) == rows(daily_counts(df, "ts", ["event_id"]))


def test_contract(spark):
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q)
    assert entry.entry(spark).count() >= 0
