"""Files, checkpoints, paged sources, contracts and reports."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from chronoloom.operators import bars, contracts, report
from chronoloom.sources import files, paged

T0 = datetime(2024, 1, 1)


def test_csv_is_read_by_name(spark, tmp_path, rows):
    (tmp_path / "a.csv").write_text("c,b,a\n9,2,1\nx,,7\n")
    assert rows(files.read_csv(spark, f"{tmp_path}/a.csv", "a int, b int")) == [(1, 2), (7, None)]
    with pytest.raises(ValueError, match="missing.*b"):
        (tmp_path / "b.csv").write_text("a,c\n1,9\n")
        files.read_csv(spark, f"{tmp_path}/b.csv", "a int, b int", ("b",))
    assert rows(files.read_csv(spark, f"{tmp_path}/b.csv", "a int, b int", ("a",))) == [(1, None)]
    assert rows(files.read_csv(spark, f"{tmp_path}/b.csv", "c int, a int")) == [(9, 1)]
    with pytest.raises(ValueError, match="repeated"):
        (tmp_path / "r.csv").write_text("a,a\n1,2\n")
        files.read_csv(spark, f"{tmp_path}/r.csv", "a int")
    files.write_csv(spark.createDataFrame([("x, y", 1.5)], "s string, v double"), f"{tmp_path}/out")
    files.write_csv(spark.createDataFrame([("z", 2.5)], "s string, v double"), f"{tmp_path}/out")
    assert rows(files.read_csv(spark, f"{tmp_path}/out", "v double, s string")) == [(2.5, "z")]


def test_promotion_keeps_the_old_table(spark, tmp_path):
    at = f"{tmp_path}/t"
    files.promote(spark.range(2), at)
    with pytest.raises(ValueError, match="finite"):
        files.promote(spark.createDataFrame([(float("nan"),)], "x double"), at, check=contracts.check_finite)
    with pytest.raises(Exception, match="(?i)divi"):
        files.promote(spark.range(3).selectExpr("1 / (id - 1) AS x"), at)
    assert spark.read.parquet(at).count() == 2
    files.promote_all({at: spark.range(3), f"{tmp_path}/u": spark.range(4)})
    assert spark.read.parquet(at).count() == 3 and spark.read.parquet(f"{tmp_path}/u").count() == 4
    assert not [p.name for p in tmp_path.iterdir() if ".old-" in p.name or ".ready-" in p.name]
    assert files.write_text(spark, f"{tmp_path}/d/a.txt", "ä\n") and not files.write_text(spark, f"{tmp_path}/d/a.txt", "b")
    assert (tmp_path / "d/a.txt").read_text() == "ä\n"
    assert files.write_text(spark, f"{tmp_path}/d/a.txt", "b", force=True) and (tmp_path / "d/a.txt").read_text() == "b"
    files.write_json_new(spark, f"{tmp_path}/j.json", {"b": 1})
    with pytest.raises(FileExistsError):
        files.write_json_new(spark, f"{tmp_path}/j.json", {})


def test_checkpoints_are_joined(spark, tmp_path, rows):
    schema = "url string, title string, v int, seq bigint"
    df = lambda *r: spark.createDataFrame(r, schema)
    load = lambda: rows(files.load_checkpoint(spark, f"{tmp_path}/p", f"{tmp_path}/l", schema, ["url", "title"]), "url", "v", "first_seen")
    assert load() == []
    df(("a", "t", 1, 1), ("b", None, 2, 2)).write.parquet(f"{tmp_path}/p")
    assert load() == [("a", 1, 1), ("b", 2, 2)]
    files.append_checkpoint(df(("b", None, 5, 0), ("c", "t", 6, 3)), f"{tmp_path}/l", "r")
    files.append_checkpoint(df(("c", "t", 7, 4)), f"{tmp_path}/l", "r")
    assert load() == [("a", 1, 1), ("b", 5, 2), ("c", 7, 3)]


def test_pages():
    data = [{"k": i} for i in range(7)]
    fetch = lambda page, size: (data[(page - 1) * 2 : (page - 1) * 2 + size], 3)
    got = paged.read_pages(fetch, 2, 500)
    assert ([r["k"] for r in got.records], got.sizes, got.stop, got.capped) == ([0, 1, 2, 3], [2, 2], "total", False)
    got = paged.read_pages(lambda page, size: (data[:size], 100), 3, 4)
    assert (len(got.records), got.sizes, got.stop, got.capped) == (4, [3, 1], "cap", True)
    assert paged.read_pages(lambda p, s: ([], None), 5, 9).stop == "empty_page"
    assert paged.read_pages(lambda p, s: (data[:1], None), 5, 9).stop == "short_page"

    def more(page, size):
        if page > 1:
            raise paged.error_of(426)
        return data[:size], None

    assert paged.read_pages(more, 2, 9).stop == "no_more_given"
    days, cut_off = paged.read_days(lambda day, page, size: (data[:size], 9 if day.day == 2 else 2), date(2024, 1, 1), date(2024, 1, 3), 2, 4)
    assert len(days) == 3 and cut_off == [date(2024, 1, 2)]
    with pytest.raises(ValueError, match="before"):
        paged.read_days(fetch, date(2024, 1, 2), date(2024, 1, 1), 1, 1)


def test_backfill(spark, rows):
    pages = [["2024-03-01", "2024-02-01"], ["2024-01-02", "2024-01-02"], ["2023-12-31"], ["2023-01-01"]]
    fetch = lambda p: [{"date": d, "title": "x"} for d in pages[p]] if p < len(pages) else []
    day = lambda r: date.fromisoformat(r["date"])
    got = paged.backfill(fetch, day, date(2024, 1, 1), 10)
    assert (len(got.pages), got.stop, got.complete, got.oldest) == (3, "oldest_before_requested_start", True, date(2023, 12, 31))
    assert paged.backfill(lambda p: fetch(p) if p < 2 else [], day, date(2024, 1, 1), 10).complete is False
    with pytest.raises(paged.SourceError, match="do not reach"):
        paged.backfill(fetch, day, date(2020, 1, 1), 2)
    flat = [(i, r["title"], r["date"]) for i, r in enumerate(r for p in got.pages for r in p)]
    df = spark.createDataFrame(flat, "seq int, title string, date string")
    kept = paged.retained(df, "date", "2024-01-01", "2024-03-01", "seq")
    assert rows(kept, "seq") == [(0,), (1,), (2,)]
    c = paged.coverage(kept, "date", "2024-01-01", "2024-01-03").first()
    assert (c["n_records"], c["n_days"], c["oldest"]) == (3, 1, date(2024, 1, 2)) and c["missing_days"] == [date(2024, 1, 1), date(2024, 1, 3)]
    assert paged.coverage(kept.limit(0), "date", "2024-01-01", "2024-01-02").first()["n_days"] == 0


def test_errors_and_downloads(spark, rows):
    kinds = {426: paged.TooMany, 401: paged.NotAllowed, 402: paged.NotAllowed, 403: paged.NotAllowed, 429: paged.Busy, 503: paged.Unavailable, 404: paged.SourceError}
    assert all(type(paged.error_of(s)) is k and paged.error_of(s).status == s for s, k in kinds.items())
    with pytest.raises(ValueError, match="KEY"):
        paged.required_key("KEY", {"KEY": " "})
    cols = ["Date", ("Open", "X"), ("High", "X"), ("Low", "X"), ("Close", "X"), ("Volume", "X"), ("Adj Close", "X")]
    data = [dict(zip(cols, [datetime(2024, 1, 3 - i), 1, 2, 0.5, 1.5, 10, 1.4], strict=True)) for i in range(2)]
    assert [r["date"].day for r in paged.bars_of_download(data, spark, cols).collect()] == [2, 3]
    with pytest.raises(paged.SourceError, match="volume"):
        paged.bars_of_download([{c: 1 for c in cols[:5]}], spark, cols[:5])
    with pytest.raises(paged.SourceError, match="no bars"):
        paged.bars_of_download([], spark, cols)


def test_transcripts_are_collected():
    there = {"b": "old"}
    manifest = [{"filename": n, "source_url": n} for n in "abcd"]

    def fetch(url):
        if url == "c":
            raise paged.error_of(503)
        return f"<p>{url}</p>"

    write = lambda n, t, f: there.__setitem__(n, t) or True
    args = (manifest, fetch, lambda p: p[3:-4], lambda t, row: ["too_short"] if t == "d" else [], write, there.__contains__)
    assert paged.collect_transcripts(*args) == {"a": "written", "b": "there", "c": "failed: HTTP 503: ", "d": "rejected: too_short"}
    assert there == {"a": "a", "b": "old"}
    assert paged.collect_transcripts(*args, force=True)["b"] == "written" and there["b"] == "b"


def test_table_contracts(spark, rows):
    good = spark.createDataFrame([(datetime(2024, 1, d), 1.0, 2.0, 0.5, 1.5, 9.0, None, None) for d in (1, 2)], contracts.LOADED_BARS)
    contracts.check_loaded_bars(good)
    contracts.check_join_frame(good.withColumn("extra", F.lit(1)).select("extra", *good.columns))
    for bad in (good.withColumn("x", F.lit(1)), good.select(*good.columns[::-1]), good.drop("low"), good.withColumn("volume", F.lit(1))):
        with pytest.raises(ValueError, match="expected"):
            contracts.check_loaded_bars(bad)
    with pytest.raises(ValueError, match="repeated_date"):
        contracts.check_loaded_bars(good.unionByName(good))
    with pytest.raises(ValueError, match="null_close"):
        contracts.check_loaded_bars(good.withColumn("close", F.lit(None).cast("double")))
    contracts.check_loaded_bars(good.limit(0))
    call = spark.createDataFrame([(T0, 0.5, 0.3, 0.2, 1.0, 0.0)], contracts.CALL_SCORES)
    contracts.check_call_scores(call)
    with pytest.raises(ValueError, match="expected"):
        contracts.check_call_scores(call.drop("pos_frac"))
    names = ["as_of", "news_sent_mean", "news_risk_max", *contracts.NEWS_COUNTS]
    news = spark.createDataFrame([(T0, 0.1, 0.2, *[1.0] * 11)], "as_of timestamp_ntz, " + ", ".join(f"{c} double" for c in names[1:]))
    contracts.check_news_scores(news)
    for value in (0.5, float("nan"), float("inf"), None):
        with pytest.raises(ValueError, match="news_topic_macro"):
            contracts.check_news_scores(news.withColumn("news_topic_macro", F.lit(value).cast("double")).select(*names))
    with pytest.raises(ValueError, match="numeric"):
        contracts.check_news_scores(news.withColumn("news_count", F.lit("1")).select(*names))
    assert rows(contracts.daily_news_violations(news)) == []
    broken = news.unionByName(news).withColumn("news_topic_other", F.lit(-1))
    assert rows(contracts.daily_news_violations(broken)) == [("negative_news_topic_other", 2), ("repeated_as_of", 1)]
    m = spark.createDataFrame([(T0, "a", "Q1"), (T0, "b", "Q1"), (None, "c", None)], "call_date timestamp_ntz, filename string, fiscal_period string")
    assert rows(contracts.manifest_violations(m)) == [("null_call_date", 1), ("repeated_call_date", 1), ("repeated_fiscal_period", 1)]
    with pytest.raises(ValueError, match="empty"):
        contracts.check_manifest(m.limit(0))
    t = spark.createDataFrame([("x Operator 2024",), (None,)], "t string").select(contracts.transcript_faults(F.col("t"), F.lit(2024), ["Operator", "Analyst"], 5))
    assert [r[0] for r in t.collect()] == [["no_Analyst"], ["too_short", "no_Operator", "no_Analyst", "no_call_year"]]
    with pytest.raises(ValueError, match="not_finite_x"):
        contracts.check_finite(spark.createDataFrame([(1, float("inf"), "a")], "i int, x double, s string"))
    contracts.check_finite(spark.createDataFrame([(1, "a")], "i int, s string"))
    with pytest.raises(ValueError, match="contract"):
        bars.require(contracts.violations(m, {"any": "true"}))


PROFILES = {
    "A": {"equal": {"source": "A", "collection_complete": "true", "chunking.strategy": "utc_day"}, "present": ["requested_range.from"], "lists": ["chunking.windows"], "each": {"chunking.windows": ["day", "result_count"]}},
    "B": {"equal": {"source": "B"}, "not_after": [("coverage.oldest", "requested_range.from")], "article_equal": {"symbol": "X"}, "article_range": ("publishedDate", "requested_range.from", "requested_range.to")},
}


def test_payloads(spark, tmp_path, rows):
    a = '{"source": "A", "collection_complete": true, "requested_range": {"from": "2024-01-01"}, "chunking": {"strategy": "utc_day", "windows": [{"day": "x", "result_count": 1}]}}'
    b = '{"source": "B", "coverage": {"oldest": "%s"}, "requested_range": {"from": "2024-01-02", "to": "2024-01-03"}}'
    good = [("a", a, ["{}"]), ("b", b % "2024-01-02", ['{"symbol": "X", "publishedDate": "2024-01-03 10:00:00"}'])]
    schema = "file string, metadata string, articles array<string>"
    assert contracts.check_payloads(spark.createDataFrame(good, schema), PROFILES) == {"a": "A", "b": "B"}
    bad = [
        ("1", a.replace("true", "false").replace('"result_count"', '"n"'), []), ("2", a.replace("[{", '[{"n": 1}, {'), []), ("3", None, []),
        ("4", b % "2024-01-04", ['{"symbol": "Y", "publishedDate": "2024-01-04"}', "5"]), ("5", b % "2024-01-01", []),
    ]
    df = spark.createDataFrame(bad, schema)
    got = {k: rows(contracts.payload_violations(df, p).where("file <> '3'")) for k, p in PROFILES.items()}
    assert [v for f, v in got["A"] if f in "12"] == ["missing_chunking.windows.result_count", "not_equal_collection_complete", "missing_chunking.windows.day", "missing_chunking.windows.result_count"]
    assert [v for f, v in got["B"] if f == "4"] == ["article_not_object", "article_out_of_range", "article_symbol", "coverage.oldest_after_requested_range.from"]
    assert [v for f, v in got["B"] if f == "5"] == ["no_articles"]
    with pytest.raises(ValueError, match="unsupported"):
        contracts.check_payloads(spark.createDataFrame([("x", '{"source": "C"}', [])], schema), PROFILES)
    with pytest.raises(ValueError, match="broken"):
        contracts.check_payloads(df.where("file = '5'"), PROFILES)
    (tmp_path / "p.json").write_text('{"metadata": ' + a + ', "articles": [{"title": "t"}, 5]}')
    assert list(contracts.check_payloads(files.read_payloads(spark, f"{tmp_path}/p.json"), PROFILES).values()) == ["A"]
    assert rows(files.read_payload(spark, f"{tmp_path}/p.json", "title string", source="A"), "title") == [("t",)]
    assert files.read_payload(spark, f"{tmp_path}/p.json", "title string", source="B").count() == 0


def test_reports(spark, rows):
    df = spark.createDataFrame([("b", 1.0), ("z", 9.0)], "set string, mae double")
    assert rows(report.in_category_order(df, "set", ["a", "b"])) == [("a", None, 1), ("b", 1.0, 2)]
    assert report.markdown_table(spark.createDataFrame([("x", 1.5, None)], "s string, v double, w double")) == "| s | v | w |\n| --- | --- | --- |\n| x | 1.500000 | nan |"
    assert report.plain_table(df.where("mae < 5"), "T") == "T\nset       mae\n  b  1.000000" and report.plain_table(df.limit(0), "T").endswith("(no rows)")
    with pytest.raises(ValueError, match="more"):
        report.markdown_table(df, most=1)
    t = spark.createDataFrame([("p", 0.0085, T0), ("q", -0.17, None), ("r", None, None)], "m string, d double, t timestamp_ntz")
    got = t.select(report.delta_sentence(F.col("m"), F.col("d"), "base").alias("s"), report.share_text(F.col("d")).alias("p"), report.day_text(F.col("t")).alias("t"), report.number_text(F.col("d")).alias("n")).collect()
    assert [tuple(r) for r in got] == [("p raises MAE by 0.85 % against base", "+0.85%", "2024-01-01", "0.008500"), ("q lowers MAE by 17.00 % against base", "-17.00%", None, "-0.170000"), (None, None, None, "nan")]


def test_fetching_and_collecting():
    import io
    from contextlib import closing
    from urllib.error import HTTPError, URLError

    def opener(request, timeout):
        url = request.full_url
        if "busy" in url:
            raise HTTPError(url, 429, "slow down", {}, io.BytesIO(b"later"))
        if "gone" in url:
            raise URLError("no route")
        return closing(io.BytesIO(b'{"a": "\xc3\xa4"}' if "json" in url else b"<p>"))

    assert paged.fetch_json("http://h/json", opener=opener) == {"a": "ä"} and paged.fetch_text("http://h/page", opener=opener) == "<p>"
    for url, kind in (("busy", paged.Busy), ("gone", paged.Unavailable), ("page", paged.SourceError)):
        with pytest.raises(kind):
            paged.fetch_json(f"http://h/{url}", opener=opener)
    wrote: list[dict] = []
    days = (date(2024, 1, 1), date(2024, 1, 2))
    assert paged.collect_days("A", lambda day, page, size: ([{"d": day.day}], 1), *days, 10, 10, wrote.append) == 0
    assert [a["d"] for a in wrote[0]["articles"]] == [1, 2] and [w["result_count"] for w in wrote[0]["metadata"]["chunking"]["windows"]] == [1, 1]
    assert paged.collect_days("A", lambda day, page, size: ([{}] * size, 99), *days, 2, 2, wrote.append) == 1 and len(wrote) == 1

    def refused(day, page, size):
        raise paged.error_of(402)

    assert paged.collect_days("A", refused, *days, 2, 2, wrote.append) == 0 and wrote[1]["articles"] == [] and "402" in wrote[1]["metadata"]["note"]
