from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from chronoloom import session
from chronoloom.llm import queries
from chronoloom.llm import vector_cells as vc

ARTICLES = "article_id bigint, batch_id int, feed string, published_at string, url string, cell string"
T0 = datetime(2024, 1, 1)


def at(s):
    return (T0 + timedelta(seconds=s)).strftime("%Y-%m-%dT%H:%M:%SZ")


def feeds(spark):
    return spark.createDataFrame([("f", "UTC", "MDY")], "feed string, zone_name string, date_order string")


def test_addresses(spark):
    same = ["https://www.a.example/x-y?id=7&ref=q", "HTTP://A.EXAMPLE/X_y/?ID=7#top", "\tm.a.example//xy?page=&id=7&id=8", "https://amp.a.example:443/xy?utm=1&id=7"]
    other = ["https://www.www.a.example/xy?id=7", "https://a.example/xy?id=8", "https://a.example/xy?id=7&page=2", "https://a.example/xy?uid=7", ""]
    df = spark.createDataFrame([(i, u) for i, u in enumerate([*same, *other, None])], "i int, url string")
    got = [r["address"] for r in vc.with_address(df, "url").orderBy("i").collect()]
    assert len(set(got[:4])) == 1 and len(set(got[3:])) == 7 and got[-1] is None


def test_vectors_do_not_depend_on_neighbours():
    texts = ["abc", "", "abcd", "x" * 5000, "äöü"]
    together = vc.vectors(texts)
    for t, v in zip(texts, together, strict=True):
        assert (vc.vectors([t]) == v).all()
    c = vc.train(together)
    assert (vc._distances(together, c).argmin(1) == [vc._distances(vc.vectors([t]), c).argmin() for t in texts]).all()


def brute(data):
    out = set()
    for i, b, _, t, u, _ in data:
        ok = [j for j, c, _, s, w, _ in data if u and w and t and s and u == w and c < b and abs((datetime.fromisoformat(s) - datetime.fromisoformat(t)).total_seconds()) <= 600]
        if b >= 1 and ok:
            out.add((min(ok), i))
    return out


def test_replay_is_brute_force(spark, rows):
    rng = np.random.default_rng(0)
    times = [0, 1, 599, 600, 601, 1199, 1200, 1201, 1800, 5000, -600, -601]
    data = [(i, i // 25, "f", at(int(rng.choice(times))), f"https://a.example/{rng.integers(0, 4)}", "x") for i in range(100)]
    data += [(200, 4, "f", None, "https://a.example/0", "x"), (201, 4, "f", at(0), None, "x"), (202, 4, None, "yesterday", "https://a.example/0", "x")]
    known = [r if r[3] != "yesterday" else (*r[:3], None, *r[4:]) for r in data]
    df = spark.createDataFrame(data, ARTICLES)
    assert set(rows(vc.replay(df, feeds(spark)))) == brute(known)
    # the same, batch by batch
    index, found = vc.VectorCells.fit(df), []
    for b in range(5):
        e = index.entries(df.where(F.col("batch_id") == b), feeds(spark))
        if b:
            found += rows(index.known(e))
        index.append(e)
    assert set(found) == brute(known) and len(found) == len(set(found))
    assert vc.replay(df.limit(0), feeds(spark)).count() == 0


def test_nearest_is_brute_force(spark):
    rng = np.random.default_rng(1)
    words = ["alpha", "beta", "gamma", "delta"]
    data = [(i, i // 20, "f", at(int(rng.integers(0, 1500))), f"https://a.example/{rng.choice(words)}-{rng.choice(words)}-{rng.integers(0, 3)}", "x") for i in range(60)]
    df = spark.createDataFrame(data, ARTICLES)
    index = vc.VectorCells.fit(df)
    index.append(index.entries(df, feeds(spark)))
    e = {r["article_id"]: r for r in index.table.collect()}
    got = {r["article_id"]: (r["kept_id"], round(r["distance"], 6)) for r in index.nearest(index.table.where("batch_id >= 1"), 4.0).collect()}
    want = {}
    for i, r in e.items():
        near = [(float(np.linalg.norm(np.subtract(r["vec"], o["vec"]))), o["batch_id"], j) for j, o in e.items() if o["batch_id"] < r["batch_id"] and abs(o["ms"] - r["ms"]) <= 600_000]
        near = [x for x in near if x[0] <= 4.0]
        if r["batch_id"] >= 1 and near:
            want[i] = (min(near)[2], round(min(near)[0], 6))
    assert got == want and want


def test_known_gets_its_candidates_by_the_stored_vectors(spark, rows):
    # the last two have the same trigrams, and so the same vector, but not the same address
    urls = ["https://a.example/one", "https://a.example/one", "https://a.example/xxAxxBxx", "https://a.example/xxBxxAxx"]
    df = spark.createDataFrame([(i, i % 2, "f", at(0), u, "x") for i, u in enumerate(urls)], ARTICLES)
    index = vc.VectorCells.fit(df)
    index.append(index.entries(df, feeds(spark)))
    e = {r["article_id"]: r for r in index.table.collect()}
    assert e[2]["vec"] == e[3]["vec"] and e[2]["address"] != e[3]["address"]
    asked = index.table.where("batch_id = 1")
    assert rows(index.known(asked)) == [(0, 1)]
    index.table = index.table.withColumn("vec", F.transform("vec", lambda x: (x + 1).cast("smallint")))
    assert rows(index.known(asked)) == []


def test_near_addresses_are_a_query(spark, rows):
    urls = ["https://a.example/quarterly-report-7", "https://a.example/quarterly-report-7", "https://a.example/quarterly-report-9", "https://b.example/something/else?id=1"]
    df = spark.createDataFrame([(i, min(i, 1), "f", at(i), u, "x") for i, u in enumerate(urls)], ARTICLES)
    got = rows(vc.replay_nearest(df, feeds(spark)))
    assert [r[:2] for r in got] == [(0, 1), (0, 2)] and got[0][2] == 0 and 0 < got[1][2] <= vc.NEAR
    assert "p5_nearest" in queries.QUERIES


def test_an_index_is_opened_by_a_later_run(spark, rows, tmp_path):
    rng = np.random.default_rng(2)
    data = [(i, i // 20, "f", at(int(rng.choice([0, 599, 600, 601, 1800]))), f"https://a.example/{rng.integers(0, 4)}", "x") for i in range(80)]
    df = spark.createDataFrame(data, ARTICLES)
    path = f"file://{tmp_path}/index"
    found = rows(vc.replay(df.where("batch_id < 2"), feeds(spark), path))
    for b in (2, 3):  # each with nothing but the path and its own articles
        index = vc.VectorCells.open(spark, path)
        assert {r[0] for r in index.table.select("batch_id").distinct().collect()} == set(range(b))
        index.append(index.entries(df.where(F.col("batch_id") == b), feeds(spark)))
        found += rows(index.known(index.table.where(F.col("batch_id") == b)))
    assert set(found) == brute(data) and len(found) == len(set(found))
    assert not [p for _, p in session._written if str(tmp_path) in p]
    empty = vc.VectorCells.fit(df.limit(0), f"file://{tmp_path}/empty")
    assert empty.known(empty.table).count() == 0


def test_other_cells_are_probed_as_far_as_their_bounds_allow(spark):
    rng = np.random.default_rng(5)
    hosts = [f"{w}{i}.example" for w in ("wire", "wired", "daily") for i in range(4)]
    data = [(i, i // 40, "f", at(int(rng.integers(0, 900))), f"https://{rng.choice(hosts)}/{rng.choice(['alpha', 'beta'])}-{rng.integers(0, 4)}", "x") for i in range(120)]
    df = spark.createDataFrame(data, ARTICLES)
    index = vc.VectorCells.fit(df)
    assert len(index.shared.value) > 5
    index.append(index.entries(df, feeds(spark)))
    e = {r["article_id"]: r for r in index.table.collect()}
    for radius in (vc.NEAR, 9.0, 14.0):
        got = {r["article_id"]: (r["kept_id"], round(r["distance"], 6)) for r in index.nearest(index.table.where("batch_id >= 1"), radius).collect()}
        want, across = {}, 0
        for i, r in e.items():
            near = [(float(np.linalg.norm(np.subtract(r["vec"], o["vec"]))), o["batch_id"], j) for j, o in e.items() if o["batch_id"] < r["batch_id"] and abs(o["ms"] - r["ms"]) <= 600_000]
            near = [x for x in near if x[0] <= radius]
            if r["batch_id"] >= 1 and near:
                want[i] = (min(near)[2], round(min(near)[0], 6))
                across += e[min(near)[2]]["cell"] != r["cell"]
        assert got == want, radius
    assert across > 0  # with the widest radius some matches lie in other cells


def test_a_batch_reads_only_the_folders_it_reaches(spark, rows, tmp_path):
    day = 86_400
    data = [(i, 0, "f", at(i * 20 * day), f"https://a.example/{i}", "x") for i in range(12)] + [(50, 1, "f", at(60 * day + 30), "https://a.example/3", "x")]
    df = spark.createDataFrame(data, ARTICLES)
    index = vc.VectorCells.fit(df, f"file://{tmp_path}/index")
    index.append(index.entries(df.where("batch_id = 0"), feeds(spark)))
    batch = index.entries(df.where("batch_id = 1"), feeds(spark))
    reached = index.reached(batch)
    plan = reached._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    eras = {r[0] for r in reached.select("era").distinct().collect()}
    assert all(str(e) in filters for e in eras) and 0 < len(eras) < index.table.select("era").distinct().count()
    assert rows(index.known(batch)) == [(3, 50)]


def test_the_search_probes_cells_and_ranks_by_distance(spark):
    rng = np.random.default_rng(6)
    hosts = [f"{w}{i}.example" for w in ("wire", "wired", "daily") for i in range(3)]
    data = [(i, i // 40, "f", at(int(rng.integers(0, 3000))), f"https://{rng.choice(hosts)}/{rng.choice(['alpha', 'beta'])}-{rng.integers(0, 4)}", "x") for i in range(120)]
    df = spark.createDataFrame(data, ARTICLES)
    index = vc.VectorCells.fit(df)
    index.append(index.entries(df, feeds(spark)))
    e = {r["article_id"]: r for r in index.table.collect()}
    for radius in (0.0, 14.0):
        got = {(r["batch_id"], tuple(r["asked"]), r["id"], round(r["distance"], 6)) for r in index.search(index.table.where("batch_id >= 1"), radius).collect()}
        want, across = set(), 0
        for r in e.values():
            for o in e.values():
                d = float(np.linalg.norm(np.subtract(r["vec"], o["vec"])))
                if r["batch_id"] >= 1 and o["batch_id"] < r["batch_id"] and d <= radius:
                    if abs(o["ms"] - r["ms"]) <= vc.RADIUS_MS:
                        want.add((r["batch_id"], tuple(r["vec"]), o["article_id"], round(d, 6)))
                        across += o["cell"] != r["cell"]
        assert want and want <= got and all(d <= radius for *_, d in got), radius
        assert all(round(float(np.linalg.norm(np.subtract(q, e[i]["vec"]))), 6) == d and e[i]["batch_id"] < b for b, q, i, d in got)
    assert across > 0  # with the wide radius some lie in other cells


def test_a_replay_opens_the_index_for_each_batch(spark, rows, monkeypatch, tmp_path):
    # ids don't grow with the batches here, and batch 3 brings an address twice
    data = [(10, 0, "f", at(0), "https://a.example/1", "x"), (5, 3, "f", at(1), "https://a.example/1", "x"), (11, 3, "f", at(2), "https://a.example/1", "x")]
    data += [(1, 5, "f", at(3), "https://a.example/1", "x"), (2, 5, "f", at(700), "https://a.example/1", "x"), (12, 6, "f", at(603), "https://a.example/1", "x")]
    df = spark.createDataFrame(data, ARTICLES)
    monkeypatch.setattr(vc, "ROUND_ROWS", 0)
    opened, placed, appended = [], [], vc.VectorCells.append
    was = vc.VectorCells.open.__func__
    monkeypatch.setattr(vc.VectorCells, "open", classmethod(lambda cls, s, p: opened.append(p) or was(cls, s, p)))
    monkeypatch.setattr(vc.VectorCells, "append", lambda self, e: placed.append({r[0] for r in e.select("batch_id").collect()}) or appended(self, e))
    path = f"file://{tmp_path}/index"
    found = rows(vc.replay(df, feeds(spark), path))
    assert set(found) == brute(data) == {(10, 5), (10, 11), (5, 1), (1, 12)} and len(found) == 4
    assert placed == [{0}, {3}, {5}, {6}] and set(opened) == {path} and len(opened) >= 4


def test_small_batches_share_a_round(spark, rows):
    data = [(i, b, "f", at(0), "https://a.example/1", "x") for i, b in enumerate([-1, 0, 1, 2, 9, 40])]
    df = spark.createDataFrame(data, ARTICLES)
    assert vc._rounds(df) == [(-1, 0), (1, 40)] and vc._rounds(df.limit(0)) == []
    assert set(rows(vc.replay(df, feeds(spark)))) == brute(data)
