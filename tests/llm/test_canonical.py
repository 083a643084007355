from pyspark.sql import functions as F

from chronoloom.llm import canonical

FIELDS = ("url", "title", "source_name")
SCHEMA = "article_id bigint, url string, title string, source_name string, key string"


def df_of(spark, data):
    return spark.createDataFrame([(*r, "clash") for r in data], SCHEMA)


DATA = [
    (5, "https://a.example/x-y?b=2&a=1#t", "The Title!", "Wire"),
    (3, "HTTPS://A.EXAMPLE/x_y/?a=1&b=2#t", "the​title", " wire "),
    (9, "https://a.example/xy?a=1&b=2#t", "WIRE", "«The title»"),  # columns swapped
    (1, "https://a.example/xy?a=1&b=3#t", "The Title", "Wire"),
    (2, None, "The Title", "Wire"),
    (7, "x", "", ""),
    (8, "X!", " ", "-"),
    (10, "https://a.example/q?a&b", "Why? a & b", "Wire"),
    (11, "https://a.example/q?b&a", "Why? b & a", "Wire"),  # a title's order counts
    (12, "y" * 200_000, "t", "s"),
    (13, "Y" * 200_000 + ".", "t", "s"),
]


def test_groups(spark, rows):
    got = rows(canonical.copies(df_of(spark, DATA), "article_id", FIELDS))
    assert got == [(12, 13), (3, 5), (3, 9), (7, 8)]
    counts = {r["first_id"]: (r["n_copies"], r["collided"]) for r in canonical.duplicate_counts(df_of(spark, DATA), "article_id", FIELDS).collect()}
    assert counts == {3: (3, False), 1: (1, False), 7: (2, False), 10: (1, False), 11: (1, False), 12: (2, False)}


def test_a_large_group_beside_small_ones(spark, rows):
    data = [(i, "u", "t", "s") for i in range(40)] + [(100 + i, f"u{i // 2}", "t", "s") for i in range(6)]
    got = rows(canonical.copies(df_of(spark, data), "article_id", FIELDS))
    assert got == sorted([(0, i) for i in range(1, 40)] + [(100 + i, 101 + i) for i in (0, 2, 4)], key=repr)


def test_empty_and_repeated(spark, rows):
    assert canonical.copies(df_of(spark, []), "article_id", FIELDS).count() == 0
    assert canonical.duplicate_counts(df_of(spark, []), "article_id", FIELDS).count() == 0
    assert rows(canonical.copies(df_of(spark, [(1, "u", "t", "s")] * 2 + [(2, "u", "t", "s")] * 2), "article_id", FIELDS)) == [(1, 2)]


def test_addresses_without_a_scheme(spark):
    pairs = [("//h.example/p?b=1&a=2", "//h.example/p?a=2&b=1"), ("h.example/p?b=1&a=2#x", "H.EXAMPLE/p?a=2&b=1#x"), ("host/p?b=1&a=2", "host/p?a=2&b=1"), ("p?b=1&a=2", "p?a=2&b=1"), ("HTTP ://h/?b&a", "http://h/?a&b")]
    texts = [("Really? Gains & pains", "Really? pains & Gains"), ("Profit/loss? A & B", "Profit/loss? B & A"), ("No. 5? A & B", "No. 5? B & A"), ("No.5/7 cut? A & B", "No.5/7 cut? B & A"), ("a." * 100_000 + " ? x & y", "a." * 100_000 + " ? y & x")]
    df = spark.createDataFrame([*pairs, *texts], "a string, b string")
    got = [r[0] for r in df.select(canonical.canonical_value(F.col("a")) == canonical.canonical_value(F.col("b"))).collect()]
    assert got == [True] * len(pairs) + [False] * len(texts)


def test_policies_of_marks_and_forms(spark):
    data = [(1, "résumé", "t", "s"), (2, "résumé", "t", "s"), (3, "कि", "t", "s"), (4, "की", "t", "s"), (5, "+", "t", "s"), (6, "-", "t", "s"), (7, "ｆｕｌｌ", "t", "s"), (8, "full", "t", "s")]
    df = spark.createDataFrame(data, "id int, url string, title string, source_name string")
    run = lambda **kw: sorted(tuple(r) for r in canonical.copies(df, "id", ("url", "title", "source_name"), canonical.Policy(**kw)).collect())
    assert run() == [(3, 4), (5, 6)]  # marks count for nothing, symbols alone are empty; the two ways to write é differ
    assert run(form="NFC", marks=True) == [(1, 2), (5, 6)]
    assert run(form="NFKC", marks=True, symbols=True) == [(1, 2), (7, 8)]


def test_a_hot_group_needs_no_broadcast(spark):
    df = spark.createDataFrame([(i, "u", "t", "s" if i % 3 else str(i)) for i in range(3000)], "id int, url string, title string, source_name string")
    got = canonical.copies(df, "id", ("url", "title", "source_name"))
    assert got.count() == 1999 and got.agg(F.max("first_id")).first()[0] == 1
