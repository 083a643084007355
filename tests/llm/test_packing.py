import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronoloom.llm import packing


def filled(rows, capacity):
    """Tokens of each container of a plan, and documents of each size."""
    room, docs = {}, np.zeros(capacity + 1, int)
    for size, first, each, container, times in rows:
        assert first == docs[size]
        docs[size] += each * times
        for c in range(container, container + times):
            room[c] = room.get(c, 0) + size * each
    return room, docs


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 64), max_size=200))
def test_plan_covers_the_histogram(sizes):
    h = np.bincount(np.array(sizes, int), minlength=65)
    room, docs = filled(packing.plan(h, 64), 64)
    h[0] = 0
    assert (docs == h).all()
    assert all(0 < v <= 64 for v in room.values()) and sorted(room) == list(range(len(room)))
    # two containers never fit into one, but for the last few patterns' ends
    half = sum(v * 2 <= 64 for v in room.values())
    assert half <= 1


def test_patterns_are_fitted():
    h = np.zeros(101, int)
    h[[60, 40, 30, 50]] = [100, 120, 20, 10]
    patterns = packing.full_patterns(np.flatnonzero(h), 100)
    assert {tuple(p) for p in patterns.tolist()} == {(0, 40, 60), (30, 30, 40), (0, 50, 50)}
    x = packing.fit_patterns(h, patterns)
    use = np.bincount(patterns.ravel(), np.repeat(x, 3), minlength=101)
    assert (x >= 0).all() and abs(use[60] - 100) < 8 and abs(use[50] - 10) < 3
    room, _ = filled(packing.plan(h, 100), 100)
    assert len(room) == 120  # the 40s that find no 60 and no pair of 30s leave a fifth free: none does better


def test_documents(spark):
    texts = [(i, "word " * (i * 37 % 900)) for i in range(60)] + [(100, "word " * 5000), (101, None), (102, ""), (103, "  \n")]
    df = spark.createDataFrame(texts, "doc_id bigint, text string").selectExpr("*", "'clash' AS part", "1 AS size")
    sizes = {r["doc_id"]: r["n_tokens"] for r in packing.token_counts(df).collect()}
    got = packing.packed_documents(df).collect()
    by_doc, room = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append((r["part"], r["first_token"], r["n_tokens"]))
        room[r["container_id"]] = room.get(r["container_id"], 0) + r["n_tokens"]
    assert set(by_doc) == {d for d, n in sizes.items() if n > 0} and sizes[101] == sizes[102] == 0
    for d, parts in by_doc.items():
        parts.sort()
        assert [p for p, _, _ in parts] == list(range(len(parts))) and sum(n for *_, n in parts) == sizes[d]
        assert len(parts) == max(1, -(-sizes[d] // 2048)) and [f for _, f, _ in parts] == [2048 * k for k in range(len(parts))]
    assert max(room.values()) <= 2048 and sorted(room) == list(range(len(room)))
    assert len(room) <= -(-sum(sizes.values()) // 2048) + 1


@pytest.mark.parametrize("sizes", [[], [5] * 50, [2048] * 3, [2049, 4096, 1]])
def test_edges(spark, sizes):
    df = spark.createDataFrame([(i, n) for i, n in enumerate([*sizes, 0, None, -3])], "doc_id bigint, n_tokens bigint")
    got = packing.pack(df).collect()
    assert sum(r["n_tokens"] for r in got) == sum(sizes)
    assert len({r["container_id"] for r in got}) == -(-sum(sizes) // 2048) if sizes != [2049, 4096, 1] else len(got) == 5
