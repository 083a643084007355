import random
import string

import numpy as np
import pytest

from chronoloom.llm import spans

rnd = random.Random(7)


def noise(n, alphabet=string.ascii_letters + " äöü😀"):
    return "".join(rnd.choices(alphabet, k=n))


def lcs(a, b, least):
    """Do two texts share a stretch of so many characters? By all windows."""
    return bool({a[i : i + least] for i in range(len(a) - least + 1)} & {b[i : i + least] for i in range(len(b) - least + 1)})


def docs_df(spark, docs):
    return spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "'clash' AS class_id", "1 AS place")


@pytest.fixture(scope="module")
def docs():
    s300, s299, s301, long = noise(300), noise(299), noise(301), noise(1500)
    head = noise(270)  # a stock opening, too short
    out = [noise(rnd.randint(0, 200)) + s + noise(rnd.randint(0, 200)) for s in (s300, s300, s299, s299, s301, s301)]
    out += [head + noise(200) for _ in range(6)]
    out += [long, long, long, noise(50) + long[400:900], long[:450] + "#" + long[451:800] + noise(30)]
    out += ["a" * 700, "a" * 299, "ab" * 400, "a" * 900, "", None, "x" * 299, s300, noise(40) + s300[:150] + "#" + s300[150:]]
    return list(enumerate(out))


def test_pairs_are_brute_force(spark, docs):
    got = [tuple(r) for r in spans.shared_pairs(docs_df(spark, docs)).collect()]
    want = {(i, j) for i, a in docs for j, b in docs if i < j and a and b and lcs(a, b, 300)}
    assert len(got) == len(set(got)) and set(got) == want


def test_shares(spark, docs):
    got = {r["doc_id"]: r for r in spans.shared_share(docs_df(spark, docs)).collect()}
    for i, a in docs:
        if a is None:
            assert i not in got or got[i]["shared_chars"] == 0
            continue
        windows = {b[k : k + 300] for j, b in docs if j != i and b for k in range(len(b) - 299)}
        covered = np.zeros(len(a), bool)
        for k in range(len(a) - 299):
            if a[k : k + 300] in windows:
                covered[k : k + 300] = True
        assert got[i]["shared_chars"] == covered.sum(), i
        assert got[i]["n_chars"] == len(a)
    assert got[12]["n_copies"] == 3 and got[14]["class_id"] == 12 and got[12]["n_links"] == 2


def test_anchor_in_every_stretch():
    texts = [noise(rnd.randint(300, 900)) for _ in range(20)] + ["a" * 400, "abc" * 200]
    t, place, *_ = spans.anchors(texts, 300)
    for i, text in enumerate(texts):
        p = np.sort(place[t == i])
        for s in range(len(text) - 299):
            assert ((p >= s) & (p + 64 <= s + 300)).any()
    alone = [spans.anchors([x], 300)[1].tolist() for x in texts]
    assert alone == [place[t == i].tolist() for i in range(len(texts))]


def test_wider_windows_fit_every_stretch():
    for span in (64, 100, 136, 192, 256, 264, 280, 300, 320, 511, 700, 5000):
        sizes = spans.ladder(span)
        assert sizes[0] == 64 and sizes[-1] <= span
        for before, size in zip(sizes, sizes[1:], strict=False):
            steps = spans.offsets(before, size, span)
            for at in range(0, span - before + 1):  # the shorter window's place in the stretch
                assert any(0 <= at - o and at - o + size <= span and at - o + size >= at + before for o in steps), (span, size, at)
    with pytest.raises(ValueError, match="span"):
        spans.shared_groups(None, 63)


@pytest.mark.parametrize("span", [64, 150, 400, 900])
def test_other_spans_are_brute_force(spark, docs, span):
    got = [tuple(r) for r in spans.shared_pairs(docs_df(spark, docs), span).collect()]
    want = {(i, j) for i, a in docs for j, b in docs if i < j and a and b and lcs(a, b, span)}
    assert len(got) == len(set(got)) and set(got) == want


def test_large_groups_are_shared_out(spark, monkeypatch):
    stock = noise(280)
    docs = [(i, noise(60) + stock + noise(60)) for i in range(40)] + [(100 + i, noise(20) + stock + "the same behind it in some of them") for i in range(9)]
    want = {(i, j) for i, a in docs for j, b in docs if i < j and lcs(a, b, 300)}
    monkeypatch.setattr(spans, "GROUP", 4)
    got = [tuple(r) for r in spans.shared_pairs(docs_df(spark, docs)).collect()]
    assert set(got) == want and len(got) == len(want) == 36


def test_pieces_cover_long_texts():
    text = noise(1000, "ab")
    assert "".join(t for _, t in spans._pieces(text, 300)) == text


def test_empty(spark):
    assert spans.shared_pairs(docs_df(spark, []).limit(0)).count() == 0
    assert spans.shared_share(docs_df(spark, [(1, "short")])).first()["shared_chars"] == 0
