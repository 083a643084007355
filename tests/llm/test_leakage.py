import random

import pytest

from chronoloom.llm import leakage

ITEM = "Alpha beta, gamma; delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron."
WORDS = ITEM.replace(",", "").replace(";", "").replace(".", "").split()


def pairs(spark, docs, items, **kw):
    d = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "'clash' AS item_id")
    i = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "'clash' AS doc_id")
    return sorted(tuple(r) for r in leakage.leaked_pairs(d, i, **kw).collect())


def test_passages(spark):
    docs = [
        (1, f"Before. {' -- '.join(WORDS[1:14]).upper()}! after"),  # 13 words
        (2, f"x {' '.join(WORDS[:12])} y {' '.join(WORDS[3:])}"),  # 12 and 12 words
        (3, f"{' '.join(WORDS[:7])} other {' '.join(WORDS[7:])}"),
        (4, f"pre{' '.join(WORDS)}"),  # the first word is another
        (5, None), (6, ""), (7, "z" * 300_000), (8, ITEM), (8, ITEM),
        (9, f"{' '.join(WORDS[:12])} {WORDS[12]}x {' '.join(WORDS[13:])}"),
        (None, ITEM),
    ]
    items = [(1, ITEM), (2, ITEM + " More words here."), (3, "too short"), (4, None), (5, ""), (6, "ß " * 13), (None, ITEM)]
    assert pairs(spark, docs, items) == [(d, i) for d in (1, 4, 8) for i in (1, 2)]
    assert pairs(spark, docs, items, edits=2, exact=True) == [(d, i) for d in (1, 4, 8) for i in (1, 2)]
    assert pairs(spark, docs, []) == [] and pairs(spark, [], items) == []


def test_short_words_and_blocks(spark, monkeypatch):
    text = "a b c d e f g h i j k l m"
    docs = [(1, f"zz {text} zz"), (2, f"zzzz {text}"), (3, text[:-1]), (4, "ß " * 12 + "ß"), (5, "x " + "SS " * 13)]
    items = [(1, text), (2, "Q " + text), (3, "ß-" * 13)]
    want = [(1, 1), (1, 2), (2, 1), (2, 2), (4, 3)]
    assert pairs(spark, docs, items) == pairs(spark, docs, items, edits=2, exact=True) == want
    monkeypatch.setattr(leakage, "BLOCK_BYTES", 1)
    assert pairs(spark, docs, items) == want


def test_random_against_brute_force(spark):
    rnd = random.Random(0)
    vocab = ["ab", "c", "déf", "ghij", "klm"]
    items = [(i, " ".join(rnd.choices(vocab, k=rnd.randint(10, 30)))) for i in range(20)]
    docs = []
    for d in range(120):
        w = rnd.choices(vocab, k=rnd.randint(0, 80))
        if d % 2:
            s = items[d % 20][1].split()
            k = rnd.randint(0, max(0, len(s) - 13))
            w[5:5] = s[k : k + rnd.randint(11, 15)]
        docs.append((d, "; ".join(w).title()))
    runs = lambda t: {tuple(t[k : k + 13]) for k in range(len(t) - 12)}
    want = sorted((d, i) for d, t in docs for i, s in items if runs(t.lower().replace(";", "").split()) & runs(s.split()))
    assert pairs(spark, docs, items) == want and want
    assert pairs(spark, docs, items, edits=2, exact=True) == want


@pytest.mark.parametrize("edits", [1, 2])
def test_edits(spark, edits):
    hurt = ITEM.replace("delta", "dleta"[: 5 - (edits == 1)] if edits == 2 else "delto")
    far = ITEM.replace("a", "o")
    assert pairs(spark, [(1, hurt), (2, far), (3, "nothing of it")], [(1, ITEM)], edits=edits) == [(1, 1)]


def edits_between(p, t, most):
    """Edit distance of p to its nearest stretch of t, plainly."""
    row = [0] * (len(t) + 1)
    for y, c in enumerate(p, 1):
        diag, row[0] = row[0], y
        for x in range(1, len(t) + 1):
            diag, row[x] = row[x], min(diag + (t[x - 1] != c), row[x] + 1, row[x - 1] + 1)
    return min(row) <= most


@pytest.mark.parametrize("edits", [1, 2, 3])
@pytest.mark.parametrize("hits", [1 << 21, 40])
def test_near_is_brute_force(spark, monkeypatch, edits, hits):
    monkeypatch.setattr(leakage, "HITS", hits)
    rnd = random.Random(edits)
    vocab = ["market", "quarter", "growth", "revenue", "outlook", "supply", "profit", "margin", "guidance", "capital"]
    items = [(i, " ".join(rnd.choices(vocab, k=rnd.randint(13, 16)))) for i in range(8)]
    docs = []
    for d in range(60):
        text = list(items[d % 8][1])
        for _ in range(rnd.randint(0, edits + 2)):
            at = rnd.randrange(len(text))
            text[at : at + rnd.randint(0, 1)] = rnd.choice(["", "q", "x"])
        docs.append((d, " ".join(rnd.choices(vocab, k=rnd.randint(0, 9))) + " " + "".join(text) + " " + " ".join(rnd.choices(vocab, k=3))))
    want = set()
    for d, t in docs:
        for i, s in items:
            w = s.split()
            ps = [f" {' '.join(w[k : k + 13])} ".encode() for k in range(len(w) - 12)]
            if any(edits_between(p, leakage.plain(t), edits) for p in ps):
                want.add((d, i))
    assert set(pairs(spark, docs, items, edits=edits)) == want and len(want) > 20


def test_too_many_edits_for_a_passage(spark):
    with pytest.raises(ValueError, match="edits"):
        pairs(spark, [(1, "x")], [(1, "a b c d e f g h i j k l m")], edits=2)
