"""Filling containers of fixed capacity, by patterns of few documents fitted to the histogram of sizes.

Only the histogram (at most `capacity` numbers, whatever the corpus) comes to the driver. Patterns of up to
three sizes that fill a container exactly are given repeat counts by non-negative least squares; the counts
are rounded down and what is left of the histogram is packed longest first, with as many equal containers
at once as the histogram allows. The plan (a row per run of containers and size) goes back to the
tasks, where each document finds its container by its rank among the documents of its size.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.session import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CAPACITY = 2048
#: Patterns that are enumerated, about: where there could be more (large capacities), the smallest of three sizes is taken at equal steps from all
#: sizes. That bounds the driver's memory; what fewer patterns leave over is packed all the same.
PATTERNS = 1 << 19
#: Ranks are given in so many parts of each size, so that a size with very many documents is shared out.
PARTS = 256


@lru_cache(maxsize=2)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(hashlib.sha1(path.encode()).hexdigest(), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens): sizes in tokens of a public byte-level BPE given as ranks. A null text has 0 tokens."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoding(tokenizer)
        for pdf in batches:
            sizes = [len(enc.encode_ordinary(t)) if t else 0 for t in pdf["text"].tolist()]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": np.array(sizes, np.int64)})

    return documents.select("doc_id", "text").where("doc_id is not null").mapInPandas(count, "doc_id bigint, n_tokens bigint")


def full_patterns(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """All ways to fill a container exactly with one, two or (but see PATTERNS) three of the sizes: rows a <= b <= c, 0 for none."""
    have = np.zeros(capacity + 1, bool)
    have[sizes] = True
    out = [np.array([[0, 0, capacity]])[: int(have[capacity])]]
    a = np.sort(sizes[sizes <= capacity // 2])
    a = a[have[capacity - a]]
    out.append(np.stack([np.zeros_like(a), a, capacity - a], 1))
    small = np.sort(sizes[sizes <= capacity // 3])
    for x in small[:: max(1, len(small) * len(sizes) // 4 // PATTERNS)]:
        b = np.sort(sizes[(sizes >= x) & (sizes <= (capacity - x) // 2)])
        b = b[have[capacity - x - b]]
        out.append(np.stack([np.full_like(b, x), b, capacity - x - b], 1))
    return np.concatenate(out).astype(np.int64)


def fit_patterns(histogram: np.ndarray, patterns: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Repeat counts x >= 0 that bring the patterns' use of each size close to the histogram, in least squares.

    Active set: in each round the patterns that would lower the error most, no two of which share a size,
    join the set; then all counts in the set are settled by cyclic steps of projected gradient. Sizes'
    errors are weighed by their length, as tokens are what is packed.
    """
    weight = np.arange(len(histogram), dtype=float) / (len(histogram) - 1)
    weight[0] = 0
    x = np.zeros(len(patterns))
    norm = (weight[patterns] ** 2).sum(axis=1)
    rest = histogram.astype(float).copy()
    active = np.zeros(0, int)
    for _ in range(rounds):
        gain = (rest[patterns] * weight[patterns] ** 2).sum(axis=1) / norm
        gain[rest[patterns].min(axis=1, initial=np.inf, where=patterns > 0) <= 0.5] = 0
        best = np.argsort(-gain, kind="stable")[:4096]
        best = best[gain[best] > 0.5]
        if not len(best):
            break
        taken, new = np.zeros(len(histogram), bool), []
        for p in best.tolist():
            used = patterns[p][patterns[p] > 0]
            if not taken[used].any():
                taken[used] = True
                new.append(p)
        active = np.union1d(active, np.array(new))
        a = patterns[active]
        lipschitz = np.bincount(a[a > 0], minlength=len(histogram)).max() * 3
        for _ in range(30):
            grad = (rest[a] * weight[a] ** 2).sum(axis=1)
            stepped = np.maximum(0, x[active] + grad / max(1, lipschitz) * 3 / np.maximum(norm[active], 1e-9))
            x[active] = stepped
            use = np.bincount(a.ravel(), np.repeat(stepped, 3), minlength=len(histogram))
            rest = histogram - use
    return x


def plan(histogram: np.ndarray, capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(size, first_rank, n_each, first_container, n_containers): ranks of a size, n_each to a container.

    Covers each document of the histogram exactly once; no container exceeds the capacity.
    """
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    rank = np.zeros(capacity + 1, np.int64)
    rows: list[tuple[int, int, int, int, int]] = []
    made = 0

    def put(content: dict[int, int], times: int) -> None:
        nonlocal made
        for size, n in content.items():
            rows.append((size, int(rank[size]), n, made, times))
            rank[size] += n * times
            left[size] -= n * times
        made += times

    sizes = np.flatnonzero(left)
    patterns = full_patterns(sizes, capacity)
    if len(patterns):
        counts = np.floor(fit_patterns(left, patterns) + 1e-9).astype(np.int64)
        for p in np.argsort(-counts, kind="stable").tolist():
            if not counts[p]:
                break
            content: dict[int, int] = {}
            for size in patterns[p][patterns[p] > 0].tolist():
                content[size] = content.get(size, 0) + 1
            times = min([int(counts[p]), *[int(left[s]) // n for s, n in content.items()]])
            if times > 0:
                put(content, times)
    # what is left: the longest first, filled up with the longest that fit; two that fit exactly before one
    while (present := np.flatnonzero(left)).size:
        room, content = capacity - int(present[-1]), {int(present[-1]): 1}
        while room > 0:
            fits = present[present <= room]
            fits = fits[left[fits] > np.array([content.get(int(s), 0) for s in fits], dtype=np.int64)] if len(fits) else fits
            if not len(fits):
                break
            size = int(fits[-1])
            small = fits[fits <= room // 2]
            pair = small[np.isin(room - small, fits)] if size < room else small[:0]
            pair = [int(s) for s in pair if s * 2 != room or left[s] > content.get(int(s), 0) + 1]
            if pair:
                size = room - pair[-1]
            elif size < room:
                n = min(room // size, int(left[size]) - content.get(size, 0))
                content[size] = content.get(size, 0) + n - 1
                room -= size * (n - 1)
            content[size] = content.get(size, 0) + 1
            room -= size
        put(content, min(int(left[s]) // n for s, n in content.items()))
    return rows


def pack(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, part, container_id, first_token, n_tokens): each document's place, or its parts' places.

    sizes: doc_id, n_tokens. A document of more than `capacity` tokens is split into full containers and a
    rest, which is packed like a document; no other is split. No container holds more than `capacity`.
    Null, zero and negative sizes need no room and give no row. Equal sizes are served in an order of
    hashes of doc_id, so the result doesn't depend on the partitioning; ids should be unique.
    """
    sizes = cut(sizes.where("n_tokens > 0 and doc_id is not null").select("doc_id", F.col("n_tokens").cast("bigint").alias("n_tokens")), "sizes")
    full = F.expr(f"(n_tokens - 1) DIV {capacity}")  # full containers before the rest, if the text is too large
    items = sizes.select("doc_id", full.cast("bigint").alias("n_full"), (F.col("n_tokens") - full * capacity).cast("int").alias("size"))
    # at most `capacity` times PARTS rows, by definition
    part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int")
    items = items.withColumn("part", part)
    counts = items.groupBy("size", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("n_full").alias("n_full"))
    histogram = np.zeros(capacity + 1, np.int64)
    full_containers = np.zeros(capacity + 2, np.int64)
    for r in counts.groupBy("size").agg(F.sum("n").alias("n"), F.sum("n_full").alias("n_full")).collect():  # a row per size
        histogram[r["size"]] = r["n"]
        full_containers[r["size"] + 1] = r["n_full"]
    # the full containers of smaller sizes come first
    ahead = sizes.sparkSession.createDataFrame([(i, int(n)) for i, n in enumerate(np.cumsum(full_containers)[: capacity + 1])], "size int, full_ahead bigint")
    rows = plan(histogram, capacity)
    n_packed = max([c + t for *_, c, t in rows], default=0)

    before = Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    at = counts.join(ahead, "size").withColumns({"n_before": F.coalesce(F.sum("n").over(before), F.lit(0)), "full_before": F.col("full_ahead") + F.coalesce(F.sum("n_full").over(before), F.lit(0))})
    w = Window.partitionBy("size", "part").orderBy("doc_id")
    ranked = items.join(at.select("size", "part", "n_before", "full_before"), ["size", "part"])
    ranked = ranked.select(
        "doc_id", "size", "n_full",
        (F.col("n_before") + F.row_number().over(w) - 1).alias("rank"),
        (F.col("full_before") + F.coalesce(F.sum("n_full").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("full_rank"),
    )

    by_size: dict[int, tuple[np.ndarray, ...]] = {}
    for size, first, each, container, _ in rows:
        by_size.setdefault(size, []).append((first, each, container))
    by_size = {s: tuple(np.array(c, np.int64) for c in zip(*sorted(v), strict=True)) for s, v in by_size.items()}
    share = sizes.sparkSession.sparkContext.broadcast(by_size)  # at most a few rows per size

    @F.pandas_udf("bigint")
    def container(size: pd.Series, rank: pd.Series) -> pd.Series:
        out = np.zeros(len(size), np.int64)
        s, r = size.to_numpy(), rank.to_numpy()
        for value in np.unique(s):
            m = s == value
            first, each, base = share.value[int(value)]
            k = np.searchsorted(first, r[m], "right") - 1
            out[m] = base[k] + (r[m] - first[k]) // each[k]
        return pd.Series(out)

    placed = ranked.withColumn("container_id", container("size", "rank"))
    last = F.struct(F.col("n_full").cast("bigint").alias("part"), F.col("container_id"), (F.col("n_full") * capacity).alias("first_token"), F.col("size").cast("bigint").alias("n_tokens"))
    whole = F.transform(
        F.when(F.col("n_full") > 0, F.sequence(F.lit(0).cast("bigint"), F.col("n_full") - 1)).otherwise(F.array().cast("array<bigint>")),
        lambda i: F.struct(i.alias("part"), (F.col("full_rank") + i + n_packed).alias("container_id"), (i * capacity).alias("first_token"), F.lit(capacity).cast("bigint").alias("n_tokens")),
    )
    return placed.select("doc_id", F.inline(F.concat(whole, F.array(last))))


def packed_documents(documents: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    """The documents' texts, sized in tokens of a public tokenizer and packed; see pack."""
    return pack(token_counts(documents, tokenizer), capacity)
