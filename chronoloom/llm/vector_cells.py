"""New batches against all history, by a persisted inverted file of vector cells.

An article's vector holds signed counts of hashed trigrams of its address: HALF numbers of the host, HALF of the rest.
A cell is the nearest of the centroids of the host's half; there are more of them as history grows, trained on a bounded
sample of the first batch. Vectors are kept in full beside their cell in a table in folders by era (32 days of publication),
and a batch is appended to it, so history is never read into vectors again, and a batch reads the eras that its own times
reach. With a path, centroids and cells are written there and stay; a later run opens them and reads only its own batch
into vectors. Without one they are in the shared folder and end with the driver's Python.

Distance bounds decide which cells are probed, nearest first: a vector in a cell is at least half as far away as that cell's centroid
is farther than the own one. The own cell gives a first match; another cell is probed only if its bound is below that
match's distance (or the radius), so the search ends where no nearer match is possible. What the probes give is ranked exactly on the full vectors.

Equal addresses are looked for by the same bounds with radius 0: cells whose bound is not above it, within these the stored
vectors whose place along a line allows it, of these the ones at distance 0 by their full vectors, and last the address. A
vector is asked for once for an hour and batch, and running minima over the times of the rows found take the place of pairs of
rows (a hot address costs no more than its rows). A replay goes in rounds of batches: the index at its path is opened, only
the round's own articles are read into vectors, appended and looked up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoloom.functions.timestamps import EDGES
from chronoloom.llm.canonical import letters
from chronoloom.operators.instants import article_instants
from chronoloom.session import cut, scratch

#: Numbers of a vector for the host and for the rest of an address.
HALF = 8
DIMS = 2 * HALF
#: The host's numbers count so many times: addresses near each other share it, and the bounds of other hosts' cells lie beyond NEAR.
HOST_WEIGHT = 3
#: Cells of a small history; a larger one has a quarter of the root of its rows, and a quarter of the sample at most.
CELLS = 64
#: Days of publication that share a folder of the table.
ERA_DAYS = 32
#: Milliseconds of a slab: in a search by distance, vectors meet within a cell and slab.
SLAB_MS = 3_600_000
#: The sample that centroids are trained on has at most so many vectors. Every vector is indexed.
SAMPLE = 20_000
RADIUS_MS = 600_000
#: Addresses are near up to this distance of their vectors. One changed character takes three trigrams and brings three:
#: the root of 6 where these fall into six slots, less or more where they share some.
NEAR = 2.5
#: A direction in the space of vectors: two are at least as far apart as their places along it. Vectors that differ seldom share a place.
LINE = (311, -457, 89, 503, -227, 149, -397, 61, 439, -173, 271, -509, 353, -31, -283, 199)
#: Bits of the filter that keeps rows no probe asks for out of the shuffle: 16 for each probe, 8 MB at most.
FILTER_BITS = 1 << 26
#: Batches that together have no more rows than this, or fewer than the history before them, are looked up in one round.
ROUND_ROWS = 10_000
_PARTS = r"^(?:[a-z][a-z0-9+.\-]*:)?/*([^/?#]*)([^?#]*)(?:\?([^#]*))?"
SCHEMA = "article_id bigint, batch_id int, ms bigint, address string, cell int, vec array<smallint>, era int"


def with_address(df: DataFrame, url: str, out: str = "address") -> DataFrame:
    """Add what makes an address: host (without one leading www., m. or amp.), path, and the parameters id and
    page (the first of each), as letters and digits in lower case. Null for a null url."""
    df = df.withColumn("__u", F.lower(F.trim(F.col(url), F.lit(EDGES))))
    df = df.withColumns({f"__u{i}": F.regexp_extract("__u", _PARTS, i) for i in (1, 2, 3)})
    df = df.withColumns({"__u1": letters(F.regexp_replace(F.regexp_replace("__u1", r":\d*$", ""), r"^(?:www|m|amp)\.", "")), "__u2": letters(F.col("__u2"))})
    df = df.withColumns({f"__{k}": letters(F.regexp_extract("__u3", rf"(?:^|&){k}=([^&]*)", 1)) for k in ("id", "page")})
    return df.withColumn(out, F.when(F.col(url).isNotNull(), F.concat_ws("\n", "__u1", "__u2", "__id", "__page"))).drop("__u", "__u1", "__u2", "__u3", "__id", "__page")


def _counts(parts: list[bytes]) -> np.ndarray:
    # the two zeros keep a text's trigrams from reaching into the next one
    parts = [b"\2" + p + b"\3\0\0" for p in parts]
    data = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint64)
    row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])[:-2]
    inside = data[:-2] > 0
    h = (data[:-2] << np.uint64(16) | data[1:-1] << np.uint64(8) | data[2:]) * np.uint64(0x9E3779B97F4A7C15)
    h, row = h[inside], row[inside]
    h ^= h >> np.uint64(32)
    sign = np.where(h >> np.uint64(40) & np.uint64(1), 1, -1)
    slot = row * HALF + (h >> np.uint64(8) & np.uint64(HALF - 1)).astype(np.int64)
    return np.bincount(slot, sign, minlength=len(parts) * HALF).reshape(-1, HALF).clip(-8192, 8191).astype(np.int16)


def vectors(texts: list[str]) -> np.ndarray:
    """Signed counts of hashed byte trigrams of host (HOST_WEIGHT times) and rest, one row per text; equal texts give equal rows."""
    cut_at = [t.encode().partition(b"\n") for t in texts]
    if not cut_at:
        return np.zeros((0, DIMS), np.int16)
    return np.hstack([HOST_WEIGHT * _counts([c[0] for c in cut_at]), _counts([c[2] for c in cut_at])])


def _distances(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Of each vector (its leading numbers, as many as a centroid has) to each centroid."""
    v = v[:, : centroids.shape[1]].astype(np.float64)
    return np.sqrt(np.maximum(0, (v**2).sum(1)[:, None] - 2 * v @ centroids.T + (centroids**2).sum(1)[None, :]))


def train(sample: np.ndarray, cells: int = CELLS, rounds: int = 8) -> np.ndarray:
    """Centroids of the hosts' halves by k-means from evenly spaced rows of the sorted sample; at least one."""
    sample = sample[:, :HALF]
    if not len(sample):
        return np.zeros((1, HALF))
    uniq = np.unique(sample, axis=0).astype(np.float64)
    c = uniq[np.linspace(0, len(uniq) - 1, min(cells, len(uniq))).astype(int)]
    for _ in range(rounds):
        own = np.concatenate([_distances(sample[i : i + 4096], c).argmin(1) for i in range(0, len(sample), 4096)])
        n = np.bincount(own, minlength=len(c))
        total = np.stack([np.bincount(own, sample[:, k], minlength=len(c)) for k in range(HALF)], 1)
        # in sixteenths, so that distances are exact and equal vectors fall into equal cells, whatever comes beside them
        c = np.where(n[:, None] > 0, np.round(16 * total / np.maximum(n, 1)[:, None]) / 16, c)
    return c


def _stacked(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(-1, DIMS)


def _place(vec: str) -> Column:
    return sum((F.get(vec, F.lit(i)).cast("bigint") * w for i, w in enumerate(LINE)), F.lit(0))


def _ring_width(radius: float) -> int:
    # a probe reaches into two or three rings at most; at radius 0 into its own
    return max(1, int(np.ceil(radius * np.linalg.norm(LINE))))


def _asked_for(rows: DataFrame, probes: DataFrame, on: list[str], n: int) -> DataFrame:
    """The rows that may be asked for by one of n probes (all that are, and false hits): a filter of FILTER_BITS at most is sent to the tasks."""
    bits = min(FILTER_BITS, 1 << max(15, (16 * n).bit_length()))
    at = F.pmod(F.xxhash64(*on), F.lit(bits))
    # buckets of 32,768 bits: 2,048 at most; positions and buckets count from 1
    maps = probes.select(F.bitmap_bucket_number(at + 1).alias("bucket"), F.bitmap_bit_position(at + 1).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("map")).collect()
    table = np.zeros((bits // 32_768, 4096), np.uint8)
    for r in maps:
        table[r["bucket"] - 1] = np.frombuffer(bytes(r["map"]), np.uint8)
    shared = rows.sparkSession.sparkContext.broadcast(table.ravel())

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.column("__at").to_numpy()
            hit = (shared.value[k // 8] >> (k % 8).astype(np.uint8)) & 1
            yield batch.drop_columns(["__at"]).filter(pa.array(hit.astype(bool)))

    return rows.withColumn("__at", at).mapInArrow(keep, rows.schema)


class VectorCells:
    """The index. Open it with its centroids; append batches, look batches up against what came before."""

    def __init__(self, spark: SparkSession, centroids: np.ndarray, path: str | None = None):
        self.spark = spark
        self.path = path
        self.shared = spark.sparkContext.broadcast(centroids)  # at most SAMPLE / 4 * HALF numbers
        self.table: DataFrame | None = None

    @classmethod
    def fit(cls, articles: DataFrame, path: str | None = None) -> VectorCells:
        """Train on those SAMPLE articles of the first batch whose ids have the least hashes; an index at `path` must not be there yet."""
        first = articles.agg(F.min("batch_id")).first()[0]
        history = articles.where((F.col("batch_id") == first) & F.col("url").isNotNull())
        some = history.select("article_id", "url").orderBy(F.xxhash64("article_id"), "article_id").limit(SAMPLE)
        texts = [r[0] for r in with_address(some, "url").select("address").collect()]
        cells = min(max(CELLS, int(history.count() ** 0.5) // 4), SAMPLE // 4)
        spark, centroids = articles.sparkSession, train(vectors(texts), cells)
        if path:
            rows = [(i, c) for i, c in enumerate(centroids.tolist())]
            spark.createDataFrame(rows, "cell int, centroid array<double>").coalesce(1).write.parquet(f"{path}/centroids")
            spark.createDataFrame([], SCHEMA).write.partitionBy("era").parquet(f"{path}/cells")
            return cls.open(spark, path)
        return cls(spark, centroids)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> VectorCells:
        """The index that fit and append have written to `path`, in this run or an earlier one."""
        rows = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()
        index = cls(spark, np.array([r["centroid"] for r in rows]), path)
        index.table = index._stored()
        return index

    def _stored(self) -> DataFrame:
        cells = self.spark.read.schema(SCHEMA).parquet(f"{self.path}/cells")
        return cells.select("article_id", "batch_id", "ms", "address", "cell", "vec", "era")

    def entries(self, articles: DataFrame, feeds: DataFrame) -> DataFrame:
        """The articles' entries: id, batch, time, address, cell, full vector and era. Rows without id, batch, url
        or an instant have none."""
        timed = article_instants(articles.select("article_id", "batch_id", "feed", "published_at", "url").where("url is not null"), feeds, ("published_at",))
        timed = timed.where("published_ms is not null and article_id is not null and batch_id is not null")
        rows = with_address(timed, "url").select("article_id", "batch_id", F.col("published_ms").alias("ms"), "address")
        shared = self.shared

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    v = vectors(pdf["address"].tolist())
                    cell = np.concatenate([_distances(v[i : i + 4096], shared.value).argmin(1) for i in range(0, len(v), 4096)])
                    yield pdf.assign(cell=cell.astype(np.int32), vec=list(v), era=(pdf["ms"] // (ERA_DAYS * 86_400_000)).astype(np.int32))

        return rows.mapInPandas(place, SCHEMA)

    def append(self, entries: DataFrame) -> None:
        """Write a batch's (or several batches') entries into their cells. A batch that is appended twice does not
        change what later ones get, but is itself twice in the table."""
        rows = entries.select("article_id", "batch_id", "ms", "address", "cell", "vec", "era")
        if self.path:
            # few files to a folder, and a full folder not by one task
            rows.hint("rebalance", "era").write.option("compression", "zstd").mode("append").partitionBy("era").parquet(f"{self.path}/cells")
            self.table = self._stored()
            return
        new = cut(rows, "cells")
        self.table = new if self.table is None else self.table.unionByName(new)

    def reached(self, entries: DataFrame, radius_ms: int = RADIUS_MS) -> DataFrame:
        """The part of the table in the eras that the entries' times reach: of an index at a path, other folders are not read."""
        if not self.path:
            return self.table
        width = ERA_DAYS * 86_400_000
        ends = F.array(*[F.floor((F.col("ms") + k) / width).cast("int") for k in (-radius_ms, radius_ms)])
        eras = sorted(r[0] for r in entries.select(F.explode(ends)).distinct().collect())  # one number for each 32 days
        return self.table.where(F.col("era").isin(eras) if eras else F.lit(False))

    def _probes(self, entries: DataFrame, radius: float, radius_ms: int) -> DataFrame:
        """(cell, slab, ring, batch_id, asked): where the entries' vectors have to be looked for, each vector once for a slab and batch."""
        shared = self.shared

        def cells_in_bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    part = batch.slice(at, 4096)
                    d = _distances(_stacked(part), shared.value)
                    own = d[np.arange(len(d)), part.column("cell").to_numpy()]
                    r, c = np.nonzero((d - own[:, None]) / 2 <= radius + 1e-9)  # the own one's bound is 0
                    yield part.take(pa.array(r)).set_column(3, "cell", pa.array(c, pa.int32()))

        lists = entries.select("batch_id", "ms", "vec", "cell").mapInArrow(cells_in_bounds, "batch_id int, ms bigint, vec array<smallint>, cell int")
        slabs = F.array_distinct(F.array(*[F.floor((F.col("ms") + k) / SLAB_MS) for k in (-radius_ms, 0, radius_ms)]))
        reach = F.lit(radius * float(np.linalg.norm(LINE)) * (1 + 1e-9))
        ring = lambda k: F.floor((_place("vec") + k) / _ring_width(radius))
        each = lists.select("cell", F.explode(slabs).alias("slab"), "batch_id", "vec").withColumn("ring", F.explode(F.sequence(ring(-reach), ring(reach))))
        return cut(each.repartition("cell", "slab", "ring").select("cell", "slab", "ring", "batch_id", F.col("vec").alias("asked")).distinct(), "probes")

    def search(self, entries: DataFrame, radius: float = 0.0, radius_ms: int = RADIUS_MS) -> DataFrame:
        """(batch_id, asked, id, b, ms, addr, distance): for the entries' vectors (asked) of each batch, the rows of earlier batches
        (id, batch b, time, MD5 of the address) with a vector at most `radius` away, in the slabs of time that radius_ms reaches."""
        probes = self._probes(entries, radius, radius_ms)
        n, last = probes.agg(F.count(F.lit(1)), F.max("batch_id")).first()
        history = self.reached(entries, radius_ms).where(F.col("batch_id") < F.lit(last)).select(
            "cell", F.floor(F.col("ms") / SLAB_MS).alias("slab"), F.floor(_place("vec") / _ring_width(radius)).alias("ring"), "vec", "ms", F.unhex(F.md5("address")).alias("addr"), F.col("batch_id").alias("b"), F.col("article_id").alias("id")
        )
        met = _asked_for(history, probes, ["cell", "slab", "ring"], n).join(probes, ["cell", "slab", "ring"]).where("b < batch_id")
        square = sum(((F.get("vec", F.lit(i)).cast("bigint") - F.get("asked", F.lit(i))) ** 2 for i in range(DIMS)), F.lit(0.0))
        near = met.select("batch_id", "asked", "id", "b", "ms", "addr", F.sqrt(square).alias("distance"))
        return near.where(F.col("distance") <= radius)

    def known(self, entries: DataFrame, radius_ms: int = RADIUS_MS) -> DataFrame:
        """(kept_id, article_id): entries whose address an earlier batch brought at most radius_ms away.

        Candidates are what search() finds at distance 0; those of another address drop out. kept_id is the smallest id of an
        earlier batch's. Batches may be looked up one by one or together, before or after they are appended: only lower
        batch_ids count. A repeated row counts once.
        """
        found = self.search(entries, 0.0, radius_ms).groupBy("batch_id", "addr", "ms").agg(F.min("id").alias("id"))
        slab = F.floor(F.col("ms") / radius_ms)
        row = lambda s, pos, kind: F.struct(s.alias("slab"), pos.alias("pos"), F.lit(kind).alias("kind"))
        # the radius reaches into three slabs: the end of the one before, all of its own, the beginning of the next
        probes = F.array(row(slab - 1, F.col("ms") - radius_ms, 1), row(slab, (slab + 1) * radius_ms, 2), row(slab + 1, F.col("ms") + radius_ms, 3))
        asked = entries.select("batch_id", F.unhex(F.md5("address")).alias("addr"), "ms", "article_id", F.inline(probes))
        have = found.select("batch_id", "addr", slab.alias("slab"), F.col("ms").alias("pos"), F.lit(0).alias("kind"), "id")
        w = Window.partitionBy("batch_id", "addr", "slab")
        to = w.orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, 0)
        back = w.orderBy(F.desc("pos"), "kind").rowsBetween(Window.unboundedPreceding, 0)
        best = have.unionByName(asked, allowMissingColumns=True).withColumns({"up": F.min("id").over(to), "down": F.min("id").over(back)}).where("kind > 0")
        best = best.withColumn("kept_id", F.when(F.col("kind") == 1, F.col("down")).otherwise(F.col("up"))).where("kept_id is not null")
        return best.groupBy("article_id", "batch_id", "addr", "ms").agg(F.min("kept_id").alias("kept_id")).select("kept_id", "article_id")

    def nearest(self, entries: DataFrame, radius: float, radius_ms: int = RADIUS_MS) -> DataFrame:
        """(kept_id, article_id, distance): the nearest vector of an earlier batch at most `radius` and
        radius_ms away; of equally near ones that of the earliest batch, then the smallest id.

        First the own cell of each entry is probed. Then, of the others, those whose bound is not above the match found there, or
        the radius where there was none: no other cell can hold a nearer one.
        """
        shared = self.shared
        slab = lambda ms: F.floor(ms / SLAB_MS)
        # equal vectors at one time count once
        have = self.reached(entries, radius_ms).groupBy("cell", F.col("vec").alias("vec2"), F.col("ms").alias("ms2"), F.col("batch_id").alias("b2")).agg(F.min("article_id").alias("id2")).withColumn("slab", slab(F.col("ms2")))
        square = F.aggregate(F.zip_with("vec", "vec2", lambda a, b: (a.cast("int") - b) * (a.cast("int") - b)), F.lit(0), lambda s, x: s + x)

        def probed(ask: DataFrame) -> DataFrame:
            slabs = F.array_distinct(F.array(slab(F.col("ms") - radius_ms), slab(F.col("ms")), slab(F.col("ms") + radius_ms)))
            met = ask.withColumn("slab", F.explode(slabs)).join(have, ["cell", "slab"]).where((F.col("b2") < F.col("batch_id")) & (F.abs(F.col("ms2") - F.col("ms")) <= radius_ms))
            near = met.withColumn("distance", F.sqrt(square.cast("double"))).where(F.col("distance") <= radius)
            return near.groupBy("article_id").agg(F.min(F.struct("distance", "b2", "id2")).alias("m"))

        asked = entries.select("article_id", "batch_id", "ms", "vec", "cell")
        first = cut(probed(asked), "own_cells")
        # a match at distance 0 needs no other cell: equal vectors are in equal cells
        open_ = asked.join(first.select("article_id", F.col("m.distance").alias("found")), "article_id", "left").where("found is null or found > 0")

        def others(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for at in range(0, len(pdf), 4096):
                    part = pdf.iloc[at : at + 4096]
                    d = _distances(np.array(part["vec"].tolist()).reshape(-1, DIMS), shared.value)
                    own = part["cell"].to_numpy()
                    rows = np.arange(len(part))
                    bound = (d - d[rows, own][:, None]) / 2
                    near = bound <= part["found"].fillna(radius).to_numpy()[:, None] + 1e-9
                    near[rows, own] = False
                    r, c = np.nonzero(near)
                    yield part.iloc[r].drop(columns="found").assign(cell=c.astype(np.int32))

        more = open_.select("article_id", "batch_id", "ms", "vec", "cell", "found").mapInPandas(others, "article_id bigint, batch_id int, ms bigint, vec array<smallint>, cell int")
        best = first.unionByName(probed(more)).groupBy("article_id").agg(F.min("m").alias("m"))
        return best.select(F.col("m.id2").alias("kept_id"), "article_id", "m.distance")


def _replayed(articles: DataFrame, feeds: DataFrame, path: str | None = None) -> VectorCells:
    index = VectorCells.fit(articles, path)
    index.append(index.entries(articles, feeds))
    return index


def _rounds(articles: DataFrame) -> list[tuple[int, int]]:
    """First and last batch of each round. Those up to batch 0 are one; later ones share a round as long as they are
    fewer rows than the history before it, so that there are few rounds however many batches come, and history is not read again for each."""
    rounds, seen, n = [], 0, 0
    for batch, k in articles.where("batch_id is not null").groupBy("batch_id").count().orderBy("batch_id").collect():
        if rounds and (batch < 1 or (rounds[-1][1] >= 1 and (n + k <= ROUND_ROWS or n + k < seen))):
            rounds[-1], n = (rounds[-1][0], batch), n + k
        else:
            rounds.append((batch, batch))
            seen, n = seen + n, k
    return rounds


def replay(articles: DataFrame, feeds: DataFrame, path: str | None = None) -> DataFrame:
    """(kept_id, article_id) for every batch after 0, each against all before it; see VectorCells.known.

    Round by round the index is opened at its path, and that round's articles alone are placed, appended and looked up. The index
    is left at `path`, if given, for VectorCells.open and the batches to come; without one it is in the shared folder until release().
    """
    spark = articles.sparkSession
    path, results = path or scratch(spark, "index"), scratch(spark, "known")
    VectorCells.fit(articles, path)
    spark.createDataFrame([], "kept_id bigint, article_id bigint").write.parquet(results)
    for first, last in _rounds(articles):
        index = VectorCells.open(spark, path)
        entries = index.entries(articles.where(F.col("batch_id").between(first, last)), feeds)
        if last < 1:  # nothing is asked of these
            index.append(entries)
            continue
        entries = cut(entries, "entries")
        index.append(entries)
        index.known(entries).write.mode("append").parquet(results)
    return spark.read.schema("kept_id bigint, article_id bigint").parquet(results)


def replay_nearest(articles: DataFrame, feeds: DataFrame, radius: float = NEAR) -> DataFrame:
    """(kept_id, article_id, distance) for every batch after 0, each against all before it; see VectorCells.nearest."""
    index = _replayed(articles, feeds)
    return index.nearest(index.table.where("batch_id >= 1"), radius)
