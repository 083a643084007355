"""Long verbatim spans shared between texts, by level-wise doubling.

Level 1 takes windows of 64 characters. Not all of them: of the 64-character windows inside each stretch of
`span` characters the one with the least hash, so that two texts that share such a stretch take the same
window from it. Windows that occur in one text only are dropped, those that are repeated are extended to twice the length, and so
on (128, 256, ...) while windows survive and the length leaves room in `span`; each is extended at so many offsets that
one of the longer windows lies in any stretch that the shorter one lies in. The last step goes to `span` itself: a
surviving window with the characters beside it, its context. Texts with one context share it. Where a
window has several contexts, the windows of exactly `span` characters in them are hashed, and those that are
repeated are what is shared. So all is found by equality, without comparing pairs, and a stock passage costs its own texts only.

The texts that share one such key are a group. Of groups with the same members one is kept. Copies of one text are one class
throughout (by a 128-bit hash), so a hot group of copies costs no more than one text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.session import cut

BASE = 64
#: Characters that are hashed together in one go.
BATCH_CHARS = 1 << 19
SECTION = 1 << 20
#: Bits of the filter that keeps texts without candidates out of the shuffle: 16 for each text that has some, 8 MB at most.
FILTER_BITS = 1 << 26
#: A group of more members than this is joined with itself in parts.
GROUP = 512
_B = np.uint64(0x9E3779B97F4A7C15)
_B2 = np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(codes: np.ndarray) -> np.ndarray:
    x = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _doubled(h: np.ndarray, size: int, base: np.uint64, to: int) -> np.ndarray:
    """Hashes of windows of `to` characters from those of `size`, by doubling: left half, right half."""
    while size < to:
        power = np.uint64(pow(int(base), size, 1 << 64))
        h = h[: len(h) - size] * power + h[size:] if len(h) > size else h[:0]
        size *= 2
    return h


def _final(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def _least(h: np.ndarray, w: int) -> np.ndarray:
    """Of each w windows in a row, the place of the one with the least hash (of equal ones the last)."""
    n = len(h)
    low = np.uint64((1 << 24) - 1)
    m = (h & ~low) | (low - np.arange(n, dtype=np.uint64))
    size = 1
    while size * 2 <= w:
        m = np.minimum(m[: len(m) - size], m[size:])
        size *= 2
    m = np.minimum(m[: n - w + 1], m[w - size : w - size + n - w + 1])
    return (low - (m & low)).astype(np.int64)


def anchors(texts: list[str], span: int) -> tuple[np.ndarray, ...]:
    """(text, place, h64, right, left) of the windows taken from each text of at least `span` characters.

    right and left: hashes of the 128 characters that begin or end with the window; 0 where the text has
    no room for them (and then that of the other side is there).
    """
    sizes = np.array([len(t) for t in texts])
    starts = np.cumsum(np.r_[0, sizes[:-1]])
    h = _doubled(_mix(_codes(texts)), 1, _B, BASE)
    wide = _doubled(h, BASE, _B, 2 * BASE)
    h = _final(h).view(np.uint64)
    pick = _least(h, span - BASE + 1)
    first = np.arange(len(pick))
    text = np.searchsorted(starts, first, "right") - 1
    inside = first + span <= (starts + sizes)[text]  # the stretch that the window was taken from lies in one text
    pick, text = pick[inside], text[inside]
    new = np.flatnonzero(np.r_[True, pick[1:] != pick[:-1]]) if len(pick) else np.zeros(0, int)
    pick, text = pick[new], text[new]
    place = pick - starts[text]
    room_r, room_l = place + 2 * BASE <= sizes[text], place >= BASE
    wide = np.r_[_final(wide), np.zeros(2 * BASE, np.int64)]
    return text, place, h[pick].view(np.int64), np.where(room_r, wide[pick], 0), np.where(room_l, wide[np.maximum(pick - BASE, 0)], 0)


def _pieces(text: str, span: int) -> Iterator[tuple[int, str]]:
    """A text of many millions of characters in pieces that overlap by more than any stretch and its windows need."""
    step, over = 1 << 22, span + 4 * BASE
    at = 0
    while True:
        yield at, text[at : at + step + over]
        at += step
        if at + over >= len(text):
            return


def ladder(span: int) -> list[int]:
    """The lengths of windows, doubling, that leave room for an eighth of the one before in a stretch of `span` characters."""
    if span < BASE:
        raise ValueError(f"span must be at least {BASE} characters")
    sizes = [BASE]
    while span - 2 * sizes[-1] >= sizes[-1] // 8:
        sizes.append(2 * sizes[-1])
    return sizes


def offsets(before: int, size: int, span: int) -> list[int]:
    """Characters before a window of length `before` at which windows of length `size` begin: whatever the window's place in a
    stretch of `span` characters, one of them lies inside the stretch and holds it."""
    return sorted({*range(0, size - before, span - size), size - before}) if span > size else list(range(size - before + 1))


def _classes(docs: DataFrame) -> DataFrame:
    """(class, text_key, doc_id, n_chars) of each document; one class (128 bits) for all copies of a text. text_key: 64 bits
    that only say which texts to look into."""
    return docs.select(F.unhex(F.md5("text")).alias("class"), F.xxhash64("text").alias("text_key"), "doc_id", F.length("text").cast("bigint").alias("n_chars"))


def _repeated(windows: DataFrame, *key: str, text: str = "text_key") -> DataFrame:
    """The keys that occur in two texts or more; combined before the shuffle."""
    return windows.groupBy(*key).agg(F.min(text).alias("__a"), F.max(text).alias("__b")).where("__a <> __b").select(*key)


def _level_two(windows: DataFrame) -> DataFrame:
    """(text_key, place) of the windows of 128 characters, begun or ended by repeated ones of 64, that are repeated."""
    one = windows.join(_repeated(windows, "h64"), "h64", "left_semi").select("text_key", "place", "right", "left")
    sides = one.select("text_key", F.inline(F.array(F.struct("place", F.col("right").alias("h128")), F.struct((F.col("place") - BASE).alias("place"), F.col("left").alias("h128"))))).where("h128 <> 0")
    return sides.join(_repeated(sides, "h128"), "h128", "left_semi").select("text_key", "place").distinct()


def _wider(before: int, size: int, span: int, last: bool):
    """For each text the windows of `size` characters around its surviving ones: (class, text_key, start, h, g), and for the
    last level (before, after): the characters beside it up to `span`; before is reversed."""
    beside, steps = span - size, np.array(offsets(before, size, span))
    names = ["class", "text_key", "start", "h", "g"] + ["before", "after"] * last

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: dict[str, list] = {c: [] for c in names}
            for own, key, text, places in zip(pdf["class"].tolist(), pdf["text_key"].tolist(), pdf["text"].tolist(), pdf["places"].tolist(), strict=True):
                begin = np.unique((np.asarray(places, np.int64)[:, None] - steps[None, :]).ravel())
                begin = begin[(begin >= 0) & (begin + size <= len(text))]
                # in sections, so that a very long text needs no more memory than they do
                for section in np.unique(begin // SECTION).tolist():
                    low = section * SECTION
                    mixed = _mix(_codes([text[low : low + SECTION + size]]))
                    h, g = (_final(_doubled(mixed, 1, b, size)) for b in (_B, _B2))
                    mine = begin[begin // SECTION == section]
                    out["class"] += [own] * len(mine)
                    out["text_key"] += [key] * len(mine)
                    out["start"] += mine.tolist()
                    out["h"] += h[mine - low].tolist()
                    out["g"] += g[mine - low].tolist()
                    if last:
                        for s in mine.tolist():
                            out["before"].append(text[max(0, s - beside) : s][::-1])
                            out["after"].append(text[s + size : s + size + beside])
            yield pd.DataFrame(out)

    return run


def _candidate_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, text) of the documents that may have a wanted text_key: a filter of FILTER_BITS at most, hashed once, is
    sent to the tasks, so that texts without a candidate (but for its false hits) are read and not shuffled."""
    n = wanted.count()
    bits = min(FILTER_BITS, 1 << max(15, (16 * n).bit_length()))
    position = F.pmod(F.col("text_key"), F.lit(bits)) + 1  # positions and buckets count from 1
    # buckets of 32,768 bits: 2,048 at most
    parts = wanted.select(F.bitmap_bucket_number(position).alias("bucket"), F.bitmap_bit_position(position).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("map")).collect()
    table = np.zeros((bits // 32_768, 4096), np.uint8)
    for r in parts:
        table[r["bucket"] - 1] = np.frombuffer(bytes(r["map"]), np.uint8)
    table = table.ravel()
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        have = shared.value
        for pdf in batches:
            at = pdf["text_key"].to_numpy() % bits  # as pmod: never negative
            hit = (have[at // 8] >> (at % 8).astype(np.uint8)) & 1
            yield pdf.loc[hit.astype(bool), ["doc_id", "text"]]

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInPandas(keep, "doc_id bigint, text string")


def shared_groups(documents: DataFrame, span: int = 300) -> tuple[DataFrame, DataFrame]:
    """The classes of documents, and the groups: (k1, k2, class, start, end), a row per group, text and place.

    The texts of a group all have the `span` characters or more between start and end in common, to the letter (a group may be
    of one text that holds them twice), and every stretch of at least `span` characters (64 or more) that different texts share is covered by such groups.
    """
    sizes = ladder(span)
    docs = documents.select("doc_id", "text").where("doc_id is not null and text is not null")
    long = docs.where(F.length("text") >= span)

    def level_one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, texts, froms, size, parts = [], [], [], 0, []

            def flush():
                t, place, h, r, l_ = anchors(texts, span)
                frame = {"text_key": np.array(ids, np.int64)[t], "place": (place + np.array(froms)[t]).astype(np.int32), "h64": h, "right": r, "left": l_}
                parts.append(pd.DataFrame(frame))

            for i, whole in zip(pdf["text_key"].tolist(), pdf["text"].tolist(), strict=True):
                for at, t in _pieces(whole, span):
                    ids.append(i)
                    texts.append(t)
                    froms.append(at)
                    size += len(t)
                    if size > BATCH_CHARS:
                        flush()
                        ids, texts, froms, size = [], [], [], 0
            if ids:
                flush()
            if parts:
                yield pd.concat(parts)

    classes = cut(_classes(docs), "classes")
    hashed = long.select(F.xxhash64("text").alias("text_key"), "text")
    windows = cut(hashed.mapInPandas(level_one, "text_key bigint, place int, h64 bigint, right bigint, left bigint"), "windows")
    # two levels come out of one reading where 128 characters fit on either side
    done = 2 if span >= 3 * BASE else 1
    places = _level_two(windows) if done == 2 else windows.join(_repeated(windows, "h64"), "h64", "left_semi").select("text_key", "place").distinct()
    wanted = cut(places.groupBy("text_key").agg(F.collect_list("place").alias("places")), "places")  # the places of one text
    # of a class one text is read
    first = classes.join(wanted.select("text_key"), "text_key", "left_semi").groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.min("text_key").alias("text_key"))
    texts, size = _candidate_texts(long, wanted.select("text_key")), sizes[done - 1]
    levels = sizes[min(done, len(sizes) - 1) :]
    if len(levels) > 1:
        texts = cut(texts.join(first, "doc_id"), "texts")
    for longer in levels:
        last = longer == sizes[-1]
        there = texts.join(wanted, "text_key") if len(levels) > 1 else texts.join(first.join(wanted, "text_key"), "doc_id")
        schema = "class binary, text_key bigint, start int, h bigint, g bigint" + ", before string, after string" * last
        wide = cut(there.select("class", "text_key", "text", "places").mapInPandas(_wider(size, longer, span, last), schema), f"windows_{longer}")
        kept, size = wide.join(_repeated(wide, "h", "g"), ["h", "g"], "left_semi"), longer
        if not last:
            wanted = cut(kept.select("text_key", F.col("start").alias("place")).distinct().groupBy("text_key").agg(F.collect_list("place").alias("places")), "places")
    return classes, cut(_by_context(kept, sizes[-1], span), "groups")


def _by_context(windows: DataFrame, size: int, span: int) -> DataFrame:
    """(k1, k2, class, start, end) from repeated windows and what stands beside them."""
    beside = span - size
    key = lambda *c: (F.xxhash64(F.lit(1), *c).alias("k1"), F.xxhash64(*c, F.lit(2)).alias("k2"))
    context = F.xxhash64("before", F.lit(0), "after").alias("c1"), F.xxhash64(F.lit(3), "after", "before").alias("c2")
    rows = windows.select("h", "g", *context, "class", "text_key", "start", F.length("before").alias("l"), F.length("after").alias("r"), "before", "after")
    rows = cut(rows, "contexts")  # as it is read for each of the steps below
    # the contexts of a window, once each
    each = rows.groupBy("h", "g", "c1", "c2").agg(F.min("text_key").alias("a"), F.max("text_key").alias("b"), F.first("before").alias("before"), F.first("after").alias("after"))
    whole = each.where((F.col("a") != F.col("b")) & (F.length("before") + F.length("after") >= beside)).select("h", "g", "c1", "c2")
    full = rows.join(whole, ["h", "g", "c1", "c2"], "left_semi").select(*key("h", "g", "c1", "c2"), "class", (F.col("start") - F.col("l")).alias("start"), (F.col("start") + size + F.col("r")).alias("end"))
    # where there are several, the windows of `span` characters in them: j of these before the window
    several = each.groupBy("h", "g").agg(F.min("c1").alias("x"), F.max("c1").alias("y")).where("x <> y").select("h", "g")
    lowest, most = F.greatest(F.lit(0), beside - F.length("after")), F.least(F.lit(beside), F.length("before"))
    steps = F.when(lowest <= most, F.sequence(lowest, most)).otherwise(F.array().cast("array<int>"))
    parts = each.join(several, ["h", "g"], "left_semi").select("h", "g", "c1", "c2", "before", "after", F.explode(steps).alias("j"))
    parts = cut(parts.select("h", "g", "c1", "c2", "j", *key("h", "g", "j", F.expr("substring(before, 1, j)"), F.expr(f"substring(after, 1, {beside} - j)"))), "parts")
    again = parts.groupBy("k1", "k2").agg(F.min("c1").alias("x"), F.max("c1").alias("y")).where("x <> y").select("k1", "k2")
    exact = rows.select("h", "g", "c1", "c2", "class", "start").join(parts.join(again, ["k1", "k2"], "left_semi"), ["h", "g", "c1", "c2"])
    return full.unionByName(exact.select("k1", "k2", "class", (F.col("start") - F.col("j")).alias("start"), (F.col("start") - F.col("j") + span).alias("end")))


def _members(groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(k1, k2, class), each member of a group once, and (k1, k2, n, s, t) of the groups of several: their size and fingerprint."""
    members = cut(groups.select("k1", "k2", "class").distinct(), "members")
    # the set's fingerprint: its size and two sums (without carry) of independent hashes
    return members, members.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("class")).alias("s"), F.bit_xor(F.xxhash64(F.lit(7), "class")).alias("t")).where("n > 1")


def _links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b), a < b: the classes that share a group. Of the groups with the same members one is looked at."""
    kept = sets.groupBy("n", "s", "t").agg(F.min("k1").alias("k1"), F.min_by("k2", "k1").alias("k2")).select("k1", "k2", "n")
    return _pairs(cut(members.join(kept, ["k1", "k2"]), "kept"), ["k1", "k2"], "class").distinct()


def _pairs(members: DataFrame, by: list[str], id_col: str) -> DataFrame:
    """(a, b), a < b, of the members of each group (n: how many it has); groups of many members are shared out."""
    parts = F.ceil(F.col("n") / GROUP).cast("int")
    x = members.select(*by, F.col(id_col).alias("a"), F.pmod(F.xxhash64(id_col), parts).cast("int").alias("part"))
    y = members.select(*by, F.col(id_col).alias("b"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    return x.join(y, [*by, "part"]).where("a < b").select("a", "b")


def shared_pairs(documents: DataFrame, span: int = 300) -> DataFrame:
    """(doc_id, other_doc_id), doc_id the smaller: documents whose texts have `span` characters in a row in
    common, to the letter, each pair once, copies of a text included.

    Null texts and texts of under `span` characters share nothing; ids should be unique. The number of pairs grows with the
    square of the texts that have one passage in common: shared_share has a row per document instead.
    """
    classes, groups = shared_groups(documents, span)
    classes = classes.where(F.col("n_chars") >= span).select("class", "doc_id")
    links = _links(*_members(groups))
    across = links.join(classes.select(F.col("class").alias("a"), F.col("doc_id").alias("x")), "a").join(classes.select(F.col("class").alias("b"), F.col("doc_id").alias("y")), "b").select("x", "y")
    # the copies of a text with each other
    several = classes.groupBy("class").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    within = _pairs(classes.join(several, "class"), ["class"], "doc_id").select(F.col("a").alias("x"), F.col("b").alias("y"))
    return across.unionByName(within).select(F.least("x", "y").alias("doc_id"), F.greatest("x", "y").alias("other_doc_id"))


def shared_share(documents: DataFrame, span: int = 300) -> DataFrame:
    """(doc_id, class_id, n_chars, n_copies, n_links, shared_chars, shared_share) of each document.

    class_id: the smallest doc_id with the same text; n_copies: documents with it; n_links: other texts that
    share a stretch with it; shared_chars: characters that lie in a stretch of `span` characters or more that
    another document has, to the letter. Documents without id or text have no row.
    """
    classes, groups = shared_groups(documents, span)
    members, sets = _members(groups)
    groups = groups.join(sets.select("k1", "k2"), ["k1", "k2"], "left_semi")
    links = _links(members, sets).select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("n_links"))
    # stretches of one text, each beginning once with its farthest end: at most as many as the text has characters
    ends = groups.groupBy("class", "start").agg(F.max("end").alias("end"))
    w = Window.partitionBy("class").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    covered = ends.withColumn("seen", F.max("end").over(w)).groupBy("class").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce("seen", F.lit(0))))).alias("part"))
    group = classes.groupBy("class").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n_copies"))
    out = classes.join(group.join(links, "class", "left").join(covered, "class", "left"), "class")
    whole = (F.col("n_copies") > 1) & (F.col("n_chars") >= span)
    chars = F.when(whole, F.col("n_chars")).otherwise(F.coalesce("part", F.lit(0))).cast("bigint")
    return out.select("doc_id", F.col("first_id").alias("class_id"), "n_chars", "n_copies", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), chars.alias("shared_chars"), F.when(F.col("n_chars") > 0, chars / F.col("n_chars")).otherwise(0.0).alias("shared_share"))
