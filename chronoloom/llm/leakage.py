"""Evaluation passages in training texts: q-gram lemma filter, diagonal bands, banded alignment.

Texts become words (runs of letters and digits, in lower case) joined by single spaces. The document is cut
into back-to-back q-grams; each is looked up among all q-grams of the items. A hit lies on a diagonal
(place in the document less place in the items). A region of n characters that matches but for e edits
keeps at least (n - q + 1) // q - e of the document's q-grams on diagonals at most e apart, as one edit
spoils at most one of them. Bands of diagonals overlap, so that each region lies within one. Regions with so many hits are verified
by alignment within the band, all windows of a batch at once. With no edits a band is one diagonal.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Q = 8  # bytes of a q-gram: one 64-bit word
#: Items are indexed in blocks of this many bytes (an index has up to 25 bytes for each): a task holds one of them at a time,
#: and takes its documents past all of them in one reading.
BLOCK_BYTES = 8 << 20
#: Hits that are expanded to items in one go; a batch with more is halved, a document with more meets the items in parts.
HITS = 1 << 21
#: Documents are looked at together up to this many bytes.
BATCH_BYTES = 4 << 20
_BITS = 20
_MIX = np.uint64(0x9E3779B97F4A7C15)
_ODD = re.compile(r"[^\w\x00-\x7f]+")
_ASCII = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def plain(text: str) -> bytes:
    """The words of a text, in lower case, with a space before, between and after them."""
    t = text.lower()
    if not t.isascii():
        t = _ODD.sub(" ", t)  # what is no word is rare there; within ASCII a table of bytes tells
    return b" " + b" ".join(t.encode().translate(_ASCII).split()) + b" "


def _slot(grams: np.ndarray) -> np.ndarray:
    return (grams * _MIX) >> np.uint64(64 - _BITS)


@dataclass
class Items:
    """A block of items: their bytes in a row, and every q-gram's places; ends: where the spaces of each are."""

    ids: np.ndarray
    starts: np.ndarray
    data: np.ndarray
    need: np.ndarray
    grams: np.ndarray
    first: np.ndarray
    count: np.ndarray
    places: np.ndarray
    table: np.ndarray
    ends: list[np.ndarray]

    @staticmethod
    def of(rows: list[tuple[int, bytes]], words: int, edits: int, exact: bool = False) -> Items | None:
        ids, parts, need, starts, spaces, at = [], [], [], [], [], 0
        for key, text in rows:
            ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
            if len(ends) <= words:
                continue
            # the shortest passage of so many words bounds the hits that a leak must give
            shortest = int((ends[words:] - ends[:-words]).min()) + 1
            if (shortest - edits - Q + 1) // Q - edits < 1 and edits and not exact:
                raise ValueError(f"item {key} has a passage of {words} words in {shortest} bytes: {edits} edits could spoil all of its {Q}-grams")
            need.append(max(1, (shortest - edits - Q + 1) // Q - edits))
            ids.append(key)
            spaces.append(ends)
            starts.append(at)
            parts.append(text + b"\0" * Q)
            at += len(text) + Q
        if not ids:
            return None
        data = np.frombuffer(b"".join(parts), np.uint8)
        grams = np.lib.stride_tricks.sliding_window_view(data, Q)
        places = np.flatnonzero((grams != 0).all(axis=1))
        value = np.ascontiguousarray(grams[places]).view("<u8").ravel()
        order = np.argsort(value, kind="stable")
        uniq, first, count = np.unique(value[order], return_index=True, return_counts=True)
        table = np.zeros(1 << _BITS, bool)
        table[_slot(uniq)] = True
        return Items(np.array(ids), np.array(starts), data, np.array(need), uniq, first.astype(np.int32), count.astype(np.int32), places[order].astype(np.int32), table, spaces)


def _hits(data: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """(place in the documents, number of the gram) of each back-to-back gram that the items have."""
    words = data.view("<u8")
    at = np.flatnonzero(items.table[_slot(words)])
    k = np.minimum(np.searchsorted(items.grams, words[at]), len(items.grams) - 1)
    sure = items.grams[k] == words[at]
    return at[sure] * Q, k[sure]


def _regions(where: np.ndarray, gram: np.ndarray, starts: np.ndarray, items: Items, edits: int) -> Iterator[np.ndarray]:
    """Rows (document, item, lowest diagonal of the band), in pieces, of each region that meets the bound.

    Counts are per document and item, so documents may be taken in parts, and so may the items of one document.
    """
    doc = np.searchsorted(starts, where, "right") - 1
    n = items.count[gram].astype(np.int64)
    if n.sum() <= HITS or len(where) < 2:
        parts = [slice(0, len(where))]
    else:
        # whole documents, as many as fit
        edges = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        total = np.add.reduceat(n, edges)
        part = np.cumsum(total) // HITS
        cuts = np.r_[edges[np.r_[True, part[1:] != part[:-1]]], len(where)]
        parts = [slice(a, b) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    for p in parts:
        # a document with more hits than that meets a few items at a time
        shares = -(-int(n[p].sum()) // HITS) or 1
        bounds = np.linspace(0, len(items.ids), min(shares, len(items.ids)) + 1).astype(int)
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            yield _banded(where[p], gram[p], doc[p], n[p], starts, items, edits, (lo, hi))


def _banded(where: np.ndarray, gram: np.ndarray, doc: np.ndarray, n: np.ndarray, starts: np.ndarray, items: Items, edits: int, only: tuple[int, int]) -> np.ndarray:
    first = items.first[gram].astype(np.int64)
    if only != (0, len(items.ids)):
        # a gram's places ascend: those of a range of items lie side by side
        low, high = items.starts[only[0]], items.starts[only[1]] if only[1] < len(items.ids) else len(items.data)
        ranges = [np.searchsorted(items.places[f : f + c], [low, high]) for f, c in zip(first.tolist(), n.tolist(), strict=True)]
        first, n = first + np.array([r[0] for r in ranges], np.int64), np.array([r[1] - r[0] for r in ranges], np.int64)
    place = items.places[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())].astype(np.int64)
    doc, where = np.repeat(doc, n), np.repeat(where, n)
    item = np.searchsorted(items.starts, place, "right") - 1
    diagonal = (where - starts[doc]) - (place - items.starts[item])
    width = 2 * edits + 1
    found = [np.zeros((0, 3), np.int64)]
    for shift in sorted({0, edits}):  # bands overlap by the edits, so that each region lies within one of them
        if not len(doc):
            continue
        band = (diagonal + shift) // width
        low, spread = int(band.min()), int(band.max() - band.min()) + 1
        # document, item and band in one number, as that sorts fastest; where they don't fit, documents and items are numbered anew first
        pair = doc * len(items.ids) + item
        if (int(pair.max()) + 1) * spread >= 1 << 62:
            names, pair = np.unique(pair, return_inverse=True)
        else:
            names = None
        key = np.sort(pair * spread + (band - low))
        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        hits = np.diff(np.r_[new, len(key)])
        at, band = np.divmod(key[new], spread)
        at = at if names is None else names[at]
        met = hits >= items.need[at % len(items.ids)]
        found.append(np.stack([at[met] // len(items.ids), at[met] % len(items.ids), (band[met] + low) * width - shift], 1))
    return np.concatenate(found)


def exact_run(doc: np.ndarray, item: np.ndarray, diagonal: int, words: int) -> bool:
    """Alignment along one diagonal: do so many words in a row agree? (A band of width one.)"""
    lo, hi = max(0, -diagonal), min(len(item), len(doc) - diagonal)
    if hi <= lo:
        return False
    a, b = item[lo:hi], doc[lo + diagonal : hi + diagonal]
    breaks = np.flatnonzero(a != b)
    spaces = np.cumsum(np.r_[0, (a == 32) & (a == b)])
    edges = np.r_[-1, breaks, len(a)]
    # a run of n spaces holds n - 1 whole words
    return bool((spaces[edges[1:]] - spaces[edges[:-1] + 1] > words).any())


def banded(passages: np.ndarray, lengths: np.ndarray, data: np.ndarray, at: np.ndarray, edits: int) -> np.ndarray:
    """Banded alignment of many passages at once: does passage i occur in data around place at[i] with at most so many edits?

    passages: their bytes, a row each, padded; lengths: how many count. Diagonals up to 2 * edits from at[i] are
    looked at; the passage may begin and end on any of them. Cost: a step per byte of the longest passage.
    """
    half = 2 * edits
    k = np.arange(-half, half + 1)
    best = np.full(len(lengths), edits + 1)
    row = np.zeros((len(lengths), len(k)), np.int64)
    padded = np.concatenate([np.zeros(half + 1, np.uint8), data, np.zeros(passages.shape[1] + half + 2, np.uint8)])
    live = np.arange(len(lengths))
    for y in range(passages.shape[1]):
        # byte y of the passage against the bytes y + k further on; places outside of the data match nothing
        place = at[live][:, None] + y + k
        text = padded[np.clip(place + half + 1, 0, len(padded) - 1)]
        same = (text == passages[live, y][:, None]) & (place >= 0) & (place < len(data))
        moved = row + ~same
        moved[:, :-1] = np.minimum(moved[:, :-1], row[:, 1:] + 1)
        row = np.minimum.accumulate(moved - k, axis=1) + k
        done = lengths[live] == y + 1
        best[live[done]] = row[done].min(axis=1)
        keep = ~done & (row.min(axis=1) <= edits)
        live, row = live[keep], row[keep]
        if not len(live):
            break
    return best <= edits


def _near(rows: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, items: Items, words: int, edits: int) -> np.ndarray:
    """Which of the regions hold a passage of so many words with at most so many edits?"""
    out = np.zeros(len(rows), bool)
    for lo in range(0, len(rows), 256):
        owner, texts, places = [], [], []
        for r, (d, i, band) in enumerate(rows[lo : lo + 256].tolist(), lo):
            ends, base = items.ends[i], int(items.starts[i])
            # the windows that meet the document at all
            first = ends[:-words] + band + edits
            for w in np.flatnonzero((first + (ends[words:] - ends[:-words]) + 2 * edits >= 0) & (first - 2 * edits < sizes[d])).tolist():
                owner.append(r)
                texts.append(items.data[base + ends[w] : base + ends[w + words] + 1])
                places.append(int(starts[d]) + int(ends[w]) + band + edits)
        if owner:
            lengths = np.array([len(t) for t in texts])
            passages = np.zeros((len(texts), lengths.max()), np.uint8)
            for r, t in enumerate(texts):
                passages[r, : len(t)] = t
            out[np.array(owner)[banded(passages, lengths, data, np.array(places), edits)]] = True
    return out


def _batch(keys: list[int], texts: list[bytes], items: Items, words: int, edits: int, exact: bool = False) -> Iterator[tuple[int, int]]:
    padded = [t + b"\0" * (2 * Q - len(t) % Q) for t in texts]
    starts = np.cumsum([0] + [len(t) for t in padded[:-1]])
    data = np.frombuffer(b"".join(padded), np.uint8)
    for rows in _regions(*_hits(data, items), starts, items, edits):
        if edits and len(rows):
            rows = rows[_near(rows, data, starts, np.array([len(t) for t in texts]), items, words, edits)]
        seen = set()
        for d, i, band in rows.tolist():
            if (d, i) in seen:
                continue
            if exact or not edits:
                lo = int(items.starts[i])
                hi = int(items.starts[i + 1]) if i + 1 < len(items.starts) else len(items.data)
                doc, item = data[int(starts[d]) : int(starts[d]) + len(texts[d])], items.data[lo : hi - Q]
                if not any(exact_run(doc, item, g, words) for g in range(band, band + 2 * edits + 1)):
                    continue
            seen.add((d, i))
            yield keys[d], int(items.ids[i])


def leaked_pairs(documents: DataFrame, items: DataFrame, words: int = 13, edits: int = 0, exact: bool = False) -> DataFrame:
    """(doc_id, item_id): documents that hold `words` words in a row of an item, each pair once.

    documents: doc_id, text; items: item_id, text. Words are runs of letters and digits, case aside; all
    other characters only separate. edits: up to so many edits of bytes (of a character in ASCII: one) in the passage count too;
    raises if an item's passage is too short for the q-gram lemma to hold at that budget. exact: of what is found within the budget, only passages
    that agree word for word (these have all their q-grams, so no passage is too short).
    Null and blank texts and items of fewer words hold nothing. Items come to the driver in blocks of at
    most BLOCK_BYTES, one at a time; documents are never shuffled, are read once whatever the items, and whole.
    """
    spark = documents.sparkSession
    docs = documents.select("doc_id", "text").where("doc_id is not null and text is not null")
    rows = items.select("item_id", "text").where("item_id is not null and text is not null").toLocalIterator()
    blocks = [spark.sparkContext.broadcast(index) for block in _blocks(rows) if (index := Items.of(block, words, edits, exact))]

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found: list[tuple[int, int]] = []
            for keys, texts in _parts(pdf, BATCH_BYTES if len(blocks) == 1 else 8 * BATCH_BYTES):
                for block in blocks:
                    found += _batch(keys, texts, block.value, words, edits, exact)
                    if len(blocks) > 1:
                        vars(block).pop("_value", None)  # a task holds one block at a time
            yield pd.DataFrame(found, columns=["doc_id", "item_id"], dtype="int64")

    return docs.mapInPandas(search, "doc_id bigint, item_id bigint").distinct()


def _parts(pdf: pd.DataFrame, most: int) -> Iterator[tuple[list[int], list[bytes]]]:
    """The documents in parts of about so many bytes."""
    keys, texts, size = [], [], 0
    for key, text in zip(pdf["doc_id"].tolist(), pdf["text"].tolist(), strict=True):
        keys.append(key)
        texts.append(plain(text))
        size += len(texts[-1])
        if size > most:
            yield keys, texts
            keys, texts, size = [], [], 0
    if keys:
        yield keys, texts


def _blocks(rows: Iterator) -> Iterator[list[tuple[int, bytes]]]:
    block, size = [], 0
    for r in rows:
        text = plain(r["text"])
        if block and size + len(text) > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((r["item_id"], text))
        size += len(text)
    if block:
        yield block
