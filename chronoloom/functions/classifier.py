"""A sentence classifier (positive, negative, neutral) that is trained here: hashed words, naive Bayes in one aggregation.

Counts are taken over all labelled rows by Spark; the model that comes to the driver has SLOTS * 3 numbers, whatever the corpus.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLASSES = ("pos", "neg", "neu")
SLOTS = 1 << 15
_WORD = re.compile(r"[^\W_]+")


def label(score: Column, margin: float = 0.2) -> Column:
    """The class of a score from -1 to 1: neutral within the margin; null for null."""
    return F.when(score > margin, "pos").when(score < -margin, "neg").when(score.isNotNull(), "neu")


@dataclass(frozen=True)
class Classifier:
    """log_prior: 3 numbers; log_word: SLOTS x 3. Call it with texts: (pos, neg, neu) of each, adding up to 1."""

    log_prior: np.ndarray
    log_word: np.ndarray

    def __call__(self, texts: Sequence[str]) -> list[tuple[float, float, float]]:
        rows, slots = [], []
        for i, t in enumerate(texts):
            words = {zlib.crc32(w.encode()) % SLOTS for w in _WORD.findall(t.lower())}
            slots += words
            rows += [i] * len(words)
        total = np.tile(self.log_prior, (len(texts), 1))
        np.add.at(total, np.array(rows, int), self.log_word[np.array(slots, int)])
        p = np.exp(total - total.max(axis=1, keepdims=True)) if len(texts) else total
        return [tuple(r) for r in (p / p.sum(axis=1, keepdims=True)).tolist()]


def train(rows: DataFrame, text: str, label_col: str, smoothing: float = 1.0) -> Classifier:
    """Fit to all rows that have a text and a known class. A word counts once per text. Without rows all classes are alike."""
    known = rows.where(F.col(text).isNotNull() & F.col(label_col).isin(*CLASSES)).select(F.col(label_col).alias("label"), F.lower(text).alias("t"))
    n = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    words = F.array_distinct(F.transform(F.regexp_extract_all("t", F.lit(r"[\p{L}\p{Nd}]+"), 0), lambda w: F.crc32(w.cast("binary")) % SLOTS))
    counts = np.zeros((SLOTS, 3))
    for r in known.select("label", F.explode(words).alias("slot")).groupBy("slot", "label").agg(F.count(F.lit(1)).alias("n")).collect():  # SLOTS * 3 rows at most
        counts[r["slot"], CLASSES.index(r["label"])] = r["n"]
    size = np.array([n.get(c, 0) for c in CLASSES], float)
    return Classifier(np.log((size + 1) / (size.sum() + 3)), np.log((counts + smoothing) / (size + 2 * smoothing)))
