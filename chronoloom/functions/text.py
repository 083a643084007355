"""Texts: sentences, transcript sections, visible text of HTML, and scores of sentences."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Elements whose content isn't shown, elements that begin a line, and the section markers.
HIDDEN = ("script", "style", "noscript")
BREAKING = ("p", "div", "br", "li", "h1", "h2", "h3", "section")
START_MARKERS = ("Earnings Call Transcript", "Full Conference Call Transcript", "Prepared Remarks")
END_MARKERS = ("Premium Investing Services", "Stocks Mentioned", "This article is a transcript")
#: White space of any script, as a character class that both regex engines read alike.
SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"
LEAST_WORDS = 4
#: Stands for the end of a sentence while a text is cut.
_END = "\u0001"


def sentences(text: Column) -> Column:
    """The sentences of a text that have four words or more, white space collapsed; null for null.

    A sentence ends behind . ! or ?: where a blank line follows at once, or where a capital follows after white
    space. Other line ends are white space.
    """
    t = F.regexp_replace(F.replace(text, F.lit(_END), F.lit(" ")), r"\r\n?", "\n")
    t = F.regexp_replace(t, r"([.!?])\n\n+", f"$1{_END}")
    t = F.regexp_replace(t, rf"{SPACE}+", " ")
    t = F.regexp_replace(t, r"([.!?]) ([A-Z])", f"$1{_END}$2")
    return F.filter(F.transform(F.split(t, _END), lambda p: F.trim(p)), lambda p: F.size(F.split(p, " ")) >= LEAST_WORDS)


def trimmed(text: Column, starts: tuple[str, ...] = START_MARKERS, ends: tuple[str, ...] = END_MARKERS) -> Column:
    """A text from its earliest start marker to the earliest end marker after that; whole where there are none."""
    first = F.array_min(F.filter(F.array(*[F.instr(text, m) for m in starts]), lambda p: p > 0))
    rest = F.substr(text, F.coalesce(first, F.lit(1)))
    last = F.array_min(F.filter(F.array(*[F.instr(rest, m) for m in ends]), lambda p: p > 0))
    return F.trim(F.when(last.isNotNull(), F.substr(rest, F.lit(1), last - 1)).otherwise(rest), F.lit(" \t\r\n"))


def missing_markers(text: Column, markers: tuple[str, ...]) -> Column:
    """Those of the markers that a text lacks; all of them for a null text."""
    return F.filter(F.array(*[F.lit(m) for m in markers]), lambda m: ~F.coalesce(F.contains(text, m), F.lit(False)))


_UNSEEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({'|'.join(HIDDEN)})\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>", re.I | re.S)
_TAG = re.compile(r"""(</?[a-z](?:[^<>"']|"[^"]*"|'[^']*')*>)""", re.I)
_BREAK = re.compile(rf"<(?:/?(?:{'|'.join(t for t in BREAKING if t != 'br')})|br)\b", re.I)


def visible_text(page: str | None) -> str | None:
    """What a page shows: a line per block, pieces of a line joined as they stand, blank lines left out."""
    if page is None:
        return None
    # what isn't shown is an empty tag; after that, every second piece is a tag
    pieces = _TAG.split(_UNSEEN.sub("<i>", page))
    shown = ["\n" if _BREAK.match(p) else "" if k % 2 else " ".join(entities.unescape(p).split()) for k, p in enumerate(pieces)]
    return "".join(f"{line}\n" for line in "".join(shown).split("\n") if line) or "\n"


def visible(df: DataFrame, html: str, out: str) -> DataFrame:
    """Add the visible text of an HTML column."""

    @F.pandas_udf("string")
    def show(s: pd.Series) -> pd.Series:
        return s.map(visible_text, na_action="ignore")

    return df.withColumn(out, show(html))


Scorer = Callable[[list[str]], list[tuple[float, float, float]]]


def label_of(name: str) -> str:
    """The short name (pos, neg, neu) of a class; raises for others."""
    short = name.strip().lower()[:3]
    if short not in ("pos", "neg", "neu") or name.strip().lower() not in (short, {"pos": "positive", "neg": "negative", "neu": "neutral"}[short]):
        raise ValueError(f"unknown class {name!r}")
    return short


def score_sentences(df: DataFrame, text: str, scorer: Scorer, batch: int = 32) -> DataFrame:
    """Add score: a struct of pos, neg and neu, by any scorer of lists of texts, in batches; its parts are null for a null text."""

    @F.pandas_udf("struct<pos:double,neg:double,neu:double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in parts:
            texts = s.fillna("").tolist()
            rows = [r for i in range(0, len(texts), batch) for r in scorer(texts[i : i + batch])]
            out = pd.DataFrame(rows, columns=["pos", "neg", "neu"], dtype=float)
            out.loc[s.isna().to_numpy()] = None
            yield out

    return df.withColumn("score", run(text))


def call_aggregate(scores: DataFrame, by: str) -> DataFrame:
    """Per call: mean pos, neg and neu, and the shares of sentences whose largest score is pos or neg
    (of equal ones pos before neg before neu)."""
    p, n, u = (F.col(f"score.{c}") for c in ("pos", "neg", "neu"))
    is_pos = (p >= n) & (p >= u)
    return scores.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_sentences"), F.avg(p).alias("pos_mean"), F.avg(n).alias("neg_mean"), F.avg(u).alias("neu_mean"),
        F.avg(is_pos.cast("double")).alias("pos_frac"), F.avg((~is_pos & (n >= u)).cast("double")).alias("neg_frac"),
    )
