"""Duplicates hidden by formatting: canonical form, 128-bit hash, counts with map-side combining."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.session import cut

_OTHER = r"[^\p{L}\p{Nd}]+"
_NOT_MARKS = r"[^\p{L}\p{Nd}\p{M}]+"
#: What shows that a value is an address: a scheme or //; or, without white space before the parameters, a host with a dot, or a parameter with a value.
#: Possessive, so that a long text is looked at once.
_URL = r"(?i)^\W*+https?[^\w:]*+:|^[^\w/]*+//|^[^\s/?#.]++(?:\.[^\s/?#.]++)++(?:/[^\s?#]*+)?\?|^[^\s?#]*+\?[^\s?#=]*+="


@dataclass(frozen=True)
class Policy:
    """What counts. marks: are combining marks part of a letter (else they count for nothing, as do all but letters and digits)? form: a Unicode form
    (NFC, NFKC, ..) that texts are brought to first, in Python workers; None leaves them as they are. symbols: does a text without
    letters and digits stand for itself (else all of those are alike, as an empty text)? The default is what problem 1 asks for."""

    marks: bool = False
    form: str | None = None
    symbols: bool = False


PLAIN = Policy()


def letters(text: Column, policy: Policy = PLAIN) -> Column:
    """Letters and digits (and marks, by policy), in lower case; nothing else."""
    return F.regexp_replace(F.lower(text), _NOT_MARKS if policy.marks else _OTHER, "")


def canonical_value(text: Column, policy: Policy = PLAIN) -> Column:
    """letters() of a text; the parameters of an address (between ? and #, split at &) are sorted first."""
    query = r"(?s)^([^?#]*)\?([^#]*)(.*)$"
    own = lambda c: letters(c, policy)
    sorted_query = F.array_join(F.array_sort(F.transform(F.split(F.regexp_extract(text, query, 2), "&"), own)), "")
    whole = F.concat(own(F.regexp_extract(text, query, 1)), sorted_query, own(F.regexp_extract(text, query, 3)))
    out = F.when(text.contains("?") & text.rlike(_URL) & text.rlike(query), whole).otherwise(own(text))
    return F.when((out == "") & (text != ""), F.lower(F.trim(text))).otherwise(out) if policy.symbols else out


def canonical_record(*fields: Column, policy: Policy = PLAIN) -> Column:
    """One text for a record: the canonical values in sorted order. Null if a field is null."""
    return F.when(~F.exists(F.array(*fields), lambda x: x.isNull()), F.array_join(F.array_sort(F.array(*[canonical_value(f, policy) for f in fields])), "\n"))


def _formed(df: DataFrame, fields: tuple[str, ...], form: str) -> DataFrame:
    @F.pandas_udf("string")
    def bring(s: pd.Series) -> pd.Series:
        return s.map(lambda t: unicodedata.normalize(form, t), na_action="ignore")

    return df.withColumns({f: bring(f) for f in fields})


def keyed(df: DataFrame, id_col: str, fields: tuple[str, ...], policy: Policy = PLAIN) -> DataFrame:
    """(id, key, proof): a 128-bit hash of the canonical record, and an independent 64-bit one.

    Rows with a null in a field or in the id take no part.
    """
    names = [f"__f{i}" for i in range(len(fields))]
    df = df.select(F.col(id_col).alias("id"), *[F.col(f).alias(n) for n, f in zip(names, fields, strict=True)])
    df = _formed(df, tuple(names), policy.form) if policy.form else df
    whole = df.select("id", canonical_record(*[F.col(n) for n in names], policy=policy).alias("whole")).where("whole is not null and id is not null")
    return whole.select("id", F.unhex(F.md5("whole")).alias("key"), F.xxhash64("whole", F.length("whole")).alias("proof"))


def _groups(keys: DataFrame) -> DataFrame:
    """A row per (key, proof). Two records that share the 128-bit key but not the proof stay apart."""
    return keys.groupBy("key", "proof").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n_copies"))


def duplicate_counts(df: DataFrame, id_col: str, fields: tuple[str, ...], policy: Policy = PLAIN) -> DataFrame:
    """(first_id, n_copies, collided): one row per distinct record, with its smallest id and its row count.

    collided: other records have the same 128-bit key (told apart by the proof). Rows with a null in a
    field or the id take no part; an empty table gives no rows; repeated rows count as copies.
    """
    groups = _groups(keyed(df, id_col, fields, policy))
    # both hashes are of the whole record; the second exchange has a row per record only
    clash = groups.groupBy("key").agg(F.count(F.lit(1)).alias("n_records"), F.collect_list(F.struct("first_id", "n_copies")).alias("g"))
    return clash.select(F.inline("g"), (F.col("n_records") > 1).alias("collided"))


def copies(df: DataFrame, id_col: str, fields: tuple[str, ...], policy: Policy = PLAIN) -> DataFrame:
    """(first_id, copy_id): each copy beside the smallest id of its group; see duplicate_counts.

    Counts are combined before the shuffle, so a hot group costs a row per task. Rows then meet their group's first id by a join on
    fixed-size keys; a hot group's rows are split there by adaptive execution (its side of the groups is one row).
    """
    keys = cut(keyed(df, id_col, fields, policy), "record_keys")
    groups = _groups(keys).where("n_copies > 1").select("key", "proof", "first_id")
    rows = keys.join(groups, ["key", "proof"]).where("id <> first_id")
    return rows.select("first_id", F.col("id").alias("copy_id")).distinct()
