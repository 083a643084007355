"""Readers with explicit schemas, and sinks that validate, promote or refuse."""

from __future__ import annotations

import csv
import io
import json
import uuid
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    """Hadoop's file system of a path, and the path as its own type."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """(file, metadata, articles) of JSON payloads {metadata, articles: [...]}: metadata as JSON text, articles as JSON texts."""
    raw = spark.read.schema("metadata string, articles array<string>").option("multiLine", True).json(path)
    return raw.select(F.input_file_name().alias("file"), "metadata", "articles")


def read_payload(spark: SparkSession, path: str, article: str, source: str | None = None) -> DataFrame:
    """The articles of JSON payloads, one row each; records that are not objects are skipped.

    article: the DDL of one record. source: only payloads whose metadata names it.
    """
    raw = read_payloads(spark, path)
    if source is not None:
        raw = raw.where(F.get_json_object("metadata", "$.source") == source)
    each = raw.select("file", F.explode("articles").alias("j")).where(r"ltrim(j) LIKE '{%'")
    return each.select("file", F.from_json("j", article).alias("a")).select("file", "a.*")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(file, text): whole files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """The column names in the first line of a CSV, or of one file of a folder of CSVs."""
    first = spark.read.text(path).limit(1).collect()
    return next(csv.reader(io.StringIO(first[0][0]))) if first else []


def read_csv(spark: SparkSession, path: str, schema: str, required: tuple[str, ...] | None = None) -> DataFrame:
    """A CSV with a header, read by name: columns of the schema in its order and types, whatever their order in the file.

    Raises if the file lacks a required column (by default all of the schema); others that it lacks are null, columns beyond
    the schema are left out, and so are values that don't fit their type (null). Extra files of a folder must have the same header.
    """
    want = StructType.fromDDL(schema)
    names = csv_header(spark, path)
    if missing := sorted(set(want.names if required is None else required) - set(names)):
        raise ValueError(f"missing columns: {missing}")
    if len(set(names)) < len(names):
        raise ValueError(f"repeated columns: {names}")
    as_text = StructType.fromDDL(", ".join(f"`{n}` string" for n in names)) if names else StructType()
    df = spark.read.schema(as_text).option("header", True).option("enforceSchema", False).csv(path)
    return df.select(*[(F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in names else F.lit(None).cast(f.dataType)).alias(f.name) for f in want])


def write_csv(df: DataFrame, path: str) -> None:
    """Write a CSV with a header in place of what is there. A small result of a few rows is one file."""
    promote(df, path, "csv")


def require_columns(df: DataFrame, schema: StructType | str) -> None:
    """Raise unless df has exactly these columns, in this order and of these types."""
    want = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    have = [(f.name, f.dataType) for f in df.schema]
    if have != [(f.name, f.dataType) for f in want]:
        raise ValueError(f"expected {want.simpleString()}, got {df.schema.simpleString()}")


def write_new(df: DataFrame, path: str, check: Callable[[DataFrame], None] | None = None, form: str = "parquet") -> None:
    """Write where nothing is yet; raises otherwise, and before anything is written if the check does."""
    if check:
        check(df)
    df.write.mode("errorifexists").format(form).option("header", True).save(path)


def promote(df: DataFrame, path: str, form: str = "parquet", check: Callable[[DataFrame], None] | None = None) -> None:
    """Write beside the target, then put it in the target's place by renames.

    A failed check or job leaves the old table. Should the second rename fail, the old table is put back. Readers between the two
    renames find no table (a folder cannot be replaced in one step); those that open it then must try again.
    """
    spark = df.sparkSession
    if check:
        check(df)
    staged, old = f"{path}.staging-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.format(form).option("header", True).save(staged)
    fs, target = _fs(spark, path)
    side, aside = _fs(spark, staged)[1], _fs(spark, old)[1]
    had = fs.exists(target)
    if had and not fs.rename(target, aside):
        fs.delete(side, True)
        raise OSError(f"could not set {path} aside")
    if not fs.rename(side, target):
        if had:
            fs.rename(aside, target)
        raise OSError(f"could not promote {staged}")
    if had:
        fs.delete(aside, True)


def promote_all(tables: dict[str, DataFrame]) -> None:
    """Promote several tables: all are written before the first one is put in place."""
    staged = {path: f"{path}.ready-{uuid.uuid4().hex}" for path in tables}
    for path, df in tables.items():
        df.write.parquet(staged[path])
    for path, ready in staged.items():
        df = tables[path].sparkSession.read.parquet(ready)
        promote(df, path)
        fs, p = _fs(df.sparkSession, ready)
        fs.delete(p, True)


def write_text(spark: SparkSession, path: str, text: str, force: bool = False) -> bool:
    """Write one file in one step (beside it, then renamed). Where it is there already it stays, unless force; was it written?"""
    fs, target = _fs(spark, path)
    if fs.exists(target) and not force:
        return False
    side = _fs(spark, f"{path}.tmp-{uuid.uuid4().hex}")[1]
    out = fs.create(side, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if fs.exists(target):
        fs.delete(target, False)
    if not fs.rename(side, target):
        fs.delete(side, False)
        raise OSError(f"could not write {path}")
    return True


def write_json_new(spark: SparkSession, path: str, value: dict) -> None:
    """Write one JSON document where nothing is yet; raises otherwise."""
    if not write_text(spark, path, json.dumps(value, indent=1, sort_keys=True, default=str)):
        raise FileExistsError(path)


def append_checkpoint(df: DataFrame, path: str, run: str) -> None:
    """Append scored rows as JSON lines, under the run's id."""
    df.withColumn("run_id", F.lit(run)).write.mode("append").json(path)


def load_checkpoint(spark: SparkSession, parquet: str | None, lines: str | None, schema: str, key: Sequence[str], seq: str = "seq") -> DataFrame:
    """The rows scored so far: those of a compacted table and those of JSON lines, of one key the last (by `seq`, lines after the
    table), each with first_seen, the least seq of its key. What is not there counts as empty."""
    from chronoloom.operators.news import last_wins

    parts: Iterable[tuple[str | None, Callable[[str], DataFrame], int]] = (
        (parquet, lambda p: spark.read.schema(schema).parquet(p), 0), (lines, lambda p: spark.read.schema(schema).json(p), 1))
    out = spark.createDataFrame([], f"{schema}, __part int")
    for path, read, order in parts:
        if path and _fs(spark, path)[0].exists(_fs(spark, path)[1]):
            out = out.unionByName(read(path).withColumn("__part", F.lit(order)))
    rank = F.struct(F.col("__part"), F.col(seq))
    best = last_wins(out.withColumn("__rank", rank), key, "__rank")
    return best.select(*StructType.fromDDL(schema).names, F.col(f"first_seen.{seq}").alias("first_seen"))
