"""Scans of the parquet tables a query runs over."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronoloom.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A lazy scan; filters and columns are pushed into it."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
