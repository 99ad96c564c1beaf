"""Reading of the given tables by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import prepare


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table of a folder, read through Spark alone (any store that Spark knows)."""
    return prepare(spark).read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")
