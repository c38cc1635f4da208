"""Reading the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One table of a data directory; a parquet file or a folder of them."""
    return spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")
