"""Reading the corpus tables. Callers select the columns they use, so scans stay narrow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table as it lies; splits are the session's business (``spark.sql.files.maxPartitionBytes``)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
