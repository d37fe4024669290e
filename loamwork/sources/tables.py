"""Access to the Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Reads ``<sf_dir>/<name>.parquet``, a file or a folder, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
