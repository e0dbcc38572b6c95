"""Reading tables. The engine works on frames; this is the harness's way to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder; column pruning and filters reach the scan."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def write_table(df: DataFrame, folder: str, name: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(f"{folder.rstrip('/')}/{name}.parquet")
