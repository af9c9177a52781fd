"""Readers for the Parquet tables that the engine's views are built on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``folder`` (a file or a directory of part files)."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
