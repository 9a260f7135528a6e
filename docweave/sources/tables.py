"""Readers for the engine's parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Table ``name`` below ``root``; a file or a folder of files."""
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")
