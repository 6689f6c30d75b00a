"""Readers for the driver's Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of a folder of Parquet tables; any path Spark can open."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
