"""Parquet tables of one data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table `name` of `folder`, a file or a directory of Parquet files."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
