"""Readers for the parquet tables of one data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """``name`` under ``sf_dir``, one parquet file or a folder of them."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
