"""Reading the tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """One Parquet table of ``folder``, with just the named columns if any are named."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*[f"`{c}`" for c in columns]) if columns else df
