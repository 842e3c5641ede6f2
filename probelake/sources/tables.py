"""Reads the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table name of the folder: one parquet file, or a folder of them."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latest(df: DataFrame, key: str, columns: list[str], order: str = "ingested_at") -> DataFrame:
    """One row per key, the first delivered, with the columns; redelivered rows repeat their content. Rows of a null key count as one."""
    packed = F.min_by(F.struct(*columns), F.struct(F.col(order), *[F.col(c) for c in columns])).alias("__row")
    return df.groupBy(key).agg(packed).select(key, *[F.col("__row")[c].alias(c) for c in columns])
