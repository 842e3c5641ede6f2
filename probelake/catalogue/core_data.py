"""Queries of the general data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from probelake.operators.packed import packed_found
from probelake.sources.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_found(table(spark, sf_dir, "statements"), table(spark, sf_dir, "word_statements"))


QUERIES = {"p1_found": p1_found}
SQL: dict[str, str] = {}
