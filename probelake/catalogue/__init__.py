"""Named queries, each with its SQL for another engine where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

#: Modules of this package with QUERIES (name to query) and SQL (name to text).
FAMILIES = ("core_data", "probing", "language", "models", "flows", "records")


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for family in FAMILIES:
        found |= import_module(f"{__name__}.{family}").QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for family in FAMILIES:
        found |= import_module(f"{__name__}.{family}").SQL
    return found
