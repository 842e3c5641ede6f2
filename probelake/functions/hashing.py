"""Random choices that another engine can repeat: the first 32 bits of an md5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def h(seed: int | str, key: Column | str) -> Column:
    """A number in [0, 2**32) from the seed and the key, as in ('0x' || substr(md5(seed || ':' || key), 1, 8))."""
    text = F.concat(F.lit(f"{seed}:"), (F.col(key) if isinstance(key, str) else key).cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def h_sql(seed: int | str, key: str) -> str:
    """The same in SQL of another engine."""
    return f"('0x' || substr(md5('{seed}:' || CAST({key} AS VARCHAR)), 1, 8))::BIGINT"
