"""Running sums within groups of any size, in two levels, so that no group is ordered in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probelake.session import written


def hash_unit(*parts: Column | str | int) -> Column:
    """A number in [0, 1) from the parts, the same in every run."""
    return F.shiftrightunsigned(F.xxhash64(*[F.lit(p) if isinstance(p, (int, str)) else p for p in parts]), 11).cast("double") / float(1 << 53)


def running_sum(df: DataFrame, group: list[str], bucket: str, order: list[str], value: str | list[str], out: str | list[str]) -> DataFrame:
    """df with out = the sum of value over the rows of the group that come before this one, by bucket and then order; several values give as many sums in one pass.

    The buckets' sums are added up first, over one row per group and bucket; then each bucket is ordered on its own.
    A group thus spreads over as many tasks as it has buckets. Ties in order beyond the given columns are broken
    arbitrarily; nulls in group form one group, a null value counts as 0.
    """
    values, outs = ([value], [out]) if isinstance(value, str) else (value, out)
    keys = [*group, bucket]
    sums = df.groupBy(*keys).agg(*[F.coalesce(F.sum(v), F.lit(0)).alias(f"__sum{i}") for i, v in enumerate(values)])
    earlier = Window.partitionBy(*group).orderBy(bucket)
    renamed = sums.select(*[F.col(k).alias(f"__{i}") for i, k in enumerate(keys)], *[(F.sum(f"__sum{i}").over(earlier) - F.col(f"__sum{i}")).alias(f"__base{i}") for i in range(len(values))])
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    on = [F.col(k).eqNullSafe(F.col(f"__{i}")) for i, k in enumerate(keys)]
    joined = df.join(renamed, on, "left")
    made = {o: F.col(f"__base{i}") + F.coalesce(F.sum(F.coalesce(F.col(v), F.lit(0))).over(inside), F.lit(0)) for i, (v, o) in enumerate(zip(values, outs))}
    return joined.withColumns(made).select(*df.columns, *outs)


def by_range(df: DataFrame, *order: Column | str) -> DataFrame:
    """df written in range partitions of order, with __bucket, the partition's number: rows of equal order share one, and buckets follow the order."""
    return written(df.repartitionByRange(*order).withColumn("__bucket", F.spark_partition_id()), "ranges")


def ranked(df: DataFrame, order: list[str], out: str, group: list[str] | None = None) -> DataFrame:
    """df with out = the row's place from 1 on by order (ascending, total), in its group; no task orders a whole group."""
    placed = by_range(df, *(group or []), *order).withColumn("__one", F.lit(1))
    return running_sum(placed, group or [], "__bucket", order, "__one", out).withColumn(out, (F.col(out) + 1).cast("bigint")).drop("__bucket", "__one")


def following(df: DataFrame, group: list[str], bucket: str, order: str, out: str) -> DataFrame:
    """df with out = the next value of order in the group, null for the last: within a bucket by its own order, at its end the first value of the next bucket that has one."""
    keys = [*group, bucket]
    firsts = df.groupBy(*keys).agg(F.min(order).alias("__first"))
    firsts = firsts.withColumn("__edge", F.lead("__first").over(Window.partitionBy(*group).orderBy(bucket)))
    renamed = firsts.select(*[F.col(k).alias(f"__{i}") for i, k in enumerate(keys)], "__edge")
    on = [F.col(k).eqNullSafe(F.col(f"__{i}")) for i, k in enumerate(keys)]
    inside = F.lead(order).over(Window.partitionBy(*keys).orderBy(order))
    return df.join(renamed, on, "left").withColumn(out, F.coalesce(inside, F.col("__edge"))).select(*df.columns, out)
