"""What an intervention did to predicted probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probelake.functions.vectors import total


def natural_effects(df: DataFrame, y: str, before: Column, after: Column) -> DataFrame:
    """(nie_ft, nie_tf): how far the intervention moves false rows towards true ones, and the reverse; before and after are p0 - p1."""
    mean = lambda v, c: F.avg(F.when(F.col(y) == c, v))
    s = df.agg(mean(before, 0).alias("n"), mean(before, 1).alias("p"), mean(after, 0).alias("na"), mean(after, 1).alias("pa"))
    return s.select(((F.col("na") - F.col("n")) / (F.col("p") - F.col("n"))).alias("nie_ft"), ((F.col("pa") - F.col("p")) / (F.col("n") - F.col("p"))).alias("nie_tf"))


def indirect_effect(df: DataFrame, change: Column) -> DataFrame:
    """(effect, t): the mean change and its ratio to the standard error."""
    s = df.agg(F.avg(change).alias("effect"), F.stddev_samp(change).alias("sd"), F.count(change).alias("n"))
    return s.select("effect", F.when(F.col("sd") > 0, F.col("effect") / (F.col("sd") / F.sqrt("n"))).alias("t"))


def decoherence(before: Column, after: Column) -> Column:
    """What the valid options leave over, after over before."""
    return (1 - total(after)) / (1 - total(before))


def localized_ratio(df: DataFrame, before: Column, after: Column, chosen: list[int], others: list[int]) -> DataFrame:
    """(ratio): absolute changes of the chosen options over those of the others."""
    change = lambda ids: sum((F.abs(F.get(after, F.lit(i)) - F.get(before, F.lit(i))) for i in ids), F.lit(0.0))
    return df.agg((F.sum(change(chosen)) / F.sum(change(others))).alias("ratio"))


def log_probability(df: DataFrame, key: str, p: Column) -> DataFrame:
    """(key, logp): the sum over rows of ln(p + 1e-6)."""
    return df.groupBy(key).agg(F.sum(F.log(p + 1e-6)).alias("logp"))
