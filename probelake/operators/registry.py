"""Trial logs and artefacts: latest state by key, layers done and due, best layers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_by_key(df: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    """The last row of each key; null orders come first. Only max states are shuffled, not all rows."""
    cols = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*cols), F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])).alias("__r")).select(*key, "__r.*")


def upserted(current: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """current with the changes' rows in place of or beside its own; both have the same columns, keys once each."""
    return current.join(changes.select(key), key, "left_anti").unionByName(changes)


def stamped(df: DataFrame) -> DataFrame:
    """df with the wall clock's date and time as text."""
    return df.withColumn("date", F.date_format(F.current_timestamp(), "yyyy-MM-dd")).withColumn("time", F.date_format(F.current_timestamp(), "HH:mm"))


def number_in(name: Column, pattern: str, default: int | None = None) -> Column:
    """The number that the pattern's first group finds in a name; default where it finds none."""
    found = F.regexp_extract(name, pattern, 1)
    got = F.when(found != "", found.cast("int"))
    return F.coalesce(got, F.lit(default)) if default is not None else got


def layer_range(layers: list[int], span: tuple[float, float]) -> tuple[int, int]:
    """The layers at the closest observations to the two quantiles: place round(q * n) of the sorted ones, halves towards the even one, counted from 1."""
    layers = sorted(set(layers))

    def at(q: float) -> int:
        # closest observation: with j = floor(q n - 1/2), a whole rest goes to the even one of the two
        n = len(layers)
        g = q * n - 0.5
        j = math.floor(g)
        place = j if g == j and j % 2 == 0 else j + 1
        return layers[min(max(place, 1), n) - 1]

    return at(span[0]), at(span[1])


def layers_due(wanted: DataFrame, done: DataFrame, low: int) -> DataFrame:
    """(layer): wanted layers that are not done, and the one before the first of them unless below low."""
    missing = wanted.select("layer").distinct().join(done.select("layer").distinct(), "layer", "left_anti")
    redo = missing.agg((F.min("layer") - 1).cast("int").alias("layer")).where(F.col("layer") >= low)
    return missing.unionByName(redo).distinct()


def best_layer(metrics: DataFrame, metric: str = "metric", group: list[str] | None = None) -> DataFrame:
    """(group, layer, metric): the layer with the largest metric above -1, ties to the smallest layer."""
    rows = metrics.where(F.col(metric) > -1)
    best = F.max(F.struct(F.col(metric).alias("m"), (-F.col("layer")).alias("l"))).alias("b")
    out = (rows.groupBy(*group) if group else rows.groupBy()).agg(best).where("b is not null")
    return out.select(*(group or []), (-F.col("b.l")).alias("layer"), F.col("b.m").alias(metric))


def top_layers(metrics: DataFrame, k: int, metric: str = "metric") -> DataFrame:
    return metrics.orderBy(F.desc(metric), "layer").limit(k)


def generalization(own: DataFrame, other: DataFrame, metric: str = "metric") -> DataFrame:
    """(layer, metric): the layer whose mean of two data sets' metrics is largest."""
    both = own.select("layer", F.col(metric).alias("a")).join(other.select("layer", F.col(metric).alias("b")), "layer")
    return best_layer(both.select("layer", ((F.col("a") + F.col("b")) / 2).alias(metric)), metric)


def with_fallback(df: DataFrame, out: str, *columns: str) -> DataFrame:
    """df with out as the first of the columns that it has and that is not null."""
    have = [F.col(c) for c in columns if c in df.columns]
    return df.withColumn(out, F.coalesce(*have) if have else F.lit(None))


def reconciled(vectors: DataFrame, frame: DataFrame, key: str = "row_id") -> DataFrame:
    """(side, n): keys that only one of the two tables has; no rows if they agree."""
    v, f = vectors.select(key).distinct(), frame.select(key).distinct()
    missing = f.join(v, key, "left_anti").select(F.lit("no vector").alias("side")).unionByName(v.join(f, key, "left_anti").select(F.lit("no row").alias("side")))
    return missing.groupBy("side").agg(F.count("*").alias("n"))


def batched(df: DataFrame, size: int, order: str) -> DataFrame:
    """df with batch: as many batches as size goes into the rows, one at least, the first ones a row longer."""
    from probelake.operators.ranks import ranked

    n = df.count()
    k = max(1, n // size)
    long, extra = n // k + 1, n % k
    place = F.col("__p") - 1
    batch = F.when(place < extra * long, F.floor(place / long)).otherwise(extra + F.floor((place - extra * long) / max(1, long - 1)))
    return ranked(df, [order], "__p").withColumn("batch", (batch + 1).cast("int")).drop("__p")


def progress(log: DataFrame, key: str = "trial_id", order: list[str] | None = None) -> DataFrame:
    """log with step, each key's updates numbered in order."""
    return log.withColumn("step", F.row_number().over(Window.partitionBy(key).orderBy(*(order or ["date", "time", "progress"]))))
