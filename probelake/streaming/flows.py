"""Structured streams: scores of arriving vectors, the state of trials, windows over events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from probelake.operators.meandiff import decision
from probelake.operators.registry import latest_by_key
from probelake.session import fresh


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def scored_stream(vectors: DataFrame, probes: DataFrame, vec: str = "vec") -> DataFrame:
    """vectors (layer, vec, ...) with score; probes, one row a layer, is a static table."""
    return vectors.join(F.broadcast(probes), "layer").select(*vectors.columns, decision(vec).alias("score"))


def windowed_counts(events: DataFrame, every: str = "1 hour", late: str = "2 hours", time: str = "ts", kind: str = "event_type", value: str = "value") -> DataFrame:
    """(start, kind, n, total) of events in windows; events later than the watermark are not counted."""
    marked = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    out = marked.groupBy(F.window(time, every).alias("w"), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("start"), kind, "n", "total")


def upsert_sink(path: str, key: str, order: list[str]):
    """A function for foreachBatch that keeps the latest row of each key: each batch adds one row a key to a log, of which latest_state() is the view. A batch that is written again replaces its own rows."""

    def write(batch: DataFrame, batch_id: int) -> None:
        latest_by_key(batch, [key], order).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def latest_state(spark: SparkSession, path: str, key: str, order: list[str]) -> DataFrame:
    """The last row of each key over all batches."""
    log = spark.read.parquet(path)
    return latest_by_key(log, [key], [*order, "batch"]).drop("batch")


def trial_states(log: DataFrame, key: str = "trial_id") -> DataFrame:
    """(key, updates, best): how many updates each trial has had and its best progress, kept as state per key; a trial's rows of a batch are folded into two numbers."""

    def fold(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, best = state.get if state.exists else (0, float("-inf"))
        for part in parts:
            n += len(part)
            top = part["progress"].max()
            best = max(best, float(top)) if top == top and top is not None else best
        state.update((n, best))
        yield pd.DataFrame({key: [k[0]], "updates": [n], "best": [best]})

    out = f"{key} string, updates bigint, best double"
    return log.groupBy(key).applyInPandasWithState(fold, out, "updates bigint, best double", "update", GroupStateTimeout.NoTimeout)


def deduplicated(events: DataFrame, key: str = "event_id", time: str = "ts", late: str = "2 hours") -> DataFrame:
    """Events once each, as long as the repetition comes within the watermark."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def run_once(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and returns the result as a table in the shared folder, of any size: the last batch of mode complete, all batches of the others. A batch that is written again replaces its own rows."""
    path, batches = fresh(df.sparkSession, "results"), []

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{batch_id}")
        batches.append(batch_id)

    q = df.writeStream.foreachBatch(write).queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if not batches:
        return df.sparkSession.createDataFrame([], df.schema)
    kept = [max(batches)] if mode == "complete" else sorted(set(batches))
    return df.sparkSession.read.schema(df.schema).parquet(*[f"{path}/{i}" for i in kept])
