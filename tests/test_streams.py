"""Streams whose results are larger than the driver takes."""

from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

from probelake.session import fresh
from probelake.streaming import flows as S


@pytest.fixture
def numbers(spark):
    path = fresh(spark, "numbers")
    spark.range(0, 1000, 1, 3).select("id", F.expr("timestamp '2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, id)").alias("ts")).write.parquet(path)
    return path, spark.read.parquet(path).schema


def _ran(spark, df, mode):
    return S.run_once(df, f"t_{uuid.uuid4().hex}", fresh(spark, "offsets"), mode)


def test_results_of_a_stream_stay_out_of_the_driver(spark, numbers):
    out = _ran(spark, S.read_stream(spark, *numbers, 1).select("id"), "append")
    assert sorted(r.id for r in out.collect()) == list(range(1000))
    assert out.inputFiles()  # files, not rows held in the driver


def test_modes_keep_their_batches(spark, numbers):
    counts = S.read_stream(spark, *numbers, 1).groupBy((F.col("id") % 2).alias("k")).count()
    assert {tuple(r) for r in _ran(spark, counts, "complete").collect()} == {(0, 500), (1, 500)}
    updates = _ran(spark, counts, "update")
    assert updates.count() == 6 and {tuple(r) for r in updates.groupBy("k").agg(F.max("count")).collect()} == {(0, 500), (1, 500)}


def test_a_stream_without_files_gives_an_empty_table(spark, numbers):
    path = fresh(spark, "none")
    spark.range(0).select(F.col("id"), F.current_timestamp().alias("ts")).limit(0).write.parquet(path)
    out = _ran(spark, S.read_stream(spark, path, numbers[1]).where("id < 0"), "append")
    assert out.columns == ["id", "ts"] and out.count() == 0


def test_repeated_events_are_read_by_all_cores_and_come_once(spark, sf, monkeypatch):
    from pathlib import Path

    from probelake.catalogue import flows

    paths = []
    read = S.read_stream
    monkeypatch.setattr(S, "read_stream", lambda spark, path, schema, *n: (paths.append(path), read(spark, path, schema, *n))[1])
    got = flows.QUERIES["stream_deduplicated"](spark, sf)
    files = list(Path(paths[0].removeprefix("file:")).glob("*.parquet"))
    assert 2 * spark.sparkContext.defaultParallelism <= len(files) <= 2 * flows._FILES  # one trigger takes 100
    n = spark.read.parquet(f"{sf}/events.parquet").count()
    assert got.count() == got.select("event_id").distinct().count() == n and spark.read.parquet(paths[0]).count() == 2 * n
