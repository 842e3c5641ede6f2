"""Stored probes: what a trial left, its layers, and predictions with it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probelake.operators import conformal, meandiff, registry


@dataclass(frozen=True)
class ProbeReader:
    """The artefacts of one trial: trial_id, layer, direction (or, in older tables, coef), bias, mu, sd, metrics (JSON); calibration, where kept: layer, y, score."""

    table: DataFrame
    calibration: DataFrame | None = None

    @classmethod
    def of(cls, spark: SparkSession, path: str, trial: str, calibration: DataFrame | None = None) -> ProbeReader:
        """The trial of a folder that sources.files.write_probes wrote; only its partitions are read."""
        return cls(spark.read.parquet(path).where(F.col("trial_id") == trial), calibration)

    def probes(self, layer: int | None = None) -> DataFrame:
        """(layer, direction, bias, mu, sd), of one layer or all; a table without mu and sd has null ones."""
        rows = self.table if layer is None else self.table.where(F.col("layer") == layer)
        rows = registry.with_fallback(rows, "direction", "direction", "coef")
        for c in ("bias", "intercept"):
            rows = rows if c in rows.columns else rows.withColumn(c, F.lit(None).cast("double"))
        for c in ("mu", "sd"):
            rows = rows if c in rows.columns else rows.withColumn(c, F.lit(None).cast("array<double>"))
        return rows.select(F.col("layer").cast("int").alias("layer"), "direction", F.coalesce("bias", "intercept", F.lit(0.0)).alias("bias"), "mu", "sd")

    def layers(self) -> list[int]:
        """The layers there are, in order: tens."""
        return sorted(r.layer for r in self.table.select(F.col("layer").cast("int").alias("layer")).distinct().collect())

    def metrics(self, name: str) -> DataFrame:
        """(layer, metric): one figure of every layer, null where it is not stored."""
        return self.table.select(F.col("layer").cast("int").alias("layer"), F.get_json_object("metrics", f"$.{name}").cast("double").alias("metric"))

    def best_layer(self, name: str = "map") -> int | None:
        row = registry.best_layer(self.metrics(name)).first()
        return row.layer if row else None

    def predict(self, rows: DataFrame, scaling: bool = True) -> DataFrame:
        """rows (layer, vec and others) with score and predicted; without scaling the vectors count as scaled already. Rows of a layer without a probe drop out."""
        probes = self.probes()
        size = F.size("direction")
        zeros, ones = F.transform("direction", lambda _: F.lit(0.0)), F.transform("direction", lambda _: F.lit(1.0))
        probes = probes.withColumn("mu", F.when(F.lit(scaling) & (F.size("mu") == size), F.col("mu")).otherwise(zeros)).withColumn("sd", F.when(F.lit(scaling) & (F.size("sd") == size), F.col("sd")).otherwise(ones))
        scored = meandiff.scored(rows, probes, ["layer"])
        return scored.select(*rows.columns, "score", (F.col("score") > 0).cast("int").alias("predicted"))

    def predict_with_bag(self, rows: DataFrame, bag: str = "bag", scaling: bool = True) -> DataFrame:
        """(bag, layer, score, predicted): a bag's largest score."""
        best = self.predict(rows, scaling).groupBy(bag, "layer").agg(F.max("score").alias("score"))
        return best.withColumn("predicted", (F.col("score") > 0).cast("int"))

    def p_values(self, scored: DataFrame, alpha: float = 0.1, tie_breaking: bool = False) -> DataFrame:
        """Conformal p-values and predictions of scored (id, layer, y, score) against the calibration scores; an error where none are kept."""
        if self.calibration is None:
            raise ValueError("the trial keeps no calibration scores")
        return conformal.icp(self.calibration, scored, conformal.symmetric, [0, 1], alpha, tie_breaking, ["layer"])
