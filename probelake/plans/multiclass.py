"""Three-class probes: one probe against all others for each class, stacked, with conformal prediction."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probelake.operators import bags, conformal, meandiff, stacking
from probelake.plans.probe import PROBES, ProbeSpec
from probelake.session import written

CLASSES = (0, 1, 2)


@dataclass
class MulticlassRun:
    #: class, direction, bias, mu, sd of the probes of one layer.
    probes: DataFrame
    model: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
    #: id, y, score (the classes' probabilities), p_0, p_1, p_2, in_set, prediction of the test rows.
    predicted: DataFrame


def class_scores(rows: DataFrame, probes: DataFrame, pooled: bool) -> DataFrame:
    """(id, y, split, s0, s1, s2) of rows (id, vec, y, split; pooled: a row a vector of the bag id, whose score is its largest)."""
    wide = [F.max(F.when(F.col("class") == c, F.struct("direction", "bias", "mu", "sd"))).alias(f"p{c}") for c in CLASSES]
    packed = probes.groupBy().agg(*wide)  # one row
    both = rows.crossJoin(F.broadcast(packed))
    scored = both.select("id", "y", "split", *[meandiff.decision("vec", f"p{c}.direction", f"p{c}.bias", f"p{c}.mu", f"p{c}.sd").alias(f"s{c}") for c in CLASSES])
    return scored.groupBy("id", "y", "split").agg(*[F.max(f"s{c}").alias(f"s{c}") for c in CLASSES]) if pooled else scored


def run(rows: DataFrame, spec: ProbeSpec = ProbeSpec(), agg: str = "last", nonconformity: str = "inverse") -> MulticlassRun:
    """Trains, stacks, calibrates and tests the three-class probe of one layer.

    rows: id, pos, vec, y (0, 1 or 2; null rows take no part), split. agg "last": the last vector of each id alone;
    "all": every vector, the probes being trained on bags if spec.probe is sawmil, and a bag scoring as its largest.
    The stacker is fitted on the scores of the train rows; p-values are counted on those of the calibration rows.
    """
    if agg not in ("last", "all"):
        raise ValueError(f"unknown aggregation: {agg}")
    data = rows.where(F.col("y").isin(*CLASSES)).select("id", "pos", "vec", "y", "split")
    if agg == "last":
        data = bags.last_of(data, "id", "pos", "vec", "y", "split")
    data = written(data.withColumn("layer", F.lit(0)), "rows")
    train = data.where("split = 'train'")
    fits = [PROBES[spec.probe](train.withColumn("y", (F.col("y") == c).cast("int")), spec).select(F.lit(c).alias("class"), "direction", "bias", "mu", "sd") for c in CLASSES]
    probes = written(fits[0].unionByName(fits[1]).unionByName(fits[2]), "probes")
    scores = written(class_scores(data, probes, agg == "all"), "scores")
    names = [f"s{c}" for c in CLASSES]
    model = stacking.fit(scores.where("split = 'train'"), names)
    shown = written(scores.select("id", "y", "split", stacking.probabilities(names, model).alias("score")), "probabilities")
    predicted = conformal.icp(shown.where("split = 'calibration'").drop("split"), shown.where("split = 'test'").drop("split"), conformal.MULTICLASS[nonconformity], list(CLASSES), spec.alpha, spec.tie_breaking)
    return MulticlassRun(probes, model, predicted)
