"""The life of a probe: rows in, split, fit, calibration, prediction, metrics, artefact."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probelake.functions.vectors import sigmoid
from probelake.operators import bags, conformal, meandiff, metrics, registry, svm
from probelake.operators.labels import TASKS, task_mask, task_target
from probelake.session import written


@dataclass(frozen=True)
class ProbeSpec:
    """What to train: probe (mean_diff, svm, sawmil), task, layer range as quantiles, conformal alpha and tie-breaking, search grid (none: a single fit with c), and resamples of the metrics' intervals (0: no intervals)."""

    probe: str = "mean_diff"
    task: int = 3
    layers: tuple[float, float] = (0.0, 1.0)
    alpha: float = 0.1
    tie_breaking: bool = False
    c: float = 1.0
    grid: tuple[float, ...] = ()
    trial: str = ""
    #: Coverage by probabilities in place of decision scores, as published figures have it for mean_diff.
    reference_compat: bool = False
    replicates: int = 0
    #: Last tokens of a bag whose intra label is 1 (sawmil).
    known: int = 2

    def __post_init__(self):
        if self.probe not in PROBES:
            raise ValueError(f"unknown probe: {self.probe}")
        if self.task not in TASKS or self.task < 0:
            raise ValueError(f"unknown task: {self.task}")
        if len(self.layers) != 2:
            raise ValueError("layers needs two quantiles")

    @property
    def name(self) -> str:
        return (self.trial or self.probe) + ("_search" if self.grid else "") + f"_task-{self.task}"


class Probe(Protocol):
    """Fits one linear probe a layer: (layer, direction, bias, mu, sd)."""

    def __call__(self, train: DataFrame, spec: ProbeSpec) -> DataFrame: ...


def _mean_diff(train: DataFrame, spec: ProbeSpec) -> DataFrame:
    return meandiff.fit(train, group=["layer"])


def _searched(train: DataFrame, spec: ProbeSpec, search, fit) -> DataFrame:
    """A fit of each layer with the parameter that the one-standard-error rule picks from its search."""
    if not spec.grid:
        return fit(train, spec.c).drop("c")
    scores = written(search(train, ["layer"], spec.grid), "search")
    layers = [r.layer for r in scores.select("layer").distinct().collect()]  # layers of one model: tens
    chosen = {k: svm.one_se(scores.where(F.col("layer") == k)).first().c for k in layers}
    out = [fit(train.where(F.col("layer") == k), c).drop("c") for k, c in chosen.items()]
    first = out[0]
    for o in out[1:]:
        first = first.unionByName(o)
    return first


def _svm(train: DataFrame, spec: ProbeSpec) -> DataFrame:
    return _searched(train, spec, svm.search, lambda rows, c: svm.fit(rows, ["layer"], c))


def _sawmil(train: DataFrame, spec: ProbeSpec) -> DataFrame:
    rows = written(bags.intra_labels(train.withColumn("__bag", F.struct("layer", "id")), spec.known, "__bag").drop("__bag").withColumnRenamed("id", "bag"), "bags")
    return _searched(rows, spec, svm.search_mil, lambda r, c: svm.fit_mil(r, c, group=["layer"]))


PROBES: dict[str, Probe] = {"mean_diff": _mean_diff, "svm": _svm, "sawmil": _sawmil}


@dataclass
class ProbeRun:
    probes: DataFrame
    predicted: DataFrame
    metrics: DataFrame
    spec: ProbeSpec = field(default_factory=ProbeSpec)
    #: id, layer, y, score of the calibration rows: what p-values are counted against.
    calibration: DataFrame | None = None


def run(rows: DataFrame, spec: ProbeSpec = ProbeSpec()) -> ProbeRun:
    """Trains, calibrates and tests one probe a layer.

    rows: id, layer, vec, split (train, calibration, test), correct, real_object; sawmil: also pos, a row being one
    vector of the bag id, whose score is the largest of its vectors'. The task's mask and target apply to every split;
    rows whose target is null take no part. metrics: a row a layer with the plain and the conformal figures, and with
    replicates also [value, lower, upper] of mcc, ami, ari and recall, and of the first three weighted by acceptance.
    Each layer is fitted in parallel with the others.
    """
    target, mask = task_target(spec.task, F.col("correct"), F.col("real_object")), task_mask(spec.task, F.col("real_object"))
    pos = ["pos"] if "pos" in rows.columns else []
    if spec.probe == "sawmil" and not pos:
        raise ValueError("bags need a column pos")
    data = rows.where(mask).select("id", *pos, "layer", "vec", "split", target.alias("y")).where("y is not null")
    layers = [r.layer for r in data.select("layer").distinct().collect()]
    if layers:
        low, high = registry.layer_range(layers, spec.layers)
        data = data.where(F.col("layer").between(low, high))
    data = written(data, "rows")
    probes = written(PROBES[spec.probe](data.where("split = 'train'"), spec), "probes")
    scored = meandiff.scored(data.where("split <> 'train'"), probes, ["layer"]).select("id", "layer", "y", "split", "score")
    if pos:
        scored = scored.groupBy("id", "layer", "y", "split").agg(F.max("score").alias("score"))
    scored = written(scored, "scores")
    test = scored.where("split = 'test'").drop("split")
    predicted = written(conformal.icp(scored.where("split = 'calibration'"), test, conformal.symmetric, [0, 1], spec.alpha, spec.tie_breaking, ["layer"]).withColumn("predicted", (F.col("score") > 0).cast("int")), "predicted")
    shown = predicted
    if spec.reference_compat:
        odd = test.withColumn("score", sigmoid("score"))
        shown = conformal.icp(scored.where("split = 'calibration'"), odd, conformal.symmetric, [0, 1], spec.alpha, spec.tie_breaking, ["layer"])
    cover = conformal.coverage(shown, ["layer"]).select("layer", "coverage", "acceptance_rate")

    def figures(df: DataFrame, p: str, prefix: str) -> DataFrame:
        b = metrics.binary(df, "y", p, ["layer"]).select("layer", *[F.col(c).alias(prefix + c) for c in ("n", "mcc", "recall")])
        for f, c in ((lambda: metrics.adjusted_mutual_information(df, "y", p, ["layer"]), "ami"), (lambda: metrics.adjusted_rand(df, "y", p, ["layer"]), "ari"), (lambda: metrics.average_precision(df, "y", "score", ["layer"]), "map"), (lambda: metrics.energy_distance(df, "y", "score", ["layer"]), "energy")):
            d = f()
            b = b.join(d.select("layer", F.col(d.columns[-1]).alias(prefix + c)), "layer", "left")
        return b

    out = figures(predicted, "predicted", "").join(figures(predicted.where("prediction <> -1"), "prediction", "conformal_"), "layer", "left").join(cover, "layer", "left")
    rate = F.coalesce("conformal_n", F.lit(0)) / F.col("n")
    weighted = {f"conformal_w{c}": F.col(f"conformal_{c}") * rate for c in ("mcc", "ami", "ari", "map", "energy")}
    out = written(out.withColumns(weighted).withColumn("a_rate", rate), "metrics")
    if spec.replicates:
        marked = predicted.withColumn("accepted", (F.col("prediction") != -1).cast("int"))
        plain = metrics.intervals(marked, ["y", "predicted"], {f"{n}_ci": n for n in ("mcc", "ami", "ari", "recall")}, ["layer"], spec.replicates)
        inside = metrics.intervals(marked.where("accepted = 1"), ["y", "prediction"], {f"conformal_{n}_ci": n for n in ("mcc", "ami", "ari", "recall")}, ["layer"], spec.replicates)
        shared = metrics.intervals(marked, ["y", "prediction", "accepted"], {f"conformal_{n}_ci": n for n in ("wmcc", "wami", "wari")}, ["layer"], spec.replicates)
        out = written(out.join(plain, "layer", "left").join(inside, "layer", "left").join(shared, "layer", "left"), "metrics")
    return ProbeRun(probes, predicted, out, spec, scored.where("split = 'calibration'").drop("split"))


def artefacts(result: ProbeRun) -> DataFrame:
    """A row a layer to store: trial_id, layer, direction, bias, mu, sd, metrics as JSON."""
    figures = result.metrics.select("layer", F.to_json(F.struct(*[c for c in result.metrics.columns if c != "layer"])).alias("metrics"))
    return result.probes.join(figures, "layer").select(F.lit(result.spec.name).alias("trial_id"), "layer", "direction", "bias", "mu", "sd", "metrics")
