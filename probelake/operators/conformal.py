"""Inductive conformal prediction with abstention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probelake.functions.vectors import total
from probelake.operators.ranks import by_range, running_sum


def reciprocal(y: Column, f: Column, c: float = 0.0) -> Column:
    """1 / (1 + |f|) where (f > c) matches y, else 1 + |f|."""
    match = (f > c).cast("int") == y
    return F.when(match, 1.0 / (1.0 + F.abs(f))).otherwise(1.0 + F.abs(f))


def margin(y: Column, f: Column) -> Column:
    """reciprocal at 0."""
    return reciprocal(y, f, 0.0)


def symmetric(y: Column, f: Column, threshold: float = 0.0) -> Column:
    """exp(-(2y - 1)(f - threshold))."""
    return F.exp(-(2 * y - 1) * (f - threshold))


def symmetric_at(threshold: float):
    """symmetric with its threshold set."""
    return lambda y, f: symmetric(y, f, threshold)


def inverse_probability(y: Column, p: Column) -> Column:
    """1 - p_y of an array of probabilities."""
    return 1.0 - p[y]


def cumulative_softmax(y: Column, p: Column) -> Column:
    """The sum of probabilities above p_y."""
    return total(F.filter(p, lambda x: x > p[y]))


def probability_margin(y: Column, p: Column) -> Column:
    """(1 - (p_y - the largest other)) / 2."""
    other = F.array_max(F.filter(F.transform(p, lambda x, i: F.when(i != y, x)), lambda x: x.isNotNull()))
    return (1.0 - (p[y] - other)) / 2.0


BINARY = {"symmetric": symmetric, "reciprocal": reciprocal, "margin": margin}
MULTICLASS = {"inverse": inverse_probability, "cumulative": cumulative_softmax, "margin": probability_margin}


def p_values(calibration: DataFrame, candidates: DataFrame, group: list[str] | None = None) -> DataFrame:
    """candidates (group, id, label, alpha) with p = (number of calibration alphas >= alpha, + 1) / (all + 1).

    Both sides shrink to their distinct alphas, which are added up along their order in range partitions; no pair of
    rows is formed. Null alphas on the calibration side do not count; a group without calibration rows has p = 1.
    """
    group = group or []
    have = calibration.where("alpha is not null").groupBy(*group, "alpha").agg(F.count("*").alias("n"))
    asked = candidates.select(*group, "alpha").distinct().withColumn("n", F.lit(0).cast("bigint"))
    steps = by_range(have.unionByName(asked).groupBy(*group, "alpha").agg(F.sum("n").alias("n")), *group, "alpha")
    steps = running_sum(steps, group, "__bucket", ["alpha"], "n", "below")
    whole = have.groupBy(*group).agg(F.sum("n").alias("whole")) if group else have.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("whole"))
    steps = steps.join(F.broadcast(whole), group, "left") if group else steps.crossJoin(F.broadcast(whole))
    p = (F.coalesce("whole", F.lit(0)) - F.col("below") + 1.0) / (F.coalesce("whole", F.lit(0)) + 1.0)
    return candidates.join(steps.select(*group, "alpha", p.alias("p")), [*group, "alpha"])


def icp(calibration: DataFrame, test: DataFrame, nonconformity, labels: list[int], alpha: float = 0.1, tie_breaking: bool = False, group: list[str] | None = None) -> DataFrame:
    """test (group, id, score, y) with p_<label> for each label, in_set (of y) and prediction.

    A label is in the set if its p exceeds alpha. prediction: the set's only label; -1 for an empty set and, unless
    tie_breaking, for a larger one; tie_breaking takes the label of the larger p, the higher label on a tie (of the
    first two, as far as more classes go). calibration: (group, score, y).
    """
    group = group or []
    cal = calibration.select(*group, nonconformity(F.col("y"), F.col("score")).alias("alpha"))
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("label"), nonconformity(F.lit(c), F.col("score")).alias("alpha")) for c in labels]))
    cand = test.select(*group, "id", each.alias("c")).select(*group, "id", "c.label", "c.alpha")
    p = p_values(cal, cand, group).groupBy(*group, "id").agg(*[F.max(F.when(F.col("label") == c, F.col("p"))).alias(f"p_{c}") for c in labels])
    out = test.join(p, [*group, "id"])
    inside = [F.col(f"p_{c}") > alpha for c in labels]
    many = sum((i.cast("int") for i in inside[1:]), inside[0].cast("int"))
    only = F.coalesce(*[F.when(i, F.lit(c)) for i, c in zip(inside, labels)])
    tie = F.when(F.col(f"p_{labels[0]}") > F.col(f"p_{labels[1]}"), labels[0]).otherwise(labels[1]) if tie_breaking else F.lit(-1)
    hit = F.lit(False)
    for i, c in zip(inside, labels):
        hit = hit | ((F.col("y") == c) & i)
    return out.withColumn("in_set", hit.cast("int")).withColumn("prediction", F.when(many == 0, -1).when(many == 1, only).otherwise(tie))


def coverage(predicted: DataFrame, group: list[str] | None = None) -> DataFrame:
    """(group, n, acceptance_rate, coverage) of icp()'s rows."""
    aggs = [F.count("*").alias("n"), F.avg((F.col("prediction") != -1).cast("double")).alias("acceptance_rate"), F.avg(F.col("in_set").cast("double")).alias("coverage")]
    return predicted.groupBy(*group).agg(*aggs) if group else predicted.agg(*aggs)
