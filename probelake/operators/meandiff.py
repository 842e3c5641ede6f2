"""The mean-difference probe: the direction from the mean of one class to that of the other."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probelake.functions.vectors import dot, let
from probelake.operators.scaling import as_arrays, gram_matrix, standardised, vector_stats


def fit(train: DataFrame, vec: str = "vec", y: str = "y", group: list[str] | None = None) -> DataFrame:
    """One probe a group: (group, direction, bias, mu, sd) for vectors standardised over the train rows of both classes.

    direction has length 1; bias puts the midpoint of the class means at 0. A group without one of the classes gives
    null directions. The fit is one pass of partial sums; what follows has one row per dim.
    """
    group = group or []
    by = vector_stats(train.where(F.col(y).isin(0, 1)), vec, [*group, y])
    q = (F.col("sd") * F.col("sd") + F.col("mean") * F.col("mean")) * F.col("n")
    s = by.groupBy(*group, "dim").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("mean")).alias("s"), F.sum(q).alias("q"),
        F.max(F.when(F.col(y) == 1, F.col("mean"))).alias("m1"), F.max(F.when(F.col(y) == 0, F.col("mean"))).alias("m0"),
    )
    mu = F.col("s") / F.col("n")
    var = F.col("q") / F.col("n") - mu * mu
    sd = F.when(var > 1e-14 * (1 + mu * mu), F.sqrt(var)).otherwise(1.0)
    s = s.select(*group, "dim", mu.alias("mu"), sd.alias("sd"), ((F.col("m1") - F.col("m0")) / sd).alias("w"), ((F.col("m1") + F.col("m0") - 2 * mu) / sd).alias("c"))
    out = as_arrays(s, group, w=F.col("w"), c=F.col("c"), mu=F.col("mu"), sd=F.col("sd"))
    out = out.withColumn("direction", let(F.sqrt(dot("w", "w")), lambda n: F.transform("w", lambda x: x / n)))
    return out.select(*group, "direction", (F.lit(-0.5) * dot("direction", "c")).alias("bias"), "mu", "sd")


def oas_covariance(gram: np.ndarray, n: int) -> tuple[np.ndarray, float]:
    """(covariance, shrinkage) by oracle-approximating shrinkage of centred rows; an unusable matrix falls back to a multiple of the identity."""
    h = len(gram)
    emp = gram / n
    if not np.isfinite(emp).all():
        return np.eye(h), 1.0
    mu = np.trace(emp) / h
    alpha = (emp**2).mean()
    top, low = alpha + mu**2, (n + 1.0) * (alpha - mu**2 / h)
    rate = 1.0 if low == 0 else min(top / low, 1.0)
    return (1 - rate) * emp + rate * mu * np.eye(h), float(rate)


def fit_whitened(train: DataFrame, vec: str = "vec", y: str = "y", ridge: float = 1e-6) -> tuple[np.ndarray, float]:
    """(direction, bias) with the difference of means multiplied by the inverse of the pooled, shrunk covariance. The Gram matrices come as partial sums; the driver holds matrices of dims by dims only."""
    stats = vector_stats(train.where(F.col(y).isin(0, 1)), vec, [y]).collect()
    h = 1 + max(r.dim for r in stats)
    mean = {c: np.array([r["mean"] for r in sorted((r for r in stats if r[y] == c), key=lambda r: r.dim)]) for c in (0, 1)}
    n = {c: next(r.n for r in stats if r[y] == c) for c in (0, 1)}
    grams = {c: np.zeros((h, h)) for c in (0, 1)}
    for r in gram_matrix(train.where(F.col(y).isin(0, 1)), vec, [y]).collect():
        grams[r[y]][r.i, r.j] = r.value
    cov = {c: oas_covariance(grams[c] - n[c] * np.outer(mean[c], mean[c]), n[c])[0] for c in (0, 1)}
    pooled = sum((n[c] - 1) * cov[c] for c in (0, 1)) / max(1, n[0] + n[1] - 2)
    w = np.linalg.solve(pooled + ridge * np.eye(h), mean[1] - mean[0])
    w /= np.linalg.norm(w) or 1.0
    return w, float(-0.5 * (mean[0] + mean[1]) @ w)


def decision(vec: Column | str, direction: Column | str = "direction", bias: Column | str = "bias", mu: Column | str | None = "mu", sd: Column | str | None = "sd") -> Column:
    """The signed score of a vector under a probe."""
    x = standardised(vec, mu, sd) if mu is not None else (F.col(vec) if isinstance(vec, str) else vec)
    return dot(x, direction) + (F.col(bias) if isinstance(bias, str) else bias)


def scored(rows: DataFrame, probes: DataFrame, group: list[str], vec: str = "vec") -> DataFrame:
    """rows with score; probes has one row a group, as many as there are layers."""
    joined = rows.join(F.broadcast(probes), group) if group else rows.crossJoin(F.broadcast(probes))
    return joined.select(*rows.columns, decision(vec).alias("score"))
