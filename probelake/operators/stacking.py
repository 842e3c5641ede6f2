"""Three-class probes stacked on one-against-all scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probelake.functions.vectors import let, sanitized, softmax


def fit(df: DataFrame, scores: list[str], y: str = "y", rounds: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(mu, sd, coefficients, intercepts) of a multinomial logistic regression without penalty over standardised scores, classes weighted alike (n / (classes * n_c))."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rows = df.where(F.col(y).isNotNull()).select(F.col(y).cast("double").alias("label"), *[sanitized(s).alias(s) for s in scores])
    stats = rows.agg(*[f(s).alias(f"{n}_{s}") for s in scores for n, f in (("m", F.avg), ("d", F.stddev_pop))]).first()
    mu, sd = np.array([stats[f"m_{s}"] for s in scores]), np.array([stats[f"d_{s}"] or 1.0 for s in scores])
    counts = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    weight = F.create_map(*[F.lit(x) for c, n in counts.items() for x in (c, sum(counts.values()) / (len(counts) * n))])
    scaled = rows.select("label", weight[F.col("label")].alias("w"), *[((F.col(s) - float(m)) / float(d)).alias(s) for s, m, d in zip(scores, mu, sd)])
    packed = VectorAssembler(inputCols=scores, outputCol="features").transform(scaled)
    model = LogisticRegression(family="multinomial", regParam=0.0, weightCol="w", maxIter=rounds, standardization=False).fit(packed)
    return mu, sd, model.coefficientMatrix.toArray(), model.interceptVector.toArray()


def probabilities(scores: list[str], model: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]) -> Column:
    """The classes' probabilities as an array."""
    mu, sd, coef, icpt = model
    z = [(sanitized(s) - float(m)) / float(d) for s, m, d in zip(scores, mu, sd)]
    logits = F.array(*[sum((float(w) * x for w, x in zip(row, z)), F.lit(float(b))) for row, b in zip(coef, icpt)])
    return let(logits, softmax)
