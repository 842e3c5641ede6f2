"""The forest's importances against Spark's own, and what it sends about."""

from __future__ import annotations

import numpy as np
import pytest

from probelake.operators import features, forest


def _rows(spark, n=1500, dims=9):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (n, dims))
    x[:, 4] = rng.integers(0, 3, n)  # ties
    y = ((x[:, 0] + 0.5 * x[:, 1] + (x[:, 4] == 1) + 0.3 * rng.normal(0, 1, n)) > 0.3).astype(int)
    return spark.createDataFrame([(v.tolist(), int(c)) for v, c in zip(x, y)], "vec array<double>, y int")


def test_importances_are_those_of_sparks_forest(spark, monkeypatch):
    df = _rows(spark)
    got = np.array([r.importance for r in features.forest_importances(df, trees=60, depth=5).orderBy("dim").collect()])
    monkeypatch.setattr(forest, "MOST_BYTES", 0)
    want = np.array([r.importance for r in features.forest_importances(df, trees=60, depth=5).orderBy("dim").collect()])
    assert np.isclose(got.sum(), 1) and np.abs(got - want).max() < 0.03


def test_trees_grow_without_histograms_of_all_trees(spark, monkeypatch):
    from pyspark.ml import classification

    monkeypatch.setattr(classification, "RandomForestClassifier", None)
    df = _rows(spark, 300)
    a, b = (features.forest_importances(df, trees=7, depth=3).collect() for _ in range(2))
    assert a == b and len(a) == 9


def test_few_values_each_have_a_bin(spark):
    df = spark.createDataFrame([([0.0 if i < 3 else 1.0 if i < 6 else 2.0, float(i)],) for i in range(1000)], "vec array<double>")
    few, many = forest.cuts(df, 2)
    assert few.tolist() == [0.0, 1.0] and 25 < len(many) <= forest.BINS - 1


def test_odd_targets_raise(spark):
    with pytest.raises(ValueError, match="classes"):
        features.forest_importances(spark.createDataFrame([([1.0], 0.5)], "vec array<double>, y double"))
    with pytest.raises(ValueError, match="classes"):
        features.forest_importances(spark.createDataFrame([], "vec array<double>, y double"))
