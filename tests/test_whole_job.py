"""Small tables on which a cut in an operator shows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from probelake.operators import datagen, svm


def test_wrong_values_fill_every_slot(spark):
    kv = spark.createDataFrame([("a", f"v{i}") for i in range(59)] + [("b", "v59"), ("full", "w")] + [("full", f"v{i}") for i in range(60)], "key string, value string")
    got = datagen.wrong_values(kv).collect()
    a = [r for r in got if r.key == "a"]
    assert len({(r.value, r.slot) for r in a}) == len(a) == 118 and {r.wrong for r in a} == {"v59", "w"}
    assert not [r for r in got if r.key == "full"]


def _points(spark, n):
    x = np.random.default_rng(1).normal(3, 2, (n, 2)) * [1, 5]
    return x, spark.createDataFrame([(i, 7, v.tolist(), int(i % 2)) for i, v in enumerate(x)], "id int, layer int, vec array<double>, y int")


def test_probe_scales_by_all_rows(spark):
    x, df = _points(spark, 400)
    p = svm.fit(df, ["layer"], limit=20).first()
    assert np.allclose(p.mu, x.mean(0)) and np.allclose(p.sd, x.std(0))


def test_bag_probe_scales_by_all_instances(spark):
    x, df = _points(spark, 400)
    bags = df.select((F.col("id") / 4).cast("int").alias("bag"), (F.col("id") % 4).alias("pos"), "vec", ((F.col("id") / 4).cast("int") % 2).alias("y"), (F.col("id") % 10 == 0).cast("int").alias("intra"))
    p = svm.fit_mil(bags, limit=10).first()
    assert np.allclose(p.mu, x.mean(0)) and np.allclose(p.sd, x.std(0))
    assert np.allclose(p.direction, svm.fit_mil(bags, eta=0.1, limit=10).first().direction)


def test_search_scales_by_all_rows_outside_the_fold(spark):
    x, df = _points(spark, 400)
    far = df.withColumn("vec", F.when(F.col("id") % 7 == 0, F.transform("vec", lambda v: v * 50)).otherwise(F.col("vec")))
    parts = far.withColumn("part", F.pmod(svm.h(43, "id"), F.lit(3))).where("part <> 0").collect()
    whole = far.withColumn("part", F.pmod(svm.h(43, "id"), F.lit(3)))
    rows = svm._scaled(far.limit(5).withColumn("fold", F.lit(0)), whole.withColumn("fold", F.lit(0)).where("part <> 0"), ["layer", "fold"], "vec").first()
    assert np.allclose(rows["__mu"], np.mean([r.vec for r in parts], 0))
    seen = {r.fold: r.score for r in svm.search(far, ["layer"], (1.0,), limit=20).collect()}
    assert len(seen) == 3


def test_products_solve_as_the_matrix_does():
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (90, 3))
    y = np.where(x[:, 0] + 0.3 * rng.normal(0, 1, 90) > 0, 1.0, -1.0)
    for penalty in (-0.1, 0.2):
        a, b = (svm.solve_dual(k, y, 0.5, penalty=penalty, tol=1e-9) for k in (x @ x.T, svm.Products(x, 200)))
        assert np.allclose((a * y) @ x, (b * y) @ x, atol=1e-6) and np.isclose(a.sum(), b.sum())


def test_registered_probes_take_the_defaults(spark, sf, monkeypatch):
    from probelake.catalogue import models
    from probelake.operators import features

    asked = {}

    class Stop(Exception):
        pass

    def seen(name):
        def f(*args, **kw):
            asked[name] = kw
            raise Stop

        return f

    for at, name in ((svm, "fit"), (svm, "search"), (svm, "fit_mil"), (features, "forest_importances")):
        monkeypatch.setattr(at, name, seen(name))
    for q in ("svm_probe", "cv_search", "sawmil_probe", "feat_rf"):
        try:
            models.QUERIES[q](spark, sf)
        except Stop:
            pass
    assert asked == {"fit": {}, "search": {}, "fit_mil": {}, "forest_importances": {}}
