from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from probelake.functions import vectors as V
from probelake.functions.text import plain, plain_form
from probelake.operators import bags, conformal, features, labels, meandiff, metrics, registry, splits, svm
from probelake.operators.ranks import ranked, running_sum
from probelake.operators.scaling import gram_matrix, vector_stats
from probelake.plans import multiclass
from probelake.plans.probe import ProbeSpec, artefacts, run
from probelake.plans.reader import ProbeReader
from probelake.sources import files


def test_plain_form():
    assert plain("The Ｃíty-of, Böß 12!") == "thecityofboss12" and plain("") == "" and plain(None) is None and plain(" .,") == ""


def test_running_sum_of_any_order(spark):
    rows = [(g, random.Random(i).randrange(50), i) for i, g in enumerate(["a"] * 300 + ["b"] * 20 + [None] * 10)]
    df = spark.createDataFrame(rows, "g string, v bigint, i bigint").withColumn("b", F.floor(F.col("i") / 7))
    got = {(r.g, r.i): r.s for r in running_sum(df, ["g"], "b", ["i"], "v", "s").collect()}
    run_, want = {}, {}
    for g, v, i in rows:
        want[g, i] = run_.get(g, 0)
        run_[g] = run_.get(g, 0) + v
    assert got == want
    order = {r.i: r.p for r in ranked(df.select("v", "i"), ["v", "i"], "p").collect()}
    assert [i for _, i in sorted((v, i) for _, v, i in rows)] == sorted(order, key=order.get)


def test_stats_and_gram(spark):
    x = np.random.default_rng(0).normal(size=(200, 5))
    df = spark.createDataFrame([(i % 2, v.tolist()) for i, v in enumerate(x)] + [(0, None)], "g int, vec array<double>")
    got = {(r.g, r.dim): (r["mean"], r.sd) for r in vector_stats(df, "vec", ["g"]).collect()}
    for g in (0, 1):
        assert np.allclose([got[g, d][0] for d in range(5)], x[g::2].mean(0)) and np.allclose([got[g, d][1] for d in range(5)], x[g::2].std(0))
    gram = np.zeros((5, 5))
    for r in gram_matrix(df, "vec").collect():
        gram[r.i, r.j] = r.value
    assert np.allclose(gram, x.T @ x)
    assert vector_stats(df.limit(0), "vec").count() == 0


def test_interventions(spark):
    df = spark.createDataFrame([([1.0, 2.0, -1.0], [0.0, 3.0, 4.0]), ([0.5, -1.0, -2.0], [0.0, 3.0, 4.0])], "v array<double>, d array<double>")
    n = V.normalised("d")
    got = df.select(V.dot(V.translated("v", "d", 2.5, absolute=False), n).alias("to"), V.norm(n).alias("one"), (V.dot("v", n) * V.dot(V.amplified("v", "d", 3.0), n)).alias("side"), V.total(V.softmax("v")).alias("soft")).collect()
    assert all(abs(r.to - 2.5) < 1e-9 and abs(r.one - 1) < 1e-9 and r.side > 0 and abs(r.soft - 1) < 1e-9 for r in got)


def test_splits_partition_rows(spark):
    rows = [(i, f"c{i % 90}", f"n{i % 17}") for i in range(1500)] + [(2000, None, "n1"), (2001, "", "n1")]
    df = spark.createDataFrame(rows, "row_id bigint, object_1 string, object_2 string")
    got = {r.row_id: r.split for r in splits.exclusive_split3(df).collect()}
    assert got.keys() == {i for i, a, b in rows if a and b} and set(got.values()) <= {"train", "test", "calibration"}
    assert sum(s == "test" for s in got.values()) / len(got) > 0.25
    assert splits.exclusive_split(df.limit(0)).count() == 0


def test_tasks_are_checked():
    with pytest.raises(ValueError):
        labels.task_target(7, F.lit(1), F.lit(1))
    with pytest.raises(ValueError):
        ProbeSpec(probe="none")


def test_mean_difference_midpoint(spark):
    rng = np.random.default_rng(1)
    rows = [(i, i % 2, (rng.normal(size=4) + 2 * (i % 2)).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "id bigint, y int, vec array<double>")
    p = meandiff.fit(df)
    assert abs(math.sqrt(sum(x * x for x in p.first().direction)) - 1) < 1e-9
    means = {r.y: r.m for r in meandiff.scored(df, p, []).groupBy("y").agg(F.avg("score").alias("m")).collect()}
    assert abs(means[0] + means[1]) < 1e-9 and means[1] > 0
    w, b = meandiff.fit_whitened(df)
    assert np.linalg.norm(w) == pytest.approx(1)


def test_conformal_coverage_and_values(spark):
    rng = random.Random(5)
    draw = lambda n: [(i, i % 2, rng.gauss(1.5 * (i % 2) - 0.75, 1)) for i in range(n)]
    cal, test = (spark.createDataFrame(draw(n), "id bigint, y int, score double") for n in (400, 1000))
    out = conformal.icp(cal, test, conformal.symmetric, [0, 1])
    rows = out.collect()
    a = sorted(math.exp(-(2 * r.y - 1) * r.score) for r in cal.collect())
    for r in rows[:50]:
        assert r.p_1 == pytest.approx((sum(x >= math.exp(-r.score) for x in a) + 1) / 401)
    assert conformal.coverage(out).first().coverage > 0.86
    assert all((r.prediction == -1) == ((r.p_0 > 0.1) == (r.p_1 > 0.1)) for r in rows)
    none = conformal.icp(cal.limit(0), test, conformal.symmetric, [0, 1]).first()
    assert none.p_0 == none.p_1 == 1


def test_metrics_of_equal_labels(spark):
    df = spark.createDataFrame([(i, i % 3, i % 2, float(i % 2)) for i in range(60)], "id bigint, k int, y int, s double")
    assert metrics.multiclass_mcc(df, "k", "k").first().mcc == pytest.approx(1)
    assert metrics.adjusted_rand(df, "k", "k").first().ari == pytest.approx(1)
    assert metrics.adjusted_mutual_information(df, "k", "k").first().ami == pytest.approx(1)
    assert metrics.average_precision(df, "y", "s").first().ap == pytest.approx(1)
    assert metrics.binary(df, "y", "y").first().mcc == pytest.approx(1)
    assert metrics.energy_distance(df, "y", "s").first().energy == pytest.approx(math.sqrt(2))
    b = metrics.bootstrap(df.withColumn("p", F.col("y")), ["y", "p"], "mcc", replicates=20).first()
    assert b.lower == b.upper == b.value == pytest.approx(1)
    near = df.withColumn("p", F.when(F.col("id") < 50, F.col("y")).otherwise(0)).withColumn("accepted", (F.col("id") < 58).cast("int"))
    for repeatable in (False, True):
        for name in ("mcc", "ami", "ari", "recall", "accuracy"):
            got = metrics.bootstrap(near, ["y", "p"], name, replicates=40, repeatable=repeatable).first()
            assert got.lower <= got.value <= got.upper
    whole = metrics.bootstrap(near, ["y", "p", "accepted"], "wmcc", replicates=40).first()
    assert whole.value == pytest.approx(metrics.binary(near.where("accepted = 1"), "y", "p").first().mcc * 58 / 60)
    assert metrics.bootstrap(near, ["y", "p"], lambda t, c, n, g: t.groupBy(*g).agg((F.sum(F.when(F.col(c[0]) == 1, F.col(n)).otherwise(0)) / F.sum(n)).alias("value")), replicates=40).first().value == 0.5
    assert metrics.bootstrap(near.limit(0), ["y", "p"], "mcc").count() == 0
    ap = metrics.bootstrap_average_precision(df.withColumn("s", (F.col("id") * 37 % 60 + 20 * F.col("y")).cast("double")), "y", "s", replicates=60).first()
    assert ap.lower < ap.value < ap.upper


def test_resamples_have_the_binomial_law(spark):
    cells = spark.createDataFrame([(0, 0, 30), (0, 1, 70)], "y int, p int, n bigint")
    for repeatable in (False, True):
        got = metrics.resampled(cells, ["y", "p"], [], 400, 3, repeatable).where("p = 1").agg(F.avg("times").alias("m"), F.stddev("times").alias("s")).first()
        assert abs(got.m - 70) < 1.2 and abs(got.s - math.sqrt(21)) < 0.7


def test_plain_form_of_every_text(spark):
    texts = ["Ab-1 c", "", "...", None, "Ünï ｆ１", "İx", "a\u0301B", "tab\tand\nline", "\x7f~^_", "ß", "x" * 100_000 + "é", "Y-" * 50_000]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", plain_form("t").alias("p")).collect()
    assert {r.i: r.p for r in rows} == {i: plain(t) for i, t in enumerate(texts)}


def test_safe_keeps_good_values(spark):
    v = spark.createDataFrame([(0.7, 0.6, 0.8), (None, 0.1, 0.2), (0.5, float("nan"), 0.6)], "v double, l double, u double")
    assert [r[0] for r in v.select(metrics.safe(F.col("v"), F.col("l"), F.col("u"))).collect()] == [[0.7, 0.6, 0.8], list(metrics.FALLBACK), list(metrics.FALLBACK)]


def test_expected_mutual_information_near_the_mean_is_the_whole_sum():
    def slow(a, b, t):
        lg = math.lgamma
        fixed = lg(a + 1) + lg(b + 1) + lg(t - a + 1) + lg(t - b + 1) - lg(t + 1)
        return sum(n / t * math.log(t * n / (a * b)) * math.exp(fixed - lg(n + 1) - lg(a - n + 1) - lg(b - n + 1) - lg(t - a - b + n + 1)) for n in range(max(1, a + b - t), min(a, b) + 1))

    for a, b, t in ((1, 1, 1), (3, 4, 7), (500, 700, 1000), (40_000, 90_000, 300_000), (5, 299_990, 300_000)):
        assert metrics._expected_term(a, b, t) == pytest.approx(slow(a, b, t), rel=1e-6, abs=1e-9)
    assert abs(metrics.ami_of([(0, 0, 400_000_000), (0, 1, 100_000_000), (1, 0, 100_000_000), (1, 1, 400_000_000)]) - 0.278) < 0.01


def test_conditional_pairs_and_their_weights(spark):
    a = spark.createDataFrame([(i, i % 2, "xyz"[i % 3]) for i in range(30)] + [(98, None, "x"), (99, 1, None)], "id bigint, correct int, category string")
    b = spark.createDataFrame([(100 + i, i % 2, "xy"[i % 2]) for i in range(20)], "id bigint, correct int, category string")
    every = [(x.id, z.id, x.category) for x in a.collect() for z in b.collect() if x.correct is not None and x.category and x.correct == z.correct and x.category != z.category]
    counts = {r.ca: (r.pairs, r.weight) for r in features.conditional_weights(features.conditional_counts(a, b, "correct", "category")).collect()}
    for c in "xyz":
        n = sum(1 for e in every if e[2] == c)
        assert counts[c] == (n, pytest.approx(1 - n / len(every)))
    for n in (20, 10_000):
        got = [tuple(r) for r in features.conditional_pairs(a, b, "correct", "category", n).collect()]
        assert len(got) == len(set(got)) == min(n, len(every)) and set(got) <= {e[:2] for e in every}
    assert features.conditional_pairs(a.limit(0), b, "correct", "category", 5).count() == 0


def test_mutual_information_in_blocks_is_that_of_all_rows(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    y = rng.integers(0, 3, 400)
    x = np.round(rng.normal(size=(400, 3)) + y[:, None] * np.array([1.0, 0.2, 0.0]), 2)
    df = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, y))] + [(900, [1.0, float("nan"), 2.0], 7)], "id bigint, vec array<double>, y int")
    want = {d: features.nearest_mutual_information(x[:, d], y, 5) for d in range(3)}
    for size in (20, 10_000):
        got = {r.dim: r.mi for r in features.mutual_information(df, k=5, block_rows=size).collect()}
        assert got == {d: pytest.approx(v, abs=1e-6) for d, v in want.items()}


def test_dims_are_chosen_by_any_measure(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 120)
    x = rng.normal(size=(120, 4)) + np.outer(y, [3.0, 0.0, 1.5, 0.0])
    df = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, y))], "id bigint, vec array<double>, y int")
    for relevance in ("ks", "f", "pearson", "mi"):
        assert features.selected_dims(df, 2, relevance)[0] == 0
    for redundancy in ("spearman", "chatterjee"):
        assert set(features.selected_dims(df, 2, "f", redundancy)) <= {0, 2, 1, 3}
    assert features.selected_dims(df, 1, lambda d, v, t: features.pearson(d, v, t), lambda d, v: np.eye(4)) == [0]
    with pytest.raises(ValueError):
        features.selected_dims(df, 1, "distance_covariance")
    order = np.argsort(np.argsort(x, axis=0), axis=0) + 1
    by = order[np.argsort(order[:, 1]), 0]
    assert features.chatterjee_matrix(df)[0, 1] == pytest.approx(1 - 3 * np.abs(np.diff(by)).sum() / (120**2 - 1))


def test_identities_of_published_figures():
    assert round(0.7830 / 0.7848, 2) == round(1268 / 1271, 2)


def test_dual_solver_meets_its_conditions():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(40, 3)) + 1.2, rng.normal(size=(40, 3)) - 1.2])
    y = np.repeat([1.0, -1.0], 40)
    a = svm.solve_dual(x @ x.T, y, 1.0, tol=1e-8)
    assert abs(a @ y) < 1e-9 and a.min() >= 0 and a.max() <= 1
    w, b = svm.line_of(x, y, a, 1.0)
    full = (a * y) @ x
    free = (a > 1e-6) & (a < 1 - 1e-6)
    bias = (y - x @ full)[free]
    assert bias.std() < 1e-3 and (np.sign(x @ w + b) == y).mean() > 0.9


def test_multiple_instance_probe_finds_the_instances():
    rng = np.random.default_rng(4)
    bags_, y, marks = [], [], []
    for i in range(60):
        bag = rng.normal(size=(5, 4))
        if i % 2:
            bag[-1] += [4, 0, 0, 0]
        bags_.append(bag)
        y.append(1.0 if i % 2 else -1.0)
        marks.append(np.array([0, 0, 0, 1, 1]))
    w, b = svm.fit_sawmil(bags_, np.array(y), marks, 10.0, 0.2, scale_c=False)
    top = np.array([(x @ w + b).max() for x in bags_])
    assert svm.average_precision_of(np.array(y), top) > 0.95 and w[0] > 0.8


def test_bias_counts_by_the_parameter_as_given():
    x, y = np.array([[1.0, 0], [2.0, 0], [-1.0, 0], [-4.0, 0]]), np.array([1.0, 1, -1, -1])
    a = np.array([0.25, 0.1, 0.25, 0.1])  # 0.25 is a scaled bound of C = 1 over four rows
    w, b = svm.line_of(x, y, a, 1.0)
    assert w[0] == 1 and b == pytest.approx(((1 - 1.5) + (-1 + 2.5)) / 2)  # all four are below C
    assert svm.line_of(x, y, a, 0.25)[1] == pytest.approx(((1 - 2.0) + (-1 + 4.0)) / 2)  # only those below the bound


def test_sparse_stage_takes_negative_instances_one_by_one(monkeypatch):
    seen = []
    real = svm.solve_dual
    monkeypatch.setattr(svm, "solve_dual", lambda k, y, c, target=None, **kw: seen.append((y, c, target)) or real(k, y, c, target, **kw))
    bags_ = [np.array([[2.0, 0], [0.0, 0], [1.0, 0]]), np.array([[-1.0, 0], [-2.0, 1]]), np.array([[3.0, 1]]), np.array([[-3.0, 0]])]
    svm.fit_sawmil(bags_, np.array([1.0, -1, 1, -1]), [np.ones(len(b)) for b in bags_], 6.0, 0.5)
    y, c, target = seen[0]
    assert y.tolist() == [-1, -1, -1, 1, 1] and c.tolist() == [2, 2, 2, 3, 3] and target.tolist() == [1, 1, 1, pytest.approx(2 / 3 - 1), 1]


def test_kernels():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(120, 2))
    ring = np.where((x * x).sum(1) > 1.2, 1.0, -1.0)
    for kernel, p in (("rbf", 1.0), ("quadratic", 2.0), ("polynomial", 2.0)):
        m = svm.fit_kernel(x, ring, 10.0, kernel, p, scale_c=False)
        assert (np.sign(m.decide(x)) == ring).mean() > 0.93
    line = np.sign(x[:, 0] + 0.01)
    m = svm.fit_kernel(x, line, 1.0, scale_c=False)
    w, b = svm.fit_linear(x, line, 1.0, scale_c=False)
    got = m.decide(np.array([[1.0, 0], [0, 1.0], [0, 0]]))
    full = np.array([got[0] - got[2], got[1] - got[2]])
    assert np.allclose(full / np.linalg.norm(full), w)
    av = svm.fit_kernel([np.stack([v, v]) for v in x], line, 1.0, "linear_av", scale_c=False)
    assert np.allclose(av.decide(x), m.decide(x))
    with pytest.raises(ValueError):
        svm.fit_kernel(x, line, 1.0, "cubic")


def test_features(spark):
    rng = np.random.default_rng(6)
    rows = [(i, i % 2, [float(i % 2 + 0.1 * rng.normal()), float(rng.normal()), float(rng.normal())]) for i in range(300)]
    df = spark.createDataFrame(rows, "id bigint, y int, vec array<double>")
    mi = {r.dim: r.mi for r in features.mutual_information(df).collect()}
    assert mi[0] > 0.4 > max(mi[1], mi[2])
    assert features.mrmr(np.array([0.9, 0.8, 0.1]), np.array([[1, 0.99, 0.01], [0.99, 1, 0.01], [0.01, 0.01, 1]]), 2) == [0, 2]
    assert np.allclose(features.correlations(df), np.corrcoef(np.array([r[2] for r in rows]).T))
    d = features.shared_directions(df.withColumn("g", F.col("id") % 30), "g", share=0.7)
    out = np.array([r.vec for r in features.neutralised(df, d).collect()])
    assert np.allclose(d @ d.T, np.eye(len(d))) and np.abs(out @ d.T).max() < 1e-9


def test_bag_cap_keeps_the_tail(spark):
    df = spark.createDataFrame([(b, p, [float(p)]) for b in range(20) for p in range(3 + b)], "bag bigint, pos int, vec array<double>")
    got = bags.capped(df, most=6).groupBy("bag").agg(F.count("*").alias("n"), F.max("pos").alias("top"), F.max_by("pos", "new_pos").alias("last")).collect()
    assert all(r.n == min(6, 3 + r.bag) and r.top == r["last"] == 2 + r.bag for r in got)


def test_registry(spark):
    assert [registry.layer_range(list(range(n)), (0.1, 1.0)) for n in (28, 32, 42, 48)] == [(2, 27), (2, 31), (3, 41), (4, 47)]
    m = spark.createDataFrame([(3, 0.5), (1, 0.5), (2, -2.0)], "layer int, metric double")
    assert registry.best_layer(m).first().layer == 1
    assert registry.best_layer(m.where("layer = 2")).count() == 0
    wanted, done = spark.range(2, 8).withColumnRenamed("id", "layer"), spark.createDataFrame([(2,), (3,), (5,)], "layer bigint")
    assert sorted(r.layer for r in registry.layers_due(wanted, done, 2).collect()) == [3, 4, 6, 7]


def test_probe_life(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [(i, i % 2, ["train", "calibration", "test"][i % 3], (i // 6) % 2, 1, (rng.normal(size=4) + 1.5 * ((i // 6) % 2)).tolist()) for i in range(600)]
    df = spark.createDataFrame(rows, "id bigint, layer int, split string, correct int, real_object int, vec array<double>")
    for probe in ("mean_diff", "svm"):
        out = run(df, ProbeSpec(probe=probe, c=1.0))
        m = out.metrics.collect()
        assert len(m) == 2 and all(r.mcc > 0.5 and r.map > 0.8 for r in m)
        for r in m:
            assert r.conformal_wmcc == pytest.approx(r.conformal_mcc * r.conformal_n / r.n)
    files.write_probes(artefacts(out), str(tmp_path / "probes"))
    reader = ProbeReader.of(spark, str(tmp_path / "probes"), out.spec.name, out.calibration)
    assert reader.layers() == [0, 1] and reader.best_layer("mcc") in (0, 1)
    again = {r.id: r.score for r in reader.predict(df.where("split = 'test'")).collect()}
    assert again == {r.id: pytest.approx(r.score) for r in out.predicted.collect()}
    bagged = {r.bag: r.score for r in reader.predict_with_bag(df.where("split = 'test' and layer = 0").withColumn("bag", F.floor(F.col("id") / 10))).collect()}
    assert all(v == pytest.approx(max(s for i, s in again.items() if i // 10 == b and i % 2 == 0)) for b, v in bagged.items())
    p = {r.id: (r.p_0, r.p_1, r.prediction) for r in reader.p_values(out.predicted.select("id", "layer", "y", "score")).collect()}
    assert p == {r.id: (pytest.approx(r.p_0), pytest.approx(r.p_1), r.prediction) for r in out.predicted.collect()}
    old = ProbeReader(reader.table.withColumnRenamed("direction", "coef").drop("mu", "sd"))
    assert old.probes().where("direction is null").count() == 0 and old.predict(df).count() == df.count()
    assert {r.layer for r in files.layers_in(spark, str(tmp_path / "probes")).collect()} == {0, 1}


def test_bag_probe_life(spark):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(180):
        y = (i // 6) % 2
        for pos in range(4):
            rows.append((i, pos, i % 2, ["train", "calibration", "test"][i % 3], y, 1, (rng.normal(size=4) * 0.6 + (2.0 * y if pos == 3 else 0.0)).tolist()))
    df = spark.createDataFrame(rows, "id bigint, pos int, layer int, split string, correct int, real_object int, vec array<double>")
    for grid in ((), (0.5, 5.0)):
        out = run(df, ProbeSpec(probe="sawmil", c=5.0, grid=grid, replicates=30))
        assert out.predicted.count() == 60
        for r in out.metrics.collect():
            assert r.map > 0.8 and r.mcc_ci[1] <= r.mcc_ci[0] <= r.mcc_ci[2] and r.mcc_ci[0] == pytest.approx(r.mcc)
            assert r.conformal_wmcc_ci[0] == pytest.approx(r.conformal_wmcc) and len(r.conformal_ami_ci) == 3
    with pytest.raises(ValueError):
        run(df.drop("pos"), ProbeSpec(probe="sawmil"))
    with pytest.raises(ValueError):
        ProbeSpec(probe="tree")


@pytest.mark.parametrize(("agg", "probe"), [("last", "mean_diff"), ("all", "sawmil")])
def test_three_class_life(spark, agg, probe):
    rng = np.random.default_rng(10)
    rows = []
    for i in range(240):
        y = i % 3
        shift = np.eye(3)[y] * 3
        for pos in range(3):
            rows.append((i, pos, (rng.normal(size=3) * 0.5 + (shift if pos == 2 else 0)).tolist(), None if i % 40 == 0 else y, ["train", "calibration", "test"][(i // 3) % 3]))
    df = spark.createDataFrame(rows, "id bigint, pos int, vec array<double>, y int, split string")
    out = multiclass.run(df, ProbeSpec(probe=probe, c=5.0), agg)
    got = out.predicted.collect()
    sure = [r for r in got if r.prediction >= 0]
    assert len(got) == len({r.id for r in got}) and sum(r.prediction == r.y for r in sure) >= 0.85 * len(sure) > 0
    assert all(abs(sum(r.score) - 1) < 1e-6 for r in got)
    with pytest.raises(ValueError):
        multiclass.run(df, agg="first")


def test_files(spark, tmp_path):
    (tmp_path / "checked.csv").write_bytes("﻿Name,Keep,Notes\r\n\"Guates, OK\",1,x\r\nNo,0,\r\nBlank,,\r\n".encode())
    assert [r.name for r in files.read_checked(spark, str(tmp_path / "checked.csv")).collect()] == ["Guates, OK"]
    df = spark.createDataFrame([("a", ["x", "y"]), ('q "z", w', [])], "n string, v array<string>")
    files.write_csv(df, str(tmp_path / "out"), ["v"])
    assert sorted((r.n, r.v) for r in files.read_csv(spark, str(tmp_path / "out")).collect()) == [("a", "x, y"), ('q "z", w', None)]
    files.write_lines(df, "n", str(tmp_path / "lines"))
    assert spark.read.text(str(tmp_path / "lines")).count() == 2
    (tmp_path / "list.json").write_text('[{"a": 1}, {"a": 2}]')
    assert files.read_json(spark, str(tmp_path / "list.json"), lines=False).count() == 2
    entries = spark.createDataFrame([("w", '{"frequency": {"zipf": 3.5}, "definitions": [{"definition": "d1", "partOfSpeech": "noun"}, {"definition": "d2"}]}'), ("v", '{"frequency": 2, "definitions": {"definition": "d3"}}'), ("u", "broken"), ("t", None)], "word string, body string")
    assert sorted((r.word, r.frequency, r.definition) for r in files.flattened_dictionary(entries).collect()) == [("v", 2.0, "d3"), ("w", 3.5, "d1"), ("w", 3.5, "d2")]
    np.save(tmp_path / "x.npy", np.arange(12, dtype=np.float16).reshape(4, 3))
    spark.dataSource.register(files.NpySource)
    got = spark.read.format("npy").option("path", str(tmp_path / "x.npy")).option("rows", 3).load().orderBy("row").collect()
    assert [r.vec for r in got] == [[0, 1, 2], [3, 4, 5], [6, 7, 8], [9, 10, 11]]
