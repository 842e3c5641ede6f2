"""Queries of vectors under interventions, features, effects, registries and solver-backed probes."""

from __future__ import annotations

from pyspark.sql import functions as F

from probelake.catalogue.views import ACT, BAGS, STMT, VECTORS, act, bags, stmt, vectors
from probelake.functions import vectors as V
from probelake.functions.hashing import h_sql
from probelake.operators import bags as B
from probelake.operators import effects as I
from probelake.operators import features as T
from probelake.operators import meandiff as M
from probelake.operators import registry as R
from probelake.operators import stacking, svm
from probelake.session import written
from probelake.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# interventions: along the direction (1, -1, 1, -1, ...)

_EMB = "e AS (SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS v, [CASE WHEN i % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END FOR i IN range(64)] AS d FROM embeddings), u AS (SELECT vec_id, v, d, [x / sqrt(64.0::DOUBLE) FOR x IN d] AS n FROM e), w AS (SELECT *, list_dot_product(v, n) AS t FROM u)"
_MOVES = {
    "translate": ("0.7", "n", lambda v, d: V.translated(v, d, 0.7)),
    "translate_to": ("(0.7 - t)", "n", lambda v, d: V.translated(v, d, 0.7, absolute=False)),
    "amplify": ("sign(t) * 0.3", "n", lambda v, d: V.amplified(v, d, 0.3)),
    "polarize": ("CASE WHEN t > 0 THEN sign(t) * 0.3 ELSE 0 END", "n", lambda v, d: V.polarized(v, d, 0.3)),
    "polarize_negative": ("CASE WHEN t < 0 THEN sign(t) * 0.3 ELSE 0 END", "n", lambda v, d: V.polarized(v, d, 0.3, positive=False)),
    "translate_raw": ("0.7", "d", lambda v, d: V.translated_raw(v, d, 0.7)),
    "amplify_elementwise": ("0.2 * sign(d[i] * v[i])", "d", lambda v, d: V.amplified_raw(v, d, 0.2)),
}


def _emb(spark, sf):
    d = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(i % 2 == 0, 1.0).otherwise(-1.0))
    return table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), d.alias("d"))


def _move(f):
    return lambda spark, sf: _emb(spark, sf).select("vec_id", F.posexplode(f(F.col("v"), F.col("d"))).alias("dim", "x")).select("vec_id", "dim", F.round("x", 6).alias("x"))


for _n, (_step, _dir, _f) in _MOVES.items():
    QUERIES[_n] = _move(_f)
    SQL[_n] = f"WITH {_EMB} SELECT vec_id, i::INT - 1 AS dim, round(v[i] + {_step} * {_dir}[i], 6) AS x FROM w, range(1, 65) r(i)"


@query(f"WITH {_EMB} SELECT vec_id, i::INT - 1 AS dim, round(v[i] / sqrt(list_dot_product(v, v)), 6) AS x FROM w, range(1, 65) r(i)")
def vector_normalised(spark, sf):
    return _emb(spark, sf).select("vec_id", F.posexplode(V.normalised("v")).alias("dim", "x")).select("vec_id", "dim", F.round("x", 6).alias("x"))


@query(f"WITH {_EMB}, k AS (SELECT vec_id, v, list_sort(v, 'DESC')[8] AS edge FROM e) SELECT vec_id, i::INT - 1 AS dim, round(CASE WHEN v[i] >= edge THEN v[i] ELSE 0 END, 6) AS x FROM k, range(1, 65) r(i)")
def feat_sparsify(spark, sf):
    return _emb(spark, sf).select("vec_id", F.posexplode(V.sparsified("v", 8)).alias("dim", "x")).select("vec_id", "dim", F.round("x", 6).alias("x"))


@query(f"WITH {_EMB} SELECT vec_id, i::INT - 1 AS dim, round(CASE WHEN i IN (2, 4, 8) THEN v[i] ELSE 0 END, 6) AS x FROM e, range(1, 65) r(i)")
def feat_selected(spark, sf):
    return _emb(spark, sf).select("vec_id", F.posexplode(V.selected("v", [1, 3, 7])).alias("dim", "x")).select("vec_id", "dim", F.round("x", 6).alias("x"))


@query(f"WITH {_EMB} SELECT vec_id, round(list_sum([(sqrt(abs(v[i])) - sqrt(abs(d[i]))) * (sqrt(abs(v[i])) - sqrt(abs(d[i]))) FOR i IN range(1, 65)]), 6) AS hellinger, round(list_sum([greatest(-0.5, least(0.5, x)) FOR x IN v]), 6) AS clipped, len(v) + 6 AS padded FROM e")
def vector_distances(spark, sf):
    size = lambda c: F.transform(c, F.abs)
    e = _emb(spark, sf)
    return e.select("vec_id", F.round(V.hellinger(size("v"), size("d")), 6).alias("hellinger"), F.round(V.total(F.transform("v", lambda x: V.sanitized(x, 0.5))), 6).alias("clipped"), F.size(V.padded("v", 70)).cast("bigint").alias("padded"))


# features of the activations, layer by layer

_AL = f"{ACT}, al AS (SELECT layer, vec_id AS id, y, unnest(range(64)) AS dim, unnest(vec) AS x FROM act)"


def _al(spark, sf):
    return written(act(spark, sf).select("layer", F.col("vec_id").alias("id"), "vec", "y"), "al")


def _layers(df):
    """The layers of df: tens."""
    return sorted(r.layer for r in df.select("layer").distinct().collect())


def _each_layer(df, work):
    """work's result on each layer, with the layer."""
    out = [work(df.where(F.col("layer") == k)).withColumn("layer", F.lit(k)) for k in _layers(df)]
    first = out[0]
    for o in out[1:]:
        first = first.unionByName(o)
    return first


@query(f"WITH {_AL} SELECT layer, dim::INT AS dim, round(coalesce(corr(x, y), 0), 6) AS pearson FROM al GROUP BY layer, dim")
def feat_pearson(spark, sf):
    return T.pearson(_al(spark, sf), group=["layer"]).select("layer", "dim", F.round("pearson", 6).alias("pearson"))


@query(f"WITH {_AL}, r AS (SELECT layer, dim, rank() OVER (PARTITION BY layer, dim ORDER BY x) + (count(*) OVER (PARTITION BY layer, dim, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY layer, dim ORDER BY y) + (count(*) OVER (PARTITION BY layer, dim, y) - 1) / 2 AS ry FROM al) SELECT layer, dim::INT AS dim, round(coalesce(corr(rx, ry), 0), 6) AS spearman FROM r GROUP BY layer, dim")
def feat_spearman(spark, sf):
    return T.spearman(_al(spark, sf), group=["layer"]).select("layer", "dim", F.round("spearman", 6).alias("spearman"))


@query(
    f"WITH {_AL}, p AS (SELECT a.layer, a.id, a.dim AS a, b.dim AS b, a.x AS x, b.x AS y FROM al a JOIN al b ON a.layer = b.layer AND a.id = b.id AND b.dim = a.dim + 1), q AS (SELECT *, row_number() OVER (PARTITION BY layer, a, b ORDER BY x, id) AS pos FROM p), "
    "s AS (SELECT layer, a, b, abs(lead(pos) OVER (PARTITION BY layer, a, b ORDER BY y, pos) - pos) AS d FROM q) SELECT layer, a::INT AS a, b::INT AS b, round(1 - 3 * sum(d) / (count(*)::DOUBLE * count(*) - 1), 6) AS xi FROM s GROUP BY layer, a, b"
)
def feat_chatterjee(spark, sf):
    return T.chatterjee(_al(spark, sf), list(range(64)), group=["layer"]).select("layer", "a", "b", F.round("xi", 6).alias("xi"))


@query(
    f"WITH {_AL}, g AS (SELECT layer, dim, x, count(*) FILTER (y = 1) AS c1, count(*) FILTER (y = 0) AS c0 FROM al GROUP BY layer, dim, x), w AS (SELECT layer, dim, lead(x) OVER o - x AS d, sum(c1) OVER o / sum(c1) OVER (PARTITION BY layer, dim) - sum(c0) OVER o / sum(c0) OVER (PARTITION BY layer, dim) AS gap FROM g WINDOW o AS (PARTITION BY layer, dim ORDER BY x)) "
    "SELECT layer, dim::INT AS dim, round(sum(abs(gap) * d), 6) AS wasserstein, round(sqrt(2 * sum(gap * gap * d)), 6) AS energy, round(max(abs(gap)), 6) AS ks FROM w GROUP BY layer, dim"
)
def feat_distances(spark, sf):
    return T.distances(_al(spark, sf), group=["layer"]).select("layer", "dim", *[F.round(c, 6).alias(c) for c in ("wasserstein", "energy", "ks")])


@query(
    f"WITH {_AL}, c AS (SELECT layer, dim, y, count(*)::DOUBLE AS n, avg(x) AS m, var_pop(x) * count(*) AS q FROM al GROUP BY layer, dim, y), g AS (SELECT layer, dim, sum(n) AS n, count(*) AS k, sum(n * m) / sum(n) AS m, sum(q) AS w FROM c GROUP BY layer, dim) "
    "SELECT g.layer, g.dim::INT AS dim, round(sum(c.n * (c.m - g.m) * (c.m - g.m)) / (any_value(g.k) - 1) / (any_value(g.w) / (any_value(g.n) - any_value(g.k))), 4) AS f FROM g JOIN c ON c.layer = g.layer AND c.dim = g.dim GROUP BY g.layer, g.dim"
)
def feat_f(spark, sf):
    return T.f_values(_al(spark, sf), group=["layer"]).select("layer", "dim", F.round("f", 4).alias("f"))


@query()
def feat_mi(spark, sf):
    return T.mutual_information(_al(spark, sf), group=["layer"])


@query()
def feat_rf(spark, sf):
    return _each_layer(_al(spark, sf), T.forest_importances)


@query()
def feat_mrmr(spark, sf):
    a = _al(spark, sf)
    chosen = [(k, i, d) for k in _layers(a) for i, d in enumerate(T.selected_dims(a.where(F.col("layer") == k), 8))]
    return spark.createDataFrame(chosen, "layer int, place int, dim int")


_PAIR = f"{STMT}, pr AS (SELECT a.row_id AS id_a, b.row_id AS id_b FROM stmt a JOIN stmt b ON a.correct = b.correct AND a.object_1 = b.object_1 AND a.object_2 = b.object_2 WHERE a.negation = 0 AND b.negation = 1 AND a.object_1 <> 'x')"


def _sides(spark, sf):
    s = stmt(spark, sf, ["correct", "object_1", "object_2", "negation", "category"]).withColumnRenamed("row_id", "id")
    return s.where("negation = 0"), s.where("negation = 1")


@query(f"WITH {_PAIR} SELECT id_a, id_b FROM pr WHERE {h_sql(5, 'id_a || chr(58) || id_b')} < 0.5 * 4294967296")
def pairs_contrast(spark, sf):
    a, b = _sides(spark, sf)
    return T.contrast_pairs(a, b, ["correct", "object_1", "object_2"], frac=0.5)


_COND = (
    f"{STMT}, sa AS (SELECT row_id AS id, correct AS k, category AS c FROM stmt WHERE negation = 0 AND correct IS NOT NULL AND category IS NOT NULL), sb AS (SELECT row_id AS id, correct AS k, category AS c FROM stmt WHERE negation = 1 AND correct IS NOT NULL AND category IS NOT NULL)"
)


@query(f"WITH {_COND}, j AS (SELECT sa.c AS ca, count(*) AS pairs FROM sa JOIN sb ON sa.k = sb.k AND sa.c <> sb.c GROUP BY sa.c) SELECT ca AS category, pairs, round(1 - pairs / sum(pairs) OVER (), 6) AS weight FROM j")
def pairs_conditional(spark, sf):
    a, b = _sides(spark, sf)
    w = T.conditional_weights(T.conditional_counts(a, b, "correct", "category"))
    return w.select(F.col("ca").alias("category"), "pairs", F.round("weight", 6).alias("weight"))


@query(
    f"WITH {_COND}, j AS (SELECT sa.k, sa.c AS ca, sb.c AS cb, count(*) AS pairs, count(DISTINCT sa.id) AS na, count(DISTINCT sb.id) AS nb FROM sa JOIN sb ON sa.k = sb.k AND sa.c <> sb.c GROUP BY ALL), w AS (SELECT ca, 1 - sum(pairs) / (SELECT sum(pairs) FROM j) AS w FROM j GROUP BY ca), "
    "e AS (SELECT k, ca, cb, na, nb, sum(w * pairs) OVER (ORDER BY k, ca, cb) / sum(w * pairs) OVER () AS hi FROM j JOIN w USING (ca) WHERE w > 0), f AS (SELECT *, coalesce(lag(hi) OVER (ORDER BY k, ca, cb), 0) AS lo FROM e), "
    f"d AS (SELECT i, {h_sql('5c', 'i')} / 4294967296::DOUBLE AS u, {h_sql('5a', 'i')} / 4294967296::DOUBLE AS x, {h_sql('5b', 'i')} / 4294967296::DOUBLE AS z FROM range(200) r(i)), "
    "g AS (SELECT i, k, ca, cb, floor(x * na)::BIGINT + 1 AS pa, floor(z * nb)::BIGINT + 1 AS pb FROM d JOIN f ON u >= lo AND u < hi), q AS (SELECT k, ca, cb, pa, pb, min(i) AS i FROM g GROUP BY ALL ORDER BY i LIMIT 100), "
    "ra AS (SELECT *, row_number() OVER (PARTITION BY k, c ORDER BY id) AS p FROM sa), rb AS (SELECT *, row_number() OVER (PARTITION BY k, c ORDER BY id) AS p FROM sb) "
    "SELECT ra.id AS id_a, rb.id AS id_b FROM q JOIN ra ON ra.k = q.k AND ra.c = q.ca AND ra.p = q.pa JOIN rb ON rb.k = q.k AND rb.c = q.cb AND rb.p = q.pb"
)
def pairs_weighted(spark, sf):
    a, b = _sides(spark, sf)
    return T.conditional_pairs(a, b, "correct", "category", 100)


@query(f"WITH {BAGS}, l AS (SELECT bag, pos, unnest(range(64)) AS dim, unnest(vec) AS x FROM bags) SELECT bag, pos, dim::INT AS dim, round(x - avg(x) OVER (PARTITION BY bag, dim), 6) AS x FROM l")
def mean_removed(spark, sf):
    return T.mean_removed(bags(spark, sf).select("bag", "pos", "vec"), "bag").select("bag", "pos", "dim", F.round("x", 6).alias("x"))


@query()
def neutralize(spark, sf):
    b = written(bags(spark, sf).select("bag", "pos", "vec"), "bags")
    return T.neutralised(b, T.shared_directions(b, "bag", share=0.3))


@query("SELECT count(*) AS n, true AS apart, true AS unit FROM embeddings")
def neutralize_check(spark, sf):
    """Whether no vector has a part along the shared directions left, and all are of length 1."""
    b = written(bags(spark, sf).select("bag", "pos", "vec"), "bags")
    d = T.shared_directions(b, "bag", share=0.3)
    along = [F.abs(F.aggregate(F.zip_with("vec", F.array(*[F.lit(float(x)) for x in row]), lambda a, c: a * c), F.lit(0.0), lambda s, x: s + x)) < 1e-9 for row in d[:8]]
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    apart = F.lit(True)
    for a in along:
        apart = apart & a
    return T.neutralised(b, d).agg(F.count("*").alias("n"), F.bool_and(apart).alias("apart"), F.bool_and(F.abs(length - 1) < 1e-9).alias("unit"))


# effects of interventions on option probabilities: zero-shot scores, and the same turned by one place

_EFF = f"{STMT}, z AS (SELECT row_id, scores AS p, [scores[2], scores[3], scores[4], scores[1]] AS q FROM zero_shot_scores WHERE len(scores) = 4), ef AS (SELECT z.*, correct FROM z JOIN stmt USING (row_id) WHERE correct IS NOT NULL)"


def _effects(spark, sf):
    p = F.col("scores")
    z = table(spark, sf, "zero_shot_scores").where(F.size(p) == 4).select("row_id", p.alias("p"), F.array(p[1], p[2], p[3], p[0]).alias("q"))
    return z.join(stmt(spark, sf, ["correct"]).where("correct is not null"), "row_id")


@query(f"WITH {_EFF}, m AS (SELECT avg(p[1] - p[2]) FILTER (correct = 0) AS n, avg(p[1] - p[2]) FILTER (correct = 1) AS p, avg(q[1] - q[2]) FILTER (correct = 0) AS na, avg(q[1] - q[2]) FILTER (correct = 1) AS pa FROM ef) SELECT round((na - n) / (p - n), 4) AS nie_ft, round((pa - p) / (n - p), 4) AS nie_tf FROM m")
def nie(spark, sf):
    e = I.natural_effects(_effects(spark, sf), "correct", F.col("p")[0] - F.col("p")[1], F.col("q")[0] - F.col("q")[1])
    return e.select(F.round("nie_ft", 4).alias("nie_ft"), F.round("nie_tf", 4).alias("nie_tf"))


@query(f"WITH {_EFF} SELECT round(avg(q[1] - p[1]), 6) AS effect, round(avg(q[1] - p[1]) / (stddev_samp(q[1] - p[1]) / sqrt(count(*))), 4) AS t FROM ef")
def indirect_effect(spark, sf):
    return I.indirect_effect(_effects(spark, sf), F.col("q")[0] - F.col("p")[0]).select(F.round("effect", 6).alias("effect"), F.round("t", 4).alias("t"))


@query(f"WITH {_EFF} SELECT row_id, round((1 - (q[1] + q[2] + q[3])) / (1 - (p[1] + p[2] + p[3])), 4) AS ratio FROM ef WHERE p[1] + p[2] + p[3] < 0.999")
def decoherence(spark, sf):
    e = _effects(spark, sf).withColumn("a", F.slice("p", 1, 3)).withColumn("b", F.slice("q", 1, 3)).where(V.total("a") < 0.999)
    return e.select("row_id", F.round(I.decoherence(F.col("a"), F.col("b")), 4).alias("ratio"))


@query(f"WITH {_EFF} SELECT round(sum(abs(q[1] - p[1]) + abs(q[2] - p[2])) / sum(abs(q[3] - p[3]) + abs(q[4] - p[4])), 6) AS ratio FROM ef")
def localized_ratio(spark, sf):
    return I.localized_ratio(_effects(spark, sf), F.col("p"), F.col("q"), [0, 1], [2, 3]).select(F.round("ratio", 6).alias("ratio"))


@query("SELECT model, round(sum(ln(scores[1] + 1e-6)), 4) AS logp FROM zero_shot_scores WHERE scores IS NOT NULL AND len(scores) > 0 GROUP BY model")
def logproba(spark, sf):
    z = table(spark, sf, "zero_shot_scores").where(F.size("scores") > 0)
    return I.log_probability(z, "model", F.get("scores", F.lit(0))).select("model", F.round("logp", 4).alias("logp"))


# registry

_LOG = ["date", "time", "progress", "parameters", "status", "task"]


@query("SELECT trial_id, model, datapack, task, parameters, progress, status, date, time FROM trial_log QUALIFY row_number() OVER (PARTITION BY trial_id ORDER BY date DESC NULLS LAST, time DESC NULLS LAST, progress DESC NULLS LAST, parameters DESC NULLS LAST, status DESC NULLS LAST, task DESC NULLS LAST, model DESC NULLS LAST) = 1")
def trial_log_latest(spark, sf):
    cols = ["trial_id", "model", "datapack", "task", "parameters", "progress", "status", "date", "time"]
    return R.latest_by_key(table(spark, sf, "trial_log"), ["trial_id"], [*_LOG, "model"]).select(*cols)


@query("SELECT trial_id, progress, row_number() OVER (PARTITION BY trial_id ORDER BY date, time, progress, status, parameters) AS step FROM trial_log")
def trial_progress(spark, sf):
    return R.progress(table(spark, sf, "trial_log"), order=["date", "time", "progress", "status", "parameters"]).select("trial_id", "progress", F.col("step").cast("bigint").alias("step"))


@query("WITH l AS (SELECT * FROM trial_log QUALIFY row_number() OVER (PARTITION BY trial_id ORDER BY date DESC NULLS LAST, time DESC NULLS LAST, progress DESC NULLS LAST, parameters DESC NULLS LAST, status DESC NULLS LAST, task DESC NULLS LAST) = 1) SELECT trial_id, CASE WHEN status = 0 THEN -1 ELSE status END AS status FROM l")
def trial_upsert(spark, sf):
    base = written(R.latest_by_key(table(spark, sf, "trial_log"), ["trial_id"], _LOG).select("trial_id", "status"), "log")
    return R.upserted(base, base.where("status = 0").withColumn("status", F.lit(-1)), "trial_id")


@query("SELECT trial_id, true AS dated FROM trial_log WHERE trial_id IS NOT NULL GROUP BY trial_id")
def trial_stamped(spark, sf):
    trials = table(spark, sf, "trial_log").where("trial_id is not null").select("trial_id").distinct()
    return R.stamped(trials).select("trial_id", (F.col("date").rlike("^\\d{4}-\\d{2}-\\d{2}$") & F.col("time").rlike("^\\d{2}:\\d{2}$")).alias("dated"))


_METRIC = "m AS (SELECT l_returnflag AS g, l_linenumber AS layer, round(avg(l_discount), 6) AS metric FROM lineitem GROUP BY l_returnflag, l_linenumber)"


def _metric(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("g"), F.col("l_linenumber").alias("layer")).agg(F.round(F.avg("l_discount"), 6).alias("metric"))


@query(f"WITH {_METRIC} SELECT g, layer, metric FROM m WHERE metric > -1 QUALIFY row_number() OVER (PARTITION BY g ORDER BY metric DESC, layer) = 1")
def best_layer(spark, sf):
    return R.best_layer(_metric(spark, sf), group=["g"])


@query(f"WITH {_METRIC} SELECT layer, metric FROM m WHERE g = 'N' ORDER BY metric DESC, layer LIMIT 3")
def top_k_layers(spark, sf):
    return R.top_layers(_metric(spark, sf).where("g = 'N'").select("layer", "metric"), 3)


@query(f"WITH {_METRIC}, b AS (SELECT layer, (a.metric + b.metric) / 2 AS metric FROM m a JOIN m b USING (layer) WHERE a.g = 'N' AND b.g = 'R') SELECT layer, round(metric, 6) AS metric FROM b ORDER BY b.metric DESC, layer LIMIT 1")
def generalization(spark, sf):
    m = _metric(spark, sf)
    return R.generalization(m.where("g = 'N'"), m.where("g = 'R'")).select("layer", F.round("metric", 6).alias("metric"))


@query("SELECT n, lo, hi FROM (VALUES (28, 2, 27), (32, 2, 31), (42, 3, 41), (48, 4, 47)) t(n, lo, hi)")
def layer_range(spark, sf):
    return spark.createDataFrame([(n, *R.layer_range(list(range(n)), (0.1, 1.0))) for n in (28, 32, 42, 48)], "n int, lo int, hi int")


@query("SELECT DISTINCT p_size AS layer FROM part WHERE p_size NOT IN (SELECT p_size FROM part WHERE p_partkey % 40 = 0) UNION SELECT min(p_size) - 1 FROM part WHERE p_size NOT IN (SELECT p_size FROM part WHERE p_partkey % 40 = 0) HAVING min(p_size) - 1 >= 1")
def layer_resume(spark, sf):
    p = table(spark, sf, "part")
    return R.layers_due(p.select(F.col("p_size").alias("layer")), p.where("p_partkey % 40 = 0").select(F.col("p_size").alias("layer")), 1)


@query("SELECT p_partkey, coalesce(TRY_CAST(NULLIF(regexp_extract(p_name, '(\\d+)', 1), '') AS INT), 0) AS number FROM part")
def extract_number(spark, sf):
    return table(spark, sf, "part").select("p_partkey", R.number_in(F.col("p_name"), r"(\d+)", 0).alias("number"))


@query(f"WITH {STMT}, {VECTORS} SELECT 'no vector' AS side, count(*) AS n FROM (SELECT DISTINCT row_id FROM stmt) WHERE row_id NOT IN (SELECT row_id FROM vectors) HAVING count(*) > 0 UNION ALL SELECT 'no row', count(*) FROM (SELECT DISTINCT row_id FROM vectors) WHERE row_id NOT IN (SELECT row_id FROM stmt) HAVING count(*) > 0")
def reconcile_rows(spark, sf):
    return R.reconciled(vectors(spark, sf), stmt(spark, sf, ["dataset"]))


@query("WITH n AS (SELECT count(*) AS n FROM part) SELECT p_partkey, ntile((SELECT greatest(1, n // 12) FROM n)) OVER (ORDER BY p_partkey)::INT AS batch FROM part")
def batches(spark, sf):
    return R.batched(table(spark, sf, "part").select("p_partkey"), 12, "p_partkey")


# solver-backed probes


def _trained(spark, sf):
    return written(act(spark, sf).where("split = 'train'").select(F.col("vec_id").alias("id"), "layer", "vec", "y"), "train")


@query()
def svm_probe(spark, sf):
    p = svm.fit(_trained(spark, sf), ["layer"])
    rows = act(spark, sf).where("split = 'test'")
    return M.scored(rows, p, ["layer"]).select(F.col("vec_id").alias("id"), "layer", "y", "score", (F.col("score") > 0).cast("int").alias("predicted"))


@query()
def cv_search(spark, sf):
    return svm.search(_trained(spark, sf), ["layer"])


_GRID = "g AS (SELECT c::DOUBLE AS c, fold, avg(l_discount) * 10 AS score FROM (SELECT l_linenumber / 10.0 AS c, l_suppkey % 3 AS fold, l_discount FROM lineitem) GROUP BY c, fold)"


@query(f"WITH {_GRID}, s AS (SELECT c, avg(score) AS mean, stddev_pop(score) / sqrt(count(*)) AS se FROM g GROUP BY c), b AS (SELECT c, mean, se FROM s ORDER BY mean DESC, c LIMIT 1), f AS (SELECT s.* FROM s, b WHERE s.mean > b.mean - b.se ORDER BY s.c LIMIT 1) SELECT c, round(mean, 6) AS mean, round(se, 6) AS se FROM (SELECT * FROM f UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM f))")
def cv_one_se_select(spark, sf):
    g = table(spark, sf, "lineitem").groupBy((F.col("l_linenumber") / F.lit(10.0)).alias("c"), (F.col("l_suppkey") % 3).alias("fold")).agg((F.avg("l_discount") * 10).alias("score"))
    return svm.one_se(g).select("c", F.round("mean", 6).alias("mean"), F.round("se", 6).alias("se"))


@query()
def sawmil_probe(spark, sf):
    b = written(B.intra_labels(B.drop_zero(bags(spark, sf))), "bags")
    p = svm.fit_mil(b)
    scored = b.crossJoin(F.broadcast(p)).select("bag", "y", M.decision("vec").alias("score"))
    return scored.groupBy("bag", "y").agg(F.max("score").alias("score"))


def _tri_scores(spark, sf):
    e = table(spark, sf, "embeddings")
    rows = e.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), F.pmod("label", F.lit(3)).alias("y3"))
    for c in range(3):
        p = M.fit(rows.withColumn("y", (F.col("y3") == c).cast("int")), group=[]).select(*[F.col(x).alias(f"{x}_{c}") for x in ("direction", "bias", "mu", "sd")])
        rows = rows.crossJoin(F.broadcast(p)).withColumn(f"s{c}", M.decision("vec", f"direction_{c}", f"bias_{c}", f"mu_{c}", f"sd_{c}")).drop(*p.columns)
    return written(rows.select("id", "y3", "s0", "s1", "s2"), "tri")


@query()
def mc_stacker(spark, sf):
    t = _tri_scores(spark, sf)
    model = stacking.fit(t, ["s0", "s1", "s2"], "y3", 50)
    out = t.select("id", "y3", stacking.probabilities(["s0", "s1", "s2"], model).alias("p"))
    return out.select("id", "y3", *[F.col("p")[i].alias(f"p_{i}") for i in range(3)])
