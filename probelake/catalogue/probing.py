"""Queries of labels, splits, bags, scaling, the mean-difference probe, conformal prediction and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probelake.catalogue.views import ACT, BAGS, LONG, PROBE, STMT, VECTORS, act, bags, stmt, vectors
from probelake.functions.hashing import h_sql
from probelake.functions.vectors import sigmoid
from probelake.operators import bags as B
from probelake.operators import conformal as C
from probelake.operators import labels as L
from probelake.operators import meandiff as M
from probelake.operators import metrics as E
from probelake.operators import splits as S
from probelake.operators.scaling import gram_matrix, vector_stats
from probelake.session import written
from probelake.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# labels


def _task(task: int):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        s = stmt(spark, sf, ["correct", "real_object"])
        return s.select("row_id", L.task_target(task, F.col("correct"), F.col("real_object")).alias("target"), L.task_mask(task, F.col("real_object")).cast("int").alias("mask"))

    return run


_TARGETS = {
    0: "correct",
    1: "CAST(correct = 0 AND real_object = 1 AS INT)",
    2: "CAST(real_object = 0 AS INT)",
    3: "CAST(correct = 1 AND real_object = 1 AS INT)",
    -1: "CASE WHEN real_object = 0 THEN 2 WHEN correct = 1 THEN 1 WHEN correct = 0 THEN 0 END",
}
for _t, _sql in _TARGETS.items():
    _name = f"task_labels_{_t if _t >= 0 else 'mc'}"
    QUERIES[_name] = _task(_t)
    SQL[_name] = f"WITH {STMT} SELECT row_id, {_sql} AS target, {'CAST(real_object = 1 AS INT)' if _t == 3 else '1'} AS mask FROM stmt"


@query("SELECT row_id, CASE WHEN real_object AND NOT correct THEN 0 WHEN real_object AND correct THEN 1 WHEN fake_object AND NOT real_object AND NOT fictional_object THEN 4 WHEN NOT correct AND (fake_object OR fictional_object) THEN 2 WHEN correct AND (fake_object OR fictional_object) THEN 3 ELSE 4 END AS label FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY ingested_at) AS rn FROM word_statements) WHERE rn = 1")
def combined_label(spark, sf):
    from probelake.sources.tables import latest

    w = latest(table(spark, sf, "word_statements"), "row_id", ["correct", "real_object", "fake_object", "fictional_object"])
    flags = [F.col(c).cast("int") for c in ("correct", "real_object", "fake_object", "fictional_object")]
    return w.select("row_id", L.combined_label(*flags).alias("label"))


@query(f"WITH {STMT} SELECT row_id, CASE WHEN correct = 0 THEN -1 ELSE 1 END AS signed, CAST(correct = 1 AND real_object = 1 AS INT) AS true_and_real FROM stmt WHERE correct IS NOT NULL")
def label_signed(spark, sf):
    s = stmt(spark, sf, ["correct", "real_object"]).where("correct is not null")
    return s.select("row_id", L.signed(F.col("correct")).alias("signed"), L.true_and_real(F.col("correct"), F.col("real_object")).alias("true_and_real"))


# splits

_KEYED = "rows AS (SELECT row_id AS id, object_1 AS a, object_2 AS b FROM stmt WHERE object_1 <> '' AND object_2 <> '')"


def _exclusive_sql(seed: int, size: float, rows: str, p: str) -> str:
    """CTEs named with prefix p that end in {p}split(id, is_test) of the relation `rows`."""
    keep = 1 - size
    return (
        f"{p}pairs AS (SELECT *, row_number() OVER (ORDER BY {h_sql(seed, 'pair')}, pair) AS r FROM (SELECT DISTINCT a, b, a || '|' || b AS pair FROM {rows})), "
        f"{p}kept AS (SELECT * FROM {p}pairs WHERE r <= (SELECT round_even({keep} * count(*), 0) FROM {p}pairs)), "
        f"{p}entries AS (SELECT *, row_number() OVER (ORDER BY {h_sql(seed + 1, 'entry')}, entry) AS r FROM (SELECT a AS obj, pair || '#1' AS entry FROM {p}kept UNION ALL SELECT b, pair || '#2' FROM {p}kept)), "
        f"{p}best AS (SELECT obj, min(r) AS r FROM {p}entries GROUP BY obj), "
        f"{p}m AS (SELECT id, least(x.r, y.r) AS m FROM {rows} LEFT JOIN {p}best x ON a = x.obj LEFT JOIN {p}best y ON b = y.obj), "
        f"{p}sizes(k, n) AS (SELECT 0, (SELECT count(*) FROM {p}entries) UNION ALL SELECT k + 1, CAST(floor(n * 0.975::DOUBLE) AS BIGINT) FROM {p}sizes WHERE n > 0), "
        f"{p}at AS (SELECT n FROM {p}sizes WHERE (SELECT count(*) FROM {p}m WHERE m IS NULL OR m > n) > {size} * (SELECT count(*) FROM {p}m) ORDER BY k LIMIT 1), "
        f"{p}split AS (SELECT id, (m IS NULL OR m > (SELECT n FROM {p}at)) AS is_test FROM {p}m)"
    )


_SPLIT = f"WITH RECURSIVE {STMT}, {_KEYED}, {_exclusive_sql(42, 0.25, 'rows', 'o')}"
_SPLIT3 = f"{_SPLIT}, train AS (SELECT rows.* FROM rows JOIN osplit USING (id) WHERE NOT is_test), {_exclusive_sql(52, 0.25, 'train', 'i')}"


@query(f"{_SPLIT} SELECT id AS row_id, is_test FROM osplit")
def split_exclusive(spark, sf):
    return S.exclusive_split(stmt(spark, sf, ["object_1", "object_2"]))


@query(f"{_SPLIT3} SELECT id AS row_id, 'test' AS split FROM osplit WHERE is_test UNION ALL SELECT id, CASE WHEN is_test THEN 'calibration' ELSE 'train' END FROM isplit")
def split_calibration(spark, sf):
    return S.exclusive_split3(stmt(spark, sf, ["object_1", "object_2"]))


_RANDOM = f"CASE WHEN {h_sql(42, 'row_id')} >= 0.75 * 4294967296 THEN 'test' WHEN {h_sql(43, 'row_id')} >= 0.75 * 4294967296 THEN 'calibration' ELSE 'train' END"


@query(f"WITH {STMT} SELECT row_id, {_RANDOM} AS split FROM stmt")
def split_random(spark, sf):
    return S.random_split(stmt(spark, sf, ["dataset"])).select("row_id", "split")


@query(f"WITH {STMT} SELECT split, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS ratio FROM stmt GROUP BY split")
def split_ratio(spark, sf):
    return S.split_ratio(stmt(spark, sf, ["split"])).select("split", "n", F.round("ratio", 6).alias("ratio"))


@query(f"WITH {STMT} SELECT row_id, split, row_number() OVER (PARTITION BY split ORDER BY {h_sql(43, 'row_id')}, row_id) AS perm_rank FROM stmt")
def split_shuffled(spark, sf):
    return S.shuffled(stmt(spark, sf, ["split"]), 43, group=["split"])


# bags


@query(f"WITH {BAGS} SELECT bag, count(*) AS n, max(y) AS y FROM bags GROUP BY bag")
def bag_sizes(spark, sf):
    return bags(spark, sf).groupBy("bag").agg(F.count("*").alias("n"), F.max("y").alias("y"))


@query(f"WITH {BAGS} SELECT bag, pos, round(vec[1], 6) AS v0, round(vec[64], 6) AS v63 FROM bags QUALIFY row_number() OVER (PARTITION BY bag ORDER BY pos DESC) = 1")
def bag_last(spark, sf):
    return B.last_of(bags(spark, sf), "bag", "pos", "vec").select("bag", "pos", F.round(F.col("vec")[0], 6).alias("v0"), F.round(F.col("vec")[63], 6).alias("v63"))


@query(f"WITH {BAGS} SELECT bag, pos FROM bags WHERE attn = 1 AND len([x FOR x IN vec IF x <> 0]) > 0")
def bag_drop_zero(spark, sf):
    return B.drop_zero(bags(spark, sf)).select("bag", "pos")


@query(f"WITH {BAGS} SELECT bag, pos, CASE WHEN row_number() OVER (PARTITION BY bag ORDER BY pos DESC) <= 2 THEN 1 ELSE attn END AS attn FROM bags QUALIFY row_number() OVER (PARTITION BY bag ORDER BY pos DESC) <= 3 + bag % 2")
def bag_mask_tail(spark, sf):
    b = bags(spark, sf).withColumn("mask_len", 3 + F.pmod("bag", F.lit(2)))
    return B.mask_tail(b, forced=2).select("bag", "pos", "attn")


@query(f"WITH {BAGS} SELECT b.bag, b.pos FROM bags b JOIN (SELECT bag, arg_min(vec, pos) AS f FROM bags GROUP BY bag) f ON b.bag = f.bag WHERE list_sum([b.vec[i] - f.f[i] FOR i IN range(1, 65)]) <> 0")
def bag_remove_padded(spark, sf):
    return B.drop_like_first(bags(spark, sf)).select("bag", "pos")


_CAP = (
    f"e AS (SELECT *, row_number() OVER (PARTITION BY bag ORDER BY pos DESC) AS e, {h_sql(0, chr(98) + 'ag || ' + chr(39) + '-' + chr(39) + ' || pos')} AS hh FROM bags), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY bag ORDER BY CAST(e <= 2 AS INT), hh, pos) AS k FROM e)"
)


@query(f"WITH {BAGS}, {_CAP} SELECT bag, pos, row_number() OVER (PARTITION BY bag ORDER BY CAST(e <= 2 AS INT), CASE WHEN e <= 2 THEN pos ELSE hh END, pos) AS new_pos FROM k WHERE e <= 2 OR k <= 1")
def bag_cap(spark, sf):
    return B.capped(bags(spark, sf), most=3, last=2).select("bag", "pos", F.col("new_pos").cast("bigint").alias("new_pos"))


@query(f"WITH {BAGS} SELECT round(sum(intra) / count(*), 6) AS eta FROM (SELECT CASE WHEN row_number() OVER (PARTITION BY bag ORDER BY pos DESC) <= 2 THEN 1 ELSE 0 END AS intra FROM bags)")
def bag_eta(spark, sf):
    return B.eta(B.intra_labels(bags(spark, sf))).select(F.round("eta", 6).alias("eta"))


@query(f"WITH {BAGS} SELECT count(DISTINCT bag) FILTER (y = 1) AS x_p, count(DISTINCT bag) FILTER (y = 0) AS x_n, count(DISTINCT bag) AS x, count(*) FILTER (y = 1) AS l_p, count(*) FILTER (y = 0) AS l_n, count(*) AS l FROM bags")
def bag_splitter_counts(spark, sf):
    return B.splitter_counts(bags(spark, sf))


@query(f"WITH {BAGS} SELECT bag, round(max(vec[1] + vec[2]), 6) AS score FROM bags GROUP BY bag")
def bag_max_score(spark, sf):
    scored = bags(spark, sf).withColumn("score", F.col("vec")[0] + F.col("vec")[1])
    return B.max_score(scored).select("bag", F.round("score", 6).alias("score"))


@query(f"WITH {BAGS} SELECT bag, pos, round(greatest(vec[1], vec[2], vec[3]), 6) AS best FROM bags WHERE pos > 0 QUALIFY row_number() OVER (PARTITION BY bag ORDER BY greatest(vec[1], vec[2], vec[3]) DESC, pos) = 1")
def bag_argmax_row(spark, sf):
    b = bags(spark, sf).withColumn("scores", F.slice("vec", 1, 3))
    return B.argmax_row(b).select("bag", "pos", F.round(F.array_max("scores"), 6).alias("best"))


@query(
    f"WITH {BAGS}, s AS (SELECT *, vec[1] + vec[2] AS score, CASE WHEN row_number() OVER (PARTITION BY bag ORDER BY pos DESC) <= 2 THEN 1 ELSE 0 END AS intra FROM bags), "
    "z AS (SELECT count(*) AS l_p, count(DISTINCT bag) AS x_p FROM s WHERE y = 1), "
    "o AS (SELECT score, row_number() OVER (ORDER BY score DESC, bag, pos) AS r FROM s WHERE y = 1), "
    "e AS (SELECT score AS edge FROM o, z WHERE r = least(greatest(round_even(l_p * 0.2::DOUBLE, 0), x_p), l_p)), "
    "c AS (SELECT s.*, (y = 1 AND score >= edge) AS cand FROM s, e), a AS (SELECT count(*) FILTER (cand AND intra = 1) AS hits FROM c) "
    "SELECT bag, pos, CASE WHEN cand AND (hits < 0.05::DOUBLE * l_p OR intra = 1) THEN 1 ELSE -1 END AS label FROM c, a, z"
)
def sawmil_stage2_labels(spark, sf):
    b = B.intra_labels(bags(spark, sf).withColumn("score", F.col("vec")[0] + F.col("vec")[1]))
    return B.positive_cut(b, eta=0.2).select("bag", "pos", "label")


# scaling and the mean-difference probe


@query(f"WITH {ACT}, {LONG} SELECT layer, dim::INT AS dim, count(*) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS sd FROM long WHERE split = 'train' GROUP BY layer, dim")
def scale_stats(spark, sf):
    return vector_stats(act(spark, sf).where("split = 'train'"), "vec", ["layer"]).select("layer", "dim", "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


@query(f"WITH {VECTORS} SELECT layer, i::INT - 1 AS i, j::INT - 1 AS j, count(*) AS n, round(sum(vec[i] * vec[j]), 4) AS value FROM vectors, range(1, 65) a(i), range(1, 65) b(j) GROUP BY layer, i, j")
def gram(spark, sf):
    return gram_matrix(vectors(spark, sf), "vec", ["layer"]).select("layer", "i", "j", "n", F.round("value", 4).alias("value"))


@query()
def md_whitened_direction(spark, sf):
    rows = written(act(spark, sf).where("split = 'train'").select("layer", "vec", "y"), "rows")
    layers = sorted(r.layer for r in rows.select("layer").distinct().collect())  # tens
    fits = {k: M.fit_whitened(rows.where(F.col("layer") == k)) for k in layers}
    return spark.createDataFrame([(k, i, float(x), float(b)) for k, (w, b) in fits.items() for i, x in enumerate(w)], "layer int, dim int, w double, bias double")


def _probes(spark, sf):
    return written(M.fit(act(spark, sf).where("split = 'train'"), group=["layer"]), "probes")


@query(f"WITH {PROBE} SELECT layer, dim::INT AS dim, round(w, 6) AS w, round(b, 6) AS bias FROM probe JOIN bias USING (layer)")
def md_direction(spark, sf):
    p = _probes(spark, sf)
    return p.select("layer", F.posexplode("direction").alias("dim", "w"), F.round("bias", 6).alias("bias")).withColumn("w", F.round("w", 6))


def _scored(spark, sf):
    rows = act(spark, sf).where("split <> 'train'")
    s = M.scored(rows, _probes(spark, sf), ["layer"]).select(F.col("vec_id").alias("id"), "layer", "y", "split", "score")
    return written(s, "scores")


@query(f"WITH {PROBE} SELECT id, layer, y, split, round(score, 6) AS score, round(1 / (1 + exp(-score)), 6) AS proba, CAST(score > 0 AS INT) AS predicted FROM scored")
def md_scores(spark, sf):
    return _scored(spark, sf).select("id", "layer", "y", "split", F.round("score", 6).alias("score"), F.round(sigmoid("score"), 6).alias("proba"), (F.col("score") > 0).cast("int").alias("predicted"))


_ALPHA = {"symmetric": ("exp(-(2 * {c} - 1) * s.score)", C.symmetric), "threshold": ("exp(-(2 * {c} - 1) * (s.score - 0.25))", C.symmetric_at(0.25)), "reciprocal": ("CASE WHEN CAST(s.score > 0.1 AS INT) = {c} THEN 1 / (1 + abs(s.score)) ELSE 1 + abs(s.score) END", lambda y, f: C.reciprocal(y, f, 0.1)), "margin": ("CASE WHEN CAST(s.score > 0 AS INT) = {c} THEN 1 / (1 + abs(s.score)) ELSE 1 + abs(s.score) END", C.margin)}


def _icp_sql(alpha: str, tie: bool = False) -> str:
    cal = alpha.format(c="s.y")
    p = lambda c: f"(SELECT count(*) + 1 FROM cal WHERE cal.layer = s.layer AND cal.a >= s.a{c}) / (nc + 1)"
    both = "CASE WHEN p_0 > p_1 THEN 0 ELSE 1 END" if tie else "-1"
    return (
        f"{PROBE}, cal AS MATERIALIZED (SELECT layer, {cal} AS a FROM scored s WHERE split = 'calibration'), nn AS (SELECT layer, count(*) AS nc FROM cal GROUP BY layer), "
        f"cand AS (SELECT s.*, nc, {alpha.format(c='0')} AS a0, {alpha.format(c='1')} AS a1 FROM scored s JOIN nn USING (layer) WHERE split = 'test'), pv AS (SELECT id, layer, y, score, {p(0)} AS p_0, {p(1)} AS p_1 FROM cand s), "
        f"icp AS (SELECT *, CAST((y = 0 AND p_0 > 0.1) OR (y = 1 AND p_1 > 0.1) AS INT) AS in_set, CASE WHEN p_0 > 0.1 AND p_1 > 0.1 THEN {both} WHEN p_0 > 0.1 THEN 0 WHEN p_1 > 0.1 THEN 1 ELSE -1 END AS prediction FROM pv)"
    )


def _icp(spark, sf, nonconformity, tie=False):
    s = _scored(spark, sf)
    return C.icp(s.where("split = 'calibration'"), s.where("split = 'test'"), nonconformity, [0, 1], 0.1, tie, ["layer"])


_ICP_COLS = "id, layer, y, round(score, 6) AS score, round(p_0, 6) AS p_0, round(p_1, 6) AS p_1, in_set, prediction"


def _icp_query(name: str, tie: bool = False):
    def run(spark, sf):
        return _icp(spark, sf, _ALPHA[name][1], tie).selectExpr(*[x.strip() for x in ("id; layer; y; round(score, 6) AS score; round(p_0, 6) AS p_0; round(p_1, 6) AS p_1; in_set; prediction").split(";")])

    return run


for _n in _ALPHA:
    QUERIES[f"icp_binary_{_n}"] = _icp_query(_n)
    SQL[f"icp_binary_{_n}"] = f"WITH {_icp_sql(_ALPHA[_n][0])} SELECT {_ICP_COLS} FROM icp"
QUERIES["md_probe_scores"] = _icp_query("symmetric", True)
SQL["md_probe_scores"] = f"WITH {_icp_sql(_ALPHA['symmetric'][0], True)} SELECT {_ICP_COLS} FROM icp"


@query(f"WITH {_icp_sql(_ALPHA['symmetric'][0])} SELECT layer, count(*) AS n, round(avg(CASE WHEN prediction <> -1 THEN 1.0 ELSE 0.0 END), 6) AS acceptance_rate, round(avg(in_set), 6) AS coverage FROM icp GROUP BY layer")
def icp_coverage(spark, sf):
    return C.coverage(_icp(spark, sf, C.symmetric), ["layer"]).select("layer", "n", F.round("acceptance_rate", 6).alias("acceptance_rate"), F.round("coverage", 6).alias("coverage"))


_MULTI = {"inverse": "1 - s.p[{c} + 1]", "cumulative": "coalesce(list_sum([x FOR x IN s.p IF x > s.p[{c} + 1]]), 0)", "margin": "(1 - (s.p[{c} + 1] - CASE {c} WHEN 0 THEN greatest(s.p[2], s.p[3]) WHEN 1 THEN greatest(s.p[1], s.p[3]) ELSE greatest(s.p[1], s.p[2]) END)) / 2"}
_TRI = (
    "tri AS (SELECT vec_id AS id, label % 3 AS y, CASE WHEN vec_id % 2 = 0 THEN 'calibration' ELSE 'test' END AS split, [exp(x::DOUBLE) FOR x IN embedding[1:3]] AS e FROM embeddings), "
    "soft AS (SELECT id, y, split, [x / list_sum(e) FOR x IN e] AS p FROM tri)"
)


def _tri(spark, sf):
    e = table(spark, sf, "embeddings")
    v = F.transform(F.slice("embedding", 1, 3), lambda x: F.exp(x.cast("double")))
    from probelake.functions.vectors import total

    return e.select(F.col("vec_id").alias("id"), F.pmod("label", F.lit(3)).alias("y"), F.when(F.pmod("vec_id", F.lit(2)) == 0, "calibration").otherwise("test").alias("split"), v.alias("e")).select("id", "y", "split", F.transform("e", lambda x: x / total("e")).alias("score"))


def _multi_query(name: str):
    def run(spark, sf):
        t = written(_tri(spark, sf), "tri")
        out = C.icp(t.where("split = 'calibration'"), t.where("split = 'test'"), C.MULTICLASS[name], [0, 1, 2], 0.1)
        return out.select("id", "y", *[F.round(f"p_{c}", 6).alias(f"p_{c}") for c in range(3)], "in_set", "prediction")

    return run


for _n, _a in _MULTI.items():
    QUERIES[f"icp_multiclass_{_n}"] = _multi_query(_n)
    _p = ", ".join(f"(SELECT count(*) + 1 FROM cal WHERE cal.a >= s.a{c}) / ((SELECT count(*) FROM cal) + 1) AS p_{c}" for c in range(3))
    _cand = ", ".join(f"{_a.format(c=c)} AS a{c}" for c in range(3))
    SQL[f"icp_multiclass_{_n}"] = (
        f"WITH {_TRI}, cal AS MATERIALIZED (SELECT CASE s.y WHEN 0 THEN {_a.format(c=0)} WHEN 1 THEN {_a.format(c=1)} ELSE {_a.format(c=2)} END AS a FROM soft s WHERE split = 'calibration'), cand AS (SELECT s.*, {_cand} FROM soft s WHERE split = 'test'), "
        f"pv AS (SELECT id, y, {_p} FROM cand s), st AS (SELECT *, [c FOR c IN [0, 1, 2] IF [p_0, p_1, p_2][c + 1] > 0.1] AS st FROM pv) "
        "SELECT id, y, round(p_0, 6) AS p_0, round(p_1, 6) AS p_1, round(p_2, 6) AS p_2, CAST(list_contains(st, y) AS INT) AS in_set, CASE WHEN len(st) = 1 THEN st[1] ELSE -1 END AS prediction FROM st"
    )


# metrics


_TEST = "t AS (SELECT id, layer, y, score, CAST(score > 0 AS INT) AS p FROM scored WHERE split = 'test')"
_FOUR = "count(*) FILTER (y = 1 AND p = 1)::DOUBLE AS tp, count(*) FILTER (y = 0 AND p = 0)::DOUBLE AS tn, count(*) FILTER (y = 0 AND p = 1)::DOUBLE AS fp, count(*) FILTER (y = 1 AND p = 0)::DOUBLE AS fn"
_MCC = "CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) = 0 THEN 0.0::DOUBLE ELSE (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) END"


def _tested(spark, sf):
    return _scored(spark, sf).where("split = 'test'").select("id", "layer", "y", "score", (F.col("score") > 0).cast("int").alias("p"))


def _round(df, keys, *cols):
    return df.select(*keys, *[F.round(c, 6).alias(c) for c in cols])


@query(f"WITH {PROBE}, {_TEST}, c AS (SELECT layer, count(*) AS n, {_FOUR} FROM t GROUP BY layer) SELECT layer, n, round({_MCC}, 6) AS mcc, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS precision, round((tp + tn) / n, 6) AS accuracy FROM c")
def metric_binary(spark, sf):
    return _round(E.binary(_tested(spark, sf), "y", "p", ["layer"]), ["layer", "n"], "mcc", "recall", "precision", "accuracy")


_K3 = "k AS (SELECT label % 3 AS y, CASE WHEN embedding[1] > 0.1 THEN 0 WHEN embedding[2] > 0 THEN 1 ELSE 2 END AS p FROM embeddings)"


def _k3(spark, sf):
    e = F.col("embedding")
    return table(spark, sf, "embeddings").select(F.pmod("label", F.lit(3)).alias("y"), F.when(e[0] > 0.1, 0).when(e[1] > 0, 1).otherwise(2).alias("p"))


@query(
    f"WITH {_K3}, c AS (SELECT count(*)::DOUBLE AS s, count(*) FILTER (y = p)::DOUBLE AS c FROM k), a AS (SELECT y AS g, count(*)::DOUBLE AS n FROM k GROUP BY y), b AS (SELECT p AS g, count(*)::DOUBLE AS n FROM k GROUP BY p), "
    "z AS (SELECT (SELECT sum(a.n * b.n) FROM a JOIN b USING (g)) AS ab, (SELECT sum(n * n) FROM a) AS aa, (SELECT sum(n * n) FROM b) AS bb) SELECT round((c * s - ab) / sqrt((s * s - aa) * (s * s - bb)), 6) AS mcc FROM c, z"
)
def metric_mcc_multi(spark, sf):
    return _round(E.multiclass_mcc(_k3(spark, sf), "y", "p"), [], "mcc")


@query(
    f"WITH {PROBE}, {_TEST}, s AS (SELECT layer, score, count(*) FILTER (y = 1) AS pos, count(*) AS n FROM t GROUP BY layer, score), w AS (SELECT layer, pos, sum(pos) OVER o AS cp, sum(n) OVER o AS cn FROM s WINDOW o AS (PARTITION BY layer ORDER BY score DESC)) "
    "SELECT layer, round(sum(pos * cp / cn) / sum(pos), 6) AS ap FROM w GROUP BY layer"
)
def metric_ap(spark, sf):
    return _round(E.average_precision(_tested(spark, sf), "y", "score", ["layer"]), ["layer"], "ap")


@query(
    f"WITH {_K3}, t AS (SELECT y, p, count(*)::DOUBLE AS n FROM k GROUP BY y, p), b AS (SELECT sum(n * (n - 1) / 2) AS v FROM t), ra AS (SELECT sum(n * (n - 1) / 2) AS v FROM (SELECT sum(n) AS n FROM t GROUP BY y)), rb AS (SELECT sum(n * (n - 1) / 2) AS v FROM (SELECT sum(n) AS n FROM t GROUP BY p)), "
    "w AS (SELECT sum(n) AS n FROM t) SELECT round((b.v - ra.v * rb.v / (w.n * (w.n - 1) / 2)) / ((ra.v + rb.v) / 2 - ra.v * rb.v / (w.n * (w.n - 1) / 2)), 6) AS ari FROM b, ra, rb, w"
)
def metric_ari(spark, sf):
    return _round(E.adjusted_rand(_k3(spark, sf), "y", "p"), [], "ari")


@query(
    f"WITH {_K3}, t AS (SELECT y, p, count(*) AS n FROM k GROUP BY y, p), a AS (SELECT y, sum(n)::BIGINT AS a FROM t GROUP BY y), b AS (SELECT p, sum(n)::BIGINT AS b FROM t GROUP BY p), w AS (SELECT sum(n)::BIGINT AS t FROM t), "
    "mi AS (SELECT sum(n / t * ln(t * n / (a * b))) AS v FROM t JOIN a USING (y) JOIN b USING (p), w), ha AS (SELECT -sum(a / t * ln(a / t)) AS v FROM a, w), hb AS (SELECT -sum(b / t * ln(b / t)) AS v FROM b, w), "
    "g AS (SELECT a, b, t, unnest(range(greatest(1, a + b - t), least(a, b) + 1)) AS n FROM a, b, w), "
    "em AS (SELECT sum(n / t * ln(t * n / (a * b)) * exp(lgamma(a + 1) + lgamma(b + 1) + lgamma(t - a + 1) + lgamma(t - b + 1) - lgamma(t + 1) - lgamma(n + 1) - lgamma(a - n + 1) - lgamma(b - n + 1) - lgamma(t - a - b + n + 1))) AS v FROM g) "
    "SELECT round((mi.v - em.v) / ((ha.v + hb.v) / 2 - em.v), 6) AS ami FROM mi, ha, hb, em"
)
def metric_ami(spark, sf):
    return _round(E.adjusted_mutual_information(_k3(spark, sf), "y", "p"), [], "ami")


@query(
    f"WITH {PROBE}, {_TEST}, r AS (SELECT layer, y, (score - min(score) OVER (PARTITION BY layer)) / (max(score) OVER (PARTITION BY layer) - min(score) OVER (PARTITION BY layer)) AS s FROM t), "
    "g AS (SELECT layer, s, count(*) FILTER (y = 1) AS c1, count(*) FILTER (y = 0) AS c0 FROM r GROUP BY layer, s), "
    "w AS (SELECT layer, s, lead(s) OVER o - s AS d, sum(c1) OVER o AS k1, sum(c0) OVER o AS k0 FROM g WINDOW o AS (PARTITION BY layer ORDER BY s)), n AS (SELECT layer, sum(c1) AS n1, sum(c0) AS n0 FROM g GROUP BY layer) "
    "SELECT layer, round(sqrt(2 * sum((k1 / n1 - k0 / n0) * (k1 / n1 - k0 / n0) * d)), 6) AS energy FROM w JOIN n USING (layer) GROUP BY layer"
)
def metric_energy(spark, sf):
    return _round(E.energy_distance(_tested(spark, sf), "y", "score", ["layer"]), ["layer"], "energy")


@query(
    f"WITH {_icp_sql(_ALPHA['symmetric'][0])}, c AS (SELECT layer, count(*) AS masked, count(*) FILTER (prediction <> -1) AS accepted, {_FOUR.replace('p = ', 'prediction = ')} FROM icp GROUP BY layer), m AS (SELECT *, {_MCC} AS mcc FROM c) "
    "SELECT layer, accepted AS n, round(mcc, 6) AS mcc, round(mcc * accepted / masked, 6) AS wmcc, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS wrecall, round(accepted / masked, 6) AS a_rate FROM m"
)
def metric_weighted(spark, sf):
    p = written(_icp(spark, sf, C.symmetric), "icp")
    whole = p.groupBy("layer").agg(F.count("*").alias("masked"))
    m = whole.join(E.binary(p.where("prediction <> -1"), "y", "prediction", ["layer"]), "layer", "left").na.fill(0)
    w = E.weighted(F.col("mcc"), F.col("n"), F.col("masked"))
    return m.select("layer", "n", F.round("mcc", 6).alias("mcc"), F.round(w, 6).alias("wmcc"), F.round("recall", 6).alias("wrecall"), F.round(F.col("n") / F.col("masked"), 6).alias("a_rate"))


_CELLS = (
    f"{PROBE}, {_TEST}, cells AS (SELECT layer, y, p, count(*) AS n FROM t GROUP BY layer, y, p), cum AS MATERIALIZED (SELECT *, (sum(n) OVER (PARTITION BY layer ORDER BY y, p))::BIGINT AS hi, (sum(n) OVER (PARTITION BY layer))::BIGINT AS w FROM cells), "
    f"d AS (SELECT layer, b, {h_sql(0, 'b || ' + chr(39) + ':' + chr(39) + ' || j')} % w AS place FROM (SELECT DISTINCT layer, w FROM cum), range(100) x(b), range((SELECT max(w) FROM cum)) y(j) WHERE j < w), "
    "drawn AS (SELECT d.layer, b, y, p, count(*) AS n FROM d JOIN cum ON d.layer = cum.layer AND place < hi AND place >= hi - n GROUP BY ALL), boot AS (SELECT layer, -1 AS b, y, p, n FROM cells UNION ALL SELECT * FROM drawn), "
    "f AS (SELECT layer, b, coalesce(sum(n) FILTER (y = 1 AND p = 1), 0)::DOUBLE AS tp, coalesce(sum(n) FILTER (y = 0 AND p = 0), 0)::DOUBLE AS tn, coalesce(sum(n) FILTER (y = 0 AND p = 1), 0)::DOUBLE AS fp, coalesce(sum(n) FILTER (y = 1 AND p = 0), 0)::DOUBLE AS fn FROM boot GROUP BY layer, b)"
)
_ENDS = "SELECT layer, round(max(v) FILTER (b < 0), 6) AS value, round(quantile_cont(v, 0.025) FILTER (b >= 0), 6) AS lower, round(quantile_cont(v, 0.975) FILTER (b >= 0), 6) AS upper FROM m GROUP BY layer"
_C2 = lambda x: f"({x}) * (({x}) - 1) / 2"
_ARI = (
    f"r AS (SELECT layer, b, {_C2('tp')} + {_C2('tn')} + {_C2('fp')} + {_C2('fn')} AS i, {_C2('tp + fn')} + {_C2('tn + fp')} AS pa, {_C2('tp + fp')} + {_C2('tn + fn')} AS pb, {_C2('tp + tn + fp + fn')} AS a FROM f), "
    "m AS (SELECT layer, b, CASE WHEN a = 0 OR (pa + pb) / 2 - pa * pb / a = 0 THEN 1.0 ELSE (i - pa * pb / a) / ((pa + pb) / 2 - pa * pb / a) END AS v FROM r)"
)
_BOOT = {
    "mcc": f"m AS (SELECT layer, b, {_MCC} AS v FROM f)",
    "recall": "m AS (SELECT layer, b, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS v FROM f)",
    "ari": _ARI,
}


def _boot_query(name: str):
    def run(spark, sf):
        return _round(E.bootstrap(_tested(spark, sf), ["y", "p"], name, ["layer"], replicates=100, repeatable=True), ["layer"], "value", "lower", "upper")

    return run


for _n, _m in _BOOT.items():
    QUERIES[f"bootstrap_ci_{_n}"] = _boot_query(_n)
    SQL[f"bootstrap_ci_{_n}"] = f"WITH {_CELLS}, {_m} {_ENDS}"


@query()
def bootstrap_ci_ami(spark, sf):
    return E.bootstrap(_tested(spark, sf), ["y", "p"], "ami", ["layer"])


@query()
def bootstrap_ci_ap(spark, sf):
    rows = _tested(spark, sf)
    layers = sorted(r.layer for r in rows.select("layer").distinct().collect())  # tens
    parts = [E.bootstrap_average_precision(rows.where(F.col("layer") == k), "y", "score").select(F.lit(k).alias("layer"), "value", "lower", "upper") for k in layers]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query()
def bootstrap_ci_weighted(spark, sf):
    p = _icp(spark, sf, C.symmetric).withColumn("accepted", (F.col("prediction") != -1).cast("int"))
    return E.bootstrap(p, ["y", "prediction", "accepted"], "wmcc", ["layer"])


@query("SELECT id, value::DOUBLE AS value, lower::DOUBLE AS lower, upper::DOUBLE AS upper FROM (VALUES (1, 0.7, 0.7, 0.7), (2, 0.0, -0.000001, 0.000001), (3, 0.0, -0.000001, 0.000001)) AS t(id, value, lower, upper)")
def metric_safe(spark, sf):
    rows = spark.createDataFrame([(1, 0.7), (2, None), (3, float("nan"))], "id int, v double")
    v = E.safe(F.col("v"))
    return rows.select("id", v[0].alias("value"), v[1].alias("lower"), v[2].alias("upper"))
