"""Queries of assembly, predicates, sources, streams and the whole life of a probe."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from probelake.catalogue.probing import _ALPHA, _C2, _FOUR, _MCC, _icp_sql
from probelake.catalogue.views import PROBE, STMT, act, stmt
from probelake.operators import meandiff as M
from probelake.plans.probe import ProbeSpec, run
from probelake.session import fresh, spread, written
from probelake.sources import files
from probelake.sources.tables import latest, table
from probelake.streaming import flows as S

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _words(spark, sf):
    return latest(table(spark, sf, "word_statements"), "row_id", ["dataset", "statement", "object_1", "object_2", "correct", "negated", "real_object", "fake_object", "category"])


_WORDS = "wst AS (SELECT * FROM word_statements QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY ingested_at) = 1)"
_UNION = (
    f"{STMT}, {_WORDS}, un AS (SELECT category, correct, dataset, false AS fake_object, freq_1, max_population, negation, object_1, object_2, real_object, row_id, statement FROM stmt "
    "UNION ALL SELECT category, CAST(correct AS INT), dataset, fake_object, 0.0, 0, CAST(negated AS INT), object_1, object_2, CAST(real_object AS INT), row_id, statement FROM wst)"
)


def _union(spark, sf):
    a = stmt(spark, sf, ["dataset", "statement", "object_1", "object_2", "correct", "negation", "real_object", "category", "max_population", "freq_1"])
    both = files.assembled([a, _words(spark, sf)])
    return both.withColumn("fake_object", F.coalesce("fake_object", F.lit(False)))


@query(f"WITH {_UNION} SELECT * FROM un")
def assemble_union(spark, sf):
    return _union(spark, sf)


@query(f"WITH {STMT}, z AS (SELECT row_id, min(scores) AS s FROM zero_shot_scores GROUP BY row_id) SELECT stmt.row_id, s[1] AS scores_0, s[2] AS scores_1, s[3] AS scores_2, s[4] AS scores_3 FROM stmt LEFT JOIN z USING (row_id)")
def assemble_scores(spark, sf):
    return files.with_scores(stmt(spark, sf, ["dataset"]).select("row_id"), table(spark, sf, "zero_shot_scores"))


@query(f"WITH {_WORDS} SELECT row_id, CASE WHEN category = 'synonyms' THEN NULL ELSE object_2 END AS nulled, CASE WHEN dataset LIKE '%synth%' AND length(object_1) < 9 THEN upper(object_1) ELSE object_1 END AS cased FROM wst")
def case_rules(spark, sf):
    w = _words(spark, sf)
    short = F.col("dataset").like("%synth%") & (F.char_length("object_1") < 9)
    return w.select("row_id", F.when(F.col("category") == "synonyms", None).otherwise(F.col("object_2")).alias("nulled"), F.when(short, F.upper("object_1")).otherwise(F.col("object_1")).alias("cased"))


@query("WITH l AS (SELECT l_orderkey, list(l_returnflag) AS f FROM lineitem GROUP BY l_orderkey) SELECT o_orderkey FROM orders LEFT JOIN l ON o_orderkey = l_orderkey WHERE NOT list_contains(f, 'R') AND NOT list_contains(f, 'A')")
def list_without(spark, sf):
    flags = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("f"))
    o = table(spark, sf, "orders").join(flags, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return o.where(~F.array_contains("f", "R") & ~F.array_contains("f", "A")).select("o_orderkey")


@query(f"WITH {STMT} SELECT row_id, max_population, freq_1, freq_2 FROM stmt WHERE max_population > 30000 OR (freq_1 > 1 AND freq_2 > 1)")
def range_filter(spark, sf):
    return stmt(spark, sf, ["max_population", "freq_1", "freq_2"]).where("max_population > 30000 or (freq_1 > 1 and freq_2 > 1)")


@query(f"WITH {STMT} SELECT row_id FROM stmt WHERE statement IS NOT NULL AND length(statement) > 0 AND object_1 IS NOT NULL AND category IS NOT NULL")
def drop_nulls(spark, sf):
    s = stmt(spark, sf, ["statement", "object_1", "category"])
    return s.na.drop(subset=["statement", "object_1", "category"]).where(F.char_length("statement") > 0).select("row_id")


@query(f"WITH {STMT}, big AS (SELECT object_1 FROM stmt WHERE object_1 <> '' GROUP BY object_1 HAVING count(*) > 4) SELECT row_id, object_1 IN (SELECT object_1 FROM big) AS inside FROM stmt WHERE object_1 <> ''")
def semi_anti(spark, sf):
    s = stmt(spark, sf, ["object_1"]).where("object_1 <> ''")
    big = s.groupBy("object_1").agg(F.count("*").alias("n")).where("n > 4").select("object_1")
    inside, outside = s.join(big, "object_1", "left_semi"), s.join(big, "object_1", "left_anti")
    return inside.select("row_id", F.lit(True).alias("inside")).unionByName(outside.select("row_id", F.lit(False).alias("inside")))


@query(f"WITH {STMT}, pop AS (SELECT object_1, max(max_population) AS population FROM stmt WHERE max_population IS NOT NULL GROUP BY object_1) SELECT row_id, population FROM stmt LEFT JOIN pop USING (object_1)")
def lookup_population(spark, sf):
    s = stmt(spark, sf, ["object_1", "max_population"])
    pop = s.where("max_population is not null").groupBy("object_1").agg(F.max("max_population").alias("population"))
    return s.join(pop, "object_1", "left").select("row_id", "population")


@query(f"WITH {STMT} SELECT correct, negation, count(*) AS n, round(1 - count(*) / sum(count(*)) OVER ()::DOUBLE, 6) AS weight FROM stmt GROUP BY correct, negation")
def group_weights(spark, sf):
    n = stmt(spark, sf, ["correct", "negation"]).groupBy("correct", "negation").agg(F.count("*").alias("n"))
    whole = n.agg(F.sum("n").alias("all"))
    return n.crossJoin(F.broadcast(whole)).select("correct", "negation", "n", F.round(1 - F.col("n") / F.col("all"), 6).alias("weight"))


@query(f"WITH {STMT} SELECT DISTINCT object_1, object_2 FROM stmt WHERE object_1 IS NOT NULL AND object_2 IS NOT NULL")
def distinct_pairs(spark, sf):
    return stmt(spark, sf, ["object_1", "object_2"]).na.drop(subset=["object_1", "object_2"]).select("object_1", "object_2").dropDuplicates()


@query("SELECT DISTINCT embedding FROM embeddings")
def unique_vectors(spark, sf):
    return table(spark, sf, "embeddings").select("embedding").distinct()


@query("WITH k AS (SELECT c_nationkey AS k, list_sort(list_distinct(list(c_mktsegment))) AS v FROM customer GROUP BY c_nationkey), s AS (SELECT n_nationkey AS k FROM nation) SELECT k.k, array_to_string([x FOR x IN k.v IF x <> 'BUILDING'], ',') AS others, array_to_string([x FOR x IN k.v IF x IN ('BUILDING', 'MACHINERY')], ',') AS shared FROM k JOIN s USING (k)")
def set_algebra(spark, sf):
    k = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.array_sort(F.collect_set("c_mktsegment")).alias("v"))
    k = k.join(table(spark, sf, "nation").select(F.col("n_nationkey").alias("k")), "k")
    return k.select("k", F.array_join(F.array_except("v", F.array(F.lit("BUILDING"))), ",").alias("others"), F.array_join(F.array_intersect("v", F.array(F.lit("BUILDING"), F.lit("MACHINERY"))), ",").alias("shared"))


@query("WITH u AS (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events) SELECT event_id, TRY_CAST(k AS INT) AS k FROM u WHERE k IS NOT NULL")
def json_field(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k")).where("k is not null")


@query("SELECT DISTINCT trial_id, coalesce(json_valid(parameters), false) AS readable FROM trial_log")
def json_readable(spark, sf):
    return table(spark, sf, "trial_log").select("trial_id", F.coalesce(F.try_parse_json("parameters").isNotNull() & F.col("parameters").isNotNull(), F.lit(False)).alias("readable")).distinct()


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_round_trip(spark, sf):
    path = fresh(spark, "nation-csv")
    files.write_csv(table(spark, sf, "nation"), path)
    return files.read_csv(spark, path, table(spark, sf, "nation").schema).select("n_nationkey", "n_name", "n_regionkey")


@query("SELECT r_regionkey, r_name FROM region")
def json_round_trip(spark, sf):
    path = fresh(spark, "region-json")
    files.write_json(table(spark, sf, "region"), path)
    return files.read_json(spark, path, table(spark, sf, "region").schema).select("r_regionkey", "r_name")


@query("SELECT vec_id, layer FROM activations WHERE layer = 7 GROUP BY vec_id, layer")
def vector_layout(spark, sf):
    path = fresh(spark, "vectors")
    files.write_vectors(table(spark, sf, "activations").dropDuplicates(["vec_id"]).select("vec_id", "layer", "embeddings"), path)
    return files.read_vectors(spark, path, [7]).select("vec_id", "layer")


_KL = "USING (k, layer)"
_EMI = "n / t * ln(t * n / (a * b)) * exp(lgamma(a + 1) + lgamma(b + 1) + lgamma(t - a + 1) + lgamma(t - b + 1) - lgamma(t + 1) - lgamma(n + 1) - lgamma(a - n + 1) - lgamma(b - n + 1) - lgamma(t - a - b + n + 1))"
_FIGURES = ("mcc", "recall", "ami", "ari", "map", "energy")
#: All figures of a probe in SQL, k 0 for all test rows and 1 for those the conformal step accepts.
_METRICS = (
    f"{_icp_sql(_ALPHA['symmetric'][0])}, u AS (SELECT 0 AS k, layer, y, CAST(score > 0 AS INT) AS p, score FROM icp UNION ALL SELECT 1, layer, y, prediction, score FROM icp WHERE prediction <> -1), "
    f"f AS (SELECT k, layer, count(*) AS n, {_FOUR} FROM u GROUP BY k, layer), "
    f"rr AS (SELECT *, {_C2('tp')} + {_C2('tn')} + {_C2('fp')} + {_C2('fn')} AS i, {_C2('tp + fn')} + {_C2('tn + fp')} AS pa, {_C2('tp + fp')} + {_C2('tn + fn')} AS pb, {_C2('tp + tn + fp + fn')} AS ab FROM f), "
    f"lab AS (SELECT k, layer, n, {_MCC} AS mcc, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS recall, CASE WHEN ab = 0 OR (pa + pb) / 2 - pa * pb / ab = 0 THEN 1.0 ELSE (i - pa * pb / ab) / ((pa + pb) / 2 - pa * pb / ab) END AS ari FROM rr), "
    "ct AS (SELECT k, layer, y, p, count(*) AS n FROM u GROUP BY ALL), ma AS (SELECT k, layer, y, sum(n)::BIGINT AS a FROM ct GROUP BY ALL), mb AS (SELECT k, layer, p, sum(n)::BIGINT AS b FROM ct GROUP BY ALL), mt AS (SELECT k, layer, sum(n)::BIGINT AS t FROM ct GROUP BY ALL), "
    f"mi AS (SELECT k, layer, sum(n / t * ln(t * n / (a * b))) AS v FROM ct JOIN ma USING (k, layer, y) JOIN mb USING (k, layer, p) JOIN mt {_KL} GROUP BY k, layer), "
    f"ha AS (SELECT k, layer, -sum(a / t * ln(a / t)) AS v, count(*) AS c FROM ma JOIN mt {_KL} GROUP BY k, layer), hb AS (SELECT k, layer, -sum(b / t * ln(b / t)) AS v, count(*) AS c FROM mb JOIN mt {_KL} GROUP BY k, layer), "
    f"gg AS (SELECT k, layer, a, b, t, unnest(range(greatest(1, a + b - t), least(a, b) + 1)) AS n FROM ma JOIN mb {_KL} JOIN mt {_KL}), em AS (SELECT k, layer, sum({_EMI}) AS v FROM gg GROUP BY k, layer), "
    f"am AS (SELECT k, layer, CASE WHEN (ha.c = 1 AND hb.c = 1) OR abs((ha.v + hb.v) / 2 - em.v) < 1e-15 THEN 1.0 ELSE (mi.v - em.v) / ((ha.v + hb.v) / 2 - em.v) END AS ami FROM mi JOIN ha {_KL} JOIN hb {_KL} JOIN em {_KL}), "
    "sc AS (SELECT k, layer, score, count(*) FILTER (y = 1) AS pos, count(*) AS n FROM u GROUP BY k, layer, score), sw AS (SELECT k, layer, pos, sum(pos) OVER o AS cp, sum(n) OVER o AS cn FROM sc WINDOW o AS (PARTITION BY k, layer ORDER BY score DESC)), "
    "ap AS (SELECT k, layer, CASE WHEN sum(pos) = 0 THEN 0.0 ELSE sum(pos * cp / cn) / sum(pos) END AS map FROM sw GROUP BY k, layer), "
    "sl AS (SELECT k, layer, y, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 0 END AS s FROM u WINDOW w AS (PARTITION BY k, layer)), "
    "sg AS (SELECT k, layer, s, count(*) FILTER (y = 1) AS c1, count(*) FILTER (y = 0) AS c0 FROM sl GROUP BY k, layer, s), sd AS (SELECT k, layer, lead(s) OVER o - s AS d, sum(c1) OVER o AS k1, sum(c0) OVER o AS k0 FROM sg WINDOW o AS (PARTITION BY k, layer ORDER BY s)), "
    f"sn AS (SELECT k, layer, sum(c1) AS n1, sum(c0) AS n0 FROM sg GROUP BY k, layer), en AS (SELECT k, layer, CASE WHEN any_value(n1) = 0 OR any_value(n0) = 0 THEN 1000.0 ELSE sqrt(2 * coalesce(sum((k1 / n1 - k0 / n0) * (k1 / n1 - k0 / n0) * d), 0)) END AS energy FROM sd JOIN sn {_KL} GROUP BY k, layer), "
    f"fig AS (SELECT * FROM lab JOIN am {_KL} JOIN ap {_KL} JOIN en {_KL}), cov AS (SELECT layer, avg(in_set) AS coverage, avg(CASE WHEN prediction <> -1 THEN 1.0 ELSE 0.0 END) AS acceptance_rate FROM icp GROUP BY layer)"
)


@query(
    f"WITH {_METRICS} SELECT a.layer, a.n, c.n AS conformal_n, {', '.join(f'round(a.{x}, 6) AS {x}, round(c.{x}, 6) AS conformal_{x}' for x in _FIGURES)}, round(coverage, 6) AS coverage, round(acceptance_rate, 6) AS acceptance_rate, "
    f"{', '.join(f'round(c.{x} * c.n / a.n, 6) AS conformal_w{x}' for x in _FIGURES if x != 'recall')}, round(coalesce(c.n, 0) / a.n, 6) AS a_rate FROM fig a LEFT JOIN fig c ON c.layer = a.layer AND c.k = 1 JOIN cov ON cov.layer = a.layer WHERE a.k = 0"
)
def probe_metrics(spark, sf):
    s = stmt(spark, sf, ["correct", "real_object", "split"])
    from probelake.catalogue.views import vectors

    rows = vectors(spark, sf).join(s, "row_id").select(F.col("vec_id").alias("id"), "layer", "vec", "split", "correct", "real_object")
    out = run(rows, ProbeSpec(task=3)).metrics
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


# streams, run over what is there


#: Files of a table that a stream takes at once, two tables of them at most in one trigger.
_FILES = 50


def _folder(spark, sf, name, partitions=4):
    """The table as files of a stream's folder; partitions None: as many as its scan and the session's cores have, _FILES at most."""
    path = fresh(spark, f"stream-{name}")
    df = table(spark, sf, name)
    (df.repartition(partitions) if partitions else spread(df).coalesce(_FILES)).write.mode("overwrite").parquet(path)
    return path, df.schema


def _once(spark, df, name, mode):
    return S.run_once(df, f"{name}_{uuid.uuid4().hex}", fresh(spark, "offsets"), mode)


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_windows(spark, sf):
    path, schema = _folder(spark, sf, "events", 1)
    out = S.windowed_counts(S.read_stream(spark, path, schema))
    return _once(spark, out, "windows", "complete").select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT event_id, event_type FROM events")
def stream_deduplicated(spark, sf):
    path, schema = _folder(spark, sf, "events", None)
    spread(table(spark, sf, "events")).coalesce(_FILES).write.mode("append").parquet(path)  # every event comes twice
    events = S.read_stream(spark, path, schema).select("event_id", "event_type", "ts")
    return _once(spark, S.deduplicated(events), "events", "append").select("event_id", "event_type")


@query("SELECT trial_id, count(*) AS updates, max(progress) AS best FROM trial_log GROUP BY trial_id")
def stream_trials(spark, sf):
    path, schema = _folder(spark, sf, "trial_log")
    from probelake.operators.registry import latest_by_key

    states = _once(spark, S.trial_states(S.read_stream(spark, path, schema)), "trials", "update")
    return latest_by_key(states, ["trial_id"], ["updates"])


@query(
    f"WITH {PROBE}, packed AS (SELECT layer, list(w ORDER BY dim) AS w, list(mu ORDER BY dim) AS mu, list(sd ORDER BY dim) AS sd FROM probe GROUP BY layer) "
    "SELECT a.vec_id, a.layer, round(list_sum([(a.embeddings[i]::DOUBLE - p.mu[i]) / p.sd[i] * p.w[i] FOR i IN range(1, 65)]) + b.b, 6) AS score FROM activations a JOIN packed p ON p.layer = a.layer JOIN bias b ON b.layer = a.layer WHERE len(a.embeddings) = 64"
)
def stream_score(spark, sf):
    probes = written(M.fit(act(spark, sf).where("split = 'train'"), group=["layer"]), "probes")
    path, schema = _folder(spark, sf, "activations", None)
    v = S.read_stream(spark, path, schema).where(F.size("embeddings") == 64).select("vec_id", "layer", F.col("embeddings").cast("array<double>").alias("vec"))
    return _once(spark, S.scored_stream(v, probes), "scores", "append").select("vec_id", "layer", F.round("score", 6).alias("score"))


@query("SELECT trial_id, max(progress) AS progress FROM trial_log GROUP BY trial_id")
def stream_upsert(spark, sf):
    path, schema = _folder(spark, sf, "trial_log")
    to = fresh(spark, "upsert")
    q = S.read_stream(spark, path, schema, 2).writeStream.foreachBatch(S.upsert_sink(to, "trial_id", ["progress"])).option("checkpointLocation", f"{to}-offsets").trigger(availableNow=True).start()
    q.awaitTermination()
    return S.latest_state(spark, to, "trial_id", ["progress"]).select("trial_id", "progress")
