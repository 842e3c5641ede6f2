"""Queries of readers and writers, checks, lookups, bags by split, and the places where outside functions plug in."""

from __future__ import annotations

from pyspark.sql import functions as F

from probelake.catalogue.views import BAGS, STMT, act, bags, stmt
from probelake.functions.hashing import h_sql
from probelake.functions.vectors import padded, sigmoid
from probelake.operators import bags as B
from probelake.operators import datagen as G
from probelake.operators import labels as L
from probelake.operators import metrics as E
from probelake.operators import prompts as P
from probelake.operators import registry as R
from probelake.operators import svm
from probelake.plans import multiclass
from probelake.plans.probe import ProbeSpec, artefacts, run
from probelake.plans.reader import ProbeReader
from probelake.session import fresh, written
from probelake.sources import files
from probelake.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT c_name, c_custkey FROM customer")
def csv_columns(spark, sf):
    path = fresh(spark, "customer-csv")
    files.write_csv(table(spark, sf, "customer"), path)
    return files.read_csv(spark, path, table(spark, sf, "customer").schema, ["c_name", "c_custkey"])


@query("SELECT c_nationkey, array_to_string(list_sort(list_distinct(list(c_mktsegment))), ', ') AS segments FROM customer GROUP BY c_nationkey")
def csv_lists(spark, sf):
    path = fresh(spark, "segments-csv")
    files.write_csv(table(spark, sf, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_set("c_mktsegment")).alias("segments")), path, ["segments"])
    return files.read_csv(spark, path, table(spark, sf, "customer").selectExpr("c_nationkey", "'' as segments").schema)


@query("SELECT p_name AS name FROM part WHERE p_size % 2 = 1")
def checked_names(spark, sf):
    path = fresh(spark, "checked-csv")
    rows = table(spark, sf, "part").select(F.col("p_name").alias("Name"), F.pmod("p_size", F.lit(2)).alias("Keep"), F.col("p_type").alias("Notes"))
    files.write_csv(rows, path)
    return files.read_checked(spark, path)


@query("SELECT s_name AS value FROM supplier")
def lines_round_trip(spark, sf):
    path = fresh(spark, "lines")
    files.write_lines(table(spark, sf, "supplier"), "s_name", path)
    return spark.read.text(path)


@query("SELECT row_id, model, count(*) AS n FROM zero_shot_scores WHERE scores IS NOT NULL AND model IS NOT NULL GROUP BY row_id, model")
def score_sink(spark, sf):
    path = fresh(spark, "scores")
    scores = table(spark, sf, "zero_shot_scores").where("scores is not null and model is not null")
    files.write_scores(scores, path)
    files.write_scores(scores.where(F.col("model") == scores.agg(F.min("model")).first()[0]), path)  # again: its own folder only
    return spark.read.parquet(path).groupBy("row_id", "model").agg(F.count("*").alias("n"))


@query("SELECT s_suppkey, s_name FROM supplier UNION ALL SELECT s_suppkey + 100000000, s_name FROM supplier")
def batches_resumed(spark, sf):
    path, rows = fresh(spark, "batches"), table(spark, sf, "supplier").select("s_suppkey", "s_name")
    for shift in (0, 100_000_000):  # two runs: the second goes on after the first one's batch
        _, batch = files.load_batches(spark, path)
        files.save_batch(rows.withColumn("s_suppkey", F.col("s_suppkey") + shift), path, batch)
    return files.load_batches(spark, path)[0].drop("batch")


@query("SELECT trial_id, max(progress) AS progress FROM trial_log WHERE trial_id IS NOT NULL AND progress IS NOT NULL GROUP BY trial_id")
def table_once(spark, sf):
    path = fresh(spark, "log")
    log = table(spark, sf, "trial_log").where("trial_id is not null and progress is not null").groupBy("trial_id").agg(F.max("progress").alias("progress"))
    empty = files.ensure_table(spark, path, log.schema)
    R.upserted(empty, log, "trial_id").write.mode("append").parquet(path)
    return files.ensure_table(spark, path, log.schema)


@query("SELECT s_name, s_suppkey FROM supplier")
def ordered_columns(spark, sf):
    return files.columns_in_order(table(spark, sf, "supplier"), ["s_name", "zipf", "s_suppkey", "pnoun"])


@query(f"WITH {STMT}, big AS (SELECT object_1 FROM stmt WHERE object_1 <> '' GROUP BY object_1 HAVING count(*) > 4) SELECT row_id, object_1 FROM stmt WHERE object_1 IN (SELECT object_1 FROM big) ORDER BY {h_sql(7, 'row_id')}, row_id LIMIT 200")
def gen_subsample_of(spark, sf):
    s = stmt(spark, sf, ["object_1"])
    big = s.where("object_1 <> ''").groupBy("object_1").agg(F.count("*").alias("n")).where("n > 4")
    return G.subsample_of(s, big, 200, 7).select("row_id", "object_1")


@query("SELECT c_nationkey AS nation, list_sort(list_distinct(list(c_mktsegment))) AS segments FROM customer GROUP BY c_nationkey")
def set_per_key(spark, sf):
    return table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.array_sort(F.collect_set("c_mktsegment")).alias("segments"))


@query("SELECT p_partkey, CASE WHEN f.n > 1 THEN f.n::DOUBLE ELSE CAST(" + h_sql(0, "lower(p_brand)") + " < 0.1 * 4294967296 AS INT)::DOUBLE END AS frequency FROM part LEFT JOIN (SELECT lower(p_brand) AS w, CASE WHEN count(*) % 3 = 0 THEN 0 ELSE count(*) + 1 END AS n FROM part GROUP BY lower(p_brand)) f ON f.w = lower(p_brand)")
def zipf_lookup(spark, sf):
    words = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("word"))
    n = words.groupBy(F.lower("word").alias("word")).agg(F.count("*").alias("n"))
    known = n.select("word", F.when(F.col("n") % 3 == 0, 0.0).otherwise(F.col("n") + 1.0).alias("frequency"))
    return G.zipf_frequencies(words, known).select("p_partkey", "frequency")


@query("SELECT s_suppkey, CASE WHEN " + h_sql(0, "s_name") + " < 0.25 * 4294967296 THEN CASE " + h_sql(1, "s_name") + " % 2 WHEN 0 THEN 'New ' || s_name ELSE s_name || ' City' END ELSE s_name END AS name FROM supplier")
def names_decorated(spark, sf):
    return G.decorated(table(spark, sf, "supplier").select("s_suppkey", F.col("s_name").alias("name")), ["New {}", "{} City"])


# checks


@query(f"WITH {STMT} SELECT count(*) AS n, count(DISTINCT correct) AS classes FROM stmt WHERE correct IN (0, 1)")
def labels_checked(spark, sf):
    rows = stmt(spark, sf, ["correct", "real_object"]).where(L.check_binary(F.col("correct"), F.col("real_object")).isNull())
    return rows.where("correct is not null").agg(F.count("*").alias("n"), F.countDistinct("correct").alias("classes"))


@query(f"WITH {STMT} SELECT row_id FROM stmt WHERE length(statement) > 2")
def statements_checked(spark, sf):
    rows = stmt(spark, sf, ["statement"]).where(F.char_length("statement") > 2)
    return rows.where(P.check_statement(F.col("statement")).isNull()).select("row_id")


@query()
def prompt_intro_chat(spark, sf):
    return spark.range(1).select(F.explode(P.VARIANTS["default"].intro_chat()).alias("m")).select("m.role", "m.content")


# bags


@query(f"WITH {BAGS}, s AS (SELECT *, CASE bag % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'calibration' ELSE 'test' END AS split FROM bags), k AS (SELECT * FROM s WHERE attn = 1 AND len([x FOR x IN vec IF x <> 0]) > 0) SELECT split, bag, count(*) AS tokens, max(y) AS y, max(pos) AS last_pos, round(arg_max(vec, pos)[1], 6) AS last_0 FROM k GROUP BY split, bag")
def bags_by_split(spark, sf):
    b = bags(spark, sf).withColumn("split", F.element_at(F.array(F.lit("train"), F.lit("calibration"), F.lit("test")), (F.pmod("bag", F.lit(3)) + 1).cast("int")))
    parts = [B.bags_of(b, s).select(F.lit(s).alias("split"), "bag", F.size("items").cast("bigint").alias("tokens"), "y", F.element_at("items", -1)["pos"].alias("last_pos"), F.round(F.col("last")[0], 6).alias("last_0")) for s in ("train", "calibration", "test")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"WITH {BAGS}, s AS (SELECT *, CASE bag % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'calibration' ELSE 'test' END AS split FROM bags) SELECT bag, pos, y FROM s WHERE split = 'test' QUALIFY row_number() OVER (PARTITION BY bag ORDER BY pos DESC) = 1")
def labelled_by_split(spark, sf):
    b = bags(spark, sf).withColumn("split", F.element_at(F.array(F.lit("train"), F.lit("calibration"), F.lit("test")), (F.pmod("bag", F.lit(3)) + 1).cast("int")))
    return B.labelled_of(b, "test").select("bag", "pos", "y")


@query(f"WITH {BAGS} SELECT bag, pos, y, row_number() OVER (ORDER BY CAST(y = 1 AS INT), bag, pos) AS place FROM bags")
def bag_stacked(spark, sf):
    return B.stacked(bags(spark, sf)).select("bag", "pos", "y", "place")


@query("SELECT vec_id, [x::DOUBLE FOR x IN embedding[1:60 + CAST(vec_id % 5 AS INT)]] || [0.0::DOUBLE FOR i IN range(10 - CAST(vec_id % 5 AS INT))] AS vec FROM embeddings")
def vectors_padded(spark, sf):
    v = F.slice(F.col("embedding").cast("array<double>"), F.lit(1), 60 + F.pmod("vec_id", F.lit(5)).cast("int"))
    return table(spark, sf, "embeddings").select("vec_id", padded(v, 70).alias("vec"))


@query("SELECT vec_id, CAST(round_even(1 / (1 + exp(-embedding[1]::DOUBLE)), 0) AS INT) AS predicted FROM embeddings")
def class_of_probability(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.bround(sigmoid(F.col("embedding")[0].cast("double"))).cast("int").alias("predicted"))


@query("WITH t AS (SELECT vec_id AS id, CAST(label < 5 AS INT) AS y, CASE WHEN vec_id % 7 = 0 THEN NULL ELSE embedding[1]::DOUBLE END AS s, CAST(vec_id % 2 AS INT) AS a FROM embeddings) SELECT round(avg(y), 6) AS ap FROM t WHERE a = 1")
def metric_ap_or(spark, sf):
    e = table(spark, sf, "embeddings").select((F.col("label") < 5).cast("int").alias("y"), F.when(F.col("vec_id") % 7 != 0, F.col("embedding")[0].cast("double")).alias("s"), F.pmod("vec_id", F.lit(2)).cast("int").alias("a"))
    return E.average_precision_or(e, "y", "s", "a").select(F.round("ap", 6).alias("ap"))


# the places where outside functions plug in


@query(f"WITH {STMT} SELECT row_id, length(object_1) AS size, CAST(contains(statement, object_1) AS INT) AS held FROM stmt WHERE object_1 IS NOT NULL AND statement IS NOT NULL")
def functions_mapped(spark, sf):
    rows = stmt(spark, sf, ["object_1", "statement"]).where("object_1 is not null and statement is not null")
    sized = files.mapped(rows, "size", len, "bigint", "object_1")
    return files.mapped(sized, "held", lambda r: int(r["object_1"] in r["statement"]), "int", "object_1", "statement").select("row_id", "size", "held")


# whole lives of probes


def _rows(spark, sf):
    return act(spark, sf).select(F.col("vec_id").alias("id"), "layer", "vec", "split", F.col("y").alias("correct"), F.lit(1).alias("real_object"))


@query()
def probe_intervals(spark, sf):
    return run(_rows(spark, sf), ProbeSpec(replicates=1000)).metrics


@query()
def probe_reader(spark, sf):
    """(id, layer, score, p_0, p_1, prediction) of the test rows by the stored artefacts."""
    rows = written(_rows(spark, sf), "rows")
    out, path = run(rows, ProbeSpec(trial="stored")), fresh(spark, "artefacts")
    files.write_probes(artefacts(out), path)
    reader = ProbeReader.of(spark, path, out.spec.name, out.calibration)
    scored = reader.predict(rows.where("split = 'test'")).withColumnRenamed("correct", "y")
    return reader.p_values(scored.select("id", "layer", "y", "score")).select("id", "layer", "score", "p_0", "p_1", "prediction")


def _split_bags(spark, sf):
    part = F.element_at(F.array(F.lit("train"), F.lit("calibration"), F.lit("test")), (F.pmod("bag", F.lit(3)) + 1).cast("int"))
    return bags(spark, sf).select(F.col("bag").alias("id"), "pos", F.lit(0).alias("layer"), "vec", part.alias("split"), F.col("y").alias("correct"), F.lit(1).alias("real_object"))


@query()
def sawmil_life(spark, sf):
    return run(_split_bags(spark, sf), ProbeSpec(probe="sawmil", known=5)).metrics


@query()
def sawmil_search(spark, sf):
    b = written(B.intra_labels(B.drop_zero(bags(spark, sf))).withColumn("layer", F.lit(0)), "bags")
    return svm.search_mil(b, ["layer"])


def _three(spark, sf):
    e = table(spark, sf, "embeddings")
    part = F.element_at(F.array(F.lit("train"), F.lit("calibration"), F.lit("test")), (F.pmod(F.floor(F.col("vec_id") / 5), F.lit(3)) + 1).cast("int"))
    rows = e.select(F.floor(F.col("vec_id") / 5).cast("bigint").alias("id"), F.pmod("vec_id", F.lit(5)).cast("int").alias("pos"), F.col("embedding").cast("array<double>").alias("vec"), F.pmod("label", F.lit(3)).alias("y"), part.alias("split"))
    last = B.last_of(rows, "id", "pos", "y").select("id", "y")
    return rows.drop("y").join(last, "id")


def _three_life(spark, sf, agg):
    out = multiclass.run(_three(spark, sf), ProbeSpec(), agg).predicted
    return out.select("id", "y", "p_0", "p_1", "p_2", "in_set", "prediction")


@query()
def mc_sil_life(spark, sf):
    return _three_life(spark, sf, "last")


@query()
def mc_mil_stacker(spark, sf):
    return _three_life(spark, sf, "all")
