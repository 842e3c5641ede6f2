"""The views that queries start from, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probelake.sources.tables import latest, table

_COLS = ["dataset", "statement", "object_1", "object_2", "correct_object_2", "correct", "negation", "real_object", "category", "max_population", "freq_1", "freq_2", "split"]


def stmt(spark: SparkSession, sf: str, columns: list[str] | None = None) -> DataFrame:
    """Statements, each row_id once, flags as int."""
    cols = columns or _COLS
    once = latest(table(spark, sf, "statements"), "row_id", cols)
    return once.select("row_id", *[F.col(c).cast("int").alias(c) if c in ("correct", "negation", "real_object") else F.col(c) for c in cols])


STMT = (
    "stmt AS (SELECT row_id, dataset, statement, object_1, object_2, correct_object_2, CAST(correct AS INT) AS correct, CAST(negation AS INT) AS negation, "
    "CAST(real_object AS INT) AS real_object, category, max_population, freq_1, freq_2, split FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY ingested_at) AS rn FROM statements) WHERE rn = 1)"
)


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Usable activation vectors, each vec_id once: vec_id, row_id, layer, token_pos, attn, vec."""
    v = F.col("embeddings")
    raw = table(spark, sf, "activations").where(v.isNotNull() & (F.size(v) == 64)).where(~F.exists(v, F.isnan) & F.exists(v, lambda x: x != 0))
    once = raw.groupBy("vec_id").agg(F.first(F.struct("row_id", "layer", "token_pos", "attn", "embeddings")).alias("r")).select("vec_id", "r.*")
    return once.select("vec_id", "row_id", "layer", "token_pos", "attn", F.col("embeddings").cast("array<double>").alias("vec"))


VECTORS = (
    "vectors AS (SELECT vec_id, any_value(row_id) AS row_id, any_value(layer) AS layer, any_value(token_pos) AS token_pos, any_value(attn) AS attn, any_value([x::DOUBLE FOR x IN embeddings]) AS vec "
    "FROM activations WHERE embeddings IS NOT NULL AND len(embeddings) = 64 AND len([x FOR x IN embeddings IF isnan(x)]) = 0 AND len([x FOR x IN embeddings IF x <> 0]) > 0 GROUP BY vec_id)"
)


def act(spark: SparkSession, sf: str) -> DataFrame:
    """Usable vectors of real statements with their truth: vec_id, row_id, layer, vec, y, split."""
    s = stmt(spark, sf, ["correct", "real_object", "split"]).where("real_object = 1 and correct is not null").select("row_id", F.col("correct").alias("y"), "split")
    return vectors(spark, sf).join(s, "row_id").select("vec_id", "row_id", "layer", "vec", "y", "split")


ACT = f"{STMT}, {VECTORS}, act AS (SELECT v.vec_id, v.row_id, v.layer, v.vec, s.correct AS y, s.split FROM vectors v JOIN stmt s ON v.row_id = s.row_id WHERE s.real_object = 1 AND s.correct IS NOT NULL)"
LONG = "long AS (SELECT vec_id, layer, y, split, unnest(range(64)) AS dim, unnest(vec) AS x FROM act)"

#: The mean-difference probe of each layer in SQL: mu, sd, direction, bias, and the scores of calibration and test rows.
PROBE = (
    f"{ACT}, {LONG}, st AS (SELECT layer, dim, avg(x) AS mu, stddev_pop(x) AS sd0, avg(x) FILTER (y = 1) AS m1, avg(x) FILTER (y = 0) AS m0 FROM long WHERE split = 'train' GROUP BY layer, dim), "
    "st2 AS (SELECT *, CASE WHEN sd0 > 1e-7 THEN sd0 ELSE 1.0::DOUBLE END AS sd FROM st), raw AS (SELECT layer, dim, mu, sd, (m1 - m0) / sd AS w, (m1 + m0 - 2 * mu) / sd AS c FROM st2), "
    "nrm AS (SELECT layer, sqrt(sum(w * w)) AS n FROM raw GROUP BY layer), probe AS (SELECT r.layer, dim, mu, sd, w / n AS w, c FROM raw r JOIN nrm USING (layer)), "
    "bias AS (SELECT layer, -0.5::DOUBLE * sum(w * c) AS b FROM probe GROUP BY layer), "
    "scored AS (SELECT l.vec_id AS id, l.layer, any_value(l.y) AS y, any_value(l.split) AS split, sum((l.x - p.mu) / p.sd * p.w) + any_value(bias.b) AS score FROM long l JOIN probe p ON l.layer = p.layer AND l.dim = p.dim JOIN bias ON bias.layer = l.layer "
    "WHERE l.split <> 'train' GROUP BY l.vec_id, l.layer)"
)


def bags(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as bags of five vectors: bag, pos, vec, y (of the bag), attn (0 for pos 0 of every other bag)."""
    e = table(spark, sf, "embeddings")
    rows = e.select(F.floor(F.col("vec_id") / 5).cast("bigint").alias("bag"), F.pmod("vec_id", F.lit(5)).cast("int").alias("pos"), F.col("embedding").cast("array<double>").alias("vec"), (F.col("label") < 2).cast("int").alias("one"))
    y = rows.groupBy("bag").agg(F.max("one").alias("y"))
    attn = F.when((F.col("pos") == 0) & (F.pmod("bag", F.lit(2)) == 0), 0).otherwise(1)
    return rows.join(y, "bag").select("bag", "pos", "vec", "y", attn.alias("attn"))


BAGS = (
    "bags AS (SELECT vec_id // 5 AS bag, CAST(vec_id % 5 AS INT) AS pos, [x::DOUBLE FOR x IN embedding] AS vec, CAST(max(CASE WHEN label < 2 THEN 1 ELSE 0 END) OVER (PARTITION BY vec_id // 5) AS INT) AS y, "
    "CASE WHEN vec_id % 5 = 0 AND (vec_id // 5) % 2 = 0 THEN 0 ELSE 1 END AS attn FROM embeddings)"
)
