"""Queries of the operators for training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from probelake.llm import linking, mixing, neighbours, overlap, reading, sampling, tokens
from probelake.session import written
from probelake.sources.tables import table


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, sf_dir, "documents"))


def _mix(spark: SparkSession, sf_dir: str) -> mixing.Mix:
    weights = table(spark, sf_dir, "source_weights")
    return mixing.mix(mixing.token_counts(table(spark, sf_dir, "documents"), weights), weights)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir).report.where("short").select("source")


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir).report


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir).uses


def p7_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_checks(_mix(spark, sf_dir), table(spark, sf_dir, "source_weights"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.similar_pairs(neighbours.nearest(table(spark, sf_dir, "activations")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = sampling.statement_sample(table(spark, sf_dir, "statements"), table(spark, sf_dir, "sample_targets")).report
    return report.where(f"wanted > available and level_name <> '{sampling.REST}'").select("target_set", "level_name")


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.statement_sample(table(spark, sf_dir, "statements"), table(spark, sf_dir, "sample_targets")).report


def p2_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.statement_sample(table(spark, sf_dir, "statements"), table(spark, sf_dir, "sample_targets")).rows


def p2_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "sample_targets")
    return sampling.sample_checks(sampling.statement_sample(table(spark, sf_dir, "statements"), targets), targets)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.shared_groups(linking.statement_groups(table(spark, sf_dir, "statements")))


def p3_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.statement_splits(table(spark, sf_dir, "statements"), table(spark, sf_dir, "split_plan"))


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    statements, plan = table(spark, sf_dir, "statements"), table(spark, sf_dir, "split_plan")
    return linking.split_deviation(written(linking.statement_splits(statements, plan), "splits"), linking.statement_labels(statements), plan)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.overlap_pairs(overlap.statement_overlaps(table(spark, sf_dir, "statements")))


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.overlap_report(overlap.statement_overlaps(table(spark, sf_dir, "statements")))


def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.overlap_classes(table(spark, sf_dir, "statements"))[0]


def p4_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.overlap_classes(table(spark, sf_dir, "statements"))[1]


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.commit_bands(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_anchors"))


def p8_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_anchors"))


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rounds, residue, words): how the levels came to rest."""
    r = reading.read(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_anchors"))
    return spark.createDataFrame([(r.rounds, r.residue, r.words)], "rounds int, residue double, words bigint")


QUERIES = {
    "p8_found": p8_found,
    "p8_levels": p8_levels,
    "p8_report": p8_report,
    "p4_found": p4_found,
    "p4_report": p4_report,
    "p4_classes": p4_classes,
    "p4_links": p4_links,
    "p2_found": p2_found,
    "p2_report": p2_report,
    "p2_sample": p2_sample,
    "p2_check": p2_check,
    "p3_found": p3_found,
    "p3_splits": p3_splits,
    "p3_report": p3_report,
    "p5_found": p5_found,
    "p6_ids": p6_ids,
    "p7_found": p7_found,
    "p7_report": p7_report,
    "p7_mix": p7_mix,
    "p7_check": p7_check,
}
_WIDE = "".join(chr(0xFF00 + i) for i in range(0x10, 0x5B) if chr(0x20 + i).isalnum())
_NARROW = "".join(chr(0x20 + i) for i in range(0x10, 0x5B) if chr(0x20 + i).isalnum())


def _plain_sql(x: str) -> str:
    """The plain form in SQL, for texts in Latin letters."""
    return f"regexp_replace(lower(strip_accents(translate({x}, '{_WIDE}', '{_NARROW}'))), '[^a-z0-9]', '', 'g')"


SQL: dict[str, str] = {
    "p2_check": "SELECT target_set, level_name, true AS once, true AS exact, true AS whole FROM sample_targets",
    "p7_check": "SELECT source, true AS capped, true AS once, true AS filled FROM source_weights",
    "p2_found": f"""
        WITH once AS (SELECT dataset, CAST(correct AS VARCHAR) AS truth, {_plain_sql('object_1')} AS entity FROM statements QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY ingested_at) = 1),
        have AS (SELECT dataset, 'correct' AS field, truth AS level, count(*) AS n FROM once GROUP BY dataset, truth UNION ALL SELECT dataset, 'object_1', entity, count(*) FROM once WHERE entity <> '' GROUP BY dataset, entity),
        want AS (SELECT *, greatest(min_rows, floor(target_share * sample_size + 0.5)) AS wanted, CASE WHEN target_field = 'correct' THEN lower(level_name) ELSE {_plain_sql('level_name')} END AS level FROM sample_targets WHERE level_name <> '*')
        SELECT target_set, level_name FROM want w LEFT JOIN have h ON h.dataset = w.dataset AND h.field = w.target_field AND h.level = w.level WHERE wanted > coalesce(n, 0)""",
    "p5_found": """
        WITH v AS (SELECT vec_id, any_value(layer) AS layer, any_value([x::DOUBLE FOR x IN embeddings]) AS e FROM activations
            WHERE embeddings IS NOT NULL AND len(embeddings) = 64 AND len([x FOR x IN embeddings IF isnan(x)]) = 0 AND len([x FOR x IN embeddings IF x <> 0]) > 0 GROUP BY vec_id),
        s AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.e, b.e) AS sim FROM v a JOIN v b ON a.layer = b.layer AND a.vec_id <> b.vec_id),
        k AS (SELECT a, b, sim FROM s QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(sim, 12) DESC, b) <= 5)
        SELECT DISTINCT least(a, b) AS vec_id_a, greatest(a, b) AS vec_id_b FROM k WHERE sim >= 0.9""",
}
