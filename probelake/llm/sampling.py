"""Samples that match target proportions of categories.

Every row gets a number in [0, 1) from its id and its set. Of a level that wants w of its n rows, rows below
(w + 4 sqrt(w) + 10) / n are drawn, each on its own; their counts by narrow ranges of that number then tell the range
in which the w-th row lies. Ranges below it are kept whole and only that one is ordered, so no level is ordered in one
task. A level the drawing left short is drawn again whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from probelake.functions.text import plain_form
from probelake.operators.ranks import hash_unit
from probelake.session import is_small, written

#: Rows of a range of the numbers, about; and the level that stands for everything else.
RANGE_ROWS, REST = 500, "*"


@dataclass(frozen=True)
class Sample:
    #: target_set, level_name, and the rows' ids.
    rows: DataFrame
    #: One row per level, see match_shares().
    report: DataFrame


def quotas(plan: DataFrame) -> DataFrame:
    """plan (target_set, level_name, target_share, min_rows, sample_size, available) with wanted and quota.

    wanted: the larger of min_rows and target_share * sample_size to the nearest integer. quota: how many rows the
    level is to give, adding up to sample_size in each set: shares in whole numbers by largest remainders, levels below
    their min_rows raised to it, as far as they have the rows, and as many taken from the others, in proportion to what
    they have above their minima. Where the minima alone exceed sample_size, the quotas are the minima.
    """
    per = Window.partitionBy("target_set")
    share, least = F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)), F.greatest(F.coalesce("min_rows", F.lit(0)), F.lit(0)).cast("bigint")
    rows = plan.withColumn("__share", share).withColumn("__min", least).withColumn("__least", F.least("__min", "available")).withColumn("__size", F.max(F.coalesce("sample_size", F.lit(0))).over(per).cast("bigint"))
    rows = rows.withColumn("wanted", F.greatest("__min", F.floor(F.coalesce(F.col("target_share") * F.col("sample_size"), F.lit(0)) + 0.5)))

    def dealt(df: DataFrame, amount: str, weight: str, out: str) -> DataFrame:
        total = F.sum(weight).over(per)
        df = df.withColumn("__exact", F.when(total > 0, F.col(amount) * F.col(weight) / total).otherwise(0.0))
        df = df.withColumn("__whole", F.floor(F.col("__exact") + 1e-9)).withColumn("__rest", F.col("__exact") - F.col("__whole"))
        left = F.when(total > 0, F.col(amount)).otherwise(0) - F.sum("__whole").over(per)
        place = F.row_number().over(per.orderBy(F.desc("__rest"), "level_name"))
        return df.withColumn(out, (F.col("__whole") + (place <= left).cast("int")).cast("bigint")).drop("__exact", "__whole", "__rest")

    rows = dealt(rows, "__size", "__share", "__even")
    rows = rows.withColumn("__raise", F.greatest(F.lit(0), F.col("__least") - F.col("__even"))).withColumn("__slack", F.greatest(F.lit(0), F.col("__even") - F.col("__least")).cast("double"))
    rows = rows.withColumn("__excess", F.least(F.sum("__raise").over(per).cast("double"), F.sum("__slack").over(per)))
    rows = dealt(rows, "__excess", "__slack", "__take")
    return rows.withColumn("quota", F.greatest("__even", "__least") - F.col("__take")).drop("__share", "__min", "__least", "__size", "__even", "__raise", "__slack", "__excess", "__take")


def match_shares(rows: DataFrame, targets: DataFrame, id_col: str = "id", seed: int = 11) -> Sample:
    """Samples of rows whose levels have the targets' shares.

    rows: id, pool, field, level (a key): one row for each id and field; a null level belongs to no target. targets:
    target_set, pool, field, level_name, level (null: everything else of the pool), target_share, min_rows, sample_size.
    A level is to give its quota, see quotas(); one that has fewer rows gives all of them, and report says so:
    target_set, level_name, wanted, quota, available, taken, deficit (quota - taken), actual_share (of the set's rows).
    Taken and deficits of a set add up to its sample_size; where wanted exceeds available, the level cannot be met. Null shares, minima and sizes count as 0. Ids repeat only if
    their rows do, and are drawn alike. Two levels of a set with one key share its rows. Empty tables give an empty
    sample; a set of an unknown pool is reported with nothing available.
    """
    plan = written(targets.select("target_set", "pool", "field", "level_name", "level", "target_share", "min_rows", "sample_size"), "targets")
    rows = written(rows.where("level is not null").select(id_col, "pool", "field", "level"), "rows")
    small = is_small(plan)
    hint = F.broadcast if small else lambda d: d
    named = plan.where("level is not null")
    sets = plan.where("level is null").select("target_set", "pool", "field", "level_name")

    def matched(df: DataFrame) -> DataFrame:
        """df's rows with the sets and levels that they belong to."""
        hit = df.join(hint(named.select("target_set", "pool", "field", "level", "level_name")), ["pool", "field", "level"])
        other = df.join(hint(sets), ["pool", "field"]).join(hint(named.select("target_set", "level").distinct()), ["target_set", "level"], "left_anti")
        return hit.unionByName(other.select(*hit.columns))

    # counts come from the levels' sizes: no row is matched before it is known how many are wanted
    sizes = written(rows.groupBy("pool", "field", "level").agg(F.count("*").alias("n")), "sizes")
    counts = matched(sizes).groupBy("target_set", "level_name").agg(F.sum("n").alias("available"))
    levels = plan.select("target_set", "level_name", "target_share", "min_rows", "sample_size").join(counts, ["target_set", "level_name"], "left").na.fill(0, ["available"])
    levels = quotas(levels).select("target_set", "level_name", "wanted", "quota", "available")
    levels = levels.withColumn("due", F.least("quota", "available")).withColumn(
        "accept", F.least(F.lit(1.0), (F.col("due") + 4 * F.sqrt("due") + 10) / F.greatest("available", F.lit(1)))
    )
    levels = written(levels, "levels")
    cols = ["target_set", "level_name", id_col]

    def drawn(levels: DataFrame) -> DataFrame:
        u = hash_unit(F.col(id_col), F.col("target_set"), seed)
        got = matched(rows).select(*cols).withColumn("u", u).join(hint(levels.where("due > 0")), ["target_set", "level_name"]).where("u < accept")
        got = written(got, "drawn")
        return got.withColumn("range", F.floor(F.col("u") * F.ceil(F.col("available") / RANGE_ROWS)).cast("bigint"))

    sample = drawn(levels)
    ranges = sample.groupBy("target_set", "level_name", "range").agg(F.count("*").alias("n"))
    short = ranges.groupBy("target_set", "level_name").agg(F.sum("n").alias("got")).join(levels, ["target_set", "level_name"]).where("got < due")
    if not short.isEmpty():
        levels = levels.join(short.select("target_set", "level_name", F.lit(1.0).alias("all")), ["target_set", "level_name"], "left")
        levels = written(levels.withColumn("accept", F.coalesce("all", "accept")).drop("all"), "levels")
        sample = drawn(levels)
        ranges = sample.groupBy("target_set", "level_name", "range").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("target_set", "level_name").orderBy("range"))
    edges = ranges.withColumn("before", upto - F.col("n"))
    sample = sample.join(edges, ["target_set", "level_name", "range"]).where("before < due")
    inside = F.row_number().over(Window.partitionBy("target_set", "level_name", "range").orderBy("u", id_col))
    edge = F.col("before") + F.col("n") > F.col("due")
    kept = sample.where(~edge).select(*cols).unionByName(sample.where(edge).withColumn("at", inside).where(F.col("before") + F.col("at") <= F.col("due")).select(*cols))
    kept = written(kept, "sample")

    taken = kept.groupBy("target_set", "level_name").agg(F.count("*").alias("taken"))
    report = levels.join(hint(taken), ["target_set", "level_name"], "left").na.fill(0, ["taken"])
    size = F.sum("taken").over(Window.partitionBy("target_set"))
    report = report.select(
        "target_set", "level_name", "wanted", "quota", "available", "taken", (F.col("quota") - F.col("taken")).alias("deficit"),
        F.when(size > 0, F.col("taken") / size).otherwise(0.0).alias("actual_share"),
    )
    return Sample(kept, report)


def sample_checks(sample: Sample, targets: DataFrame) -> DataFrame:
    """(target_set, level_name, once, exact, whole): for each level whether no id is drawn twice, whether as many rows are taken as its quota and its rows allow, and whether taken and deficits of its set add up to the larger of sample_size and the minima that can be met."""
    drawn = sample.rows.groupBy("target_set", "level_name").agg(F.count("*").alias("n"), F.countDistinct(*[c for c in sample.rows.columns if c not in ("target_set", "level_name")]).alias("ids"))
    sizes = targets.groupBy("target_set").agg(F.max(F.coalesce("sample_size", F.lit(0))).alias("size"))
    minima = targets.select("target_set", "level_name", F.coalesce("min_rows", F.lit(0)).alias("least"))
    per = Window.partitionBy("target_set")
    rows = sample.report.join(drawn, ["target_set", "level_name"], "left").join(sizes, "target_set").join(minima, ["target_set", "level_name"]).na.fill(0, ["n", "ids"])
    whole = F.sum(F.col("taken") + F.col("deficit")).over(per) == F.greatest(F.col("size"), F.sum(F.least("least", "available")).over(per))
    return rows.select("target_set", "level_name", (F.col("n") == F.col("ids")).alias("once"), ((F.col("taken") == F.col("n")) & (F.col("taken") == F.least("quota", "available"))).alias("exact"), whole.alias("whole"))


def statement_sample(statements: DataFrame, targets: DataFrame) -> Sample:
    """The samples of statements that sample_targets asks for: by correct (true or false) and by object_1 (its plain form; null or empty belongs to no level), each row_id once."""
    once = statements.where("row_id is not null").groupBy("row_id").agg(F.min_by(F.struct("dataset", "correct", "object_1"), F.struct("ingested_at", "dataset", "object_1")).alias("r"))
    once = once.select("row_id", "r.*").select("row_id", "dataset", "correct", plain_form("object_1").alias("entity"))
    by = F.array(F.struct(F.lit("correct").alias("field"), F.col("correct").cast("string").alias("level")), F.struct(F.lit("object_1").alias("field"), F.when(F.col("entity") != "", F.col("entity")).alias("level")))
    rows = once.select(F.col("row_id").alias("id"), F.col("dataset").alias("pool"), F.explode(by).alias("b")).select("id", "pool", "b.field", "b.level").where("level is not null")
    key = F.when(F.col("target_field") == "correct", F.lower("level_name")).otherwise(plain_form("level_name"))
    plan = targets.select("target_set", F.col("dataset").alias("pool"), F.col("target_field").alias("field"), "level_name", F.when(F.col("level_name") != REST, key).alias("level"), "target_share", "min_rows", "sample_size")
    return match_shares(rows, plan)
