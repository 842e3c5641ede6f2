"""Train, calibration and test splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probelake.functions.hashing import h
from probelake.operators.ranks import ranked
from probelake.session import written

#: Part of the object list that a round of the exclusive split keeps.
SHRINK = 0.975


def sizes(n: int) -> list[int]:
    """The lengths of the object list round by round, down to 0."""
    out = [n]
    while out[-1]:
        out.append(int(SHRINK * out[-1]))
    return out


def exclusive_split(df: DataFrame, test_size: float = 0.25, seed: int = 42, id_col: str = "row_id", first: str = "object_1", second: str = "object_2") -> DataFrame:
    """(id, is_test) of rows (id, first, second): a part of the object pairs is drawn and listed object by object; a row is test if neither of its objects is on the list, which shrinks at random until test rows are more than test_size.

    Successive random parts are prefixes of one random order, so the rounds are not run: entries are ranked once, a row
    has the least rank of its two objects, and the first round whose length leaves enough rows behind is looked up
    among at most a few hundred. Rows with a null or empty object take no part; a row's objects may still stand in
    test rows through other pairs. An empty table gives an empty result.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(first).alias("a"), F.col(second).alias("b")).where("a <> '' and b <> ''")
    pairs = rows.select("a", "b").distinct().withColumn("pair", F.concat_ws("|", "a", "b"))
    pairs = pairs.withColumn("h", h(seed, "pair"))
    pairs = written(ranked(pairs, ["h", "pair"], "r"), "pairs")
    kept = pairs.where(F.col("r") <= round((1 - test_size) * pairs.count()))
    entries = kept.select(F.explode(F.array(F.struct(F.col("a").alias("obj"), F.concat("pair", F.lit("#1")).alias("entry")), F.struct(F.col("b").alias("obj"), F.concat("pair", F.lit("#2")).alias("entry")))).alias("e")).select("e.*")
    entries = ranked(entries.withColumn("h", h(seed + 1, "entry")), ["h", "entry"], "r")
    best = written(entries.groupBy("obj").agg(F.min("r").alias("r"), F.count("*").alias("n")), "objects")
    n = best.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    to = rows.join(best.select(F.col("obj").alias("a"), F.col("r").alias("ra")), "a", "left").join(best.select(F.col("obj").alias("b"), F.col("r").alias("rb")), "b", "left")
    to = written(to.select("id", F.least("ra", "rb").alias("m")), "ranks")
    lengths = sizes(n)
    # how many rows each round leaves behind, from one histogram over the rounds' lengths
    table = df.sparkSession.createDataFrame([(k, x) for k, x in enumerate(lengths)], "k int, n bigint")
    hist = to.groupBy("m").agg(F.count("*").alias("rows"))
    left = hist.join(F.broadcast(table), F.col("m").isNull() | (F.col("m") > F.col("n"))).groupBy("k").agg(F.sum("rows").alias("rows"))
    counts = {r.k: r.rows for r in left.collect()}
    total = to.count()
    at = next((k for k in range(len(lengths)) if counts.get(k, 0) > test_size * total), len(lengths) - 1)
    return to.select(F.col("id").alias(id_col), (F.col("m").isNull() | (F.col("m") > lengths[at])).alias("is_test"))


def exclusive_split3(df: DataFrame, test_size: float = 0.25, cal_size: float = 0.25, seed: int = 42, id_col: str = "row_id", first: str = "object_1", second: str = "object_2") -> DataFrame:
    """(id, split): the exclusive split, then again over its train rows, whose cal_size becomes calibration."""
    cols = [id_col, first, second]
    outer = written(exclusive_split(df, test_size, seed, id_col, first, second), "split")
    rest = df.select(*cols).join(outer.where("not is_test").select(id_col), id_col)
    inner = exclusive_split(rest, cal_size, seed + 10, id_col, first, second)
    named = inner.select(id_col, F.when(F.col("is_test"), "calibration").otherwise("train").alias("split"))
    return outer.where("is_test").select(id_col, F.lit("test").alias("split")).unionByName(named)


def random_split(df: DataFrame, test_size: float = 0.25, cal_size: float = 0.25, seed: int = 42, id_col: str = "row_id") -> DataFrame:
    """df with split by the hash of its id: test_size of the rows, then cal_size of the others."""
    test = h(seed, id_col) >= (1 - test_size) * 2.0**32
    cal = h(seed + 1, id_col) >= (1 - cal_size) * 2.0**32
    return df.withColumn("split", F.when(test, "test").when(cal, "calibration").otherwise("train"))


def split_ratio(df: DataFrame, split_col: str = "split") -> DataFrame:
    """(split, n, ratio)."""
    counts = df.groupBy(split_col).agg(F.count("*").alias("n"))
    whole = counts.agg(F.sum("n").alias("whole"))
    return counts.crossJoin(F.broadcast(whole)).select(split_col, "n", (F.col("n") / F.col("whole")).alias("ratio"))


def shuffled(df: DataFrame, seed: int, id_col: str = "row_id", group: list[str] | None = None) -> DataFrame:
    """df with perm_rank, the row's place in a random order of its group."""
    return ranked(df.withColumn("__h", h(seed, id_col)), ["__h", id_col], "perm_rank", group).drop("__h")
