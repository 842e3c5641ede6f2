"""Splits that keep related records together.

Records and the keys they name are a bipartite graph. A key is known by the smallest id of its records, so labels are
ids from the start. Keys of the second kind that name a single key of the first kind are leaves; they wait aside. Over
the others the smallest label spreads along the links, iteration by iteration, each followed by a step to the label's
own label, until nothing changes. Groups then go to splits whole: the few large ones first, each where the labels'
counts deviate least from the plan, and moved once more while that lowers the deviation; the others in one order of
strata and hash, cut where the running sums reach what each stratum's label still wants of each split.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probelake.functions.text import plain_form
from probelake.operators.ranks import hash_unit, running_sum
from probelake.session import is_small, written

#: A group of more than this part of all rows is placed on its own; there are at most 1 / LARGE of them. Labels of fewer rows than this part count together where large groups are placed.
LARGE = 0.001
#: Splits that a plan may have: its rows go to the driver.
MAX_SPLITS = 10_000
#: Groups that are ordered together.
BUCKET_GROUPS = 4096


def spread_labels(edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """(node, label): the smallest node of each node's component. edges: (a, b), of any direction, without nulls.

    Minimum-label propagation with a jump to the label's label each round, so the rounds grow with the logarithm of a
    component's diameter. Each round is written to the shared folder.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    for _ in range(most_rounds):
        heard = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("heard"))
        lower = labels.join(heard, "node").select("node", F.least("label", "heard").alias("label"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        after = lower.join(jump, "label", "left").select("node", F.least("label", F.coalesce("next", "label")).alias("label"), "old")
        after = written(after, "labels")
        labels = after.select("node", "label")
        if after.where("label <> old").isEmpty():
            return labels
    raise RuntimeError(f"labels still changed after {most_rounds} rounds")


def linked_groups(rows: DataFrame, id_col: str = "row_id", first: str = "first", second: str = "second") -> DataFrame:
    """(id, group_id) of every row of rows (id, first key, second key); group_id is the group's smallest id.

    Two rows belong together if their first or their second keys are equal, and so on through further rows. Null and
    empty keys match nothing; a row without keys is a group of its own. Each id is to come once, ids are not null.
    """
    key = lambda c: F.when(F.col(c) != "", F.col(c))
    base = written(rows.select(F.col(id_col).alias("id"), key(first).alias("k1"), key(second).alias("k2")), "records")
    pairs = base.groupBy("k1", "k2").agg(F.min("id").alias("low"))  # hot keys shrink to their distinct pairs before any join
    pairs = written(pairs, "pairs")
    names = written(pairs.where("k1 is not null").groupBy("k1").agg(F.min("low").alias("n1")), "names")
    seconds = pairs.where("k2 is not null").join(names, "k1", "left").groupBy("k2").agg(F.min("n1").alias("lo"), F.max("n1").alias("hi"), F.min("low").alias("low"))
    seconds = written(seconds, "seconds")
    linking = seconds.where("lo < hi").select("k2", "lo")
    edges = pairs.where("k1 is not null").join(linking, "k2").join(names, "k1").where("n1 <> lo").select(F.col("n1").alias("a"), F.col("lo").alias("b"))
    labels = spread_labels(edges)
    of_first = names.join(labels.withColumnRenamed("node", "n1"), "n1", "left").select("k1", F.coalesce("label", "n1").alias("of_first"))
    of_second = seconds.join(labels.withColumnRenamed("node", "lo"), "lo", "left").select("k2", F.coalesce("label", "lo", "low").alias("of_second"))
    # a row with a first key follows it; another follows its second key; the key pairs carry the label to the rows
    to = pairs.join(of_first, "k1", "left").join(of_second, "k2", "left").select("k1", "k2", F.coalesce("of_first", "of_second").alias("label"), "low")
    least = to.where("label is not null").groupBy("label").agg(F.min("low").alias("group_id"))
    to = to.join(least, "label").select("k1", "k2", "group_id")
    with_key = base.where("k1 is not null or k2 is not null")
    joined = with_key.alias("b").join(to.alias("t"), F.col("b.k1").eqNullSafe(F.col("t.k1")) & F.col("b.k2").eqNullSafe(F.col("t.k2"))).select("id", "group_id")
    return joined.unionByName(base.where("k1 is null and k2 is null").select("id", F.col("id").alias("group_id"))).withColumnRenamed("id", id_col)


def statement_groups(statements: DataFrame) -> DataFrame:
    """(row_id, group_id) of statements by the plain forms of object_1 and statement; each row_id counts once, rows of a null row_id do not count."""
    once = statements.where("row_id is not null").groupBy("row_id").agg(F.min_by(F.struct("object_1", "statement"), F.struct("ingested_at", "object_1", "statement")).alias("r"))
    return linked_groups(once.select("row_id", plain_form(F.col("r.object_1")).alias("first"), plain_form(F.col("r.statement")).alias("second")))


def shared_groups(groups: DataFrame) -> DataFrame:
    """(group_id, row_id) of the groups of at least two rows."""
    many = groups.groupBy("group_id").agg(F.count("*").alias("n")).where("n > 1")
    return groups.join(many, "group_id").select("group_id", "row_id")


def place_groups(counts: np.ndarray, totals: np.ndarray, shares: np.ndarray, passes: int = 20) -> np.ndarray:
    """The split of each group. counts: groups x labels, in the order of placing; totals: rows of each label in all; shares: of the splits, adding up to 1.

    A group goes where the summed deviation grows least: (rows there - rows wanted)^2 / rows wanted over its labels and
    over all rows. Then groups move to other splits while that lowers the sum.
    """
    counts = np.concatenate([counts, counts.sum(1, keepdims=True)], 1).astype(float)
    want = np.maximum(np.outer(shares, np.append(totals, totals.sum())), 1e-9)
    there = np.zeros_like(want)
    to = np.zeros(len(counts), int)
    gain = lambda n: (n * (2 * (there - want) + n) / want).sum(1)
    for g, n in enumerate(counts):
        to[g] = int(gain(n).argmin())
        there[to[g]] += n
    for _ in range(passes):
        moved = False
        for g, n in enumerate(counts):
            there[to[g]] -= n
            costs = gain(n)
            best = int(costs.argmin())
            if costs[best] < costs[to[g]] - 1e-9:
                to[g], moved = best, True
            there[to[g]] += n
        if not moved:
            break
    return to


def split_groups(groups: DataFrame, labels: DataFrame, plan: DataFrame, id_col: str = "row_id", seed: int = 29) -> DataFrame:
    """(id, group_id, split): whole groups in splits of the plan's shares, labels spread alike.

    groups: (id, group_id); labels: (id, label), one row an id at most, an id without one has a null label, which
    counts as a label; plan: (split, target_share), shares above 0, at most MAX_SPLITS. Groups larger than LARGE of all
    rows go first, see place_groups(); the others, whose stratum is their commonest label, follow within each stratum by
    hash, cut where the running sums reach what the label still wants of each split after the large groups. An empty
    table gives an empty result; a plan without a share above 0, or with too many splits, raises an error.
    """
    shares = [(r.split, float(r.target_share)) for r in plan.where("target_share > 0").orderBy("split").limit(MAX_SPLITS + 1).collect()]
    if not shares:
        raise ValueError("the plan has no share above 0")
    if len(shares) > MAX_SPLITS:
        raise ValueError(f"the plan has more than {MAX_SPLITS} splits")
    tagged = groups.join(labels.select(F.col(id_col), F.col("label").cast("string").alias("label")), id_col, "left")
    per_label = written(tagged.groupBy("group_id", "label").agg(F.count("*").alias("n")), "labelled")
    sized = per_label.groupBy("group_id").agg(F.sum("n").alias("rows"), F.max_by("label", F.struct("n", "label")).alias("stratum"))
    sized = written(sized, "groups")
    total = sized.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.count("*").alias("groups")).first()
    whole = sum(s for _, s in shares)
    names = [name for name, _ in shares]
    spark = groups.sparkSession
    big = F.col("rows") > LARGE * total.rows

    # large groups, at most 1 / LARGE, by their counts of the labels that have that part of the rows, at most 1 / LARGE, and of all others together
    of_label = written(per_label.groupBy("label").agg(F.sum("n").alias("rows")), "labels")
    common = of_label.where(F.col("rows") >= LARGE * total.rows).orderBy("label").collect()
    place = {r.label: i for i, r in enumerate(common)}
    totals = np.array([*(r.rows for r in common), total.rows - sum(r.rows for r in common)], float)
    order = [r.group_id for r in sized.where(big).orderBy(F.desc("rows"), "group_id").select("group_id").collect()]
    row = {g: i for i, g in enumerate(order)}
    counts = np.zeros((len(order), len(totals)))
    frequent = of_label.where(F.col("rows") >= LARGE * total.rows).select(F.col("label").alias("l"))
    mine = per_label.join(F.broadcast(sized.where(big).select("group_id")), "group_id")
    known = mine.join(F.broadcast(frequent), F.col("label").eqNullSafe(F.col("l")), "left").groupBy("group_id", F.when(F.col("l").isNotNull() | F.col("label").isNull(), F.col("label")).otherwise("").alias("label")).agg(F.sum("n").alias("n"))
    for r in known.collect() if order else ():
        counts[row[r.group_id], place.get(r.label, len(totals) - 1)] += r.n
    to = place_groups(counts, totals, np.array([s / whole for _, s in shares]))
    large = spark.createDataFrame([(g, names[to[i]]) for g, i in row.items()], f"group_id {groups.schema['group_id'].dataType.simpleString()}, split string")

    small = sized.where(~big)
    small = small.withColumn("u", hash_unit(F.col("group_id"), seed))
    small = small.withColumn("bucket", F.floor(F.col("u") * max(1, -(-total.groups // BUCKET_GROUPS))).cast("int"))
    small = running_sum(small, ["stratum"], "bucket", ["u", "group_id"], "rows", "before")

    # what each label still wants of each split, after the large groups: of its own rows, whatever group they are in
    plan_rows = spark.createDataFrame([(i, name, share / whole) for i, (name, share) in enumerate(shares)], "place int, split string, share double")
    taken = per_label.join(F.broadcast(large), "group_id").groupBy(F.col("label").alias("t"), "split").agg(F.sum("n").alias("there"))
    wants = of_label.crossJoin(F.broadcast(plan_rows)).join(taken, [F.col("label").eqNullSafe(F.col("t")), plan_rows["split"] == taken["split"]], "left")
    wants = wants.select("label", "place", F.greatest(F.lit(0.0), F.col("rows") * F.col("share") - F.coalesce("there", F.lit(0))).alias("want"))
    wants = wants.withColumn("upto", F.sum("want").over(Window.partitionBy("label").orderBy("place")))
    strata = wants.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "upto"))), lambda x: x["upto"]).alias("ends"))  # as many as the plan has splits
    placed = sized.where(~big).groupBy("stratum").agg(F.sum("rows").alias("all")).withColumnRenamed("stratum", "s")
    strata = written(placed.join(strata, F.col("s").eqNullSafe(F.col("label"))).select("s", "all", "ends"), "strata")
    small = small.join(F.broadcast(strata) if is_small(strata) else strata, F.col("stratum").eqNullSafe(F.col("s")))
    at = (F.col("before") + F.col("rows") / 2) / F.col("all") * F.element_at("ends", -1)
    small = small.withColumn("at", at).withColumn("place", F.least(F.size(F.filter("ends", lambda e: e <= F.col("at"))), F.lit(len(names) - 1)))
    small = small.join(F.broadcast(plan_rows.select("place", "split")), "place")
    both = small.select("group_id", "split").unionByName(large.select("group_id", "split"))
    return groups.join(both, "group_id").select(id_col, "group_id", "split")


def split_deviation(assigned: DataFrame, labels: DataFrame, plan: DataFrame, id_col: str = "row_id") -> DataFrame:
    """(split, label, rows, share, target_share, deviation): of each label's rows the part that each split of the plan got, and how far that is from the plan; label "*" stands for all rows."""
    whole = F.sum("target_share").over(Window.partitionBy())
    shares = plan.where("target_share > 0").select("split", (F.col("target_share") / whole).alias("target_share"))  # a row a split
    tagged = assigned.join(labels.select(id_col, F.col("label").cast("string").alias("label")), id_col, "left").groupBy("split", "label").agg(F.count("*").alias("n"))
    counts = written(tagged.unionByName(tagged.groupBy("split").agg(F.sum("n").alias("n")).withColumn("label", F.lit("*"))), "counts")
    sizes = counts.groupBy("label").agg(F.sum("n").alias("of")).withColumnRenamed("label", "l")
    every = sizes.crossJoin(F.broadcast(shares))
    got = every.join(counts, (every["split"] == counts["split"]) & every["l"].eqNullSafe(counts["label"]), "left")
    share = F.coalesce("n", F.lit(0)) / F.col("of")
    return got.select(every["split"], F.col("l").alias("label"), F.coalesce("n", F.lit(0)).alias("rows"), share.alias("share"), "target_share", (share - F.col("target_share")).alias("deviation"))


def statement_label(correct: Column, real: Column) -> Column:
    """true, false or neither; null where correct is null on a real object."""
    return F.when(~real, "neither").when(correct, "true").when(~correct, "false")


def statement_labels(statements: DataFrame) -> DataFrame:
    """(row_id, label): dataset and truth of each row_id."""
    return statements.where("row_id is not null").groupBy("row_id").agg(F.min(F.concat_ws("|", "dataset", statement_label(F.col("correct"), F.col("real_object")))).alias("label"))


def statement_splits(statements: DataFrame, plan: DataFrame) -> DataFrame:
    """(row_id, group_id, split) of statements by statement_groups, stratified by dataset and truth."""
    return split_groups(written(statement_groups(statements), "linked"), written(statement_labels(statements), "truths"), plan)
