"""Metrics of predictions and scores, and their bootstrap intervals. Rows with a null label or prediction do not count."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probelake.functions.hashing import h
from probelake.operators.ranks import by_range, following, running_sum
from probelake.session import written

#: What a metric is given as where it cannot be computed: value, lower and upper bound.
FALLBACK = (0.0, -1e-6, 1e-6)


def confusion(y: Column, p: Column, times: str | None = None) -> list[Column]:
    """tp, tn, fp, fn as aggregates; times: a column that says how often a row counts."""
    hit = lambda a, b: F.sum(((y == a) & (p == b)).cast("double") * (F.col(times) if times else 1))
    return [hit(1, 1).alias("tp"), hit(0, 0).alias("tn"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn")]


def mcc_of(tp: Column, tn: Column, fp: Column, fn: Column) -> Column:
    """Matthews correlation of the four counts, 0 where a margin is empty."""
    d = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return F.when(d == 0, 0.0).otherwise((tp * tn - fp * fn) / d)


def binary(df: DataFrame, y: str, p: str, group: list[str] | None = None, times: str | None = None) -> DataFrame:
    """(group, n, mcc, recall, precision, accuracy) of 0/1 labels and predictions; times: a column that says how often a row counts."""
    rows = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    counts = (rows.groupBy(*group) if group else rows.groupBy()).agg((F.sum(times) if times else F.count("*")).alias("n"), *confusion(F.col(y), F.col(p), times))
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    rate = lambda a, b: F.when(a + b == 0, 0.0).otherwise(a / (a + b))
    return counts.select(*(group or []), "n", mcc_of(tp, tn, fp, fn).alias("mcc"), rate(tp, fn).alias("recall"), rate(tp, fp).alias("precision"), rate(tp + tn, fp + fn).alias("accuracy"))


def contingency(df: DataFrame, a: str, b: str, group: list[str] | None = None, times: str | None = None) -> DataFrame:
    """(group, a, b, n): the pairs of labels, as many as there are classes squared; times: a column that says how often a row counts."""
    counted = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*(group or []), F.col(a).alias("a"), F.col(b).alias("b"))
    return counted.agg((F.sum(times) if times else F.count("*")).alias("n")).where("n > 0")


def _marginals(table: DataFrame, group: list[str]) -> DataFrame:
    return table.withColumns({"na": F.sum("n").over(Window.partitionBy(*group, "a")), "nb": F.sum("n").over(Window.partitionBy(*group, "b")), "ra": F.row_number().over(Window.partitionBy(*group, "a").orderBy("b")), "rb": F.row_number().over(Window.partitionBy(*group, "b").orderBy("a"))})


def multiclass_mcc(df: DataFrame, y: str, p: str, group: list[str] | None = None, times: str | None = None) -> DataFrame:
    """(group, mcc) of any number of classes."""
    group = group or []
    m = _marginals(contingency(df, y, p, group, times), group)
    # marginal products need each class's two marginals; classes of one side only add nothing to the cross term
    per_a = m.where("ra = 1").select(*group, F.col("a").alias("c"), F.col("na").alias("t"), F.lit(0).alias("u"))
    per_b = m.where("rb = 1").select(*group, F.col("b").alias("c"), F.lit(0).alias("t"), F.col("nb").alias("u"))
    cls = per_a.unionByName(per_b).groupBy(*group, "c").agg(F.sum("t").alias("t"), F.sum("u").alias("u"))
    sums = cls.groupBy(*group).agg(F.sum(F.col("t") * F.col("u")).cast("double").alias("tu"), F.sum(F.col("t") * F.col("t")).cast("double").alias("tt"), F.sum(F.col("u") * F.col("u")).cast("double").alias("uu"))
    hits = m.groupBy(*group).agg(F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).cast("double").alias("c"), F.sum("n").cast("double").alias("s"))
    both = sums.join(hits, group) if group else sums.crossJoin(hits)
    d = F.sqrt((F.col("s") * F.col("s") - F.col("tt")) * (F.col("s") * F.col("s") - F.col("uu")))
    return both.select(*group, F.when(d == 0, 0.0).otherwise((F.col("c") * F.col("s") - F.col("tu")) / d).alias("mcc"))


def adjusted_rand(df: DataFrame, a: str, b: str, group: list[str] | None = None, times: str | None = None) -> DataFrame:
    """(group, ari)."""
    group = group or []
    m = _marginals(contingency(df, a, b, group, times), group)
    pairs = lambda c: F.col(c).cast("double") * (F.col(c) - 1) / 2
    s = m.groupBy(*group).agg(F.sum(pairs("n")).alias("both"), F.sum(F.when(F.col("ra") == 1, pairs("na"))).alias("pa"), F.sum(F.when(F.col("rb") == 1, pairs("nb"))).alias("pb"), F.sum("n").cast("double").alias("n"))
    expected = F.when(F.col("n") < 2, 0.0).otherwise(F.col("pa") * F.col("pb") / F.greatest(F.lit(1.0), pairs("n")))
    top = (F.col("pa") + F.col("pb")) / 2 - expected
    return s.select(*group, F.when(top == 0, 1.0).otherwise((F.col("both") - expected) / top).alias("ari"))


def _expected_term(a: int, b: int, total: int) -> float:
    """The part of the expected mutual information that a class of a and one of b of total rows have: over the values of their common rows that carry any weight, some forty deviations around the mean."""
    low, high = max(1, a + b - total), min(a, b)
    mean = a * b / total
    wide = 40 * math.sqrt(mean * (1 - a / total) * (1 - b / total) * total / max(1, total - 1)) + 60
    low, high = max(low, math.floor(mean - wide)), min(high, math.ceil(mean + wide))
    if high < low:
        return 0.0
    lg = math.lgamma
    first = lg(a + 1) + lg(b + 1) + lg(total - a + 1) + lg(total - b + 1) - lg(total + 1) - lg(low + 1) - lg(a - low + 1) - lg(b - low + 1) - lg(total - a - b + low + 1)
    n = np.arange(low, high + 1, dtype=float)
    step = np.log((a - n[:-1]) * (b - n[:-1])) - np.log((n[:-1] + 1) * (total - a - b + n[:-1] + 1))
    weight = np.exp(first + np.concatenate([[0.0], step.cumsum()]))
    return float((n / total * np.log(total * n / (a * b)) * weight).sum())


def ami_of(table: list[tuple[object, object, int]]) -> float:
    """Adjusted mutual information of a contingency table, arithmetic normalisation."""
    rows: dict[object, int] = {}
    cols: dict[object, int] = {}
    for a, b, n in table:
        rows[a] = rows.get(a, 0) + n
        cols[b] = cols.get(b, 0) + n
    total = sum(rows.values())
    if len(rows) == len(cols) == 1 or not total:
        return 1.0
    entropy = lambda m: -sum(n / total * math.log(n / total) for n in m.values())
    mutual = sum(n / total * math.log(total * n / (rows[a] * cols[b])) for a, b, n in table if n)
    expected = sum(_expected_term(a, b, total) for a in rows.values() for b in cols.values())
    top = (entropy(rows) + entropy(cols)) / 2 - expected
    if abs(top) < 1e-15:
        return 1.0
    return (mutual - expected) / top


def adjusted_mutual_information(df: DataFrame, a: str, b: str, group: list[str] | None = None, times: str | None = None) -> DataFrame:
    """(group, ami). The rows shrink to a table of classes squared; its expectation is computed on that."""
    group = group or []
    table = contingency(df, a, b, group, times)

    def one(part: pd.DataFrame) -> pd.DataFrame:
        value = ami_of(list(zip(part["a"], part["b"], part["n"])))
        return pd.DataFrame({**{g: [part[g].iloc[0]] for g in group}, "ami": [value]})

    fields = "".join(f"{g} {table.schema[g].dataType.simpleString()}, " for g in group)
    return table.withColumn("__all", F.lit(0)).groupBy(*(group or ["__all"])).applyInPandas(one, f"{fields}ami double")


def average_precision(df: DataFrame, y: str, score: str, group: list[str] | None = None) -> DataFrame:
    """(group, ap): precision summed over the recall gained at each distinct score, 0 where there is no positive."""
    group = group or []
    steps = df.where(F.col(y).isNotNull() & F.col(score).isNotNull()).groupBy(*group, (-F.col(score)).alias("t")).agg(F.sum((F.col(y) == 1).cast("bigint")).alias("pos"), F.count("*").alias("n"))
    steps = by_range(steps, *group, "t")
    steps = running_sum(steps, group, "__bucket", ["t"], ["pos", "n"], ["pos_before", "n_before"])
    gain = F.col("pos") * (F.col("pos_before") + F.col("pos")) / (F.col("n_before") + F.col("n"))
    sums = (steps.groupBy(*group) if group else steps.groupBy()).agg(F.sum(gain).alias("g"), F.sum("pos").alias("p"))
    return sums.select(*group, F.when(F.coalesce("p", F.lit(0)) == 0, 0.0).otherwise(F.col("g") / F.col("p")).alias("ap"))


def average_precision_or(df: DataFrame, y: str, score: str, accepted: str) -> DataFrame:
    """(ap) of the accepted rows; where a score among them is null or NaN, that of scores of 0; where none is accepted, of scores of 0 of all rows; 0 where there is no label."""
    bad = F.col(score).isNull() | F.isnan(score)
    state = df.where(F.col(y).isNotNull()).agg(F.coalesce(F.bool_or((F.col(accepted) == 1) & bad), F.lit(False)).alias("bad"), F.coalesce(F.bool_or(F.col(accepted) == 1), F.lit(False)).alias("some"))
    rows = df.crossJoin(F.broadcast(state)).where((F.col(accepted) == 1) | ~F.col("some"))
    flat = rows.withColumn(score, F.when(F.col("bad") | ~F.col("some"), 0.0).otherwise(F.col(score)))
    return average_precision(flat.select(y, score), y, score).select(F.coalesce("ap", F.lit(0.0)).alias("ap"))


def energy_distance(df: DataFrame, y: str, score: str, group: list[str] | None = None) -> DataFrame:
    """(group, energy) between the two classes' scores after scaling them to [0, 1]; a constant score counts as 0, and a missing class gives 1000."""
    group = group or []
    rows = df.where(F.col(y).isin(0, 1) & F.col(score).isNotNull())
    ends = rows.groupBy(*group).agg(F.min(score).alias("lo"), F.max(score).alias("hi"), F.sum((F.col(y) == 1).cast("double")).alias("n1"), F.sum((F.col(y) == 0).cast("double")).alias("n0")) if group else rows.agg(
        F.min(score).alias("lo"), F.max(score).alias("hi"), F.sum((F.col(y) == 1).cast("double")).alias("n1"), F.sum((F.col(y) == 0).cast("double")).alias("n0")
    )
    joined = rows.join(F.broadcast(ends), group) if group else rows.crossJoin(F.broadcast(ends))
    scaled = joined.withColumn("t", F.when(F.col("hi") > F.col("lo"), (F.col(score) - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0))
    steps = scaled.groupBy(*group, "t").agg(F.sum((F.col(y) == 1).cast("bigint")).alias("c1"), F.sum((F.col(y) == 0).cast("bigint")).alias("c0"), F.first("n1").alias("n1"), F.first("n0").alias("n0"))
    steps = by_range(steps, *group, "t")
    steps = following(running_sum(steps, group, "__bucket", ["t"], ["c1", "c0"], ["b1", "b0"]), group, "__bucket", "t", "t_next").where("t_next is not null")
    gap = (F.col("b1") + F.col("c1")) / F.col("n1") - (F.col("b0") + F.col("c0")) / F.col("n0")
    area = steps.groupBy(*group).agg(F.sum(gap * gap * (F.col("t_next") - F.col("t"))).alias("area")) if group else steps.agg(F.sum(gap * gap * (F.col("t_next") - F.col("t"))).alias("area"))
    out = ends.join(area, group, "left") if group else ends.crossJoin(area)
    return out.select(*group, F.when((F.col("n1") == 0) | (F.col("n0") == 0), 1000.0).otherwise(F.sqrt(2 * F.coalesce("area", F.lit(0.0)))).alias("energy"))


def weighted(value: Column, accepted: Column, masked: Column) -> Column:
    """A metric over accepted rows times the part of masked rows that were accepted."""
    return F.when(masked == 0, 0.0).otherwise(value * accepted / masked)


def safe(value: Column, lower: Column | None = None, upper: Column | None = None) -> Column:
    """[value, lower, upper], the bounds being the value where they are not given; the fallback where any of them is null or NaN."""
    parts = [value, value if lower is None else lower, value if upper is None else upper]
    bad = F.lit(False)
    for part in parts:
        bad = bad | part.isNull() | F.isnan(part)
    return F.when(bad, F.array(*[F.lit(x) for x in FALLBACK])).otherwise(F.array(*[part.cast("double") for part in parts]))


#: A metric of cells: (table, names of its label columns, column that says how often a cell counts, group) to (group, value).
Metric = Callable[[DataFrame, list[str], str, list[str]], DataFrame]


def _named(name: str) -> Metric:
    return lambda t, cols, times, group: binary(t, cols[0], cols[1], group, times).select(*group, F.col(name).alias("value"))


def _value(f: Callable[..., DataFrame]) -> Metric:
    return lambda t, cols, times, group: f(t, cols[0], cols[1], group, times).transform(lambda d: d.select(*group, F.col(d.columns[-1]).alias("value")))


def accepted_part(metric: Metric) -> Metric:
    """A metric of three columns, the third 1 where the prediction was accepted: the metric of the accepted rows times their part of all rows."""

    def run(t: DataFrame, cols: list[str], times: str, group: list[str]) -> DataFrame:
        rate = t.groupBy(*group).agg((F.sum(F.when(F.col(cols[2]) == 1, F.col(times)).otherwise(0)) / F.sum(times)).alias("rate"))
        inner = metric(t.where(F.col(cols[2]) == 1), cols[:2], times, group)
        both = rate.join(inner, group, "left") if group else rate.crossJoin(inner)
        return both.select(*group, (F.coalesce("value", F.lit(0.0)) * F.col("rate")).alias("value"))

    return run


#: Metrics of labels by name, for bootstrap(); the w ones take a third column, whether the prediction was accepted.
METRICS: dict[str, Metric] = {n: _named(n) for n in ("mcc", "recall", "precision", "accuracy")} | {"ami": _value(adjusted_mutual_information), "ari": _value(adjusted_rand), "mcc_multi": _value(multiclass_mcc)}
METRICS |= {f"w{n}": accepted_part(METRICS[n]) for n in ("mcc", "ami", "ari", "recall")}


def resampled(cells: DataFrame, cols: list[str], group: list[str], replicates: int, seed: int, repeatable: bool) -> DataFrame:
    """(group, resample, cols, times): how often each cell of (group, cols, n) is drawn in each resample of as many rows, with replacement.

    Rows of one cell are alike, so a resample is a draw of counts: the work grows with resamples and cells, not with
    rows. repeatable: the j-th draw of resample b is row h(seed, b:j) modulo n in the order of the cells, as another
    engine can repeat it; its work grows with the rows too, but none is joined or shuffled.
    """
    if repeatable:
        upto = F.sum("n").over(Window.partitionBy(*group).orderBy(*cols))  # as many rows as there are cells
        cells = cells.withColumn("to", upto).withColumn("from", F.col("to") - F.col("n"))
        packed = cells.groupBy(*group).agg(F.sum("n").alias("all"), F.array_sort(F.collect_list(F.struct("to", "from", *cols))).alias("cells"))
        spark = cells.sparkSession
        most = packed.agg(F.max("all").alias("m")).first().m or 0
        draws = spark.range(replicates * most).select(F.floor(F.col("id") / most).cast("bigint").alias("resample"), F.pmod("id", F.lit(most)).alias("j"))
        draws = draws.withColumn("u", h(seed, F.concat_ws(":", "resample", "j")))
        drawn = draws.crossJoin(F.broadcast(packed)).where("j < all").withColumn("place", F.pmod("u", "all"))
        at = F.filter("cells", lambda c: (c["to"] > F.col("place")) & (c["from"] <= F.col("place")))[0]
        return drawn.select(*group, "resample", at.alias("c")).groupBy(*group, "resample", *[F.col(f"c.{c}").alias(c) for c in cols]).agg(F.count("*").alias("times"))
    names = [*group, *cols]
    table = cells.select(*names, "n").orderBy(*names).toPandas()  # classes to the power of the columns, times the groups
    owner = table.groupby(group, dropna=False, sort=False).ngroup().to_numpy() if group else np.zeros(len(table), int)
    counts = table["n"].to_numpy()
    schema = ", ".join(["resample bigint", *[f"{c} {cells.schema[c].dataType.simpleString()}" for c in names], "times bigint"])

    def draw(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for b in part["id"]:
                rng = np.random.default_rng([seed, int(b)])
                times = np.zeros(len(counts), np.int64)
                for g in np.unique(owner):
                    own = owner == g
                    times[own] = rng.multinomial(counts[own].sum(), counts[own] / counts[own].sum())
                yield table[names].assign(resample=b, times=times)[["resample", *names, "times"]][times > 0]

    return cells.sparkSession.range(replicates).mapInPandas(draw, schema)


def bootstrap(df: DataFrame, cols: list[str], metric: str | Metric, group: list[str] | None = None, replicates: int = 1000, alpha: float = 0.05, seed: int = 0, repeatable: bool = False) -> DataFrame:
    """(group, value, lower, upper): a metric of label columns and its interval over resamples of as many rows with replacement (percentiles, linear between).

    metric: a name of METRICS, or a callable of the same form. Rows with a null in cols do not count; a table without
    rows gives no group. Rows shrink to cells of equal labels first, see resampled().
    """
    group = group or []
    measure = METRICS[metric] if isinstance(metric, str) else metric
    rows = df
    for c in cols:
        rows = rows.where(F.col(c).isNotNull())
    cells = written(rows.groupBy(*group, *cols).agg(F.count("*").alias("n")), "cells")
    if cells.isEmpty():
        return measure(cells, cols, "n", group).where(F.lit(False)).select(*group, *[F.lit(0.0).alias(c) for c in ("value", "lower", "upper")])
    drawn = written(resampled(cells, cols, group, replicates, seed, repeatable), "resamples")
    per = measure(drawn, cols, "times", [*group, "resample"])
    ends = [F.percentile("value", F.lit(q)).alias(c) for q, c in ((alpha / 2, "lower"), (1 - alpha / 2, "upper"))]
    spread = per.groupBy(*group).agg(*ends)
    whole = measure(cells, cols, "n", group).select(*group, "value")
    return whole.join(spread, group) if group else whole.crossJoin(spread)


def intervals(df: DataFrame, cols: list[str], names: dict[str, str | Metric], group: list[str], replicates: int = 1000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """(group, names): each metric of names (column to a name of METRICS or a callable) as [value, lower, upper], all over the same resamples; the fallback where one cannot be computed."""
    rows = df
    for c in cols:
        rows = rows.where(F.col(c).isNotNull())
    cells = written(rows.groupBy(*group, *cols).agg(F.count("*").alias("n")), "cells")
    drawn = written(resampled(cells, cols, group, replicates, seed, False), "resamples")
    out = cells.select(*group).distinct()
    for name, metric in names.items():
        measure = METRICS[metric] if isinstance(metric, str) else metric
        ends = [F.percentile("value", F.lit(q)).alias(c) for q, c in ((alpha / 2, "lower"), (1 - alpha / 2, "upper"))]
        spread = measure(drawn, cols, "times", [*group, "resample"]).groupBy(*group).agg(*ends)
        whole = measure(cells, cols, "n", group).select(*group, "value")
        out = out.join(whole.join(spread, group).select(*group, safe(F.col("value"), F.col("lower"), F.col("upper")).alias(name)), group, "left")
        out = out.withColumn(name, F.coalesce(name, F.array(*[F.lit(x) for x in FALLBACK])))
    return out


def _poisson(rng: np.random.Generator, rows: int, replicates: int) -> np.ndarray:
    return rng.poisson(1.0, (rows, replicates)).astype(np.int64)


def bootstrap_average_precision(df: DataFrame, y: str, score: str, replicates: int = 1000, alpha: float = 0.05, seed: int = 0, id_col: str = "id") -> DataFrame:
    """(value, lower, upper) of the average precision, resampled by Poisson weights: a row counts 0, 1, 2, ... times in each resample, on its own, which for many rows is as good as drawing with replacement.

    Two passes over rows in range partitions of the score, a task holding one partition: weights' sums per partition and
    resample, then the precision at every score from the sums of the partitions before. Null labels and scores do not
    count; without a positive the value is 0.
    """
    rows = df.where(F.col(y).isNotNull() & F.col(score).isNotNull()).select((-F.col(score)).alias("t"), (F.col(y) == 1).cast("int").alias("pos"), F.xxhash64(id_col, F.lit(seed)).alias("draw"))
    placed = by_range(rows, "t")

    def weights(part: pd.DataFrame) -> np.ndarray:
        return np.stack([_poisson(np.random.default_rng(d & (2**63 - 1)), 1, replicates)[0] for d in part["draw"]]) if len(part) else np.zeros((0, replicates), np.int64)

    def totals(part: pd.DataFrame) -> pd.DataFrame:
        w = weights(part)
        return pd.DataFrame([{"__bucket": part["__bucket"].iloc[0], "p": (w * part["pos"].to_numpy()[:, None]).sum(0).tolist(), "n": w.sum(0).tolist()}])

    sums = placed.groupBy("__bucket").applyInPandas(totals, "__bucket int, p array<bigint>, n array<bigint>").orderBy("__bucket").toPandas()  # a row a partition
    before_p, before_n, p, n = {}, {}, np.zeros(replicates, np.int64), np.zeros(replicates, np.int64)
    for bucket, dp, dn in zip(sums["__bucket"], sums["p"], sums["n"]):
        before_p[bucket], before_n[bucket] = p.copy(), n.copy()
        p, n = p + np.array(dp), n + np.array(dn)
    whole = p

    def gains(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["t", "draw"])
        w, bucket = weights(part), part["__bucket"].iloc[0]
        starts = np.flatnonzero(np.append(True, np.diff(part["t"].to_numpy()) != 0))
        pos, all_ = np.add.reduceat(w * part["pos"].to_numpy()[:, None], starts), np.add.reduceat(w, starts)
        cp, cn = before_p[bucket] + pos.cumsum(0), before_n[bucket] + all_.cumsum(0)
        return pd.DataFrame({"b": np.arange(replicates), "g": (pos * cp / np.maximum(cn, 1)).sum(0)})

    per = placed.groupBy("__bucket").applyInPandas(gains, "b int, g double").groupBy("b").agg(F.sum("g").alias("g"))
    of = df.sparkSession.createDataFrame([(i, float(v)) for i, v in enumerate(whole)], "b int, p double")  # a row a resample
    per = of.join(per, "b", "left").select(F.when(F.col("p") > 0, F.coalesce("g", F.lit(0.0)) / F.col("p")).otherwise(0.0).alias("v"))
    ends = per.agg(F.percentile("v", F.lit(alpha / 2)).alias("lower"), F.percentile("v", F.lit(1 - alpha / 2)).alias("upper"))
    return average_precision(df, y, score).select(F.col("ap").alias("value")).crossJoin(ends)
