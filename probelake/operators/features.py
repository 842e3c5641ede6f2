"""Relevance of vector dims to a target, selection of dims, and directions that pairs of rows share.

Long form (dim, x, y) spreads dims over tasks; matrices of dims by dims are the only thing the driver holds.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probelake.functions.hashing import h
from probelake.operators import forest
from probelake.operators.ranks import by_range, following, ranked, running_sum
from probelake.operators.scaling import as_arrays, gram_matrix, vector_stats
from probelake.session import is_small, written


def long_form(df: DataFrame, vec: str = "vec", keep: list[str] | None = None) -> DataFrame:
    """(keep, dim, x): one row for each value of each vector."""
    return df.select(*(keep or []), F.posexplode(vec).alias("dim", "x"))


def _correlation(a: str, b: str) -> Column:
    return F.corr(F.col(a).cast("double"), F.col(b).cast("double"))


def pearson(df: DataFrame, vec: str = "vec", y: str = "y", group: list[str] | None = None) -> DataFrame:
    """(group, dim, pearson) of each dim with y; 0 where a side is constant. Sums per partition over whole vectors: none is exploded."""
    group = group or []
    wide = df.where(F.col(y).isNotNull()).select(*group, F.concat(F.array(F.col(y).cast("double")), F.col(vec).cast("array<double>"), F.transform(vec, lambda x: x.cast("double") * F.col(y).cast("double"))).alias("__w"))
    stats = vector_stats(wide, "__w", group)
    packed = as_arrays(stats, group, mean=F.col("mean"), sd=F.col("sd"), n=F.col("n"))
    size = (F.size("mean") - 1) / 2
    rows = packed.select(*group, F.explode(F.sequence(F.lit(0), (size - 1).cast("int"))).alias("dim"), "mean", "sd", size.cast("int").alias("h")).where("h > 0")
    at = lambda c, i: F.element_at(c, (i + 1).cast("int"))
    dim, h_ = F.col("dim"), F.col("h")
    cov = at("mean", dim + 1 + h_) - at("mean", dim + 1) * at("mean", F.lit(0))
    scale = at("sd", dim + 1) * at("sd", F.lit(0))
    return rows.select(*group, "dim", F.when(scale > 1e-300, cov / scale).otherwise(0.0).alias("pearson"))


def average_ranks(df: DataFrame, group: list[str], value: str, out: str) -> DataFrame:
    """df with out, the value's rank in its group, ties at their mean; groups may be of any size."""
    placed = ranked(df.groupBy(*group, value).agg(F.count("*").alias("__n")), [value], "__r", group)
    sums = running_sum(placed.withColumn("__b", F.floor(F.col("__r") / 4096)), group, "__b", ["__r"], "__n", "__below")
    ranks = sums.select(*group, F.col(value).alias("__v"), (F.col("__below") + (F.col("__n") + 1) / 2).alias(out))
    return df.join(ranks, [*[df[g] == ranks[g] for g in group], df[value] == ranks["__v"]]).select(*[df[c] for c in df.columns], out)


def spearman(df: DataFrame, vec: str = "vec", y: str = "y", group: list[str] | None = None) -> DataFrame:
    """(group, dim, spearman): the correlation of mean ranks."""
    group = group or []
    rows = df.where(F.col(y).isNotNull()).withColumn("__y", F.col(y).cast("double"))
    rows = average_ranks(rows.select(*group, vec, "__y"), group, "__y", "ry")  # the target is ranked once, not once a dim
    long = long_form(rows, vec, [*group, "ry"])
    both = average_ranks(long, [*group, "dim"], "x", "rx")
    return both.groupBy(*group, "dim").agg(_correlation("rx", "ry").alias("c")).select(*group, "dim", F.when(F.col("c").isNull() | F.isnan("c"), 0.0).otherwise(F.col("c")).alias("spearman"))


def chatterjee(df: DataFrame, dims: list[int], vec: str = "vec", id_col: str = "id", group: list[str] | None = None) -> DataFrame:
    """(group, a, b, xi) for each pair of neighbouring dims (a, b) of dims: 1 - 3 * the sum of |steps| / (n^2 - 1), the steps being those of the positions by a when rows are taken in the order of b."""
    group = group or []
    keys = [*group, "a", "b"]
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in zip(dims, dims[1:])])).alias("p")
    rows = df.select(*group, F.col(id_col).alias("id"), pairs, vec).select(*group, "id", "p.a", "p.b", F.col(vec)[F.col("p.a")].alias("x"), F.col(vec)[F.col("p.b")].alias("y"))
    rows = ranked(rows, ["x", "id"], "pos", keys)
    rows = ranked(rows.select(*keys, "y", "pos"), ["y", "pos"], "at", keys)
    nxt = rows.select(*keys, (F.col("at") - 1).alias("at"), F.col("pos").alias("next"))
    steps = rows.join(nxt, [*keys, "at"], "left").groupBy(*keys).agg(F.sum(F.abs(F.col("next") - F.col("pos"))).alias("s"), F.count("*").cast("double").alias("n"))
    return steps.select(*keys, (1 - 3 * F.coalesce("s", F.lit(0)) / (F.col("n") * F.col("n") - 1)).alias("xi"))


def distances(df: DataFrame, vec: str = "vec", y: str = "y", group: list[str] | None = None) -> DataFrame:
    """(group, dim, wasserstein, energy, ks) between the values of the two classes, from their distribution functions; ks is the largest gap between these."""
    keys = [*(group or []), "dim"]
    long = long_form(df.where(F.col(y).isin(0, 1)), vec, [*(group or []), y])
    steps = long.groupBy(*keys, "x").agg(F.sum((F.col(y) == 1).cast("bigint")).alias("c1"), F.sum((F.col(y) == 0).cast("bigint")).alias("c0"))
    steps = by_range(steps, *keys, "x")
    steps = following(running_sum(steps, keys, "__bucket", ["x"], ["c1", "c0"], ["b1", "b0"]), keys, "__bucket", "x", "x_next")
    n = steps.groupBy(*keys).agg(F.sum("c1").cast("double").alias("n1"), F.sum("c0").cast("double").alias("n0"))
    gap = (F.col("b1") + F.col("c1")) / F.col("n1") - (F.col("b0") + F.col("c0")) / F.col("n0")
    step = F.coalesce(F.col("x_next") - F.col("x"), F.lit(0.0))
    return steps.join(n, keys).groupBy(*keys).agg(F.sum(F.abs(gap) * step).alias("wasserstein"), F.sqrt(2 * F.sum(gap * gap * step)).alias("energy"), F.max(F.abs(gap)).alias("ks"))


def f_values(df: DataFrame, vec: str = "vec", y: str = "y", group: list[str] | None = None) -> DataFrame:
    """(group, dim, f): the variance between classes over that within them; 0 where a class's values never vary."""
    group = group or []
    stats = vector_stats(df.where(F.col(y).isNotNull()), vec, [*group, y])
    both = stats.groupBy(*group, "dim").agg(
        F.sum("n").alias("n"), F.count("*").alias("k"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("m"), F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("q"), F.sum(F.col("n") * F.col("sd") * F.col("sd")).alias("within")
    )
    between = F.greatest(F.lit(0.0), F.col("q") - F.col("n") * F.col("m") * F.col("m")) / (F.col("k") - 1)
    inner = F.col("within") / (F.col("n") - F.col("k"))
    return both.select(*group, "dim", F.when((F.col("k") > 1) & (inner > 0), between / inner).otherwise(0.0).alias("f"))


def _digamma(n: np.ndarray) -> np.ndarray:
    n = np.asarray(n, float)
    out = np.zeros_like(n)
    while (small := n < 6).any():
        out = np.where(small, out - 1 / np.where(small, n, 1), out)
        n = np.where(small, n + 1, n)
    i = 1 / (n * n)
    return out + np.log(n) - 0.5 / n - i * (1 / 12 - i * (1 / 120 - i / 252))


def nearest_mutual_information(x: np.ndarray, y: np.ndarray, k: int = 25) -> float:
    """Mutual information of a continuous x with a discrete y by the k nearest neighbours within the class."""
    n, radius, size, kk = len(x), np.zeros(len(x)), np.zeros(len(x)), np.zeros(len(x))
    for c in np.unique(y):
        at = np.flatnonzero(y == c)
        if len(at) < 2:
            continue
        order = at[np.argsort(x[at], kind="stable")]
        v, near = x[order], min(k, len(at) - 1)
        lo = np.arange(len(v))[:, None] - np.arange(near + 1)[None, :]  # windows of near + 1 neighbours in order that hold the point
        hi = lo + near
        fits = (lo >= 0) & (hi < len(v))
        far = np.maximum(v[:, None] - v[np.clip(lo, 0, len(v) - 1)], v[np.clip(hi, 0, len(v) - 1)] - v[:, None])
        radius[order] = np.where(fits, far, np.inf).min(1)
        size[order], kk[order] = len(at), near
    used = size > 1
    if not used.any():
        return 0.0
    all_ = np.sort(x[used])
    r = np.nextafter(radius[used], 0)
    m = np.searchsorted(all_, x[used] + r, "right") - np.searchsorted(all_, x[used] - r, "left")
    return max(0.0, float(_digamma(np.array([used.sum()]))[0] + _digamma(kk[used]).mean() - _digamma(size[used]).mean() - _digamma(np.maximum(m, 1)).mean()))


#: Rows of a class and dim whose neighbours one task looks for.
BLOCK_ROWS = 65_536


def _digamma_of(n: Column) -> Column:
    """digamma of whole numbers from 1 on."""
    far = n + 6
    i = 1 / (far * far)
    series = F.log(far) - 0.5 / far - i * (1 / 12 - i * (1 / 120 - i / 252))
    for step in range(6):
        series = series - 1 / (n + step)
    return series


def mutual_information(df: DataFrame, vec: str = "vec", y: str = "y", k: int = 25, id_col: str = "id", group: list[str] | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(group, dim, mi) of each dim with a discrete y over all rows, by the k nearest neighbours within the class; NaN values do not count, a class of one row neither.

    The values of a dim and class are ordered and cut into blocks, each with k rows of its neighbours at either edge,
    so a task looks at one block; how many values lie within a row's radius comes from running counts over all values.
    """
    keys = [*(group or []), "dim"]
    own = [*keys, y]
    long = long_form(df.where(F.col(y).isNotNull()), vec, [*(group or []), id_col, y]).where(~F.isnan("x") & F.col("x").isNotNull()).withColumn("x", F.col("x").cast("double"))
    placed = written(ranked(long, ["x", id_col], "at", own), "placed")
    sizes = placed.groupBy(*own).agg(F.count("*").alias("size")).where("size > 1")
    used = placed.join(F.broadcast(sizes) if is_small(sizes) else sizes, own).select(*own, "x", "at", "size")
    block = F.floor((F.col("at") - 1) / block_rows).cast("int")
    inside = F.pmod(F.col("at") - 1, F.lit(block_rows))
    blocks = F.array(block, F.when(inside < k, block - 1), F.when(inside >= block_rows - k, block + 1))
    spread = used.withColumn("own", block).withColumn("block", F.explode(F.filter(blocks, lambda b: b.isNotNull() & (b >= 0))))

    def radii(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("at")
        v, near = part["x"].to_numpy(), int(min(k, part["size"].iloc[0] - 1))
        low = np.arange(len(v))[:, None] - np.arange(near + 1)[None, :]  # windows of near + 1 neighbours in order that hold the point
        high = low + near
        far = np.maximum(v[:, None] - v[np.clip(low, 0, len(v) - 1)], v[np.clip(high, 0, len(v) - 1)] - v[:, None])
        part["r"] = np.nextafter(np.where((low >= 0) & (high < len(v)), far, np.inf).min(1), 0)
        part["near"] = near
        return part[part["own"] == part["block"]][[*own, "at", "x", "r", "size", "near"]]

    fields = ", ".join(f"{c} {used.schema[c].dataType.simpleString()}" for c in own)
    found = written(spread.groupBy(*own, "block").applyInPandas(radii, f"{fields}, at bigint, x double, r double, size bigint, near int"), "radii")
    # a row's count: values up to x + r less values below x - r; ends are ordered among the values
    ends = F.array(
        F.struct(F.col("x").alias("v"), F.lit(0).alias("kind"), F.lit(1).alias("one"), F.lit(0).alias("sign")),
        F.struct((F.col("x") + F.col("r")).alias("v"), F.lit(1).alias("kind"), F.lit(0).alias("one"), F.lit(1).alias("sign")),
        F.struct((F.col("x") - F.col("r")).alias("v"), F.lit(-1).alias("kind"), F.lit(0).alias("one"), F.lit(-1).alias("sign")),
    )
    marks = by_range(found.select(*own, "at", F.explode(ends).alias("e")).select(*own, "at", "e.*"), *keys, "v", "kind")
    counted = running_sum(marks, keys, "__bucket", ["v", "kind"], "one", "below").where("sign <> 0")
    within = counted.groupBy(*own, "at").agg(F.sum(F.col("sign") * F.col("below")).alias("m"))
    m = within.groupBy(*keys).agg(F.avg(_digamma_of(F.greatest(F.col("m"), F.lit(1)).cast("double"))).alias("m"))
    rest = found.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(_digamma_of(F.col("near").cast("double"))).alias("near"), F.avg(_digamma_of(F.col("size").cast("double"))).alias("size"))
    mi = F.greatest(F.lit(0.0), _digamma_of(F.col("n").cast("double")) + F.col("near") - F.col("size") - F.col("m"))
    return rest.join(m, keys).select(*keys, mi.alias("mi"))


def forest_importances(df: DataFrame, vec: str = "vec", y: str = "y", trees: int = 500, depth: int = 10, seed: int = 0) -> DataFrame:
    """(dim, importance) by a random forest over all rows; rows of a null target do not count. See forest; rows that do not fit a worker in bins go to Spark's own forest."""
    rows = written(df.where(F.col(y).isNotNull()).select(F.col(vec).alias("vec"), F.col(y).cast("double").alias("y")), "forest")
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dims"), F.min(F.size("vec")).alias("least"), F.min("y").alias("low"), F.max("y").alias("high"), F.count_if(F.col("y") != F.floor("y")).alias("odd")).first()
    if not size.n or size.low < 0 or size.odd or size.least != size.dims:
        raise ValueError("a forest takes rows of equal lengths with classes 0, 1, ...")
    classes = int(size.high) + 1
    if forest.BINS * classes <= 65_536 and size.n * size.dims * (1 if forest.BINS * classes <= 256 else 2) <= forest.MOST_BYTES:
        values = forest.importances(rows, size.dims, classes, trees, depth, seed)
    else:
        from pyspark.ml.classification import RandomForestClassifier
        from pyspark.ml.functions import array_to_vector

        values = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(rows.select(array_to_vector("vec").alias("features"), F.col("y").alias("label"))).featureImportances.toArray()
    return df.sparkSession.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "dim int, importance double")


def correlations(df: DataFrame, vec: str = "vec") -> np.ndarray:
    """The correlation matrix of the dims, 0 where one is constant."""
    stats = sorted(vector_stats(df, vec).collect(), key=lambda r: r.dim)
    size = len(stats)
    gram = np.zeros((size, size))
    for r in gram_matrix(df, vec).collect():
        gram[r.i, r.j] = r.value
    n = max(1, stats[0].n) if stats else 1
    mean, sd = np.array([r["mean"] for r in stats]), np.array([r.sd for r in stats])
    scale = np.outer(sd, sd)
    return np.where(scale > 0, (gram / n - np.outer(mean, mean)) / np.where(scale > 0, scale, 1), 0.0)


def mrmr(relevance: np.ndarray, redundancy: np.ndarray, k: int) -> list[int]:
    """k dims, each next one with the largest relevance over its mean |redundancy| with those chosen; ties to the lower dim."""
    chosen: list[int] = []
    for _ in range(min(k, len(relevance))):
        load = np.abs(redundancy[:, chosen]).mean(1) if chosen else np.ones(len(relevance))
        score = relevance / np.maximum(load, 1e-12)
        score[chosen] = -np.inf
        chosen.append(int(score.argmax()))
    return chosen


#: Relevance of a dim to the target by name: (group, dim, value); redundancy of dims by name: dims by dims.
RELEVANCE: dict[str, Callable[[DataFrame, str, str], DataFrame]] = {
    "mi": lambda df, vec, y: mutual_information(df, vec, y),
    "ks": lambda df, vec, y: distances(df, vec, y).select("dim", "ks"),
    "f": lambda df, vec, y: f_values(df, vec, y),
    "rf": lambda df, vec, y: forest_importances(df, vec, y),
    "pearson": lambda df, vec, y: pearson(df, vec, y).select("dim", F.abs("pearson").alias("pearson")),
}


def rank_correlations(df: DataFrame, vec: str = "vec", id_col: str = "id") -> np.ndarray:
    """The correlation matrix of the dims' mean ranks."""
    long = long_form(df, vec, [id_col])
    ranks = average_ranks(long, ["dim"], "x", "r").groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("dim", "r"))).alias("z"))  # as many as a vector has dims
    return correlations(ranks.select(F.col("z.r").alias("vec")))


def chatterjee_matrix(df: DataFrame, vec: str = "vec", id_col: str = "id") -> np.ndarray:
    """xi of every pair of dims, row a and column b, ties by id; 1 on the diagonal."""
    long = ranked(long_form(df, vec, [id_col]), ["x", id_col], "pos", ["dim"])
    ranks = written(long.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("dim", "pos"))).alias("z")).select(id_col, F.col("z.pos").alias("p")), "ranks")
    size, n = len((ranks.select("p").first() or [[]])[0]), ranks.count()
    out = np.eye(size)
    for b in range(size):  # rows in the order of dim b: each one's steps in all dims, partial sums per partition
        at = ranks.select(F.col("p")[b].cast("bigint").alias("at"), "p")
        steps = at.join(at.select((F.col("at") - 1).alias("at"), F.col("p").alias("next")), "at").select(F.zip_with("p", "next", lambda x, y: F.abs(x - y).cast("double")).alias("d"))
        for r in vector_stats(steps, "d").collect():
            if r.dim != b:
                out[r.dim, b] = 1 - 3 * r["mean"] * r.n / (n * n - 1.0)
    return out


REDUNDANCY: dict[str, Callable[[DataFrame, str], np.ndarray]] = {"pearson": lambda df, vec: correlations(df, vec), "spearman": lambda df, vec: rank_correlations(df, vec), "chatterjee": lambda df, vec: chatterjee_matrix(df, vec)}


def selected_dims(df: DataFrame, k: int, relevance: str | Callable[[DataFrame, str, str], DataFrame] = "pearson", redundancy: str | Callable[[DataFrame, str], np.ndarray] = "pearson", vec: str = "vec", y: str = "y") -> list[int]:
    """k dims by mrmr(); relevance and redundancy are names of RELEVANCE and REDUNDANCY or callables of the same form. An unknown name raises an error."""
    for name, known in ((relevance, RELEVANCE), (redundancy, REDUNDANCY)):
        if isinstance(name, str) and name not in known:
            raise ValueError(f"unknown measure: {name}")
    found = (RELEVANCE[relevance] if isinstance(relevance, str) else relevance)(df, vec, y)
    value = dict(sorted((r[0], abs(float(r[1]))) for r in found.collect()))  # a row a dim
    return mrmr(np.array(list(value.values())), (REDUNDANCY[redundancy] if isinstance(redundancy, str) else redundancy)(df, vec), k)


def contrast_pairs(a: DataFrame, b: DataFrame, on: list[str], id_col: str = "id", frac: float = 1.0, seed: int = 5) -> DataFrame:
    """(id_a, id_b) of rows that agree in the columns `on`, a part of them by hash."""
    left, right = a.select(*on, F.col(id_col).alias("id_a")), b.select(*on, F.col(id_col).alias("id_b"))
    pairs = left.join(right, on).select("id_a", "id_b")
    return pairs if frac >= 1 else pairs.where(h(seed, F.concat_ws(":", "id_a", "id_b")) < frac * 2.0**32)


def conditional_counts(a: DataFrame, b: DataFrame, on: str, condition: str) -> DataFrame:
    """(on, ca, cb, na, nb): for each value of `on` the values of condition on both sides, where they differ, and how many rows have them: as many rows as values, however many pairs there are."""
    count = lambda df, c, n: df.where(F.col(on).isNotNull() & F.col(condition).isNotNull()).groupBy(F.col(on).alias("on"), F.col(condition).alias(c)).agg(F.count("*").alias(n))
    return count(a, "ca", "na").join(count(b, "cb", "nb"), "on").where("ca <> cb")


def conditional_weights(cells: DataFrame) -> DataFrame:
    """(ca, pairs, weight) of conditional_counts(): the pairs of each left value, and 1 less their part of all pairs."""
    per = cells.groupBy("ca").agg(F.sum(F.col("na") * F.col("nb")).alias("pairs"))
    return per.crossJoin(F.broadcast(per.agg(F.sum("pairs").alias("all")))).select("ca", "pairs", (1 - F.col("pairs") / F.col("all")).alias("weight"))


def conditional_pairs(a: DataFrame, b: DataFrame, on: str, condition: str, n: int, id_col: str = "id", seed: int = 5) -> DataFrame:
    """(id_a, id_b): n pairs of rows that agree in `on` and differ in condition, drawn without replacement, a pair weighing 1 less its left condition's part of all pairs.

    No pair is listed that is not drawn: a draw takes a cell of conditional_counts() by its pairs' weight and then a
    row of each side by its place in the cell; draws that repeat a pair are drawn again, which is the law of drawing
    one after another. Draw j uses the hashes of c:j, a:j and b:j. Where fewer pairs have a weight, all of them come.
    """
    cells = conditional_counts(a, b, on, condition)
    cells = written(cells.join(conditional_weights(cells), "ca").where("weight > 0").select("on", "ca", "cb", "na", "nb", "weight"), "cells")
    rows = cells.orderBy("on", "ca", "cb").collect()  # values of condition squared
    everything = sum(r.na * r.nb for r in rows)
    spark, most = a.sparkSession, 2.0**32
    schema = f"on {cells.schema['on'].dataType.simpleString()}, ca {cells.schema['ca'].dataType.simpleString()}, cb {cells.schema['cb'].dataType.simpleString()}, pa bigint, pb bigint"
    size = np.array([r.weight * r.na * r.nb for r in rows], float)
    edges = size.cumsum() / size.sum() if len(rows) else size

    def placed(df: DataFrame, c: str, p: str, i: str) -> DataFrame:
        of = df.where(F.col(on).isNotNull() & F.col(condition).isNotNull()).select(F.col(on).alias("on"), F.col(condition).alias(c), F.col(id_col).alias(i))
        return ranked(of, [i], p, ["on", c])

    if everything <= 4 * n:  # so few that all are listed: the largest ln(u) / weight come first
        left = placed(a, "ca", "pa", "id_a").join(cells.select("on", "ca", "cb", "weight"), ["on", "ca"])
        pairs = left.join(placed(b, "cb", "pb", "id_b"), ["on", "cb"])
        return weighted_sample(pairs, F.col("weight"), F.concat_ws(":", "id_a", "id_b"), n, seed).select("id_a", "id_b")
    if not rows:
        return placed(a, "ca", "pa", "id_a").select("id_a", F.col("id_a").alias("id_b")).limit(0)

    chosen: dict[tuple, None] = {}
    at, step = 0, max(64, n)
    while len(chosen) < n:  # n pairs are the result's size; a quarter of all pairs at most, so few draws repeat
        u = [np.array(spark.range(at, at + step).select(h(f"{seed}{k}", "id").alias("h")).toPandas()["h"], float) for k in "cab"]
        for cell, x, z in zip(np.searchsorted(edges, u[0] / most, "right").tolist(), u[1], u[2]):
            r = rows[min(cell, len(rows) - 1)]
            key = (r.on, r.ca, r.cb, int(x / most * r.na) + 1, int(z / most * r.nb) + 1)
            if len(chosen) < n:
                chosen.setdefault(key)
        at += step
    drawn = spark.createDataFrame(list(chosen), schema)
    return drawn.join(placed(a, "ca", "pa", "id_a"), ["on", "ca", "pa"]).join(placed(b, "cb", "pb", "id_b"), ["on", "cb", "pb"]).select("id_a", "id_b")


def weighted_sample(df: DataFrame, weight: Column, key: Column, n: int, seed: int = 5) -> DataFrame:
    """n rows without replacement, each drawn by its weight: the largest ln(u) / weight; rows of weight 0 or less last."""
    u = (h(seed, key) + 0.5) / 2.0**32
    return df.withColumn("__k", F.when(weight > 0, F.log(u) / weight).otherwise(float("-inf"))).orderBy(F.desc("__k"), key).limit(n).drop("__k")


def mean_removed(df: DataFrame, group: str, vec: str = "vec") -> DataFrame:
    """df's vectors less their group's mean, in long form (columns of df without vec, dim, x). A group's mean is one array, so vectors are never regrouped by dim."""
    keep = [c for c in df.columns if c != vec]
    means = as_arrays(vector_stats(df, vec, [group]), [group], __mean=F.col("mean")).withColumnRenamed(group, "__g")
    away = df.join(means, F.col(group).eqNullSafe(F.col("__g")))
    return away.select(*keep, F.posexplode(F.zip_with(F.col(vec), F.col("__mean"), lambda x, m: x - m)).alias("dim", "x"))


def kept_components(explained: list[float], share: float = 0.95) -> int:
    """How many components stay: the place from 0 of the first whose running share reaches `share`, at least 1, all if none does."""
    total, run = sum(explained), 0.0
    for i, e in enumerate(explained):
        run += e / total if total else 0.0
        if run >= share - 1e-12:
            return max(1, i)
    return max(1, len(explained))


def shared_directions(df: DataFrame, group: str, vec: str = "vec", share: float = 0.95, most: int = 500) -> np.ndarray:
    """Rows: the main directions in which rows of a group differ (dims wide, orthonormal). The mean is removed per group through the Gram matrix: G - sum of n_g m_g m_g^T."""
    from probelake.operators.scaling import _partials

    whole = gram_matrix(df, vec).collect()
    size = 1 + max((r.i for r in whole), default=-1)
    gram = np.zeros((size, size))
    for r in whole:
        gram[r.i, r.j] = r.value
    sums = _partials(df, [group], vec, gram=False).select(group, "n", F.posexplode("s").alias("dim", "s")).groupBy(group, "dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    means = sums.groupBy(group).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("dim", "s"))), lambda z: z["s"]).alias("s"))
    means = means.select(F.transform("s", lambda x: x / F.sqrt(F.col("n"))).alias("v"))
    for r in gram_matrix(means, "v").collect():
        gram[r.i, r.j] -= r.value
    values, vectors = np.linalg.eigh(gram) if size else (np.zeros(0), np.zeros((0, 0)))
    order = np.argsort(-values)[:most]
    keep = kept_components([max(0.0, float(v)) for v in values[order]], share) if size else 0
    return vectors[:, order[:keep]].T


def neutralised(df: DataFrame, directions: np.ndarray, vec: str = "vec") -> DataFrame:
    """df with vec less its part along the directions, then of length 1; Arrow batches, the directions travel with the task."""
    from collections.abc import Iterator

    import pyarrow as pa

    from probelake.operators.scaling import matrix

    at = df.columns.index(vec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(at))
            if len(x):
                x = x - (x @ directions.T) @ directions
                n = np.linalg.norm(x, axis=1, keepdims=True)
                x = x / np.where(n > 0, n, 1)
            cols = list(batch.columns)
            cols[at] = pa.array(list(x), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(cols, batch.schema.names)

    return df.withColumn(vec, F.col(vec).cast("array<double>")).mapInArrow(run, df.withColumn(vec, F.col(vec).cast("array<double>")).schema)
