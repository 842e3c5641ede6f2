"""Importances of a random forest whose rows fit a worker at a byte a value.

Values are binned once, by cuts over all rows; each task gets all rows in bins and grows its share of the trees whole,
so no histogram of a node and no row's weights for all trees ever travel.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probelake.operators.scaling import matrix
from probelake.session import written

#: Bins of a dim, and bytes of binned rows up to which a worker holds them.
BINS, MOST_BYTES = 32, 128 << 20


def cuts(rows: DataFrame, dims: int) -> list[np.ndarray]:
    """Of each dim at most BINS - 1 values between which its bins lie, from all rows: every value but the largest where there are at most BINS, else quantiles."""
    shares = F.array(*[F.lit(i / (BINS - 1)) for i in range(BINS - 1)])
    found = rows.agg(*[F.percentile_approx(F.col("vec")[i], shares, F.lit(1000)).alias(f"c{i}") for i in range(dims)]).first()
    out = [np.unique(np.array(c, float)) for c in found]
    tied = [i for i, c in enumerate(out) if len(c) < BINS - 1]
    if tied:
        each = F.explode(F.array(*[F.struct(F.lit(i).alias("dim"), F.col("vec")[i].alias("x")) for i in tied])).alias("p")
        values = written(rows.select(each).select("p.*").distinct(), "values")
        few = values.groupBy("dim").agg(F.count("*").alias("n")).where(F.col("n") <= BINS).select("dim")
        found = values.join(F.broadcast(few), "dim").collect()  # BINS a dim at most
        for i in {r.dim for r in found}:
            out[i] = np.unique([r.x for r in found if r.dim == i])[:-1]
    return out


def tree_importances(codes: np.ndarray, classes: int, rows: np.ndarray, depth: int, rng: np.random.Generator) -> np.ndarray:
    """Of each dim the gini gain of a tree's splits by it, times their rows. codes: dims x rows, each bin * classes + class; a node looks at the root of the dims, drawn anew."""
    dims = len(codes)
    tried, width, out = math.ceil(math.sqrt(dims)), BINS * classes, np.zeros(dims)
    shift = (np.arange(tried) * width)[:, None]
    todo = [(rows, 0)]
    while todo:
        rows, level = todo.pop()
        some, n = rng.permutation(dims)[:tried], len(rows)
        if n <= 4096:
            counts = np.bincount((codes[some[:, None], rows] + shift).ravel(), minlength=tried * width)
        else:
            counts = np.concatenate([np.bincount(codes[f].take(rows), minlength=width) for f in some])
        left = counts.reshape(tried, BINS, classes).cumsum(1).astype(float)
        whole = left[0, -1]
        left = left[:, :-1]
        right = whole - left
        a, b = left.sum(2), right.sum(2)
        gain = (left * left).sum(2) / np.maximum(a, 1) + (right * right).sum(2) / np.maximum(b, 1) - (whole @ whole) / n
        gain[(a == 0) | (b == 0)] = 0
        best, at = divmod(int(gain.argmax()), BINS - 1)
        if gain[best, at] <= 1e-12 * n:
            continue
        out[some[best]] += gain[best, at]
        if level + 1 < depth:
            low = codes[some[best]].take(rows) < (at + 1) * classes
            for side, n_of in ((rows[low], left[best, at]), (rows[~low], right[best, at])):
                if (n_of > 0).sum() > 1:
                    todo.append((side, level + 1))
    return out


def importances(rows: DataFrame, dims: int, classes: int, trees: int, depth: int, seed: int) -> np.ndarray:
    """The mean over the trees of each one's shares of the dims, adding up to 1 (all 0 where no tree splits). rows: a written table (vec, y), y below classes; a tree takes a row as often as a Poisson variable of mean 1 says."""
    edges = cuts(rows, dims)
    kind = np.uint8 if BINS * classes <= 256 else np.uint16

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x, y = matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
                codes = np.stack([np.searchsorted(e, x[:, i], "left") * classes + y for i, e in enumerate(edges)]).astype(kind)
                yield pa.RecordBatch.from_arrays([pa.array([len(batch)], pa.int32()), pa.array([codes.tobytes()], pa.binary())], ["n", "codes"])

    blocks = written(rows.select("vec", "y").mapInArrow(binned, "n int, codes binary"), "binned")
    spark = rows.sparkSession
    shares = min(trees, spark.sparkContext.defaultParallelism)

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, mine = [], None
        for batch in batches:
            for n, codes, share in zip(*(c.to_pylist() for c in batch.columns)):
                parts.append(np.frombuffer(codes, kind).reshape(dims, n))
                mine = share
        if mine is None:
            return
        codes = np.concatenate(parts, 1)
        parts.clear()
        key = np.zeros(codes.shape[1], np.uint64)
        for c in codes:
            key = key * np.uint64(0x9E3779B97F4A7C15) + c
        order = np.argsort(key, kind="stable")  # trees depend on the rows, not on how they are dealt out
        for i in range(dims):
            codes[i] = codes[i][order]
        total = np.zeros(dims)
        for tree in range(mine, trees, shares):
            rng = np.random.default_rng([seed, tree])
            drawn = np.repeat(np.arange(codes.shape[1]), rng.poisson(1.0, codes.shape[1]))
            if len(drawn):
                own = tree_importances(codes, classes, drawn, depth, rng)
                total += own / (own.sum() or 1.0)
        yield pa.RecordBatch.from_arrays([pa.array([mine], pa.int32()), pa.array([total.tolist()], pa.list_(pa.float64()))], ["share", "total"])

    each = blocks.crossJoin(F.broadcast(spark.range(shares).select(F.col("id").cast("int").alias("share"))))
    found = each.repartitionById(shares, F.col("share")).mapInArrow(grow, "share int, total array<double>").collect()  # a row a core
    out = np.sum([r.total for r in sorted(found)], axis=0)
    return out / (out.sum() or 1.0)
