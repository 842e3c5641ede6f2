"""Linear support vector probes: the dual solver, its line, hyper-parameter search, and the sparse multiple-instance probe.

Solvers are small and dense (training sets are capped), so each runs in one task on numpy; fits of several layers,
parameters and folds run side by side.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probelake.functions.hashing import h
from probelake.operators.scaling import as_arrays, vector_stats
from probelake.session import is_small

GRID = (0.05, 0.1, 0.5, 1.0, 10.0)
#: Bags that train, and that train in a fold of the search.
TRAIN_LIMIT, FOLD_LIMIT = 1800, 600


class Products:
    """The products of all rows of x with each other, row by row as they are asked for: at most `held` numbers are kept, so memory does not grow with the square of the rows."""

    def __init__(self, x: np.ndarray, held: int = 1 << 24):
        self.row = lru_cache(max(2, held // max(1, len(x))))(lambda i: x @ x[i])
        self.squares = np.einsum("ij,ij->i", x, x)


def solve_dual(kernel: np.ndarray | Products, y: np.ndarray, c: np.ndarray | float, target: np.ndarray | None = None, penalty: float = -0.1, tol: float = 1e-4, most: int = 100_000) -> np.ndarray:
    """The multipliers that maximise sum(target * a) - a' (yy' * kernel) a / 2 with sum(y a) = 0 and 0 <= a <= c.

    Pairs that break the optimality conditions most are moved one after another. target is 1 for a plain margin; a
    positive penalty is added to the kernel's diagonal. kernel: the matrix, or its rows as Products.
    """
    n = len(y)
    y = y.astype(float)
    c = np.broadcast_to(np.asarray(c, float), (n,))
    row, squares = (kernel.row, kernel.squares) if isinstance(kernel, Products) else (kernel.__getitem__, np.diag(kernel).copy())
    a, grad = np.zeros(n), -(np.ones(n) if target is None else target.astype(float))
    for _ in range(most):
        rise = ((y > 0) & (a < c)) | ((y < 0) & (a > 0))
        fall = ((y > 0) & (a > 0)) | ((y < 0) & (a < c))
        if not rise.any() or not fall.any():
            break
        f = -y * grad
        i = int(np.where(rise, f, -np.inf).argmax())
        gap = f[i] - np.where(fall, f, np.inf)
        curve = np.maximum(squares[i] + squares - 2 * row(i) + (2 * penalty if penalty > 0 else 0), 1e-12)
        j = int(np.where(fall & (gap > 0), gap * gap / curve, -np.inf).argmax())
        if f[i] - np.where(fall, f, np.inf).min() <= tol:
            break
        step = gap[j] / curve[j]
        step = min(step, c[i] - a[i] if y[i] > 0 else a[i], a[j] if y[j] > 0 else c[j] - a[j])
        a[i] += y[i] * step
        a[j] -= y[j] * step
        grad += y * (row(i) - row(j)) * step
        if penalty > 0:
            grad[i] += penalty * y[i] * step
            grad[j] -= penalty * y[j] * step
    return a


def line_of(x: np.ndarray, y: np.ndarray, a: np.ndarray, c: float, cut: float = 1e-7) -> tuple[np.ndarray, float]:
    """(direction of length 1, bias): the bias is the mean over both sides of the mean of y - x.w at multipliers strictly between 0 and c; sides without one do not count, and without any all support vectors do. c is the parameter as given, not the bound it was scaled to, so with a scaled bound every support vector counts."""
    w = (a * y) @ x
    n = np.linalg.norm(w)
    w = w / n if n else w
    free = (a > cut) & (a < np.asarray(c, float) - cut)
    if not free.any():
        free = a > cut
    sides = [float((y[s] - x[s] @ w).mean()) for s in (free & (y > 0), free & (y < 0)) if s.any()]
    return w, float(np.mean(sides)) if sides else 0.0


def fit_linear(x: np.ndarray, y: np.ndarray, c: float, scale_c: bool = True, penalty: float = -0.1) -> tuple[np.ndarray, float]:
    """A linear support vector machine on standardised rows, y in -1 and 1; with scale_c the bound is c / rows."""
    bound = c / len(y) if scale_c else c
    return line_of(x, y, solve_dual(Products(x), y, bound, penalty=penalty), c)


#: Kernels by name: the products of the rows of a with those of b, p being the exponent or the width.
KERNELS: dict[str, Callable[[np.ndarray, np.ndarray, float], np.ndarray]] = {
    "linear": lambda a, b, p: a @ b.T,
    "quadratic": lambda a, b, p: (1 + a @ b.T) ** 2,
    "polynomial": lambda a, b, p: (1 + a @ b.T) ** p,
    "rbf": lambda a, b, p: np.exp(-p * np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T)),
}
#: The kernel of bags that is linear in their means: bags are averaged, then it is the linear one.
AVERAGED = "linear_av"


@dataclass(frozen=True)
class KernelMachine:
    """Support vectors with their coefficients (multiplier times side) and the bias."""

    support: np.ndarray
    coefficients: np.ndarray
    bias: float
    kernel: str
    p: float

    def decide(self, x: np.ndarray) -> np.ndarray:
        return KERNELS[self.kernel](x, self.support, self.p) @ self.coefficients + self.bias


def fit_kernel(x: np.ndarray | list[np.ndarray], y: np.ndarray, c: float, kernel: str = "linear", p: float = 2.0, scale_c: bool = True, penalty: float = -0.1) -> KernelMachine:
    """A support vector machine with a kernel of KERNELS, or AVERAGED over bags. The bias is the mean of y - f(x) at multipliers strictly between the bounds, or of all support vectors where none is. Only the linear ones have a direction, see fit_linear(); an unknown name raises an error."""
    if kernel == AVERAGED:
        x, kernel = np.stack([b.mean(0) for b in x]), "linear"
    if kernel not in KERNELS:
        raise ValueError(f"unknown kernel: {kernel}")
    products = KERNELS[kernel](x, x, p)
    bound = c / len(y) if scale_c else c
    a = solve_dual(products, y, bound, penalty=penalty)
    used = a > 1e-7
    free = used & (a < bound - 1e-7)
    at = free if free.any() else used
    rest = y - products @ (a * y)
    return KernelMachine(x[used], (a * y)[used], float(rest[at].mean()) if at.any() else 0.0, kernel, p)


def average_precision_of(y: np.ndarray, score: np.ndarray) -> float:
    order = np.argsort(-score, kind="stable")
    y, score = y[order] > 0, score[order]
    ends = np.append(np.flatnonzero(np.diff(score)), len(score) - 1)
    tp = y.cumsum()[ends]
    if not len(y) or not y.any():
        return 0.0
    return float((np.diff(np.append(0, tp)) * tp / (ends + 1)).sum() / y.sum())


def fit_sawmil(bags: list[np.ndarray], y: np.ndarray, intra: list[np.ndarray], c: float, eta: float, scale_c: bool = True, least: float = 0.05) -> tuple[np.ndarray, float]:
    """The sparse multiple-instance probe in three stages.

    1: the sparse machine, as published: every instance of a negative bag on its own side with a margin of 1, and every
    positive bag as its mean, a bag of m instances with a margin of 2 / m - 1 only; with scale_c the bounds are c over
    the instances of negative bags and c over the positive bags. 2: instances of positive bags are scored; those that reach the n-th largest score, n = l_p * eta rounded half
    to even within [x_p, l_p], and whose intra label is 1 count as positive; if these are fewer than `least` of l_p,
    the intra label is not asked. 3: a support vector machine over all instances with these labels.
    """
    means = np.stack([x.mean(0) for x, s in zip(bags, y) if s > 0])
    lengths = np.array([len(x) for x, s in zip(bags, y) if s > 0])
    apart = np.concatenate([x for x, s in zip(bags, y) if s < 0])
    rows = np.concatenate([apart, means])
    sides = np.concatenate([-np.ones(len(apart)), np.ones(len(means))])
    margin = np.concatenate([np.ones(len(apart)), 2.0 / lengths - 1])
    bound = np.concatenate([np.full(len(apart), c / len(apart) if scale_c else c), np.full(len(means), c / len(means) if scale_c else c)])
    w, b = line_of(rows, sides, solve_dual(Products(rows), sides, bound, margin), c)
    pos = np.concatenate([x for x, s in zip(bags, y) if s > 0])
    neg = apart
    marks = np.concatenate([x for x, s in zip(intra, y) if s > 0])
    score = pos @ w + b
    n = int(min(max(round(len(pos) * eta), int((y > 0).sum())), len(pos)))
    reach = score >= np.sort(score)[::-1][n - 1]
    label = reach & (marks == 1)
    if label.sum() < least * len(pos):
        label = reach
    x = np.concatenate([neg, pos])
    return fit_linear(x, np.concatenate([-np.ones(len(neg)), np.where(label, 1.0, -1.0)]), c, scale_c)


def one_se(table: DataFrame) -> DataFrame:
    """(c, mean, se): of (c, fold, score) the first c whose mean exceeds the best mean less its standard error; the best if none does."""
    s = table.groupBy("c").agg(F.avg("score").alias("mean"), (F.stddev_pop("score") / F.sqrt(F.count("*"))).alias("se"))
    best = s.agg(F.max_by(F.struct("c", "mean", "se"), F.struct("mean", (-F.col("c")).alias("n"))).alias("b"))
    ok = s.crossJoin(F.broadcast(best)).withColumn("fine", F.col("mean") > F.col("b.mean") - F.col("b.se"))
    pick = F.coalesce(F.min(F.when(F.col("fine"), F.struct("c", "mean", "se"))), F.first("b"))
    return ok.agg(pick.alias("p")).select("p.c", "p.mean", "p.se")


def _capped(df: DataFrame, group: list[str], limit: int, seed: int, id_col: str) -> DataFrame:
    """At most limit rows a group, by hash; the row limit is the probe's documented training cap."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(*group).orderBy(h(seed, id_col), id_col))
    return df.withColumn("__k", place).where(F.col("__k") <= limit).drop("__k")


PROBE_SCHEMA = "direction array<double>, bias double, mu array<double>, sd array<double>, c double"


def _grouped(df: DataFrame, group: list[str], work: Callable[[pd.DataFrame], dict], schema: str) -> DataFrame:
    fields = "".join(f"{g} {df.schema[g].dataType.simpleString()}, " for g in group)

    def one(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{**{g: part[g].iloc[0] for g in group}, **work(part)}])

    return df.groupBy(*group).applyInPandas(one, fields + schema)


def _scaled(rows: DataFrame, whole: DataFrame, group: list[str], vec: str) -> DataFrame:
    """rows with __mu and __sd, the mean and deviation of all vectors of `whole` in the row's group; a constant dim has deviation 1."""
    mu, sd = F.col("mean"), F.col("sd")
    scales = as_arrays(vector_stats(whole, vec, group), group, __mu=mu, __sd=F.when(sd * sd > 1e-14 * (1 + mu * mu), sd).otherwise(1.0))
    scales = scales.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], "__mu", "__sd")
    on = [F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(group)]
    joined = rows.join(F.broadcast(scales), on, "left") if group else rows.crossJoin(F.broadcast(scales))
    return joined.drop(*[f"__g{i}" for i in range(len(group))])


def _scale_in(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    mu, sd = part["__mu"].iloc[0], part["__sd"].iloc[0]
    if mu is None:
        raise ValueError("no row to scale by")
    return np.array(mu), np.array(sd)


def fit(train: DataFrame, group: list[str], c: float = 1.0, vec: str = "vec", y: str = "y", limit: int = TRAIN_LIMIT, seed: int = 42, id_col: str = "id") -> DataFrame:
    """One linear probe a group over standardised vectors: (group, direction, bias, mu, sd, c). y is 0 or 1; a group without both gets a zero direction.

    mu and sd are those of all rows with a y; only the solver is held to `limit` rows.
    """

    def work(part: pd.DataFrame) -> dict:
        part = part.sort_values(id_col)
        x, s = np.stack(part[vec].to_numpy()), np.where(part[y].to_numpy() > 0, 1.0, -1.0)
        mu, sd = _scale_in(part)
        w, b = fit_linear((x - mu) / sd, s, c) if len(set(s)) == 2 else (np.zeros(x.shape[1]), 0.0)
        return {"direction": w.tolist(), "bias": b, "mu": mu.tolist(), "sd": sd.tolist(), "c": c}

    whole = train.where(F.col(y).isin(0, 1))
    rows = _scaled(_capped(whole, group, limit, seed, id_col), whole, group, vec)
    return _grouped(rows, group, work, PROBE_SCHEMA)


def search(train: DataFrame, group: list[str], grid: tuple[float, ...] = GRID, folds: int = 3, vec: str = "vec", y: str = "y", limit: int = FOLD_LIMIT, seed: int = 42, id_col: str = "id", leak: bool = False) -> DataFrame:
    """(group, c, fold, score): average precision of each parameter on each held-out fold, each in its own task; a fit that fails scores 0.1. The scaler sees all rows with a y outside the held-out fold, whatever `limit`; leak: also that fold's."""
    whole = train.where(F.col(y).isin(0, 1)).withColumn("part", F.pmod(h(seed + 1, id_col), F.lit(folds)).cast("int"))
    each = F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))
    seen = whole.withColumn("fold", each).where(F.lit(leak) | (F.col("part") != F.col("fold")))
    rows = _capped(whole, group, limit * folds // max(1, folds - 1), seed, id_col).withColumn("fold", each)
    tasks = _scaled(rows, seen, [*group, "fold"], vec).withColumn("c", F.explode(F.array(*[F.lit(float(c)) for c in grid])))

    def work(part: pd.DataFrame) -> dict:
        part = part.sort_values(id_col)
        x, s, held = np.stack(part[vec].to_numpy()), np.where(part[y].to_numpy() > 0, 1.0, -1.0), (part["part"] == part["fold"]).to_numpy()
        try:
            mu, sd = _scale_in(part)
            w, b = fit_linear((x[~held] - mu) / sd, s[~held], float(part["c"].iloc[0]))
            return {"score": average_precision_of(s[held], ((x[held] - mu) / sd) @ w + b)}
        except (ValueError, FloatingPointError):
            return {"score": 0.1}

    return _grouped(tasks, [*group, "c", "fold"], work, "score double")


def _bag_places(train: DataFrame, group: list[str], seed: int) -> DataFrame:
    """(group, bag, y, __k): each bag once, numbered in its group by hash."""
    from pyspark.sql import Window

    bags = train.groupBy(*group, "bag").agg(F.max("y").alias("y"))
    return bags.withColumn("__k", F.row_number().over(Window.partitionBy(*group).orderBy(h(seed, "bag"), "bag")))


def _mil_rows(train: DataFrame, kept: DataFrame, group: list[str], eta: float | None) -> DataFrame:
    """The instances of the bags of kept (group, bag and further columns), scaled over the instances of all bags, with __eta, the part of all instances whose intra label is 1."""
    keys = kept.select(*[F.col(c).alias(f"__b{i}") for i, c in enumerate([*group, "bag"])], *[c for c in kept.columns if c not in (*group, "bag", "y")])
    on = [F.col(c).eqNullSafe(F.col(f"__b{i}")) for i, c in enumerate([*group, "bag"])]
    rows = train.join(F.broadcast(keys) if is_small(keys) else keys, on).drop(*[f"__b{i}" for i in range(len(group) + 1)])
    rows = _scaled(rows, train, group, "vec")
    if eta is not None:
        return rows.withColumn("__eta", F.lit(float(eta)))
    shares = train.groupBy(*group).agg(F.avg("intra").alias("__eta")) if group else train.agg(F.avg("intra").alias("__eta"))
    shares = shares.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], "__eta")
    on = [F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(group)]
    return (rows.join(F.broadcast(shares), on, "left") if group else rows.crossJoin(F.broadcast(shares))).drop(*[f"__g{i}" for i in range(len(group))])


def _bags_in(part: pd.DataFrame) -> tuple[list[np.ndarray], np.ndarray, list[np.ndarray], pd.DataFrame]:
    """The scaled bags of a task, their sides, their intra labels, and a row a bag."""
    part = part.sort_values(["bag", "pos"])
    mu, sd = _scale_in(part)
    x = (np.stack(part["vec"].to_numpy()) - mu) / sd
    starts = np.flatnonzero(np.append(True, part["bag"].to_numpy()[1:] != part["bag"].to_numpy()[:-1]))
    heads = part.iloc[starts]
    return np.split(x, starts[1:]), np.where(heads["y"].to_numpy() > 0, 1.0, -1.0), np.split(part["intra"].to_numpy(), starts[1:]), heads


def fit_mil(train: DataFrame, c: float = 1.0, eta: float | None = None, limit: int = TRAIN_LIMIT, seed: int = 42, group: list[str] | None = None) -> DataFrame:
    """One multiple-instance probe a group (group, direction, bias, mu, sd, c) of bags in long form (group, bag, pos, vec, y, intra), scaled over the instances of all bags; eta: the part of all instances whose intra label is 1. Only the solver is held to `limit` bags; a group without both sides gets a zero direction."""
    group = group or []
    rows = _mil_rows(train, _bag_places(train, group, seed).where(F.col("__k") <= limit).drop("__k"), group, eta).withColumn("__all", F.lit(0))

    def work(part: pd.DataFrame) -> dict:
        mu, sd = _scale_in(part)
        bags, y, marks, _ = _bags_in(part)
        w, b = fit_sawmil(bags, y, marks, c, float(part["__eta"].iloc[0])) if len(set(y)) == 2 else (np.zeros(len(mu)), 0.0)
        return {"direction": w.tolist(), "bias": b, "mu": mu.tolist(), "sd": sd.tolist(), "c": c}

    return _grouped(rows, [*group, "__all"], work, PROBE_SCHEMA).drop("__all")


def search_mil(train: DataFrame, group: list[str], grid: tuple[float, ...] = GRID, folds: int = 3, limit: int = FOLD_LIMIT, seed: int = 42) -> DataFrame:
    """(group, c, fold, score): average precision over the held-out bags' largest scores of each parameter and fold, each in its own task. The scaler and eta see all bags, those of the held-out fold too; the solver sees `limit` bags a fold. A fit that fails raises its error."""
    places = _bag_places(train, group, seed).where(F.col("__k") <= limit * folds // max(1, folds - 1))
    places = places.withColumn("part", F.pmod("__k", F.lit(folds)).cast("int")).drop("__k")
    rows = _mil_rows(train, places, group, None).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).withColumn("c", F.explode(F.array(*[F.lit(float(c)) for c in grid])))

    def work(part: pd.DataFrame) -> dict:
        bags, y, marks, heads = _bags_in(part)
        held = (heads["part"] == heads["fold"]).to_numpy()
        seen = np.flatnonzero(~held)
        if len(set(y[seen])) < 2:
            return {"score": 0.0}
        w, b = fit_sawmil([bags[i] for i in seen], y[seen], [marks[i] for i in seen], float(part["c"].iloc[0]), float(part["__eta"].iloc[0]))
        return {"score": average_precision_of(y[held], np.array([(bags[i] @ w + b).max() for i in np.flatnonzero(held)]))}

    return _grouped(rows, [*group, "c", "fold"], work, "score double")
