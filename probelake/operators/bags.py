"""Bags: the vectors of one statement, one per token. Long form: bag, pos, vec (and attn)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probelake.functions.hashing import h
from probelake.functions.vectors import _c


def nonzero(vec: Column | str) -> Column:
    return F.exists(_c(vec), lambda x: x != 0)


def drop_zero(df: DataFrame, vec: str = "vec", attn: str | None = "attn") -> DataFrame:
    """Tokens under the mask with any non-zero value; without a mask, just those."""
    return df.where(nonzero(vec) & (F.col(attn) == 1)) if attn else df.where(nonzero(vec))


def mask_tail(df: DataFrame, bag: str = "bag", pos: str = "pos", mask_len: str = "mask_len", forced: int = 5) -> DataFrame:
    """Bags longer than their mask: the last mask_len tokens, the last `forced` of them unmasked (attn 1)."""
    tail = F.row_number().over(Window.partitionBy(bag).orderBy(F.desc(pos)))
    return df.withColumn("__t", tail).where(F.col("__t") <= F.col(mask_len)).withColumn("attn", F.when(F.col("__t") <= forced, 1).otherwise(F.col("attn"))).drop("__t")


def drop_like_first(df: DataFrame, bag: str = "bag", pos: str = "pos", vec: str = "vec") -> DataFrame:
    """Tokens whose summed difference from the bag's first token is not 0: what padding repeats drops out."""
    first = F.first(vec).over(Window.partitionBy(bag).orderBy(pos))
    off = F.aggregate(F.zip_with(vec, "__first", lambda x, y: x - y), F.lit(0.0), lambda s, x: s + x)
    return df.withColumn("__first", first).where(off != 0).drop("__first")


def nested(df: DataFrame, bag: str = "bag", pos: str = "pos", vec: str = "vec") -> DataFrame:
    """(bag, items): the bag's tokens (pos, vec) in order; as many as a statement has tokens."""
    return df.groupBy(bag).agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("pos"), F.col(vec).alias("vec")))).alias("items"))


def last_of(df: DataFrame, bag: str = "bag", pos: str = "pos", *columns: str) -> DataFrame:
    """(bag, pos, columns) of each bag's last token."""
    got = F.max_by(F.struct(pos, *columns), pos).alias("r")
    return df.groupBy(bag).agg(got).select(bag, "r.*")


def capped(df: DataFrame, most: int = 10, last: int = 2, seed: int = 0, bag: str = "bag", pos: str = "pos") -> DataFrame:
    """At most `most` tokens of a bag: the last `last`, and of the others a random part; new_pos is their place, the drawn ones first in drawn order."""
    w = Window.partitionBy(bag)
    from_end = F.row_number().over(w.orderBy(F.desc(pos)))
    out = df.withColumn("__e", from_end).withColumn("__n", F.count("*").over(w)).withColumn("__h", h(seed, F.concat_ws("-", bag, pos)))
    out = out.withColumn("__k", F.row_number().over(w.orderBy((F.col("__e") <= last).cast("int"), F.col("__h"), F.col(pos))))
    out = out.where((F.col("__n") <= most) | (F.col("__e") <= last) | (F.col("__k") <= most - last))
    few = F.row_number().over(w.orderBy(pos))
    many = F.row_number().over(w.orderBy((F.col("__e") <= last).cast("int"), F.when(F.col("__e") <= last, F.col(pos)).otherwise(F.col("__h")), F.col(pos)))
    return out.withColumn("new_pos", F.when(F.col("__n") <= most, few).otherwise(many)).drop("__e", "__n", "__h", "__k")


def intra_labels(df: DataFrame, known: int | None = 2, bag: str = "bag", pos: str = "pos") -> DataFrame:
    """df with intra: 1 for the bag's last `known` tokens, 0 for the others; 1 for all if known is None."""
    if known is None:
        return df.withColumn("intra", F.lit(1))
    return df.withColumn("intra", (F.row_number().over(Window.partitionBy(bag).orderBy(F.desc(pos))) <= known).cast("int"))


def eta(df: DataFrame) -> DataFrame:
    """(eta): the part of all tokens whose intra label is 1."""
    return df.agg((F.sum("intra") / F.count("*")).alias("eta"))


def splitter_counts(df: DataFrame, y: str = "y", bag: str = "bag") -> DataFrame:
    """One row of counts: bags and instances of positive and negative bags (x_p, x_n, x, l_p, l_n, l)."""
    pos, neg = F.col(y) == 1, F.col(y) == 0
    each = df.groupBy(bag, y).agg(F.count("*").alias("n"))
    return each.agg(
        F.sum(pos.cast("bigint")).alias("x_p"), F.sum(neg.cast("bigint")).alias("x_n"), F.count("*").alias("x"),
        F.sum(F.when(pos, F.col("n")).otherwise(0)).alias("l_p"), F.sum(F.when(neg, F.col("n")).otherwise(0)).alias("l_n"), F.sum("n").alias("l"),
    )


def bags_of(df: DataFrame, split: str, bag: str = "bag", pos: str = "pos", vec: str = "vec", y: str = "y", drop_zeros: bool = True) -> DataFrame:
    """(bag, items, y, last): the bags of a split, their tokens in order, their label, and the last token's vector."""
    rows = df.where(F.col("split") == split)
    rows = drop_zero(rows, vec, "attn" if "attn" in df.columns else None) if drop_zeros else rows
    labels = rows.groupBy(bag).agg(F.max(y).alias(y), F.max_by(vec, pos).alias("last"))
    return nested(rows, bag, pos, vec).join(labels, bag).select(bag, "items", y, "last")


def labelled_of(df: DataFrame, split: str, bag: str = "bag", pos: str = "pos", vec: str = "vec", y: str = "y") -> DataFrame:
    """(bag, pos, vec, y): the last token of each bag of a split, with the bag's label."""
    return last_of(df.where(F.col("split") == split), bag, pos, vec, y)


def stacked(df: DataFrame, bag: str = "bag", pos: str = "pos", y: str = "y") -> DataFrame:
    """df with place: all instances under one another, those of negative bags first, bags and tokens in order; each may count as a bag of its own."""
    from probelake.operators.ranks import ranked

    return ranked(df.withColumn("__side", (F.col(y) == 1).cast("int")), ["__side", bag, pos], "place").drop("__side")


def max_score(df: DataFrame, score: str = "score", bag: str = "bag") -> DataFrame:
    """(bag, score): the largest of the bag's scores."""
    return df.groupBy(bag).agg(F.max(score).alias(score))


def argmax_row(df: DataFrame, scores: str = "scores", bag: str = "bag", pos: str = "pos") -> DataFrame:
    """(bag, pos, scores): the row with the largest score of any class, the first token skipped, ties to the first."""
    best = F.struct(F.array_max(scores).alias("m"), (-F.col(pos)).alias("q"))
    rows = df.withColumn("__first", F.min(pos).over(Window.partitionBy(bag))).where(F.col(pos) > F.col("__first"))
    return rows.groupBy(bag).agg(F.max_by(F.struct(pos, scores), best).alias("r")).select(bag, "r.*")


def positive_cut(df: DataFrame, score: str = "score", y: str = "y", bag: str = "bag", intra: str = "intra", eta: float = 0.2, least: float = 0.05) -> DataFrame:
    """df with label: second-stage labels of instances, 1 or -1.

    Of the l_p instances of positive bags the n best are candidates, n = l_p * eta rounded half to even, within
    [x_p, l_p]; a candidate is 1 if its intra label is 1. If that leaves fewer than `least` of l_p, the intra label is
    not asked. Instances of negative bags are -1.
    """
    pos = df.where(F.col(y) == 1)
    sizes = pos.agg(F.count("*").alias("l_p"), F.countDistinct(bag).alias("x_p"))
    n = F.least(F.greatest(F.bround(F.col("l_p") * F.lit(eta)), F.col("x_p")), F.col("l_p"))
    sizes = sizes.withColumn("n", n.cast("bigint"))
    from probelake.operators.ranks import ranked

    by_score = ranked(pos.select((-F.col(score)).alias("t"), F.col(bag).alias("__b"), F.col("pos").alias("__p")), ["t", "__b", "__p"], "place")
    edge = by_score.crossJoin(F.broadcast(sizes)).where("place = n").select((-F.col("t")).alias("edge"))
    cut = df.crossJoin(F.broadcast(edge)).withColumn("__c", (F.col(y) == 1) & (F.col(score) >= F.col("edge")))
    strict = cut.agg(F.sum((F.col("__c") & (F.col(intra) == 1)).cast("bigint")).alias("hits"))
    both = cut.crossJoin(F.broadcast(strict)).crossJoin(F.broadcast(sizes.select("l_p")))
    asks = F.col("hits") >= F.lit(least) * F.col("l_p")
    return both.withColumn("label", F.when(F.col("__c") & (~asks | (F.col(intra) == 1)), 1).otherwise(-1)).drop("edge", "__c", "hits", "l_p")
