"""Mixing sources to target weights, in tokens, along a low-discrepancy schedule.

The mix is a sequence of slots of slot_tokens tokens. Slot j belongs to the source in whose interval of the cumulative
weights the golden-ratio point frac((j + 1/2) * phi) falls, so that every stretch of the mix holds each source at
nearly its share. Each source's documents are shuffled anew for every pass and cut into blocks of slot_tokens tokens;
the r-th slot of a source takes its r-th block. A source passes at most max_repeats times; a source that cannot fill
its slots leaves them empty, and the report says so.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probelake.operators.ranks import hash_unit, running_sum
from probelake.llm.tokens import TOKENIZERS, encode_corpus
from probelake.session import written

GOLDEN = 0.6180339887498949
#: Documents of a source that are ordered together, and slots that are ranked together.
BUCKET_DOCS, BUCKET_SLOTS = 2000, 65536
#: Sources that a weight table may have: its rows go to the driver, as does one row per source of the token sums.
MAX_SOURCES = 10_000


def source_key(col: Column) -> Column:
    """A source's name without case and outer spaces."""
    return F.lower(F.regexp_replace(col, r"^[\s ]+|[\s ]+$", ""))


@dataclass(frozen=True)
class Mix:
    #: slot, source, doc_id, pass, n_tokens: one row for each use of a document, in the order slot, source_rank.
    uses: DataFrame
    #: One row per source of the weights, see mix().
    report: DataFrame


def token_counts(documents: DataFrame, weights: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, key, n_tokens) of the documents whose source is one of weights."""
    keys = [r.key for r in weights.select(source_key(F.col("source")).alias("key")).distinct().limit(MAX_SOURCES + 1).collect()]
    if len(keys) > MAX_SOURCES:
        raise ValueError(f"weights have more than {MAX_SOURCES} sources")
    named = documents.select(F.struct("doc_id", source_key(F.col("source")).alias("key")).alias("id"), "text").where(F.col("id.key").isin(keys))
    return encode_corpus(named, "id", "text", tokenizer, folder, count_only=True).select("id.doc_id", "id.key", "n_tokens")


def mix_checks(made: Mix, weights: DataFrame) -> DataFrame:
    """(source, capped, once, filled): for each source whether no document is used more than max_repeats times, whether none is used twice in a pass, and whether what is placed is its target, or all that max_repeats passes give, to within its last document."""
    per_doc = made.uses.groupBy("source", "doc_id").agg(F.count("*").alias("uses"), F.countDistinct("pass").alias("passes"), F.max("n_tokens").alias("size"))
    seen = per_doc.groupBy("source").agg(F.max("uses").alias("uses"), F.bool_and(F.col("uses") == F.col("passes")).alias("once"), F.max("size").alias("longest"))
    rows = weights.select("source").join(made.report, "source", "left").join(seen, "source", "left").na.fill(0, ["uses", "longest", "placed_tokens", "max_repeats", "available_tokens"])
    due = F.least("target_tokens", (F.col("max_repeats") * F.col("available_tokens")).cast("double"))
    filled = (F.col("placed_tokens") >= due) & (F.col("placed_tokens") < due + F.greatest(F.col("longest"), F.lit(1)))
    return rows.select("source", (F.col("uses") <= F.col("max_repeats")).alias("capped"), F.coalesce("once", F.lit(True)).alias("once"), F.coalesce(filled, F.lit(False)).alias("filled"))


def mix(counts: DataFrame, weights: DataFrame, slot_tokens: int = 2048, seed: int = 17) -> Mix:
    """Combines documents to total_tokens tokens by target_share.

    counts: doc_id, key (a source's name without case and outer spaces), n_tokens. weights: source, target_share,
    max_repeats, total_tokens. Null keys, null or zero counts and sources without weights take no part; a source without
    documents is reported with nothing placed; repeated rows of counts are separate documents. Empty tables give an
    empty mix. The last block of a source ends with the document that fills it, so placed_tokens may exceed
    target_tokens by less than one document. report: source, target_share, target_tokens, available_tokens,
    max_repeats, placed_tokens, passes, actual_share (of all placed), short (what the schedule placed stays below
    target_tokens: all passes over the source do not fill it).
    """
    spark = counts.sparkSession
    counts = written(counts.where("key is not null and n_tokens > 0"), "counts")
    plan = weights.select("source", source_key(F.col("source")).alias("key"), "target_share", "max_repeats", "total_tokens")
    sums = counts.groupBy("key").agg(F.sum("n_tokens").alias("available_tokens"), F.count("*").alias("docs"))
    rows = plan.join(sums, "key", "left").na.fill(0, ["available_tokens", "docs"]).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"weights have more than {MAX_SOURCES} sources")
    low, table, slots = 0.0, [], 0
    for r in sorted(rows, key=lambda r: (r.key is None, r.key or "", r.source or "")):
        share = max(0.0, r.target_share or 0.0)
        target = share * (r.total_tokens or 0)
        cap = (r.max_repeats or 0) * r.available_tokens
        table.append((r.source, r.key, share, target, r.available_tokens, r.docs, r.max_repeats or 0, min(target, float(cap)), low, low + share))
        low += share
        slots = max(slots, -(-int(r.total_tokens or 0) // slot_tokens))
    schema = "source string, key string, target_share double, target_tokens double, available_tokens bigint, docs bigint, max_repeats int, fill double, low double, high double"
    sources = spark.createDataFrame(table, schema)

    # each source's uses: passes over its shuffled documents, as far as its target reaches
    live = sources.where("fill > 0").withColumn("passes", F.ceil(F.col("fill") / F.col("available_tokens")).cast("int"))
    used = counts.join(F.broadcast(live.select("key", "fill", "docs", "available_tokens", "passes")), "key")
    used = used.withColumn("pass", F.explode(F.sequence(F.lit(1), F.col("passes")))).withColumn("u", hash_unit(F.col("doc_id"), F.col("key"), F.col("pass"), seed))
    used = used.withColumn("bucket", F.floor(F.col("u") * F.ceil(F.col("docs") / BUCKET_DOCS)).cast("int"))
    used = running_sum(used, ["key", "pass"], "bucket", ["u", "doc_id"], "n_tokens", "in_pass").withColumn("before", F.col("in_pass") + (F.col("pass") - 1) * F.col("available_tokens")).where("before < fill")
    used = used.withColumn("block", F.floor(F.col("before") / slot_tokens)).select("key", "doc_id", "pass", "n_tokens", "before", "block")

    # slots of each source, numbered in the order of the schedule
    point = F.expr(f"(id + 0.5D) * {GOLDEN!r}D").alias("x")
    slot = spark.range(slots).select(F.col("id").alias("slot"), (point - F.floor(point)).alias("x"))
    # a source stands in every cell of the unit interval that its weights reach into: an equi-join, a few sources a cell
    scale, cells = (low if low > 0 else 1.0), 2 * len(table) + 1
    cell = lambda c: F.least(F.floor(c / scale * cells), F.lit(cells - 1)).cast("int")
    reach = live.select("key", "low", "high", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))).alias("cell"))
    slot = slot.withColumn("x", F.col("x") * scale).withColumn("cell", cell(F.col("x")))
    slot = slot.join(F.broadcast(reach), "cell").where("x >= low and x < high")
    slot = slot.withColumn("bucket", F.floor(F.col("slot") / BUCKET_SLOTS).cast("int")).withColumn("one", F.lit(1))
    slot = running_sum(slot.select("key", "slot", "bucket", "one"), ["key"], "bucket", ["slot"], "one", "block").select("key", "slot", F.col("block").cast("bigint").alias("block"))

    # a source whose slots round to fewer than its blocks puts the rest behind the last slot
    uses = used.join(slot, ["key", "block"], "left").withColumn("slot", F.coalesce("slot", F.lit(slots)))
    uses = written(uses.join(F.broadcast(live.select("key", "source")), "key").select("slot", "source", "doc_id", F.col("pass"), "n_tokens", F.col("before").alias("source_rank")), "mix")
    placed = written(uses.groupBy("source").agg(F.sum("n_tokens").alias("placed_tokens"), F.max("pass").alias("passes")), "placed")
    report = sources.join(F.broadcast(placed), "source", "left").na.fill(0, ["placed_tokens", "passes"])
    whole = placed.agg(F.sum("placed_tokens").alias("whole")).first().whole or 0
    share = F.col("placed_tokens") / float(whole) if whole else F.lit(0.0)
    short = F.col("placed_tokens") < F.col("target_tokens")
    return Mix(uses, report.select("source", "target_share", "target_tokens", "available_tokens", "max_repeats", "placed_tokens", "passes", share.alias("actual_share"), short.alias("short")))
