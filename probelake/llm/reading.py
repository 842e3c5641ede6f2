"""Reading level of documents, by harmonic propagation over a document-word graph.

Documents and graded examples are linked to the words they hold, a link weighing as much as the word is rare. The
examples are clamped at the level of their band (0 easy, 0.5 medium, 1 hard). Round by round a word takes the mean of
its documents' levels and a document the weighted mean of its words'. The examples of a word together count as much as
GRIP of its documents, so their say does not fade as the corpus grows, and every word hears the middle level with the
weight of GROUND of its documents, so what no path links to an example stays in the middle and no level drifts on: the
largest change that a round would still make, over 1 - 1 / (1 + GROUND), bounds how far any level is from its rest. The
rounds are Chebyshev's, which need the root of the rounds of plain ones, and end when that bound is at most `still`. A
word of a single document would always repeat that document's level and is left out. The cuts between bands lie midway
between the mean levels that the examples would have without being clamped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probelake.llm.prose import message_of, prose_words
from probelake.session import spread, written

#: The bands and where they are clamped.
BANDS = {"easy": 0.0, "medium": 0.5, "hard": 1.0}
#: Words up to which their levels go to the tasks as one array; beyond it each round joins them instead.
MOST_WORDS = 1_000_000
#: How much the examples of a word count, as a part of its documents.
GRIP = 0.5
#: How much the middle level counts for a word, as a part of its documents, and that level.
GROUND, MIDDLE = 0.05, 0.5
#: Rounds at most: levels that have not come to rest by then raise an error.
MOST_ROUNDS = 400
#: Graded examples at most: they go to the driver.
MOST_ANCHORS = 10_000
LEAST_WORDS = 40


@dataclass(frozen=True)
class Reading:
    #: See reading_levels().
    levels: DataFrame
    #: Rounds it took, how far a word may still be from its level at rest, and the number of shared words.
    rounds: int
    residue: float
    words: int


class _Rounds:
    """Chebyshev's steps for x = Gx + b with the eigenvalues of G from 0 to 1 / (1 + GROUND), and when they may end."""

    def __init__(self, still: float, most: int):
        reach = 1 / (1 + GROUND)
        self.still, self.most, self.rounds, self.residue = still, most, 0, float("inf")
        self.pace, self.mu, self.omega, self.left = 2 / (2 - reach), reach / (2 - reach), 1.0, 1 - reach

    def step(self) -> float:
        """The weight of the next step; the next x is x_before + weight * (pace * (Gx + b - x) + x - x_before)."""
        self.rounds += 1
        if self.rounds > 1:
            self.omega = 1 / (1 - self.mu**2 / 2) if self.rounds == 2 else 1 / (1 - self.mu**2 * self.omega / 4)
        return self.omega

    def rest(self, change: float) -> bool:
        """Whether levels are at rest where the largest |Gx + b - x| is change; too many rounds raise an error."""
        self.residue = change / self.left
        if self.residue <= self.still:
            return True
        if self.rounds >= self.most:
            raise RuntimeError(f"levels may still be off by {self.residue} after {self.rounds} rounds")
        return False


def word_sets(documents: DataFrame, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    """(id, keep, prose, words): the number of words of running prose in the message, and the distinct words of it, or of the subject where there is no prose. One row for each row of documents; a null or blank text has none."""
    schema = T.StructType([documents.schema[id_col], *[documents.schema[c] for c in keep], T.StructField("prose", T.IntegerType()), T.StructField("words", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, sets = [], []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                subject, body = message_of(text) if text else ("", [])
                words = prose_words(body)
                counts.append(len(words))
                sets.append(sorted(set(words or prose_words([subject]))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int32()), pa.array(sets, pa.list_(pa.string()))], [f.name for f in schema.fields])

    return spread(documents.select(id_col, *keep, text_col)).mapInArrow(run, schema)


def _by_array(sets: DataFrame, vocabulary: DataFrame, anchors: list[tuple[float, list[str]]], rounds: _Rounds, grip: float) -> tuple[DataFrame, list[float]]:
    """(columns of sets, level), and the examples' free levels; the words' levels travel as one array."""
    rows = vocabulary.orderBy("word").collect()
    place = {r.word: i for i, r in enumerate(rows)}
    weight = np.array([r.weight for r in rows])
    sc = sets.sparkSession.sparkContext
    places, weights = sc.broadcast(place), sc.broadcast(weight)
    numbered = T.StructType([T.StructField("uid", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = places.value
        for batch in batches:
            ids = [[at[w] for w in words if w in at] for words in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["uid", "ids"])

    links = written(sets.select("uid", "words").mapInArrow(number, numbered), "links")
    clamped = [(level, np.array([place[w] for w in words if w in place], np.int64)) for level, words in anchors]

    def levels_of(levels: np.ndarray, owner: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
        w = weights.value[ids]
        total = np.bincount(owner, w, n)
        return np.where(total > 0, np.bincount(owner, w * levels[ids], n) / np.where(total > 0, total, 1), np.nan)

    def split(column: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
        ids = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        return np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy())), ids, len(column)

    fixed, count = np.zeros(len(rows)), np.zeros(len(rows))
    for level, ids in clamped:
        fixed[ids] += level
        count[ids] += 1
    levels, before = np.full(len(rows), MIDDLE), np.full(len(rows), MIDDLE)
    while True:
        now = sc.broadcast(levels)

        def gather(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            sums, hits = np.zeros(len(now.value)), np.zeros(len(now.value))
            for batch in batches:
                owner, ids, n = split(batch.column(0))
                own = levels_of(now.value, owner, ids, n)[owner]
                sums += np.bincount(ids, own, len(sums))
                hits += np.bincount(ids, minlength=len(sums))
            at = np.flatnonzero(hits)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at]), pa.array(hits[at])], ["word", "s", "n"])

        got = links.select("ids").mapInArrow(gather, "word bigint, s double, n double").groupBy("word").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).toArrow()
        sums, hits = np.zeros(len(rows)), np.zeros(len(rows))
        at = got["word"].to_numpy()
        sums[at] += got["s"].to_numpy()
        hits[at] += got["n"].to_numpy()
        hold = np.where(count > 0, np.maximum(count, grip * hits) / np.maximum(count, 1), 0.0)  # what one example of the word counts
        change = (sums + hold * fixed + GROUND * hits * MIDDLE) / (hits * (1 + GROUND) + hold * count) - levels
        now.unpersist()
        if rounds.rest(float(np.abs(change).max(initial=0.0))):
            break
        weight = rounds.step()
        levels, before = before + weight * (rounds.pace * change + levels - before), levels
    last = sc.broadcast(levels)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = levels_of(last.value, *split(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, from_pandas=True)], ["uid", "level"])

    free = [float(levels_of(levels, np.zeros(len(ids), np.int64), ids, 1)[0]) for _, ids in clamped]
    return links.mapInArrow(apply, "uid bigint, level double"), free


def _by_join(sets: DataFrame, vocabulary: DataFrame, anchors: list[tuple[float, list[str]]], rounds: _Rounds, grip: float) -> tuple[DataFrame, list[float]]:
    """As _by_array, the words' levels being a table."""
    spark = sets.sparkSession
    links = written(sets.select("uid", F.explode("words").alias("word")).join(vocabulary, "word"), "links")
    rows = [(i, w, level) for i, (level, words) in enumerate(anchors) for w in words]
    graded = written(spark.createDataFrame(rows, "anchor int, word string, level double").join(vocabulary, "word"), "graded")
    fixed = written(graded.groupBy("word").agg(F.sum("level").alias("s"), F.count("*").cast("double").alias("n")), "fixed")
    levels = written(vocabulary.select("word", F.lit(MIDDLE).alias("level"), F.lit(MIDDLE).alias("before")), "levels")

    def of(table: DataFrame, key: str, levels: DataFrame) -> DataFrame:
        return table.select(key, "word", "weight").join(levels.select("word", "level"), "word").groupBy(key).agg((F.sum(F.col("weight") * F.col("level")) / F.sum("weight")).alias("level"))

    while True:
        heard = links.join(of(links, "uid", levels), "uid").groupBy("word").agg(F.sum("level").alias("s"), F.count("*").cast("double").alias("n"))
        both = levels.join(heard, "word", "left").join(fixed.select("word", F.col("s").alias("fs"), F.col("n").alias("fn")), "word", "left").na.fill(0.0, ["s", "n", "fs", "fn"])
        hold = F.when(F.col("fn") > 0, F.greatest(F.col("fn"), grip * F.col("n")) / F.col("fn")).otherwise(0.0)
        heard = (F.col("s") + hold * F.col("fs") + GROUND * MIDDLE * F.col("n")) / (F.col("n") * (1 + GROUND) + hold * F.col("fn"))
        both = written(both.select("word", "level", "before", (heard - F.col("level")).alias("change")), "levels")
        if rounds.rest(both.agg(F.max(F.abs("change")).alias("m")).first().m or 0.0):
            break
        weight = rounds.step()
        levels = both.select("word", (F.col("before") + weight * (rounds.pace * F.col("change") + F.col("level") - F.col("before"))).alias("level"), F.col("level").alias("before"))
    free = {r.anchor: r.level for r in of(graded, "anchor", levels).collect()}
    return of(links, "uid", levels), [free.get(i, float("nan")) for i in range(len(anchors))]


def reading_levels(documents: DataFrame, anchors: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, **settings) -> DataFrame:
    """The levels of read(), which has the same settings."""
    return read(documents, anchors, id_col, text_col, keep, **settings).levels


def read(
    documents: DataFrame,
    anchors: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: list[str] | None = None,
    rounds: int = MOST_ROUNDS,
    still: float = 0.002,
    grip: float = GRIP,
    most_words: int = MOST_WORDS,
) -> Reading:
    """(id, keep, prose, level, band) of each row of documents: level from 0 (easy) to 1 (hard), its band, and the number of words of running prose in the message; with the rounds it took and what the levels may still be off.

    anchors: band (easy, medium or hard; others and null texts do not count), text. A document without words has a
    null level and band, as has every document where there are no examples; one whose words no path links to an example
    takes the middle level, and one that shares no word with another the mean level. Repeated rows count as documents of their own. Empty tables give an empty result. Levels that
    are not at rest, to within `still`, after `rounds` rounds raise an error.
    """
    keep = keep or []
    graded = [(BANDS[r.band], sorted(set(prose_words(r.text.split("\n"))))) for r in anchors.where(F.col("band").isin(*BANDS)).where("text is not null").select("band", "text").limit(MOST_ANCHORS + 1).collect()]
    if len(graded) > MOST_ANCHORS:
        raise ValueError(f"there are more than {MOST_ANCHORS} graded examples")
    graded = [g for g in graded if g[1]]
    sets = written(word_sets(documents, id_col, text_col, keep).withColumn("uid", F.monotonically_increasing_id()), "sets")
    total = sets.count() + len(graded)
    extra = documents.sparkSession.createDataFrame([(w,) for _, words in graded for w in words], "word string")
    shared = sets.select(F.explode("words").alias("word")).unionByName(extra).groupBy("word").agg(F.count("*").alias("df")).where("df > 1")
    vocabulary = written(shared.select("word", F.log(1 + total / F.col("df")).alias("weight")), "vocabulary")
    way = _by_array if vocabulary.limit(most_words + 1).count() <= most_words else _by_join
    if not graded:
        nothing = F.lit(None)
        return Reading(sets.select(id_col, *keep, "prose", nothing.cast("double").alias("level"), nothing.cast("string").alias("band")), 0, 0.0, vocabulary.count())
    steps = _Rounds(still, rounds)
    found, free = way(sets, vocabulary, graded, steps, grip)
    found = written(found, "found")
    means = {b: np.nanmean(x) for b, at in BANDS.items() if (x := [f for f, (level, _) in zip(free, graded) if level == at and f == f])}
    mean = F.lit(found.agg(F.avg(F.when(~F.isnan("level"), F.col("level"))).alias("m")).first().m).cast("double")
    level = F.when(F.size("words") > 0, F.coalesce("level", mean))
    band = F.lit(None).cast("string")
    order = [b for b in BANDS if b in means]
    for i in range(len(order) - 1, -1, -1):
        upper = (means[order[i]] + means[order[i + 1]]) / 2 if i + 1 < len(order) else float("inf")
        band = F.when(level < upper, order[i]).otherwise(band)
    levels = sets.join(found, "uid", "left").select(id_col, *keep, "prose", level.alias("level"), band.alias("band"))
    return Reading(levels, steps.rounds, steps.residue, vocabulary.count())


def commit_bands(documents: DataFrame, anchors: DataFrame) -> DataFrame:
    """(doc_id, band) of the documents in English whose message has at least LEAST_WORDS words of running prose."""
    levels = reading_levels(documents, anchors, keep=["lang"])
    return levels.where((F.col("lang") == "en") & (F.col("prose") >= LEAST_WORDS)).select("doc_id", "band")
