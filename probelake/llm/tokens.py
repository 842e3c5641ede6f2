"""Encoding of a corpus with a public byte-level tokenizer, long texts in overlapping chunks.

A text up to chunk_chars characters is encoded where it is read. A longer one is cut into chunks that overlap; each
chunk is pre-tokenised on its own, and chunk i + 1 takes over from chunk i at the first place in their overlap where
both have a pre-token boundary that no context can move. The pieces between these places are encoded in parallel and
their ids joined in order, so the result equals the encoding of the whole text. Where an overlap has no such place
(a run of one character class longer than the overlap), the two chunks stay one piece.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probelake.session import spread

#: Where the vocabulary files lie, unless a call says otherwise.
TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Boundaries that hold in any context: where a letter or digit run, or a run without spaces, ends before another class.
_HARD_CUT = regex.compile(r"(?<=\p{L})(?=[^\p{L}])|(?<=\p{N})(?=[^\p{N}])|(?<=\S)(?=\s)")
CHUNK_CHARS, OVERLAP_CHARS = 8192, 1024


@lru_cache(maxsize=4)
def encoding(tokenizer: str, folder: str = TOKENIZERS) -> tiktoken.Encoding:
    """The tokenizer of a rank file; loaded once in a Python worker. Strings of special tokens are ordinary text."""
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, (Path(folder) / f"{tokenizer}.tiktoken").open("rb"))}
    return tiktoken.Encoding(tokenizer, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def _pre_tokens() -> regex.Pattern:
    return regex.compile(PATTERN)


def _lists(values: list[list[int]]) -> pa.Array:
    lengths = np.fromiter((len(v) for v in values), np.int64, len(values))
    flat = np.fromiter((x for v in values for x in v), np.int32, int(lengths.sum()))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], lengths.cumsum()]), pa.int32()), pa.array(flat, pa.int32()))


def _encode(df: DataFrame, tokenizer: str, folder: str, count_only: bool) -> DataFrame:
    """df, whose last column is __text, with ids (or n_tokens) in its place; a null or empty text has none."""
    value = T.StructField("n_tokens", T.LongType()) if count_only else T.StructField("ids", T.ArrayType(T.IntegerType()))
    schema = T.StructType([*df.schema.fields[:-1], value])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(tokenizer, folder).encode_ordinary
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for at in range(0, max(1, len(texts)), 1024):  # bounds what a batch of long texts holds as ids
                ids = [encode(t) if t else [] for t in texts[at : at + 1024]]
                made = pa.array([len(x) for x in ids], pa.int64()) if count_only else _lists(ids)
                yield pa.RecordBatch.from_arrays([*(c.slice(at, 1024) for c in batch.columns[:-1]), made], schema=None, names=[*batch.schema.names[:-1], value.name])

    return df.mapInArrow(run, schema)


def _boundaries(chunks: DataFrame, chunk_chars: int, overlap: int) -> DataFrame:
    """For each chunk (__key, i, part) the unmovable pre-token boundaries, from the text's start, in the overlap at its head and in that at its tail."""
    schema = T.StructType([chunks.schema["__key"], chunks.schema["i"], T.StructField("head", T.ArrayType(T.LongType())), T.StructField("tail", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = _pre_tokens()
        for batch in batches:
            heads, tails = [], []
            for i, part in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                starts = {m.start() for m in pattern.finditer(part)}
                base = i * chunk_chars
                heads.append([base + m.start() for m in _HARD_CUT.finditer(part, 0, min(len(part), overlap)) if m.start() in starts])
                tails.append([base + m.start() for m in _HARD_CUT.finditer(part, chunk_chars) if m.start() in starts])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))], ["__key", "i", "head", "tail"])

    return chunks.mapInArrow(run, schema)


def text_pieces(texts: DataFrame, chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """The pieces (__key, at, __text) of texts (__key, __text), cut where the chunks' pre-token boundaries resynchronise."""
    last = F.floor((F.char_length("__text") - 1) / chunk_chars).cast("int")
    chunks = texts.select("__key", F.explode(F.sequence(F.lit(0), last)).alias("i"), "__text").select(
        "__key", "i", F.substring("__text", F.col("i") * chunk_chars + 1, F.lit(chunk_chars + overlap)).alias("part")
    )
    pairs = _boundaries(chunks, chunk_chars, overlap).select(
        "__key", F.explode(F.array(F.struct(F.col("i").alias("seam"), F.col("head").alias("cuts")), F.struct((F.col("i") + 1).alias("seam"), F.col("tail").alias("cuts")))).alias("s")
    )
    met = F.array_min(F.array_intersect(F.min("s.cuts"), F.max("s.cuts")))
    seams = pairs.groupBy("__key", "s.seam").agg(F.count("*").alias("sides"), met.alias("at")).where("seam > 0 and sides = 2 and at is not null")
    starts = seams.groupBy("__key").agg(F.array_sort(F.collect_list("at")).alias("__starts"))
    cut = texts.join(starts, "__key", "left").select("__key", "__text", F.concat(F.array(F.lit(0).cast("long")), F.coalesce("__starts", F.array().cast("array<bigint>"))).alias("__starts"))
    to = F.coalesce(F.try_element_at("__starts", F.col("p") + 2), F.char_length("__text").cast("long"))
    return cut.select("__key", "__text", "__starts", F.posexplode("__starts").alias("p", "at")).select(
        "__key", "at", F.substring("__text", (F.col("at") + 1).cast("int"), (to - F.col("at")).cast("int")).alias("__text")
    )


def encode_corpus(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str = "byte_bpe_50k",
    folder: str = TOKENIZERS,
    chunk_chars: int = CHUNK_CHARS,
    overlap: int = OVERLAP_CHARS,
    count_only: bool = False,
) -> DataFrame:
    """One row (id_col, ids) for each row of df; with count_only (id_col, n_tokens).

    ids are those of the whole text without special tokens and without normalising it; a null or empty text gives an
    empty list (0 tokens). Repeated rows, null ids and ids that repeat each give their own row. Only texts longer than
    chunk_chars are shuffled, once each whatever the number of their copies.
    """
    rows = df.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").cast("string").alias("__text"))
    value = "n_tokens" if count_only else "ids"
    is_long = F.coalesce(F.char_length("__text"), F.lit(0)) > chunk_chars
    short = _encode(spread(rows.where(~is_long)), tokenizer, folder, count_only)
    long = rows.where(is_long).withColumn("__key", F.sha2("__text", 256))
    texts = long.groupBy("__key").agg(F.first("__text").alias("__text"))
    pieces = text_pieces(texts, chunk_chars, overlap).repartition("__key", "at")
    done = _encode(pieces.select("__key", "at", "__text"), tokenizer, folder, count_only)
    if count_only:
        joined = done.groupBy("__key").agg(F.sum("n_tokens").alias(value))
    else:
        ordered = F.array_sort(F.collect_list(F.struct("at", "ids")))
        joined = done.groupBy("__key").agg(F.flatten(F.transform(ordered, lambda x: x["ids"])).alias(value))
    both = short.select("__id", value).unionByName(long.select("__id", "__key").join(joined, "__key").select("__id", value))
    return both.withColumnRenamed("__id", id_col)


def decode_corpus(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """One row (id_col, text) for each row of df: the tokens' bytes put together, then read as UTF-8. An empty or null list gives an empty text; ids the tokenizer lacks and null ids raise an error."""
    schema = T.StructType([df.schema[id_col], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = encoding(tokenizer, folder).decode_bytes
        for batch in batches:
            texts = [decode(ids).decode("utf-8", "replace") if ids else "" for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return df.select(id_col, ids_col).mapInArrow(run, schema)
