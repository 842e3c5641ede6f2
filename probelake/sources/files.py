"""Readers and writers of statement files, checked lists, dictionaries, vectors and artefacts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from probelake.sources.schemas import CHECKED, DEFINITION


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """A CSV with a header, by declared schema or inferred, only the columns asked for. Quoted commas, doubled quotes, line ends of either kind and a byte-order mark are understood."""
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).option("encoding", "UTF-8")
    df = reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)
    df = df.toDF(*[c.lstrip("\ufeff") for c in df.columns])
    return df.select(*columns) if columns else df


def read_checked(spark: SparkSession, path: str) -> DataFrame:
    """(name): the names of a checked list whose Keep is 1; further columns may follow."""
    df = read_csv(spark, path, T.StructType([*CHECKED.fields, T.StructField("rest", T.StringType())]))
    return df.where("Keep = 1").select(F.regexp_replace("Name", "^\ufeff", "").alias("name"))


def write_csv(df: DataFrame, path: str, lists: Sequence[str] = ()) -> None:
    """df as CSV with a header, list columns joined by ", "."""
    df.withColumns({c: F.array_join(c, ", ") for c in lists}).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None, lines: bool = True) -> DataFrame:
    """JSON records, one a line, or unless lines in a list over any number of lines."""
    reader = spark.read.option("multiLine", not lines)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_lines(df: DataFrame, column: str, path: str) -> None:
    """The column's values as lines of text; nulls are left out."""
    df.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def union_columns(frames: Sequence[DataFrame]) -> list[str]:
    """The names of all columns, sorted; no job runs."""
    return sorted({c for f in frames for c in f.columns})


def assembled(frames: Sequence[DataFrame], flags: Sequence[str] = ("correct", "negation", "real_object"), renames: dict[str, str] | None = None) -> DataFrame:
    """The frames under one another: columns of all, sorted, flags as int; a column a frame lacks is 0.0 in its rows, or false, 0 or empty text by the type it has elsewhere. Nulls that a frame has stay null."""
    renames = {"negated": "negation"} if renames is None else renames
    named = [f.withColumnsRenamed({a: b for a, b in renames.items() if a in f.columns and b not in f.columns}) for f in frames]
    named = [f.withColumns({c: F.col(c).cast("int") for c in flags if c in f.columns}) for f in named]
    types: dict[str, T.DataType] = {}
    for f in named:
        for field in f.schema.fields:
            types.setdefault(field.name, field.dataType)
    fill = lambda t: F.lit(0.0).cast(t) if isinstance(t, T.NumericType | T.StringType) else F.lit(None).cast(t)
    full = [f.select(*[F.col(c) if c in f.columns else fill(types[c]).alias(c) for c in union_columns(named)]) for f in named]
    out = full[0]
    for f in full[1:]:
        out = out.unionByName(f)
    return out


def with_scores(frame: DataFrame, scores: DataFrame, key: str = "row_id", column: str = "scores", options: int = 4) -> DataFrame:
    """frame with scores_0, scores_1 and so on from an array column of scores, null where there is none; a key that repeats in scores counts once, by its smallest array."""
    once = scores.groupBy(key).agg(F.min(column).alias("__s"))
    return frame.join(once, key, "left").select(*frame.columns, *[F.get("__s", F.lit(i)).alias(f"scores_{i}") for i in range(options)])


def flattened_dictionary(df: DataFrame, word: str = "word", body: str = "body") -> DataFrame:
    """(word, frequency, definition, partOfSpeech, synonyms, typeOf, instanceOf) of JSON entries, a row a definition.

    definitions may be a list or one object, frequency a number or an object with zipf; entries that cannot be read, or
    have no definition, give no row.
    """
    many = F.from_json(F.get_json_object(body, "$.definitions"), T.ArrayType(DEFINITION))
    one = F.array(F.from_json(F.get_json_object(body, "$.definitions"), DEFINITION))
    raw = F.get_json_object(body, "$.definitions")
    freq = F.coalesce(F.get_json_object(body, "$.frequency.zipf"), F.get_json_object(body, "$.frequency")).try_cast("double")
    parsed = df.where(raw.isNotNull()).select(F.col(word).alias("word"), freq.alias("frequency"), F.explode(F.when(F.substring(F.ltrim(raw), 1, 1) == "[", many).otherwise(one)).alias("d"))
    return parsed.select("word", "frequency", "d.*").where("definition is not null")


def write_vectors(df: DataFrame, path: str) -> None:
    """Vectors in long form by layer: readers of one layer touch its files only."""
    df.write.mode("overwrite").partitionBy("layer").parquet(path)


def read_vectors(spark: SparkSession, path: str, layers: Sequence[int] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.where(F.col("layer").isin(*layers)) if layers is not None else df


def write_probes(df: DataFrame, path: str) -> None:
    """Probe artefacts, a row a trial and layer; only the partitions (trial_id, layer) of df are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("trial_id", "layer").parquet(path)


def layers_in(spark: SparkSession, path: str, pattern: str = r"layer=(\d+)") -> DataFrame:
    """(layer): the layers that files under path belong to, by their names."""
    names = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path").distinct()
    found = F.regexp_extract("path", pattern, 1)
    return names.where(found != "").select(found.cast("int").alias("layer")).distinct()


def inferred(rows: DataFrame, infer, schema: str) -> DataFrame:
    """The place a model plugs in: infer maps an iterator of pandas frames to frames of the schema; no model is part of this repository."""
    return rows.mapInPandas(infer, schema)


def columns_in_order(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """df's columns of order, in that order; names it lacks are left out."""
    return df.select(*[F.col(f"`{c}`") for c in order if c in df.columns])


def write_scores(df: DataFrame, path: str, model: str = "model") -> None:
    """Scores (row_id, model, scores, target) of zero-shot runs, a folder a model; only the models of df are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(model).parquet(path)


def ensure_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table at path; where there is none, an empty one of the schema is written first. A table of other columns or types raises an error."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        spark.createDataFrame([], schema).write.parquet(path)
    found = spark.read.parquet(path)
    if [(f.name, f.dataType) for f in found.schema.fields] != [(f.name, f.dataType) for f in schema.fields]:
        raise ValueError(f"the table at {path} has other columns")
    return found


def save_batch(scores: DataFrame, path: str, batch: int) -> None:
    """A batch's scores as part of a run that can be resumed; a batch that is written again replaces its own rows."""
    scores.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def load_batches(spark: SparkSession, path: str) -> tuple[DataFrame | None, int]:
    """(scores so far, the next batch); (None, 0) where nothing is stored."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return None, 0
    done = spark.read.parquet(path)
    return done, (done.agg(F.max("batch").alias("b")).first().b or 0) + 1


def mapped(df: DataFrame, out: str, f, kind: str, *columns: str) -> DataFrame:
    """df with out: a plain function of one value, or of a dict where several columns are named, applied in Arrow batches; the place for taggers and the like that no column function can express. Nulls are passed on."""
    returns = F.pandas_udf(lambda s: s.map(f) if len(columns) == 1 else s.apply(lambda row: f(dict(row)), axis=1), kind)
    return df.withColumn(out, returns(F.col(columns[0]) if len(columns) == 1 else F.struct(*columns)))


class NpySource(DataSource):
    """spark.read.format("npy"): matrices in .npy files, a row each: file, row, vec. Options: path (a file or a folder on a mount that all executors share), rows (of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "file string, row bigint, vec array<float>"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return NpyReader(self.options)


class NpyReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.rows = options["path"], int(options.get("rows", 65536))

    def partitions(self) -> list[InputPartition]:
        import os

        import numpy as np

        files = [self.path] if os.path.isfile(self.path) else sorted(os.path.join(self.path, f) for f in os.listdir(self.path) if f.endswith(".npy"))
        return [InputPartition((f, at)) for f in files for at in range(0, len(np.load(f, mmap_mode="r")), self.rows)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import numpy as np

        file, at = partition.value
        for i, v in enumerate(np.load(file, mmap_mode="r")[at : at + self.rows]):
            yield file, at + i, [float(x) for x in np.ravel(v)]
