"""Statistics of vector columns, as partial sums per partition: no vector is exploded, whatever its length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probelake.functions.vectors import _c


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The rows of a list column of equal lengths."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _partials(df: DataFrame, group: list[str], vec: str, gram: bool) -> DataFrame:
    """(group, n, s, q) per partition and group: count, sums, and sums of squares or the flattened Gram matrix. Null vectors do not count."""
    rows = df.select(*group, F.col(vec).cast("array<double>").alias("__v")).where("__v is not null")
    arr = T.ArrayType(T.DoubleType())
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("n", T.LongType()), T.StructField("s", arr), T.StructField("q", arr)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, list] = {}
        for batch in batches:
            x = matrix(batch.column(batch.num_columns - 1))
            keys = list(zip(*[c.to_pylist() for c in batch.columns[:-1]])) if group else [()] * len(x)
            where: dict[tuple, list[int]] = {}
            for i, key in enumerate(keys):
                where.setdefault(key, []).append(i)
            for key, at in where.items():
                part = x[at]
                got = [len(at), part.sum(0), (part.T @ part).ravel() if gram else (part * part).sum(0)]
                sums[key] = [a + b for a, b in zip(sums[key], got)] if key in sums else got
        cols = [pa.array([k[i] for k in sums], schema_arrow.field(i).type) for i in range(len(group))]
        made = [pa.array([v[0] for v in sums.values()], pa.int64()), *(pa.array([v[i].tolist() for v in sums.values()], pa.list_(pa.float64())) for i in (1, 2))]
        yield pa.RecordBatch.from_arrays([*cols, *made], [f.name for f in schema.fields])

    from pyspark.sql.pandas.types import to_arrow_schema

    schema_arrow = to_arrow_schema(schema)
    return rows.mapInArrow(run, schema)


def vector_stats(df: DataFrame, vec: str, group: list[str] | None = None) -> DataFrame:
    """(group, dim, n, mean, sd) of a vector column, dim from 0; sd is that of the population. Null vectors do not count; an empty table gives none."""
    group = group or []
    long = _partials(df, group, vec, gram=False).select(*group, "n", F.posexplode(F.arrays_zip("s", "q")).alias("dim", "z"))
    sums = long.groupBy(*group, "dim").agg(F.sum("n").alias("n"), F.sum("z.s").alias("s"), F.sum("z.q").alias("q"))
    mean = F.col("s") / F.col("n")
    return sums.select(*group, "dim", "n", mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("n") - mean * mean)).alias("sd"))


def gram_matrix(df: DataFrame, vec: str, group: list[str] | None = None) -> DataFrame:
    """(group, i, j, n, value): the sums over rows of x_i * x_j."""
    group = group or []
    long = _partials(df, group, vec, gram=True).select(*group, "n", F.size("s").alias("h"), F.posexplode("q").alias("at", "v"))
    return long.groupBy(*group, F.floor(F.col("at") / F.col("h")).cast("int").alias("i"), F.pmod("at", "h").cast("int").alias("j")).agg(F.sum("n").alias("n"), F.sum("v").alias("value"))


def as_arrays(stats: DataFrame, group: list[str], **columns: Column) -> DataFrame:
    """One row a group with arrays of the columns over the dims, in order."""
    packed = F.array_sort(F.collect_list(F.struct("dim", *[c.alias(n) for n, c in columns.items()])))  # as many as a vector has dims
    return stats.groupBy(*group).agg(packed.alias("__p")).select(*group, *[F.col(f"__p.{n}").alias(n) for n in columns])


def standardised(vec: Column | str, mu: Column | str, sd: Column | str) -> Column:
    """(x - mu) / sd, a sd of 0 counting as 1."""
    away = F.zip_with(_c(vec), _c(mu), lambda x, m: x - m)
    return F.zip_with(away, _c(sd), lambda x, s: x / F.when(s == 0, 1.0).otherwise(s))
