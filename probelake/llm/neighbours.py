"""The k most similar vectors of every vector, by navigable small-world graphs per shard.

Equal vectors are put together first and searched once. Each layer is cut into cells around centres that are fitted on
a bounded sample; every vector is a member of its nearest cell and is asked against the cells whose centres are hardly
farther off: within `reach` of the nearest one's angle, `probes` at most. A cell of more than 2 * shard_rows members (a
crowded direction, or a layer of very many vectors) is cut once more around centres of its own, of which a query asks
SUB_PROBES at most, so the shards a vector is asked against do not grow with the table. Range partitions of the shards,
of about as many vectors each, bring members and queries together; a task builds a shard's graph, asks it, and drops
it. The shards' answers are merged per vector, and equal vectors are put back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probelake.session import BROADCAST_ROWS, written

#: Members of a shard as a rule, cells of a layer and of a cell at most, and vectors of a layer or cell the centres are fitted on at most.
SHARD_ROWS, MOST_CELLS, SAMPLE_ROWS = 6000, 4096, 16_384
#: Cells a vector is asked against at most, by how much their angle may exceed the nearest one's, and the parts of a cell it is asked against.
PROBES, REACH, SUB_PROBES, EF = 6, 0.1, 3, 24
#: Partitions of shards at most; a partition may hold several.
MOST_PARTITIONS = 20_000


def usable(vec: Column, dim: int) -> Column:
    """Whether vec is a vector of dim numbers, all finite and not all zero."""
    fine = ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(vec, lambda x: x != 0)
    return vec.isNotNull() & (F.size(vec) == dim) & F.coalesce(fine, F.lit(False))


def _unit(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def fit_centres(x: np.ndarray, cells: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Centres of unit length of about `cells` cells over rows of x, by spherical k-means."""
    cells = max(1, min(cells, len(x)))
    centres = x[np.random.default_rng(seed).choice(len(x), cells, replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(x[at : at + 4096] @ centres.T).argmax(1) for at in range(0, len(x), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        size = np.sqrt((sums * sums).sum(1, keepdims=True))
        centres = np.where(size > 0, sums / np.maximum(size, 1e-12), centres)
    return centres


def _near(x: np.ndarray, centres: np.ndarray, probes: int, reach: float) -> list[list[int]]:
    """For each row of x the centres within `reach` of its nearest one's angle, nearest first, probes at most."""
    sims = x @ centres.T
    best = np.argsort(-sims, axis=1, kind="stable")[:, :probes]
    angles = np.arccos(np.clip(np.take_along_axis(sims, best, 1), -1, 1))
    many = (angles <= angles[:, :1] + reach).sum(1)
    return [row[:n] for row, n in zip(best.tolist(), many.tolist())]


def _route(vectors: DataFrame, centres: dict[int, np.ndarray], dim: int, probes: int, reach: float) -> DataFrame:
    """(id, layer, vec, cells): the cells each vector is asked against, nearest first."""
    schema = T.StructType([*vectors.schema.fields, T.StructField("cells", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            layers = batch.column(1).to_numpy(zero_copy_only=False)
            x = _unit(_matrix(batch.column(2), dim)).astype(np.float32)
            cells: list[list[int]] = [[]] * len(layers)
            for layer in np.unique(layers):
                at = np.flatnonzero(layers == layer)
                for i, row in zip(at, _near(x[at], centres[int(layer)], probes, reach)):
                    cells[i] = row
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.int32()))], [*batch.schema.names, "cells"])

    return vectors.mapInArrow(run, schema)


def _parts_of_cells(routed: DataFrame, big: DataFrame, dim: int, shard_rows: int) -> DataFrame:
    """(layer, cell, centres): of each cell of big (layer, cell, n) the centres of its parts, each fitted in a task on at most SAMPLE_ROWS of the cell's members."""
    u = F.shiftrightunsigned(F.xxhash64("id", F.lit(4)), 11) / float(1 << 53)
    members = routed.select("id", "layer", F.col("cells")[0].alias("cell"), "vec").join(F.broadcast(big), ["layer", "cell"])
    drawn = members.where(u < SAMPLE_ROWS / F.col("n")).select("layer", "cell", "n", "id", "vec")

    def fit(cell: pa.Table) -> pa.Table:
        order = np.argsort(cell["id"].to_numpy())[:SAMPLE_ROWS]
        parts = max(1, min(-(-cell["n"][0].as_py() // shard_rows), MOST_CELLS, len(order) // 4))
        got = fit_centres(_unit(_matrix(cell["vec"], dim))[order], parts)
        return pa.table({"layer": cell["layer"][:1], "cell": cell["cell"][:1], "centres": pa.array([got.astype(np.float32).tolist()], pa.list_(pa.list_(pa.float32())))})

    return drawn.groupBy("layer", "cell").applyInArrow(fit, "layer int, cell int, centres array<array<float>>")


def _route_parts(asked: DataFrame, parts: DataFrame, dim: int, reach: float) -> DataFrame:
    """asked (layer, cell, id, vec, p) with part, the parts of the cell a vector is asked against, and member; cells without parts are one part."""
    rows = asked.join(parts, ["layer", "cell"], "left")
    schema = T.StructType([*asked.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("member", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _unit(_matrix(batch.column(3), dim)).astype(np.float32)
            whole = batch.column(5).is_null().to_numpy(zero_copy_only=False)
            p = batch.column(4).to_numpy(zero_copy_only=False)
            keys = np.stack([batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)], 1)
            found: list[list[int]] = [[0]] * len(x)
            there = np.flatnonzero(~whole)
            for key in np.unique(keys[there], axis=0) if len(there) else ():
                at = there[(keys[there] == key).all(1)]
                centres = np.asarray(batch.column(5)[int(at[0])].as_py(), np.float32)
                for i, row in zip(at, _near(x[at], centres, SUB_PROBES, reach)):
                    found[i] = row
            index = np.repeat(np.arange(len(x)), [len(f) for f in found])
            part = np.array([c for f in found for c in f], np.int32)
            first = np.concatenate([[True], index[1:] != index[:-1]]) if len(index) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(index)) for i in range(5)), pa.array(part), pa.array(first & (p[index] == 0))], [f.name for f in schema.fields])

    return rows.mapInArrow(run, schema)


def _search(dim: int, k: int, ef: int):
    """The work on one shard: rows (id, vec, member) to (id, found: the k nearest members by similarity)."""

    def run(shard: pa.Table) -> pa.Table:
        from probelake.llm.hnsw import Graph

        ids = shard["id"].to_numpy()
        member = shard["member"].to_numpy(zero_copy_only=False).astype(bool)
        exact = _unit(_matrix(shard["vec"], dim))
        own = np.flatnonzero(member)
        own = own[np.argsort(ids[own])]
        if not len(own):
            return pa.table({"id": pa.array([], pa.int64()), "found": pa.array([], pa.list_(FOUND))})
        x = exact.astype(np.float32)
        graph = Graph(np.ascontiguousarray(x[own]), ef=ef)
        near, _ = graph.query(x, min(k + 3, len(own)))
        sims = np.full(near.shape, -2.0)
        for at in range(0, len(near), 4096):
            part = near[at : at + 4096]
            sims[at : at + 4096] = np.einsum("qkd,qd->qk", exact[own[np.maximum(part, 0)]], exact[at : at + 4096])
        to = ids[own[np.maximum(near, 0)]]
        sims[(near < 0) | (to == ids[:, None])] = -2.0
        best = np.lexsort((to, -sims), axis=1)[:, :k]
        sims, to = np.take_along_axis(sims, best, 1), np.take_along_axis(to, best, 1)
        real = sims > -2.0
        ends = np.concatenate([[0], real.sum(1).cumsum()]).astype(np.int32)
        found = pa.StructArray.from_arrays([pa.array(sims[real]), pa.array(to[real])], fields=list(FOUND))
        return pa.table({"id": shard["id"], "found": pa.ListArray.from_arrays(pa.array(ends), found)})

    return run


FOUND = pa.struct([("sim", pa.float64()), ("to", pa.int64())])


def nearest(
    df: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embeddings",
    layer_col: str | None = "layer",
    k: int = 5,
    dim: int = 64,
    shard_rows: int = SHARD_ROWS,
    probes: int = PROBES,
    reach: float = REACH,
    ef: int = EF,
) -> DataFrame:
    """(id, near: array of (sim, to), most similar first) of every usable vector: its k most similar ones of its layer.

    Usable: not null, dim numbers, all finite, not all zero. Each id counts once (repeated rows repeat their vector),
    rows of a null id do not count, rows of a null layer are a layer of their own. The vector itself is not among
    them, equal vectors under another id are; ties go to the smaller id. A layer of one vector gives an empty array;
    an empty table gives an empty result. The centres are fitted on at most SAMPLE_ROWS vectors a layer or cell; every
    vector is indexed.
    """
    layer = F.coalesce(F.col(layer_col).cast("int"), F.lit(-(2**31))) if layer_col else F.lit(0)
    rows = df.select(F.col(id_col).cast("long").alias("id"), layer.alias("layer"), F.col(vec_col).cast("array<float>").alias("vec")).where("id is not null").where(usable(F.col("vec"), dim))
    once = rows.groupBy("id").agg(F.first(F.struct("layer", "vec")).alias("r")).select("id", "r.layer", "r.vec")
    once = written(once.withColumn("key", F.struct("layer", F.xxhash64("vec"), F.xxhash64("vec", F.lit(1)))), "vectors")

    # equal vectors: the group stands under its smallest id, and shows at most its k + 1 smallest ids
    shown = once.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("id"))).where(F.col("n") <= k + 1)
    groups = shown.groupBy("key").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    groups = written(groups.withColumn("id", F.col("ids")[0]), "groups")
    leads = once.select("id", "layer", "vec").join(groups.select("id"), "id", "left_semi")

    counts = {r.layer: r.n for r in leads.groupBy("layer").agg(F.count("*").alias("n")).collect()}
    centres: dict[int, np.ndarray] = {}
    for at, n in counts.items():
        cells = min(MOST_CELLS, -(-n // shard_rows))
        share = min(1.0, SAMPLE_ROWS / n)
        u = F.shiftrightunsigned(F.xxhash64("id", F.lit(3)), 11) / float(1 << 53)
        drawn = leads.where((F.col("layer") == at) & (u < share)).select("vec").limit(SAMPLE_ROWS).toArrow() if cells > 1 else None
        centres[at] = fit_centres(_unit(_matrix(drawn["vec"], dim)), cells).astype(np.float32) if drawn is not None and drawn.num_rows else np.ones((1, dim), np.float32)

    routed = written(_route(leads, centres, dim, probes, reach), "routed")
    size = routed.groupBy("layer", F.col("cells")[0].alias("cell")).agg(F.count("*").alias("n")).collect()  # one row a cell: MOST_CELLS a layer at most
    asked = routed.select("layer", F.posexplode("cells").alias("p", "cell"), "id", "vec").select("layer", "cell", "id", "vec", "p")
    crowded = [(r.layer, r.cell, r.n) for r in size if r.n > 2 * shard_rows]
    if crowded:
        big = df.sparkSession.createDataFrame(crowded, "layer int, cell int, n bigint")
        parts = written(_parts_of_cells(routed, big, dim, shard_rows), "parts")
        centre_rows = parts.agg(F.sum(F.size("centres")).alias("n")).first().n or 0
        asked = _route_parts(asked, F.broadcast(parts) if centre_rows <= BROADCAST_ROWS else parts, dim, reach).drop("p")
    else:
        asked = asked.withColumn("part", F.lit(0)).withColumn("member", F.col("p") == 0).drop("p")
    shards = sum(-(-r.n // shard_rows) for r in size)
    spread = asked.repartitionByRange(min(MOST_PARTITIONS, max(shards, 1)), "layer", "cell", "part")
    answers = spread.groupBy("layer", "cell", "part").applyInArrow(_search(dim, k, ef), "id bigint, found array<struct<sim:double,to:bigint>>")
    best = answers.groupBy("id").agg(F.flatten(F.collect_list("found")).alias("found"))  # at most probes * SUB_PROBES short lists
    order = lambda a, b: F.when(a["sim"] != b["sim"], F.when(a["sim"] > b["sim"], -1).otherwise(1)).when(a["to"] < b["to"], -1).when(a["to"] > b["to"], 1).otherwise(0)
    best = written(best.select("id", F.slice(F.array_sort(F.array_distinct("found"), order), 1, k).alias("found")), "answers")

    # put equal vectors back: every found group shows its ids, and a group's own ids come first
    wide = best.select("id", F.posexplode("found").alias("at", "f")).select(F.col("id").alias("lead"), "at", "f.sim", F.col("f.to").alias("to"))
    wide = wide.join(groups.select(F.col("id").alias("to"), "ids"), "to")
    listed = wide.groupBy("lead").agg(F.array_sort(F.collect_list(F.struct("at", "sim", "ids"))).alias("others"))
    pairs = F.flatten(F.transform("others", lambda o: F.transform(o["ids"], lambda i: F.struct(o["sim"].alias("sim"), i.alias("to")))))
    shared = groups.join(listed, groups["id"] == listed["lead"], "left").select(
        "key", F.concat(F.transform("ids", lambda i: F.struct(F.lit(1.0).alias("sim"), i.alias("to"))), F.coalesce(pairs, F.array().cast("array<struct<sim:double,to:bigint>>"))).alias("all")
    )
    return once.select("id", "key").join(shared, "key").select("id", F.slice(F.filter("all", lambda x: x["to"] != F.col("id")), 1, k).alias("near"))


def similar_pairs(near: DataFrame, least: float = 0.90) -> DataFrame:
    """(vec_id_a, vec_id_b), smaller first, of nearest()'s rows with a similarity of at least `least`, each pair once."""
    pairs = near.select("id", F.explode("near").alias("n")).where(F.col("n.sim") >= least)
    return pairs.select(F.least("id", "n.to").alias("vec_id_a"), F.greatest("id", "n.to").alias("vec_id_b")).distinct()
