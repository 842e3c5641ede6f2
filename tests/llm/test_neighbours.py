import numpy as np
import pytest
from probelake.llm import neighbours
from probelake.llm.hnsw import Graph

SCHEMA = "vec_id bigint, layer int, embeddings array<float>, id string, cells string"


def brute(rows, k):
    out = {}
    for layer in {r[1] for r in rows}:
        own = sorted(r for r in rows if r[1] == layer)
        x = np.array([r[2] for r in own], float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        s = x @ x.T
        for i, r in enumerate(own):
            order = sorted((j for j in range(len(own)) if j != i), key=lambda j: (-round(s[i, j], 9), own[j][0]))[:k]
            out[r[0]] = [(own[j][0], s[i, j]) for j in order]
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 8))
    out = []
    for i in range(900):
        v = (centres[i % 30 if i % 3 else 0] + 0.2 * rng.normal(size=8)) * rng.uniform(0.5, 3)  # a third about one direction
        out.append((i, i % 2, np.float32(v).tolist(), "x", "y"))
    for i in range(900, 930):
        out.append((i, 0, out[0][2], "x", "y"))  # a group of equal vectors
    return out


def test_against_brute_force(spark, rows):
    dirty = [(2000, 0, None, "x", "y"), (2001, 0, [0.0] * 8, "x", "y"), (2002, 0, [1.0] * 7, "x", "y"), (2003, 0, [float("nan")] * 8, "x", "y"), (None, 0, [1.0] * 8, "x", "y"), rows[5]]
    df = spark.createDataFrame(rows + dirty, SCHEMA)
    want = brute(rows, 5)
    got = {r.id: [(n.to, n.sim) for n in r.near] for r in neighbours.nearest(df, dim=8, shard_rows=60, probes=4).collect()}
    assert got.keys() == want.keys()
    hits = sum(len({a for a, _ in got[i]} & {a for a, _ in want[i]}) for i in want)
    assert hits >= 0.95 * sum(len(x) for x in want.values())
    assert [a for a, _ in got[905]] == [0, 900, 901, 902, 903] and all(abs(s - 1) < 1e-6 for _, s in got[905])
    pairs = neighbours.similar_pairs(neighbours.nearest(df, dim=8, shard_rows=60, probes=4), 0.9).collect()
    assert all(p.vec_id_a < p.vec_id_b for p in pairs) and len(pairs) == len(set(pairs))


def test_crowded_cells_are_cut_again(spark, rows, monkeypatch):
    monkeypatch.setattr(neighbours, "MOST_CELLS", 3)  # three cells a layer, three parts a cell: beyond one level of cells
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows, 5)
    got = {r.id: [n.to for n in r.near] for r in neighbours.nearest(df, dim=8, shard_rows=60).collect()}
    assert got.keys() == want.keys()
    assert sum(len(set(got[i]) & {a for a, _ in want[i]}) for i in want) >= 0.9 * sum(len(x) for x in want.values())


def test_cells_within_reach_of_the_nearest():
    centres = np.array([[1, 0], [np.cos(0.3), np.sin(0.3)], [np.cos(0.5), np.sin(0.5)], [0, 1]])
    x = np.array([[1, 0], [np.cos(0.2), np.sin(0.2)], [0, 1]])
    assert neighbours._near(x, centres, 4, 0.15) == [[0], [1, 0], [3]] and neighbours._near(x, centres, 1, 9.0) == [[0], [1], [3]]


def test_small_and_empty(spark):
    one = spark.createDataFrame([(1, None, [1.0, 0.0], "", ""), (2, 3, [1.0, 0.0], "", "")], SCHEMA)
    assert {r.id: r.near for r in neighbours.nearest(one, dim=2).collect()} == {1: [], 2: []}
    assert neighbours.nearest(one.limit(0), dim=2).count() == 0


def test_graph_recall():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = Graph(x, ef=64)
    assert len(g.levels) >= 1 and all(level.links.dtype == np.int32 for level in g.levels)
    ids, _ = g.query(x[:500], 10)
    true = np.argsort(-(x[:500] @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(ids.tolist(), true.tolist())]) >= 0.9
