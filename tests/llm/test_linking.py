import random
from collections import Counter

from probelake.llm import linking

SCHEMA = "row_id bigint, object_1 string, statement string, ingested_at timestamp, dataset string, correct boolean, real_object boolean, label string, k1 string"


def table(spark, rows):
    return spark.createDataFrame([(i, o, s, None, "d", True, True, "clash", "clash") for i, o, s in rows], SCHEMA)


def components(rows):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, o, s in rows:
        for key in (("o", o), ("s", s)):
            if key[1]:
                parent[find(key)] = find(("r", i))
    groups = {}
    for i, *_ in rows:
        groups.setdefault(find(("r", i)), []).append(i)
    return {i: min(g) for g in groups.values() for i in g}


def test_chain_and_spellings(spark):
    rows = [(5, "Bö", "x y"), (3, "BO.", "other"), (9, None, "OTHER!"), (7, "", None), (8, "zed", "x-y"), (1, None, None), (6, None, "alone"), (4, None, "Alone")]
    got = {r.row_id: r.group_id for r in linking.statement_groups(table(spark, rows + [rows[0]])).collect()}
    assert got == {5: 3, 3: 3, 9: 3, 8: 3, 7: 7, 1: 1, 6: 4, 4: 4}
    assert {(r.group_id, r.row_id) for r in linking.shared_groups(linking.statement_groups(table(spark, rows))).collect()} == {(3, 5), (3, 3), (3, 9), (3, 8), (4, 6), (4, 4)}


def test_against_union_find(spark):
    rng = random.Random(3)
    rows = [(i, None if rng.random() < 0.1 else "hot" if rng.random() < 0.3 else f"o{rng.randrange(300)}", None if rng.random() < 0.1 else f"s{rng.randrange(700)}") for i in range(1, 900)]
    rows += [(1000 + i, f"chain{i}", f"link{(i + 1) // 2 if i % 2 else i // 2}") for i in range(60)]  # long paths
    assert {r.row_id: r.group_id for r in linking.statement_groups(table(spark, rows)).collect()} == components(rows)


def test_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "a bigint, b bigint")
    assert {r.label for r in linking.spread_labels(edges).collect()} == {0}


def test_splits_keep_groups(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"o{i % 500}", None) for i in range(3000)]
    plan = spark.createDataFrame([("train", 0.5), ("calibration", 0.2), ("test", 0.3)], "split string, target_share double")
    got = linking.statement_splits(table(spark, rows), plan).collect()
    by = {}
    for r in got:
        by.setdefault(r.group_id, set()).add(r.split)
    assert len(got) == 3000 and all(len(s) == 1 for s in by.values())
    share = Counter(r.split for r in got)
    assert abs(share["train"] / 3000 - 0.5) < 0.02 and abs(share["test"] / 3000 - 0.3) < 0.02


def test_labels_are_spread_alike(spark):
    rng = random.Random(8)
    rows, at = [], 0
    for g in range(400):  # some large groups of their own mixture of labels, many small ones
        for _ in range(rng.choice([1, 2, 5]) if g > 12 else rng.randrange(150, 400)):
            rows.append((at, g, "abc"[min(2, int(rng.random() ** (1 + g % 3) * 3))] if rng.random() > 0.02 else None))
            at += 1
    groups = spark.createDataFrame([(i, g) for i, g, _ in rows], "row_id bigint, group_id bigint")
    labels = spark.createDataFrame([(i, x) for i, _, x in rows if x is not None or i % 2], "row_id bigint, label string")
    plan = spark.createDataFrame([("train", 0.6), ("calibration", 0.15), ("test", 0.25)], "split string, target_share double")
    done = linking.split_groups(groups, labels, plan)
    report = linking.split_deviation(done, labels, plan).collect()
    assert {(r.split, r.label) for r in report} == {(s, x) for s in ("train", "calibration", "test") for x in ("a", "b", "c", None, "*")}
    assert all(abs(r.deviation) < 0.03 for r in report if r.label is not None), report
    assert sum(r.rows for r in report if r.label == "*") == len(rows)


def test_many_splits_are_all_there(spark):
    groups = spark.createDataFrame([(i, i) for i in range(9000)], "row_id bigint, group_id bigint")
    plan = spark.createDataFrame([(f"s{i}", 1.0) for i in range(1500)], "split string, target_share double")
    labels = spark.createDataFrame([], "row_id bigint, label string")
    assert linking.split_groups(groups, labels, plan).select("split").distinct().count() > 1450


def test_empty(spark):
    empty = table(spark, [(1, "a", "b")]).limit(0)
    plan = spark.createDataFrame([("train", 1.0)], "split string, target_share double")
    assert linking.statement_groups(empty).count() == 0
    assert linking.statement_splits(empty, plan).count() == 0
