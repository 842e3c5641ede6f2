import random
from collections import Counter

from probelake.llm import sampling

ROWS = "row_id bigint, dataset string, correct boolean, object_1 string, ingested_at timestamp, u string, pool string"
TARGETS = "target_set string, dataset string, target_field string, level_name string, target_share double, min_rows int, sample_size bigint"


def statements(spark):
    rows = [(i, "d", None if i % 50 == 0 else i % 2 == 0, None if i % 97 == 0 else "" if i % 89 == 0 else "Hot" if i % 3 == 0 else f"e{i % 40}", None, "clash", "clash") for i in range(4000)]
    return spark.createDataFrame([*rows, rows[5], rows[6], (None, "d", True, "Hot", None, "", "")], ROWS)


def test_shares_and_deficits(spark):
    targets = [("a", "d", "correct", "true", 0.25, 2, 1000), ("a", "d", "correct", "false", 0.75, 2, 1000), ("b", "d", "object_1", "HÓT", 0.5, 1, 400), ("b", "d", "object_1", "e1", 0.01, 500, 400), ("b", "d", "object_1", "*", 0.49, 0, 400), ("c", "unknown", "correct", "true", 1.0, 1, 5), ("n", "d", "correct", "true", None, None, None)]
    s = sampling.statement_sample(statements(spark), spark.createDataFrame(targets, TARGETS))
    report = {(r.target_set, r.level_name): r for r in s.report.collect()}
    taken = Counter((r.target_set, r.level_name) for r in s.rows.collect())
    e1 = report["b", "e1"]
    assert e1.wanted == 500 and e1.taken == e1.available == taken["b", "e1"] < 500 and e1.deficit == 0
    above = e1.available - 4  # what e1 has above its share is taken from the others in proportion
    assert taken["a", "true"] == 250 and taken["a", "false"] == 750
    assert abs(taken["b", "HÓT"] - (200 - above * 199 / 395)) <= 1 and taken["b", "HÓT"] + taken["b", "*"] + e1.taken == 400
    assert report["c", "true"].deficit == 5 and report["n", "true"].wanted == 0
    assert len({(r.target_set, r.id) for r in s.rows.collect()}) == s.rows.count()
    hot = [r.id for r in s.rows.where("level_name = 'HÓT'").collect()]
    assert all(i % 3 == 0 for i in hot)


def test_quotas_add_up(spark):
    rng = random.Random(5)
    rows, sizes = [], {}
    for s in range(40):
        k, size = rng.randrange(1, 9), rng.randrange(0, 300)
        weights = [rng.random() ** 3 for _ in range(k)]
        sizes[f"s{s}"] = size
        rows += [(f"s{s}", f"l{i}", w / sum(weights), rng.choice([0, 0, 1, 5, 20]), size, rng.choice([0, 3, 50, 1000])) for i, w in enumerate(weights)]
    got = sampling.quotas(spark.createDataFrame(rows, "target_set string, level_name string, target_share double, min_rows int, sample_size bigint, available bigint")).collect()
    for s, size in sizes.items():
        mine = [r for r in got if r.target_set == s]
        minima = sum(min(r.min_rows, r.available) for r in mine)
        assert sum(r.quota for r in mine) == max(size, minima)
        for r in mine:
            assert r.quota >= min(r.min_rows, r.available) and r.wanted == max(r.min_rows, int(r.target_share * size + 0.5))
            assert r.quota <= max(r.min_rows, r.target_share * size + 1)


def test_taken_and_deficits_add_up_to_the_sample_size(spark, sf):
    from probelake.llm.queries import QUERIES

    per = {}
    for r in QUERIES["p2_report"](spark, sf).collect():
        per.setdefault(r.target_set, []).append(r)
    sizes = {r.target_set: r.sample_size for r in spark.read.parquet(f"{sf}/sample_targets.parquet").select("target_set", "sample_size").distinct().collect()}
    assert {s: sum(r.taken + r.deficit for r in rows) for s, rows in per.items()} == {s: max(n, sum(r.quota for r in per[s])) for s, n in sizes.items()}
    assert sum(sum(r.quota for r in per[s]) == n for s, n in sizes.items()) >= len(sizes) / 2


def test_all_of_a_level_and_empty(spark):
    targets = spark.createDataFrame([("a", "d", "correct", "true", 1.0, 1, 10**6)], TARGETS)
    r = sampling.statement_sample(statements(spark), targets).report.first()
    assert r.taken == r.available > 0
    assert sampling.statement_sample(statements(spark).limit(0), targets).report.first().deficit == 10**6
    assert sampling.statement_sample(statements(spark), targets.limit(0)).report.count() == 0
