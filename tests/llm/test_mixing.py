from probelake.llm import mixing

WEIGHTS = "source string, target_share double, max_repeats int, total_tokens bigint"


def test_shares_and_shortfalls(spark):
    counts = spark.createDataFrame([(i, "a", 10) for i in range(3000)] + [(10_000 + i, "b", 7) for i in range(100)] + [(None, "b", 5), (20_000, None, 50), (20_001, "c", 0)], "doc_id bigint, key string, n_tokens bigint")
    weights = spark.createDataFrame([(" A ", 0.5, 1, 10_000), ("b", 0.3, 2, 10_000), ("c", 0.2, 3, 10_000)], WEIGHTS)
    m = mixing.mix(counts, weights, slot_tokens=100)
    report = {r.source: r for r in m.report.collect()}
    assert not report[" A "].short and report[" A "].placed_tokens == 5000
    assert report["b"].short and report["b"].placed_tokens == 2 * 705 and report["b"].passes == 2
    assert report["c"].short and report["c"].placed_tokens == 0
    assert abs(sum(r.actual_share for r in report.values()) - 1) < 1e-9
    uses = m.uses.collect()
    per = {}
    for u in uses:
        per[u.source, u.doc_id, u["pass"]] = per.get((u.source, u.doc_id, u["pass"]), 0) + 1
    assert max(per.values()) == 1
    half = [u for u in uses if u.slot < 50 and u.source == " A "]
    assert abs(sum(u.n_tokens for u in half) - 2500) <= 200  # every stretch holds the share


def test_sources_without_case_and_spaces(spark):
    docs = spark.createDataFrame([(1, "one two", " A"), (2, "three", "a "), (3, None, "a"), (4, "x", None), (5, "y", "other")], "doc_id bigint, text string, source string")
    weights = spark.createDataFrame([("a", 1.0, 1, 3)], WEIGHTS)
    counts = mixing.token_counts(docs, weights)
    assert {(r.doc_id, r.n_tokens) for r in counts.collect()} == {(1, 2), (2, 1), (3, 0)}
    assert mixing.mix(counts, weights).report.first().placed_tokens == 3


def test_empty(spark):
    counts = spark.createDataFrame([], "doc_id bigint, key string, n_tokens bigint")
    weights = spark.createDataFrame([("a", 1.0, 1, 100)], WEIGHTS)
    assert mixing.mix(counts, weights).report.first().short
    assert mixing.mix(counts, weights.limit(0)).report.count() == 0
