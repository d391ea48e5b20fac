"""Overlaps and containment without pairing all that lies near, and dictionary hits without sending n-grams to the driver."""

from quadloom.operators import spans

SCHEMA = "key long, start int, end int"


def test_containment_is_not_joined(spark):
    rows = spark.createDataFrame([(1, 1, 3), (1, 1, 4), (1, 2, 4), (1, 2, 4), (1, 6, 8), (2, 1, 3)], SCHEMA)
    left = spans.without_subsets(rows, ["key"])
    assert "Join" not in left._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, left.collect())) == [(1, 1, 4), (1, 6, 8), (2, 1, 3)]
    assert sorted(map(tuple, spans.inside_another(rows, ["key"]).collect())) == [(1, 1, 3), (1, 2, 4)]


def test_each_overlap_once(spark):
    rows = spark.createDataFrame([(1, 1, 9), (1, 2, 9), (1, 2, 5), (1, 9, 11)], SCHEMA)
    assert sorted(map(tuple, spans.overlapping(rows, ["key"]).collect())) == [(1, 1, 9, 2, 5), (1, 1, 9, 2, 9), (1, 2, 5, 2, 9)]
    assert "Aggregate" not in spans.overlapping(rows, ["key"])._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]


def test_ngrams_are_not_broadcast(spark):
    rows = spark.createDataFrame([(1, ["a", "b", "c"])], "key long, toks array<string>")
    hits = spans.gazetteer(rows, ["key"], "toks", spark.createDataFrame([("b c",)], "phrase string"), [2, 3])
    assert "Broadcast" not in hits._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in hits.collect()] == [(1, "b c", 2, 4)]


def test_single_spans_stay_in_spark(spark):
    """A span without overlaps isn't sent to Python."""
    many = spark.range(1000).selectExpr("id AS key", "1 AS start", "3 AS end")
    kept = spans.greedy(many, ["key"])
    assert "FlatMapGroupsInPandas" not in kept._jdf.queryExecution().executedPlan().toString()
    assert kept.count() == 1000
