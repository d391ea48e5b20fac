"""Set containment: small sets are compared where they meet, large ones by fetching both."""

import random

import pytest

from quadloom.operators import retrieve


@pytest.mark.parametrize("carried", [64, 3, 0])
@pytest.mark.parametrize("share", [1.0, 0.6])
def test_subsets(spark, monkeypatch, carried, share):
    monkeypatch.setattr(retrieve, "CARRIED", carried)
    r = random.Random(7)
    sets = {c: {r.randrange(9) for _ in range(r.randrange(1, 7))} for c in range(25)}
    rows = spark.createDataFrame([(c, x) for c, xs in sets.items() for x in xs], "c long, x long")
    want = sorted((a, b) for a in sets for b in sets if a != b and len(sets[a] & sets[b]) * 1000 >= len(sets[a]) * round(share * 1000))
    assert sorted(map(tuple, retrieve.subsets(rows, share).collect())) == want


def test_candidates_are_not_shuffled(spark):
    rows = spark.createDataFrame([(1, 1), (2, 1), (2, 2)], "c long, x long")
    plan = retrieve.subsets(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1
