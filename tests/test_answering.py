"""Who answers questions of several constraints, and how many are compared whole."""

import random

from quadloom.operators import dialogue


def brute(questions, candidates):
    needs, has = {}, {}
    for q, x in questions:
        needs.setdefault(q, set()).add(x)
    for c, x in candidates:
        has.setdefault(c, set()).add(x)
    return sorted((q, c) for q, n in needs.items() for c, h in has.items() if n <= h and None not in n)


def test_against_brute_force(spark):
    r = random.Random(4)
    questions = [(f"q{i}", r.randrange(60)) for i in range(200) for _ in range(1 + i % 4)] + [("qn", None), ("qm", None), ("qm", 3), ("none", 999)]
    candidates = [(f"c{i}", r.randrange(60)) for i in range(120) for _ in range(1 + i % 70)] + [("cn", None), ("c1", 7), ("c1", 7)]
    got = dialogue.answering(spark.createDataFrame(questions, "q string, x long"), spark.createDataFrame(candidates, "cand string, x long"))
    want = brute(questions, [c for c in candidates if c[1] is not None])
    assert sorted(tuple(x) for x in got.collect()) == want and len(want) > 500


def test_few_are_compared_whole(spark):
    """Every candidate holds the rarest value and lacks another one, but for one."""
    candidates = [(i, x) for i in range(2000) for x in (0, 1000 + i)] + [(0, 1)] + [(i, 1) for i in range(5000, 8000)]
    found = dialogue.answering(spark.createDataFrame([(9, 0), (9, 1)], "q long, x long"), spark.createDataFrame(candidates, "cand long, x long"))
    assert [tuple(x) for x in found.collect()] == [(9, 0)]
    from pyspark.sql import functions as F

    near = spark.createDataFrame([[list(range(10))]], "has array<int>").select(dialogue._marks(F.col("has")).alias("m")).first().m
    assert near.m0 == 1023 and near.m1 == near.m2 == near.m3 == 0
