"""Clustering against plain Python, whole numbers throughout."""

import hashlib
import math

import numpy as np
import pytest

from quadloom.llm import centroids


def brute(rows, dim, k, rounds, seed=3):
    v = [(i, [math.floor(1024 * x) for x in e]) for i, e in rows if e is not None and len(e) == dim and all(x is not None and math.isfinite(x) for x in e)]
    name = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1])
    places = [q for _, q in sorted(v, key=name)[:k]]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), n) for n, c in enumerate(places))
    for _ in range(rounds):
        of = [near(q)[1] for _, q in v]
        for n in range(len(places)):
            mine = [q for (_, q), c in zip(v, of, strict=True) if c == n]
            if mine:
                places[n] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    last = [(i, *near(q)) for i, q in v]
    cap = lambda x: min(x, (1 << 63) - 1)
    total = {n: sum(d for _, d, c in last if c == n) for n in range(len(places))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in places]
    return sorted(((i, c, cap(d), cap(total[c]), cap(sum(total.values())), digest[c]) for i, d, c in last), key=repr)


@pytest.mark.parametrize("large,k,rounds", [(0, 4, 3), (1, 4, 3), (2, 5, 10), (0, 90, 2)])
def test_against_plain_python(spark, large, k, rounds):
    rng = np.random.default_rng(large)
    dim = 6
    rows = [(i, [float(x) for x in rng.normal(size=dim) * (1e9 if large == 2 and i % 9 == 0 else 3e5 if large else 1)]) for i in range(60)]
    rows += [rows[3], rows[3], (7, [0.5] * dim), (8, [0.25] * dim), (None, [0.125] * dim), (100, None), (101, [None] * dim), (102, [float("nan"), *[0.0] * (dim - 1)]), (103, [float("inf")] * dim), (104, [1.0] * (dim + 1)), (105, [])]
    df = spark.createDataFrame([(i, e, "x", 5) for i, e in rows], "vec_id long, embedding array<double>, cluster string, q int").repartition(3)
    got = centroids.cluster(df, dim, k=k, rounds=rounds)
    assert sorted((tuple(r)[:6] for r in got.collect()), key=repr) == brute(rows, dim, k, rounds)


def test_ties_and_empty_clusters(spark):
    schema = "vec_id long, embedding array<float>"
    assert centroids.cluster(spark.createDataFrame([], schema), 2).count() == 0
    rows = [(i, [1.0, 2.0]) for i in range(20)]  # all centroids equal: the first takes all, the others stay
    got = centroids.cluster(spark.createDataFrame(rows, schema), 2, k=3).collect()
    assert {(r.cluster, r.distance, r.inertia) for r in got} == {(0, 0, 0)} and len(got) == 20
    assert got[0].centroid == [1024, 2048]
