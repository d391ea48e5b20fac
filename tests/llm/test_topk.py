"""Exact search against all pairs."""

import math

import numpy as np
import pytest

from quadloom.llm import topk


def brute(rows, k, step):
    v = {i: [math.floor(1024 * float(x)) for x in e] for i, e in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)}
    out = []
    for q in v:
        if q % step == 0:
            best = sorted((-sum(a * b for a, b in zip(v[q], v[i], strict=False)), i) for i in v if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("dim,copies", [(8, 0), (5, 60)])
def test_against_all_pairs(spark, dim, copies):
    rng = np.random.default_rng(dim)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=dim)]) for i in range(150)]
    rows += [(500 + i, rows[20][1]) for i in range(copies)]
    rows += [(700, None), (800, [None, *[1.0] * (dim - 1)]), (900, [float("nan")] * dim), (910, [float("inf")] * dim), (None, [1.0] * dim), (20, rows[20][1])]
    df = spark.createDataFrame([(i, e, "clash", 1) for i, e in rows], "vec_id long, embedding array<float>, q string, label int").repartition(3)
    got = sorted(map(tuple, topk.search_embeddings(df, 10, 10).collect()))
    assert got == brute(rows, 10, 10)


def test_few_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    assert topk.search_embeddings(spark.createDataFrame([], schema)).count() == 0
    assert topk.search_embeddings(spark.createDataFrame([(100, [1.0])], schema)).count() == 0
    got = topk.search_embeddings(spark.createDataFrame([(100, [1.0]), (200, [2.0]), (3, [-1.0])], schema)).collect()
    assert sorted(map(tuple, got)) == [(100, 1, 200, 2 << 20), (100, 2, 3, -1 << 20), (200, 1, 100, 2 << 20), (200, 2, 3, -2 << 20)]


def test_wide_products():
    a = np.array([[1 << 40, 5], [-(1 << 62), 1]])
    assert topk.products(a[:, 1:], a[:, 1:]).tolist() == [[25, 5], [5, 1]]
    assert topk.products(a, a)[0, 1] == -(1 << 63)
