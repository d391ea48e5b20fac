"""Hard negatives against all pairs, and the bound of the sorted lists."""

import math

import numpy as np
import pytest

from quadloom.llm import negatives


def brute(rows, step):
    v = []
    for i, e, label in sorted(set((i, None if e is None else tuple(e), label) for i, e, label in rows), key=repr):
        if i is not None and e is not None and label is not None and all(x is not None and math.isfinite(x) for x in e):
            v.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in e]))
    out = []
    for a in v:
        if a[0] % step:
            continue
        score = lambda b: sum(x * y for x, y in zip(a[2], b[2], strict=False))  # noqa: B023, E731
        order = sorted(((-score(b), b[0], b[1]) for b in v if b is not a))
        for p, i, _ in [x for x in order if x[2] == a[1]][:5]:
            hard = [x for x in order if x[2] != a[1] and 50 * -p <= 100 * -x[0] <= 95 * -p][:3]
            out += [(a[0], i, n + 1, j, -p, -s) for n, (s, j, _) in enumerate(hard)]
    return sorted(out)


@pytest.mark.parametrize("dim,spread,bucket", [(8, 0.0, 4096), (6, 2.0, 16), (3, 0.5, 8)])
def test_against_all_pairs(spark, monkeypatch, dim, spread, bucket):
    monkeypatch.setattr(negatives, "BUCKET", bucket)
    rng = np.random.default_rng(dim)
    rows = []
    for i in range(160):
        x = rng.normal(size=dim)
        x *= math.exp(rng.normal() * spread) / np.linalg.norm(x)
        rows.append((i, [float(np.float32(y)) for y in x], int(rng.integers(0, 3))))
    rows += [(300 + i, rows[20][1], 1) for i in range(40)] + [(400 + i, rows[20][1], 2) for i in range(40)]  # copies of two labels, anchors among them
    rows += [rows[10], (500, None, 1), (510, rows[0][1], None), (520, [None, *[1.0] * (dim - 1)], 1), (530, [float("nan")] * dim, 1), (None, rows[1][1], 1), (540, [0.0] * dim, 0), (550, [-y for y in rows[0][1]], 0), (560, [1.0], 0), (570, [], 1)]
    df = spark.createDataFrame([(i, e, label, "x", 1) for i, e, label in rows], "vec_id long, embedding array<double>, label int, cid string, q int").repartition(3)
    got = negatives.mine(df, 10).collect()
    assert sorted(map(tuple, got)) == brute(rows, 10)
    assert got


def test_few_and_none(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert negatives.mine(spark.createDataFrame([], schema)).count() == 0
    assert negatives.mine(spark.createDataFrame([(50, [1.0], 1), (51, [1.0], 1)], schema)).count() == 0
    got = negatives.mine(spark.createDataFrame([(50, [1.0], 1), (51, [1.0], 1), (52, [0.75], 2), (53, [0.75], 3)], schema)).collect()
    assert sorted(map(tuple, got)) == [(50, 51, 1, 52, 65536, 49152), (50, 51, 2, 53, 65536, 49152)]


@pytest.mark.parametrize("least", [0.2, 0.6, 0.95, 1.0])
def test_sorted_lists_lose_nothing_and_leave_out_much(least):
    rng = np.random.default_rng(5)
    flat = rng.integers(-900, 900, (500, 8))
    flat[100] = flat[7]
    values, order = negatives.sorted_lists(flat)
    unit = flat / np.linalg.norm(flat, axis=1)[:, None]
    left = 0
    for anchor in unit[:40]:
        found = negatives.feasible(anchor, least - negatives.SLACK, values, order)
        assert set(np.flatnonzero(unit @ anchor >= least)) <= set(found.tolist())
        left += len(found)
    assert left < 40 * {0.2: 501, 0.6: 300, 0.95: 100, 1.0: 5}[least]
