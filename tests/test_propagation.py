"""Propagation over plain predicates: two rounds at once, the neighbour found once where none that rises can lift another."""

import random

import pytest

from quadloom.operators import salience as rel


@pytest.mark.parametrize(("most", "least", "odd", "finds"), [(1.0, 0.0, False, 1), (5.0, 0.0, False, 4), (1.0, -2.0, False, 4), (5.0, 0.0, True, 4)])
def test_against_plain_rounds(spark, monkeypatch, most, least, odd, finds):
    rng, found, plain = random.Random(5), [], rel._best_neighbour
    monkeypatch.setattr(rel, "_best_neighbour", lambda *a: found.append(1) or plain(*a))
    nodes = [f"n{i}" for i in range(12)]
    facts = [(f"f{i}", rng.choice(nodes), rng.choice([*nodes, None])) for i in range(14)]
    facts += [("f0", "n1", "n2"), ("g", "f3", "n4"), ("h", None, "g")] if odd else []
    given = {n: rng.choice([most, least, rng.uniform(least, most)]) for n in nodes[:9]} | ({"f5": 2.0} if odd else {})
    now = {x: given.get(x, 0.0) for p, s, o in facts for x in (p, s, o) if x}
    for _ in range(5):
        new = {x: max(v, 0.0) for x, v in now.items()}
        for pid in {p for p, *_ in facts}:
            ends = [x for p, *so in facts if p == pid for x in so if x]
            new[pid] = max(new[pid], sum(now[x] for x in ends) / len(ends) - rel.ASSOCIATION_LOSS)
            for x in ends:
                new[x] = max(new[x], now[pid])
        now = new
    quads = spark.createDataFrame(facts, "pid string, s string, o string")
    rows = rel.propagate(quads, spark.createDataFrame(list(given.items()), "c string, salience double"), 5).collect()
    assert len(rows) == len(now) and {r.c: r.salience for r in rows} == pytest.approx(now)
    assert len(found) == finds
