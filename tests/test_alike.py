"""References that ask for the same share their candidates: kinds against pairs one by one."""

import random

from pyspark.sql import functions as F

from quadloom.operators import reference
from tests.test_references import sequential


def test_kinds_choose_as_their_pairs(spark):
    rng = random.Random(11)
    members, fits, barred, sal = set(), set(), set(), {}
    for g in range(10):
        refs, constants, kinds = [f"r{i}" for i in range(8)], [f"c{i}" for i in range(6)], ["k0", "k1", "k2"]
        sal |= {(f"g{g}", x): round(rng.random(), 1) for x in refs + constants if rng.random() < 0.9}
        members |= {(f"g{g}", r, k) for r in refs for k in kinds if rng.random() < 0.4}
        fits |= {(f"g{g}", k, m) for k in kinds for m in refs + constants if rng.random() < (0.15 if m in refs else 0.5)}
    for g, r, k in members:
        barred |= {(g, r, k, m) for h, x, m in fits if (h, x) == (g, k) and (m == r or rng.random() < 0.3)}
    table = lambda rows, *names: spark.createDataFrame(sorted(rows), ", ".join(f"{n} string" for n in names))
    got = reference.chosen_alike(table(members, "graph_id", "ref", "kind"), table(fits, "graph_id", "kind", "match"), spark.createDataFrame([(*k, v) for k, v in sal.items()], "graph_id string, c string, salience double"), table(barred, "graph_id", "ref", "kind", "match"))
    want = set()
    for g in {g for g, _, _ in members}:
        pairs = {(r, m) for h, r, k in members if h == g for x, y, m in fits if (x, y) == (g, k) and (g, r, k, m) not in barred}
        want |= {(g, *x) for x in sequential(sorted(pairs), {c: v for (h, c), v in sal.items() if h == g})}
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_what_fits_is_found_once_for_all_that_ask_for_it(spark):
    facts = [("g", f"p{i}", "type", "part", f"t{i}") for i in range(40)]
    said = [("g", f"r{i}", "type", "part", f"a{i}") for i in range(30)]
    links = [("g", f"r{i}", label, dst) for i in range(30) for label, dst in (("ref", f"a{i}"), ("var", f"r{i}"))]
    quads = lambda rows: spark.createDataFrame(rows, "graph_id string, s string, t string, o string, pid string")
    refs = reference.references(spark.createDataFrame(links, "graph_id string, src string, label string, dst string"))
    kinds = spark.createDataFrame([("r1", "p2")], "c string, sup string")
    members, fits, barred = reference.alike(quads(said), refs, kinds, quads(facts))
    assert (members.count(), fits.count()) == (30, 40)
    assert [(r.ref, r.match) for r in barred.collect()] == [("r1", "p2")]
    assert reference.candidates(quads(said), refs, kinds, quads(facts)).count() == 30 * 40 - 1
    salience = spark.createDataFrame([("g", "p2", 1.0), ("g", "p7", 0.5)], "graph_id string, c string, salience double")
    best = reference.best_constant(members, fits, barred, salience).where(F.col("graph_id") == "g").collect()
    assert {(r.ref, r.match) for r in best} == {(f"r{i}", "p7" if i == 1 else "p2") for i in range(30)}
