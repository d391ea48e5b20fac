"""Span links turned into constraints: what hangs together, by numbers instead of ids."""

import random

from quadloom.operators import reference
from quadloom.operators.components import connected_components

FACT = "graph_id string, s string, t string, o string, pid string"
LINK = "graph_id string, src string, label string, dst string"


def test_focus_linking_names_and_ignored_types(spark):
    facts = [("g", "a", "likes", "b", "p1"), ("g", "p1", "sure", None, "p2"), ("g", "x", "likes", "y", "p3"), ("g", "p2", "urgent", None, "p4"), ("g", "sp", "ref", "b", "r1"), ("g", "__linking__sq", "ref", "b", "r2"), ("h", "a", "likes", "b", "p1")]
    links = [("g", "a", "ref_sp", "sp"), ("g", "x", "ref_sp", "sp"), ("g", "p2", "ref_sp", "sq"), ("g", "a", "ref_sp", "no"), ("h", "a", "ref_sp", "sp")]
    links += [("g", "b", "comps", d) for d in ("p1", "p2", "p3", "p4", "b", "out")] + [("h", "b", "comps", "p1"), ("g", "z", "ref", "p9")]
    got = reference.gathered(spark.createDataFrame(facts, FACT), spark.createDataFrame(links, LINK), "ref_sp", ["ref", "var"], ["urgent"])
    want = {("g", n, k, d) for n in ("a", "p2") for k in ("ref", "var") for d in ("p1", "p2", "b")} | {("g", "x", k, "p3") for k in ("ref", "var")} | {tuple(x) for x in links if x[2] != "ref_sp"}
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_components_are_those_of_all_ends(spark):
    rng = random.Random(7)
    node = lambda: rng.choice("abcdefghij") + str(rng.randrange(6))
    facts = [(rng.choice("gh"), node() if i % 9 else None, "t", node() if i % 3 else None, rng.choice([f"p{i}", node()])) for i in range(60)]
    above = {}

    def top(k):
        while above.setdefault(k, k) != k:
            k = above[k]
        return k

    for g, s, _, o, p in facts:
        for n in (s, o):
            if n is not None:
                above[top((g, n))] = top((g, p))
    found = {(r.graph_id, r.node): r.component for r in reference._together(spark.createDataFrame(facts, FACT)).collect()}
    assert set(found) == set(above)
    groups = lambda name: {frozenset(k for k in found if name(k) == c) for c in map(name, found)}
    assert groups(found.get) == groups(top)


def test_components_are_found_among_numbers(spark, monkeypatch):
    kinds, real = [], connected_components
    monkeypatch.setattr(reference, "connected_components", lambda e, *a, **k: kinds.extend(dict(e.dtypes)[c] for c in (a or ("src", "dst"))) or real(e, *a, **k))
    quads = spark.createDataFrame([("g", "a", "ref", "b", "p1")], FACT)
    reference.gathered(quads, spark.createDataFrame([("g", "a", "ref_sp", "sp")], LINK), "ref_sp", ["ref"], [])
    assert kinds == ["bigint", "bigint"]
