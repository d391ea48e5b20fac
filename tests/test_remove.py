"""Removal that cascades: what is written and compared is what goes, not the whole graph."""

import pytest

from quadloom.operators import mutate

FACT = "graph_id string, s string, t string, o string, pid string"


@pytest.fixture()
def written(monkeypatch):
    """The number of rows of each table that is stored."""
    rows, real = [], mutate.staged

    def counted(df):
        out = real(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(mutate, "staged", counted)
    return rows


def test_only_what_goes_is_stored(spark, written):
    lines = [("g", f"o:{i % 50}", "contain", f"p:{i}", f"li:{i}") for i in range(500)]
    marks = [("g", f"li:{i}", "not", None, f"q:{i}") for i in range(0, 500, 2)]
    g = spark.createDataFrame([*lines, *marks, ("g", "q:20", "sure", None, "z:20"), ("h", "o:20", "contain", "p:1", "li:20")], FACT)
    left = mutate.remove(g, spark.createDataFrame([("g", "o:20")], "graph_id string, c string"))
    want = {r for r in g.collect() if r.graph_id == "h" or not (r.s == "o:20" or r.pid == "z:20" or (r.t == "not" and int(r.s[3:]) % 50 == 20))}
    assert set(left.collect()) == want and left.count() == len(want) == 752 - 10 - 10 - 1
    assert sum(written) < 60


def test_cycles_repeated_ids_and_nulls(spark):
    facts = [("g", "b1", "t", "b3", "b2"), ("g", "b2", "t", None, "b1"), ("g", "b1", "t", "x", "b3"), ("g", "b9", "t", "x", "b2"), ("g", None, "t", None, "c1"), ("g", "y", "t", "x", None), ("h", "b1", "t", "b2", "b3")]
    g = spark.createDataFrame(facts, FACT)
    left = mutate.remove(g, pids=spark.createDataFrame([("g", "b2")], "graph_id string, pid string"))
    assert {tuple(r) for r in left.collect()} == {facts[4], facts[5], facts[6]}


def test_ids_of_many_kinds(spark):
    facts = [("g", f"{chr(0x4E00 + i)}{i}", "t", None, f"{chr(0x4E00 + i)}p") for i in range(300)]
    g = spark.createDataFrame([*facts, ("g", f"{chr(0x4E00)}p", "t", None, "z")], FACT)
    left = mutate.remove(g, spark.createDataFrame([f[:2] for f in facts[:250]], "graph_id string, c string"))
    assert {tuple(r) for r in left.collect()} == set(facts[250:])
