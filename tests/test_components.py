"""Components found in one task and in shuffled rounds against plain Python, for plain and structured nodes; dealt scans."""

import random

import pytest
from pyspark.sql import functions as F

from quadloom.operators import components
from quadloom.operators.components import connected_components
from quadloom.operators.salience import propagate
from quadloom.sources.staging import spread


def smallest(edges):
    """Labels spread along the edges until none changes."""
    label = {x: x for e in edges for x in e}
    while True:
        new = dict(label)
        for a, b in edges:
            new[a] = new[b] = min(new[a], new[b])
        if new == label:
            return label
        label = new


@pytest.mark.parametrize("gathered", [0, 100_000])
def test_random_graphs(spark, monkeypatch, gathered):
    monkeypatch.setattr(components, "GATHERED", gathered)
    rng = random.Random(gathered)
    edges = sorted({(a, b) for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(45)) if a != b})
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == smallest(edges)


def test_structured_nodes_with_nulls(spark, monkeypatch):
    node = lambda g, n: {"graph_id": g, "node": n}
    rows = [(node("a", "y"), node("a", "x")), (node("b", "y"), node("b", "é")), (node("b", "z"), node("b", "é")), (node(None, "x"), node("a", "x")), (node("b", None), node("b", "z")), (node("c", "x"), node("c", "x")), (None, node("c", "x"))]
    kind = "struct<graph_id: string, node: string>"
    edges = spark.createDataFrame(rows, f"src {kind}, dst {kind}")
    found = []
    for gathered in (0, 100_000):
        monkeypatch.setattr(components, "GATHERED", gathered)
        found.append({tuple(r.node): tuple(r.component) for r in connected_components(edges).collect()})
    assert found[0] == found[1]
    assert found[1] == {("a", "x"): (None, "x"), ("a", "y"): (None, "x"), (None, "x"): (None, "x"), ("b", "y"): ("b", None), ("b", "z"): ("b", None), ("b", "é"): ("b", None), ("b", None): ("b", None)}


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_propagation_against_plain_python(spark):
    rng = random.Random(3)
    facts = [(f"f{i}", rng.choice("abcde"), rng.choice(["a", "b", None, "f0", "f1"])) for i in range(12)]
    given = {"a": 1.0, "c": 0.4, "f3": 0.9}
    now = {x: given.get(x, 0.0) for p, s, o in facts for x in (p, s, o) if x}
    for _ in range(4):
        new = dict(now)
        for p, s, o in facts:
            ends = [x for x in (s, o) if x]
            new[p] = max(new[p], sum(now[x] for x in ends) / len(ends) - 0.3)
            for x in ends:
                new[x] = max(new[x], now[p])
        now = new
    quads = spark.createDataFrame(facts, "pid string, s string, o string")
    salience = spark.createDataFrame(list(given.items()), "c string, salience double")
    got = {r.c: r.salience for r in propagate(quads, salience, 4).collect()}
    assert got == pytest.approx(now)


def test_spread_keeps_all_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    dealt = spread(docs.select("doc_id"))
    assert dealt.rdd.getNumPartitions() >= docs.rdd.getNumPartitions()
    assert sorted(r.doc_id for r in dealt.collect()) == sorted(r.doc_id for r in docs.select(F.col("doc_id")).collect())
