"""Parses as facts: a golden sentence and what isn't a whole parse."""

from quadloom.operators.closure import types
from quadloom.operators.match import match
from quadloom.operators.parse import KINDS, parse_facts, sketched

ARCS = "graph_id string, i int, word string, tag string, head int, label string"


def facts_of(spark, rows, **more):
    parsed = spark.createDataFrame(rows, ARCS)
    kinds = spark.createDataFrame([*KINDS.items(), ("vb", None)], "kind string, sup string")
    return parse_facts(parsed, parsed, kinds, **more)


def test_a_parse_as_facts(spark):
    rows = [
        ("x", 0, "the", "dt", 1, "det"), ("x", 1, "dog", "nn", 2, "nsbj"), ("x", 2, "barked", "vb", -1, "root"),
        ("x", 2, "barked", "vb", 1, "acl"), ("x", 3, "was", "md", None, None), ("x", 4, "hm", None, 9, "gone"), ("x", 5, "hm", "nn", 2, None),
        ("y", 0, "the", "dt", None, "root"),
    ]
    facts = facts_of(spark, rows, marks={"was": "tenseful_aux"})
    got = {(r.s, r.t, r.o) for r in facts.where("graph_id = 'x'").collect()}
    arcs = {f for f in got if f[1] != "type"}
    assert arcs == {("x#1", "det", "x#0"), ("x#2", "nsbj", "x#1"), ("x#1", "acl", "x#2"), ("x#2", "assert", None), ("x#3", "assert", None)}
    assert got - arcs == (
        {(f"x#{i}", "type", "span") for i in range(6)} | {("x#0", "type", "dt"), ("x#1", "type", "nn"), ("x#2", "type", "vb"), ("x#3", "type", "md"), ("x#5", "type", "nn"), ("x#3", "type", "tenseful_aux")}
        | {(t, "type", "pstg") for t in ("dt", "nn", "vb", "md")} | {("dt", "type", "function"), ("nn", "type", "noun"), ("nn", "type", "content"), ("vb", "type", "verb"), ("vb", "type", "content"), ("md", "type", "verb"), ("md", "type", "content"), ("nsbj", "type", "argument")}
    )
    assert facts.count() == facts.select("graph_id", "pid").distinct().count()
    hit = match(facts, [("?v", "nsbj", "?n"), ("?n", "det", "?d")], types(facts), {"v": "verb", "n": "pstg", "d": "function"}).collect()
    assert [(r.graph_id, r.v, r.n, r.d) for r in hit] == [("x", "x#2", "x#1", "x#0")]


def test_the_rule_of_arcs(spark):
    words = "the dog and cat jumped on the red box".split()
    rows = spark.createDataFrame([("g", 0, i, w) for i, w in enumerate(words)] + [("g", 1, 20, "of"), ("h", 0, 0, None)], "graph_id string, sentence int, i int, word string")
    got = {(r.graph_id, r.i): (r.head, r.label) for r in sketched(rows).collect()}
    assert [got["g", i] for i in range(9)] == [(1, "det"), (4, "nsbj"), (1, "coord"), (1, "conj"), (None, "root"), (4, "case"), (7, "det"), (5, "pobj"), (4, "obj")]
    assert got["g", 20] == got["h", 0] == (None, "root")


def test_no_tokens(spark):
    assert facts_of(spark, []).count() == 0
