"""Steps of stored rules are made for beginnings that matched alone, and marks are looked up where an edge needs its facts sure."""

import pytest

from quadloom.operators import rulebook
from quadloom.operators.infer import Rule
from quadloom.sources.rules import read_edges, write_rules

FACT = "graph_id string, s string, t string, o string, pid string"
RULES = [Rule("r", [("?x", "a", "?y", "?p"), ("?y", "b", "?z", "?q")], [("?x", "ab", "?z")]), Rule("q", [("?x", "c", "?y", "?p"), ("?y", "d", "?z", "?q")], [("?x", "cd", "?z")], {"p": "any", "q": "any"})]
FACTS = [("g", "u", "c", "v", "1"), ("g", "v", "d", "w", "2"), ("g", "x", "b", "y", "3"), ("g", "1", "not", None, "4"), ("g", "2", "maybe", None, "5")]


@pytest.fixture(scope="module")
def trie(spark, tmp_path_factory):
    path = write_rules(spark, RULES, str(tmp_path_factory.mktemp("rules")))
    return rulebook.compiled(read_edges(spark, path), spark.read.parquet(f"{path}/conditions"))


def test_only_live_beginnings_go_on(spark, trie, monkeypatch):
    asked, plain = [], rulebook._Doubted.of
    monkeypatch.setattr(rulebook._Doubted, "of", lambda self, rows: asked.append(sorted({(r.depth, r.value) for r in rows})) or plain(self, rows))
    found = rulebook.solve(spark.createDataFrame(FACTS, FACT), trie)
    assert {(r.rule, *sorted(r.bindings.items())) for r in found.collect()} == {("q", ("p", "1"), ("q", "2"), ("x", "u"), ("y", "v"), ("z", "w"))}
    assert asked == [[(0, "a"), (0, "c")], [(1, "d")]]


def test_a_step_shuffles_no_specs(spark, trie):
    """What an edge asks was carried through the shuffle with every partial solution."""
    node = trie.where("depth = 1").select("node", "parent", "want", *rulebook.PLACES)
    partial = spark.createDataFrame([("g", r.parent, ["u", "v", "1"]) for r in node.collect()], "graph_id string, node string, b array<string>")
    facts = spark.createDataFrame([(*f, False) for f in FACTS], f"{FACT}, doubt boolean")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = rulebook._step(partial, node, facts, None, "st", True)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    shuffles = [line for line in plan.splitlines() if "SortMergeJoin" in line or "ShuffledHashJoin" in line]
    assert shuffles and plan.count("BroadcastHashJoin") >= 2
