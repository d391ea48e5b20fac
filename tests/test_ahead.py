"""Many turns at once: what one turn after another makes; and each session has types of its own."""

import pytest
from pyspark.sql import functions as F

from quadloom.operators.infer import Rule
from quadloom.sources.rules import read_edges, write_rules
from quadloom.streaming import conversation as talk
from tests import test_conversation as golden

LENGTHS = {"a": 40, "b#1": 23, "c": 1}


def counted(state, said, know):
    """A step that is quickly told: `set` says a number, any other turn adds one to the last; and each turn leaves a link of its own twice."""
    now = said.select(F.col("session").alias("graph_id"), "turn", "t", "o")
    was = state["facts"].select("graph_id", F.col("o").alias("was"))
    last = now.join(was, "graph_id", "left").withColumn("o", F.when(F.col("t") == "set", F.col("o")).otherwise((F.coalesce("was", F.lit("0")).cast("int") + 1).cast("string")))
    mine = {k: v.join(now.select("graph_id"), "graph_id", "left_semi") for k, v in state.items()}
    facts = last.select("graph_id", F.lit("x").alias("s"), F.lit("is").alias("t"), "o", F.lit("f").alias("pid"))
    own = now.select("graph_id", F.col("turn").cast("string").alias("src"), F.lit("b").alias("label"), F.lit(None).cast("string").alias("dst"))
    links = mine["links"].unionByName(own).unionByName(own)
    return mine | {"facts": facts, "links": links}, last.select(F.col("graph_id").alias("session"), "turn", F.lit("tell").alias("kind"), F.col("o").alias("text"), F.lit(None).cast("string").alias("about"))


def test_many_turns_at_once_equal_one_after_another(spark, monkeypatch):
    rows, want, last = [], set(), {"b#1": 100}
    for session, n in LENGTHS.items():
        for k in range(n):
            last[session] = 7 * k if k % 4 == 1 else last.get(session, 0) + 1
            rows.append((session, k, "fact", "x", "set" if k % 4 == 1 else "inc", str(7 * k), f"f{k}"))
            want.add((session, k, "tell", str(last[session])))
    made = []
    monkeypatch.setattr(talk, "step", lambda *x: made.append(1) or counted(*x))
    start = talk.starting(spark, spark.createDataFrame([("b#1", "x", "is", "100", "f")], golden.FACT))
    state, out = talk.ahead(start, spark.createDataFrame(rows, talk.SAID), None)
    assert golden.responses(out) == want and out.count() == len(want)
    assert {(r.graph_id, r.o) for r in state["facts"].collect()} == {(s, str(n)) for s, n in last.items()} and state["facts"].count() == len(LENGTHS)
    assert {(r.graph_id, r["count"]) for r in state["links"].groupBy("graph_id").count().collect()} == {(s, 2 * n) for s, n in LENGTHS.items()}
    assert len(made) <= max(LENGTHS.values()) + 1


def test_turns_are_taken_at_once_within_bounds(spark, monkeypatch):
    said = spark.createDataFrame([("a", k, "fact", "x", "is", None, f"f{k}") for k in range(8)] + [("b", 0, "fact", "x", "is", None, "f")], talk.SAID)
    start = talk.starting(spark, spark.createDataFrame([("a", "x", "is", None, "s1"), ("c", "x", "is", None, "s1")], golden.FACT))
    sizes = [3, 3, 4, 5, 6, 7, 8, 9]  # rows before each turn, its own included
    for n in (0, 1, 4, 8):
        monkeypatch.setattr(talk, "TOGETHER", sum(sizes[:n]))
        assert talk._at_once(start, said) == n


@pytest.fixture(scope="module")
def know(spark, tmp_path_factory):
    rules = [*golden.RULES, Rule("pet", [("?x", "own", "?y")], [("?x", "feed", "?y")], var_types={"y": "animal"})]
    path = write_rules(spark, rules, str(tmp_path_factory.mktemp("rules")))
    facts = spark.createDataFrame([("kb", "dog", "type", "animal", "k1")], golden.FACT)
    return talk.Knowledge(facts, read_edges(spark, path), spark.read.parquet(f"{path}/conditions")).ready()


def test_golden_conversation_at_once(spark, know, monkeypatch):
    monkeypatch.setattr(talk, "AHEAD", 2)
    state, out = talk.run_turns(talk.starting(spark, spark.createDataFrame(golden.START, golden.FACT)), spark.createDataFrame(golden.TURNS, talk.SAID), know)
    assert golden.responses(out) == golden.WANT and out.count() == len(golden.WANT)
    assert {(r.graph_id, r.who, r.settled) for r in state["requests"].collect()} == {("a", "bot", True), ("a", "user", True), ("b", "bot", True)}


def test_types_belong_to_their_session(spark, know):
    rows = [("a", 0, "fact", "ann", "own", "tom", "f1"), ("a", 0, "fact", "tom", "type", "cat", "f2"), ("b", 0, "fact", "cat", "type", "animal", "f1"), ("b", 0, "fact", "bob", "own", "rex", "f2"), ("b", 0, "fact", "rex", "type", "cat", "f3"), ("c", 0, "fact", "cid", "own", "fox", "f1"), ("c", 0, "fact", "fox", "type", "dog", "f2")]
    state, _ = talk.run_turns(talk.starting(spark), spark.createDataFrame(rows, talk.SAID), know)
    assert {(r.graph_id, r.s, r.o) for r in state["facts"].where(F.col("t") == "feed").collect()} == {("b", "bob", "rex"), ("c", "cid", "fox")}
