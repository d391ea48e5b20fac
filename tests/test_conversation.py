"""A golden conversation: a pronoun is resolved, a rule raises a question, its answer is taken in, a question is answered."""

import os

import pytest
from pyspark.sql import functions as F

from quadloom.operators.infer import Rule
from quadloom.sources.rules import read_edges, write_rules
from quadloom.streaming import conversation as talk

RULES = [
    Rule("ask", [("?x", "see", "?y"), ("?y", "type", "dog")], [("?x", "ask_like", "?y")]),
    Rule("walk", [("?x", "like", "?y"), ("?y", "type", "dog")], [("?x", "walk_with", "?y")]),
]
TURNS = [  # session, turn, row, s, t, o, pid
    ("a", 0, "fact", "ann", "see", "rex", "f1"),
    ("a", 0, "fact", "rex", "type", "dog", "f2"),
    ("a", 1, "fact", "ann", "affirm", "yes", "f3"),
    # who is the dog that ann likes?
    ("a", 2, "fact", "who", "type", "dog", "f4"),
    ("a", 2, "fact", "ann", "like", "who", "f5"),
    ("a", 2, "link", "who", "ref", "f4", None),
    ("a", 2, "link", "who", "ref", "f5", None),
    ("a", 2, "link", "who", "var", "who", None),
    ("a", 2, "ask", "who", "arg", None, "q1"),
    ("b", 0, "fact", "bob", "see", "fido", "f1"),
    ("b", 1, "fact", "bob", "reject", "no", "f2"),
    ("b", 2, "fact", "bob", "sing", None, "f3"),
]
START = [("b", "fido", "type", "dog", "s1"), ("c", "x", "type", "dog", "s1")]
FACT = "graph_id string, s string, t string, o string, pid string"
#: session, turn, kind, text
WANT = {
    ("a", 0, "ask", "ann ask_like rex"),
    ("a", 1, "tell", "ann walk_with rex"),
    ("a", 2, "answer", "rex"),
    ("b", 0, "ask", "bob ask_like fido"),
    ("b", 1, "fallback", talk.FALLBACK),
    ("b", 2, "fallback", talk.FALLBACK),
}


@pytest.fixture(scope="module")
def know(spark, tmp_path_factory):
    path = write_rules(spark, RULES, str(tmp_path_factory.mktemp("rules")))
    facts = spark.createDataFrame([("kb", "dog", "type", "animal", "k1")], FACT)
    return talk.Knowledge(facts, read_edges(spark, path)).ready()


def responses(df):
    return {(r.session, r.turn, r.kind, r.text) for r in df.collect()}


def test_batch_twin(spark, know):
    state, out = talk.run_turns(talk.starting(spark, spark.createDataFrame(START, FACT)), spark.createDataFrame(TURNS, talk.SAID), know)
    assert responses(out) == WANT
    facts = {(r.graph_id, r.s, r.t, r.o) for r in state["facts"].collect()}
    assert ("a", "ann", "like", "rex") in facts and not any("who" in f for f in facts)
    assert ("b", "bob", "like", "fido") in facts and ("b", "bob", "walk_with", "fido") not in facts  # it was denied
    assert {(r.graph_id, r.who, r.settled) for r in state["requests"].collect()} == {("a", "bot", True), ("a", "user", True), ("b", "bot", True)}
    assert not state["links"].where("src = 'who' OR dst = 'who'").count() and {r.graph_id for r in state["facts"].select("graph_id").distinct().collect()} == {"a", "b"}


def test_stream_equals_twin_and_stays_small(spark, know, tmp_path):
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir").removeprefix("file://")
    src, path = f"{tmp_path}/in", f"{tmp_path}/out"
    start = spark.createDataFrame(START, FACT)
    left = []
    for turn in range(3):
        spark.createDataFrame([x for x in TURNS if x[1] == turn], talk.SAID).coalesce(1).write.mode("append").parquet(src)
        before = set(os.listdir(shared))
        q = talk.converse(spark.readStream.schema(talk.SAID).parquet(src), path, know, f"{tmp_path}/check", start, compact=2)
        q.processAllAvailable()
        q.stop()
        left.append(len(set(os.listdir(shared)) - before))
    out = spark.read.parquet(f"{path}/responses")
    assert responses(out) == WANT and out.count() == len(WANT)
    assert left == [0, 0, 0]  # no intermediate table stays
    assert sorted(os.listdir(f"{path}/state")) in (["version=0", "version=1", "version=2"], ["version=2"])
    talk.Sessions(spark, path, 2).tidy(3)
    assert os.listdir(f"{path}/state") == ["version=2"]
    now = talk.Sessions(spark, path, 2).before(3)
    assert {(r.graph_id, r.s, r.t) for r in now["facts"].where("t = 'like'").collect()} == {("a", "ann", "like"), ("b", "bob", "like")}
    assert now["features"].agg(F.count("*")).first()[0] > 0
