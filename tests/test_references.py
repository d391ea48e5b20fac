"""References, answers and linearised graphs on small graphs."""

import random

import pytest
from pyspark.sql import functions as F

from quadloom.operators import linear, reference
from quadloom.operators.closure import types

FACT = "graph_id string, s string, t string, o string, pid string"
LINK = "graph_id string, src string, label string, dst string"


def links(spark, *rows):
    return spark.createDataFrame([("g", *r) for r in rows], LINK)


@pytest.fixture(scope="module")
def said(spark):
    """`the dog that Ann likes barked`: two dogs are known, Ann likes one of them."""
    rows = [("rex", "type", "dog", "t1"), ("fido", "type", "dog", "t2"), ("ann", "like", "fido", "l1"), ("bob", "like", "rex", "l2"), ("it", "type", "dog", "t3"), ("ann", "like", "it", "l3"), ("it", "bark", None, "b1"), ("dog", "type", "animal", "t4")]
    return spark.createDataFrame([("g", *r) for r in rows], FACT)


def test_references_covered_by_another_go(spark):
    got = reference.references(links(spark, ("a", "ref", "1"), ("a", "ref", "2"), ("a", "var", "a"), ("b", "ref", "1"), ("c", "ref", "3"), ("d", "ref", "4"), ("e", "ref", "4")))
    assert {(r.ref, *r.constraints, *r.vars) for r in got.collect()} == {("a", "1", "2", "a"), ("c", "3")}


def test_a_reference_is_resolved_and_merged(spark, said):
    of = links(spark, ("it", "ref", "t3"), ("it", "ref", "l3"), ("it", "var", "it"))
    salience = spark.createDataFrame([("g", "fido", 0.5), ("g", "rex", 0.9)], "graph_id string, c string, salience double")
    facts, pairs = reference.resolved(said, of, types(said), salience)
    assert [(r.ref, r.match) for r in pairs.collect()] == [("it", "fido")]
    assert {(r.s, r.t) for r in facts.where("t = 'bark'").collect()} == {("fido", "bark")}


def test_the_choice_shrinks(spark):
    pairs = spark.createDataFrame([("g", "r1", "c1"), ("g", "r1", "c2"), ("g", "r1", "r2"), ("g", "r2", "c2"), ("g", "r2", "r1")], "graph_id string, ref string, match string")
    salience = spark.createDataFrame([("g", "c1", 0.4), ("g", "c2", 0.9), ("g", "r2", 0.1), ("g", "r1", 0.1)], "graph_id string, c string, salience double")
    got = {(r.ref, r.match) for r in reference.chosen(pairs, salience).collect()}
    assert got == {("r1", "c2"), ("r1", "r2")}


def test_follow_up_questions(spark):
    quads = spark.createDataFrame([("g", "new", "op_more_info", "old", "m")], FACT)
    facts, more = reference.more_info(quads, links(spark, ("old", "rref", "p1"), ("old", "rvar", "v1")))
    assert [(r.s, r.t) for r in facts.collect()] == [("new", "_specific")]
    spec = facts.first().pid
    assert {(r.label, r.dst) for r in more.where("src = 'new'").collect()} == {("ref", "p1"), ("ref", spec), ("var", "v1"), ("var", spec)}


def test_yes_and_no(spark):
    schema = "graph_id string, pid string, t string, o string, salience double, denied boolean"
    rows = [("a", "1", "affirm", "x", 0.2, False), ("a", "2", "reject", "y", 0.9, False), ("b", "3", "do", None, 0.5, False), ("c", "4", "have", None, 0.5, True), ("d", "5", "have", "z", 1.0, False)]
    asked = spark.createDataFrame([(g, f"q{g}", "truth", "f") for g in "abcd"], "graph_id string, pid string, kind string, focus string")
    got = {(r.request, r.answer, r.says) for r in reference.truth_answers(asked, spark.createDataFrame(rows, schema)).collect()}
    assert got == {("qa", "y", "no"), ("qb", "answer:3", "yes"), ("qc", "answer:4", "no")}


def test_open_requests_prefer_truth_on_ties(spark):
    rows = [("g", "1", "arg", "f", 3, 0.5, False), ("g", "2", "truth", "f", 3, 0.5, False), ("g", "3", "arg", "f", 2, 0.9, False), ("g", "4", "arg", "f", 3, 0.9, True)]
    asked = reference.open_request(spark.createDataFrame(rows, "graph_id string, pid string, kind string, focus string, turn int, salience double, settled boolean"), spark.createDataFrame([("g", 4)], "graph_id string, turn int"))
    assert [r.pid for r in asked.collect()] == ["2"]


def test_argument_answers(spark, said):
    of = types(spark.createDataFrame([("g", *r) for r in (("q", "type", "animal", "1"), ("rex", "type", "dog", "2"), ("dog", "type", "animal", "3"), ("ann", "type", "person", "4"))], FACT))
    asked = spark.createDataFrame([("g", "r", "arg", "q")], "graph_id string, pid string, kind string, focus string")
    told = spark.createDataFrame([("g", "rex", 0.3, False, False), ("g", "dog", 0.9, False, False), ("g", "ann", 1.0, False, False)], "graph_id string, c string, salience double, reference boolean, predicate boolean")
    assert [r.answer for r in reference.arg_answers(asked, told, of).collect()] == ["rex"]


def test_marks_of_settled_requests(spark):
    requests = spark.createDataFrame([("g", "u1", "user", "truth", "f"), ("g", "b1", "bot", "arg", "f"), ("g", "u2", "user", "arg", "h")], "graph_id string, pid string, who string, kind string, focus string")
    pairs = spark.createDataFrame([("g", "m", "f"), ("g", "n", "h"), ("g", "open", "f")], "graph_id string, match string, ref string")
    got = reference.settled_marks(pairs, requests, links(spark, ("open", "ref", "1"), ("h", "ref", "k")))
    assert {(r.s, r.t, r.op) for r in got.collect()} == {("b1", "req_sat", "add"), ("b1", "user_aware", "add"), ("u2", "req_sat", "add"), ("u2", "user_aware", "remove"), ("h", "user_aware", "remove"), ("k", "user_aware", "remove")}


def test_linearized(spark):
    rows = [("user", "like", "rex", "1"), ("rex", "type", "dog", "2"), ("user", "own", "rex", "3"), ("dog", "eat", "user", "4"), ("user", "ask", "bot", "5")]
    quads = spark.createDataFrame([("g", *r) for r in rows], FACT)
    tree = linear.spanning_tree(quads, spark.createDataFrame([("g", "user")], "graph_id string, root string"))
    text = linear.linearized(tree, spark.createDataFrame([("rex", "Rex")], "c string, label string"))
    assert text.first().text == "user : ask bot like Rex : type dog"
    assert text.select(linear.speakers_swapped(F.col("text")).alias("x")).first().x == "_bot_ : ask _user_ like Rex : type dog"


def sequential(pairs, weight):
    """The choice among (ref, match), one reference after another."""
    also, left, out = {r for r, _ in pairs}, {}, []
    for r, m in pairs:
        left.setdefault(r, set()).add(m)
    w = lambda c: weight.get(c, 0.0)
    while left:
        ref = min(left, key=lambda r: (max((w(c) for c in left[r]), default=0.0), r))
        constants = sorted(left[ref] - also, key=lambda c: (-w(c), c))[:1]
        now = (left[ref] & also) | set(constants)
        while now:
            take = min(now, key=lambda c: (-w(c), c))
            out.append((ref, take))
            if take not in also:
                now = {c for c in now if c not in also or take in left.get(c, ())}
            elif take in left:
                now &= left[take]
                left[take] &= now
            now.discard(take)
        del left[ref]
    return out


def test_components_choose_as_one_after_another(spark):
    rng = random.Random(4)
    rows, sal, want = set(), {}, set()
    for g in range(12):
        refs, constants = [f"r{i}" for i in range(rng.choice([1, 4, 9]))], [f"c{i}" for i in range(6)]
        weight = {x: round(rng.random(), 1) for x in refs + constants if rng.random() < 0.9}
        pairs = {(r, m) for r in refs for m in refs + constants if m != r and rng.random() < (0.25 if m in refs else 0.4)}
        rows |= {(f"g{g}", *p) for p in pairs}
        sal |= {(f"g{g}", c): v for c, v in weight.items()}
        want |= {(f"g{g}", *x) for x in sequential(sorted(pairs), weight)}
    pairs = spark.createDataFrame(sorted(rows), "graph_id string, ref string, match string")
    salience = spark.createDataFrame([(*k, v) for k, v in sal.items()], "graph_id string, c string, salience double")
    got = [tuple(r) for r in reference.chosen(pairs, salience).collect()]
    assert set(got) == want and len(got) == len(want)


def test_resolve_iter_over_a_table(spark, sf):
    from quadloom.plans.references import nearby, resolve_iter

    pairs, salience = (x.collect() for x in nearby(spark, sf))
    want = sequential(sorted({(r.ref, r.match) for r in pairs}), {r.c: r.salience for r in salience})
    assert sorted(map(tuple, resolve_iter(spark, sf).collect())) == sorted(want) and want
