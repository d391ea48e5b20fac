"""Small graphs with known answers."""

import random

import pytest
from pyspark.sql import functions as F

from quadloom.operators import infer, lookup, mutate, retrieve, spans
from quadloom.operators import salience as rel
from quadloom.operators.closure import closure, paths, reach, types
from quadloom.operators.components import connected_components
from quadloom.operators.infer import Rule
from quadloom.operators.match import match

FACT = "graph_id string, s string, t string, o string, pid string"


def quads(spark, *facts):
    return spark.createDataFrame([("g", *f) for f in facts], FACT)


@pytest.fixture(scope="module")
def people(spark):
    return quads(
        spark, ("john", "likes", "mary", "x_0"), ("mary", "dislikes", "peter", "x_1"), ("peter", "likes", "john", "pjl_1"), ("peter", "likes", "sarah", "x_2"), ("peter", "happy", None, "x_3"), ("jack", "happy", None, "x_4"), ("peter", "dislikes", "mary", "x_5")
    )


def test_lookup(spark, people):
    of = lambda **b: {r.pid for r in lookup.predicates(people, spark.createDataFrame([tuple(b.values())], list(b))).collect()}
    assert of(s="peter") == {"pjl_1", "x_2", "x_3", "x_5"}
    assert of(s="peter", t="likes") == {"pjl_1", "x_2"}
    assert of(s="peter", t="happy") == {"x_3"}
    assert {r.object for r in lookup.objects(people, "likes").where("concept = 'peter'").collect()} == {"john", "sarah"}
    assert {r.subject for r in lookup.subjects(people, "likes").where("concept = 'mary'").collect()} == {"john"}
    assert {r.pid for r in lookup.incident(people).where("c = 'peter'").collect()} == {"pjl_1", "x_1", "x_2", "x_3", "x_5"}


def test_pattern_match(spark):
    edges = [("mary", "john"), ("mary", "sally"), ("sally", "john"), ("tom", "mary"), ("john", "mary")]
    foes = [("john", "tom"), ("tom", "john"), ("sally", "tom")]
    g = quads(spark, *[(a, "likes", b, f"l{i}") for i, (a, b) in enumerate(edges)], *[(a, "dislikes", b, f"d{i}") for i, (a, b) in enumerate(foes)])
    assert match(g, [("?x", "likes", "?y")]).count() == 5
    want = {(a, b, c) for a, b in edges for b2, c in edges if b == b2}
    assert {(r.x, r.y, r.z) for r in match(g, [("?x", "likes", "?y"), ("?y", "likes", "?z")]).collect()} == want
    tri = {(a, b, c) for a, b, c in want if (c, a) in foes}
    assert {(r.x, r.y, r.z) for r in match(g, [("?x", "likes", "?y"), ("?y", "likes", "?z"), ("?z", "dislikes", "?x")]).collect()} == tri
    assert match(g, [("?x", "likes", "?x")]).count() == 0


def test_ontology(spark):
    up = [("entity", "object"), ("animal", "entity"), ("pet", "entity"), ("person", "animal"), ("dog", "animal"), ("dog", "pet"), ("retriever", "dog"), ("fido", "retriever"), ("loop", "pool"), ("pool", "loop")]
    g = quads(spark, *[(a, "type", b, f"t{i}") for i, (a, b) in enumerate(up)], ("fido", "happy", None, "uh"), ("happy", "type", "emotion", "te"))
    of = {}
    for r in types(g, predicates=True).collect():
        of.setdefault(r.c, set()).add(r.sup)
    assert of["fido"] == {"fido", "retriever", "dog", "animal", "pet", "entity", "object"}
    assert of["uh"] == {"uh", "happy", "emotion"}, of["uh"]
    assert of["loop"] == {"loop", "pool"}
    again = types(g, predicates=True)
    assert again.count() == again.distinct().count()


def test_inference(spark):
    g = quads(spark, ("john", "like", "mary", "jlm"), ("mary", "like", "sally", "mls"), ("sally", "like", "tom", "slt"), ("slt", "not", None, "n1"))
    rule = Rule("trans", [("?x", "like", "?y"), ("?y", "like", "?z")], [("?x", "like", "?z")])
    new = infer.chain(g, [rule], 5)
    assert [(r.s, r.o) for r in new.collect()] == [("john", "sally")]
    made = infer.apply(infer.solutions(g, rule), rule)
    assert {(r.src, r.label) for r in infer.provenance(made).where("label = 'and'").collect()} == {("jlm", "and"), ("mls", "and")}
    assert infer.unfired(made, made.select("graph_id", "rule", "evidence")).count() == 0
    assert infer.chain(g, [rule], 3).exceptAll(new).count() == 0


def test_merge_is_congruent_and_orderless(spark):
    g = quads(spark, ("a", "type", "k", "p1"), ("b", "type", "k", "p2"), ("p1", "sure", None, "p3"), ("p2", "sure", None, "p4"), ("c", "likes", "b", "p5"))
    pair = "graph_id string, a string, b string"
    one = mutate.merged(g, spark.createDataFrame([("g", "a", "b")], pair))
    two = mutate.merged(g, spark.createDataFrame([("g", "b", "a")], pair))
    want = {("a", "type", "k", "p1"), ("p1", "sure", None, "p3"), ("p1", "sure", None, "p4"), ("c", "likes", "a", "p5")}
    for m in (one, two):
        assert {(r.s, r.t, r.o, r.pid) for r in m.collect()} == want


def test_remove_cascades(spark):
    g = quads(spark, ("a", "likes", "b", "p1"), ("p1", "not", None, "p2"), ("p2", "sure", None, "p3"), ("c", "likes", "d", "p4"))
    left = mutate.remove(g, spark.createDataFrame([("g", "b")], "graph_id string, c string"))
    assert [r.pid for r in left.collect()] == ["p4"]


def test_closures_end_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "src string, dst string")
    got = closure(spark.createDataFrame([("a", "a")], "c string, sup string"), edges)
    assert {r.sup for r in got.collect()} == {"a", "b", "c"}
    hops = {(r.node, r.hop) for r in reach(spark.createDataFrame([("a",)], "c string"), edges, 2).collect()}
    assert hops == {("a", 0), ("b", 1), ("c", 1)}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5)], "src long, dst long").repartition(4)
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000}


def test_confidence_and_salience(spark):
    x = spark.createDataFrame([(0.5,), (0.5,)], "x double")
    assert x.agg(rel.all_of(F.col("x")).alias("a"), rel.any_of(F.col("x")).alias("b")).first() == (0.25, 0.75)
    g = quads(spark, ("a", "likes", "b", "p"))
    out = {r.c: round(r.salience, 6) for r in rel.propagate(g, spark.createDataFrame([("a", 1.0), ("b", 0.2)], "c string, salience double"), 2).collect()}
    assert out == {"a": 1.0, "b": 0.3, "p": 0.35} or out == {"a": 1.0, "b": 0.3, "p": 0.3}


def test_maximal_and_subsets(spark):
    sets = spark.createDataFrame([("a", "1"), ("b", "1"), ("b", "2"), ("c", "1"), ("c", "2"), ("d", "3")], "c string, x string")
    rng = random.Random(2)
    many = {f"s{i}": {str(rng.randrange(9)) for _ in range(rng.randint(1, 7))} for i in range(80)}
    rows = spark.createDataFrame([(c, x) for c, xs in many.items() for x in xs], "c string, x string")
    assert {r.c for r in retrieve.maximal(rows).collect()} == {a for a, xs in many.items() if not any(xs < ys or (xs == ys and b < a) for b, ys in many.items())}
    for share in (1.0, 0.6):
        want = {(a, b) for a, xs in many.items() for b, ys in many.items() if a != b and 10 * len(xs & ys) >= len(xs) * round(10 * share)}
        assert {(r.a, r.b) for r in retrieve.subsets(rows, share).collect()} == want
    assert {r.c for r in retrieve.maximal(sets).collect()} == {"b", "d"}
    assert {(r.a, r.b) for r in retrieve.subsets(sets).collect()} == {("a", "b"), ("a", "c"), ("b", "c"), ("c", "b")}


def test_spans(spark):
    phrases = spark.createDataFrame([("the fox and the hound",), ("fox",), ("hound",), ("lone wolf",)], "phrase string")
    text = spark.createDataFrame([(1, "I saw The Fox and the Hound, a lone wolf")], "key long, text string").select("key", spans.tokens(F.col("text")).alias("toks"))
    hits = spans.gazetteer(text, ["key"], "toks", phrases, [1, 2, 5])
    assert hits.count() == 4
    assert {r.phrase for r in spans.without_subsets(hits, ["key"]).collect()} == {"the fox and the hound", "lone wolf"}
    assert {r.start for r in spans.greedy(spark.createDataFrame([(1, 1, 4), (1, 3, 6), (1, 5, 7)], "key long, start long, end long"), ["key"]).collect()} == {1, 5}


def test_greedy_against_plain_python(spark):
    rng = random.Random(4)
    texts = {k: sorted({(a := rng.randrange(40), a + rng.randint(1, 6)) for _ in range(rng.randint(1, 14))}) for k in range(30)}

    def plain(left):
        while True:
            n = {x: sum(x[0] < y[1] and y[0] < x[1] for y in left) - 1 for x in left}
            if max(n.values()) == 0:
                return set(left)
            left = [x for x in left if x != min(left, key=lambda x: (-n[x], x[1] - x[0], -x[0]))]

    rows = spark.createDataFrame([(k, a, b) for k, xs in texts.items() for a, b in xs], "key long, start long, end long")
    got = {}
    for r in spans.greedy(rows, ["key"]).collect():
        got.setdefault(r.key, set()).add((r.start, r.end))
    assert got == {k: plain(xs) for k, xs in texts.items()}


def test_deep_chains_are_finished(spark):
    edges = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(20)], "src string, dst string")
    start = spark.createDataFrame([("n000", "n000")], "c string, sup string")
    assert closure(start, edges).count() == 21
    with pytest.raises(RuntimeError):
        closure(start, edges, max_rounds=3)
    assert closure(start, edges, max_rounds=21).count() == 21


def test_paths_end_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "src string, dst string")
    assert {r.path for r in paths(edges).collect()} == {"a -> b -> c", "b -> c -> a", "c -> a -> b", "x -> y"}


def test_graphs_stay_apart(spark):
    rows = [(g, *f) for g in ("g1", "g2") for f in (("a", "type", "k", "p1"), ("b", "type", "k", "p2"), ("p2", "maybe", None, "p3"))]
    g = spark.createDataFrame(rows, FACT)
    out = mutate.merged(g, spark.createDataFrame([("g1", "a", "b")], "graph_id string, a string, b string"))
    assert {(r.graph_id, r.s, r.t, r.pid) for r in out.collect()} == {("g1", "a", "type", "p1"), ("g1", "p1", "maybe", "p3"), ("g2", "a", "type", "p1"), ("g2", "b", "type", "p2"), ("g2", "p2", "maybe", "p3")}
    sure = infer.affirmed(g, spark.createDataFrame([("g1", "p2")], "graph_id string, pid string"))
    assert [(r.graph_id) for r in sure.where("t = 'maybe'").collect()] == ["g2"]
    denied = infer.rejected(g, spark.createDataFrame([("g2", "p2")], "graph_id string, pid string"))
    assert {(r.graph_id, r.t) for r in denied.where("s = 'p2'").collect()} == {("g1", "maybe"), ("g2", "not")}
    made = spark.createDataFrame([("g1", "r", "x", "1"), ("g2", "r", "x", "1")], "graph_id string, rule string, evidence string, pid string")
    assert [r.graph_id for r in infer.unfired(made, made.where("graph_id = 'g1'").select("graph_id", "rule", "evidence")).collect()] == ["g2"]


def test_null_objects_are_found(spark, people):
    asked = spark.createDataFrame([("peter", "happy", None), ("peter", "likes", None)], "s string, t string, o string")
    assert [(r.s, r.t) for r in lookup.existing(asked, people).collect()] == [("peter", "happy")]
    assert [r.pid for r in lookup.predicates(people, asked).collect()] == ["x_3"]


def test_chain_finds_what_naive_rounds_find(spark):
    rng = random.Random(6)
    facts = {(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}") for _ in range(18)}
    g = quads(spark, *[(a, "to", b, f"p{i}") for i, (a, b) in enumerate(sorted(facts))])
    got = {(r.s, r.o) for r in infer.chain(g, [Rule("t", [("?x", "to", "?y"), ("?y", "to", "?z")], [("?x", "to", "?z")])]).collect()}
    whole = set(facts)
    while more := {(a, d) for a, b in whole for c, d in whole if b == c} - whole:
        whole |= more
    assert got == whole - facts


def test_limits_of_a_pull(spark):
    from quadloom.operators.retrieve import within_reach

    edges = spark.createDataFrame([("a", "b", 3.0), ("a", "c", 2.0), ("a", "d", 2.0), ("a", "b", 1.0), ("b", "e", 1.0), ("b", "a", 9.0), ("c", "e", 4.0), ("e", "f", 1.0), ("d", "x", 5.0)], "src string, dst string, weight double")
    start = spark.createDataFrame([("a",), ("a",)], "c string")
    got = lambda *limits: {tuple(r) for r in within_reach(start, edges, *limits).collect()}
    assert got(1) == {("b", 1, 3.0), ("c", 1, 2.0), ("d", 1, 2.0)}
    assert got(2) == got(1) | {("e", 2, 4.0), ("x", 2, 5.0)}
    assert got(3, 2) == {("b", 1, 3.0), ("c", 1, 2.0), ("e", 2, 4.0), ("f", 3, 1.0)}  # of ties the smaller
    assert got(3, None, 4) == got(1) | {("x", 2, 5.0)}


def test_marked_sections(spark):
    from quadloom.operators.spans import sections

    marks = {1: [-1, 0, 1, 0, 1, 0, -1, -1, 0, 1, 0], 2: [0, None, -1], 3: [1, -1, 1, -1]}
    rows = spark.createDataFrame([(k, i, m) for k, ms in marks.items() for i, m in enumerate(ms)], "g int, i int, mark int")
    got = {}
    for r in sections(rows, ["g"], "i", "mark").orderBy("g", "i").collect():
        got.setdefault(r.g, []).append((r.depth, r.section, r.closed))
    out, one, two = (0, None, None), lambda d: (d, 1, True), lambda d, c: (d, 2, c)
    assert got[1] == [out, out, one(1), one(1), one(2), one(2), one(1), one(0), out, two(1, False), two(1, False)]
    assert got[2] == [out] * 3 and got[3] == [one(1), one(0), two(1, True), two(0, True)]
