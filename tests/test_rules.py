"""Chains with derived marks, and stored rules in bulk, against naive rounds in plain Python."""

import hashlib
import itertools
import random

import pytest

from quadloom.operators import infer, rulebook
from quadloom.operators.infer import Rule, chain, strata
from quadloom.sources.rules import read_edges, write_rules

FACT = "graph_id string, s string, t string, o string, pid string"


def solve(facts, rule, kinds=frozenset()):
    """All bindings of a rule's precondition over facts (graph, s, t, o, pid)."""
    doubts = {(g, s): {t for g2, s2, t, _, _ in facts if (g2, s2) == (g, s) and t in ("not", "maybe")} for g, s, *_ in facts}
    out = []
    for graph in sorted({f[0] for f in facts}):
        found = [{}]
        for edge in infer.named_ids(rule.pre):
            new = []
            for have in found:
                for g, *fact in facts:
                    if g != graph:
                        continue
                    now = dict(have)
                    for term, value in zip(edge, fact, strict=True):
                        if isinstance(term, str) and term.startswith("?"):
                            if value is None or now.setdefault(term[1:], value) != value:
                                break
                        elif term != value:
                            break
                    else:
                        new.append(now)
            found = new
        for b in found:
            if all((lambda m: not m if w == "sure" else w == "any" or w in m)(doubts.get((graph, b[v]), set())) for v, w in infer.conditions(rule)) and all((b[v], k) in kinds for v, k in rule.var_types.items()):
                out.append((graph, b))
    return out


def naive(facts, rules, rounds):
    known, said = set(facts), {f[:4] for f in facts}
    for _ in range(rounds):
        made = {}
        for rule in rules:
            for graph, b in solve(known, rule):
                term = lambda x: b[x[1:]] if isinstance(x, str) and x.startswith("?") else x  # noqa: B023, E731
                for e in rule.post:
                    fact = (graph, *(term(x) for x in e[:3]))
                    pid = f"{rule.name}:{hashlib.sha256('|'.join(x or '' for x in fact[1:]).encode()).hexdigest()[:20]}"
                    if fact not in said:
                        made[fact] = min(pid, made.get(fact, pid))
        if not made:
            break
        said |= set(made)
        known |= {(*f, pid) for f, pid in made.items()}
    return said - {f[:4] for f in facts}


def random_rules(rng, n):
    """Rules over likes, knows and marks; some derive marks of what they matched, some ask for marks."""
    rules = []
    for i in range(n):
        x, y, z = "?x", "?y", "?z"
        pre = rng.choice([[(x, rng.choice("abc"), y, "?p")], [(x, rng.choice("abc"), y, "?p"), (y, rng.choice("abc"), z, "?q")], [(x, rng.choice("abc"), y, "?p"), (y, rng.choice("abc"), x, "?q")]])
        ids = [e[3][1:] for e in pre]
        confidence = {v: rng.choice(["sure", "sure", "any", "not", "maybe"]) for v in ids}
        post = rng.choice([[(x, rng.choice("abcd"), y)], [(y, rng.choice("abcd"), x)], [("?p", rng.choice(["not", "maybe"]), None)]])
        rules.append(Rule(f"r{i}", pre, post, confidence))
    return rules


def random_facts(rng, n=14):
    facts = [(rng.choice("gh"), rng.choice("uvwx"), rng.choice("abc"), rng.choice("uvwx")) for _ in range(n)]
    facts = [(*f, f"p{i}") for i, f in enumerate(dict.fromkeys(facts))]
    return facts + [(f[0], f[4], rng.choice(["not", "maybe"]), None, f"m{i}") for i, f in enumerate(facts) if rng.random() < 0.3]


@pytest.mark.parametrize("seed", range(5))
def test_chain_over_derived_marks_finds_what_naive_rounds_find(spark, seed, tmp_path):
    rng = random.Random(seed)
    facts, rules = random_facts(rng), random_rules(rng, 5)
    quads = spark.createDataFrame(facts, FACT)
    want = naive(facts, rules, 3)
    got = {tuple(r)[:4] for r in chain(quads, rules, 3).collect()}
    assert got == want
    path = write_rules(spark, rules, str(tmp_path))
    stored = rulebook.chain_stored(quads, read_edges(spark, path), spark.read.parquet(f"{path}/conditions"), 3)
    assert {tuple(r)[:4] for r in stored.collect()} == want


def test_a_derived_mark_fires_a_rule(spark):
    quads = spark.createDataFrame([("g", "ann", "say", "p1", "s1"), ("g", "bob", "like", "tea", "p1")], FACT)
    rules = [Rule("r1", [("?x", "say", "?p")], [("?p", "not", None)]), Rule("r2", [("?x", "like", "?y", "?p")], [("?x", "dislike", "?y")], {"p": "not"})]
    assert {(r.s, r.t, r.o) for r in chain(quads, rules).collect()} == {("p1", "not", None), ("bob", "dislike", "tea")}


def test_strata():
    doubt = Rule("doubt", [("?x", "say", "?p")], [("?p", "not", None)])
    trust = Rule("trust", [("?x", "like", "?y", "?p")], [("?x", "trust", "?y")])
    loose = Rule("loose", [("?x", "trust", "?y", "?p")], [("?x", "know", "?y")], {"p": "any"})
    assert [[r.name for r in x] for x in strata([loose, trust, Rule("mark", [("?x", "like", "?y", "?p")], [("?p", "maybe", None)], {"p": "any"})])] == [["mark"], ["loose", "trust"]]
    with pytest.raises(ValueError):  # say may be marked by doubt itself, as any fact may
        strata([doubt])
    with pytest.raises(ValueError):
        strata([Rule("a", [("?x", "like", "?y", "?p")], [("?x", "trust", "?y")]), Rule("b", [("?x", "trust", "?y"), ("?x", "like", "?y", "?p")], [("?p", "not", None)], {"p": "any", "_e0": "any"})])


def test_stratified_chain_waits_for_marks(spark):
    quads = spark.createDataFrame([("g", "u", "like", "v", "p1"), ("g", "v", "like", "w", "p2"), ("g", "w", "odd", "w", "p3")], FACT)
    rules = [Rule("trust", [("?x", "like", "?y", "?p")], [("?x", "trust", "?y")]), Rule("mark", [("?x", "like", "?y", "?p"), ("?y", "odd", "?y")], [("?p", "not", None)], {"p": "any"})]
    says = lambda **k: {(r.s, r.t) for r in chain(quads, rules, **k).collect()}
    assert says() == {("u", "trust"), ("v", "trust"), ("p2", "not")}
    assert says(stratified=True) == {("u", "trust"), ("p2", "not")}


@pytest.mark.parametrize("seed", range(3))
def test_many_rules_of_six_edges_at_once(spark, seed, tmp_path):
    rng = random.Random(100 + seed)
    facts = random_facts(rng, 24)
    rules = []
    for i in range(40):
        names = ["?1", "?2", "?3", "?4", "?5"]
        pre = []
        for _ in range(rng.choice([1, 3, 6])):
            term = lambda: rng.choice(names + list("uv")) if rng.random() < 0.9 else rng.choice(names)
            pre.append((term(), rng.choice(["a", "b", "c", "?t"]), term()))
        used = [v[1:] for e in pre for v in e if v.startswith("?") and v != "?t"]
        rules.append(Rule(f"r{i}", pre, [], {"_e0": rng.choice(["sure", "any"])}, {used[0]: "k"} if used and i % 4 == 0 else {}))
    kinds = {("u", "k"), ("v", "k"), ("k", "k")}
    quads = spark.createDataFrame(facts, FACT)
    path = write_rules(spark, rules, str(tmp_path))
    found = rulebook.solve(quads, rulebook.compiled(read_edges(spark, path), spark.read.parquet(f"{path}/conditions")), spark.createDataFrame(sorted(kinds), "c string, sup string"))
    got = sorted((r.rule, r.graph_id, sorted(r.bindings.items())) for r in found.collect())
    want = sorted((rule.name, g, sorted(b.items())) for rule in rules for g, b in solve(facts, rule, kinds))
    assert got == want and want


def test_the_plan_does_not_grow_with_the_rules(spark, tmp_path):
    quads = spark.createDataFrame(random_facts(random.Random(1)), FACT)
    sizes = []
    for n in (10, 1000):
        rules = [Rule(f"r{i}", [("?x", f"a{i}", "?y"), ("?y", f"b{i}", "?z"), ("?z", f"c{i}", "?x")], []) for i in range(n)]
        path = write_rules(spark, rules, f"{tmp_path}/{n}")
        plan = rulebook.solve(quads, rulebook.compiled(read_edges(spark, path)))
        sizes.append(len(plan._jdf.queryExecution().optimizedPlan().toString().splitlines()))
    assert sizes[0] == sizes[1]


def test_rules_from_metalinks(spark):
    facts = [("g", "x", "like", "y", "l1"), ("g", "y", "sell", "z", "l2"), ("g", "x", "buy", "z", "l3"), ("g", "l2", "not", None, "m1"), ("g", "a", "like", "b", "f1"), ("g", "b", "sell", "c", "f2"), ("g", "f2", "not", None, "m2"), ("g", "b", "sell", "d", "f3")]
    links = [("r", "pre", "l1"), ("r", "pre", "l2"), ("r", "post", "l3"), *(("r", "var", v) for v in "xyz"), ("half", "pre", "l1"), ("half", "var", "x")]
    quads = spark.createDataFrame(facts, FACT)
    edges, conditions = rulebook.assembled(quads, spark.createDataFrame([("g", *x) for x in links], "graph_id string, src string, label string, dst string"))
    assert {r.rule for r in edges.collect()} == {"g|r"} and edges.count() == 3
    made = rulebook.filled(rulebook.solve(quads, rulebook.compiled(edges, conditions)), edges)
    assert {(r.s, r.t, r.o, r.evidence) for r in made.collect()} == {("x", "buy", "z", "l1&l2"), ("a", "buy", "c", "f1&f2")}


def test_apply_and_filled_agree(spark, tmp_path):
    facts = random_facts(random.Random(3))
    quads = spark.createDataFrame(facts, FACT)
    rules = [Rule("r0", [("?x", "a", "?y"), ("?y", "b", "?z", "?q")], [("?x", "d", "?z"), ("?q", "seen", None)], {"q": "any"}), Rule("r1", [("?x", "?t", "?x")], [("?x", "self", "?t")])]
    path = write_rules(spark, rules, str(tmp_path))
    edges = read_edges(spark, path)
    made = rulebook.filled(rulebook.solve(quads, rulebook.compiled(edges, spark.read.parquet(f"{path}/conditions"))), edges)
    want = list(itertools.chain(*(infer.apply(infer.solutions(quads, r), r).collect() for r in rules)))
    assert sorted(map(str, map(tuple, made.distinct().collect()))) == sorted({str(tuple(r)) for r in want}) and want


def test_what_an_edge_brings_is_cut_before_it_multiplies_solutions(spark, monkeypatch):
    facts = [("g", "c", "want", f"p{i}", f"w{i}") for i in range(10)] + [("g", f"s{j}", "supply", f"p{i}", f"y{i}_{j}") for i in range(10) for j in range(20)]
    facts += [("g", f"s{j}", "in", f"n{j % 10}", f"i{j}") for j in range(20)] + [("g", "y3_0", "not", None, "m1"), ("g", "i10", "maybe", None, "m2")]
    edges = [(f"r{k}", "pre", i, *e, None) for k in range(2) for i, e in enumerate([("c", "want", "?p"), ("?s", "supply", "?p"), ("?s", "in", f"n{k}")])]
    edges += [(f"r{k}", "post", 0, "?s", "serve", "c", None) for k in range(2)]
    table = spark.createDataFrame(edges, "rule string, side string, nth int, s string, t string, o string, pid string")
    sizes, plain = [], rulebook.staged
    monkeypatch.setattr(rulebook, "staged", lambda df: (lambda out: (sizes.append(out.count()) if out.columns == ["graph_id", "node", "b"] else None, out)[1])(plain(df)))
    for evidence in (True, False):
        found = rulebook.solve(spark.createDataFrame(facts, FACT), rulebook.compiled(table, evidence=evidence))
        got = sorted((r.rule, r.bindings["s"], r.bindings["p"]) for r in found.collect())
        assert got == sorted((f"r{k}", f"s{j}", f"p{i}") for k in range(2) for j in (k, k + 10) for i in range(10) if (i, j) != (3, 0) and j != 10)
        assert max(sizes) <= 40
        assert all(any(n.startswith("_e") for n in r.bindings) == evidence for r in found.collect())
