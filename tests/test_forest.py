"""Spanning forests against a golden graph and a queue in plain Python."""

import random

from quadloom.operators.linear import NOT_LINKS, spanning_forest

FACT = "graph_id string, s string, t string, o string, pid string"
PETS = [
    ("d", "type", "dog", "dtd"), ("b", "type", "bone", "btb"), ("a", "type", "person", "atp"), ("sally", "buy", "b", "sbb"),
    ("d", "like", "sbb", "dlb"), ("dlb", "degree", "really", "ddr"), ("john", "aunt", "a", "jaa"), ("a", "possess", "d", "apd"),
    ("apd", "property", "illegal", "api"), ('"dog"', "expr", "dog", "ed"), ("user", "assert", "dlb", "uad"),
]


def forest(spark, facts):
    rows = spanning_forest(spark.createDataFrame(facts, FACT)).collect()
    return sorted(((r.graph_id, r.root, r.node, r.parent, r.label, r.reverse, r.kind, r.depth, r.again) for r in rows), key=repr)


def by_queue(facts):
    """The same rule, a graph at a time and a round at a time, over dictionaries."""
    out = []
    for g in sorted({f[0] for f in facts}):
        mine = {f[4]: f[1:4] for f in facts if f[0] == g}
        kinds, seen, met = {f[1] for f in mine.values()}, set(), set()
        asserted = sorted({o or s for s, t, o in mine.values() if t == "assert"})
        refs = {o for s, t, o in mine.values() if t == "ref" and o} - set(asserted)
        for root in asserted + sorted(refs - kinds) + sorted(refs & kinds):
            if root in seen or root in met:
                continue
            level, depth = {root: ("root", None, False, None)}, 0
            while level:
                for n, (label, parent, reverse, _) in level.items():
                    seen.add(n)
                    if n in mine:
                        met.add(mine[n][1])
                    out.append((g, root, n, parent, label, reverse, mine[n][1] if n in mine else None, depth, False))
                entries = []
                for n, (_, parent, reverse, above) in level.items():
                    kind = None
                    if n in mine:
                        a, kind, b = mine[n]
                        a, b = (b, a) if reverse else (a, b)
                        entries += [(0, n, a, kind)] if a is not None and a != parent else []
                        entries += [(1, n, b, kind)] if b is not None else []
                    if above != "time":
                        for pid, (s, t, o) in mine.items():
                            if t not in NOT_LINKS and pid not in (n, parent):
                                entries += [(2, n, pid, kind)] if s == n else []
                                entries += [(3, n, pid, kind)] if o == n else []
                depth, level = depth + 1, {}
                for k, parent, n, kind in sorted(entries, key=lambda e: e[:2]):
                    label = ("arg0", "arg1", "link", "link")[k]
                    if n not in seen and n not in level:
                        level[n] = (label, parent, k == 3, kind)
                    elif k < 2:
                        out.append((g, root, n, parent, label, False, mine[n][1] if n in mine else None, depth, True))
    return sorted(out, key=repr)


TALK = [("go", "time", "now", "gt"), ("now", "is", "late", "nl"), ("u", "assert", "go", "ua"), ("x", "ref", "now", "r1"), ("x", "ref", "is", "r2"), ("x", "ref", "far", "r3"), ("x", "ref", "late", "r4")]


def random_facts():
    rnd, facts = random.Random(11), []
    for g in range(25):
        nodes = [f"n{i}" for i in range(7)] + ["like", "time"]
        pids = [f"p{i}" for i in range(rnd.randint(0, 12))]
        for p in pids:
            t = rnd.choice(["like", "time", "see", "see", "type", "ref", "expr"])
            facts.append((f"g{g}", rnd.choice(nodes + pids), t, None if rnd.random() < 0.1 else rnd.choice(nodes + pids), p))
        if rnd.random() < 0.8:
            facts.append((f"g{g}", "u", "assert", rnd.choice(nodes + pids + ["z"]), "pa"))
    return facts


def test_forests(spark):
    """All graphs at once: the golden ones, and random ones against the queue."""
    facts = [("pets", *f) for f in PETS] + [("talk", *f) for f in TALK] + random_facts()
    got = forest(spark, facts)
    assert got == by_queue(facts)
    assert len(got) > 150 and any(r[8] for r in got)
    assert {(r[2], r[3], r[4], r[5]) for r in got if r[0] == "pets"} == {
        ("dlb", None, "root", False), ("d", "dlb", "arg0", False), ("sbb", "dlb", "arg1", False), ("ddr", "dlb", "link", False),
        ("really", "ddr", "arg1", False), ("sally", "sbb", "arg0", False), ("b", "sbb", "arg1", False), ("apd", "d", "link", True),
        ("a", "apd", "arg1", False), ("api", "apd", "link", False), ("illegal", "api", "arg1", False), ("jaa", "a", "link", True),
        ("john", "jaa", "arg1", False),
    }
    assert not any(r[8] for r in got if r[0] == "pets")
    talk = [r for r in got if r[0] == "talk"]
    assert ("talk", "go", "now", "gt", "arg1", False, None, 2, False) in talk
    assert {r[1] for r in talk} == {"go", "far", "late"}  # now is reached; is is the type of nl, below late


def test_empty_graph(spark):
    assert forest(spark, []) == []
