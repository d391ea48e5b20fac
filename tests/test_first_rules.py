"""Rules by priority with covers, against the plain sequence."""

import random

from quadloom.operators.ranking import first_rules


def test_rules_take_their_centres_in_order(spark):
    rnd = random.Random(5)
    node = lambda: rnd.choice("abcdefghij")
    rows = [(f"g{g}", rnd.randint(0, 3), s, node(), [node() for _ in range(rnd.randint(0, 2))]) for g in range(40) for s in range(rnd.randint(0, 14))]
    chain = [("chain", 0, k, f"n{k}", [f"n{k + 1}"]) for k in range(8)]  # every second one is out
    odd = [("g0", 0, 99, None, ["a"]), ("g0", 9, 99, "k", None), ("g0", 9, 100, "l", [None, "l"]), (None, 0, 1, "a", [])]
    want = set()
    for g in {r[0] for r in rows + chain}:
        taken = set()
        for _, r, s, c, covers in sorted(x for x in rows + chain if x[0] == g):
            if c not in taken:
                taken |= {c, *covers}
                want.add((g, r, s, c))
    got = [tuple(r) for r in first_rules(spark.createDataFrame([*rows, *rows[:5], *chain, *odd], "graph_id string, rindex int, sol int, centre string, covers array<string>")).collect()]
    assert len(got) == len(set(got))
    assert set(got) == want | {("g0", 9, 99, "k"), ("g0", 9, 100, "l")}
    assert sum(g[0] == "chain" for g in got) == 4
