"""A pull with more pullers than its budget, against the plain order."""

from quadloom.operators.retrieve import pull


def test_many_pullers_of_one_node(spark):
    pullers = [(f"c{k}", k) for k in range(1, 1501)]
    near = [(c, "hub") for c, _ in pullers] + [("c1400", "far"), ("c1401", "far"), ("c1402", "far"), ("c3", "none")]
    facts = [("hub", "p1"), ("hub", "p2"), ("far", "p3")]
    size = {"hub": 2, "far": 1}
    of = {n: sorted(r for c, r in pullers if (c, n) in set(near)) for n in ("hub", "far")}
    for nodes in (["far"], ["hub", "far"]):
        items = sorted([(False, a, b, n) for n in nodes for i, a in enumerate(of[n]) for b in of[n][i + 1 :]][:10**6] + [(True, a, 0, n) for n in nodes for a in of[n]])
        want, spent = [], 0
        for alone, a, b, n in items:
            spent += size[n]
            if spent > 30:
                break
            want.append((f"c{a}", None if alone else f"c{b}", n, size[n]))
        links = spark.createDataFrame([x for x in near if x[1] in nodes or x[1] == "none"], "c string, node string")
        got = pull(spark.createDataFrame(pullers, "c string, rank int"), links, spark.createDataFrame(facts, "node string, pid string"), 30)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
