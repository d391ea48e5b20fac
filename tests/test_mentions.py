"""Instances for mentions: known ones, classes, ids in use, texts that are added later."""

from quadloom.operators.mentions import instantiated, mention_facts

HIT = "key string, start int, `end` int, phrase string"


def test_instances(spark):
    table = lambda rows, of: spark.createDataFrame(rows, of)
    hits = [("a", 1, 3, "ice cream"), ("a", 1, 3, "ice cream"), ("a", 4, 6, "big ben"), ("b", 1, 3, "ice cream"), (None, 2, 3, "ice cream"), ("a", 9, 10, None), ("a", 8, 9, "odd")]
    concepts = table([("ice cream", "ice"), ("ice cream", "dessert"), ("big ben", "bb"), ("odd", None), (None, "x")], "phrase string, concept string")
    known, used = table([("bb",), ("bb",), (None,)], "concept string"), table([("m_4",), ("m_x",), ("n_9",), (None,)], "id string")
    made = instantiated(table(hits, HIT), ["key"], concepts, known, "m_", used)
    got = sorted(((r.key or "", r.start, r.end, r.concept, r.node, r.fresh) for r in made.collect()))
    assert got == [
        ("", 2, 3, "dessert", "m_5", True), ("", 2, 3, "ice", "m_6", True), ("a", 1, 3, "dessert", "m_7", True), ("a", 1, 3, "ice", "m_8", True),
        ("a", 4, 6, "bb", "bb", False), ("b", 1, 3, "dessert", "m_9", True), ("b", 1, 3, "ice", "m_10", True),
    ]
    more = instantiated(table([*hits, ("a", 0, 1, "ice cream")], HIT), ["key"], concepts, known, "m_", used, made)
    later = {(r.key or "", r.start, r.end, r.concept, r.node, r.fresh) for r in more.collect()}
    assert later - set(got) == {("a", 0, 1, "dessert", later_node(later, "dessert"), True), ("a", 0, 1, "ice", later_node(later, "ice"), True)}
    assert set(got) <= later
    facts = {(r.graph_id, r.s, r.t, r.o) for r in mention_facts(made.where("key = 'a' AND concept <> 'ice'"), ["key"]).collect()}
    assert facts == {("a_1_3", "m_7", "type", "dessert"), ("a_1_3", "m_7", "focus", None), ("a_1_3", "dessert", "center", None), ("a_4_6", "bb", "focus", None), ("a_4_6", "bb", "center", None)}


def later_node(rows, concept):
    (node,) = [r[4] for r in rows if r[:4] == ("a", 0, 1, concept)]
    assert int(node[2:]) > 10
    return node
