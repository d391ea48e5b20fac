"""What changes after speaking, on a golden graph; contractions with have; lemmas by tag."""

from pyspark.sql import functions as F

from quadloom.functions.text import CONTRACTIONS, expanded
from quadloom.operators.dialogue import lemma, spoken
from quadloom.operators.ranking import composed

FACT = "graph_id string, s string, t string, o string, pid string"


def test_after_speaking(spark):
    facts = [("g", "dog", "type", "topic", "a1"), ("g", "dog", "type", "animal", "x"), ("g", "sun", "shine", None, "a2")]
    said = [("g", "user", "own", "dog", "f1", 7), ("g", "dog", "run", None, "f2", 7), ("g", '"dog"', "expr", "dog", "f3", 7), ("g", "f1", "user_aware", None, "f4", 7), ("h", None, "own", None, None, 2)]
    known = [("g", "f2"), ("h", "f1")]
    inserts = [("g", "dog", "type", "topic", "n1"), ("g", "cat", "type", "topic", "n2"), ("g", "sun", "shine", None, "n3")]
    make = lambda rows, kind: spark.createDataFrame(rows, kind)
    out = spoken(make(facts, FACT), make(said, FACT + ", turn long"), make(known, "graph_id string, c string"), make(inserts, FACT))
    got = {(r.graph_id, r.c): (r.aware, r.turn, r.salience, r.warm) for r in out.collect()}
    assert got == {
        ("g", "f1"): (True, 7, 1.0, True),
        ("g", "f2"): (None, 7, 1.0, True),
        ("g", "f3"): (None, None, None, True),
        ("g", "f4"): (None, 7, 1.0, True),
        ("g", "user"): (None, 7, None, None),
        ("g", "dog"): (None, 7, 1.0, None),
        ("g", "a1"): (None, None, 1.0, None),
        ("g", "cat"): (None, None, 1.0, None),
        ("g", "n2"): (None, None, 1.0, None),
        ("g", "sun"): (None, None, 1.0, None),
        ("g", "a2"): (None, None, 1.0, None),
    }


def test_nothing_said(spark):
    none = spark.createDataFrame([], FACT)
    assert spoken(none, none.withColumn("turn", F.lit(1).cast("long")), spark.createDataFrame([], "graph_id string, c string"), none).count() == 0


def test_have_in_contractions(spark):
    told = "couldve Should've i'd've hedve cantve couldn't've whatre whatll we'll have shell"
    row = spark.createDataFrame([(told,)], "text string").select(expanded(F.col("text")).alias("t")).first()
    assert row.t == "could have Should have i would have he would have can not have could not have what are what will we will have shell"
    assert all("'" not in full for full in CONTRACTIONS.values())


def test_lemmas_by_tag(spark):
    rows = [("'s", "VBZ"), ("s", "vbz"), ("'s", "PRP"), ("'s", "POS"), ("s", None), ("was", "VBD"), ("dog", "NN"), (None, "NN")]
    got = [r.x for r in spark.createDataFrame(rows, "w string, t string").select(lemma(F.col("w"), F.col("t")).alias("x")).collect()]
    assert got == ["be", "be", "us", "'s", "s", "be", "dog", None]


def test_answers_by_kind(spark):
    rows = [
        ("both", "rpresent", 0.5, "rp"), ("both", "present", 0.5, "p"), ("both", "react", 9.0, "r"),
        ("better", "rpresent", 0.5, "rp"), ("better", "present", 0.6, "p2"), ("better", "present", 0.6, "p1"), ("better", "react", 0.1, "r"), ("better", "react", 0.2, "s"),
        ("plain", "present", 0.1, "p"), ("plain", "react", 0.4, None), ("mute", "react", 0.4, "r"),
        ("none", "present", None, "p"), ("none", "rpresent", 0.0, "rp"), ("odd", "other", 1.0, "x"),
    ]
    cands = spark.createDataFrame(rows, "session string, kind string, score double, text string")
    got = {r.session: r.text for r in composed(cands, F.lit("okay")).collect()}
    assert got == {"both": "rp", "better": "s p1", "plain": "okay p", "mute": None, "none": "rp"}
    assert {r.session: r.text for r in composed(cands, F.lit(None).cast("string")).collect()}["plain"] == "p"
    assert composed(cands.limit(0), F.lit("okay")).count() == 0
