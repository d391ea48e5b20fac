"""Phrases by tries against the join of all n-grams, and at the size of a large dictionary."""

import random

from pyspark.sql import functions as F

from quadloom.operators import phrases, spans

TEXT = "i saw felix the fox and the hound watching the fox and the hound"
NAMES = ["the fox and the hound", "fox", "hound", "felix the fox", "lone wolf"]


def found(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_golden_phrases(spark):
    texts = spark.createDataFrame([(1, TEXT.split()), (2, []), (3, None), (4, ["fox", None, "fox"])], "id int, toks array<string>")
    names = spark.createDataFrame([(n,) for n in [*NAMES, "fox", "", None, " felix  the fox "]], "phrase string")
    hits = found(phrases.find_phrases(texts, ["id"], "toks", names))
    assert {h[1] for h in hits} == {"the fox and the hound", "fox", "hound", "felix the fox"}
    assert hits == sorted(
        [(1, "felix the fox", 3, 6), (1, "fox", 5, 6), (1, "hound", 8, 9), (1, "the fox and the hound", 4, 9), (1, "fox", 11, 12), (1, "hound", 14, 15), (1, "the fox and the hound", 10, 15)]
        + [(4, "fox", 1, 2), (4, "fox", 3, 4)],
        key=repr,
    )


def test_tries_find_what_the_join_finds(spark, monkeypatch):
    monkeypatch.setattr(phrases, "PIECE", 50)
    rnd = random.Random(3)
    draw = lambda n: [rnd.choice("abcd") + rnd.choice("xy") for _ in range(n)]
    rows = [(i, draw(rnd.choice([0, 1, 3, 40, 400]))) for i in range(60)]
    rows += [(7, rows[5][1])] * 3  # repeated rows and keys
    texts = spark.createDataFrame(rows, "key int, toks array<string>")
    names = spark.createDataFrame([(" ".join(draw(rnd.randint(1, 8))),) for _ in range(800)], "phrase string")
    want = found(spans.gazetteer(texts, ["key"], "toks", names.distinct(), list(range(1, 9))))
    assert len(want) > 1000
    for shards in (10**6, 300):
        assert found(phrases.find_phrases(texts, ["key"], "toks", names, shards, 1000)) == want


def test_no_phrases_and_no_texts(spark):
    texts = spark.createDataFrame([(1, ["a"])], "id int, toks array<string>")
    names = spark.createDataFrame([("a",)], "phrase string")
    assert phrases.find_phrases(texts, ["id"], "toks", names.limit(0)).count() == 0
    assert phrases.find_phrases(texts.limit(0), ["id"], "toks", names).count() == 0


def test_a_million_phrases(spark):
    word = lambda c: F.concat(F.lit("w"), F.pmod(F.xxhash64("id", F.lit(c)), F.lit(50_000)).cast("string"))
    size = F.pmod(F.xxhash64("id"), F.lit(8)) + 1
    names = spark.range(1_000_000).select(F.array_join(F.slice(F.array(*map(word, range(8))), F.lit(1), size.cast("int")), " ").alias("phrase"))
    texts = spark.range(2_000).select("id", F.split(F.concat_ws(" ", F.array(*map(word, range(8)))), " ").alias("toks"))
    hits = phrases.find_phrases(texts, ["id"], "toks", names)
    whole = texts.join(spark.range(2_000).select("id", size.alias("n")), "id").select("id", F.array_join(F.slice("toks", F.lit(1), F.col("n").cast("int")), " ").alias("phrase"))
    assert whole.join(hits.where("start = 1"), ["id", "phrase"], "left_anti").count() == 0
    assert hits.select("id", "phrase").join(names, "phrase", "left_anti").count() == 0


def test_expressions_from_facts(spark):
    quads = spark.createDataFrame(
        [("g", '"Ice  Cream"', "expr", "ice_cream", "1"), ("g", '"dog"', "expr", "dog", "2"), ("g", '"o\'clock"', "expr", "hour", "3"), ("g", '"mother-in-law"', "expr", "kin", "4"), ("g", '"big dog"', "type", "dog", "5"), ("g", '"a b"', "expr", None, "6")],
        "graph_id string, s string, t string, o string, pid string",
    )
    got = {r.phrase: r.concept for r in phrases.expression_dictionary(quads).collect()}
    assert got == {"ice cream": "ice_cream", "o'clock": "hour", "mother-in-law": "kin"}
