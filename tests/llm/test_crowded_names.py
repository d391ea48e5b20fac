"""Surrogates where the short formats are nearly full."""

from pyspark.sql import functions as F

from quadloom.llm import pii


def fixed(found, key):
    """found -> surrogate, for those that need a further attempt."""
    of = pii.entities(found.withColumnRenamed("found", "text"))
    fixes = of.join(pii.collisions(of, key), ["kind", "entity"])
    return {r.found: r.s for r in fixes.select("found", pii.surrogate(F.col("found"), key, F.col("attempt"), F.col("family")).alias("s")).collect()}


def test_more_surnames_than_first_surrogates(spark):
    name = lambda i: "X" + "".join(chr(97 + i // 26**k % 26) for k in range(4))
    people = [f"Mr {name(i)}" for i in range(21_500)] + [f"Mr John {name(i)}" for i in range(0, 21_500, 7)]
    fixes = fixed(spark.createDataFrame([(p,) for p in people], "found string"), "k")
    rest = [p for p in people if p not in fixes]
    plain = spark.createDataFrame([(p,) for p in rest], "found string")
    made = fixes | {r.found: r.s for r in plain.select("found", pii.surrogate(plain["found"], "k").alias("s")).collect()}
    assert len(made) == len(people) == len(set(made.values()))
    assert not set(made.values()) & set(people)
    for i in range(0, 21_500, 7):
        assert made[f"Mr {name(i)}"].split()[-1] == made[f"Mr John {name(i)}"].split()[-1]


def test_a_full_block_of_private_addresses(spark):
    found = spark.range(1 << 16).selectExpr("concat('192.168.', id div 256, '.', id % 256) as found").where("id < 36000")
    fixes = fixed(found, "k")
    real = {r.found for r in found.collect()}
    assert len(set(fixes.values())) == len(fixes) > 10_000
    assert not set(fixes.values()) & real
    assert all(x.startswith(("192.168.", "10.")) for x in fixes.values())
