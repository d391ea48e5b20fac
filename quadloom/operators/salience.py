"""Relevance: propagation over facts, generic message passing, decay, and confidence arithmetic."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.sources.staging import small, staged

#: What a predicate loses against the mean of its arguments, and a fact against its evidence.
ASSOCIATION_LOSS, EVIDENCE_LOSS, DECAY = 0.3, 0.1, 0.1


def propagate(quads: DataFrame, salience: DataFrame, rounds: int) -> DataFrame:
    """(c, salience) after so many synchronous rounds.

    In a round each node takes the largest of its own salience, that of predicates it is an argument of, and, for a
    predicate, the mean of its arguments' less ASSOCIATION_LOSS. Nodes without a given salience start from 0.

    A plain predicate, one row that is nobody's argument and has no given salience, only hands on what its arguments had, so its own
    value is worked out at the end alone. Until then a node takes what its most salient neighbour of two rounds ago makes of their
    mean; where given saliences lie close enough for no node that rises to lift another, that neighbour is the same in all rounds.
    """
    facts = staged(quads.select("pid", "s", "o").where("s IS NOT NULL OR o IS NOT NULL"))
    ends = facts.select(F.explode(F.array_compact(F.array("s", "o"))).alias("c")).distinct()
    given = lambda nodes: nodes.join(salience, "c", "left").select("c", F.coalesce("salience", F.lit(0.0)).alias("salience"))
    now = staged(given(ends))
    # predicates that aren't plain, told by a hash of their id; a few others among them do no harm
    seen = facts.select(F.xxhash64("pid").alias("h"), F.lit(1).alias("p")).union(now.select("c").union(salience.select("c")).select(F.xxhash64("c"), F.lit(0)))
    other = small(staged(seen.groupBy("h").agg(F.sum("p").alias("n"), F.count("*").alias("m")).where("n > 1 OR (n = 1 AND m > 1)").select("h")))
    hashed = facts.withColumn("h", F.xxhash64("pid"))
    rest, plain = staged(hashed.join(other, "h", "left_semi").drop("h")), facts
    if some := not rest.isEmpty():
        plain = staged(hashed.join(other, "h", "left_anti").drop("h"))
        now = staged(given(ends.union(rest.select("pid")).distinct()))
    args = rest.select("pid", F.explode(F.array_compact(F.array("s", "o"))).alias("c"))
    low, high = now.agg(F.min("salience"), F.max("salience")).first()
    # who rises gets less than high - 2 losses; who lifts another has more than low + 2 losses
    steady = not some and low is not None and low >= 0 and high - low < 4 * ASSOCIATION_LOSS - 1e-6
    none = F.lit(None).cast("double")
    now = now.select("c", "salience", none.alias("was"), none.alias("best"))
    for n in range(1, rounds + 1):
        if n == 2 or (n > 2 and not steady):  # from what the neighbours had two rounds ago, as predicates had it a round ago
            best = _best_neighbour(plain, now.select("c", F.col("was").alias("salience")))
            now = now.drop("best").join(best, "c", "left")
        rows = now.select("c", F.greatest("salience", _mean(F.col("was"), F.col("best")), F.lit(0.0)).alias("next"), "salience", "best")
        if some:
            up = args.join(now, "c").groupBy(F.col("pid").alias("c")).agg((F.avg("salience") - ASSOCIATION_LOSS).alias("m"))
            down = args.join(now.select(F.col("c").alias("pid"), "salience"), "pid").select("c", "salience")
            rows = rows.union(up.select("c", "m", none, none)).union(down.select("c", "salience", none, none)).groupBy("c").agg(F.max("next").alias("next"), F.max("salience").alias("salience"), F.max("best").alias("best"))
        now = rows.select("c", F.col("next").alias("salience"), F.col("salience").alias("was"), "best")
        now = now if steady and n < rounds else staged(now)
    if rounds == 0:
        said = plain.select(F.col("pid").alias("c"), F.lit(0.0).alias("salience"))
    else:
        of = lambda end: now.select(F.col("c").alias(end), F.col("was").alias(f"{end}_was")).hint("shuffle_hash")
        both = plain.join(of("s"), "s", "left").select("pid", "o", "s_was").join(of("o"), "o", "left")
        said = both.select(F.col("pid").alias("c"), F.greatest(F.coalesce(_mean(F.col("s_was"), F.col("o_was")), F.coalesce("s_was", "o_was") - ASSOCIATION_LOSS), F.lit(0.0)).alias("salience"))
    return now.select("c", "salience").union(said)


def _mean(a: Column, b: Column) -> Column:
    """What a predicate of two arguments makes of them."""
    return (a + b) / 2 - ASSOCIATION_LOSS


def _best_neighbour(facts: DataFrame, now: DataFrame) -> DataFrame:
    """(c, best): the largest salience among the nodes that share a fact with c; those too small to lift any are left out."""
    low = now.agg(F.min("salience")).first()[0]
    high = now.where(F.col("salience") > F.lit(low) + 2 * ASSOCIATION_LOSS - 1e-6)
    pairs = facts.where("s IS NOT NULL AND o IS NOT NULL").select("s", "o")
    told = [pairs.join(high.select(F.col("c").alias(a), "salience").hint("shuffle_hash"), a).select(F.col(b).alias("c"), "salience") for a, b in ("so", "os")]
    return told[0].union(told[1]).groupBy("c").agg(F.max("salience").alias("best"))


def matvec(edges: DataFrame, salience: DataFrame, weight: float = 0.1, cap: float = 1.0) -> DataFrame:
    """One step of a sparse matrix and vector product: a node adds weight times its neighbours' salience, up to cap."""
    moved = edges.join(salience.withColumnRenamed("c", "src"), "src").groupBy(F.col("dst").alias("c")).agg((F.sum("salience") * weight).alias("add"))
    return salience.join(moved, "c", "left").select("c", F.least(F.lit(cap), F.col("salience") + F.coalesce("add", F.lit(0.0))).alias("salience"))


def pregel(nodes: DataFrame, edges: DataFrame, gather: Column, update: Callable[[Column, Column], Column], rounds: int) -> DataFrame:
    """(c, value) after synchronous rounds: gather sums up the in-messages (columns value and label of the edges), update
    makes the new value from the old one and what was gathered; nodes without messages keep theirs."""
    now = nodes
    for _ in range(rounds):
        sent = edges.join(now.withColumnRenamed("c", "src"), "src").groupBy(F.col("dst").alias("c")).agg(gather.alias("_in"))
        now = staged(now.join(sent, "c", "left").select("c", F.when(F.col("_in").isNull(), F.col("value")).otherwise(update(F.col("value"), F.col("_in"))).alias("value")))
    return now


def all_of(x: Column) -> Column:
    """Confidence of a conjunction: the product."""
    return F.product(x)


def any_of(x: Column) -> Column:
    """Confidence of a disjunction: one less the product of what is left to doubt."""
    return 1 - F.product(1 - x)


def signed_or(x: Column) -> Column:
    """any_of for confidences from -1 to 1: doubts count only where all are doubts, and then as the product of their strengths."""
    return F.when(F.max(x) >= 0, 1 - F.product(1 - F.greatest(x, F.lit(0.0)))).otherwise(-F.product(-x))


def signed_and(x: Column) -> Column:
    """all_of for confidences from -1 to 1: with a doubt among them, the disjunction of the doubts."""
    return F.when(F.min(x) >= 0, F.product(x)).otherwise(F.product(1 + F.least(x, F.lit(0.0))) - 1)


def confidence(nodes: DataFrame, links: DataFrame, rounds: int) -> DataFrame:
    """(c, conf) after so many synchronous rounds over evidence links (src, dst, label), label one of and, nand, or, nor.

    In a round a node's evidence of each label is taken together, nand and nor with the opposite sign; what its labels
    say and its own given confidence count as alternatives. nodes: (c, conf) from -1 to 1, or null where nothing is known
    yet; evidence that isn't known says nothing.
    """
    edges = staged(links.select("src", "dst", "label"))
    given = staged(nodes.select("c", F.col("conf").alias("own")))
    now = given.select("c", F.col("own").alias("conf"))
    x = F.col("conf")
    both = F.when(F.col("label").isin("and", "nand"), F.col("a")).otherwise(F.col("b"))
    sign = F.when(F.col("label").isin("nand", "nor"), -1.0).otherwise(1.0)
    for _ in range(rounds):
        told = edges.join(now.where("conf IS NOT NULL").withColumnRenamed("c", "src"), "src").groupBy("dst", "label").agg(signed_and(x).alias("a"), signed_or(x).alias("b"))
        says = told.select(F.col("dst").alias("c"), (both * sign).alias("conf"))
        all_ = says.union(given.where("own IS NOT NULL").select("c", "own")).groupBy("c").agg(signed_or(x).alias("conf"))
        now = staged(given.join(all_, "c", "left").select("c", "conf"))
    return now


def decayed(salience: Column, turns: Column) -> Column:
    return F.greatest(F.lit(0.0), salience - DECAY * turns)


def considered(facts: DataFrame) -> DataFrame:
    """(batch, salience) of new facts from what they rest on: rows (batch, kind, salience), kind being association or evidence.

    Both kinds at once give none, as neither rule holds.
    """
    mean = lambda k: F.avg(F.when(F.col("kind") == k, F.coalesce("salience", F.lit(0.0))))
    a, e = mean("association") - ASSOCIATION_LOSS, mean("evidence") - EVIDENCE_LOSS
    return facts.groupBy("batch").agg(F.when(a.isNull(), e).when(e.isNull(), a).alias("salience"))
