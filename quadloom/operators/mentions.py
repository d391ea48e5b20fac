"""Nodes for what texts mention: a known instance stands for itself, a class gets an instance of its own at each place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.operators.mutate import fresh_ids


def instantiated(hits: DataFrame, keys: list[str], concepts: DataFrame, instances: DataFrame, namespace: str, used: DataFrame, made: DataFrame | None = None) -> DataFrame:
    """(keys, start, end, concept, node, fresh): a node for each hit (keys, start, end, phrase) and each concept of its phrase.

    concepts (phrase, concept) is the dictionary. A concept among instances (concept) is its own node. Any other is a class:
    its mention is a new instance, namespace and a number beyond all such ids in use (used: id), in the order of keys,
    start, end and concept, from counts of range partitions. Mentions that an earlier call made (made: its result) keep their
    nodes, so texts can be added; their ids count as used.

    Hits given twice are one mention. Phrases without a concept give nothing, and no more do null phrases; null keys are keys.
    """
    place = [*keys, "start", "end", "concept"]
    told = hits.join(concepts.where("concept IS NOT NULL").select("phrase", "concept").distinct(), "phrase").select(place).distinct()
    own = instances.select("concept").distinct()
    known = told.join(own, "concept", "left_semi").select(*place, F.col("concept").alias("node"), F.lit(False).alias("fresh"))
    item = F.struct(place).alias("item")
    new, ids = told.join(own, "concept", "left_anti").select(place).select(item), used.select(F.col("id").cast("string"))
    if made is not None:
        old = made.where("fresh").select(item, F.col("node").alias("id"))
        kept = new.join(old, "item")
        new, ids = new.join(old, "item", "left_anti"), ids.union(old.select("id"))
    number = F.when(F.col("id").startswith(namespace), F.substring("id", len(namespace) + 1, 18))
    last = ids.select(F.max(F.when(number.rlike("^[0-9]+$"), number.cast("long")))).first()[0]
    given = fresh_ids(new, namespace, 0 if last is None else last + 1)
    if made is not None:
        given = given.union(kept.select("item", "id"))
    return known.union(given.select("item.*", F.col("id").alias("node"), F.lit(True).alias("fresh")))


def mention_facts(mentions: DataFrame, keys: list[str]) -> DataFrame:
    """(graph_id, s, t, o, pid): a small graph for each span of instantiated(), named by its keys, start and end.

    A new instance has its class as type; the node is the focus and the concept the centre.
    """
    o = lambda c: c.cast("string").alias("o")
    fact = lambda s, t, x: F.struct(F.col(s).alias("s"), F.lit(t).alias("t"), o(x))
    none = F.lit(None)
    facts = F.array(F.when(F.col("fresh"), fact("node", "type", F.col("concept"))), fact("node", "focus", none), fact("concept", "center", none))
    span = F.concat_ws("_", *(F.col(k).cast("string") for k in keys), F.col("start").cast("string"), F.col("end").cast("string"))
    rows = mentions.select(span.alias("graph_id"), F.explode(F.array_compact(facts)).alias("f")).select("graph_id", "f.*").distinct()
    return rows.withColumn("pid", F.concat(F.lit("q:"), "s", F.lit("|"), "t", F.lit("|"), F.coalesce("o", F.lit(""))))
