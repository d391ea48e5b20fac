"""Lookups over facts (graph_id, s, t, o, pid)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadloom.operators.closure import types


def predicates(quads: DataFrame, bound: DataFrame | None = None) -> DataFrame:
    """Facts by any of s, t and o: those that agree with a row of bound in all its columns; all without bound.

    A bound s and t without o finds one- and two-argument predicates alike; a null o in bound finds those with one.
    """
    facts = quads.select("s", "t", "o", "pid")
    return facts if bound is None else facts.join(bound.distinct().alias("b"), agree("b", facts, bound.columns), "left_semi").select("s", "t", "o", "pid")


def agree(alias: str, rows: DataFrame, columns: list[str]) -> Column:
    """Equality with the columns of an aliased table; null objects agree with each other."""
    return reduce(Column.__and__, (rows[c].eqNullSafe(F.col(f"{alias}.{c}")) if c == "o" else rows[c] == F.col(f"{alias}.{c}") for c in columns))


def existing(asked: DataFrame, quads: DataFrame) -> DataFrame:
    """The rows of asked (any of s, t, o, pid) that some fact agrees with."""
    return asked.join(quads.alias("b"), agree("b", asked, asked.columns), "left_semi")


def subjects(quads: DataFrame, t: str) -> DataFrame:
    return quads.where(F.col("t") == t).select(F.col("o").alias("concept"), F.col("s").alias("subject")).distinct()


def objects(quads: DataFrame, t: str) -> DataFrame:
    return quads.where((F.col("t") == t) & F.col("o").isNotNull()).select(F.col("s").alias("concept"), F.col("o").alias("object")).distinct()


def concepts(quads: DataFrame, isolated: DataFrame | None = None) -> DataFrame:
    """(graph_id, c): every node, be it subject, type, object, predicate id, or isolated."""
    nodes = quads.select("graph_id", F.explode(F.array("s", "t", "o", "pid")).alias("c")).where("c IS NOT NULL")
    return (nodes if isolated is None else nodes.unionByName(isolated)).distinct()


def incident(quads: DataFrame) -> DataFrame:
    """(graph_id, c, side, pid, t): the facts about each node; side 0 as subject, 1 as object."""
    s = quads.select("graph_id", F.col("s").alias("c"), F.lit(0).alias("side"), "pid", "t")
    return s.union(quads.where("o IS NOT NULL").select("graph_id", "o", F.lit(1), "pid", "t"))


def limited(rows: DataFrame, limit: int) -> DataFrame:
    """At most `limit` facts of each node, subject side first."""
    first = Window.partitionBy("graph_id", "c").orderBy("side", "pid")
    return rows.withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= limit).drop("_k")


def subgraph(quads: DataFrame, of_types: list[str], without: list[str]) -> DataFrame:
    """Facts between nodes of the given types, leaving out some predicate types."""
    inside = types(quads.where("t = 'type'")).where(F.col("sup").isin(*of_types)).select("c").distinct()
    rows = quads.where(~F.col("t").isin(*without))
    return rows.join(inside.withColumnRenamed("c", "s"), "s", "left_semi").join(inside.withColumnRenamed("c", "o"), "o", "left_semi")


def pullers(quads: DataFrame, salience: DataFrame, relations: list[str]) -> DataFrame:
    """Concepts with salience that take part in a real relation, are no type or expression, and no number."""
    real = quads.where(F.col("t").isin(*relations))
    part = real.select(F.col("s").alias("c")).union(real.select("o")).distinct()
    kinds = quads.where(F.col("t").isin("type", "expr")).select(F.col("o").alias("c")).distinct()
    some = salience.where(F.col("salience") > 0).where(~F.col("c").rlike("^[0-9]+$"))
    return some.join(part, "c", "left_semi").join(kinds, "c", "left_anti").select("c")


def undefined(quads: DataFrame) -> DataFrame:
    """Nodes that facts use, without a type, not types themselves and not predicate ids."""
    used = quads.where("t NOT IN ('type', 'expr')").select(F.explode(F.array("s", "o")).alias("c")).where("c IS NOT NULL").distinct()
    kinds = quads.where("t = 'type'")
    known = kinds.select(F.col("s").alias("c")).union(kinds.select("o")).union(quads.select("pid"))
    return used.join(known, "c", "left_anti")


def conflicts(facts: DataFrame) -> DataFrame:
    """(pid, n): predicate ids that stand for n > 1 different facts."""
    one = F.concat_ws("|", "s", "t", F.coalesce("o", F.lit("")))
    return facts.groupBy("pid").agg(F.count_distinct(one).alias("n")).where("n > 1")


def degree(quads: DataFrame) -> DataFrame:
    roles = F.explode(F.array(*[F.struct(F.col(r).alias("node"), F.lit(r).alias("role")) for r in ("s", "t", "o")]))
    return quads.select(roles.alias("x")).select("x.*").where("node IS NOT NULL").groupBy("node", "role").agg(F.count("*").alias("n"))


def rendered(quads: DataFrame) -> DataFrame:
    """(graph_id, t, pid, text): id/type(s,o) of every fact, or id/type(s). A row for each fact, as a type may have any number."""
    one = F.concat("pid", F.lit("/"), "t", F.lit("("), "s", F.coalesce(F.concat(F.lit(","), "o"), F.lit("")), F.lit(")"))
    return quads.select("graph_id", "t", "pid", one.alias("text"))


def labelled(nodes: DataFrame, quads: DataFrame) -> DataFrame:
    """(c, label): a concept's expression, else its type, else its own id; the smallest of several."""
    expr = quads.where("t = 'expr'").groupBy(F.col("o").alias("c")).agg(F.min("s").alias("_e"))
    kind = quads.where("t = 'type'").groupBy(F.col("s").alias("c")).agg(F.min("o").alias("_k"))
    return nodes.join(expr, "c", "left").join(kind, "c", "left").select("c", F.coalesce("_e", "_k", "c").alias("label"))
