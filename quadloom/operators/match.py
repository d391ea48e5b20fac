"""Pattern matching over facts: a pattern is a list of (s, t, o) or (s, t, o, pid), '?x' being a variable."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Facts about a fact that take it back.
DOUBTS = ("not", "maybe")


def is_variable(term) -> bool:
    return isinstance(term, str) and term.startswith("?")


def edge_rows(quads: DataFrame, edge: tuple, subtypes: DataFrame | None = None) -> DataFrame:
    """Facts that fit one edge: graph_id and a column for each variable.

    subtypes: (c, sup) closure; a constant predicate type then also fits its sub-predicates.
    """
    terms = dict(zip(("s", "t", "o", "pid"), edge, strict=False))
    rows = quads
    if edge[2] is None:
        rows = rows.where(F.col("o").isNull())
    for column, term in terms.items():
        if term is None or is_variable(term):
            continue
        if column == "t" and subtypes is not None:
            below = subtypes.where(F.col("sup") == term).select(F.col("c").alias("t"))
            rows = rows.join(below, "t", "left_semi")
        else:
            rows = rows.where(F.col(column) == term)
    names: dict[str, str] = {}
    for column, term in terms.items():
        if is_variable(term):
            rows = rows.where(F.col(column).isNotNull())
            if term in names:
                rows = rows.where(F.col(column) == F.col(names[term]))
            else:
                names[term] = column
    return rows.select("graph_id", *[F.col(c).alias(v[1:]) for v, c in names.items()])


def ordered(pattern: list[tuple], after: tuple = ()) -> list[tuple]:
    """Edges so that each shares a variable with those before where it can, those with most constants first. after: an edge before them all."""
    left, out, bound = list(pattern), [], set(filter(is_variable, after))
    constants = lambda e: sum(not is_variable(x) for x in e)
    while left:
        edge = max(left, key=lambda e: (bool(bound & set(filter(is_variable, e))) or not bound, constants(e), -pattern.index(e)))
        left.remove(edge)
        out.append(edge)
        bound |= set(filter(is_variable, edge))
    return out


def match(quads: DataFrame | list[DataFrame], pattern: list[tuple], types: DataFrame | None = None, var_types: dict[str, str] | None = None, subpredicates: bool = False, confident: list[str] | None = None) -> DataFrame:
    """All assignments of the pattern's variables, in each graph: graph_id and a column for each variable.

    A chain of equi-joins; two variables may be bound to one node. quads: facts, or a table of facts for each edge. var_types: variables that must be of a type, by the
    closure types (c, sup). confident: variables bound to predicate ids that must not be marked not or maybe.
    """
    parts = []
    tables = quads if isinstance(quads, list) else [quads] * len(pattern)
    of = {id(edge): table for edge, table in zip(pattern, tables, strict=True)}
    for edge in ordered(pattern):
        rows = edge_rows(of[id(edge)], edge, types if subpredicates else None)
        for v, kind in (var_types or {}).items():
            if v in rows.columns:
                within = types.where(F.col("sup") == kind).select(F.col("c").alias(v)).distinct()
                rows = rows.join(within, v, "left_semi")
        for v in confident or []:
            if v in rows.columns:
                rows = without_doubt(rows, of[id(edge)], v)
        parts.append(rows)
    join = lambda a, b: a.join(b, [c for c in b.columns if c in a.columns])
    return reduce(join, parts)


def without_doubt(rows: DataFrame, quads: DataFrame, pid: str = "pid") -> DataFrame:
    """Rows whose predicate id carries no mark of DOUBTS."""
    marks = quads.where(F.col("t").isin(*DOUBTS)).select("graph_id", F.col("s").alias(pid))
    return rows.join(marks, ["graph_id", pid], "left_anti")


def with_mark(rows: DataFrame, quads: DataFrame, mark: str, pid: str = "pid") -> DataFrame:
    marks = quads.where(F.col("t") == mark).select("graph_id", F.col("s").alias(pid)).distinct()
    return rows.join(marks, ["graph_id", pid], "left_semi")
