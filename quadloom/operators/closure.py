"""Closures over edges: a loop of joins that stops when nothing new is reached."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.sources.staging import staged

#: Rounds after which the tables of a loop are put together, so that plans don't grow with the rounds.
MERGE = 16


def closure(start: DataFrame, edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(c, sup): all (c, x) of start, and (c, y) for every edge (src, dst) from a reached x to y.

    Semi-naive: only pairs new in the last round are joined with the edges, and those known are left out by an
    anti-join, so cycles end. Every round is written, so that lineage stays short and lost executors cost one round.
    Goes on until nothing is new, in as many rounds as the longest path has edges; more than max_rounds is an error.
    """
    seen = staged(start.select("c", "sup").distinct())
    new = seen
    edges = staged(edges.select(F.col("src").alias("sup"), F.col("dst").alias("_next")).distinct())
    for n in count(1):
        step = new.join(edges, "sup").select("c", F.col("_next").alias("sup")).distinct()
        new = staged(step.join(seen, ["c", "sup"], "left_anti"))
        if new.isEmpty():
            return seen
        bounded(n, max_rounds)
        seen = seen.union(new)
        if n % MERGE == 0:
            seen = staged(seen)  # one table instead of many


def bounded(n: int, max_rounds: int | None) -> None:
    """Raise when a loop with something left to do has had its rounds."""
    if max_rounds is not None and n >= max_rounds:
        raise RuntimeError(f"not finished after {max_rounds} rounds")


def type_edges(quads: DataFrame) -> DataFrame:
    return quads.where("t = 'type' AND s <> o").select(F.col("s").alias("src"), F.col("o").alias("dst"))


def types(quads: DataFrame, predicates: bool = False) -> DataFrame:
    """(c, sup): every concept with all its types, itself included; predicates: also predicate ids by their type.

    The classes, that have something below them, are few; their closure is built by the loop, and the instances
    join it once.
    """
    edges = staged(type_edges(quads).distinct())
    classes = edges.select(F.col("dst").alias("c")).distinct()
    upper = edges.join(classes, F.col("src") == F.col("c"), "left_semi")
    top = closure(classes.select("c", F.col("c").alias("sup")), upper)
    below = edges.select(F.col("src").alias("c"), F.col("dst").alias("mid"))
    if predicates:
        below = below.union(quads.where("t <> 'type'").select("pid", "t"))
        used = quads.where("t <> 'type'").select(F.col("t").alias("c")).distinct()
        above = edges.join(used, F.col("src") == F.col("c")).select("c", F.col("dst").alias("mid"))
        above = above.join(top.select(F.col("c").alias("mid"), "sup"), "mid").select("c", "sup")
        top = top.union(used.select("c", F.col("c").alias("sup"))).union(above).distinct()
    own = below.select("c", F.col("c").alias("sup"))
    lifted = below.join(top.select(F.col("c").alias("mid"), "sup"), "mid").select("c", "sup")
    return top.union(own).union(lifted).distinct()


def types_within(quads: DataFrame, above: DataFrame) -> DataFrame:
    """(graph_id, c, sup): the nodes of each graph with all their types, by its own facts and above, and by no other graph's.

    above: (c, sup), the types that hold in every graph, complete.
    """
    nodes = quads.select("graph_id", F.explode(F.array_compact(F.array("s", "t", "o", "pid"))).alias("c")).distinct()
    lifted = nodes.join(above.where("c <> sup"), "c").select("graph_id", F.col("c").alias("src"), F.col("sup").alias("dst"))
    own = quads.where("t = 'type' AND s <> o").select("graph_id", F.col("s").alias("src"), F.col("o").alias("dst"))
    edges = own.union(lifted)
    node = lambda c: F.struct("graph_id", F.col(c).alias("n"))
    out = types(edges.select(node("src").alias("s"), F.lit("type").alias("t"), node("dst").alias("o")))
    return out.select(F.col("c.graph_id").alias("graph_id"), F.col("c.n").alias("c"), F.col("sup.n").alias("sup"))


def paths(edges: DataFrame) -> DataFrame:
    """(start, end, path): from every source the ways `a -> b -> c` along edges (src, dst) to where they end.

    A way ends where no edge goes on to a node that isn't on it yet, so cycles end as well.
    """
    edges = staged(edges.select("src", "dst").where("src <> dst").distinct())
    rows, done = edges.select(F.col("src").alias("start"), F.col("src").alias("end"), F.array("src").alias("path")).distinct(), []
    while True:
        on = rows.join(edges, F.col("end") == F.col("src"), "left").withColumn("dst", F.when(~F.array_contains("path", F.col("dst")), F.col("dst")))
        on = staged(on.groupBy("start", "end", "path").agg(F.collect_set("dst").alias("more")))
        done.append(on.where(F.size("more") == 0).select("start", "end", F.array_join("path", " -> ").alias("path")))
        rows = on.select("start", F.explode("more").alias("end"), "path").select("start", "end", F.array_append("path", F.col("end")).alias("path"))
        if rows.isEmpty():
            return reduce(DataFrame.union, done)


def reach(start: DataFrame, edges: DataFrame, hops: int | None = None) -> DataFrame:
    """(c, node, hop): nodes within so many undirected steps of each start (c), or any number, with the fewest steps."""
    both = edges.select("src", "dst").union(edges.select("dst", "src")).distinct()
    seen = start.select("c", F.col("c").alias("node"), F.lit(0).alias("hop"))
    new = seen
    for k in count(1):
        if hops is not None and k > hops:
            return seen
        step = new.join(both, F.col("node") == F.col("src")).select("c", F.col("dst").alias("node")).distinct()
        new = staged(step.join(seen, ["c", "node"], "left_anti").select("c", "node", F.lit(k).alias("hop")))
        if new.isEmpty():
            return seen
        seen = seen.union(new)
