"""Changes of fact tables: adding, joining, renaming, removing, merging. All give new tables."""

from __future__ import annotations

from functools import reduce
from itertools import count
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadloom.operators.closure import MERGE, bounded
from quadloom.operators.components import connected_components
from quadloom.sources.staging import staged

FACT = ["graph_id", "s", "t", "o", "pid"]
#: Predicates of which a concept has at most one with the same arguments.
UNIQUE = ("user_aware", "time", "type", "not", "maybe")


def add(quads: DataFrame, new: DataFrame) -> DataFrame:
    """quads and those new facts whose predicate id isn't there yet; one of each id."""
    fresh = new.select(FACT).dropDuplicates(["graph_id", "pid"]).join(quads.select("graph_id", "pid"), ["graph_id", "pid"], "left_anti")
    return quads.select(FACT).unionByName(fresh.select(FACT))


def renamed(quads: DataFrame, names: DataFrame, columns: tuple[str, ...] = ("s", "t", "o", "pid")) -> DataFrame:
    """Facts with nodes replaced by names (graph_id, old, new); what has no row there stays."""
    out = quads
    for c in columns:
        m = names.select("graph_id", F.col("old").alias(c), F.col("new").alias("_new"))
        out = out.join(m, ["graph_id", c], "left").withColumn(c, F.coalesce("_new", c)).drop("_new")
    return out.select(quads.columns)


def fresh_ids(items: DataFrame, namespace: str, start: int = 0) -> DataFrame:
    """(item, id): namespace and a number from start on, in the order of items.

    Numbers come from counts of range partitions, not from one sorted task.
    """
    from pyspark.sql.functions import monotonically_increasing_id, spark_partition_id

    n = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = items.select("item").distinct().repartitionByRange(n, "item").sortWithinPartitions("item")
    rows = staged(ranged.select("item", spark_partition_id().alias("p"), monotonically_increasing_id().alias("m")))
    parts = rows.groupBy("p").agg(F.min("m").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = parts.select("p", (before - F.col("first")).alias("shift"))  # a row for each partition
    return rows.join(F.broadcast(shift), "p").select("item", F.concat(F.lit(namespace), (F.col("m") + F.col("shift") + start).cast("string")).alias("id"))


def concatenated(quads: DataFrame, other: DataFrame, namespace: str, own: Column, without: tuple[str, ...] = ()) -> DataFrame:
    """quads and the facts of other, whose generated nodes (where own(column) holds) move to a namespace of their own."""
    move = lambda c: F.when(own(F.col(c)), F.concat(F.lit(namespace), c)).otherwise(F.col(c)).alias(c)
    moved = other.where(~F.col("t").isin(*without)) if without else other
    return add(quads, moved.select("graph_id", move("s"), "t", move("o"), move("pid")))


#: Characters at the start of an id that tell kinds of ids apart, and kinds that are told apart at most.
START, KINDS = 2, 200


def _kind(node: str | Column) -> Column:
    return F.substring(node, 1, START)


def _kinds(ids: DataFrame) -> list[str] | None:
    """The kinds of ids (one column); None where they are too many to be of use."""
    found = ids.select(_kind(ids.columns[0]).alias("k")).distinct().limit(KINDS + 1).collect()
    return None if len(found) > KINDS else [r.k for r in found if r.k is not None]


def _of(kinds: list[str] | None, node: str | Column) -> Column:
    """Whether a node may be one of ids of these kinds."""
    return F.lit(True) if kinds is None else F.coalesce(_kind(node).isin(kinds), F.lit(False))


def _holding(quads: DataFrame, ids: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(graph_id, pid) of facts that hold one of ids (graph_id, node), stored, in these columns; a fact may come twice.

    Ids of other kinds aren't shuffled.
    """
    kinds = _kinds(ids.select("node"))
    held = F.array_compact(F.array(*(F.when(_of(kinds, c), F.col(c)) for c in columns)))
    some = quads.where(reduce(or_, (_of(kinds, c) for c in columns))).select("graph_id", "pid", F.explode(held).alias("node"))
    return some.join(ids, ["graph_id", "node"], "left_semi").select("graph_id", "pid")


def remove(quads: DataFrame, concepts: DataFrame | None = None, pids: DataFrame | None = None, max_rounds: int | None = None) -> DataFrame:
    """quads without the given concepts (graph_id, c) or predicates (graph_id, pid), and without facts about what goes.

    A loop until nothing more goes: facts whose subject or object has gone go too. Types don't cascade. More than
    max_rounds is an error. quads is read in each round, so one that is costly to make is better stored before; only what goes is
    stored here, and a fact is shuffled only where an id in it starts like those that it is compared with.
    """
    gone = None
    if concepts is not None:
        gone = _holding(quads, staged(concepts.select("graph_id", F.col("c").alias("node")).distinct()), ("s", "o", "pid"))
    if pids is not None:
        gone = pids.select("graph_id", "pid") if gone is None else gone.union(pids.select("graph_id", "pid"))
    new = gone = staged(gone)
    for n in count(1):
        found = staged(_holding(quads, new.withColumnRenamed("pid", "node"), ("s", "o")))
        known = gone.where(_of(_kinds(found.select("pid")), "pid"))
        new = found if known.isEmpty() else staged(found.join(known, ["graph_id", "pid"], "left_anti").distinct())
        if new.isEmpty():
            break
        bounded(n, max_rounds)
        gone = gone.union(new)
        if n % MERGE == 0:
            gone = staged(gone)
    touched = _of(_kinds(gone.select("pid")), "pid")
    gone = gone.where(_of(_kinds(quads.select("pid")), "pid"))
    return quads.where(touched).join(gone, ["graph_id", "pid"], "left_anti").select(FACT).union(quads.where(~touched).select(FACT))


def representatives(pairs: DataFrame, generated: str | None = None) -> DataFrame:
    """(old, new) for nodes of pairs (a, b), linked in groups: the smallest one that isn't generated, else the smallest.

    With a column graph_id in pairs nodes are linked within their graph, and it is in the result.
    """
    own = "graph_id" in pairs.columns
    node = lambda c: F.struct("graph_id", F.col(c).alias("node")) if own else F.struct(F.col(c).alias("node"))
    groups = connected_components(pairs.select(node("a").alias("a"), node("b").alias("b")), "a", "b")
    name = F.col("node.node")
    rank = F.struct(name.rlike(generated) if generated else F.lit(False), name.alias("node"))
    best = groups.groupBy("component").agg(F.min(rank).alias("m"))
    keep = [F.col("node.graph_id").alias("graph_id")] if own else []
    return groups.join(best, "component").select(*keep, name.alias("old"), F.col("m.node").alias("new"))


def merged(quads: DataFrame, pairs: DataFrame, generated: str | None = None, max_rounds: int | None = None) -> DataFrame:
    """quads after merging the pairs (graph_id, a, b) of nodes; each graph's pairs touch that graph alone.

    Groups go to one representative each. Facts of a UNIQUE type that then agree in s, t and o become one; merged
    predicate ids force their subjects and objects to merge as well, until nothing more is forced. A round
    touches only the facts that hold a renamed node; the forced pairs come from those that agree with one of them.
    """
    quads, wanted = staged(quads.select(FACT).distinct()), pairs.select("graph_id", "a", "b")
    first = True
    for n in count(1):
        names = staged(representatives(wanted, generated).where("old <> new"))
        if names.isEmpty() and not first:
            return quads
        old = names.select("graph_id", F.col("old").alias("_node"))
        holds = quads.select(*FACT, F.explode(F.array_distinct(F.array_compact(F.array("s", "t", "o", "pid")))).alias("_node"))
        touched = staged(holds.join(old, ["graph_id", "_node"], "left_semi").select(FACT).distinct())
        new = staged(renamed(touched, names).select(FACT).distinct())
        key = ["graph_id", "pid"]
        rest = quads.join(touched.select(*key, "s", "t", F.col("o").alias("_o")).alias("x"), [quads[c] == F.col(f"x.{c}") for c in (*key, "s", "t")] + [quads["o"].eqNullSafe(F.col("x._o"))], "left_anti")
        quads = staged(rest.union(new).distinct())
        # in the first round facts may agree without any renaming; later only with a renamed one
        near = quads if first else quads.join(new.select("graph_id", "s", "t").distinct(), ["graph_id", "s", "t"], "left_semi")
        same = near.where(F.col("t").isin(*UNIQUE)).groupBy("graph_id", "s", "t", "o").agg(F.min("pid").alias("a"), F.collect_set("pid").alias("all")).where(F.size("all") > 1)
        forced = same.select("graph_id", "a", F.explode("all").alias("b")).where("a <> b")
        ids = quads if first else quads.join(new.select(*key).distinct(), key, "left_semi")
        by_pid = ids.groupBy(*key).agg(F.min("s").alias("s1"), F.max("s").alias("s2"), F.min("o").alias("o1"), F.max("o").alias("o2"))
        forced = forced.union(by_pid.where("s1 <> s2").select("graph_id", "s1", "s2")).union(by_pid.where("o1 <> o2").select("graph_id", "o1", "o2"))
        wanted, first = staged(forced.distinct()), False
        if wanted.isEmpty():
            return quads
        bounded(n, max_rounds)
