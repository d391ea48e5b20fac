"""Retrieval of facts around concepts: candidates, shared neighbours, budgets and set containment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadloom.operators.closure import closure
from quadloom.operators.match import match
from quadloom.sources.staging import small, staged


def meeting(quads: DataFrame, one: list[tuple], other: list[tuple]) -> DataFrame:
    """Matches of a pattern with a cycle, cut into two paths that share their ends: each path is matched by itself and
    they meet on all shared variables at once, so neither end's fan-out multiplies the other's."""
    a, b = match(quads, one), match(quads, other)
    return a.join(b, [c for c in b.columns if c in a.columns])


def having_all(have: DataFrame, needed: list[str]) -> DataFrame:
    """(c): nodes of have (c, a) with every needed attribute."""
    some = have.where(F.col("a").isin(*needed)).distinct()
    return some.groupBy("c").agg(F.count("*").alias("n")).where(F.col("n") == len(set(needed))).select("c")


def quantities(values: DataFrame, **bounds: float) -> DataFrame:
    """Rows whose num meets all bounds, given as eq, ne, gt, lt, ge or le."""
    test = {"eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "gt": lambda a, b: a > b, "lt": lambda a, b: a < b, "ge": lambda a, b: a >= b, "le": lambda a, b: a <= b}
    for k, v in bounds.items():
        values = values.where(test[k](F.col("num"), F.lit(v)))
    return values


def first_of_each(rows: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each group; Spark cuts each task's rows to n before the shuffle."""
    first = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= n).drop("_k")


def within_reach(start: DataFrame, edges: DataFrame, hops: int, branch: int | None = None, limit: int | None = None) -> DataFrame:
    """(node, hop, weight): what lies within so many hops of the nodes start (c) along edges (src, dst, weight), with the fewest hops and
    the greatest weight of an edge that leads there in that hop.

    branch: only so many edges of a node are followed, the heaviest, ties to the smaller dst; they are cut once, before any hop, and in
    each task before the shuffle. limit: only so many nodes are kept, nearer ones first, then heavier, then smaller ones; each task
    sends no more than that.
    """
    cut = edges.groupBy("src", "dst").agg(F.max("weight").alias("weight"))
    cut = staged(cut if branch is None else first_of_each(cut, ["src"], [F.desc("weight"), "dst"], branch))
    new = seen = start.select(F.col("c").alias("node")).distinct()
    out = None
    for k in range(1, hops + 1):
        step = new.join(cut, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.max("weight").alias("weight"))
        found = staged(step.join(seen, "node", "left_anti").select("node", F.lit(k).alias("hop"), "weight"))
        out = found if out is None else out.union(found)
        new, seen = found.select("node"), seen.union(found.select("node"))
    return out if limit is None else out.orderBy("hop", F.desc("weight"), "node").limit(limit)


def shared_neighbours(edges: DataFrame) -> DataFrame:
    """(a, b, node): nodes next to two of the few pullers in edges (c, node), a < b."""
    other = edges.select(F.col("c").alias("b"), "node")
    return edges.select(F.col("c").alias("a"), "node").join(other, "node").where("a < b")


def within_budget(nodes: DataFrame, budget: int) -> DataFrame:
    """Nodes (node, n) in the order of n, most first, while their sum stays within the budget.

    n is 1 or more, so at most `budget` rows can fit; only as many are ordered in one task.
    """
    top = nodes.orderBy(F.desc("n"), "node").limit(budget)
    total = F.sum("n").over(Window.orderBy(F.desc("n"), "node").rowsBetween(Window.unboundedPreceding, 0))
    return top.withColumn("_total", total).where(F.col("_total") <= budget).drop("_total")


def pull(pullers: DataFrame, neighbours: DataFrame, structure: DataFrame, budget: int) -> DataFrame:
    """(a, b, node, n): what is pulled in, in order, while the facts it brings, n each, stay within one budget.

    pullers: (c, rank), the most salient concepts, no rank given twice; neighbours: (c, node); structure: (node, pid) facts that come with a node.
    What two pullers share comes first, by their ranks, then what one has alone (b null). Items without new facts are free
    and left out. The first item that doesn't fit ends the pull.
    """
    near = neighbours.join(small(pullers), "c").select("c", "rank", "node").distinct()
    # every item brings a fact, so a node's items with pullers beyond its first budget + 1 come when the budget is spent
    place = F.row_number().over(Window.partitionBy("node").orderBy("rank", "c"))
    near = near.withColumn("_k", place).where(F.col("_k") <= budget + 1).drop("_k")
    a, b = (near.select("node", F.col("c").alias(k), F.col("rank").alias(f"_{k}")) for k in "ab")
    pairs = a.join(b, "node").where("_a < _b")
    single = a.select("node", "a", "_a", F.lit(None).cast("string").alias("b"), F.lit(None).cast("int").alias("_b"))
    size = structure.distinct().groupBy("node").agg(F.count("*").alias("n"))
    items = pairs.select("node", "a", "_a", "b", "_b").union(single).join(size, "node")
    order = [F.col("_b").isNull(), "_a", "_b", "node"]
    top = items.orderBy(*order).limit(budget)  # each brings a fact at least
    total = F.sum("n").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return top.withColumn("_total", total).where(F.col("_total") <= budget).select("a", "b", "node", "n")


def pruned(quads: DataFrame, keep: DataFrame, of_subject: list[str], of_object: list[str], links: DataFrame | None = None) -> DataFrame:
    """The facts that kept ones (graph_id, pid) need, and no others.

    A fact needs its subject and object; a node needs its types, its facts of the types in of_subject, the facts of the types
    in of_object about it, and, with links (graph_id, src, label, dst), what its `ref` links lead to. As what is kept
    holds all arguments, nothing is left about what goes.
    """
    n = lambda c: F.struct("graph_id", F.col(c).alias("n"))
    edge = lambda rows, a, b: rows.select(n(a).alias("src"), n(b).alias("dst"))
    edges = edge(quads, "pid", "s").union(edge(quads.where("o IS NOT NULL"), "pid", "o")).union(edge(quads.where(F.col("t").isin("type", *of_subject)), "s", "pid")).union(edge(quads.where(F.col("t").isin(*of_object)), "o", "pid"))
    if links is not None:
        edges = edges.union(edge(links.where("label = 'ref'"), "src", "dst"))
    # all starts are one, as only what is reached at all matters
    reached = closure(keep.select(F.lit(0).alias("c"), n("pid").alias("sup")), edges).select("sup.*").distinct()
    return quads.join(reached.select("graph_id", F.col("n").alias("pid")), ["graph_id", "pid"], "left_semi").select(quads.columns)


def _by_rarity(sets: DataFrame) -> DataFrame:
    """(c, n, xs): each set with its size and its elements, the rarest first."""
    often = sets.groupBy("x").agg(F.count("*").alias("_often"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_often", "x"))), lambda e: e["x"])
    return sets.join(often, "x").groupBy("c").agg(F.count("*").alias("n"), ordered.alias("xs"))


#: Sets of so many elements at most are sent whole to each of their elements.
CARRIED = 64


def subsets(sets: DataFrame, share: float = 1.0) -> DataFrame:
    """(a, b): at least that share of a's elements are b's, in sets (c, x) without repeats.

    A set that lacks at most n - k of a's n elements holds one of any n - k + 1 of them, so a is looked for among the
    sets that hold one of its rarest; frequent elements make no pairs. Sets of at most CARRIED elements go there whole and are compared
    in that join, so candidates aren't shuffled; pairs with a larger one fetch both sets.
    """
    bags = staged(_by_rarity(sets.distinct()))
    asked = lambda n: (n - F.greatest(F.ceil(n * F.lit(round(share * 1000)) / 1000), F.lit(1)) + 1).cast("int")
    enough = F.size(F.array_intersect("_a", "_b")) * 1000 >= F.col("n") * round(share * 1000)
    few, many = bags.where(F.col("n") <= CARRIED), bags.where(F.col("n") > CARRIED)
    asks = lambda rows, *more: rows.select(F.col("c").alias("a"), *more, F.explode(F.slice("xs", F.lit(1), asked(F.col("n")))).alias("x"))
    held = lambda rows, *more: rows.select(F.col("c").alias("b"), *more, F.explode("xs").alias("x"))
    found = asks(few, "n", F.col("xs").alias("_a")).join(held(few, F.col("xs").alias("_b")).hint("merge"), "x").where("a <> b").where(enough).select("a", "b")
    found = found if share == 1.0 else found.distinct()  # whole sets ask under one element
    if many.isEmpty():
        return found
    pairs = asks(many).join(held(bags), "x").union(asks(few).join(held(many), "x")).where("a <> b").select("a", "b").distinct()
    both = pairs.join(bags.select(F.col("c").alias("a"), "n", F.col("xs").alias("_a")), "a").join(bags.select(F.col("c").alias("b"), F.col("xs").alias("_b")), "b")
    return found.union(both.where(enough).select("a", "b"))


def maximal(sets: DataFrame) -> DataFrame:
    """(c): sets of any size that lie in no other set; of equal sets the smallest name counts.

    Equal sets are one from the start. A set is looked for under its rarest element alone, among larger sets.
    """
    bags = staged(_by_rarity(sets.distinct()).groupBy("n", F.array_sort("xs").alias("_same")).agg(F.min("c").alias("c"), F.first("xs").alias("xs")).drop("_same"))
    asks = bags.select("c", "n", "xs", F.col("xs")[0].alias("x"))
    others = bags.select(F.col("n").alias("_n"), F.col("xs").alias("_xs"), F.explode("xs").alias("x"))
    inside = asks.join(others, "x").where("_n > n").where(F.size(F.array_except("xs", "_xs")) == 0).select("c").distinct()
    return bags.join(inside, "c", "left_anti").select("c")


def reference_candidates(pairs: DataFrame, types: DataFrame, quads: DataFrame) -> DataFrame:
    """(ref, match) without a reference itself, its own types, and classes."""
    own = types.select(F.col("c").alias("ref"), F.col("sup").alias("match"))
    classes = quads.where("t = 'type'").select(F.col("o").alias("match")).distinct()
    return pairs.where("ref <> match").join(own, ["ref", "match"], "left_anti").join(classes, "match", "left_anti").select("ref", "match")
