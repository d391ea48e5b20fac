"""A graph as a spanning tree, and a tree as one string."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.operators.closure import MERGE
from quadloom.operators.components import connected_components
from quadloom.sources.staging import staged


def spanning_tree(quads: DataFrame, roots: DataFrame) -> DataFrame:
    """(graph_id, root, node, parent, label, depth): from each root (graph_id, root) all nodes that facts lead to, each once.

    Breadth first from subject to object; a node hangs on the first of its possible parents by (label, parent). Goes
    on until no new node is reached, so cycles end; the root has no parent.
    """
    edges = staged(quads.where("o IS NOT NULL AND s <> o").select("graph_id", F.col("s").alias("parent"), F.col("t").alias("label"), F.col("o").alias("node")).distinct())
    text = F.lit(None).cast("string")
    seen = new = staged(roots.select("graph_id", "root", F.col("root").alias("node"), text.alias("parent"), text.alias("label"), F.lit(0).alias("depth")).distinct())
    for k in count(1):
        step = new.select("graph_id", "root", F.col("node").alias("parent")).join(edges, ["graph_id", "parent"])
        first = step.groupBy("graph_id", "root", "node").agg(F.min(F.struct("label", "parent")).alias("m"))
        first = first.select("graph_id", "root", "node", "m.parent", "m.label", F.lit(k).alias("depth"))
        new = staged(first.join(seen, ["graph_id", "root", "node"], "left_anti").select(*seen.columns))
        if new.isEmpty():
            return seen
        seen = staged(seen.union(new)) if k % MERGE == 0 else seen.union(new)


#: Types of facts that are no links of a tree: they say what a node is called or how it stands in the talk (fixed values).
NOT_LINKS = ("expr", "def", "ref", "assert", "type", "link", "user_aware")
#: Labels in the order in which a node reached twice in a round is taken.
LABELS = ("arg0", "arg1", "link", "reverse")


def spanning_forest(quads: DataFrame, without: tuple[str, ...] = NOT_LINKS, ending: tuple[str, ...] = ("time",), asserted: str = "assert", referent: str = "ref") -> DataFrame:
    """(graph_id, root, node, parent, label, reverse, kind, depth, again): trees over nodes and facts, each node taken once.

    The first root is what is asserted (the object of `asserted`, or its subject where there is none), then come the
    objects of `referent` that no tree has reached; one that is the type of a reached fact is no root. Between roots
    that can meet the smaller one goes first, and names of types last; all other trees grow at once, part by part, and
    only what earlier trees have reached keeps a name of a type from being a root.

    A fact hangs on its subject as a link, or on its object as a link with `reverse`, which swaps its arguments;
    below it hang its arguments arg0 and arg1, but for the one above it. Facts of types in `without` are no links, and
    what hangs on a fact of a type in `ending` is not followed by links. Breadth first; of several places in a round a node takes
    the first by label (arg0, arg1, link, reverse) and parent. An argument that already has its place is a leaf there,
    with `again`. kind is a fact's type, null for other nodes. Facts without subject or id are none.
    """
    facts = staged(quads.where("s IS NOT NULL AND pid IS NOT NULL").select("graph_id", "s", "t", "o", "pid").distinct())
    links = staged(facts.where(~F.col("t").isin(*without)))
    own = staged(facts.groupBy("graph_id", F.col("pid").alias("node")).agg(F.min(F.struct("t", "s", "o")).alias("f")))
    roots = staged(_roots(facts, links, asserted, referent))
    columns = ["graph_id", "root", "node", "parent", "label", "reverse", "kind", "depth"]
    seen = extra = None
    for rank in range(3):
        while True:
            left = roots.where(F.col("rank") == rank)
            if seen is not None:
                left = left.join(seen.select("graph_id", F.col("node").alias("root")), ["graph_id", "root"], "left_anti")
                left = left.join(seen.where("kind IS NOT NULL").select("graph_id", F.col("kind").alias("root")), ["graph_id", "root"], "left_anti")
            first = left.groupBy("graph_id", "part").agg(F.min("root").alias("root"))
            none = F.lit(None).cast("string")
            new = first.select("graph_id", "root", F.col("root").alias("node"), none.alias("parent"), F.lit("root").alias("label"), F.lit(False).alias("reverse"), none.alias("above"))
            new = staged(new.join(own, ["graph_id", "node"], "left").select("*", F.col("f.t").alias("kind"), F.lit(0).alias("depth")))
            if new.isEmpty():
                break
            seen = new.select(columns) if seen is None else staged(seen.union(new.select(columns)))
            for k in count(1):
                reached = staged(_reached(new, links, ending))
                taken = reached.groupBy("graph_id", "node").agg(F.min("at").alias("at")).join(seen.select("graph_id", "node"), ["graph_id", "node"], "left_anti")
                new = taken.select("graph_id", "at.root", "node", "at.parent", _label("at.k"), (F.col("at.k") == 3).alias("reverse"), "at.above")
                new = staged(new.join(own, ["graph_id", "node"], "left").select("*", F.col("f.t").alias("kind"), F.lit(k).alias("depth")))
                args = reached.where("at.k < 2").select("graph_id", "at.root", "node", "at.parent", _label("at.k"))
                more = args.join(new.select("graph_id", "node", "parent", "label"), ["graph_id", "node", "parent", "label"], "left_anti")
                more = more.join(own, ["graph_id", "node"], "left").select("graph_id", "root", "node", "parent", "label", F.lit(False).alias("reverse"), F.col("f.t").alias("kind"), F.lit(k).alias("depth"))
                extra = more if extra is None else extra.union(more)
                if new.isEmpty():
                    break
                seen = seen.union(new.select(columns))
                if k % MERGE == 0:
                    seen, extra = staged(seen), staged(extra)
            extra = staged(extra)
    if seen is None:
        seen = new.select(columns)
    again = lambda rows, yes: rows.withColumn("again", F.lit(yes))
    return again(seen, False) if extra is None else again(seen, False).union(again(extra.select(columns), True))


def _label(k: str) -> Column:
    return F.element_at(F.array(*map(F.lit, LABELS[:3])), F.least(F.col(k), F.lit(2)) + 1).alias("label")


def _roots(facts: DataFrame, links: DataFrame, asserted: str, referent: str) -> DataFrame:
    """(graph_id, root, rank, part): roots of one part can meet, those of different parts can't."""
    first = facts.where(F.col("t") == asserted).select("graph_id", F.coalesce("o", "s").alias("root"), F.lit(0).alias("rank"))
    named = facts.select("graph_id", F.col("t").alias("root")).distinct().withColumn("named", F.lit(2))
    later = facts.where((F.col("t") == referent) & F.col("o").isNotNull()).select("graph_id", F.col("o").alias("root")).distinct()
    later = later.join(named, ["graph_id", "root"], "left").select("graph_id", "root", F.coalesce("named", F.lit(1)).alias("rank"))
    told = facts.select("graph_id", F.explode(F.array_compact(F.array("s", "o"))).alias("pid")).distinct()
    followed = links.union(facts.join(links.select("graph_id", "pid"), ["graph_id", "pid"], "left_anti").join(told, ["graph_id", "pid"], "left_semi").select(links.columns))
    key = lambda c: F.concat(F.length(F.col("graph_id").cast("string")).cast("string"), F.lit(":"), F.col("graph_id").cast("string"), c)
    ends = F.explode(F.array_compact(F.array("s", "o"))).alias("end")
    parts = connected_components(followed.select(key("pid").alias("src"), "graph_id", ends).select("src", key("end").alias("dst")))
    roots = first.union(later).groupBy("graph_id", "root").agg(F.min("rank").alias("rank")).withColumn("node", key("root"))
    return roots.join(parts, "node", "left").select("graph_id", "root", "rank", F.coalesce("component", "node").alias("part"))


def _reached(new: DataFrame, links: DataFrame, ending: tuple[str, ...]) -> DataFrame:
    """(graph_id, node, at): the places (k of LABELS, parent, root, above) where nodes below those of a round may stand."""
    at = lambda k: F.struct(F.lit(k).alias("k"), F.col("node").alias("parent"), "root", F.col("kind").alias("above"))
    subject, object_ = F.when(F.col("reverse"), F.col("f.o")).otherwise(F.col("f.s")), F.when(F.col("reverse"), F.col("f.s")).otherwise(F.col("f.o"))
    args = new.where("kind IS NOT NULL").select("graph_id", F.explode(F.array(
        F.struct(F.when(~subject.eqNullSafe(F.col("parent")), subject).alias("node"), at(0).alias("at")),
        F.struct(object_.alias("node"), at(1).alias("at")),
    )).alias("e")).select("graph_id", "e.node", "e.at").where("node IS NOT NULL")
    open_ = new.where(~F.coalesce(F.col("above").isin(*ending), F.lit(False))) if ending else new
    out = args
    for k, end in ((2, "s"), (3, "o")):
        on = links.where(F.col(end).isNotNull()).select("graph_id", F.col(end).alias("node"), "pid")
        below = open_.select("graph_id", "root", "node", "parent", "kind").join(on, ["graph_id", "node"]).where("pid <> node AND NOT (pid <=> parent)")
        out = out.union(below.select("graph_id", F.col("pid").alias("node"), at(k).alias("at")))
    return out


def speakers_swapped(text: Column) -> Column:
    """The user's and the bot's placeholders take each other's place, as a reply is written from the other side."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\buser\b", "\u0001"), r"\bbot\b", "_user_"), "\u0001", "_bot_")


def linearized(tree: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(graph_id, text): each graph's trees as one string, `root : label child label child : ...`, children by label and name.

    tree: as spanning_tree gives it. labels: (c, label) of what a node is called, by default its own name. A node with
    children is followed by a colon. A graph is a session or a document, so its string is bounded.
    """
    tree = staged(tree)
    parents = tree.where("parent IS NOT NULL").select("graph_id", "root", F.col("parent").alias("node"), F.lit(True).alias("_inner")).distinct()
    rows = tree.join(parents, ["graph_id", "root", "node"], "left")
    called = rows if labels is None else rows.join(labels.select(F.col("c").alias("node"), F.col("label").alias("_called")), "node", "left")
    name = F.col("node") if labels is None else F.coalesce("_called", "node")
    word = F.concat(F.coalesce(F.concat("label", F.lit(" ")), F.lit("")), name, F.when(F.col("_inner"), " :").otherwise(""))
    rows = staged(called.select("graph_id", "root", "node", "parent", "depth", F.struct(F.coalesce("label", F.lit("")).alias("label"), name.alias("name"), F.col("node")).alias("key"), word.alias("word")))
    done = now = rows.where("depth = 0").select("graph_id", "root", "node", F.array("key").alias("path"), "word")
    for k in range(1, (rows.agg(F.max("depth")).first()[0] or 0) + 1):
        up = now.select("graph_id", "root", F.col("node").alias("parent"), F.col("path").alias("_path"))
        now = rows.where(F.col("depth") == k).join(up, ["graph_id", "root", "parent"]).select("graph_id", "root", "node", F.array_append("_path", F.col("key")).alias("path"), "word")
        now = staged(now) if k % MERGE == 0 else now
        done = done.union(now)
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "word"))), lambda r: r["word"]), " ")
    return done.groupBy("graph_id").agg(line.alias("text"))
