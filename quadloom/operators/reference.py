"""References and answers: concepts described by constraints, what they may stand for, and what a reply settles.

Metalinks are rows (graph_id, src, label, dst): `ref` leads from a reference to the predicates that constrain it, `var` to
the nodes that a match may bind, `comps` from a focus to the parts of its mention.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadloom.operators.components import connected_components
from quadloom.operators.mutate import FACT, merged
from quadloom.operators.retrieve import subsets
from quadloom.operators.rulebook import compiled, ends, leaves
from quadloom.sources.staging import small, staged

#: Requests in the order in which a reply settles them, and whose question each is.
REQUESTS = [("bot", "truth"), ("bot", "arg"), ("user", "truth"), ("user", "arg")]
#: What a reply of its own says yes or no with.
REPLIES = ("have", "do", "be")


def links_of(links: DataFrame, label: str, src: str, dst: str) -> DataFrame:
    return links.where(F.col("label") == label).select("graph_id", F.col("src").alias(src), F.col("dst").alias(dst)).distinct()


def references(links: DataFrame) -> DataFrame:
    """(graph_id, ref, constraints, vars) of every node with `ref` links.

    One whose constraints all belong to another reference of its graph is covered by that and goes; two with
    the same constraints cover each other.
    """
    own = links_of(links, "ref", "ref", "x")
    sets = own.select(F.struct("graph_id", "ref").alias("c"), F.struct("graph_id", "x").alias("x"))
    covered = subsets(sets).select(F.col("a.graph_id").alias("graph_id"), F.col("a.ref").alias("ref")).distinct()
    names = links_of(links, "var", "ref", "v").groupBy("graph_id", "ref").agg(F.array_sort(F.collect_set("v")).alias("vars"))
    whole = own.groupBy("graph_id", "ref").agg(F.array_sort(F.collect_set("x")).alias("constraints"))
    none = F.array().cast("array<string>")
    return whole.join(covered, ["graph_id", "ref"], "left_anti").join(names, ["graph_id", "ref"], "left").select("graph_id", "ref", "constraints", F.coalesce("vars", none).alias("vars"))


def gathered(quads: DataFrame, links: DataFrame, gather: str, promote: list[str], ignore: list[str]) -> DataFrame:
    """Metalinks with span links (label `gather`) turned into links of the labels in promote.

    A span's focus is the object of its `ref` fact, the smallest of several, also under its linking name; of the
    focus's components those stay that are no predicate of an ignored type and hang together with the linking node.
    """
    part = staged(_together(quads))
    of = lambda c: part.select("graph_id", F.col("node").alias(c), "component")
    foci = quads.where("t = 'ref'").groupBy("graph_id", F.col("s").alias("span")).agg(F.min("o").alias("focus"))
    foci = foci.union(foci.where(F.col("span").startswith("__linking__")).select("graph_id", F.expr("substring(span, 12)"), "focus"))
    spans = links_of(links, gather, "node", "span").join(foci, ["graph_id", "span"]).select("graph_id", "node", "focus").distinct().join(of("node"), ["graph_id", "node"])
    ignored = quads.where(F.col("t").isin(*ignore)).select("graph_id", F.col("pid").alias("dst"))
    comps = links.where("label = 'comps'").select("graph_id", F.col("src").alias("focus"), "dst").join(of("dst"), ["graph_id", "dst"]).join(ignored, ["graph_id", "dst"], "left_anti")
    near = spans.join(comps, ["graph_id", "focus", "component"]).select("graph_id", "node", "dst").distinct()
    new = near.select("graph_id", F.col("node").alias("src"), F.explode(F.array(*map(F.lit, promote))).alias("label"), "dst")
    return links.where(F.col("label") != gather).select("graph_id", "src", "label", "dst").union(new).distinct()


def _together(quads: DataFrame) -> DataFrame:
    """(graph_id, node, component) of all subjects, objects and predicate ids that hang together over facts.

    Nodes are numbered, as numbers are compared much faster than ids. A predicate id hangs on its subject; one that is no fact's
    subject or object makes no edge and takes its subject's component.
    """
    facts = quads.where("graph_id IS NOT NULL AND pid IS NOT NULL").withColumn("s", F.coalesce("s", "o")).where("s IS NOT NULL").select("graph_id", "s", "o", "pid")
    nodes = facts.select("graph_id", F.explode(F.array_compact(F.array("s", "o"))).alias("node")).distinct()
    nodes = staged(nodes.withColumn("id", F.monotonically_increasing_id()))
    held = facts.join(nodes.select("graph_id", F.col("node").alias("s"), F.col("id").alias("sid")), ["graph_id", "s"])
    held = held.select("graph_id", "sid", F.explode(F.array_compact(F.array("o", "pid"))).alias("node")).join(nodes, ["graph_id", "node"], "left")
    held = staged(held.select("graph_id", F.when(F.col("id").isNull(), F.col("node")).alias("node"), "sid", "id"))
    part = connected_components(held.where("id IS NOT NULL"), "sid", "id").withColumnRenamed("node", "id")
    own = held.where("id IS NULL").select("graph_id", "node", F.col("sid").alias("id"))
    return nodes.union(own).join(part, "id", "left").select("graph_id", "node", F.coalesce("component", "id").alias("component")).distinct()


def more_info(quads: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts and metalinks after each `op_more_info`(new, old): new takes over the resolved constraints (rref, rvar) of old
    and must be something specific; the operator's own fact goes."""
    asked = quads.where("t = 'op_more_info'").select("graph_id", F.col("s").alias("new"), F.col("o").alias("old"))
    special = asked.select("graph_id", F.col("new").alias("s"), F.lit("_specific").alias("t"), F.lit(None).cast("string").alias("o"), F.concat(F.lit("q:"), "new", F.lit("|_specific|")).alias("pid")).distinct()
    moved = None
    for old, label in (("rref", "ref"), ("rvar", "var")):
        rows = asked.join(links_of(links, old, "old", "dst"), ["graph_id", "old"]).select("graph_id", F.col("new").alias("src"), F.lit(label).alias("label"), "dst")
        rows = rows.union(special.select("graph_id", "s", F.lit(label), "pid"))
        moved = rows if moved is None else moved.union(rows)
    return quads.where("t <> 'op_more_info'").select(FACT).union(special), links.select("graph_id", "src", "label", "dst").union(moved).distinct()


def patterns(refs: DataFrame, quads: DataFrame) -> DataFrame:
    """(rule, nth, s, t, o): each reference's constraints as edges; rule is graph_id and ref, variables are numbered."""
    rows = refs.select("graph_id", "ref", "vars", F.explode("constraints").alias("pid")).join(quads.select(*FACT), ["graph_id", "pid"])
    term = lambda c: F.when(F.array_contains("vars", F.col(c)), F.concat(F.lit("?v"), F.array_position("vars", F.col(c)).cast("string"))).otherwise(F.col(c)).alias(c)
    edges = rows.select(F.concat_ws("|", "graph_id", "ref").alias("rule"), term("s"), "t", term("o"), "pid")
    nth = F.row_number().over(Window.partitionBy("rule").orderBy("t", "pid")) - 1
    return edges.select("rule", nth.alias("nth"), "s", "t", "o")


def candidates(quads: DataFrame, refs: DataFrame, types: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """(graph_id, ref, match) of what fits a reference's constraints, a row for each pair; alike() says the same without the pairs."""
    members, fits, barred = alike(quads, refs, types, facts)
    return members.join(fits, ["graph_id", "kind"]).join(barred, ["graph_id", "ref", "kind", "match"], "left_anti").select("graph_id", "ref", "match").distinct()


def alike(quads: DataFrame, refs: DataFrame, types: DataFrame, facts: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """References by kind, as many may ask for the same: (graph_id, ref, kind), (graph_id, kind, match) of what fits the constraints of a
    kind, and (graph_id, ref, kind, match) of what a reference must not stand for although its kind may.

    A reference stands for another node, both or neither of them predicates, and for none of its own types. facts: where matches are looked
    for, by default the other facts of quads. types: (c, sup), with a column graph_id each graph's own.
    """
    trie = compiled(patterns(refs, quads), unstated="any")
    named = refs.select("graph_id", "ref", F.array_position("vars", F.col("ref")).alias("at"), F.concat_ws("|", "graph_id", "ref").alias("rule")).where("at > 0")
    slot = F.array_position("names", F.concat(F.lit("v"), F.col("at").cast("string"))).cast("int").alias("slot")
    own = named.join(leaves(trie), "rule").select("graph_id", "ref", "node", slot).where("slot > 0")
    ids = quads.select("graph_id", "pid").distinct().withColumn("is_id", F.lit(True))
    kind = F.concat_ws("|", "node", "slot", F.coalesce("is_id", F.lit(False)).cast("string")).alias("kind")
    own = own.join(ids.withColumnRenamed("pid", "ref"), ["graph_id", "ref"], "left").select("graph_id", "ref", kind, "node", "slot")
    members = staged(own.distinct())
    found = ends(quads if facts is None else facts, trie)
    if found is None:
        none = members.limit(0).withColumn("match", F.col("ref"))
        return members.select("graph_id", "ref", "kind"), none.select("graph_id", "kind", "match"), none.select("graph_id", "ref", "kind", "match")
    fits = found.join(small(members.select("node", "slot").distinct()), "node").select("graph_id", "node", "slot", F.get("b", F.col("slot") - 1).alias("match")).distinct()
    fits = staged(fits.join(ids.withColumnRenamed("pid", "match"), ["graph_id", "match"], "left").select("graph_id", kind, "match"))
    members = members.select("graph_id", "ref", "kind")
    own = ["graph_id"] if "graph_id" in types.columns else []
    bars = members.withColumn("match", F.col("ref")).union(members.join(types.select(*own, F.col("c").alias("ref"), F.col("sup").alias("match")), [*own, "ref"]).select("graph_id", "ref", "kind", "match"))
    return members, fits, staged(bars.join(fits, ["graph_id", "kind", "match"], "left_semi").select("graph_id", "ref", "kind", "match").distinct())


def chosen(pairs: DataFrame, salience: DataFrame) -> DataFrame:
    """chosen_alike() of candidates (graph_id, ref, match), each reference being a kind of its own."""
    rows = pairs.select("graph_id", "ref", "match").distinct()
    return chosen_alike(rows.select("graph_id", "ref", F.col("ref").alias("kind")).distinct(), rows.withColumnRenamed("ref", "kind"), salience)


def chosen_alike(members: DataFrame, fits: DataFrame, salience: DataFrame, barred: DataFrame | None = None) -> DataFrame:
    """(graph_id, ref, match) that are merged; salience: (graph_id, c, salience), the others as in alike(). A reference may be of several kinds.

    A reference takes its most salient constant and, while they agree, the references among its candidates: the one with the
    least salient best candidate first; a reference that was taken keeps only candidates that both have, and after a
    constant only references remain that could be it too. Ties go to the smaller name.

    Only references that may be one another depend on each other. One without such candidates takes its best constant by
    aggregation; the others are split into connected components of the graph of references, and each component is settled by
    itself, in parallel. Of constants a component needs those alone that are the best of one of its references: what a
    reference that was taken can still choose is its taker's best, and its own best decides its turn. Constants are ranked
    once for each kind, so references are paired with each other and with what a component needs, never with all constants.
    """
    if barred is not None and barred.isEmpty():
        barred = None
    members = staged(members.select("graph_id", "ref", "kind").distinct())
    sal = salience.select("graph_id", F.col("c").alias("match"), "salience")
    sizes = fits.select("graph_id", "kind", "match").distinct().groupBy("graph_id", "kind").agg(F.count("*").alias("n"))
    live = members.join(sizes, ["graph_id", "kind"])
    if barred is not None:
        live = live.join(barred.groupBy("graph_id", "ref", "kind").agg(F.count("*").alias("less")), ["graph_id", "ref", "kind"], "left").where("n > coalesce(less, 0)")
    known = live.select("graph_id", F.col("ref").alias("match")).distinct().withColumn("also", F.lit(True))
    rows = fits.select("graph_id", "kind", "match").distinct().join(sal, ["graph_id", "match"], "left").join(known, ["graph_id", "match"], "left")
    rows = staged(rows.select("graph_id", "kind", "match", F.coalesce("salience", F.lit(0.0)).alias("salience"), F.coalesce("also", F.lit(False)).alias("also")))
    open_to = lambda x: x if barred is None else x.join(barred, ["graph_id", "ref", "kind", "match"], "left_anti")
    met = staged(open_to(members.join(rows.where("also"), ["graph_id", "kind"])).select("graph_id", "ref", "match", "salience", "also").distinct())
    node = lambda c: F.struct("graph_id", F.col(c).alias("n"))
    parts = connected_components(met.select(node("ref").alias("src"), node("match").alias("dst")))
    parts = staged(parts.select(F.col("node.graph_id").alias("graph_id"), F.col("node.n").alias("ref"), F.col("component.n").alias("part")))
    constants = rows.where("NOT also").drop("also")
    best = staged(_best(members, constants, barred).join(parts, ["graph_id", "ref"], "left"))
    alone = best.where("part IS NULL").select("graph_id", "ref", "match")
    wanted = best.where("part IS NOT NULL").select("graph_id", "part", "match").distinct().join(constants, ["graph_id", "match"])
    within = open_to(members.join(parts, ["graph_id", "ref"]).join(wanted, ["graph_id", "part", "kind"])).withColumn("also", F.lit(False))
    cols = ["graph_id", "part", "ref", "match", "salience", "also"]
    joint = met.join(parts, ["graph_id", "ref"]).select(cols).union(within.select(cols).distinct())

    def settle(group: pd.DataFrame) -> pd.DataFrame:
        weight = dict(zip(group["match"], group["salience"], strict=True))
        also = set(group.loc[group["also"], "match"])
        left = {r: set(g["match"]) for r, g in group.groupby("ref")}
        first = lambda names: min(names, key=lambda c: (-weight[c], c))
        turn = lambda r: (max((weight[c] for c in left[r]), default=0.0), r)
        turns = [turn(r) for r in left]
        heapq.heapify(turns)
        out = []
        while turns:
            at = heapq.heappop(turns)
            ref = at[1]
            if ref not in left or at != turn(ref):
                continue
            constants = left[ref] - also
            open_ = (left[ref] & also) | ({first(constants)} if constants else set())
            while open_:
                take = first(open_)
                out.append((ref, take))
                if take in also:
                    if take in left:
                        open_ &= left[take]
                        left[take] &= open_
                        heapq.heappush(turns, turn(take))
                else:
                    open_ = {c for c in open_ if c not in also or take in left.get(c, ())}
                open_.discard(take)
            del left[ref]
        return pd.DataFrame({"graph_id": group["graph_id"].iloc[0], "ref": [r for r, _ in out], "match": [m for _, m in out]})

    return alone.union(joint.groupBy("graph_id", "part").applyInPandas(settle, "graph_id string, ref string, match string"))


def _best(members: DataFrame, constants: DataFrame, barred: DataFrame | None) -> DataFrame:
    """(graph_id, ref, match): each reference's most salient constant that isn't barred to it; constants: (graph_id, kind, match, salience).

    A reference that may not take k constants of its kind finds its own among the kind's first k + 1.
    """
    order = F.struct(-F.col("salience"), "match")
    first = constants.groupBy("graph_id", "kind").agg(F.min(order).alias("b"))
    if barred is None:
        tried = members.join(small(staged(first)), ["graph_id", "kind"])
    else:
        held = barred.select("graph_id", "ref", "kind").distinct()
        most = barred.groupBy("graph_id", "ref", "kind").count().agg(F.max("count")).first()[0]
        rank = F.row_number().over(Window.partitionBy("graph_id", "kind").orderBy(F.desc("salience"), "match"))
        some = constants.join(held.select("graph_id", "kind").distinct(), ["graph_id", "kind"], "left_semi")
        some = some.withColumn("_k", rank).where(F.col("_k") <= most + 1).select("graph_id", "kind", "match", order.alias("b"))
        mine = members.join(held, ["graph_id", "ref", "kind"], "left_semi").join(some, ["graph_id", "kind"]).join(barred, ["graph_id", "ref", "kind", "match"], "left_anti")
        free = members.join(held, ["graph_id", "ref", "kind"], "left_anti").join(small(staged(first)), ["graph_id", "kind"])
        tried = free.select("graph_id", "ref", "b").union(mine.select("graph_id", "ref", "b"))
    return tried.groupBy("graph_id", "ref").agg(F.min("b")["match"].alias("match"))


def best_constant(members: DataFrame, fits: DataFrame, barred: DataFrame, salience: DataFrame) -> DataFrame:
    """chosen_alike() where no candidate is a reference itself: the most salient one of each reference, without gathering a graph."""
    rows = fits.join(salience.select("graph_id", F.col("c").alias("match"), "salience"), ["graph_id", "match"], "left")
    rows = rows.select("graph_id", "kind", "match", F.coalesce("salience", F.lit(0.0)).alias("salience"))
    return _best(members, rows, None if barred.isEmpty() else barred)


def resolved(quads: DataFrame, links: DataFrame, types: DataFrame, salience: DataFrame, facts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(facts with references merged into what they stand for, the pairs): references, their candidates, the choice, the merge.

    facts: where candidates are looked for, by default quads itself.
    """
    members, fits, barred = alike(quads, references(links), types, facts)
    pairs = staged(chosen_alike(members, fits, salience, barred))
    return merged(quads, pairs.select("graph_id", F.col("match").alias("a"), F.col("ref").alias("b"))), pairs


def open_request(requests: DataFrame, turns: DataFrame) -> DataFrame:
    """(graph_id, pid, kind, focus): the most salient request that was asked on the turn before and isn't settled.

    requests: (graph_id, pid, kind, focus, turn, salience, settled); turns: (graph_id, turn) now. Of equal salience a
    question of truth comes before one of an argument, then the smaller id.
    """
    now = turns.select("graph_id", F.col("turn").alias("_now"))
    rows = requests.join(now, "graph_id").where("turn = _now - 1 AND NOT settled")
    best = Window.partitionBy("graph_id").orderBy(F.desc("salience"), F.desc(F.col("kind") == "truth"), "pid")
    return rows.withColumn("_k", F.row_number().over(best)).where("_k = 1").select("graph_id", "pid", "kind", "focus")


def truth_answers(asked: DataFrame, said: DataFrame) -> DataFrame:
    """(graph_id, request, focus, answer, says): yes or no to the open truth request of a graph.

    said: (graph_id, pid, t, o, salience, denied) of the turn. The most salient affirm or reject decides; without one a reply
    of its own, `I do` or `I haven't` (REPLIES without an object), says yes or, denied, no, and stands for the answer.
    """
    own = F.col("t").isin(*REPLIES) & F.col("o").isNull()
    says = F.when(F.col("t") == "affirm", "yes").when(F.col("t") == "reject", "no").when(own & ~F.col("denied"), "yes").when(own, "no")
    rank = F.when(own, 1).otherwise(0)
    rows = said.withColumn("says", says).where("says IS NOT NULL AND (t IN ('have', 'do', 'be') OR o IS NOT NULL)").withColumn("_own", rank)
    best = Window.partitionBy("graph_id").orderBy("_own", F.desc("salience"), "pid")
    first = rows.withColumn("_k", F.row_number().over(best)).where("_k = 1")
    answer = F.when(F.col("_own") == 1, F.concat(F.lit("answer:"), "pid")).otherwise(F.col("o"))
    return asked.where("kind = 'truth'").join(first.select("graph_id", answer.alias("answer"), "says"), "graph_id").select("graph_id", F.col("pid").alias("request"), "focus", "answer", "says")


def arg_answers(asked: DataFrame, said: DataFrame, types: DataFrame) -> DataFrame:
    """(graph_id, request, focus, answer): the most salient concept of the turn that has all of the focus's types and more.

    said: (graph_id, c, salience, reference, predicate); a concept with a subtype among those said, a reference, and a
    predicate for a focus that is none, is no answer. asked may have a column predicate, false if missing.
    """
    asked = asked if "predicate" in asked.columns else asked.withColumn("predicate", F.lit(False))
    needs = asked.where("kind = 'arg'").join(types.where("c <> sup").select(F.col("c").alias("focus"), "sup"), "focus")
    sizes = needs.groupBy("graph_id", "focus").agg(F.count("*").alias("_n"))
    strict = types.select("c", "sup")
    above = said.join(strict.where("c <> sup"), "c").select("graph_id", F.col("sup").alias("c")).distinct()
    some = said.where("NOT reference").join(above, ["graph_id", "c"], "left_anti")
    have = some.join(strict, "c").join(needs.select("graph_id", "pid", "focus", "sup", F.col("predicate").alias("_p")), ["graph_id", "sup"]).where("c <> focus AND (_p OR NOT predicate)")
    full = have.groupBy("graph_id", "pid", "focus", "c", "salience").agg(F.count("*").alias("_k")).join(sizes, ["graph_id", "focus"]).where("_k = _n")
    best = full.groupBy("graph_id", "pid", "focus").agg(F.min_by("c", F.struct(-F.col("salience"), "c")).alias("answer"))
    return best.select("graph_id", F.col("pid").alias("request"), "focus", "answer")


def settled_marks(pairs: DataFrame, requests: DataFrame, links: DataFrame) -> DataFrame:
    """(graph_id, s, t, op): marks added or removed when pairs (graph_id, match, ref) are merged.

    A pair whose match is no reference settles the first request about ref, in the order of REQUESTS; a question of the
    bot's is then known to the user, while one of the user's, its focus and constraints are so no longer. requests:
    (graph_id, pid, who, kind, focus).
    """
    order = F.coalesce(*[F.when((F.col("who") == w) & (F.col("kind") == k), i) for i, (w, k) in enumerate(REQUESTS)])
    plain = pairs.join(links_of(links, "ref", "match", "_x").select("graph_id", "match").distinct(), ["graph_id", "match"], "left_anti")
    met = plain.select("graph_id", F.col("ref").alias("focus")).distinct().join(requests.withColumn("_order", order), ["graph_id", "focus"])
    first = Window.partitionBy("graph_id", "focus").orderBy("_order", "pid")
    done = met.withColumn("_k", F.row_number().over(first)).where("_k = 1").select("graph_id", "pid", "who", "focus")
    mark = lambda rows, s, t, op: rows.select("graph_id", F.col(s).alias("s"), F.lit(t).alias("t"), F.lit(op).alias("op"))
    users = done.where("who = 'user'")
    below = users.join(links_of(links, "ref", "focus", "x"), ["graph_id", "focus"])
    return mark(done, "pid", "req_sat", "add").union(mark(done.where("who = 'bot'"), "pid", "user_aware", "add")).union(mark(users, "pid", "user_aware", "remove")).union(mark(users, "focus", "user_aware", "remove")).union(mark(below, "x", "user_aware", "remove")).distinct()


def mention_links(mentions: DataFrame, facts: DataFrame, rules: DataFrame) -> DataFrame:
    """Metalinks of new mentions (graph_id, mention, rule, focus, asserted): `comps` from a mention's focus to its predicates, `ref_sp`
    from what it refers to, and `dp_sub` where the mention is asserted.

    facts: (graph_id, mention, pid, t, o) of each mention. rules: (rule, with_object, with_focus, target) says whether the object of the
    mention's question or the focus itself belongs to the components, and whether the reference hangs on the `focus`,
    on the `object` of the question, or on nothing (null).
    """
    of = mentions.join(small(rules), "rule")  # few rules, each with a large share of the mentions
    inner = facts.where("t NOT IN ('focus', 'center', 'cover')").join(of.select("graph_id", "mention", "focus"), ["graph_id", "mention"])
    asks = facts.where("t IN ('req_arg', 'req_truth')").groupBy("graph_id", "mention").agg(F.min_by("o", F.struct(F.col("t") != "req_arg", "pid")).alias("asked"))
    asked = of.join(asks, ["graph_id", "mention"], "left")
    row = lambda rows, src, label, dst: rows.select("graph_id", F.col(src).alias("src"), F.lit(label).alias("label"), F.col(dst).alias("dst"))
    comps = row(inner, "focus", "comps", "pid").union(row(asked.where("with_object AND asked IS NOT NULL"), "focus", "comps", "asked")).union(row(of.where("with_focus"), "focus", "comps", "focus"))
    target = asked.withColumn("_target", F.when(F.col("target") == "object", F.col("asked")).when(F.col("target") == "focus", F.col("focus"))).where("_target IS NOT NULL")
    return comps.union(row(target, "_target", "ref_sp", "mention")).union(row(of.where("asserted"), "focus", "dp_sub", "mention")).distinct()
