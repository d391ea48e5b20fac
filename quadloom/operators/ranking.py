"""Choice of the best, scores, and texts put together from parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadloom.sources.staging import staged


def best(rows: DataFrame, by: list[str], order: list, n: int = 1, rank: str | None = None) -> DataFrame:
    """The first n rows of each group; cut within each task before the shuffle."""
    k = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    out = rows.withColumn(rank or "_k", k).where(F.col(rank or "_k") <= n)
    return out if rank else out.drop("_k")


def first_rules(rows: DataFrame) -> DataFrame:
    """(graph_id, rindex, sol, centre): rules that get their centre, when they are tried by rindex and then by sol.

    rows: (graph_id, rindex, sol, centre, covers), sol a solution of the rule rindex, covers an array of further nodes. A rule
    that gets its centre takes the centre and its covers, which are then no centre of later ones; a rule that doesn't takes
    nothing. Decided in rounds: who is the first of all undecided to touch its centre has it, and those later ones whose
    centre that takes are out; so no graph is one group. Rows without a graph, a centre or an order are none; null covers count for nothing.
    """
    own = F.struct("rindex", "sol")
    left = staged(rows.where("graph_id IS NOT NULL AND rindex IS NOT NULL AND sol IS NOT NULL AND centre IS NOT NULL").select("graph_id", "rindex", "sol", "centre", F.coalesce("covers", F.array().cast("array<string>")).alias("covers")).distinct())
    nodes = F.explode(F.array_compact(F.array_union(F.array("centre"), "covers"))).alias("centre")
    touched = lambda some: some.select("graph_id", nodes, own.alias("at")).groupBy("graph_id", "centre").agg(F.min("at").alias("_at"))
    out = left.limit(0)
    while not left.isEmpty():
        won = staged(left.join(touched(left), ["graph_id", "centre"]).where(F.col("_at") == own).select(left.columns))
        out = out.union(won)
        left = staged(left.join(touched(won), ["graph_id", "centre"], "left").where(F.col("_at").isNull() | (F.col("_at") > own)).select(left.columns))
    return out.drop("covers")


def composed(candidates: DataFrame, default: Column) -> DataFrame:
    """(session, text): one answer of each session's candidates (session, kind, score, text), kind being react, present or rpresent.

    The best rpresent, which reacts and presents at once, is the answer where no present has a higher score. Else it is the best
    present behind the best react, whatever that one's score, or behind the default, a column of the session; where that
    is null, the present alone. A session with reacts alone has a null text, as a fallback is its to find. Of equal scores the
    smallest text; null scores count least, null texts and other kinds not at all.
    """
    rows = candidates.where("text IS NOT NULL AND kind IN ('react', 'present', 'rpresent')")
    top = best(rows, ["session", "kind"], [F.desc_nulls_last("score"), "text"])
    of = lambda k, c: F.max(F.when(F.col("kind") == k, F.col(c))).alias(f"_{k}_{c}")
    one = top.groupBy("session").agg(*(of(k, c) for k in ("react", "present", "rpresent") for c in ("score", "text")))
    least = F.lit(float("-inf"))
    whole = F.col("_rpresent_text").isNotNull() & (F.col("_present_text").isNull() | (F.coalesce("_rpresent_score", least) >= F.coalesce("_present_score", least)))
    behind = F.when(F.col("_present_text").isNotNull(), F.concat_ws(" ", F.coalesce(F.col("_react_text"), default), "_present_text"))
    return one.select("session", F.when(whole, F.col("_rpresent_text")).otherwise(behind).alias("text"))


def allowed(candidates: DataFrame, history: DataFrame) -> DataFrame:
    """Candidates (session, rule, form, text, mode) that a session may use after its history (session, rule, form, text, at).

    `nr`: the rule wasn't used, nor was this text by any. `ur`: the rule wasn't used, or its last form would now say
    something else; then another form. `r`: another form than the last, where the rule has several.
    """
    last = history.groupBy("session", "rule").agg(F.max_by(F.struct("form", "text"), "at").alias("_last"))
    said = history.select("session", "text").distinct().withColumn("_said", F.lit(True))
    forms = Window.partitionBy("session", "rule")
    rows = candidates.join(last, ["session", "rule"], "left").join(said, ["session", "text"], "left")
    again = F.max(F.when((F.col("form") == F.col("_last.form")) & (F.col("text") != F.col("_last.text")), True)).over(forms)
    rows = rows.withColumn("_several", F.size(F.collect_set("form").over(forms)) > 1).withColumn("_changed", F.coalesce(again, F.lit(False)))
    unused, other = F.col("_last").isNull(), F.col("form") != F.col("_last.form")
    fits = F.when(F.col("mode") == "nr", unused & F.col("_said").isNull()).when(F.col("mode") == "ur", unused | (F.col("_changed") & other)).otherwise(unused | ~F.col("_several") | other)
    return rows.where(fits).select(candidates.columns)


def unused_fallbacks(sessions: DataFrame, fallbacks: DataFrame, history: DataFrame) -> DataFrame:
    """(session, text): the first of the fallback texts (text), in their order, that a session's history (session, text) doesn't hold;
    none if all are used up. A session that has used k different fallbacks finds one among the first k + 1."""
    place = fallbacks.select("text", F.row_number().over(Window.orderBy("text")).alias("at"))  # program text, so few
    used = history.join(F.broadcast(place), "text").select("session", "at").distinct()
    taken = used.groupBy("session").agg(F.array_sort(F.collect_set("at")).alias("taken"))
    at = F.array_min(F.array_except(F.sequence(F.lit(1), F.size("taken") + 1), "taken"))
    first = sessions.select("session").distinct().join(taken, "session", "left").select("session", F.coalesce(at, F.lit(1)).alias("at"))
    return first.join(F.broadcast(place), "at").select("session", "text")


def score(saliences: list[Column], priority: Column, coherence: Column) -> Column:
    """Mean salience, priority, and half the coherence."""
    return F.round(sum(saliences[1:], saliences[0]) / len(saliences) + priority + 0.5 * coherence + 1e-9, 6)


def in_order(rows: DataFrame, by: list[str], at: str, part: str) -> DataFrame:
    """(by, parts): each group's parts in the order of `at`; a group is one text."""
    return rows.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(at), F.col(part)))), lambda x: x[part]).alias("parts"))


def filled(solutions: DataFrame, sol: str, template: list[str], names: DataFrame) -> DataFrame:
    """(sol, text): a template's words, its variables ('?x') replaced by the name of what they are bound to, else by the node."""
    out = solutions
    for v in dict.fromkeys(x[1:] for x in template if x.startswith("?")):
        out = out.join(names.select(F.col("concept").alias(v), F.col("text").alias(f"_{v}")), v, "left").withColumn(f"_{v}", F.coalesce(f"_{v}", v))
    words = [F.col(f"_{x[1:]}") if x.startswith("?") else F.lit(x) for x in template]
    return out.select(sol, F.concat_ws(" ", *words).alias("text"))
