"""Requests and answers, awareness, templates and the routing of mentions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.sources.staging import staged

#: A template's priority, and the tags that its tokens may carry.
PRIORITIES = {"low": 0.1, "normal": 0.5, "high": 1.0}
#: Tags and what they are kinds of.
TAG_KINDS = {"user": ["person", "entity"], "assistant": ["bot", "agent", "entity"], "system": ["agent", "entity"]}
#: Lemmas that override a parser's.
LEMMAS = {"are": "be", "is": "be", "was": "be", "has": "have", "had": "have", "did": "do"}


def tag_kinds(tags: DataFrame) -> DataFrame:
    """(tag, kind) for each tag of a column `tag`; a tag without kinds is its own."""
    table = F.create_map(*[x for k, v in TAG_KINDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return tags.select("tag", F.explode(F.coalesce(F.try_element_at(table, F.col("tag")), F.array("tag"))).alias("kind"))


def lemma(word: Column, tag: Column | None = None) -> Column:
    """The overriding lemma, else the word; with its tag a shortened s is be where it is a verb, us where it is a pronoun."""
    table = F.create_map(*[F.lit(x) for kv in LEMMAS.items() for x in kv])
    found = F.coalesce(F.try_element_at(table, word), word)
    if tag is None:
        return found
    short, low = word.isin("'s", "s"), F.lower(tag)
    return F.when(short & F.contains(low, F.lit("vb")), "be").when(short & F.contains(low, F.lit("prp")), "us").otherwise(found)


def concept_of(words: DataFrame, names: DataFrame) -> DataFrame:
    """(word, concept): by the word itself, else by the word without a final s, else unknown; the smallest of several."""
    best = names.groupBy("text").agg(F.min("concept").alias("concept"))
    by = lambda k, c: best.select(F.col("text").alias(k), F.col("concept").alias(c))
    rows = words.select("word", F.regexp_replace("word", "s$", "").alias("_stem")).distinct()
    rows = rows.join(by("word", "_a"), "word", "left").join(by("_stem", "_b"), "_stem", "left")
    return rows.select("word", F.coalesce("_a", "_b", F.lit("unknown")).alias("concept"))


def covered(nodes: DataFrame, marked: DataFrame, mark: str) -> DataFrame:
    """(s, t): a mark for each node (c) that has none yet."""
    return nodes.select("c").distinct().join(marked.select("c").distinct(), "c", "left_anti").select(F.col("c").alias("s"), F.lit(mark).alias("t"))


def spoken(facts: DataFrame, said: DataFrame, known: DataFrame, inserts: DataFrame) -> DataFrame:
    """(graph_id, c, aware, turn, salience, warm): what changes once an answer's facts have been said.

    facts: (graph_id, s, t, o, pid) of the graphs; said: those of the answer, with its turn; known: (graph_id, c) that the user is
    aware of; inserts: facts to add, such as anchors of a topic, with the ids they get where they aren't there yet.
    warm: a said fact is no cold start any more. turn: the bot's turn on every fact and its arguments. aware: facts the user
    now knows of and didn't before. salience: 1 for said and inserted facts and the subjects of inserts. What only names an
    expression is warm and nothing more. Columns are null where they say nothing; nulls among nodes get no row.
    """
    own = said.where("t IS NULL OR t <> 'expr'")
    row = lambda rows, c, **is_: rows.select(
        "graph_id", F.col(c).alias("c"), *(is_.get(n, F.lit(None)).cast(k).alias(n) for n, k in (("aware", "boolean"), ("turn", "long"), ("salience", "double"), ("warm", "boolean")))
    )
    there = facts.select("graph_id", "s", "t", F.col("o").alias("_o"), F.col("pid").alias("_pid"))
    new = inserts.select("graph_id", F.col("s").alias("_s"), F.col("t").alias("_t"), "o", "pid").distinct()
    same = (new["graph_id"] == there["graph_id"]) & (F.col("_s") == F.col("s")) & (F.col("_t") == F.col("t")) & F.col("o").eqNullSafe(F.col("_o"))
    put = new.join(there, same, "left").select(new["graph_id"], "_s", F.coalesce("_pid", "pid").alias("pid"))
    stamped = own.select("graph_id", "turn", F.explode(F.array("s", "o", "pid")).alias("c"))
    unknown = own.where("t IS NULL OR t <> 'user_aware'").select("graph_id", F.col("pid").alias("c")).join(known, ["graph_id", "c"], "left_anti")
    one = F.lit(1.0)
    parts = [row(said, "pid", warm=F.lit(True)), row(unknown, "c", aware=F.lit(True)), row(own, "pid", salience=one), row(put, "pid", salience=one), row(put, "_s", salience=one)]
    out = row(stamped, "c", turn=F.col("turn"))
    for p in parts:
        out = out.union(p)
    return out.where("c IS NOT NULL").groupBy("graph_id", "c").agg(*(F.max(c).alias(c) for c in ("aware", "turn", "salience", "warm")))


def request_status(requests: DataFrame, answered: DataFrame) -> DataFrame:
    """(request, status): satisfied once answered, else unsatisfied."""
    done = answered.select("request").distinct().withColumn("_done", F.lit(True))
    return requests.join(done, "request", "left").select("request", F.when(F.col("_done"), "satisfied").otherwise("unsatisfied").alias("status"))


#: Longs in which a candidate's values are marked, each value a bit of one of them.
MARKS = 4


def _marks(hashes: Column) -> Column:
    """An array of hashes as MARKS longs in which their bits are set."""
    bits = lambda i: F.aggregate(F.filter(hashes, lambda h: F.shiftright(h, 6) == i), F.lit(0).cast("long"), lambda a, h: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), h % 64)))
    return F.struct(*(bits(i).alias(f"m{i}") for i in range(MARKS)))


def answering(questions: DataFrame, candidates: DataFrame) -> DataFrame:
    """(q, cand): candidates whose values hold every constraint of a question; questions (q, x), candidates (cand, x).

    A question is looked up under its rarest constraint alone, so that frequent values make no pairs. Where it has others, most
    candidates that lack one are told by a few marked bits as they meet it, and only the rest is shuffled to be compared whole.
    """
    place = lambda x: F.pmod(F.xxhash64(x), F.lit(64 * MARKS)).cast("int")
    held = staged(candidates.where("cand IS NOT NULL").groupBy("cand").agg(F.collect_set("x").alias("has")).withColumn("marks", _marks(F.transform("has", place))))
    each = held.select("cand", "marks", F.explode("has").alias("x"))
    often = each.groupBy("x").agg(F.count("*").alias("_often"))
    order = F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("_often", F.lit(0)), "x"))), lambda e: e["x"])
    whole = questions.distinct().join(often, "x", "left").groupBy("q").agg(order.alias("needs"))
    whole = staged(whole.select("q", "needs", F.col("needs")[0].alias("x"), _marks(F.transform("needs", lambda x: F.coalesce(place(x), F.lit(0)))).alias("asks")))
    one = whole.where(F.size("needs") == 1).select("q", "x").join(each.select("x", "cand"), "x")
    fits = " AND ".join(f"(asks.m{i} & marks.m{i}) = asks.m{i}" for i in range(MARKS))
    near = whole.where(F.size("needs") > 1).join(each, "x").where(fits).select("q", "needs", "cand")
    several = near.join(held.select("cand", "has"), "cand").where(F.size(F.array_except("needs", "has")) == 0)
    return one.select("q", "cand").union(several.select("q", "cand"))


def normalised(templates: DataFrame) -> DataFrame:
    """Templates (rule, tag) with their priority, null for a tag that isn't known."""
    table = F.create_map(*[F.lit(x) for kv in PRIORITIES.items() for x in kv])
    return templates.select("rule", "tag", F.try_element_at(table, F.col("tag")).alias("priority"))


def routed(merges: DataFrame, outer: DataFrame) -> DataFrame:
    """Merge pairs (a, b) with spans inside a longer mention (sub, mention) moved to it; pairs that become one node go."""
    of = lambda k: outer.select(F.col("sub").alias(k), F.col("mention").alias(f"_{k}"))
    rows = merges.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return rows.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")).where("a <> b").distinct()


def broad(patterns: DataFrame, types: list[str]) -> DataFrame:
    """(rule): patterns (rule, kind) that name nothing more special than the given types."""
    return patterns.groupBy("rule").agg(F.bool_and(F.col("kind").isin(*types)).alias("b")).where("b").select("rule")
