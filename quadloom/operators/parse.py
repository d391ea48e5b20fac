"""Parsed texts as facts: tokens typed by their tags, labelled arcs between them, asserted roots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadloom.operators.closure import types

#: What every tag is a kind of, and what every token is (fixed values).
TAG, SPAN = "pstg", "span"
#: Words by tag for sketched(); others are verbs by their ending, else nouns.
WORDS = {
    "dt": "the a an this that le la les une des der die das ein eine el los las una".split(),
    "in": "of in on at to for with by from de du dans pour zu von mit auf en con por".split(),
    "cc": "and or but et ou und oder y pero".split(),
    "md": "is are was were be has have had will would est sont ist sind hat es son".split(),
}
VERB = "(ed|ing|ent|ten|ar)$"
#: Direct kinds of the tags and labels of sketched().
KINDS = {"dt": "function", "in": "function", "cc": "function", "md": "verb", "vb": "verb", "nn": "noun", "verb": "content", "noun": "content", "nsbj": "argument", "obj": "argument", "pobj": "argument"}


def parse_facts(tokens: DataFrame, arcs: DataFrame, ontology: DataFrame, marks: dict[str, str] | None = None) -> DataFrame:
    """(graph_id, s, t, o, pid): a graph for each text from tokens (graph_id, i, word, tag) and arcs (graph_id, i, head, label).

    A token is the node '<graph_id>#<i>', of its tag's type and a span; marks gives words a further type. Every tag that a
    text has is of all types above it in ontology (kind, sup) and of type pstg, every label of all types above it.
    An arc is the fact (head, label, token); one whose head is null or -1 asserts its token. A token may have
    several heads, and a text several roots. Tokens without a tag are spans alone; arcs without a label are left out unless
    they assert, as are arcs from or to tokens that aren't there. Facts given twice are one.
    """
    at = lambda i: F.concat(F.col("graph_id").cast("string"), F.lit("#"), F.col(i).cast("string"))
    fact = lambda s, t, o: F.struct(s.alias("s"), t.alias("t"), o.alias("o"))
    kind, none = F.lit("type"), F.lit(None).cast("string")
    above = types(ontology.select(F.col("kind").alias("s"), kind.alias("t"), F.col("sup").alias("o"))).where("c <> sup")
    own = [F.when(F.col("tag").isNotNull(), fact(at("i"), kind, F.col("tag"))), fact(at("i"), kind, F.lit(SPAN))]
    own += [F.when(F.col("word") == w, fact(at("i"), kind, F.lit(m))) for w, m in (marks or {}).items()]
    spans = tokens.where("i IS NOT NULL").select("graph_id", F.explode(F.array_compact(F.array(*own))).alias("f"))
    tags = tokens.where("tag IS NOT NULL").select("graph_id", F.col("tag").alias("c")).distinct()
    root = F.col("head").isNull() | (F.col("head") == -1)
    there = tokens.select("graph_id", "i").distinct()
    links = arcs.join(there, ["graph_id", "i"], "left_semi")
    ends = links.where(~root & F.col("label").isNotNull()).join(there.withColumnRenamed("i", "head"), ["graph_id", "head"], "left_semi")
    labels = ends.select("graph_id", F.col("label").alias("c")).distinct()
    up = tags.union(labels).join(above, "c").select("graph_id", fact(F.col("c"), kind, F.col("sup")).alias("f"))
    parts = [
        spans,
        tags.select("graph_id", fact(F.col("c"), kind, F.lit(TAG)).alias("f")),
        up,
        ends.select("graph_id", fact(at("head"), F.col("label"), at("i")).alias("f")),
        links.where(root).select("graph_id", fact(at("i"), F.lit("assert"), none).alias("f")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    out = out.select("graph_id", "f.*").distinct()
    return out.withColumn("pid", F.concat(F.lit("q:"), "s", F.lit("|"), "t", F.lit("|"), F.coalesce("o", F.lit(""))))


def sketched(words: DataFrame) -> DataFrame:
    """(graph_id, i, word, tag, head, label): words (graph_id, sentence, i, word) with tags and arcs by a fixed rule.

    Tags come from WORDS and the ending. A sentence's root is its first verb, else its first noun, else its first word. A
    determiner or auxiliary hangs on the next content word, a preposition or conjunction on the last one, where there is
    none on the root; a content word on the preposition before it (pobj), by a conjunction on the content word
    before (conj), else on the root, as nsbj before it and obj after it; determiners between don't count.
    A stand-in for a parser, of several heads and labels; it claims no linguistic truth.
    """
    tag = F.lit("nn")
    tag = F.when(F.col("word").rlike(VERB), "vb").otherwise(tag)
    for t, of in WORDS.items():
        tag = F.when(F.col("word").isin(of), t).otherwise(tag)
    whole = Window.partitionBy("graph_id", "sentence")
    before = whole.orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    after = whole.orderBy("i").rowsBetween(1, Window.unboundedFollowing)
    tagged = words.withColumn("tag", tag)
    is_, i = lambda *ts: F.col("tag").isin(*ts), F.col("i")
    root = F.coalesce(F.min(F.when(is_("vb", "md"), i)).over(whole), F.min(F.when(is_("nn"), i)).over(whole), F.min(i).over(whole))
    rows = tagged.withColumn("_r", root).withColumn("_p", F.max(F.when(is_("vb", "nn"), i)).over(before)).withColumn("_n", F.min(F.when(is_("vb", "nn"), i)).over(after))
    rows = rows.withColumn("_q", F.max(F.when(~is_("dt"), F.struct("i", "tag"))).over(before))
    left, right, link = F.coalesce("_p", "_r"), F.coalesce("_n", "_r"), F.col("_q.tag")
    arc = lambda head, label: F.struct(head.cast("int").alias("head"), F.lit(label).alias("label"))
    found = F.when(i == F.col("_r"), arc(F.lit(None), "root")).when(is_("dt"), arc(right, "det")).when(is_("md"), arc(right, "aux"))
    found = found.when(is_("in"), arc(left, "case")).when(is_("cc"), arc(left, "coord")).when(link == "in", arc(F.col("_q.i"), "pobj"))
    found = found.when(link == "cc", arc(left, "conj")).when(i < F.col("_r"), arc(F.col("_r"), "nsbj")).otherwise(arc(F.col("_r"), "obj"))
    return rows.withColumn("_a", found).select("graph_id", "i", "word", "tag", "_a.head", "_a.label")
