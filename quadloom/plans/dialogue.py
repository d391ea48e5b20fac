"""Requests, answers, awareness, templates and mentions over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.operators import dialogue as dia
from quadloom.operators import spans
from quadloom.operators.closure import types
from quadloom.operators.match import match
from quadloom.plans.matching import TY
from quadloom.plans.registry import query
from quadloom.sources.graphs import event_graph, star_graph

_read = lambda spark, d, n: spark.read.parquet(f"{d}/{n}.parquet")
_TOK = "list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: x <> '')"


@query("pos_ontology", "SELECT DISTINCT role AS tag, kind FROM conversations JOIN (VALUES ('user', 'person'), ('user', 'entity'), ('assistant', 'bot'), ('assistant', 'agent'), ('assistant', 'entity'), ('system', 'agent'), ('system', 'entity')) v(tag, kind) ON v.tag = role")
def pos_ontology(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dia.tag_kinds(_read(spark, sf_dir, "conversations").select(F.col("role").alias("tag")).distinct())


@query("span_to_concept", f"""
WITH w AS (SELECT DISTINCT unnest({_TOK}) AS word FROM conversations), n AS (SELECT DISTINCT unnest({_TOK}) AS text FROM benchmark)
SELECT w.word, CASE WHEN a.text IS NOT NULL THEN concat('w:', a.text) WHEN b.text IS NOT NULL THEN concat('w:', b.text) ELSE 'unknown' END AS concept
FROM w LEFT JOIN n a ON a.text = w.word LEFT JOIN n b ON b.text = regexp_replace(w.word, 's$', '')""")
def span_to_concept(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = lambda n: _read(spark, sf_dir, n).select(F.explode(spans.tokens(F.col("text"))).alias("word"))
    names = words("benchmark").distinct().select(F.col("word").alias("text"), F.concat(F.lit("w:"), "word").alias("concept"))
    return dia.concept_of(words("conversations"), names)


@query("lemma_override", f"WITH w AS (SELECT DISTINCT unnest({_TOK}) AS word FROM conversations) SELECT word, CASE WHEN word IN ('are', 'is', 'was') THEN 'be' WHEN word IN ('has', 'had') THEN 'have' WHEN word = 'did' THEN 'do' ELSE word END AS lemma FROM w")
def lemma_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _read(spark, sf_dir, "conversations").select(F.explode(spans.tokens(F.col("text"))).alias("word")).distinct()
    return words.select("word", dia.lemma(F.col("word")).alias("lemma"))


@query("assign_cover", "SELECT DISTINCT pid AS s, 'user_aware' AS t FROM quads WHERE t = 'place' AND pid NOT IN (SELECT s FROM quads WHERE t = 'urgent')", "star")
def assign_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    quads = star_graph(spark, sf_dir)
    marked = quads.where("t = 'urgent'").select(F.col("s").alias("c"))
    return dia.covered(quads.where("t = 'place'").select(F.col("pid").alias("c")), marked, "user_aware")


@query("after_speak", "SELECT DISTINCT graph_id, o AS c, 'user_aware' AS mark FROM acts QUALIFY turn = max(turn) OVER (PARTITION BY graph_id)", "events")
def after_speak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was said in a session's last turn is known from then on."""
    acts = event_graph(spark, sf_dir)
    last = acts.groupBy("graph_id").agg(F.max("turn").alias("turn"))
    return acts.join(last, ["graph_id", "turn"]).select("graph_id", F.col("o").alias("c"), F.lit("user_aware").alias("mark")).distinct()


@query("spoken_updates", """
WITH last AS (SELECT * FROM acts QUALIFY turn = max(turn) OVER (PARTITION BY graph_id)), old AS (SELECT a.* FROM acts a JOIN last l ON l.graph_id = a.graph_id AND a.turn < l.turn),
put AS (SELECT l.graph_id, l.o AS s, coalesce(b.pid, concat('an:', l.pid)) AS pid FROM last l LEFT JOIN (SELECT graph_id, o, concat('an:', pid) AS pid FROM old WHERE t = 'purchase') b ON b.graph_id = l.graph_id AND b.o = l.o),
f AS (SELECT graph_id, pid AS c, NULL AS aware, turn, 1.0::DOUBLE AS salience, true AS warm FROM last UNION ALL SELECT graph_id, s, NULL, turn, NULL, NULL FROM last UNION ALL SELECT graph_id, o, NULL, turn, NULL, NULL FROM last
UNION ALL SELECT graph_id, pid, true, NULL, NULL, NULL FROM last WHERE t <> 'view' UNION ALL SELECT graph_id, pid, NULL, NULL, 1.0, NULL FROM put UNION ALL SELECT graph_id, s, NULL, NULL, 1.0, NULL FROM put)
SELECT graph_id, c, bool_or(aware) AS aware, max(turn) AS turn, max(salience) AS salience, bool_or(warm) AS warm FROM f WHERE c IS NOT NULL GROUP BY graph_id, c""", "events")
def spoken_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each session's last act as what was just said: what was viewed is known already, and what the act is about becomes a topic, as
    the things purchased before it are."""
    acts = event_graph(spark, sf_dir)
    last = acts.groupBy("graph_id").agg(F.max("turn").alias("last"))
    rows = acts.join(last, "graph_id")
    said, old = rows.where("turn = last"), rows.where("turn < last")
    topic = lambda r: r.select("graph_id", F.col("o").alias("s"), F.lit("type").alias("t"), F.lit("topic").alias("o"), F.concat(F.lit("an:"), "pid").alias("pid"))
    known = acts.where("t = 'view'").select("graph_id", F.col("pid").alias("c"))
    return dia.spoken(topic(old.where("t = 'purchase'")), said.select("graph_id", "s", "t", "o", "pid", "turn"), known, topic(said))


@query("pattern_merges", "SELECT pid AS focus, kind, node FROM (SELECT pid, 'subject' AS kind, s AS node FROM quads WHERE t = 'place' UNION ALL SELECT pid, 'object', o FROM quads WHERE t = 'place' UNION ALL SELECT pid, 'type', t FROM quads WHERE t = 'place')", "star")
def pattern_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = match(star_graph(spark, sf_dir), [("?s", "place", "?o", "?pid")])
    each = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("node")) for k, v in (("subject", F.col("s")), ("object", F.col("o")), ("type", F.lit("place")))])
    return found.select(F.col("pid").alias("focus"), F.explode(each).alias("m")).select("focus", "m.*")


@query("span_merges", "SELECT q.pid AS span, q.s AS node, 'subject' AS pos FROM quads q WHERE q.t = 'urgent' UNION ALL SELECT q.pid, p.o, 'object' FROM quads q JOIN quads p ON p.pid = q.s WHERE q.t = 'urgent'", "star")
def span_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mark's own subject, and the object of the fact it is about."""
    quads = star_graph(spark, sf_dir)
    marks = quads.where("t = 'urgent'").select(F.col("pid").alias("span"), F.col("s").alias("node"))
    about = marks.join(quads.where("t = 'place'").select(F.col("pid").alias("node"), "o"), "node").select("span", F.col("o").alias("node"), F.lit("object").alias("pos"))
    return marks.withColumn("pos", F.lit("subject")).union(about)


@query("merge_routing", "SELECT DISTINCT concat('o:', l_orderkey) AS a, concat('p:', l_partkey) AS b FROM lineitem")
def merge_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines are swallowed by their order, so pairs of a line and a part become pairs of an order and a part."""
    li = _read(spark, sf_dir, "lineitem")
    line = F.concat_ws("_", F.concat(F.lit("li:"), "l_orderkey"), "l_linenumber")
    merges = li.select(line.alias("a"), F.concat(F.lit("p:"), "l_partkey").alias("b"))
    outer = li.select(line.alias("sub"), F.concat(F.lit("o:"), "l_orderkey").alias("mention")).distinct()
    return dia.routed(merges, outer)


@query("request_status", "SELECT concat('po:', o_orderkey) AS request, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'F') THEN 'satisfied' ELSE 'unsatisfied' END AS status FROM orders")
def request_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = star_graph(spark, sf_dir, "place").select(F.col("pid").alias("request"))
    done = _read(spark, sf_dir, "lineitem").where("l_linestatus = 'F'").select(F.concat(F.lit("po:"), "l_orderkey").alias("request"))
    return dia.request_status(requests, done)


@query("question_links", "SELECT u.s AS question, c.pid AS link FROM quads u JOIN quads p ON p.pid = u.s JOIN quads c ON c.t = 'contain' AND c.s = p.o WHERE u.t = 'urgent' UNION ALL SELECT s, s FROM quads WHERE t = 'urgent'", "star")
def question_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question's own id and the constraints it refers to: for an urgent order, its lines."""
    quads = star_graph(spark, sf_dir)
    found = match(quads, [("?question", "urgent", None), ("?c", "place", "?o", "?question"), ("?o", "contain", "?p", "?link")])
    own = quads.where("t = 'urgent'").select(F.col("s").alias("question"), F.col("s").alias("link"))
    return found.select("question", "link").union(own)


@query("answering", """
WITH q AS (SELECT DISTINCT concat('po:', o_orderkey) AS q, l_suppkey AS x FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderpriority LIKE '1%'), n AS (SELECT q, count(*) AS n FROM q GROUP BY q),
k AS (SELECT DISTINCT concat('c:', o_custkey) AS cand, l_suppkey AS x FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
SELECT q.q, k.cand FROM q JOIN k USING (x) JOIN n ON n.q = q.q GROUP BY q.q, k.cand, n.n HAVING count(*) = n.n""")
def answering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers who have bought from every supplier of an urgent order."""
    o, li = _read(spark, sf_dir, "orders"), _read(spark, sf_dir, "lineitem")
    bought = o.join(li, F.col("l_orderkey") == F.col("o_orderkey"))
    questions = bought.where("o_orderpriority LIKE '1%'").select(F.concat(F.lit("po:"), "o_orderkey").alias("q"), F.col("l_suppkey").alias("x"))
    return dia.answering(questions, bought.select(F.concat(F.lit("c:"), "o_custkey").alias("cand"), F.col("l_suppkey").alias("x")))


@query("open_user_questions", "SELECT graph_id, pid FROM acts WHERE t = 'view' QUALIFY turn >= max(turn) OVER (PARTITION BY graph_id) - 1", "events")
def open_user_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = event_graph(spark, sf_dir).where("t = 'view'")
    last = asked.groupBy("graph_id").agg(F.max("turn").alias("last"))
    return asked.join(last, "graph_id").where("turn >= last - 1").select("graph_id", "pid")


_TAG = "CASE WHEN o_orderpriority LIKE '1%' THEN 'high' WHEN o_orderpriority LIKE '3%' THEN 'normal' WHEN o_orderpriority LIKE '5%' THEN 'low' ELSE o_orderpriority END"


def _templates(spark: SparkSession, d: str) -> DataFrame:
    return dia.normalised(_read(spark, d, "orders").select(F.concat(F.lit("o:"), "o_orderkey").alias("rule"), F.expr(_TAG).alias("tag")))


@query("templates", f"SELECT concat('o:', o_orderkey) AS rule, {_TAG} AS tag, CAST(CASE {_TAG} WHEN 'high' THEN 1.0 WHEN 'low' THEN 0.1 ELSE 0.5 END AS DOUBLE) AS priority FROM orders")
def templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _templates(spark, sf_dir).select("rule", "tag", F.coalesce("priority", F.lit(0.5)).alias("priority"))


@query("bad_tags", f"SELECT {_TAG} AS tag, CAST(count(*) AS BIGINT) AS n FROM orders WHERE {_TAG} NOT IN ('high', 'low', 'normal') GROUP BY 1")
def bad_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _templates(spark, sf_dir).where("priority IS NULL").groupBy("tag").agg(F.count("*").alias("n"))


@query("promote_time", "SELECT concat('o:', o_orderkey) AS head, coalesce(min(CASE WHEN l_returnflag = 'R' THEN year(l_shipdate) END), year(o_orderdate))::BIGINT AS time FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderdate")
def promote_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A head's time is that of its returned lines, where it has some, else its own."""
    o = _read(spark, sf_dir, "orders")
    raised = _read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min(F.year("l_shipdate")).alias("_t"))
    return o.join(raised, "o_orderkey", "left").select(F.concat(F.lit("o:"), "o_orderkey").alias("head"), F.coalesce("_t", F.year("o_orderdate")).cast("long").alias("time"))


@query("broad_rules", f"WITH RECURSIVE {TY} SELECT c AS rule FROM ty WHERE c <> sup AND c NOT LIKE '%:%' GROUP BY c HAVING bool_and(sup IN ('entity', 'party', 'product', 'event'))", "star")
def broad_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes whose types are all among the most general ones."""
    kinds = types(star_graph(spark, sf_dir, "type")).where("c <> sup AND c NOT LIKE '%:%'").select(F.col("c").alias("rule"), F.col("sup").alias("kind"))
    return dia.broad(kinds, ["entity", "party", "product", "event"])


@query("used_fallbacks", "SELECT conv_id, text, min(turn) AS first FROM conversations WHERE role = 'assistant' GROUP BY conv_id, text")
def used_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "conversations").where("role = 'assistant'")
    return c.groupBy("conv_id", "text").agg(F.min("turn").alias("first"))


@query("learn_generics", "SELECT s AS rule, 'pre' AS side, o AS node FROM quads WHERE t = 'prefer' AND o NOT LIKE 'p:%' UNION ALL SELECT q.s, 'post', n.o FROM quads q JOIN quads n ON n.s = q.s AND n.t = 'in' WHERE q.t = 'prefer' AND q.o NOT LIKE 'p:%'", "star")
def learn_generics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements about classes become rules: the class is the condition, what else is said follows."""
    quads = star_graph(spark, sf_dir)
    general = quads.where("t = 'prefer' AND o NOT LIKE 'p:%'").select(F.col("s").alias("rule"), F.lit("pre").alias("side"), F.col("o").alias("node"))
    follows = quads.where("t = 'in'").select(F.col("s").alias("rule"), F.lit("post").alias("side"), F.col("o").alias("node")).join(general.select("rule"), "rule", "left_semi")
    return general.unionByName(follows.select("rule", "side", "node"))
