"""Rankings: what to keep, which candidate answers, and templates filled from matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadloom.operators import ranking as rank
from quadloom.operators.closure import types
from quadloom.operators.match import match
from quadloom.plans.matching import TY
from quadloom.plans.registry import query
from quadloom.sources.graphs import event_graph, star_graph, star_salience

_read = lambda spark, d, n: spark.read.parquet(f"{d}/{n}.parquet")
_GIVEN = """given AS (SELECT concat('c:', c_custkey) AS c, least(1.0, greatest(0.0, c_acctbal / 10000)) AS salience FROM customer UNION ALL SELECT concat('o:', o_orderkey), CASE WHEN o_orderstatus = 'O' THEN 1.0 ELSE 0.5 END FROM orders UNION ALL SELECT concat('p:', p_partkey), p_size / 50.0 FROM part)"""


@query("topk_keep", f"""
WITH {_GIVEN}, f AS (SELECT q.pid, q.s, greatest(a.salience, b.salience) AS sal FROM quads q JOIN given a ON a.c = q.s JOIN given b ON b.c = q.o WHERE q.t = 'contain'),
r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY sal DESC, pid) AS k FROM f) SELECT s, pid FROM r WHERE k <= 2""", "star")
def topk_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    sal = star_salience(spark, sf_dir)
    facts = star_graph(spark, sf_dir, "contain")
    rows = facts.join(sal.select(F.col("c").alias("s"), F.col("salience").alias("a")), "s").join(sal.select(F.col("c").alias("o"), F.col("salience").alias("b")), "o")
    return rank.best(rows.withColumn("sal", F.greatest("a", "b")), ["s"], [F.desc("sal"), "pid"], 2).select("s", "pid")


_CAND = f"""{_GIVEN}, prio AS (SELECT 'BUILDING' AS seg, 1.0 AS p UNION ALL SELECT 'MACHINERY', 0.1),
cand AS (SELECT q.s AS c, l.s AS o, l.o AS p, l.pid, c_mktsegment AS seg FROM quads q JOIN quads l ON l.t = 'contain' AND l.s = q.o JOIN customer ON concat('c:', c_custkey) = q.s WHERE q.t = 'place'),
sc AS (SELECT cand.c, cand.pid, round((a.salience + b.salience + d.salience) / 3 + coalesce(prio.p, 0.5) + 0.5 * d.salience + 1e-9, 6) AS score FROM cand JOIN given a ON a.c = cand.c JOIN given b ON b.c = cand.o JOIN given d ON d.c = cand.p LEFT JOIN prio ON prio.seg = cand.seg)"""


def _candidates(spark: SparkSession, d: str, *of_order: DataFrame) -> DataFrame:
    """Bought lines of each customer, scored by mean salience, the segment's priority and the part's salience.

    of_order: further tables by order (o, ...), whose columns the lines then have. What hangs on an order is put together before its
    lines come in, and a line brings its part's salience, so that lines are shuffled by part and by order alone.
    """
    quads, sal = star_graph(spark, d, "place", "contain", "type"), star_salience(spark, d)
    kinds = quads.where("t = 'type' AND s LIKE 'c:%'").select(F.col("s").alias("c"), F.col("o").alias("seg"))
    of = lambda v: sal.select(F.col("c").alias(v), F.col("salience").alias(f"s_{v}"))
    orders = match(quads, [("?c", "place", "?o")]).join(of("c"), "c").join(kinds, "c").join(of("o"), "o")
    for more in of_order:
        orders = orders.join(more, "o", "left")
    found = match(quads, [("?o", "contain", "?p", "?pid")]).join(of("p"), "p").join(orders, ["graph_id", "o"])
    priority = F.when(F.col("seg") == "seg:BUILDING", 1.0).when(F.col("seg") == "seg:MACHINERY", 0.1).otherwise(0.5)
    more = [c for t in of_order for c in t.columns if c != "o"]
    return found.select("c", "pid", rank.score([F.col("s_c"), F.col("s_o"), F.col("s_p")], priority, F.col("s_p")).alias("score"), *more)


@query("candidate_score", f"WITH {_CAND} SELECT c, pid, score FROM sc", "star")
def candidate_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir)


@query("best_candidate", f"WITH {_CAND}, r AS (SELECT sc.*, row_number() OVER (PARTITION BY sc.c ORDER BY CASE WHEN o_orderpriority LIKE '1%' THEN 0 ELSE 1 END, score DESC, sc.pid) AS k FROM sc JOIN cand USING (pid) JOIN orders ON concat('o:', o_orderkey) = cand.o) SELECT c, pid, score FROM r WHERE k = 1", "star")
def best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's best line, those of an urgent order, which is an open question, before all others."""
    quads = star_graph(spark, sf_dir, "place", "urgent")
    asked = match(quads, [("?x", "place", "?o", "?q"), ("?q", "urgent", None)]).select("o", F.lit(1).alias("answers")).distinct()
    return rank.best(_candidates(spark, sf_dir, asked), ["c"], [F.desc_nulls_last("answers"), F.desc("score"), "pid"]).select("c", "pid", "score")


@query("compose", f"""WITH {_CAND}, r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY score DESC, pid) AS k FROM sc)
SELECT a.c, CASE WHEN b.pid IS NULL THEN a.pid WHEN b.score >= a.score THEN b.pid ELSE concat(a.pid, ' ', b.pid) END AS text FROM r a LEFT JOIN r b ON b.c = a.c AND b.k = 2 WHERE a.k = 1""", "star")
def compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two best candidates of a customer as one answer."""
    top = rank.best(_candidates(spark, sf_dir), ["c"], [F.desc("score"), "pid"], 2, "k")
    one = top.groupBy("c").agg(*[F.max(F.when(F.col("k") == i, F.col(x))).alias(f"{x}{i}") for i in (1, 2) for x in ("pid", "score")])
    return one.select("c", F.when(F.col("pid2").isNull(), F.col("pid1")).when(F.col("score2") >= F.col("score1"), F.col("pid2")).otherwise(F.concat_ws(" ", "pid1", "pid2")).alias("text"))


@query("compose_kinds", f"""
WITH {_CAND}, k AS (SELECT c, pid AS text, score, CASE WHEN l_returnflag = 'R' THEN 'react' WHEN l_linestatus = 'O' THEN 'rpresent' ELSE 'present' END AS kind FROM sc JOIN li ON li.id = sc.pid),
b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY c, kind ORDER BY score DESC, text) = 1),
o AS (SELECT c, max(CASE WHEN kind = 'react' THEN text END) AS r, max(CASE WHEN kind = 'present' THEN text END) AS p, max(CASE WHEN kind = 'rpresent' THEN text END) AS rp, max(CASE WHEN kind = 'present' THEN score END) AS ps, max(CASE WHEN kind = 'rpresent' THEN score END) AS rs FROM b GROUP BY c)
SELECT c, CASE WHEN rp IS NOT NULL AND (p IS NULL OR rs >= ps) THEN rp WHEN p IS NOT NULL THEN concat(coalesce(r, 'okay'), ' ', p) END AS text FROM o""", "star")
def compose_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's bought lines as candidates: returned ones react, doubted ones react and present at once, sure ones present."""
    marks = star_graph(spark, sf_dir, "not", "maybe").select(F.col("s").alias("pid"), "t")
    kind = F.when(F.col("t") == "not", "react").when(F.col("t") == "maybe", "rpresent").otherwise("present")
    rows = _candidates(spark, sf_dir).join(marks, "pid", "left").select(F.col("c").alias("session"), kind.alias("kind"), "score", F.col("pid").alias("text"))
    return rank.composed(rows, F.lit("okay")).withColumnRenamed("session", "c")


@query("open_question", "SELECT graph_id, pid FROM (SELECT *, max(turn) OVER (PARTITION BY graph_id) AS last FROM acts) WHERE turn >= last - 1 QUALIFY row_number() OVER (PARTITION BY graph_id ORDER BY value DESC, pid) = 1", "events")
def open_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    acts = event_graph(spark, sf_dir)
    recent = acts.join(acts.groupBy("graph_id").agg(F.max("turn").alias("last")), "graph_id").where("turn >= last - 1")
    return rank.best(recent, ["graph_id"], [F.desc("value"), "pid"]).select("graph_id", "pid")


@query("resolve_best", f"WITH {_GIVEN}, r AS (SELECT q.s AS ref, q.o AS match, row_number() OVER (PARTITION BY q.s ORDER BY g.salience DESC, q.o) AS k FROM quads q JOIN given g ON g.c = q.o WHERE q.t = 'supply') SELECT ref, match FROM r WHERE k = 1", "star")
def resolve_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = star_graph(spark, sf_dir, "supply").select(F.col("s").alias("ref"), F.col("o").alias("c")).join(star_salience(spark, sf_dir), "c")
    return rank.best(rows, ["ref"], [F.desc("salience"), "c"]).select("ref", F.col("c").alias("match"))


@query("arg_answer", f"WITH RECURSIVE {TY}, {_GIVEN}, r AS (SELECT q.s AS c, q.o AS n, row_number() OVER (PARTITION BY q.o ORDER BY g.salience DESC, q.s) AS k FROM quads q JOIN given g ON g.c = q.s WHERE q.t = 'in' AND q.s IN (SELECT c FROM ty WHERE sup = 'customer')) SELECT n, c FROM r WHERE k = 1", "star")
def arg_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    quads = star_graph(spark, sf_dir)
    of = types(quads).where("sup = 'customer'").select("c")
    rows = quads.where("t = 'in'").select(F.col("s").alias("c"), F.col("o").alias("n")).join(of, "c", "left_semi").join(star_salience(spark, sf_dir), "c")
    return rank.best(rows, ["n"], [F.desc("salience"), "c"]).select("n", "c")


@query("rule_priority", "SELECT o AS centre, s AS rule FROM quads WHERE t = 'supply' QUALIFY row_number() OVER (PARTITION BY o ORDER BY CAST(substr(s, 3) AS BIGINT)) = 1", "star")
def rule_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = star_graph(spark, sf_dir, "supply").withColumn("rindex", F.expr("try_cast(substring(s, 3) AS BIGINT)"))
    return rank.best(rows, ["o"], ["rindex"]).select(F.col("o").alias("centre"), F.col("s").alias("rule"))


@query("template_tokens", "SELECT concat('o:', l_orderkey) AS rule, string_agg(concat(l_linenumber, '/', l_partkey, '/', l_suppkey), ' ' ORDER BY l_linenumber, l_partkey, l_suppkey) AS tokens FROM lineitem GROUP BY l_orderkey")
def template_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem").select(F.concat(F.lit("o:"), "l_orderkey").alias("rule"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("at"), F.concat_ws("/", "l_linenumber", "l_partkey", "l_suppkey").alias("token"))
    return rank.in_order(li, ["rule"], "at", "token").select("rule", F.array_join("parts", " ").alias("tokens"))


@query("fill_template", """
SELECT concat('po:', o_orderkey) AS sol, concat('customer c:', c_custkey, ' of ', n_name, ' placed o:', o_orderkey) AS text FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey""")
def fill_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    quads = star_graph(spark, sf_dir)
    found = match(quads, [("?X", "place", "?Y", "?sol"), ("?X", "in", "?Z")])
    names = _read(spark, sf_dir, "nation").select(F.concat(F.lit("n:"), "n_nationkey").alias("concept"), F.col("n_name").alias("text"))
    return rank.filled(found, "sol", ["customer", "?X", "of", "?Z", "placed", "?Y"], names)


@query("repetition", """
WITH l AS (SELECT o_custkey AS session, p_brand AS rule, l_suppkey AS form, p_type AS text, o_orderstatus AS st, l_returnflag AS flag, concat(strftime(o_orderdate, '%Y-%m-%d'), '|', id) AS w FROM li JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey),
k AS (SELECT DISTINCT session, rule, form, text, CASE flag WHEN 'R' THEN 'nr' WHEN 'A' THEN 'ur' ELSE 'r' END AS mode FROM l WHERE st = 'O'), h AS (SELECT * FROM l WHERE st <> 'O'),
z AS (SELECT session, rule, arg_max(form, w) AS lform, arg_max(text, w) AS ltext FROM h GROUP BY 1, 2), s AS (SELECT DISTINCT session, text FROM h),
j AS (SELECT k.*, lform, ltext, s.text IS NOT NULL AS said FROM k LEFT JOIN z USING (session, rule) LEFT JOIN s ON s.session = k.session AND s.text = k.text),
g AS (SELECT session, rule, count(DISTINCT form) > 1 AS several, coalesce(bool_or(form = lform AND text <> ltext), false) AS changed FROM j GROUP BY 1, 2)
SELECT session, rule, form, text, mode FROM j JOIN g USING (session, rule) WHERE CASE mode WHEN 'nr' THEN lform IS NULL AND NOT said WHEN 'ur' THEN lform IS NULL OR (changed AND form <> lform) ELSE lform IS NULL OR NOT several OR form <> lform END""", "star")
def repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What customers may be told of the lines they have open, after those that are done: brands are rules, suppliers their forms."""
    from quadloom.sources.graphs import star_lines

    li = star_lines(spark, sf_dir)
    o, p = _read(spark, sf_dir, "orders"), _read(spark, sf_dir, "part")
    rows = li.join(o, F.col("o_orderkey") == F.col("l_orderkey")).join(p, F.col("p_partkey") == F.col("l_partkey"))
    mode = F.when(F.col("l_returnflag") == "R", "nr").when(F.col("l_returnflag") == "A", "ur").otherwise("r")
    rows = rows.select(F.col("o_custkey").alias("session"), F.col("p_brand").alias("rule"), F.col("l_suppkey").alias("form"), F.col("p_type").alias("text"), mode.alias("mode"), "o_orderstatus", F.concat_ws("|", F.date_format("o_orderdate", "yyyy-MM-dd"), "id").alias("at"))
    return rank.allowed(rows.where("o_orderstatus = 'O'").select("session", "rule", "form", "text", "mode").distinct(), rows.where("o_orderstatus <> 'O'"))


@query("fallback", "WITH f AS (SELECT name AS text, row_number() OVER (ORDER BY name) AS at FROM (SELECT DISTINCT n_name AS name FROM nation)), u AS (SELECT DISTINCT o_custkey AS session, n_name AS text FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey) SELECT c_custkey AS session, min_by(f.text, f.at) AS text FROM customer CROSS JOIN f WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.session = c_custkey AND u.text = f.text) GROUP BY c_custkey")
def fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first nation that a customer has nothing from yet, as what to fall back to."""
    o, li, s, n = (_read(spark, sf_dir, x) for x in ("orders", "lineitem", "supplier", "nation"))
    used = o.join(li, F.col("l_orderkey") == F.col("o_orderkey")).join(s, F.col("s_suppkey") == F.col("l_suppkey")).join(n, F.col("n_nationkey") == F.col("s_nationkey"))
    sessions = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session"))
    return rank.unused_fallbacks(sessions, n.select(F.col("n_name").alias("text")).distinct(), used.select(F.col("o_custkey").alias("session"), F.col("n_name").alias("text")))


@query("assemble", "SELECT conv_id, string_agg(text, '. ' ORDER BY turn) AS text FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "conversations").where("role = 'assistant'")
    return rank.in_order(c, ["conv_id"], "turn", "text").select("conv_id", F.array_join("parts", ". ").alias("text"))


@query("unaware", "SELECT q.s AS c, CAST(count(*) AS BIGINT) AS n FROM quads q WHERE q.t = 'place' AND q.pid NOT IN (SELECT s FROM quads WHERE t = 'urgent') GROUP BY q.s", "star")
def unaware(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with an order that isn't marked, and how many."""
    quads = star_graph(spark, sf_dir)
    known = quads.where("t = 'urgent'").select(F.col("s").alias("pid"))
    return quads.where("t = 'place'").join(known, "pid", "left_anti").groupBy(F.col("s").alias("c")).agg(F.count("*").alias("n"))
