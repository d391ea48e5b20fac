"""Lookups, filters, checks and counts over the star graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadloom.operators import lookup
from quadloom.plans.flagship import segment_products
from quadloom.plans.registry import query
from quadloom.sources.graphs import star_graph

_read = lambda spark, d, n: spark.read.parquet(f"{d}/{n}.parquet")


@query("flagship", """
SELECT concat('pt:', p_type) AS product_type, CAST(count(*) AS BIGINT) AS n_matches
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN part ON p_partkey = l_partkey
WHERE c_mktsegment = 'BUILDING' AND l_returnflag <> 'R' AND l_linestatus <> 'O' GROUP BY p_type""")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment_products(spark, sf_dir)


@query("g1_quads", "SELECT * FROM quads", "star")
def g1_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star_graph(spark, sf_dir)


def _asked(spark, d) -> DataFrame:
    return _read(spark, d, "customer").select(F.concat(F.lit("c:"), "c_custkey").alias("s"), F.lit("in").alias("t"), F.concat(F.lit("n:"), F.col("c_custkey") % 25).alias("o"))


@query("has_bulk", "SELECT concat('c:', c_custkey) AS s, 'in' AS t, concat('n:', c_custkey % 25) AS o FROM customer WHERE c_nationkey = c_custkey % 25")
def has_bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.existing(_asked(spark, sf_dir), star_graph(spark, sf_dir))


_BOUND = {
    "s": "s IN (SELECT concat('c:', c_custkey) FROM customer)",
    "t": "t = 'urgent'",
    "o": "o IN (SELECT concat('n:', n_nationkey) FROM nation)",
    "st": "(s, t) IN (SELECT (concat('c:', c_custkey), 'place') FROM customer)",
    "so": "(s, o) IN (SELECT (concat('c:', c_custkey), concat('n:', c_nationkey)) FROM customer)",
    "to": "(t, o) IN (SELECT ('in', concat('n:', n_nationkey)) FROM nation)",
    "sto": "(s, t, o) IN (SELECT (concat('s:', s_suppkey), 'in', concat('n:', s_nationkey)) FROM supplier)",
}


def _bound(spark, d, by):
    c, n = _read(spark, d, "customer"), _read(spark, d, "nation")
    node = lambda p, x: F.concat(F.lit(p), x)
    if by in ("s", "st"):
        out = c.select(node("c:", "c_custkey").alias("s"))
        return out.withColumn("t", F.lit("place")) if by == "st" else out
    if by == "t":
        return spark.createDataFrame([("urgent",)], "t string")
    if by in ("o", "to"):
        out = n.select(node("n:", "n_nationkey").alias("o"))
        return out.withColumn("t", F.lit("in")) if by == "to" else out
    if by == "so":
        return c.select(node("c:", "c_custkey").alias("s"), node("n:", "c_nationkey").alias("o"))
    return _read(spark, d, "supplier").select(node("s:", "s_suppkey").alias("s"), F.lit("in").alias("t"), node("n:", "s_nationkey").alias("o"))


#: The type that the bound rows name, where they name one.
_KIND = {"t": ["urgent"], "st": ["place"], "to": ["in"], "sto": ["in"]}

for _by, _where in _BOUND.items():
    query(f"predicates_by_{_by}", f"SELECT s, t, o, pid FROM quads WHERE {_where}", "star")(lambda spark, d, by=_by: lookup.predicates(star_graph(spark, d, *_KIND.get(by, [])), _bound(spark, d, by)))


@query("predicates_by_all", "SELECT t, CAST(count(*) AS BIGINT) AS n, CAST(count(o) AS BIGINT) AS n_two FROM quads GROUP BY t", "star")
def predicates_by_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.predicates(star_graph(spark, sf_dir)).groupBy("t").agg(F.count("*").alias("n"), F.count("o").alias("n_two"))


@query("by_pid", "SELECT pid, s, t, o FROM quads WHERE pid IN (SELECT concat('po:', o_orderkey) FROM orders)", "star")
def by_pid(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = _read(spark, sf_dir, "orders").select(F.concat(F.lit("po:"), "o_orderkey").alias("pid"))
    return star_graph(spark, sf_dir).join(ids, "pid").select("pid", "s", "t", "o")


@query("subjects_of", "SELECT DISTINCT o AS concept, s AS subject FROM quads WHERE t = 'in'", "star")
def subjects_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.subjects(star_graph(spark, sf_dir), "in")


@query("objects_of", "SELECT DISTINCT s AS concept, o AS object FROM quads WHERE t = 'supply' AND o IS NOT NULL", "star")
def objects_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.objects(star_graph(spark, sf_dir), "supply")


@query("concepts", "SELECT DISTINCT c FROM (SELECT s AS c FROM quads UNION ALL SELECT t FROM quads UNION ALL SELECT o FROM quads UNION ALL SELECT pid FROM quads) WHERE c IS NOT NULL", "star")
def concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.concepts(star_graph(spark, sf_dir)).select("c")


@query("related", """
WITH i AS (SELECT s AS c, pid, 0 AS side FROM quads WHERE s LIKE 's:%' AND t <> 'type' UNION ALL SELECT o, pid, 1 FROM quads WHERE o LIKE 'n:%' AND t <> 'type'),
r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY side, pid) AS k FROM i)
SELECT c, pid FROM r WHERE k <= 5""", "star")
def related(spark: SparkSession, sf_dir: str) -> DataFrame:
    quads = star_graph(spark, sf_dir)
    subjects = quads.where("s LIKE 's:%'").select(F.col("s").alias("c")).distinct()
    objects_ = quads.where("o LIKE 'n:%'").select(F.col("o").alias("c")).distinct()
    rows = lookup.incident(quads.where("t <> 'type'"))
    wanted = rows.where("side = 0").join(subjects, "c", "left_semi").union(rows.where("side = 1").join(objects_, "c", "left_semi"))
    return lookup.limited(wanted, 5).select("c", "pid")


@query("subgraph", """
WITH ty(c, sup) AS (SELECT s, s FROM quads WHERE t = 'type' UNION SELECT o, o FROM quads WHERE t = 'type' UNION SELECT ty.c, q.o FROM ty JOIN quads q ON q.t = 'type' AND q.s = ty.sup AND q.s <> q.o),
k AS (SELECT DISTINCT c FROM ty WHERE sup IN ('party', 'place'))
SELECT s, t, o, pid FROM quads WHERE s IN (SELECT c FROM k) AND o IN (SELECT c FROM k) AND t <> 'type'""", "star")
def subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.subgraph(star_graph(spark, sf_dir), ["party", "place"], ["type"]).select("s", "t", "o", "pid")


@query("prune_types", "SELECT t, CAST(count(*) AS BIGINT) AS n FROM quads WHERE t NOT IN ('contain', 'not', 'maybe') GROUP BY t", "star")
def prune_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadloom.operators.mutate import remove

    quads = star_graph(spark, sf_dir)
    gone = quads.where("t = 'contain'").select("graph_id", "pid")
    return remove(quads.where("t <> 'contain'"), pids=gone).groupBy("t").agg(F.count("*").alias("n"))


@query("pullers", """
WITH f AS (SELECT concat('c:', c_custkey) AS c, least(1.0, greatest(0.0, c_acctbal / 10000)) AS sal FROM customer),
a AS (SELECT s AS c FROM quads WHERE t IN ('place', 'in', 'supply', 'contain') UNION SELECT o FROM quads WHERE t IN ('place', 'in', 'supply', 'contain'))
SELECT f.c FROM f WHERE sal > 0 AND c IN (SELECT c FROM a) AND c NOT IN (SELECT o FROM quads WHERE t IN ('type', 'expr'))""", "star")
def pullers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadloom.sources.graphs import star_salience

    sal = star_salience(spark, sf_dir).where("c LIKE 'c:%'")
    return lookup.pullers(star_graph(spark, sf_dir), sal, ["place", "in", "supply", "contain"])


@query("undefined_concepts", """
WITH u AS (SELECT s AS c FROM quads WHERE t NOT IN ('type', 'expr') UNION SELECT o FROM quads WHERE t NOT IN ('type', 'expr') AND o IS NOT NULL)
SELECT c FROM u WHERE c NOT IN (SELECT s FROM quads WHERE t = 'type') AND c NOT IN (SELECT o FROM quads WHERE t = 'type') AND c NOT IN (SELECT pid FROM quads)""", "star")
def undefined_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.undefined(star_graph(spark, sf_dir))


@query("failed_refs", """
SELECT concat('c:', o_custkey) AS ref, CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0) GROUP BY o_custkey""")
def failed_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = star_graph(spark, sf_dir, "place").select(F.col("s").alias("ref"))
    declared = _read(spark, sf_dir, "customer").where("c_custkey % 7 <> 0").select(F.concat(F.lit("c:"), "c_custkey").alias("ref"))
    return refs.join(declared, "ref", "left_anti").groupBy("ref").agg(F.count("*").alias("n"))


@query("dup_defs", "SELECT s AS name, CAST(count(*) AS BIGINT) AS n FROM quads WHERE t = 'expr' GROUP BY s HAVING count(*) > 1", "star")
def dup_defs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star_graph(spark, sf_dir, "expr").groupBy(F.col("s").alias("name")).agg(F.count("*").alias("n")).where("n > 1")


@query("mult_mismatch", "SELECT p_partkey FROM part WHERE len(string_split(p_name, ' ')) <> len(string_split(p_type, ' '))")
def mult_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").where(F.size(F.split("p_name", " ")) != F.size(F.split("p_type", " "))).select("p_partkey")


@query("pid_conflicts", """
SELECT pid, CAST(count(DISTINCT concat(s, '|', t, '|', coalesce(o, ''))) AS BIGINT) AS n FROM (
  SELECT concat('li:', l_orderkey, '_', l_linenumber) AS pid, concat('o:', l_orderkey) AS s, 'contain' AS t, concat('p:', l_partkey) AS o FROM lineitem)
GROUP BY pid HAVING count(DISTINCT concat(s, '|', t, '|', coalesce(o, ''))) > 1""")
def pid_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem")
    facts = li.select(F.concat_ws("_", F.concat(F.lit("li:"), "l_orderkey"), "l_linenumber").alias("pid"), F.concat(F.lit("o:"), "l_orderkey").alias("s"), F.lit("contain").alias("t"), F.concat(F.lit("p:"), "l_partkey").alias("o"))
    return lookup.conflicts(facts)


@query("degree", """
SELECT node, role, CAST(count(*) AS BIGINT) AS n FROM (SELECT s AS node, 's' AS role FROM quads UNION ALL SELECT t, 't' FROM quads UNION ALL SELECT o, 'o' FROM quads WHERE o IS NOT NULL) GROUP BY node, role""", "star")
def degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.degree(star_graph(spark, sf_dir))


@query("edge_label_counts", "SELECT s AS node, t AS label, CAST(count(*) AS BIGINT) AS n FROM quads GROUP BY s, t", "star")
def edge_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star_graph(spark, sf_dir).groupBy(F.col("s").alias("node"), F.col("t").alias("label")).agg(F.count("*").alias("n"))


@query("render_flat", """
SELECT graph_id, t, pid, concat(pid, '/', t, '(', s, CASE WHEN o IS NULL THEN '' ELSE concat(',', o) END, ')') AS text FROM quads""", "star")
def render_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.rendered(star_graph(spark, sf_dir))


@query("labels", """
WITH e AS (SELECT o AS c, min(s) AS label FROM quads WHERE t = 'expr' GROUP BY o), k AS (SELECT s AS c, min(o) AS label FROM quads WHERE t = 'type' GROUP BY s),
n AS (SELECT DISTINCT s AS c FROM quads WHERE t IN ('in', 'contain', 'part_of') UNION SELECT DISTINCT o FROM quads WHERE t IN ('in', 'contain', 'part_of'))
SELECT n.c, coalesce(e.label, k.label, n.c) AS label FROM n LEFT JOIN e ON e.c = n.c LEFT JOIN k ON k.c = n.c""", "star")
def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    quads = star_graph(spark, sf_dir)
    some = quads.where("t IN ('in', 'contain', 'part_of')")
    nodes = some.select(F.col("s").alias("c")).union(some.select("o")).distinct()
    return lookup.labelled(nodes, quads)


@query("pull_types", """
WITH present AS (SELECT DISTINCT s FROM quads WHERE t = 'type' AND s LIKE 'c:%'),
a AS (SELECT DISTINCT s AS c FROM quads WHERE t = 'supply')
SELECT q.s, q.o FROM quads q JOIN a ON a.c = q.s WHERE q.t = 'type' AND q.s NOT IN (SELECT s FROM present)""", "star")
def pull_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    quads = star_graph(spark, sf_dir)
    kinds = quads.where("t = 'type'")
    active = quads.where("t = 'supply'").select("s").distinct()
    return kinds.join(active, "s", "left_semi").join(kinds.where("s LIKE 'c:%'").select("s").distinct(), "s", "left_anti").select("s", "o")


@query("pull_expressions", "SELECT s AS text, o AS concept FROM quads WHERE t = 'expr' AND o IN (SELECT o FROM quads WHERE t = 'prefer')", "star")
def pull_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    quads = star_graph(spark, sf_dir)
    active = quads.where("t = 'prefer'").select("o").distinct()
    return quads.where("t = 'expr'").join(active, "o", "left_semi").select(F.col("s").alias("text"), F.col("o").alias("concept"))


@query("expr_dict", """
WITH e AS (SELECT o AS concept, replace(s, '"', '') AS text, row_number() OVER (PARTITION BY o ORDER BY pid) AS k FROM quads WHERE t = 'expr')
SELECT concept, text FROM e WHERE k = 1""", "star")
def expr_dict(spark: SparkSession, sf_dir: str) -> DataFrame:
    quads = star_graph(spark, sf_dir, "expr")
    first = Window.partitionBy("o").orderBy("pid")
    return quads.withColumn("k", F.row_number().over(first)).where("k = 1").select(F.col("o").alias("concept"), F.regexp_replace("s", '"', "").alias("text"))


@query("auto_expr", "SELECT DISTINCT concat('\"', s, '\"') AS text, s AS concept FROM quads WHERE regexp_matches(s, '^[A-Za-z .-]+$') AND t = 'type'", "star")
def auto_expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = star_graph(spark, sf_dir, "type").select(F.col("s").alias("concept")).distinct()
    return names.where(F.col("concept").rlike("^[A-Za-z .-]+$")).select(F.concat(F.lit('"'), "concept", F.lit('"')).alias("text"), "concept")
