"""Closures, components, relevance and confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.operators import salience as rel
from quadloom.operators.closure import closure, paths, reach, type_edges, types
from quadloom.operators.components import connected_components
from quadloom.operators.retrieve import pruned
from quadloom.plans.matching import TY
from quadloom.plans.registry import query
from quadloom.sources.graphs import event_graph, star_graph, star_salience
from quadloom.sources.staging import staged

_read = lambda spark, d, n: spark.read.parquet(f"{d}/{n}.parquet")


@query("type_closure", f"WITH RECURSIVE {TY} SELECT c, sup FROM ty", "star")
def type_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return types(star_graph(spark, sf_dir, "type")).select("c", "sup")


@query("subtypes", f"WITH RECURSIVE {TY} SELECT sup AS concept, CAST(count(*) AS BIGINT) AS n FROM ty GROUP BY sup", "star")
def subtypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return types(star_graph(spark, sf_dir, "type")).groupBy(F.col("sup").alias("concept")).agg(F.count("*").alias("n"))


@query("type_predicates", f"WITH RECURSIVE {TY} SELECT DISTINCT q.pid FROM ty JOIN quads q ON q.t = 'type' AND q.s = ty.sup WHERE ty.c LIKE 's:%'", "star")
def type_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    quads = star_graph(spark, sf_dir)
    up = types(quads).where("c LIKE 's:%'").select(F.col("sup").alias("s")).distinct()
    return quads.where("t = 'type'").join(up, "s", "left_semi").select("pid")


@query("structure", """
WITH RECURSIVE e(a, b) AS (SELECT pid, s FROM quads WHERE t = 'place' UNION ALL SELECT pid, o FROM quads WHERE t = 'place' UNION ALL SELECT s, pid FROM quads WHERE t = 'in' UNION ALL SELECT pid, o FROM quads WHERE t = 'in'),
r(c, x) AS (SELECT pid, pid FROM quads WHERE t = 'place' UNION SELECT r.c, e.b FROM r JOIN e ON e.a = r.x)
SELECT c, x FROM r""", "star")
def structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    quads = star_graph(spark, sf_dir)
    place, where = quads.where("t = 'place'"), quads.where("t = 'in'")
    edges = place.select(F.col("pid").alias("src"), F.col("s").alias("dst")).union(place.select("pid", "o")).union(where.select("s", "pid")).union(where.select("pid", "o"))
    start = place.select(F.col("pid").alias("c"), F.col("pid").alias("sup"))
    return closure(start, edges).select("c", F.col("sup").alias("x"))


def _regional(quads: DataFrame) -> DataFrame:
    return quads.where("t IN ('in', 'part_of') AND o <> 'world'").select(F.col("s").alias("src"), F.col("o").alias("dst"))


_REGIONAL = """e AS (SELECT s AS a, o AS b FROM quads WHERE t IN ('in', 'part_of') AND o <> 'world' UNION SELECT o, s FROM quads WHERE t IN ('in', 'part_of') AND o <> 'world'),
n AS (SELECT DISTINCT a AS node FROM e), r(node, x) AS (SELECT node, node FROM n WHERE node LIKE 'r:%' UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.x), """


@query("components", f"WITH RECURSIVE {_REGIONAL} m AS (SELECT node AS root, min(x) AS component FROM r GROUP BY node) SELECT DISTINCT r.x AS node, m.component FROM r JOIN m ON m.root = r.node", "star")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connected_components(_regional(star_graph(spark, sf_dir, "in", "part_of")))


@query("component_count", f"WITH RECURSIVE {_REGIONAL} m AS (SELECT node AS root, min(x) AS component FROM r GROUP BY node) SELECT CAST(count(DISTINCT component) AS BIGINT) AS n FROM m", "star")
def component_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connected_components(_regional(star_graph(spark, sf_dir, "in", "part_of"))).agg(F.count_distinct("component").alias("n"))


@query("reachable", f"WITH RECURSIVE {_REGIONAL} p AS (SELECT concat('c:', c_custkey) AS a, concat('n:', c_custkey % 25) AS b FROM customer) SELECT p.a, p.b FROM p WHERE EXISTS (SELECT 1 FROM r JOIN r q ON r.node = q.node WHERE r.x = p.a AND q.x = p.b)", "star")
def reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = connected_components(_regional(star_graph(spark, sf_dir, "in", "part_of")))
    pairs = _read(spark, sf_dir, "customer").select(F.concat(F.lit("c:"), "c_custkey").alias("a"), F.concat(F.lit("n:"), F.col("c_custkey") % 25).alias("b"))
    one, two = label.select(F.col("node").alias("a"), F.col("component").alias("ca")), label.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    return pairs.join(one, "a").join(two, "b").where("ca = cb").select("a", "b")


@query("subtree", """
WITH RECURSIVE r(c, x) AS (SELECT concat('r:', r_regionkey), concat('r:', r_regionkey) FROM region UNION SELECT r.c, q.s FROM r JOIN quads q ON q.o = r.x AND q.t IN ('part_of', 'in'))
SELECT c, x FROM r WHERE c <> x""", "star")
def subtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    quads = star_graph(spark, sf_dir)
    down = quads.where("t IN ('part_of', 'in')").select(F.col("o").alias("src"), F.col("s").alias("dst"))
    start = quads.where("t = 'type' AND o = 'region'").select(F.col("s").alias("c"), F.col("s").alias("sup"))
    return closure(start, down).where("c <> sup").select("c", F.col("sup").alias("x"))


@query("connected_deps", f"WITH RECURSIVE {_REGIONAL} k AS (SELECT node, count(*) - 1 AS n FROM r GROUP BY node) SELECT DISTINCT r.x AS node, CAST(k.n AS BIGINT) AS n FROM r JOIN k ON k.node = r.node", "star")
def connected_deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = connected_components(_regional(star_graph(spark, sf_dir, "in", "part_of")))
    sizes = label.groupBy("component").agg((F.count("*") - 1).alias("n"))
    return label.join(sizes, "component").select("node", "n")


@query("parent_subtree", """
WITH p AS (SELECT s AS c, min(o) AS parent FROM quads WHERE t = 'in' GROUP BY s), k AS (SELECT parent, count(*) AS n FROM (SELECT s, o AS parent FROM quads WHERE t = 'in') GROUP BY parent)
SELECT p.c, p.parent, CAST(k.n AS BIGINT) AS n_with_parent FROM p JOIN k USING (parent)""", "star")
def parent_subtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = star_graph(spark, sf_dir, "in").select(F.col("s").alias("c"), F.col("o").alias("parent"))
    first = where.groupBy("c").agg(F.min("parent").alias("parent"))
    below = where.groupBy("parent").agg(F.count("*").alias("n"))  # the parent's subtree without c itself, and the parent
    return first.join(below, "parent").select("c", "parent", F.col("n").alias("n_with_parent"))


@query("bfs_tree", """
WITH RECURSIVE e AS (SELECT s AS a, o AS b FROM quads WHERE t IN ('part_of', 'in') UNION SELECT o, s FROM quads WHERE t IN ('part_of', 'in')),
d(node, depth) AS (SELECT 'world', 0 UNION SELECT e.b, d.depth + 1 FROM d JOIN e ON e.a = d.node WHERE d.depth < 12), m AS (SELECT node, min(depth) AS depth FROM d GROUP BY node)
SELECT m.node, CAST(m.depth AS INTEGER) AS depth, min(p.node) AS parent FROM m LEFT JOIN e ON e.a = m.node LEFT JOIN m p ON p.node = e.b AND p.depth = m.depth - 1 GROUP BY m.node, m.depth""", "star")
def bfs_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    quads = star_graph(spark, sf_dir)
    edges = quads.where("t IN ('part_of', 'in')").select(F.col("s").alias("src"), F.col("o").alias("dst"))
    depth = reach(quads.where("o = 'world'").select(F.col("o").alias("c")).distinct(), edges).select("node", F.col("hop").alias("depth"))
    both = edges.union(edges.select("dst", "src"))
    up = both.join(depth.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), F.col("src").alias("p"), (F.col("depth") + 1).alias("depth"))
    parent = up.groupBy("node", "depth").agg(F.min("p").alias("parent"))
    return depth.join(parent, ["node", "depth"], "left").select("node", "depth", "parent")


@query("ancestor_paths", """
WITH RECURSIVE e AS (SELECT s AS a, o AS b FROM quads WHERE t = 'type' AND s NOT LIKE '%:%'), r(x, path) AS (SELECT a, a FROM e UNION SELECT e.b, concat(r.path, ' -> ', e.b) FROM r JOIN e ON e.a = r.x)
SELECT path FROM r WHERE x NOT IN (SELECT a FROM e)""", "star")
def ancestor_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = type_edges(star_graph(spark, sf_dir, "type")).where("src NOT LIKE '%:%'")
    return paths(edges).select("path")


@query("classify_roots", f"WITH RECURSIVE {TY} SELECT c, bool_or(sup = 'entity') AS entity_like, bool_or(sup IN ('buy', 'include', 'provide', 'event')) AS predicate_like FROM ty GROUP BY c", "star")
def classify_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return types(star_graph(spark, sf_dir, "type")).groupBy("c").agg(F.bool_or(F.col("sup") == "entity").alias("entity_like"), F.bool_or(F.col("sup").isin("buy", "include", "provide", "event")).alias("predicate_like"))


@query("concrete_type", f"WITH RECURSIVE {TY}, k AS (SELECT c, sup FROM ty WHERE c LIKE 'c:%' AND c <> sup) SELECT c, min(sup) AS kind FROM k WHERE NOT EXISTS (SELECT 1 FROM k j JOIN ty ON ty.c = j.sup WHERE j.c = k.c AND ty.sup = k.sup AND ty.c <> ty.sup) GROUP BY c", "star")
def concrete_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = types(star_graph(spark, sf_dir, "type"))
    kinds = of.where("c LIKE 'c:%' AND c <> sup")
    above = kinds.select("c", F.col("sup").alias("mid")).join(of.where("c <> sup").select(F.col("c").alias("mid"), "sup"), "mid").select("c", "sup")
    return kinds.join(above, ["c", "sup"], "left_anti").groupBy("c").agg(F.min("sup").alias("kind"))


_SAL0 = """f AS MATERIALIZED (SELECT pid, s, o FROM quads WHERE t IN ('place', 'contain')), a AS MATERIALIZED (SELECT pid, s AS c FROM f UNION ALL SELECT pid, o FROM f), nodes AS (SELECT c FROM a UNION SELECT pid FROM a),
given AS (SELECT concat('c:', c_custkey) AS c, least(1.0, greatest(0.0, c_acctbal / 10000)) AS salience FROM customer UNION ALL SELECT concat('o:', o_orderkey), CASE WHEN o_orderstatus = 'O' THEN 1.0 ELSE 0.5 END FROM orders UNION ALL SELECT concat('p:', p_partkey), p_size / 50.0 FROM part),
s0 AS (SELECT n.c, coalesce(CAST(g.salience AS DOUBLE), 0.0) AS salience FROM nodes n LEFT JOIN given g ON g.c = n.c)"""


def _salience_sql(rounds: int) -> str:
    step = ", ".join(f"""s{k} AS MATERIALIZED (SELECT s.c, greatest(s.salience, coalesce(max(m.m), 0.0)) AS salience FROM s{k - 1} s LEFT JOIN (
      SELECT a.pid AS c, avg(x.salience) - 0.3 AS m FROM a JOIN s{k - 1} x ON x.c = a.c GROUP BY a.pid
      UNION ALL SELECT a.c, max(x.salience) FROM a JOIN s{k - 1} x ON x.c = a.pid GROUP BY a.c) m ON m.c = s.c GROUP BY s.c, s.salience)""" for k in range(1, rounds + 1))
    return f"WITH {_SAL0}, {step} SELECT c, round(salience + 1e-9, 6) AS salience FROM s{rounds}"


for _n in (1, 5):
    query(f"salience_{_n}", _salience_sql(_n), "star")(lambda spark, d, n=_n: rel.propagate(star_graph(spark, d, "place", "contain"), star_salience(spark, d), n).select("c", F.round(F.col("salience") + 1e-9, 6).alias("salience")))


@query("salience_matvec", """
WITH g AS (SELECT concat('c:', c_custkey) AS c, least(1.0, greatest(0.0, c_acctbal / 10000)) AS salience FROM customer UNION ALL SELECT concat('o:', o_orderkey), CASE WHEN o_orderstatus = 'O' THEN 1.0 ELSE 0.5 END FROM orders),
m AS (SELECT q.o AS c, sum(g.salience) * 0.1 AS x FROM quads q JOIN g ON g.c = q.s WHERE q.t = 'place' GROUP BY q.o)
SELECT g.c, round(least(1.0, g.salience + coalesce(m.x, 0.0)) + 1e-9, 6) AS salience FROM g LEFT JOIN m ON m.c = g.c""", "star")
def salience_matvec(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = star_graph(spark, sf_dir, "place").select(F.col("s").alias("src"), F.col("o").alias("dst"))
    given = star_salience(spark, sf_dir).where("c NOT LIKE 'p:%'")
    return rel.matvec(edges, given).select("c", F.round(F.col("salience") + 1e-9, 6).alias("salience"))


@query("pregel_sum", """
WITH v0 AS (SELECT concat('c:', c_custkey) AS c, 1.0::DOUBLE AS v FROM customer UNION ALL SELECT concat('n:', n_nationkey), 0.0 FROM nation UNION ALL SELECT concat('r:', r_regionkey), 0.0 FROM region),
e AS (SELECT s, o FROM quads WHERE (t = 'in' AND s LIKE 'c:%') OR (t = 'part_of' AND o <> 'world')),
v1 AS (SELECT v0.c, v0.v + coalesce(sum(x.v), 0) AS v FROM v0 LEFT JOIN e ON e.o = v0.c LEFT JOIN v0 x ON x.c = e.s GROUP BY v0.c, v0.v),
v2 AS (SELECT v1.c, v1.v + coalesce(sum(x.v), 0) AS v FROM v1 LEFT JOIN e ON e.o = v1.c LEFT JOIN v1 x ON x.c = e.s GROUP BY v1.c, v1.v) SELECT c, v AS value FROM v2""", "star")
def pregel_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    quads = star_graph(spark, sf_dir)
    edges = quads.where("(t = 'in' AND s LIKE 'c:%') OR (t = 'part_of' AND o <> 'world')").select(F.col("s").alias("src"), F.col("o").alias("dst"))
    nodes = edges.select(F.col("src").alias("c")).union(edges.select("dst")).distinct().withColumn("value", F.when(F.col("c").like("c:%"), 1.0).otherwise(0.0))
    regions = quads.where("o = 'region' AND t = 'type'").select(F.col("s").alias("c"), F.lit(0.0).alias("value"))
    nations = quads.where("o = 'nation' AND t = 'type'").select(F.col("s").alias("c"), F.lit(0.0).alias("value"))
    nodes = nodes.union(regions).union(nations).groupBy("c").agg(F.max("value").alias("value"))
    return rel.pregel(nodes, edges, F.sum("value"), lambda own, got: own + got, 2)


@query("conf_and", "SELECT l_orderkey, round(product(1 - l_discount), 6) AS conf FROM lineitem GROUP BY l_orderkey")
def conf_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.round(rel.all_of(1 - F.col("l_discount")), 6).alias("conf"))


@query("conf_or", "SELECT l_orderkey, round(1 - product(1 - l_discount), 6) AS conf FROM lineitem GROUP BY l_orderkey")
def conf_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.round(rel.any_of(F.col("l_discount")), 6).alias("conf"))


@query("confidence_prop", """
WITH l AS (SELECT l_orderkey AS k, CASE WHEN l_returnflag = 'R' THEN -l_discount ELSE 1 - l_discount END AS x FROM lineitem), o AS (SELECT k, CASE WHEN min(x) >= 0 THEN product(x) ELSE product(1 + least(x, 0)) - 1 END AS x FROM l GROUP BY k),
g AS (SELECT o_custkey AS c, CASE WHEN o_orderstatus = 'P' THEN -1 ELSE 1 END AS side, CASE WHEN max(x) >= 0 THEN 1 - product(1 - greatest(x, 0)) ELSE -product(-x) END AS v FROM o JOIN orders ON o_orderkey = k GROUP BY 1, 2), h AS (SELECT c, side * v AS v FROM g)
SELECT concat('c:', c) AS c, round(CASE WHEN max(v) >= 0 THEN 1 - product(1 - greatest(v, 0)) ELSE -product(-v) END + 1e-9, 6) + 0.0 AS conf FROM h GROUP BY c""")
def confidence_prop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines are evidence for their order, returned ones against it; orders are evidence for their customer, pending ones against."""
    li, o = _read(spark, sf_dir, "lineitem"), _read(spark, sf_dir, "orders")
    line = F.concat_ws("_", F.lit("li"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.monotonically_increasing_id())
    rows = staged(li.select(line.alias("c"), F.concat(F.lit("o:"), "l_orderkey").alias("o"), F.when(F.col("l_returnflag") == "R", -F.col("l_discount")).otherwise(1 - F.col("l_discount")).cast("double").alias("conf")))
    owner = o.select(F.concat(F.lit("o:"), "o_orderkey").alias("src"), F.concat(F.lit("c:"), "o_custkey").alias("dst"), F.when(F.col("o_orderstatus") == "P", "nor").otherwise("or").alias("label"))
    none = F.lit(None).cast("double")
    nodes = rows.select("c", "conf").union(rows.select("o", none).distinct()).union(owner.select("dst", none).distinct())
    links = rows.select(F.col("c").alias("src"), F.col("o").alias("dst"), F.lit("and").alias("label")).union(owner)
    return rel.confidence(nodes, links, 2).where("c LIKE 'c:%' AND conf IS NOT NULL").select("c", (F.round(F.col("conf") + 1e-9, 6) + 0.0).alias("conf"))


@query("consider_salience", """
WITH f AS (SELECT o_custkey AS b, CASE WHEN o_orderstatus = 'O' THEN 1.0 ELSE 0.5 END AS s FROM orders WHERE o_custkey % 2 = 0), g AS (SELECT o_custkey AS b, CASE WHEN o_orderstatus = 'O' THEN 1.0 ELSE 0.5 END AS s FROM orders WHERE o_custkey % 2 = 1)
SELECT b AS batch, round(avg(s) - 0.3, 6) AS salience FROM f GROUP BY b UNION ALL SELECT b, round(avg(s) - 0.1, 6) FROM g GROUP BY b""")
def consider_salience(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("batch"), F.when(F.col("o_custkey") % 2 == 0, "association").otherwise("evidence").alias("kind"), F.when(F.col("o_orderstatus") == "O", 1.0).otherwise(0.5).alias("salience"))
    return rel.considered(o).select("batch", F.round("salience", 6).alias("salience"))


@query("feature_merge", """
WITH f AS (SELECT user_id, event_type, turn, value FROM turns2) SELECT user_id, event_type AS c, round(max(value), 6) AS salience, string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) AS turns FROM f GROUP BY user_id, event_type""".replace("turns2", "(SELECT DISTINCT user_id, event_type, turn, max(value) OVER (PARTITION BY user_id, event_type) AS value FROM turns)"), "events")
def feature_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    acts = event_graph(spark, sf_dir)
    rows = acts.groupBy(F.substring("graph_id", 3, 20).cast("long").alias("user_id"), F.col("t").alias("c")).agg(F.round(F.max("value"), 6).alias("salience"), F.array_sort(F.collect_set("turn")).alias("turns"))
    return rows.withColumn("turns", F.array_join(F.col("turns").cast("array<string>"), ","))


@query("prune_attended", """
WITH RECURSIVE k AS (SELECT q.pid FROM quads q JOIN customer ON concat('c:', c_custkey) = q.s WHERE q.t = 'place' ORDER BY least(1.0, greatest(0.0, c_acctbal / 10000)) DESC, q.pid LIMIT 50),
e(a, b) AS (SELECT pid, s FROM quads UNION ALL SELECT pid, o FROM quads WHERE o IS NOT NULL UNION ALL SELECT s, pid FROM quads WHERE t IN ('type', 'in', 'part_of') UNION ALL SELECT o, pid FROM quads WHERE t = 'expr'),
r(x) AS (SELECT pid FROM k UNION SELECT e.b FROM r JOIN e ON e.a = r.x) SELECT s, t, o FROM quads WHERE pid IN (SELECT x FROM r)""", "star")
def prune_attended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty orders of the most salient customers and all that defines them."""
    quads = star_graph(spark, sf_dir)
    keep = quads.where("t = 'place'").join(star_salience(spark, sf_dir).withColumnRenamed("c", "s"), "s").orderBy(F.desc("salience"), "pid").limit(50)
    return pruned(quads, keep.select("graph_id", "pid"), ["in", "part_of"], ["expr"]).select("s", "t", "o")
