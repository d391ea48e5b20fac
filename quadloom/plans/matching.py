"""Pattern matching, knowledge retrieval and joins over the star graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadloom.operators import retrieve
from quadloom.operators.closure import reach, types
from quadloom.operators.match import edge_rows, match, with_mark
from quadloom.plans.registry import query
from quadloom.sources.graphs import star_graph, star_salience

TY = "ty(c, sup) AS (SELECT s, s FROM quads WHERE t = 'type' UNION SELECT o, o FROM quads WHERE t = 'type' UNION SELECT ty.c, q.o FROM ty JOIN quads q ON q.t = 'type' AND q.s = ty.sup AND q.s <> q.o)"
_read = lambda spark, d, n: spark.read.parquet(f"{d}/{n}.parquet")


@query("match_edge", "SELECT s AS c, o FROM quads WHERE t = 'place'", "star")
def match_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match(star_graph(spark, sf_dir), [("?c", "place", "?o")]).select("c", "o")


@query("match_path2", "SELECT a.s AS c, a.o, b.o AS p, b.pid AS line FROM quads a JOIN quads b ON b.s = a.o AND b.t = 'contain' WHERE a.t = 'place'", "star")
def match_path2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match(star_graph(spark, sf_dir), [("?c", "place", "?o"), ("?o", "contain", "?p", "?line")]).select("c", "o", "p", "line")


@query("match_triangle", """
SELECT concat('n:', c_nationkey) AS n, CAST(count(*) AS BIGINT) AS n_matches FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
JOIN (SELECT DISTINCT l_suppkey AS sk, l_partkey AS pk FROM lineitem) sp ON sp.pk = l_partkey JOIN supplier ON s_suppkey = sp.sk AND s_nationkey = c_nationkey GROUP BY c_nationkey""")
def match_triangle(spark: SparkSession, sf_dir: str) -> DataFrame:
    buyer = [("?c", "in", "?n"), ("?c", "place", "?o"), ("?o", "contain", "?p", "?line")]
    seller = [("?s", "in", "?n"), ("?s", "supply", "?p")]
    return retrieve.meeting(star_graph(spark, sf_dir), buyer, seller).groupBy("n").agg(F.count("*").alias("n_matches"))


@query("match_counts", """
SELECT 'edge' AS pattern, CAST(count(*) AS BIGINT) AS n FROM orders UNION ALL SELECT 'path2', CAST(count(*) AS BIGINT) FROM orders JOIN lineitem ON l_orderkey = o_orderkey""")
def match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    quads = star_graph(spark, sf_dir)
    patterns = {"edge": [("?c", "place", "?o")], "path2": [("?c", "place", "?o"), ("?o", "contain", "?p", "?line")]}
    each = [match(quads, p).agg(F.count("*").alias("n")).select(F.lit(k).alias("pattern"), "n") for k, p in patterns.items()]
    return each[0].union(each[1])


@query("match_reified", """
SELECT c.s AS o, c.o AS p, c.pid AS line FROM quads c JOIN quads n ON n.s = c.pid AND n.t = 'not' JOIN quads b ON b.t = 'place' AND b.o = c.s JOIN quads u ON u.s = b.pid AND u.t = 'urgent' WHERE c.t = 'contain'""", "star")
def match_reified(spark: SparkSession, sf_dir: str) -> DataFrame:
    pattern = [("?o", "contain", "?p", "?line"), ("?line", "not", None), ("?c", "place", "?o", "?b"), ("?b", "urgent", None)]
    return match(star_graph(spark, sf_dir), pattern).select("o", "p", "line")


@query("semi_edges", "SELECT s, o FROM quads WHERE t = 'supply' AND o IN (SELECT o FROM quads WHERE t = 'prefer')", "star")
def semi_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    quads = star_graph(spark, sf_dir)
    return quads.where("t = 'supply'").join(quads.where("t = 'prefer'").select("o"), "o", "left_semi").select("s", "o")


@query("anti_edges", "SELECT s, o FROM quads WHERE t = 'supply' AND o NOT IN (SELECT o FROM quads WHERE t = 'prefer')", "star")
def anti_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    quads = star_graph(spark, sf_dir)
    return quads.where("t = 'supply'").join(quads.where("t = 'prefer'").select("o"), "o", "left_anti").select("s", "o")


@query("expand", "SELECT a.s AS source, b.o AS target FROM quads a JOIN quads b ON b.s = a.o AND b.t = 'part_of' WHERE a.t = 'in'", "star")
def expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    quads = star_graph(spark, sf_dir)
    start = quads.where("t = 'in'").select(F.col("s").alias("source"), F.col("o").alias("mid"))
    return start.join(quads.where("t = 'part_of'").select(F.col("s").alias("mid"), F.col("o").alias("target")), "mid").select("source", "target")


@query("match_disconnected", "SELECT a.s AS x, b.s AS y FROM quads a, quads b WHERE a.t = 'type' AND a.o = 'region' AND b.t = 'type' AND b.o = 'nation'", "star")
def match_disconnected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match(star_graph(spark, sf_dir), [("?x", "type", "region"), ("?y", "type", "nation")]).select("x", "y")


@query("match_typed", f"WITH RECURSIVE {TY} SELECT q.s AS o, q.o AS p FROM quads q JOIN (SELECT DISTINCT c FROM ty WHERE sup = 'product') k ON k.c = q.o WHERE q.t = 'contain'", "star")
def match_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    quads = star_graph(spark, sf_dir)
    return match(quads, [("?o", "contain", "?p")], types(quads), {"p": "product"}).select("o", "p")


@query("match_subpredicate", "SELECT s AS c, o FROM quads WHERE t IN ('place', 'buy')", "star")
def match_subpredicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    quads = star_graph(spark, sf_dir)
    return edge_rows(quads, ("?c", "buy", "?o"), types(quads)).select("c", "o")


@query("attr_subset", """
WITH a AS (SELECT DISTINCT s AS c, t FROM quads WHERE s LIKE 'c:%'), need AS (SELECT 'place' AS t UNION ALL SELECT 'prefer')
SELECT c FROM a JOIN need USING (t) GROUP BY c HAVING count(*) = 2""", "star")
def attr_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = star_graph(spark, sf_dir).where("s LIKE 'c:%'").select(F.col("s").alias("c"), F.col("t").alias("a")).distinct()
    return retrieve.having_all(have, ["place", "prefer"])


@query("match_numeric", "SELECT concat('o:', l_orderkey) AS o, concat('p:', p_partkey) AS p, p_size AS num FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size > 10 AND p_size <= 20")
def match_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = _read(spark, sf_dir, "part").select(F.concat(F.lit("p:"), "p_partkey").alias("p"), F.col("p_size").alias("num"))
    found = match(star_graph(spark, sf_dir), [("?o", "contain", "?p", "?line")])
    return found.join(retrieve.quantities(sizes, gt=10, le=20), "p").select("o", "p", "num")


@query("kb_query", f"WITH RECURSIVE {TY}, k AS (SELECT a.s AS c, b.o AS r FROM quads a JOIN quads b ON b.s = a.o AND b.t = 'part_of' WHERE a.t = 'in' AND a.s IN (SELECT c FROM ty WHERE sup = 'party')), m AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY c) AS n FROM k) SELECT c, r FROM m WHERE n <= 3", "star")
def kb_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    quads = star_graph(spark, sf_dir)
    found = match(quads, [("?c", "in", "?n"), ("?n", "part_of", "?r")], types(quads), {"c": "party"})
    return retrieve.first_of_each(found, ["r"], ["c"], 3).select("c", "r")


@query("pull_by_query", "SELECT q.s, q.t, q.o FROM quads q WHERE q.t = 'type' AND q.s IN (SELECT s FROM quads WHERE t = 'supply' AND o IN (SELECT o FROM quads WHERE t = 'prefer'))", "star")
def pull_by_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    quads = star_graph(spark, sf_dir)
    found = match(quads, [("?s", "supply", "?p"), ("?c", "prefer", "?p")]).select("s").distinct()
    return quads.where("t = 'type'").join(found, "s", "left_semi").select("s", "t", "o")


@query("pull_pairs", """
WITH k AS (SELECT concat('s:', s_suppkey) AS s FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 20), e AS (SELECT q.s, q.o FROM quads q JOIN k ON k.s = q.s WHERE q.t = 'supply')
SELECT a.s AS a, b.s AS b, CAST(count(*) AS BIGINT) AS shared FROM e a JOIN e b ON a.o = b.o AND a.s < b.s GROUP BY a.s, b.s""", "star")
def pull_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.shared_neighbours(_supplied(spark, sf_dir)).groupBy("a", "b").agg(F.count("*").alias("shared"))


def _supplied(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = _read(spark, sf_dir, "supplier").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(20).select(F.concat(F.lit("s:"), "s_suppkey").alias("s"))
    return star_graph(spark, sf_dir, "supply").join(F.broadcast(top), "s", "left_semi").select(F.col("s").alias("c"), F.col("o").alias("node"))


@query("pull_budget", """
WITH k AS (SELECT concat('s:', s_suppkey) AS s FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 20), e AS (SELECT q.s, q.o FROM quads q JOIN k ON k.s = q.s WHERE q.t = 'supply'),
g AS (SELECT o AS node, CAST(count(*) AS BIGINT) AS n FROM e GROUP BY o), r AS (SELECT node, n, sum(n) OVER (ORDER BY n DESC, node ROWS UNBOUNDED PRECEDING) AS total FROM g)
SELECT node, n FROM r WHERE total <= 100""", "star")
def pull_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.within_budget(_supplied(spark, sf_dir).groupBy("node").agg(F.count("*").alias("n")), 100)


@query("pull_knowledge", """
WITH k AS (SELECT concat('s:', s_suppkey) AS c, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS r FROM supplier QUALIFY r <= 20), e AS (SELECT k.c, k.r, q.o AS node FROM quads q JOIN k ON k.c = q.s WHERE q.t = 'supply'),
z AS (SELECT s AS node, pid FROM quads WHERE s LIKE 'p:%' UNION SELECT o, pid FROM quads WHERE t = 'expr'), n AS (SELECT node, CAST(count(*) AS BIGINT) AS n FROM z GROUP BY node),
i AS (SELECT a.c AS a, a.r AS ra, b.c AS b, b.r AS rb, node, n FROM e a JOIN e b USING (node) JOIN n USING (node) WHERE a.r < b.r UNION ALL SELECT c, r, NULL, NULL, node, n FROM e JOIN n USING (node)),
t AS (SELECT *, sum(n) OVER (ORDER BY b IS NULL, ra, rb, node ROWS UNBOUNDED PRECEDING) AS total FROM i) SELECT a, b, node, n FROM t WHERE total <= 100""", "star")
def pull_knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts around the twenty suppliers with most money, with their types and names, 100 facts at most."""
    quads = star_graph(spark, sf_dir)
    order = Window.orderBy(F.desc("s_acctbal"), "s_suppkey")
    top = _read(spark, sf_dir, "supplier").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(20).select(F.concat(F.lit("s:"), "s_suppkey").alias("c"), F.row_number().over(order).alias("rank"))
    near = quads.where("t = 'supply'").select(F.col("s").alias("c"), F.col("o").alias("node"))
    facts = quads.where("s LIKE 'p:%'").select(F.col("s").alias("node"), "pid").union(quads.where("t = 'expr'").select("o", "pid"))
    return retrieve.pull(top, near, facts, 100)


@query("khop", """
WITH e AS (SELECT s AS a, o AS b FROM quads WHERE t IN ('part_of', 'in') UNION SELECT o, s FROM quads WHERE t IN ('part_of', 'in')),
one AS (SELECT DISTINCT b AS node FROM e WHERE a = 'r:0' AND b <> 'r:0'), two AS (SELECT DISTINCT e.b AS node FROM e JOIN one ON one.node = e.a WHERE e.b <> 'r:0' AND e.b NOT IN (SELECT node FROM one))
SELECT node, 1 AS hop FROM one UNION ALL SELECT node, 2 FROM two""", "star")
def khop(spark: SparkSession, sf_dir: str) -> DataFrame:
    quads = star_graph(spark, sf_dir)
    edges = quads.where("t IN ('part_of', 'in')").select(F.col("s").alias("src"), F.col("o").alias("dst"))
    return reach(quads.where("s = 'r:0'").select(F.col("s").alias("c")).distinct(), edges, 2).where("hop > 0").select("node", "hop")


_HOPS = "SELECT x.b AS node, max(x.w) AS w FROM x JOIN {0} h ON h.node = x.a WHERE {1} GROUP BY x.b"


@query("khop_limits", f"""
WITH e AS (SELECT s AS a, o AS b FROM quads WHERE t IN ('part_of', 'in', 'place') UNION SELECT o, s FROM quads WHERE t IN ('part_of', 'in', 'place')),
sal AS (SELECT concat('c:', c_custkey) AS c, least(1.0, greatest(0.0, CAST(c_acctbal AS DOUBLE) / 10000)) AS v FROM customer UNION ALL SELECT concat('o:', o_orderkey), CASE WHEN o_orderstatus = 'O' THEN 1.0 ELSE 0.5 END FROM orders),
k AS (SELECT a, b, coalesce(v, 0.0) AS w, row_number() OVER (PARTITION BY a ORDER BY coalesce(v, 0.0) DESC, b) AS k FROM e LEFT JOIN sal ON c = b), x AS MATERIALIZED (SELECT a, b, w FROM k WHERE k <= 20),
h0 AS (SELECT 'r:0' AS node), h1 AS MATERIALIZED ({_HOPS.format("h0", "x.b <> 'r:0'")}), h2 AS MATERIALIZED ({_HOPS.format("h1", "x.b <> 'r:0' AND x.b NOT IN (SELECT node FROM h1)")}),
h3 AS ({_HOPS.format("h2", "x.b <> 'r:0' AND x.b NOT IN (SELECT node FROM h1) AND x.b NOT IN (SELECT node FROM h2)")})
SELECT node, hop, w AS weight FROM (SELECT node, 1 AS hop, w FROM h1 UNION ALL SELECT node, 2, w FROM h2 UNION ALL SELECT node, 3, w FROM h3) ORDER BY hop, w DESC, node LIMIT 300""", "star")
def khop_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three hops around a region, at most twenty ways on from each node, the most salient first, and 300 nodes in all."""
    quads = star_graph(spark, sf_dir, "part_of", "in", "place")
    both = quads.select(F.col("s").alias("src"), F.col("o").alias("dst")).union(quads.select("o", "s"))
    weight = star_salience(spark, sf_dir).where("c NOT LIKE 'p:%'").select(F.col("c").alias("dst"), F.col("salience").alias("weight"))
    edges = both.join(weight, "dst", "left").select("src", "dst", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    return retrieve.within_reach(quads.where("o = 'r:0'").select(F.col("o").alias("c")), edges, 3, 20, 300)


@query("subsumption", """
WITH p AS (SELECT DISTINCT l_orderkey AS c, l_partkey AS x FROM lineitem), n AS (SELECT c, count(*) AS n FROM p GROUP BY c)
SELECT concat('o:', a.c) AS a, concat('o:', b.c) AS b FROM p a JOIN p b ON a.x = b.x AND a.c <> b.c JOIN n ON n.c = a.c GROUP BY a.c, b.c, n.n HAVING count(*) = n.n""", "star")
def subsumption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose parts are all in another order."""
    sets = star_graph(spark, sf_dir, "contain").select(F.col("s").alias("c"), F.col("o").alias("x")).distinct()
    return retrieve.subsets(sets)


@query("maximal_sets", """
WITH p AS (SELECT DISTINCT concat('o:', l_orderkey) AS c, concat('p:', l_partkey) AS x FROM lineitem), n AS (SELECT c, count(*) AS n FROM p GROUP BY c),
inside AS (SELECT a.c AS a, b.c AS b FROM p a JOIN p b ON a.x = b.x AND a.c <> b.c JOIN n ON n.c = a.c JOIN n m ON m.c = b.c GROUP BY a.c, b.c, n.n, m.n HAVING count(*) = n.n AND (m.n > n.n OR b.c < a.c))
SELECT c FROM n WHERE c NOT IN (SELECT a FROM inside)""")
def maximal_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem")
    sets = li.select(F.concat(F.lit("o:"), "l_orderkey").alias("c"), F.concat(F.lit("p:"), "l_partkey").alias("x")).distinct()
    return retrieve.maximal(sets)


@query("ref_candidates", f"WITH RECURSIVE {TY} SELECT q.s AS ref, q.o AS match FROM quads q WHERE q.t = 'prefer' AND q.s <> q.o AND NOT EXISTS (SELECT 1 FROM ty WHERE ty.c = q.s AND ty.sup = q.o) AND q.o NOT IN (SELECT o FROM quads WHERE t = 'type')", "star")
def ref_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    quads = star_graph(spark, sf_dir, "prefer", "type")
    pairs = quads.where("t = 'prefer'").select(F.col("s").alias("ref"), F.col("o").alias("match"))
    return retrieve.reference_candidates(pairs, types(quads), quads)


@query("cluster_pairs", "SELECT concat('n:', a.s_nationkey) AS cluster, concat('s:', a.s_suppkey) AS a, concat('s:', b.s_suppkey) AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
def cluster_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _read(spark, sf_dir, "supplier").select(F.concat(F.lit("n:"), "s_nationkey").alias("cluster"), F.col("s_suppkey").alias("k"), F.concat(F.lit("s:"), "s_suppkey").alias("a"))
    other = s.select("cluster", F.col("k").alias("k2"), F.col("a").alias("b"))
    return s.join(other, "cluster").where("k < k2").select("cluster", "a", "b")


@query("topk_pullers", """
WITH f AS (SELECT concat('n:', c_nationkey) AS n, concat('c:', c_custkey) AS c, least(1.0, greatest(0.0, c_acctbal / 10000)) AS salience FROM customer),
r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY salience DESC, c) AS k FROM f) SELECT n, c, round(salience, 6) AS salience FROM r WHERE k <= 3""")
def topk_pullers(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = star_graph(spark, sf_dir, "in").where("t = 'in' AND s LIKE 'c:%'").select(F.col("s").alias("c"), F.col("o").alias("n"))
    rows = where.join(star_salience(spark, sf_dir), "c")
    return retrieve.first_of_each(rows, ["n"], [F.desc("salience"), "c"], 3).select("n", "c", F.round("salience", 6).alias("salience"))
