"""Changes of the star graph: adding, renaming, removing, merging, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.operators import mutate
from quadloom.plans.registry import query
from quadloom.sources.graphs import star_graph

_read = lambda spark, d, n: spark.read.parquet(f"{d}/{n}.parquet")


@query("add_quads", "SELECT t, CAST(count(*) AS BIGINT) AS n FROM (SELECT t FROM quads UNION ALL SELECT 'in' FROM supplier) GROUP BY t", "star")
def add_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    quads = star_graph(spark, sf_dir)
    old = quads.where("t = 'in'")
    new = old.where("s LIKE 's:%'").withColumn("pid", F.concat(F.lit("again:"), "s"))
    return mutate.add(quads, old.union(new).union(new)).groupBy("t").agg(F.count("*").alias("n"))


@query("concat_graphs", """
WITH o AS (SELECT CASE WHEN s LIKE 'o:%' THEN concat('x_', s) ELSE s END AS s, t, CASE WHEN o LIKE 'o:%' THEN concat('x_', o) ELSE o END AS o, CASE WHEN pid LIKE 'po:%' THEN concat('x_', pid) ELSE pid END AS pid FROM quads WHERE t IN ('place', 'in'))
SELECT s, t, o, pid FROM quads WHERE t IN ('in', 'part_of') UNION ALL SELECT s, t, o, pid FROM o WHERE pid NOT IN (SELECT pid FROM quads WHERE t IN ('in', 'part_of'))""", "star")
def concat_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    quads = star_graph(spark, sf_dir)
    one, two = quads.where("t IN ('in', 'part_of')"), quads.where("t IN ('place', 'in', 'urgent')")
    return mutate.concatenated(one, two, "x_", lambda c: c.rlike("^p?o:"), ("urgent",)).select("s", "t", "o", "pid")


@query("assign_ids", "SELECT item, concat('id_', row_number() OVER (ORDER BY item) + 3) AS id FROM (SELECT DISTINCT s AS item FROM quads WHERE t = 'supply')", "star")
def assign_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutate.fresh_ids(star_graph(spark, sf_dir, "supply").select(F.col("s").alias("item")), "id_", 4)


@query("copy_ns", "SELECT concat('k_', s) AS s, t, concat('k_', o) AS o, concat('k_', pid) AS pid FROM quads WHERE t = 'supply'", "star")
def copy_ns(spark: SparkSession, sf_dir: str) -> DataFrame:
    quads = star_graph(spark, sf_dir, "supply")
    return mutate.concatenated(quads.limit(0), quads, "k_", lambda c: F.lit(True)).select("s", "t", "o", "pid")


@query("remove_cascade", """
WITH gone AS (SELECT concat('o:', o_orderkey) AS o FROM orders WHERE o_orderstatus = 'P'), g1 AS (SELECT pid FROM quads WHERE s IN (SELECT o FROM gone) OR o IN (SELECT o FROM gone)),
g2 AS (SELECT pid FROM g1 UNION SELECT q.pid FROM quads q JOIN g1 ON q.s = g1.pid) SELECT t, CAST(count(*) AS BIGINT) AS n FROM quads WHERE pid NOT IN (SELECT pid FROM g2) GROUP BY t""", "star")
def remove_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = _read(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.lit("g1").alias("graph_id"), F.concat(F.lit("o:"), "o_orderkey").alias("c"))
    return mutate.remove(star_graph(spark, sf_dir), gone).groupBy("t").agg(F.count("*").alias("n"))


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive customers of a nation and segment."""
    from pyspark.sql import Window

    c = _read(spark, sf_dir, "customer")
    before = F.lag("c_custkey").over(Window.partitionBy("c_nationkey", "c_mktsegment").orderBy("c_custkey"))
    pairs = c.withColumn("p", before).where("p IS NOT NULL")
    return pairs.select(F.concat(F.lit("c:"), "c_custkey").alias("a"), F.concat(F.lit("c:"), "p").alias("b"))


_REP = "rep AS (SELECT concat('c:', c_custkey) AS old, min(concat('c:', c_custkey)) OVER (PARTITION BY c_nationkey, c_mktsegment) AS new FROM customer)"


@query("merge_groups", f"WITH {_REP} SELECT old, new FROM rep WHERE (SELECT count(*) FROM rep r WHERE r.new = rep.new) > 1")
def merge_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutate.representatives(_neighbours(spark, sf_dir))


@query("merge_simple", f"WITH {_REP} SELECT coalesce(rep.new, q.s) AS s, CAST(count(*) AS BIGINT) AS n FROM quads q LEFT JOIN rep ON rep.old = q.s WHERE q.t = 'place' GROUP BY 1", "star")
def merge_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = mutate.representatives(_neighbours(spark, sf_dir)).withColumn("graph_id", F.lit("g1"))
    return mutate.renamed(star_graph(spark, sf_dir, "place"), names, ("s",)).groupBy("s").agg(F.count("*").alias("n"))


@query("merge_congruence", f"""
WITH {_REP} SELECT coalesce(rep.new, q.s) AS s, q.t, q.o, min(q.pid) AS pid FROM quads q LEFT JOIN rep ON rep.old = q.s WHERE q.t = 'type' AND q.s LIKE 'c:%' GROUP BY 1, 2, 3
UNION ALL SELECT coalesce(rep.new, q.s), q.t, q.o, q.pid FROM quads q LEFT JOIN rep ON rep.old = q.s WHERE q.t = 'place'""", "star")
def merge_congruence(spark: SparkSession, sf_dir: str) -> DataFrame:
    quads = star_graph(spark, sf_dir, "place", "type").where("t = 'place' OR (t = 'type' AND s LIKE 'c:%')")
    return mutate.merged(quads, _neighbours(spark, sf_dir).withColumn("graph_id", F.lit("g1"))).select("s", "t", "o", "pid")


@query("merge_metalinks", f"WITH {_REP} SELECT DISTINCT coalesce(rep.new, q.s) AS src, q.o AS dst, CASE WHEN rep.new = rep.old THEN 'ref' ELSE 'rref' END AS label FROM quads q JOIN rep ON rep.old = q.s WHERE q.t = 'place'", "star")
def merge_metalinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = star_graph(spark, sf_dir, "place").select(F.col("s").alias("src"), F.col("o").alias("dst"))
    names = mutate.representatives(_neighbours(spark, sf_dir)).withColumnRenamed("old", "src")
    moved = links.join(names, "src", "left")
    return moved.select(F.coalesce("new", "src").alias("src"), "dst", F.when(F.col("new") != F.col("src"), "rref").otherwise("ref").alias("label")).distinct()


@query("support_cascade", "SELECT s, t, o FROM quads WHERE t IN ('not', 'maybe') AND s IN (SELECT id FROM li WHERE l_quantity >= 10)", "star")
def support_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks stay only while the line they rest on does; lines of small quantity go."""
    quads = star_graph(spark, sf_dir, "contain", "not", "maybe")
    from quadloom.sources.graphs import star_lines

    gone = star_lines(spark, sf_dir).where("l_quantity < 10").select(F.lit("g1").alias("graph_id"), F.col("id").alias("pid"))
    return mutate.remove(quads, pids=gone).where("t <> 'contain'").select("s", "t", "o")


@query("add_links", "SELECT concat('r:', n_regionkey) AS src, concat('n:', n_nationkey) AS dst, 'comps' AS label FROM nation")
def add_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = star_graph(spark, sf_dir, "part_of").where("t = 'part_of' AND o <> 'world'").groupBy(F.col("o").alias("src")).agg(F.collect_set("s").alias("targets"))
    return groups.select("src", F.explode("targets").alias("dst"), F.lit("comps").alias("label"))


@query("set_diff", "SELECT o FROM quads WHERE t = 'supply' EXCEPT SELECT o FROM quads WHERE t = 'prefer'", "star")
def set_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = star_graph(spark, sf_dir)
    return q.where("t = 'supply'").select("o").subtract(q.where("t = 'prefer'").select("o"))


@query("set_intersect", "SELECT o FROM quads WHERE t = 'supply' INTERSECT SELECT o FROM quads WHERE t = 'prefer'", "star")
def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = star_graph(spark, sf_dir)
    return q.where("t = 'supply'").select("o").intersect(q.where("t = 'prefer'").select("o"))


@query("distribute_args", "SELECT concat('n:', n_nationkey) AS s, t, o FROM nation, (SELECT unnest(['likes', 'knows']) AS t), (SELECT unnest(['user', 'bot']) AS o)")
def distribute_args(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of types and objects of each subject become all their facts."""
    lists = _read(spark, sf_dir, "nation").select(F.concat(F.lit("n:"), "n_nationkey").alias("s"), F.array(F.lit("likes"), F.lit("knows")).alias("ts"), F.array(F.lit("user"), F.lit("bot")).alias("os"))
    return lists.select("s", F.explode("ts").alias("t"), "os").select("s", "t", F.explode("os").alias("o"))


@query("merge_scores", """
WITH p AS (SELECT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b, l_discount AS score FROM lineitem WHERE l_partkey <> l_suppkey)
SELECT a, b, round(sum(score), 6) AS score FROM p GROUP BY a, b HAVING round(sum(score), 6) > 0.1""")
def merge_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "lineitem").where("l_partkey <> l_suppkey").select(F.least("l_partkey", "l_suppkey").alias("a"), F.greatest("l_partkey", "l_suppkey").alias("b"), "l_discount")
    return rows.groupBy("a", "b").agg(F.round(F.sum("l_discount"), 6).alias("score")).where("score > 0.1")


@query("redirect_links", "SELECT DISTINCT CASE WHEN l_linenumber > 1 THEN concat('li:', l_orderkey, '_1') ELSE concat('li:', l_orderkey, '_', l_linenumber) END AS src, concat('p:', l_partkey) AS dst FROM lineitem")
def redirect_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem")
    name = F.concat_ws("_", F.concat(F.lit("li:"), "l_orderkey"), "l_linenumber")
    inside = li.where("l_linenumber > 1").select(name.alias("src"), F.concat(F.lit("li:"), "l_orderkey", F.lit("_1")).alias("outer")).distinct()
    links = li.select(name.alias("src"), F.concat(F.lit("p:"), "l_partkey").alias("dst"))
    return links.join(inside, "src", "left").select(F.coalesce("outer", "src").alias("src"), "dst").distinct()


@query("nonassert_marks", "SELECT pid AS s, mark FROM quads, (SELECT unnest(['maybe', '_exists']) AS mark) WHERE t = 'prefer' AND s IN (SELECT concat('c:', c_custkey) FROM customer WHERE c_acctbal < 0)", "star")
def nonassert_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    unsure = _read(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.concat(F.lit("c:"), "c_custkey").alias("s"))
    facts = star_graph(spark, sf_dir, "prefer").join(unsure, "s", "left_semi")
    return facts.select(F.col("pid").alias("s"), F.explode(F.array(F.lit("maybe"), F.lit("_exists"))).alias("mark"))
