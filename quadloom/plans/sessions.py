"""Session state over the events, as batch queries: what the streams hold after all events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadloom.plans.registry import query
from quadloom.sources.graphs import event_graph
from quadloom.streaming.sessions import DECAY, MEMORY

_LAST = "x AS (SELECT graph_id, o AS concept, max(turn) AS t FROM acts GROUP BY graph_id, o), y AS (SELECT graph_id, max(turn) AS last FROM acts GROUP BY graph_id)"


@query("turn_index", "SELECT graph_id, pid, turn FROM acts", "events")
def turn_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_graph(spark, sf_dir).select("graph_id", "pid", "turn")


def current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(graph_id, concept, t, last): last mention and last turn."""
    acts = event_graph(spark, sf_dir)
    said = acts.groupBy("graph_id", F.col("o").alias("concept")).agg(F.max("turn").alias("t"))
    return said.withColumn("last", F.max("t").over(Window.partitionBy("graph_id")))


@query("attention", f"WITH {_LAST} SELECT x.graph_id, concept, round(1 - 0.1 * (last - t), 6)::DOUBLE AS attention FROM x JOIN y USING (graph_id) WHERE 1 - 0.1 * (last - t) > 0", "events")
def attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = F.round(1 - F.lit(DECAY) * (F.col("last") - F.col("t")), 6)
    return current(spark, sf_dir).select("graph_id", "concept", left.alias("attention")).where("attention > 0")


@query("decay", f"WITH {_LAST} SELECT x.graph_id, concept, CAST(greatest(0, round(1 - 0.1 * (last - t), 6)) AS DOUBLE) AS salience FROM x JOIN y USING (graph_id)", "events")
def decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quadloom.operators.salience import decayed

    return current(spark, sf_dir).select("graph_id", "concept", F.round(decayed(F.lit(1.0), F.col("last") - F.col("t")), 6).alias("salience"))


@query("retention", "SELECT graph_id, pid FROM (SELECT *, max(turn) OVER (PARTITION BY graph_id) AS last FROM acts) WHERE turn > last - 5", "events")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    acts = event_graph(spark, sf_dir)
    return acts.withColumn("last", F.max("turn").over(Window.partitionBy("graph_id"))).where("turn > last - 5").select("graph_id", "pid")


@query("bounded_memory", f"WITH {_LAST} SELECT graph_id, concept FROM x QUALIFY row_number() OVER (PARTITION BY graph_id ORDER BY t DESC, concept) <= 50", "events")
def bounded_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("graph_id").orderBy(F.desc("t"), "concept"))
    return current(spark, sf_dir).withColumn("k", rank).where(F.col("k") <= MEMORY).select("graph_id", "concept")


@query("turn_sets", "SELECT graph_id, t AS kind, string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) AS turns FROM acts GROUP BY graph_id, t", "events")
def turn_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    acts = event_graph(spark, sf_dir)
    return acts.groupBy("graph_id", F.col("t").alias("kind")).agg(F.array_join(F.array_sort(F.collect_set("turn")).cast("array<string>"), ",").alias("turns"))


@query("history", "SELECT graph_id, o AS concept, min(turn) AS first FROM acts GROUP BY graph_id, o", "events")
def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_graph(spark, sf_dir).groupBy("graph_id", F.col("o").alias("concept")).agg(F.min("turn").alias("first"))


@query("asked_prev_turn", "SELECT graph_id, pid FROM (SELECT *, lag(t) OVER (PARTITION BY graph_id ORDER BY turn) AS before FROM acts) WHERE before = 'error'", "events")
def asked_prev_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("t").over(Window.partitionBy("graph_id").orderBy("turn"))
    return event_graph(spark, sf_dir).withColumn("before", before).where("before = 'error'").select("graph_id", "pid")


@query("stamp_turns", "SELECT graph_id, o AS c, CASE WHEN t IN ('error', 'view') THEN 'eturn' ELSE 'uturn' END AS kind, CAST(count(DISTINCT turn) AS BIGINT) AS n FROM acts GROUP BY 1, 2, 3", "events")
def stamp_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("t").isin("error", "view"), "eturn").otherwise("uturn")
    return event_graph(spark, sf_dir).groupBy("graph_id", F.col("o").alias("c"), kind.alias("kind")).agg(F.count_distinct("turn").alias("n"))
