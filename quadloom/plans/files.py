"""Reading and writing graphs as files, over graphs of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.plans.registry import query
from quadloom.sources import documents as doc
from quadloom.sources.graphs import event_graph, star_graph

_read = lambda spark, d, n: spark.read.parquet(f"{d}/{n}.parquet")


@query("src_files", "SELECT CAST(sum(len(pid) + len(s) + len(o) + 11) AS BIGINT) AS n_chars, CAST(count(*) AS BIGINT) AS n_facts FROM quads WHERE t = 'place'", "star")
def src_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The star graph's place facts written as text files, and listed again."""
    path = doc.scratch(spark, "text")
    doc.fact_lines(star_graph(spark, sf_dir, "place")).write.text(path)
    files = doc.read_files(spark, path, "*.txt")
    return files.agg(F.sum(F.length("text")).alias("n_chars"), F.sum(F.size(F.split("text", ";")) - 1).alias("n_facts"))


@query("src_kg_blocks", "SELECT s, t, o, pid FROM quads WHERE t IN ('place', 'urgent')", "star")
def src_kg_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = doc.scratch(spark, "text")
    facts = star_graph(spark, sf_dir, "place", "urgent")
    doc.fact_lines(facts.withColumn("pid", F.translate("pid", "|", "!"))).write.text(path)
    return doc.facts_in(doc.read_files(spark, path)).select("s", "t", "o", F.translate("pid", "!", "|").alias("pid"))


@query("roundtrip_json", "SELECT graph_id, s, t, o, pid FROM acts", "events")
def roundtrip_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = doc.scratch(spark, "json")
    doc.to_json(event_graph(spark, sf_dir)).write.text(path)
    return doc.from_json(spark.read.text(path))


@query("sink_json", "SELECT graph_id, CAST(count(*) AS BIGINT) AS n FROM acts GROUP BY graph_id", "events")
def sink_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = doc.scratch(spark, "json")
    doc.to_json(event_graph(spark, sf_dir)).write.text(path)
    return doc.from_json(spark.read.text(path)).groupBy("graph_id").agg(F.count("*").alias("n"))


@query("incremental_diff", "SELECT concat('doc/', doc_id) AS path, CASE WHEN doc_id % 3 = 0 THEN 'new' WHEN doc_id % 3 = 1 AND doc_id % 2 = 0 THEN 'stale' ELSE 'unchanged' END AS state FROM documents")
def incremental_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _read(spark, sf_dir, "documents").select(F.concat(F.lit("doc/"), "doc_id").alias("path"), F.col("doc_id").alias("modified"), "doc_id")
    cached = d.where("doc_id % 3 <> 0").select("path", F.when((F.col("doc_id") % 3 == 1) & (F.col("doc_id") % 2 == 0), F.col("modified") - 1).otherwise(F.col("modified")).alias("modified"))
    return doc.new_or_stale(d.select("path", "modified"), cached)
