"""Graphs in files: fact blocks as text, graphs as JSON documents, and which files are new."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.sources.staging import shared_dir

GRAPH = "graph_id string, predicates array<struct<s:string,t:string,o:string,pid:string>>"


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, text, modified) of all files under a folder, whole, by Spark's own reader."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"), F.col("_metadata.file_modification_time").alias("modified"))


def facts_in(texts: DataFrame) -> DataFrame:
    """(path, block, s, t, o, pid) of ground facts `pid/type(subject)` or `pid/type(subject,object)` in blocks that end with ';'."""
    blocks = texts.select("path", F.posexplode(F.split("text", ";")).alias("block", "body"))
    one = r"([^\s/(),;]+)/([^\s/(),;]+)\(([^(),;]+)(?:,([^(),;]+))?\)"
    found = blocks.select("path", "block", F.explode(F.regexp_extract_all("body", F.lit(one), F.lit(0))).alias("fact"))
    part = lambda i: F.regexp_extract("fact", one, i)
    return found.select("path", "block", part(3).alias("s"), part(2).alias("t"), F.when(part(4) != "", part(4)).alias("o"), part(1).alias("pid"))


def fact_lines(quads: DataFrame) -> DataFrame:
    """(value): each fact as a line that facts_in reads."""
    return quads.select(F.concat("pid", F.lit("/"), "t", F.lit("("), "s", F.coalesce(F.concat(F.lit(","), "o"), F.lit("")), F.lit(");")).alias("value"))


def to_json(quads: DataFrame) -> DataFrame:
    """(value): a JSON document for each graph; a graph is a session, so it is bounded."""
    one = F.array_sort(F.collect_list(F.struct("s", "t", "o", "pid")))
    return quads.groupBy("graph_id").agg(one.alias("predicates")).select(F.to_json(F.struct("graph_id", "predicates")).alias("value"))


def from_json(values: DataFrame) -> DataFrame:
    rows = values.select(F.from_json("value", GRAPH).alias("g")).select("g.graph_id", F.explode("g.predicates").alias("q"))
    return rows.select("graph_id", "q.s", "q.t", "q.o", "q.pid")


def new_or_stale(files: DataFrame, cached: DataFrame) -> DataFrame:
    """(path, state): files (path, modified) against a manifest (path, modified): 'unchanged', 'stale' or 'new'."""
    old = cached.select("path", F.col("modified").alias("_cached"))
    state = F.when(F.col("_cached").isNull(), "new").when(F.col("_cached") >= F.col("modified"), "unchanged").otherwise("stale")
    return files.join(old, "path", "left").select("path", state.alias("state"))


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quadloom-{name}-{uuid.uuid4().hex}"
