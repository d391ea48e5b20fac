"""A store for rules: one table of pattern edges and one of conditions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quadloom.operators.infer import Rule
from quadloom.sources.staging import shared_dir

EDGES = "rule string, side string, nth int, s string, t string, o string, pid string"
CONDITIONS = "rule string, kind string, var string, value string"


def write_rules(spark: SparkSession, rules: list[Rule], path: str | None = None) -> str:
    """Write rules as Parquet under path (by default in the shared folder) and return it."""
    path = path or f"{shared_dir(spark)}/quadloom-rules-{uuid.uuid4().hex}"
    edges = [(r.name, side, i, *e, *[None] * (4 - len(e))) for r in rules for side in ("pre", "post") for i, e in enumerate(getattr(r, side))]
    conditions = [(r.name, kind, k, v) for r in rules for kind in ("confidence", "var_types") for k, v in getattr(r, kind).items()]
    spark.createDataFrame(edges, EDGES).coalesce(1).write.mode("overwrite").parquet(f"{path}/edges")
    spark.createDataFrame(conditions, CONDITIONS).coalesce(1).write.mode("overwrite").parquet(f"{path}/conditions")
    return path


def write_edges(edges: DataFrame, path: str | None = None) -> str:
    """Write a table of pattern edges (EDGES), however many, to a store without conditions, and return its path."""
    spark = edges.sparkSession
    path = path or f"{shared_dir(spark)}/quadloom-rules-{uuid.uuid4().hex}"
    edges.select("rule", "side", "nth", "s", "t", "o", "pid").write.mode("overwrite").parquet(f"{path}/edges")
    spark.createDataFrame([], CONDITIONS).write.mode("overwrite").parquet(f"{path}/conditions")
    return path


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EDGES).parquet(f"{path}/edges")


def read_rules(spark: SparkSession, path: str) -> list[Rule]:
    """The rules of a store, by name; rules are program text, so they are few."""
    edges = sorted(spark.read.parquet(f"{path}/edges").collect(), key=lambda r: (r.rule, r.side, r.nth))
    conditions = spark.read.parquet(f"{path}/conditions").collect()
    side = lambda n, k: [(r.s, r.t, r.o, r.pid) if r.pid else (r.s, r.t, r.o) for r in edges if (r.rule, r.side) == (n, k)]
    held = lambda n, k: {c["var"]: c.value for c in conditions if (c.rule, c.kind) == (n, k)}
    return [Rule(n, side(n, "pre"), side(n, "post"), held(n, "confidence"), held(n, "var_types")) for n in dict.fromkeys(r.rule for r in edges)]
