"""The flagship query: typed pattern matching with confidence over the star graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.operators.closure import types
from quadloom.operators.match import match
from quadloom.sources.graphs import star_graph
from quadloom.sources.staging import staged


def segment_products(spark: SparkSession, sf_dir: str, segment: str = "seg:BUILDING") -> DataFrame:
    """Unmarked place and contain facts of a segment's customers, counted for each product type."""
    quads = star_graph(spark, sf_dir)
    of = staged(types(quads.where("t = 'type'")))
    found = match(quads, [("?c", "place", "?o"), ("?o", "contain", "?p", "?line")], of, {"c": segment, "p": "product"}, confident=["line"])
    kinds = quads.where("t = 'type'").select(F.col("s").alias("p"), F.col("o").alias("product_type"))
    return found.join(kinds, "p").groupBy("product_type").agg(F.count("*").alias("n_matches"))
