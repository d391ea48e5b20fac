"""Connected components of an undirected edge table."""

from __future__ import annotations

from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.operators.closure import bounded
from quadloom.sources.staging import staged


#: Edges that are so few are handled in one task, which bounds its memory; more are spread.
GATHERED = 100_000


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int | None = None) -> DataFrame:
    """(node, component): each node that has an edge to another, with the smallest node it reaches.

    Alternates large stars (a node's larger neighbours move to its smallest neighbour) and small stars (its smaller
    ones do) until the edges are stars around the smallest nodes; rounds grow with the logarithm of the size, and
    the edges never grow in number. Each round is written to the shared folder. Null ends and loops are dropped.
    Goes on until the edges are stars; more than max_rounds is an error. Where at most GATHERED edges are left, one task ends
    the work without further rounds.
    """
    a, b = F.col(f"`{src}`"), F.col(f"`{dst}`")
    now = staged(edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    last = None
    for n in count():
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sign == last or sign[0] == 0:
            break
        bounded(n, max_rounds)
        last = sign
        if sign[0] <= GATHERED:
            now = staged(_stars(now))
            break
        now = staged(_round(now))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())


def _round(now: DataFrame) -> DataFrame:
    """A large and a small star over edges (u, v), u > v. The smallest neighbours are aggregated apart, so that a hot node's edges needn't meet."""
    both = now.union(now.select("v", "u"))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    return large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low).distinct()


def _order(x):
    """A value's place in Spark's order: nulls first, structs field by field."""
    return (0,) if x is None else (1, *map(_order, x.values())) if isinstance(x, dict) else (1, x)


def _stars(now: DataFrame) -> DataFrame:
    """The stars of few edges (u, v), found in one task."""

    def run(batches):
        above, node, kinds = {}, {}, None

        def top(k):
            while above[k] != k:
                above[k] = k = above[above[k]]
            return k

        for batch in batches:
            kinds = batch.schema
            for u, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ends = [_order(u), _order(v)]
                for k, x in zip(ends, (u, v), strict=True):
                    node.setdefault(k, x)
                    above.setdefault(k, k)
                low, high = sorted(map(top, ends))
                above[high] = low
        if kinds is not None:
            far = [k for k in node if top(k) != k]
            ends = ([node[k] for k in far], [node[top(k)] for k in far])
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(ends, kinds, strict=True)], schema=kinds)

    return now.coalesce(1).mapInArrow(run, now.schema)
