"""Exact top-k inner product search by a three-phase uniform threshold."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadloom.llm.common import only, table
from quadloom.sources.staging import staged

K, QUERY_STEP, SCALE = 10, 100, 1024
#: A score is the sum of so many local scores, each over its own range of components.
LISTS = 2
#: Vectors and queries in a cell of the grid that one row of work holds.
CHUNK, BLOCK = 4096, 512


def integer_vector(vector: Column) -> Column:
    """floor(SCALE * x) of each component; null where the vector, or a component, is null or not finite.

    Components beyond 2 ** 62 after scaling count as that bound.
    """
    limit = float(1 << 62)
    fine = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    scaled = F.transform(vector, lambda x: F.floor(F.greatest(F.least(x.cast("double") * SCALE, F.lit(limit)), F.lit(-limit))))
    return F.when(fine, scaled)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact a @ b.T of integers, as int64: in floats where every sum stays under 2 ** 53, else in wider numbers."""
    top = max(1, a.shape[1]) * max(1, int(np.abs(a).max(initial=0))) * max(1, int(np.abs(b).max(initial=0)))
    if top < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if top < 1 << 63:
        return a @ b.T
    wide = a.astype(object) @ b.astype(object).T
    return np.clip(wide, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _packed(rows: DataFrame, n: int, width: int, lists: int) -> DataFrame:
    """(part, list, ids, parts): vectors dealt into n parts, with the components of one list side by side."""
    each = -(-max(1, width) // lists)
    padded = F.concat("q", F.array_repeat(F.lit(0).cast("long"), F.lit(each * lists) - F.size("q")))
    ranges = F.explode(F.array(*[F.struct(F.lit(b).alias("list"), F.slice(padded, b * each + 1, each).alias("x")) for b in range(lists)]))
    cut = rows.select("cid", F.pmod(F.xxhash64("cid"), F.lit(n)).cast("int").alias("part"), ranges.alias("r"))
    packed = cut.groupBy("part", "r.list").agg(F.collect_list(F.struct("cid", "r.x")).alias("v"))
    return staged(packed.select("part", "list", F.col("v.cid").alias("ids"), F.flatten("v.x").alias("flat")))


def _scores(batches, keep):
    """Rows (qid, cid, list, s) of the pairs in each cell that keep(scores, row, qids, cids) points at."""
    for batch in batches:
        for row in range(len(batch)):
            take = lambda name: batch.column(name)[row].values.to_numpy() if batch.column(name)[row].is_valid else None  # noqa: B023, E731
            qids, cids = take("q_ids"), take("ids")
            s = products(take("q_flat").reshape(len(qids), -1), take("flat").reshape(len(cids), -1))
            i, j = keep(s, take, qids, cids)
            lists = np.full(len(i), batch.column("list")[row].as_py(), np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(qids[i]), pa.array(cids[j]), pa.array(lists), pa.array(s[i, j])], names=["qid", "cid", "list", "s"])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, lists: int = LISTS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of vectors with the largest inner product for each query.

    vectors: (vec_id, q array<long>); queries: (query_id) of ids among them. Ties go to the smaller vec_id; a query's
    own id is never a candidate; with fewer than k candidates all are returned. Shorter vectors count as
    padded with zeros. Equal vectors are searched once: a class of copies keeps its k + 1 smallest ids, which
    are all that any top k can hold, so its pairs are never spelled out.

    Phase one: every cell of the grid (list of components, block of queries, chunk of vectors) sends its k + 1 best
    local scores; their exact sums give each query a cutoff that k candidates reach. Phase two: the cutoff over
    the number of lists goes back to all cells, which send every local score reaching it; a pair below it in all
    lists can't reach the cutoff. Phase three: pairs whose upper bound still reaches the cutoff get the local
    scores they miss. The queries are a stated set that grows with the vectors; cells hold bounded numbers.
    """
    spark = vectors.sparkSession
    rows = staged(vectors.where("vec_id is not null and q is not null").distinct())
    classes = staged(rows.groupBy("q").agg(F.min("vec_id").alias("cid")))
    of = staged(rows.join(classes, "q").select("cid", "vec_id"))
    asked = of.join(queries.distinct(), F.col("vec_id") == F.col("query_id"), "left_semi").select("cid", F.col("vec_id").alias("query_id"))
    asking = staged(classes.join(asked.select("cid").distinct(), "cid", "left_semi").select("cid", "q"))
    width = classes.agg(F.max(F.size("q"))).first()[0] or 1
    n_parts, n_blocks = (-(-max(1, df.count()) // size) for df, size in ((classes, CHUNK), (asking, BLOCK)))
    chunks = _packed(classes, n_parts, width, lists)
    blocks = _packed(asking, n_blocks, width, lists).select(F.col("part").alias("block"), "list", F.col("ids").alias("q_ids"), F.col("flat").alias("q_flat"))
    part, block = (F.pmod(F.xxhash64(c), F.lit(n)).cast("int") for c, n in (("cid", n_parts), ("qid", n_blocks)))

    def cells(asked_of: DataFrame) -> DataFrame:
        """Blocks of queries, each beside the chunks that it is to meet, all where it names none.

        A chunk is shuffled once and a block once for each chunk; neither is broadcast, as what a block grows to isn't told by its file.
        """
        if "part" not in asked_of.columns:
            asked_of = asked_of.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))))
        return asked_of.join(chunks.hint("merge"), ["list", "part"])

    out = "qid long, cid long, list int, s long"

    def local_best(batches):
        def keep(s, take, qids, cids):
            n = min(k + 1, s.shape[1])
            best = np.argpartition(-s, n - 1, axis=1)[:, :n]
            return np.repeat(np.arange(len(s)), n), best.ravel()

        yield from _scores(batches, keep)

    def reaching(batches):
        def keep(s, take, qids, cids):
            floor = np.full(len(qids), np.iinfo(np.int64).min)
            if take("c_ids") is not None:
                order = np.argsort(qids)
                floor[order[np.searchsorted(qids, take("c_ids"), sorter=order)]] = take("c_floor")
            return np.nonzero((s >= floor[:, None]) & (cids[None, :] != qids[:, None]))

        yield from _scores(batches, keep)

    def asked_for(batches):
        def keep(s, take, qids, cids):
            a, b = np.argsort(qids), np.argsort(cids)
            return a[np.searchsorted(qids, take("r_q"), sorter=a)], b[np.searchsorted(cids, take("r_c"), sorter=b)]

        yield from _scores(batches, keep)

    def exact(pairs: DataFrame) -> DataFrame:
        """Sums over all lists of the pairs (qid, cid)."""
        wanted = pairs.select("qid", "cid", part.alias("part"), block.alias("block")).groupBy("block", "part").agg(F.collect_list(F.struct("qid", "cid")).alias("r"))
        wanted = wanted.select("block", "part", F.col("r.qid").alias("r_q"), F.col("r.cid").alias("r_c"))
        return cells(wanted.join(blocks, "block")).mapInArrow(asked_for, out).groupBy("qid", "cid").agg(F.sum("s").alias("score"))

    first = cells(blocks).mapInArrow(local_best, out).select("qid", "cid").where("qid <> cid").distinct()
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "cid")
    cutoff = staged(exact(first).withColumn("n", F.row_number().over(best)).where(F.col("n") == k).select("qid", F.col("score").alias("cutoff")))
    floors = cutoff.groupBy(block.alias("block")).agg(F.collect_list(F.struct("qid", F.ceil(F.col("cutoff") / lists).alias("f"))).alias("c"))
    floors = floors.select("block", F.col("c.qid").alias("c_ids"), F.col("c.f").alias("c_floor"))
    seen = cells(blocks.join(floors, "block", "left")).mapInArrow(reaching, out).groupBy("qid", "cid").agg(F.sum("s").alias("s"), F.count("*").alias("n"))
    bound = F.col("s") + (lists - F.col("n")) * (F.ceil(F.col("cutoff") / lists) - 1)
    seen = staged(seen.join(cutoff, "qid", "left").where(F.col("cutoff").isNull() | (F.col("n") == lists) | (bound >= F.col("cutoff"))))
    own = asking.select(F.col("cid").alias("qid"), "cid")
    rest = exact(seen.where(F.col("n") < lists).select("qid", "cid").union(own))
    scored = seen.where(F.col("n") == lists).select("qid", "cid", F.col("s").alias("score")).union(rest).join(cutoff, "qid", "left")
    scored = scored.where(F.col("cutoff").isNull() | (F.col("score") >= F.col("cutoff")) | (F.col("qid") == F.col("cid")))
    members = of.withColumn("n", F.row_number().over(Window.partitionBy("cid").orderBy("vec_id"))).where(F.col("n") <= k + 1).drop("n")
    each = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    found = scored.join(members, "cid").withColumn("n", F.row_number().over(each)).where(F.col("n") <= k + 1).select("qid", "vec_id", "score")
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    answers = asked.withColumnRenamed("cid", "qid").join(found, "qid").where("vec_id <> query_id")
    return answers.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_embeddings(embeddings: DataFrame, k: int = K, step: int = QUERY_STEP) -> DataFrame:
    """Top k of every row of embeddings whose id is divisible by step, against all other rows.

    Rows with a null id, or a vector that is null or holds nulls or non-finite numbers, take no part; repeated
    rows count once; other columns are not read; an empty table gives no rows.
    """
    vectors = only(embeddings, "vec_id", "embedding").select("vec_id", integer_vector(F.col("embedding")).alias("q"))
    return top_k(vectors, vectors.where(F.col("vec_id") % step == 0).where("q is not null").select(F.col("vec_id").alias("query_id")), k)


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_embeddings(table(spark, sf_dir, "embeddings"))


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
