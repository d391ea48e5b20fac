"""Sharding by jump consistent hashing, with gapless slots in every shard."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadloom.llm.common import only, table, unsigned_crc32
from quadloom.sources.staging import staged

LAW = "key"
SHARDS = 8


def jump_hash(keys: np.ndarray, n_shards: int) -> np.ndarray:
    """Shard in [0, n_shards) of each 64-bit key: Lamping and Veach's walk over the shard counts at which a key moves.

    No table is kept; with one more shard, a key either stays or moves to the new shard.
    """
    key = np.asarray(keys).astype(np.uint64)
    at = np.zeros(len(key), np.int64)
    live, jump = np.arange(len(key)), np.zeros(len(key), np.int64)
    with np.errstate(over="ignore"):
        while len(live):
            at[live] = jump[live]
            key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
            step = (1 << 31) / ((key[live] >> np.uint64(33)).astype(np.float64) + 1.0)
            jump[live] = ((at[live] + 1) * step).astype(np.int64)
            live = live[jump[live] < n_shards]
    return at


def jump_shard(key: Column, n_shards: int) -> Column:
    """Column form of jump_hash over a 64-bit key; null keys must be replaced before."""

    @F.pandas_udf("int")
    def shard(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy().view(np.uint64), n_shards).astype(np.int32))

    return shard(key)


def gapless_slots(df: DataFrame, shard: str, order: list[str], slot: str = "slot") -> DataFrame:
    """Add `slot`, numbering the rows of each shard 0, 1, 2, ... by `order`, ties in any order.

    A shard may hold any share of all rows, so none is gathered in a task: rows are range-partitioned by shard
    and order, numbered within their partition, and shifted by the counts of earlier partitions (at most one
    row for each pair of a partition and a shard).
    """
    keys = [F.col(shard), *(F.col(x).asc_nulls_first() for x in order)]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    numbered = staged(ranged.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")))
    parts = numbered.groupBy(shard, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(shard).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select(shard, "_part", (before - F.col("_first")).alias("_shift"))
    out = numbered.join(starts, [shard, "_part"]).withColumn(slot, F.col("_at") + F.col("_shift"))
    return out.select(*df.columns, slot)


def shard_documents(docs: DataFrame, n_shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of docs in a shard that its id and the shard count alone decide.

    Returns id, size (UTF-8 bytes + 1), text_crc32, law, shard, slot and grown_shard (with n_shards + 1 shards).
    Null texts count as empty (size 1, crc 0). Rows with a null id share one fixed key, repeated ids share a
    shard; both keep all their rows and get slots of their own. An empty table gives an empty result. Other
    columns are not read.
    """
    key = F.xxhash64(F.coalesce(F.col("_id").cast("string"), F.lit("")))
    base = only(docs, id_col, text_col).toDF("_id", "_text").select(
        F.col("_id").alias(id_col),
        (F.coalesce(F.octet_length("_text"), F.lit(0)) + 1).cast("long").alias("size"),
        unsigned_crc32(F.col("_text")).alias("text_crc32"),
        F.lit(LAW).alias("law"),
        jump_shard(key, n_shards).alias("shard"),
        jump_shard(key, n_shards + 1).alias("grown_shard"),
    )
    return gapless_slots(staged(base), "shard", [id_col, "text_crc32", "size"])


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
