"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quadloom.llm import byte_bpe, centroids, factors, langid, negatives, packing, pii, pipeline, quality, sharding, simhash, substrings, token_counts, topk


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = [
        token_counts.op1_token_counts,
        topk.op2_topk,
        byte_bpe.op3_byte_bpe,
        langid.op4_langid,
        packing.op5_packing,
        quality.op6_quality,
        simhash.op7_simhash,
        sharding.op8_sharding,
        substrings.op9_suffix_dedup,
        pii.op10_pii,
        centroids.op11_centroids,
        negatives.op12_hard_negatives,
        factors.op13_substring_dedup,
    ]
    return {f.__name__: f for f in ops} | {"pipeline": pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op2_topk": topk.OP2_SQL, "op11_centroids": centroids.OP11_SQL, "op12_hard_negatives": negatives.OP12_SQL, "op13_substring_dedup": factors.OP13_SQL}
