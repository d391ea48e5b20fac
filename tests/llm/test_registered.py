"""The registered queries: names, columns, and SQL where there is any."""

import duckdb
import pytest

from quadloom.llm import queries

COLUMNS = {
    "op1_token_counts": ["doc_id", "n_pretokens", "n_tokens", "score"],
    "op2_topk": ["query_id", "rank", "vec_id", "score"],
    "op3_byte_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op4_langid": ["doc_id", "held_out", "lang_pred", "score"],
    "op5_packing": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op6_quality": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op7_simhash": ["doc_id", "fingerprint", "component_id"],
    "op8_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op9_suffix_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op10_pii": ["doc_id", "text", "n_entities"],
    "op11_centroids": ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
    "op12_hard_negatives": ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"],
    "op13_substring_dedup": ["doc_id", "n_words", "n_removed", "kept_sha256"],
}


def test_names():
    assert set(queries.queries()) == {*COLUMNS, "pipeline"}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, sf, name):
    df = queries.queries()[name](spark, sf)
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    answer = c.execute(queries.oracle_sql()[name])
    assert df.columns == [x[0] for x in answer.description] == COLUMNS[name]
    assert sorted(map(tuple, df.collect())) == sorted(answer.fetchall())


def test_columns(spark, sf):
    for name in ("op1_token_counts", "op3_byte_bpe", "op6_quality"):
        assert queries.queries()[name](spark, sf).columns[: len(COLUMNS[name])] == COLUMNS[name]
