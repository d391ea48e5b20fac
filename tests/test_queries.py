"""Registered queries against their DuckDB SQL on the smallest tables."""

import math

import pytest

import __spark_entry__ as entry
from quadloom.sources.graphs import TABLES

QUICK = """has_bulk by_pid degree predicates_by_st undefined_concepts match_path2 match_triangle match_reified match_disconnected type_closure
components infer_conf infer_negated chain_2 remove_cascade merge_groups merge_congruence assign_ids salience_1 conf_or gazetteer longest_match
best_candidate fill_template attention bounded_memory roundtrip_json src_kg_blocks render_flat khop pull_budget
semi_edges anti_edges pull_by_query candidate_score chain_marks rules_chain rules_bulk rules_assembled rules_roundtrip resolve_refs resolve_all khop_limits marked_sections expression_dict expression_hits mention_instances spanning_forest ingest_parse match_parse rule_cover compose_kinds spoken_updates contractions after_speak""".split()


@pytest.fixture(scope="module")
def duck(sf):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else float(f"{v:.9g}") if isinstance(v, float) else v


def rows(names, found):
    order = sorted(names)
    return sorted((tuple(plain(r[names.index(c)]) for c in order) for r in found), key=repr)


@pytest.mark.parametrize("name", QUICK)
def test_query(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    answer = duck.execute(entry.oracle_sql()[name])
    names = [x[0] for x in answer.description]
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert sorted(df.columns) == sorted(names)
    assert got == rows(names, answer.fetchall())
    assert got


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 120


def test_entry(spark):
    assert entry.entry(spark).count() == 6
