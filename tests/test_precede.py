"""Phrases that stand before others in a turn: all pairs, near or far, of first and later places."""

import os

import pytest

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def told(spark, tmp_path_factory):
    """One turn in which phrases stand far apart and again; the dictionary has those of five texts or more."""
    d = str(tmp_path_factory.mktemp("told"))
    known = ["red fox", "old dog", "big cat"]
    spark.createDataFrame([(i, p) for i, p in enumerate(known * 5)], "item_id long, text string").coalesce(1).write.parquet(os.path.join(d, "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, text string").write.parquet(os.path.join(d, "documents.parquet"))
    spark.createDataFrame([(1, 0, "a red fox met in the long cold night an old dog and a red fox")], "conv_id long, turn int, text string").write.parquet(os.path.join(d, "conversations.parquet"))
    return d


def test_pairs_far_apart_and_of_later_places(spark, told):
    got = {tuple(r) for r in entry.queries()["precede"](spark, told).select("key", "a", "b").collect()}
    assert got == {("1_0", "red fox", "old dog"), ("1_0", "old dog", "red fox")}


def test_all_pairs_of_the_hits(spark, sf):
    places = {}
    for r in entry.queries()["gazetteer"](spark, sf).collect():
        places.setdefault(r.key, []).append((r.start, r.phrase))
    wanted = sorted({(k, a, b) for k, at in places.items() for i, a in at for j, b in at if a != b and i <= j})
    assert sorted(tuple(r) for r in entry.queries()["precede"](spark, sf).select("key", "a", "b").collect()) == wanted
    assert wanted
