"""The star graph as a view: nothing is stored for kinds that don't need it, and lines with twins keep their numbers."""

import glob

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quadloom.operators import reference
from quadloom.sources import graphs
from quadloom.sources.staging import shared_dir


@pytest.mark.parametrize("name", ["auto_expr", "salience_matvec", "predicates_by_st"])
def test_nothing_stored(spark, sf, name):
    graphs.forget()
    stored = lambda: set(glob.glob(shared_dir(spark).removeprefix("file://") + "/*"))
    before = stored()
    assert not entry.queries()[name](spark, sf).isEmpty()
    assert stored() == before


@pytest.mark.parametrize("few", [100, 0])
def test_twins(spark, sf, tmp_path, monkeypatch, few):
    monkeypatch.setattr(graphs, "FEW", few)
    li = spark.read.parquet(f"{sf}/lineitem.parquet").limit(50).localCheckpoint()
    twins = li.limit(5).withColumn("l_discount", F.col("l_discount") + 1).withColumn("l_returnflag", F.lit("R"))
    li.union(twins).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = graphs.star_lines(spark, str(tmp_path))
    want = graphs.derived(spark, str(tmp_path), graphs.LINES.strip(), "li").select("id", "nth", "l_discount", "l_returnflag")
    rows = lambda df: sorted(map(tuple, df.select(want.columns).collect()))
    assert rows(found) == rows(want)
    assert found.where("nth = 2").count() == 5
    if few:
        assert not any("lines-" in f for f in found.inputFiles())


def test_rules_are_sent(spark):
    """Two rules would put all mentions into two tasks."""
    m = spark.createDataFrame([("g", "m1", "a", "f", True)], "graph_id string, mention string, rule string, focus string, asserted boolean")
    facts = spark.createDataFrame([("g", "m1", "p", "t", "o")], "graph_id string, mention string, pid string, t string, o string")
    rules = spark.createDataFrame([("a", False, True, "focus")], "rule string, with_object boolean, with_focus boolean, target string")
    out = reference.mention_links(m, facts, rules)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(rule" not in plan
    assert out.count() == 4
