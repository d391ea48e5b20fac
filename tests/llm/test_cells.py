"""Cells of blocks and chunks are shuffled: what an exploded table grows to isn't told by its file, so it must not be broadcast."""

import re

import numpy as np
import pytest
from pyspark.sql import DataFrame

from quadloom.llm import negatives, topk


@pytest.fixture()
def joins(spark, monkeypatch):
    """The uppermost join of each table that goes to Python, once its cells are made."""
    seen, kind = [], type(spark.range(0))
    real = kind.mapInArrow

    def told(self: DataFrame, *a, **k):
        if {"flat", "ids"} <= set(self.columns) and ({"q_flat"} & set(self.columns) or {"a_flat"} & set(self.columns)):
            seen.append(re.search(r"\w+Join", self._jdf.queryExecution().executedPlan().toString())[0])
        return real(self, *a, **k)

    monkeypatch.setattr(kind, "mapInArrow", told)
    return seen


def vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6)], i % 3) for i in range(200)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_search(spark, joins):
    assert topk.search_embeddings(vectors(spark), 3, 10).count() == 60
    assert len(joins) == 4 and set(joins) == {"SortMergeJoin"}


def test_negatives(spark, joins):
    assert negatives.mine(vectors(spark), 10).count() > 0
    assert len(joins) == 4 and set(joins) == {"SortMergeJoin"}
