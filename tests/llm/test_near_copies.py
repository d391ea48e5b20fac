"""The pipeline's near-duplicate stage on planted near copies, against plain Python."""

import random

import numpy as np
import pytest

from quadloom.llm import near_copies, pipeline


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def alike(a, b):
    return not (a or b) or len(a & b) / len(a | b) >= 0.8


def kept_by(texts):
    """Ids that stay: the smallest of each connected group of the pairs at 0.8 or more."""
    sets = {i: shingles(t or "") for i, t in texts.items()}
    label = {i: i for i in texts}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a in texts:
        for b in texts:
            if a < b and alike(sets[a], sets[b]):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {root(i) for i in texts}


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    phrase = rng.sample(words, 30)
    out, planted = {}, {}
    for _ in range(40):
        base = rng.choices(words, k=rng.randint(60, 400)) + (phrase if rng.random() < 0.5 else [])
        want = rng.choice([0.75, 0.79, 0.8, 0.82, 0.85, 0.9, 0.95, 0.99])
        copy = list(base)
        while True:
            trial = list(copy)
            trial[rng.randrange(len(trial))] = rng.choice(words)
            a, b = shingles(" ".join(base)), shingles(" ".join(trial))
            if len(a & b) / len(a | b) < want:
                break
            copy = trial
        i = len(out)
        out[i], out[i + 1] = " ".join(base), " ".join(copy)
        planted[i + 1] = len(shingles(out[i]) & shingles(out[i + 1])) / len(shingles(out[i]) | shingles(out[i + 1]))
    hot = rng.choices(words, k=120)
    for _ in range(60):  # a chain and a crowd: each is a changed copy of an earlier one
        copy = out[rng.randrange(80, len(out))].split() if len(out) > 80 else list(hot)
        copy[rng.randrange(len(copy))] = rng.choice(words)
        out[len(out)] = " ".join(copy)
    for t in (None, "", " ", "one two", "One  two", "a b c d e", "a b c d e f", " ".join(phrase), out[3], out[3].upper()):
        out[len(out)] = t
    assert sum(0.8 <= x < 1 for x in planted.values()) > 20
    return out


def test_planted_near_copies_go(spark, texts):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    kept = pipeline.simhash_near_dedup(spark, docs, "")
    assert kept.columns == docs.columns
    got = [r.doc_id for r in kept.collect()]
    assert len(got) == len(set(got))
    assert set(got) == kept_by(texts)


def test_the_order_of_shingles_changes_nothing(spark, texts, monkeypatch):
    common = np.unique(np.concatenate([near_copies.shingle_set((t or "").encode()) for t in list(texts.values())[::2]]))
    monkeypatch.setattr(near_copies, "common_shingles", lambda _: (common, np.random.default_rng(1).permutation(len(common)) + 1))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in pipeline.simhash_near_dedup(spark, docs, "").collect()} == kept_by(texts)


def test_repeated_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (1, "a b c d e f g"), (None, "q r s"), (2, "z")], "doc_id long, text string")
    kept = near_copies.drop_near_copies(docs).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == [(0, "q r s"), (1, "a b c d e f g"), (2, "z")]
    assert near_copies.drop_near_copies(docs.limit(0)).count() == 0
