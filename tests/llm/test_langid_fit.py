"""The classifier's fit against a dense version, its temperature against a search, and odd texts."""

import numpy as np

from quadloom.llm import langid


def samples(n=60, seed=2):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        lang = "abc"[i % 3]
        base = {"a": [1, 2, 3], "b": [3, 4, 5], "c": [6, 7, 1]}[lang]
        ids = np.unique(np.concatenate([rng.choice(base, 2), rng.integers(0, 12, 2)]))
        out.append((ids, rng.integers(1, 5, len(ids)), lang))
    return out


def dense(rows, seed=11):
    """The same updates on whole matrices."""
    n_features = langid.FEATURES
    langs = sorted({x[2] for x in rows})
    order = np.random.default_rng(seed).permutation(len(rows))
    train = [rows[i] for k, i in enumerate(order) if k % langid.CALIBRATION]
    held = [rows[i] for i in order[:: langid.CALIBRATION]]
    df = np.zeros(n_features)
    for ids, _, _ in train:
        df[ids] += 1
    idf = np.log((1 + len(train)) / (1 + df)) + 1
    z, n = np.zeros((n_features + 1, len(langs))), np.zeros((n_features + 1, len(langs)))
    l1 = np.full((n_features + 1, 1), langid.L1)
    l1[-1] = 0
    weights = lambda: np.where(np.abs(z) <= l1, 0, -(z - np.sign(z) * l1) / ((langid.BETA + np.sqrt(n)) / langid.ALPHA + langid.L2))

    def row(ids, counts):
        x = np.zeros(n_features + 1)
        x[ids] = np.log1p(counts) * idf[ids]
        x /= np.linalg.norm(x)
        x[-1] = 1
        return x

    rng = np.random.default_rng(seed)
    for _ in range(langid.EPOCHS):
        for k in rng.permutation(len(train)):
            ids, counts, lang = train[k]
            x, w = row(ids, counts), weights()
            p = langid.softmax(x @ w)
            p[langs.index(lang)] -= 1
            g = np.outer(x, p)
            z += g - (np.sqrt(n + g * g) - np.sqrt(n)) / langid.ALPHA * w
            n += g * g
    return weights(), held, langs, row


def test_fit_is_the_dense_fit():
    rows = samples()
    model = langid.fit(rows)
    w, held, langs, row = dense(rows)
    assert np.allclose(model["w"], w[:-1], atol=1e-6) and np.allclose(model["b"], w[-1])
    assert 0 < (model["w"] != 0).any(axis=1).sum() <= 12  # features that never occur have no weight
    z = np.array([row(i, c) @ w for i, c, _ in held])
    y = np.array([langs.index(x[2]) for x in held])
    loss = lambda t: -np.log(langid.softmax(z / t)[np.arange(len(y)), y]).mean()
    assert loss(model["t"]) <= min(map(loss, np.geomspace(0.06, 9, 1000))) + 1e-3


def test_signs_that_are_no_letters(spark):
    rows = [(i, t, la) for i, (t, la) in enumerate([("the cat and the dog", "en"), ("le chat et la souris", "fr")] * 8)]
    rows += [(50, "½ ² ①", None), (51, "Ⅷ 12", None), (52, "½ x", None), (None, "the cat", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert got[50].lang_pred == got[51].lang_pred == "und" and got[50].score == 0
    assert got[52].lang_pred in ("en", "fr") and got[None].lang_pred == "en" and not got[None].held_out
    kept = {r.doc_id for r in langid.keep_identified(docs, 0.0).collect()}
    assert kept == {r.doc_id for r in docs.collect()} - {50, 51}


def test_the_sample_is_bounded_and_repeats_count_once(spark):
    rows = [(i % 400, f"text {i % 400}", "a") for i in range(800)] + [(i, "same", "b") for i in range(3)] + [(1, "x", None), (2, None, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    first = sorted((r.lang, r.text) for r in langid.bounded_sample(docs, 20).collect())
    assert len([x for x in first if x[0] == "a"]) <= 20 and len([x for x in first if x[0] == "b"]) == 3
    assert len(set(x for x in first if x[0] == "a")) == len([x for x in first if x[0] == "a"]) > 5
    assert first == sorted((r.lang, r.text) for r in langid.bounded_sample(docs.repartition(3), 20).collect())
