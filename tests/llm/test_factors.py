"""Removal of repeated word windows against a plain search."""

import numpy as np
import pytest

from quadloom.llm import factors


def brute(rows, length):
    """rows: (id, text), unique; gives (id, words, words kept, runs)."""
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        words = (t or "").encode().split()
        gone = np.zeros(len(words), bool)
        for p in range(len(words) - length + 1):
            window = tuple(words[p : p + length])
            if window in seen:
                gone[p : p + length] = True
            seen.add(window)
        runs = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]]))).reshape(-1, 2)
        out[i] = (len(words), b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode(), [(int(a), int(z - a)) for a, z in runs])
    return out


def texts(seed, n=90):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdé"), int(rng.integers(1, 5)))) for _ in range(300)]
    make = lambda k: " ".join(rng.choice(words, k))
    passages = [make(60).split() for _ in range(5)]
    out = []
    for i in range(n):
        t = make(int(rng.integers(1, 120))).split()
        for _ in range(int(rng.integers(0, 3))):
            a = int(rng.integers(0, 30))
            t[10:10] = passages[int(rng.integers(0, 5))][a : a + int(rng.integers(15, 40))]
        if i % 3 == 0:  # one passage between other words, in a third of all texts
            t[5:5] = passages[0]
        out.append("\n".join(out[i - 4].split()) + " end" * (i % 5) if i % 10 == 9 else " ".join(t))
    loop = " ".join(["to", "be"] * 40)
    return [*out, loop, "x " * 19, "x " * 20, "x " * 21, "x " * 500, "", None, " \t\n ", "a b " * 15, make(4000)]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("flush,crowd", [(factors.FLUSH, factors.CROWD), (40, 3), (40, 0)])
def test_against_plain_search(spark, seed, flush, crowd):
    rows = [(int(i), t) for i, t in zip(np.random.default_rng(seed).permutation(1000), texts(seed), strict=False)]
    df = spark.createDataFrame([(i, t, "clash", "clash", 1) for i, t in rows], "doc_id long, text string, doc string, words string, h int").repartition(5)
    got = {r.doc_id: (r.n_words, r.kept, [(x.start, x.length) for x in r.removed]) for r in factors.remove_repeated_windows(df, flush=flush, crowd=crowd).collect()}
    assert got == brute(rows, 20)


def test_parse_checks_windows_over_the_end_of_a_factor():
    w = [b"%d" % i for i in range(60)]
    pieces = [(1, 0, w[:30]), (2, 0, [*w[20:30], *w[40:55]]), (3, 0, [*w[5:30], *w[40:55]]), (4, 7, w[30:40])]
    assert factors.parse(pieces, 20) == [(3, 0, 5), (3, 15, 5)]
    assert factors.parse(pieces, 12) == [(3, 0, 13), (3, 15, 13)]
    assert factors.parse([(1, 0, w[:20]), (2, 5, w[:20])], 20) == [(2, 5, 0)]


def test_repeated_rows_and_null_ids(spark):
    long = " ".join(f"w{i}" for i in range(30))
    rows = [(5, long), (5, long), (7, long), (None, None), (None, "x"), (5, "other " + long)]
    out = factors.remove_repeated_windows(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    kept = sorted((r.doc_id or -1, r.n_words, len(r.kept.split())) for r in out)
    assert len(out) == len(rows) and (7, 30, 0) in kept and (-1, 0, 0) in kept and (-1, 1, 1) in kept
    assert sum(k for _, n, k in kept if n > 1) in (31, 61)  # whichever of the rows with one id comes first, with its copies
    assert factors.remove_repeated_windows(spark.createDataFrame([], "doc_id long, text string")).count() == 0
