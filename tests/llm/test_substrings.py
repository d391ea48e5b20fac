"""Removal of repeated strings against a plain search."""

import numpy as np
import pytest

from quadloom.llm import substrings


def brute(rows, length):
    """rows: (id, text), unique; gives (id, bytes kept, runs)."""
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if b[p : p + length] in seen:
                gone[p : p + length] = True
            seen.add(b[p : p + length])
        runs = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]]))).reshape(-1, 2)
        out[i] = (bytes(np.frombuffer(b, np.uint8)[~gone]), [(int(a), int(z - a)) for a, z in runs])
    return out


def texts(seed, n=120):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdefé \n"), 6)) for _ in range(400)]
    make = lambda k: " ".join(rng.choice(words, k))
    passages = [make(30) for _ in range(6)]
    line = make(10)[:53]
    out = []
    for i in range(n):
        t = make(int(rng.integers(1, 90)))
        for _ in range(int(rng.integers(0, 3))):
            p = passages[int(rng.integers(0, 6))]
            a = int(rng.integers(0, 60))
            t = t[:80] + p[a : a + int(rng.integers(90, 150))] + t[80:]
        if i % 3 == 0:
            t = line + "\n" + t
        if i % 10 == 9:
            t = out[i - 5] + "!" * (i % 20)
        out.append(t)
    out += ["x" * 500, "y" * 99, "y" * 100, "ab" * 300, "", None, "z" * 100, "z" * 101, make(3000)]
    return out


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("flush", [substrings.FLUSH, 50])
def test_against_plain_search(spark, seed, flush):
    rows = [(int(i), t) for i, t in zip(np.random.default_rng(seed).permutation(1000), texts(seed), strict=False)]
    df = spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], "doc_id long, text string, doc string, lo string").repartition(5)
    got = {r.doc_id: (bytes(r.kept), [(x.start, x.length) for x in r.removed]) for r in substrings.remove_repeats(df, flush=flush).collect()}
    assert got == brute(rows, 100)


def test_repeated_rows_and_null_ids(spark):
    long = "abcdefghij" * 3 + "klmnopqrst" * 9
    rows = [(5, long), (5, long), (7, long), (None, None), (None, "x"), (5, "other " + long)]
    out = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == len(rows)
    kept = sorted((r.doc_id or -1, r.n_bytes, len(r.kept)) for r in out)
    assert sum(k for _, n, k in kept if n in (120, 126)) == 126  # whichever of the rows with one id comes first
    assert (7, 120, 0) in kept and (-1, 0, 0) in kept and (-1, 1, 1) in kept


def test_empty(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
