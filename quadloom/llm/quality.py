"""Quality rules from repetition coverage: characters inside repeated n-grams and lines, by rolling hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.llm.common import only, slices, table, utf8_buffer

#: Largest allowed share of a text's word characters inside later copies of n-grams, by n.
COVERAGE = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Largest allowed shares of lines, and of characters in lines, that are copies of earlier lines.
LINES, LINE_CHARS = 0.30, 0.20
MIN_WORDS, REPEAT_WINDOW, MAX_REPEAT_PERCENT = 50, 3, 50

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_rng = np.random.default_rng(20240607)
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """BASE ** i and BASE ** -i modulo 2 ** 64, for i up to n."""
    if len(_powers[0]) <= n:
        m = 1 << int(n).bit_length()
        for k, b in enumerate((BASE, INVERSE)):
            _powers[k] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(m, b)]), dtype=np.uint64)
    return _powers


def spans_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Rolling polynomial hash, modulo 2 ** 64, of values[start:end] for each pair, from one pass of prefix sums."""
    up, down = powers(len(values))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(values * up[: len(values)], dtype=np.uint64)])
    return mixed((sums[end] - sums[start]) * down[start])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ x >> np.uint64(32)


def repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key occurs twice or more, and whether it occurred before."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    later, any_ = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:]] = same
    any_[order[1:]] = same
    any_[order[:-1]] |= same
    return any_, later


def covered(windows: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n words lie in one of the windows that start at the given words."""
    edge = np.zeros(n + 1, np.int64)
    edge[windows] += 1
    edge[windows + width] -= 1
    return np.cumsum(edge[:n]) > 0


def measures(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """All counts of the texts data[at[i]:at[i + 1]]."""
    n = len(at) - 1
    total = lambda flag: np.diff(np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])[at])
    space = SPACE[data]
    first, filled = np.zeros(len(data), bool), at[:-1][at[1:] > at[:-1]]
    first[filled] = True
    start = ~space & np.concatenate([[True], space[:-1]])[: len(data)] | ~space & first
    last = np.zeros(len(data), bool)
    last[at[1:][at[1:] > at[:-1]] - 1] = True
    end = ~space & (np.concatenate([space[1:], [True]])[: len(data)] | last)
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    doc = np.searchsorted(at, s, "right") - 1
    point = (data & 0xC0) != 0x80
    points = np.concatenate([[0], np.cumsum(point, dtype=np.int64)])
    chars = points[e] - points[s]
    per_doc = lambda w=None: np.bincount(doc, w, n).astype(np.int64)
    out = {"n_words": per_doc(), "word_chars": per_doc(chars), "n_symbols": total(SYMBOL[data])}

    values = BYTE[data]
    newline = np.flatnonzero(data == 10)
    line_start = np.sort(np.concatenate([at[:-1], newline + 1]), kind="stable")
    line_end = np.sort(np.concatenate([at[1:], newline]), kind="stable")
    starts_before = np.concatenate([[0], np.cumsum(start, dtype=np.int64)])
    worded = starts_before[line_end] > starts_before[line_start]
    line_start, line_end = line_start[worded], line_end[worded]
    line_doc = np.searchsorted(at, line_start, "right") - 1
    salt = lambda d: mixed(d.astype(np.uint64) + np.uint64(1))
    again = repeats(spans_hash(values, line_start, line_end) + salt(line_doc))[1]
    by_line = lambda w: np.bincount(line_doc, w, n).astype(np.int64)
    out |= {"n_lines": by_line(None), "n_dup_lines": by_line(again), "line_chars": by_line(points[line_end] - points[line_start]), "dup_line_chars": by_line((points[line_end] - points[line_start]) * again)}

    word = spans_hash(values, s, e)

    def windows(width: int, word: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i = np.arange(max(0, len(word) - width + 1))
        i = i[doc[i] == doc[i + width - 1]]
        return i, *repeats(spans_hash(word, i, i + width) + salt(doc[i]))

    i, twice, _ = windows(REPEAT_WINDOW, word, doc)
    out["n_repeat_words"] = per_doc(covered(i[twice], REPEAT_WINDOW, len(word)))
    for width in sorted(COVERAGE):  # a longer n-gram repeats only where a shorter one does
        i, _, later = windows(width, word, doc)
        out[f"dup_chars_{width}"] = np.bincount(doc, chars * covered(i[later], width, len(word)), n).astype(np.int64)
        keep = (out[f"dup_chars_{width}"] > 0)[doc]
        word, doc, chars = word[keep], doc[keep], chars[keep]
    return out


COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "line_chars", "dup_line_chars", "n_repeat_words", *[f"dup_chars_{n}" for n in COVERAGE]]


def repetition_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and the counts of every whole text, row for row; a null or blank text counts 0 throughout.

    Repeated rows and null ids are kept, an empty table stays empty, other columns are not read. Hashes have
    64 bits and include the document, so two different spans are taken for one with a chance below 1e-9 a
    document of a million words. A task holds about 1 MB of text, or one text, at a time; nothing is shuffled.
    """

    def run(batches):
        for batch in batches:
            data, at = utf8_buffer(batch.column(1))
            for lo, hi in slices(at, 1 << 20):
                got = measures(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(pa.array(got[c]) for c in COUNTS)], names=[id_col, *COUNTS])

    source = only(docs, id_col, text_col)
    return source.mapInArrow(run, f"`{id_col}` {source.dtypes[0][1]}, " + ", ".join(f"{c} long" for c in COUNTS))


def judged(counts: DataFrame) -> DataFrame:
    """Add base_failed and kept to repetition_counts: kept texts pass the base rules and stay within every coverage."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    fine = (F.col("n_dup_lines") <= LINES * F.col("n_lines")) & (F.col("dup_line_chars") <= LINE_CHARS * F.col("line_chars"))
    for n, most in COVERAGE.items():
        fine = fine & (F.col(f"dup_chars_{n}") <= most * F.col("word_chars"))
    return counts.withColumn("base_failed", failed).withColumn("kept", ~failed & fine)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    out = judged(repetition_counts(table(spark, sf_dir, "documents")))
    return out.select(*first, *[c for c in out.columns if c not in first])
