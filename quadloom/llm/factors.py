"""Removal of repeated word windows by relative Lempel-Ziv parsing.

Every window has an anchor, the few words in it with the smallest hash, and equal windows have equal anchors. So a document
is cut into pieces, runs of windows that share an anchor, and only needs to be parsed against the reference blocks that hold its
anchors; blocks are ranges of anchor hashes. A block holds each distinct piece once, at its first place. A copy of an
earlier piece is one factor from end to end; any other piece whose anchor the block also has with other words around it is
parsed greedily, word by word, against what stands earlier in the block.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.llm.common import slices, table, text_bytes, utf8_buffer
from quadloom.llm.quality import BYTE, SPACE, mixed, powers, spans_hash
from quadloom.llm.sharding import gapless_slots
from quadloom.llm.substrings import BUCKETS, COVERED, FLUSH, WANTED, _compared, _Gather, _ids_are_keys
from quadloom.sources.staging import small, staged

WORDS, GRAM = 20, 8
#: Pieces of one anchor that a block parses; those of a more frequent anchor are compared window by window, spread by window.
CROWD = 5_000
#: Sets the second hash of a window apart from the first.
SECOND = np.uint64(0xD6E8FEB86659FD93)


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of the texts data[at[i]:at[i + 1]], and the n + 1 offsets of the texts in words."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    space = SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    start = np.flatnonzero(~space & (edge[:-1] | np.concatenate([[True], space[:-1]])))
    end = np.flatnonzero(~space & (edge[1:] | np.concatenate([space[1:], [True]]))) + 1
    return spans_hash(BYTE[data], start, end), np.searchsorted(start, at, "left")


def pieces(words: np.ndarray, at: np.ndarray, length: int = WORDS, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of windows that share an anchor: text number, first window, number of further windows, hash of the anchor and of all words.

    words: hashes of the words of all texts in a row; at: offsets of the texts. Windows count from the text's first word.
    """
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    starts = len(words) - length + 1
    if starts <= 0:
        return none
    up, down = powers(len(words))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(words * up[: len(words)], dtype=np.uint64)])
    grams = mixed((sums[gram:] - sums[:-gram]) * down[: len(words) - gram + 1])
    # the smallest hash of the grams in a window, of equal ones the first: its upper half, then its place
    low = grams & np.uint64(0xFFFFFFFF00000000) | np.arange(len(grams), dtype=np.uint64)
    width, step = length - gram + 1, 1
    while 2 * step <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    low = np.minimum(low[:starts], low[width - step : width - step + starts])
    anchor = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    doc = np.searchsorted(at, np.arange(starts), "right") - 1
    whole = np.arange(starts) + length <= at[doc + 1]
    change = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | ~whole[:-1]])
    lo = np.flatnonzero(whole & change)
    hi = np.flatnonzero(whole & np.concatenate([change[1:] | ~whole[1:], [True]]))
    if not len(lo):
        return none
    m = anchor[lo]
    words_of = mixed((sums[hi + length] - sums[lo]) * down[lo]) + mixed(((hi - lo) << 8 | m - lo).astype(np.uint64))
    return doc[lo], lo - at[doc[lo]], hi - lo, grams[m], mixed(words_of)


def parse(found: list[tuple[int, int, list[bytes]]], length: int = WORDS) -> list[tuple[int, int, int]]:
    """(doc, lo, n): windows lo to lo + n that also start earlier, of pieces (doc, first word, words) in order of place.

    Each piece is factored greedily against the pieces before it: at a word, the window there is looked up in the index and the
    match is followed to its end. Factors shorter than a window count as literals. A window that crosses the end
    of a factor may stand elsewhere in the reference, so those are looked up one by one. Then the piece's own new
    windows are added to the index.
    """
    index: dict[tuple[bytes, ...], tuple[list[bytes], int]] = {}
    out = []
    for doc, lo, words in found:
        last, i, flags = len(words) - length, 0, []
        while i <= last:
            at = index.get(tuple(words[i : i + length]))
            if at is None:
                flags.append(False)
                i += 1
                continue
            reference, j = at
            n = length
            while i + n < len(words) and j + n < len(reference) and words[i + n] == reference[j + n]:
                n += 1
            flags += [True] * (n - length + 1)
            i += n - length + 1  # on to the windows that cross the factor's end
        run = None
        for k, again in enumerate([*flags, False]):
            if again and run is None:
                run = k
            elif not again and run is not None:
                out.append((doc, lo + run, k - 1 - run))
                run = None
        for k, again in enumerate(flags):
            if not again:
                index[tuple(words[k : k + length])] = words, k
    return out


def repeated_windows(texts: DataFrame, length: int = WORDS, gram: int = GRAM, flush: int = FLUSH, crowd: int = CROWD) -> DataFrame:
    """(doc, lo, n): windows lo to lo + n of `length` words that also start earlier, in texts (doc unique, >= 0; text).

    Earlier: in a smaller doc, or in the same doc at a smaller place. First the hashes of anchors and pieces find copies of
    pieces, and the pieces whose anchor stands among other words too; only these are sent to the blocks with their words. A
    task holds the pieces of one anchor, at most `crowd`; those of more frequent anchors go by the hash of each window.
    """
    n_tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = BUCKETS * n_tasks

    def find(batches):
        gather = _Gather(buckets, False, flush)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            data, at = utf8_buffer(batch.column(1))
            for lo, hi in slices(at, 1 << 22):
                words, cuts = word_hashes(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
                doc, start, n, h, c = pieces(words, cuts, length, gram)
                yield from gather.add(h, c, ids[lo + doc], start, n)
        yield from gather.close()

    def cut(batches):
        for batch in batches:
            ids, wanted = batch.column(0).to_numpy(), batch.column(2)
            bounds, spans = wanted.offsets.to_numpy(), wanted.values
            los, ns = spans.field("lo").to_numpy().astype(np.int64), spans.field("n").to_numpy().astype(np.int64)
            out = [], [], [], []
            for i, text in enumerate(text_bytes(batch.column(1))):
                words = text.split()
                hashes, cuts = word_hashes(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
                _, start, _, h, _ = pieces(hashes, cuts, length, gram)
                mine = slice(bounds[i], bounds[i + 1])
                anchor = h[np.searchsorted(start, los[mine], "right") - 1].view(np.int64)
                for x, lo, n in zip(anchor.tolist(), los[mine].tolist(), ns[mine].tolist(), strict=True):
                    for y, z in zip(out, (x, int(ids[i]), lo, b" ".join(words[lo : lo + n + length])), strict=True):
                        y.append(z)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["h", "doc", "lo", "words"])

    def factor(batches):
        at, found, out = None, [], []

        def made():
            rows = pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32()))], names=["doc", "lo", "n"])
            out.clear()
            return rows

        for batch in batches:
            for h, doc, lo, words in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if h != at:
                    out += parse(found, length)
                    at, found = h, []
                found.append((doc, lo, words.split()))
            yield made()
        out += parse(found, length)
        yield made()

    def each_window(batches):
        gather = _Gather(buckets, True, flush)
        for batch in batches:
            data, at = utf8_buffer(pa.array(batch.column("words").to_pylist(), pa.binary()).cast(pa.large_binary()).view(pa.large_string()))
            ids, los = batch.column("doc").to_numpy(), batch.column("lo").to_numpy().astype(np.int64)
            words, cuts = word_hashes(data, at)
            up, down = powers(len(words))
            first = np.concatenate([np.arange(a, b - length + 1) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
            hashes = []
            for values in (words, mixed(words + SECOND)):
                sums = np.concatenate([[np.uint64(0)], np.cumsum(values * up[: len(values)], dtype=np.uint64)])
                hashes.append(mixed((sums[first + length] - sums[first]) * down[first]))
            doc = np.searchsorted(cuts, first, "right") - 1
            yield from gather.add(*hashes, ids[doc], los[doc] + first - cuts[doc], np.zeros(len(first), np.int64))
        yield from gather.close()

    sent = "kind int, bucket int, blob binary"
    marks = staged(_compared(texts.mapInArrow(find, sent), buckets, False))
    wanted = marks.where(F.col("kind") == WANTED).groupBy("doc").agg(F.collect_list(F.struct("lo", "n")).alias("w"))
    parts = staged(texts.join(wanted, "doc").select("doc", "text", "w").mapInArrow(cut, "h long, doc long, lo int, words binary"))
    crowded = staged(parts.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd).select("h"))
    crowded = small(crowded)
    blocks = parts.join(crowded, "h", "left_anti").select("h", "doc", "lo", "words").repartition(n_tasks, "h").sortWithinPartitions("h", "doc", "lo")
    factored = blocks.mapInArrow(factor, "doc long, lo int, n int")
    alone = _compared(parts.join(crowded, "h", "left_semi").select("doc", "lo", "words").mapInArrow(each_window, sent), buckets, True)
    covered = marks.where(F.col("kind") == COVERED).select("doc", "lo", "n")
    return covered.union(staged(factored)).union(staged(alone.where(F.col("kind") == COVERED).select("doc", "lo", "n")))


def remove_repeated_windows(docs: DataFrame, length: int = WORDS, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", flush: int = FLUSH, crowd: int = CROWD) -> DataFrame:
    """id, n_words, kept (string: the words left, joined by one space), removed (array of struct<start, length>, in words, maximal runs) of every row.

    Every word in a window of `length` words that also starts earlier is removed, judged on the input. Null and empty texts have no
    words; very long ones are taken whole. Rows that repeat an id and text are one document and get the same result; rows that
    share an id with another text are ordered by a hash of the text; null ids come first. Other columns are not read. An empty table
    gives an empty result.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    if _ids_are_keys(rows.select("_id")):
        rows = rows.select(F.col("_id").cast("long").alias("doc"), "text", "_id")
        texts = rows
    else:
        rows = rows.withColumn("_h", F.xxhash64("text"))
        keys = gapless_slots(rows.select("_id", "_h", F.lit(0).alias("_one")).distinct(), "_one", ["_id", "_h"], "doc")
        match = rows["_id"].eqNullSafe(keys["_id"]) & (rows["_h"] == keys["_h"])
        rows = staged(rows.join(keys, match).select(keys["doc"], rows["text"], rows["_id"]))
        texts = staged(rows.groupBy("doc").agg(F.first("text").alias("text")))
    spans = repeated_windows(texts.select("doc", "text"), length, gram, flush, crowd).groupBy("doc").agg(F.collect_list(F.struct("lo", "n")).alias("s"))

    def leave(batches):
        for batch in batches:
            lists = batch.column(1).fill_null([]) if batch.column(1).null_count else batch.column(1)
            cuts = lists.offsets.to_numpy()
            los, ns = (lists.values.field(k).to_numpy().astype(np.int64) for k in ("lo", "n"))
            sizes, kept, removed = [], [], []
            for i, text in enumerate(text_bytes(batch.column(0))):
                words = text.split()
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, los[cuts[i] : cuts[i + 1]], 1)
                np.add.at(edge, los[cuts[i] : cuts[i + 1]] + ns[cuts[i] : cuts[i + 1]] + length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                turn = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                sizes.append(len(words))
                kept.append(b" ".join(compress(words, (~gone).tolist()) if len(turn) else words))
                removed.append([{"start": int(a), "length": int(b - a)} for a, b in turn.reshape(-1, 2)])
            runs = pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), runs], names=["_id", "n_words", "kept", "removed"])

    joined = rows.join(spans, "doc", "left").select("text", "s", "_id")
    out = joined.mapInArrow(leave, f"_id {dict(joined.dtypes)['_id']}, n_words long, kept string, removed array<struct<start: long, length: long>>")
    return out.withColumnRenamed("_id", id_col)


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_windows(table(spark, sf_dir, "documents"))
    total = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["length"])
    return out.select("doc_id", "n_words", total.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


OP13_SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
w AS MATERIALIZED (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM d),
g AS (
  SELECT doc_id, i, word, string_agg(word, ' ') OVER n AS win, count(*) OVER n AS k FROM w
  WINDOW n AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {WORDS - 1} FOLLOWING)
), r AS (
  SELECT doc_id, i, word, k = {WORDS} AND row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1 AS again FROM g
), c AS (
  SELECT doc_id, i, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {WORDS - 1} PRECEDING AND CURRENT ROW) AS gone FROM r
), o AS (
  SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS g, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_words, CAST(coalesce(g, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN o ON o.doc_id = d.doc_id
"""
