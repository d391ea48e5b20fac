"""Best-fit packing of tokenized documents into sequences of a fixed length.

Lengths are whole numbers up to the capacity, so the range-sorted documents and gaps fall into at most `capacity`
runs of equal size on each side. Every superstep sweeps the runs of one length over the runs of gaps, each
document length meeting its successor, the smallest gap that holds it; documents in conflict over a gap are
told apart by their rank within their length; the gaps are updated and the sweep repeats. Ranks are given,
and the supersteps' rank intervals applied to the documents, by Spark tasks over all pieces.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadloom.llm.common import PieceCache, only, slices, table, utf8_buffer, vocabulary
from quadloom.sources.staging import staged

VOCABULARY = "word_bpe_49k.json"
CAPACITY = 4096
END_ID = 1

#: Lower-case words, digits and signs as the vocabulary's pre-tokenizer cuts them, for texts below U+0180.
LATIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿĀ-ſ]+|[0-9²³¹¼-¾]|[^\sa-zªµºß-öø-ÿĀ-ſ0-9²³¹¼-¾]+")
WORD = re.compile(r"[a-zªµºß-öø-ÿĀ-ſ]+")
#: Anything else in a chunk goes to the library as it stands: other scripts, white space and controls.
OTHER = re.compile(r"[^\x21-\x7e¡-ſ]|İ|ŉ")

_encoders: dict[int, PieceCache] = {}


def chunk_encoder(raw: bytes, most: int = 400_000) -> PieceCache:
    """Ids of chunks without ASCII white space, by the tokenizers library.

    The vocabulary drops white space and never merges across it, so a text's ids are its chunks' ids in a row.
    Chunks share words: those of Latin chunks go to the library once each, many in one call.
    """
    if hash(raw) in _encoders:
        return _encoders[hash(raw)]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(raw.decode())
    tokenizer.encode_special_tokens = True
    ends = np.zeros(tokenizer.get_vocab_size(), bool)
    ends[[i for token, i in tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
    words: dict[str, bytes] = {}

    def learn(new: list[str]) -> None:
        """A letter word is one pre-token and its last id carries the word's end."""
        for lo in range(0, len(new), 4096):
            part = new[lo : lo + 4096]
            ids = np.array(tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.int32)
            stops = np.flatnonzero(ends[ids]) + 1
            if len(stops) != len(part):
                words.update((w, direct(w)) for w in part)
                continue
            blob, stops = ids.tobytes(), (stops * 4).tolist()
            words.update((w, blob[a:b]) for w, a, b in zip(part, [0, *stops], stops, strict=False))

    def direct(text: str) -> bytes:
        return np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32).tobytes()

    def many(chunks: list[bytes]) -> list[bytes]:
        if len(words) > most * 3 // 2:
            words.clear()
        texts = [c.decode() for c in chunks]
        cut = [None if len(t) > 1000 or OTHER.search(t) else LATIN.findall(t.lower()) for t in texts]
        new = {w for x in cut if x for w in x} - words.keys()
        learn([w for w in new if WORD.fullmatch(w) and len(w) < 200])
        words.update((w, direct(w)) for w in new if w not in words)
        get = words.__getitem__
        return [direct(t) if x is None else b"".join(map(get, x)) for t, x in zip(texts, cut, strict=True)]

    cache = _encoders.setdefault(hash(raw), PieceCache(many, most))
    cache.words = words
    return cache


def token_pieces(docs: DataFrame, vocabulary_path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, keep_cache: bool = True) -> DataFrame:
    """A row for each piece of each document: its ids and then end_id, cut only when longer than the capacity.

    Columns: id, piece, start, length, ids_crc32 (unsigned, of the ids as little-endian unsigned 32-bit numbers)
    and, with_ids, ids (array<int>). Null or empty texts are end_id alone; repeated rows each
    give their pieces; an empty table gives none; other columns are not read. keep_cache: whether a Python process
    keeps what it has learnt of words for its next task, or gives the memory back for other work.
    """
    raw = vocabulary(docs.sparkSession, vocabulary_path or public_tokenizers.path(VOCABULARY))

    def run(batches):
        cache = chunk_encoder(raw.value, 400_000 if keep_cache else 150_000)
        for batch in batches:
            data, at = utf8_buffer(batch.column(1))
            for lo, hi in slices(at, 4 << 20):
                flat, ends = cache.ids([data[at[i] : at[i + 1]].tobytes().split() for i in range(lo, hi)])
                n = np.diff(ends) + 1
                with_end = np.full(len(flat) + hi - lo, end_id, np.int32)
                mask = np.ones(len(with_end), bool)
                mask[np.cumsum(n) - 1] = False
                with_end[mask] = flat
                count = -(-n // capacity)
                piece = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                start = piece * capacity
                length = np.minimum(np.repeat(n, count) - start, capacity)
                offsets = np.concatenate([[0], np.cumsum(length)])
                rows = pa.array(np.repeat(np.arange(lo, hi), count))
                raw_ids, cuts = memoryview(with_end.astype("<u4", copy=False)).cast("B"), (offsets * 4).tolist()
                crc = [zlib.crc32(raw_ids[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                arrays = [batch.column(0).take(rows), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                ids = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(with_end))] if with_ids else []
                yield pa.RecordBatch.from_arrays([*arrays, *ids], names=[id_col, "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])
        if not keep_cache:
            cache.known.clear()
            cache.words.clear()
            pa.default_memory_pool().release_unused()

    source = only(docs, id_col, text_col)
    return source.mapInArrow(run, f"`{id_col}` {source.dtypes[0][1]}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def best_fit_plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Where documents go: rows (length, first rank, end rank, first sequence, documents a sequence, offset).

    counts: documents of each length, at most `capacity` numbers. A superstep takes the largest length with
    documents left, finds the successor among the gaps, and gives that run of sequences as many documents each
    as fit; if no gap holds one, new sequences open, as few as take the documents left. Runs of gaps: size ->
    list of (first sequence, number). Rows are at most a fixed multiple of the capacity, however many documents.
    """
    sizes: list[int] = []  # of gaps, ascending
    runs: dict[int, list[tuple[int, int]]] = defaultdict(list)
    plan, opened = [], 0

    def gap(size: int, first: int, n: int) -> None:
        if n and size:
            if not runs[size]:
                bisect.insort(sizes, size)
            runs[size].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            k = bisect.bisect_left(sizes, length)
            if k == len(sizes):
                size, first, n = capacity, opened, -(-left // (capacity // length))
                opened += n
            else:
                size = sizes[k]
                first, n = runs[size].pop()
                if not runs[size]:
                    sizes.pop(k)
            each = size // length
            used = min(n, -(-left // each))
            placed = min(left, used * each)
            plan.append((length, rank, rank + placed, first, each, capacity - size))
            full = placed // each
            gap(size - each * length, first, full)
            if placed % each:
                gap(size - placed % each * length, first + full, 1)
            gap(size, first + used, n - used)
            rank, left = rank + placed, left - placed
    return np.array(plan, np.int64).reshape(-1, 6)


def ranked(pieces: DataFrame, by: str) -> DataFrame:
    """Add `rank`: a number from 0 for each row among those of equal `by`, without gathering them.

    Rows are numbered within their partition, then shifted by the counts of earlier partitions (one row for
    each pair of a partition and a length). pieces must be a stored table.
    """

    def number(batches):
        seen: dict[int, int] = defaultdict(int)
        for batch in batches:
            values = batch.column(by).to_numpy(zero_copy_only=False)
            order = np.argsort(values, kind="stable")
            kinds, first, n = np.unique(values[order], return_index=True, return_counts=True)
            own = np.arange(len(values)) - np.repeat(first, n) + np.repeat([seen[int(k)] for k in kinds], n).astype(np.int64)
            for k, m in zip(kinds.tolist(), n.tolist(), strict=True):
                seen[k] += m
            out = np.empty(len(values), np.int64)
            out[order] = own
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "_own"])

    schema = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes)
    rows = staged(pieces.withColumn("_part", F.spark_partition_id()).mapInArrow(number, f"{schema}, _part int, _own long"))
    counts = rows.groupBy("_part", by).agg(F.count("*").alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    shifts = counts.select("_part", by, F.coalesce(earlier, F.lit(0)).alias("_shift"))
    return rows.join(shifts, ["_part", by]).withColumn("rank", F.col("_own") + F.col("_shift")).drop("_part", "_own", "_shift")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to stored pieces with a `length` of 1 to capacity; other columns are kept. Where pieces have a
    number `_row` of their own, only that goes through the tasks that rank and place, and wide columns are joined to the result.

    Every piece gets a place of its own; a sequence is filled from 0 without gaps and never past its capacity.
    Equal lengths are interchangeable, so which of them comes first is arbitrary. No rows: no sequences.
    """
    spark = pieces.sparkSession
    counts = {r[0]: r[1] for r in pieces.groupBy("length").agg(F.count("*")).collect()}  # at most `capacity` rows
    plan = spark.sparkContext.broadcast(best_fit_plan(counts, capacity))

    def place(batches):
        steps = plan.value[np.lexsort((plan.value[:, 1], plan.value[:, 0]))]
        where = steps[:, 0] << 44 | steps[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            step = steps[np.searchsorted(where, length << 44 | rank, "right") - 1]
            nth = rank - step[:, 1]
            drop = batch.schema.names.index("rank")
            kept = [c for i, c in enumerate(batch.columns) if i != drop]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(step[:, 3] + nth // step[:, 4]), pa.array(step[:, 5] + nth % step[:, 4] * length)], names=[*(n for n in batch.schema.names if n != "rank"), "sequence_id", "offset"])

    schema = lambda rows: ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", sequence_id long, offset long"
    slim = pieces.select("_row", "length") if "_row" in pieces.columns else pieces
    placed = ranked(slim, "length").select(*slim.columns, "rank").mapInArrow(place, schema(slim))
    if slim is pieces:
        return placed
    return pieces.join(placed.select("_row", "sequence_id", "offset"), "_row").select(*[c for c in pieces.columns if c != "_row"], "sequence_id", "offset")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary_path: str | None = None, with_ids: bool = False, keep_cache: bool = True) -> DataFrame:
    """Pack whole documents; see token_pieces and pack for nulls, repeats, empty tables and keep_cache.

    The ids themselves are left out unless asked for: they stay in place and are told by (doc_id, start, length).
    """
    pieces = token_pieces(docs, vocabulary_path, capacity, with_ids=with_ids, keep_cache=keep_cache)
    return pack(staged(pieces.withColumn("_row", F.monotonically_increasing_id()) if with_ids else pieces), capacity)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
