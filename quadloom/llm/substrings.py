"""Exact removal of repeated byte strings, within and across documents.

The column-wise suffix structure would need as many rounds over the whole collection as the longest text has
bytes, so the same bytes are found by content-chosen anchors instead: every string of LENGTH bytes has an anchor,
the GRAM-byte string in it with the smallest hash, and equal strings have equal anchors. Strings are compared
only among equal anchors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.llm.common import slices, table, utf8_buffer
from quadloom.llm.quality import BYTE, mixed, powers, spans_hash
from quadloom.llm.sharding import gapless_slots
from quadloom.sources.staging import staged

LENGTH, GRAM = 100, 40
#: Entries that a task compares among themselves before it sends the rest.
FLUSH = 1_000_000
#: Buckets of hashes in each shuffle partition; a task sends at most one row for each bucket at a time.
BUCKETS = 3

COVERED, WANTED, ENTRY = 1, 2, 0
MARK_TYPES = (("doc", "<i8"), ("lo", "<i4"), ("n", "<i4"))
#: A hash's rest within its bucket, 48 bits of the other hash, and where the entry starts.
ENTRY_TYPES = (("h", "<u4"), ("c", "<u4"), ("d", "<u2"), ("doc", "<i8"), ("lo", "<i4"), ("n", "<i4"), ("many", "u1"))
_second = np.roll(BYTE, 97) * np.uint64(0xD6E8FEB86659FD93) | np.uint64(1)


def pack(types, columns: dict[str, np.ndarray]) -> bytes:
    """Columns one after another; ids and places as differences, which compress well."""
    delta = lambda x: np.diff(x, prepend=x[:1] * 0)
    return b"".join((delta(columns[c]) if c in ("doc", "lo") else columns[c]).astype(t).tobytes() for c, t in types)


def unpack(types, blob: bytes) -> dict[str, np.ndarray]:
    n, at, out = len(blob) // sum(np.dtype(t).itemsize for _, t in types), 0, {}
    for c, t in types:
        x = np.frombuffer(blob, t, n, at)
        out[c] = np.cumsum(x, dtype=np.int64) if c in ("doc", "lo") else x
        at += x.nbytes
    return out


def anchors(data: np.ndarray, at: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of string starts that share an anchor: text number, first start, number of further starts, anchor hash, and
    the hash of all bytes of the run's strings. Starts count from the text's own first byte."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    if len(data) < length:
        return none
    values = BYTE[data]
    up, down = powers(len(values))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(values * up[: len(values)], dtype=np.uint64)])
    grams = mixed((sums[gram:] - sums[:-gram]) * down[: len(values) - gram + 1])
    place = np.arange(len(grams), dtype=np.uint64)
    low = grams & np.uint64(0xFFFFFFFF00000000) | place
    width, step = length - gram + 1, 1
    while 2 * step <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if step < width:
        low = np.minimum(low[: len(low) - (width - step)], low[width - step :])
    least = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    edge = np.zeros(len(data) + 1, np.int64)
    np.add.at(edge, np.maximum(at[:-1], at[1:] - length + 1), 1)
    np.add.at(edge, at[1:], -1)
    valid = np.cumsum(edge)[: len(least)] == 0
    first = valid.copy()
    first[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
    last = valid.copy()
    last[:-1] &= ~valid[1:] | (least[1:] != least[:-1])
    # equal neighbours in different texts never touch: a text's last length - 1 starts are not valid
    lo, hi = np.flatnonzero(first), np.flatnonzero(last)
    if not len(lo):
        return none
    m = least[lo]
    context = mixed((sums[hi + length] - sums[lo]) * down[lo]) + mixed(((hi - lo) << 8 | m - lo).astype(np.uint64))
    doc = np.searchsorted(at, lo, "right") - 1
    return doc, lo - at[doc], hi - lo, grams[m], mixed(context)


def _rows(kind: int, bucket: np.ndarray, types, columns: dict[str, np.ndarray], most: int = 200_000):
    """(kind, bucket, blob) rows of the columns, dealt by bucket."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    bounds = np.concatenate([[0], np.flatnonzero(np.diff(b)) + 1, [len(b)]])
    cuts = [(i, min(i + most, hi)) for lo, hi in zip(bounds[:-1], bounds[1:], strict=True) for i in range(lo, hi, most)]
    blobs = [pack(types, {c: x[order[lo:hi]] for c, x in columns.items()}) for lo, hi in cuts]
    if cuts:
        yield pa.RecordBatch.from_arrays([pa.array([kind] * len(cuts), pa.int32()), pa.array([int(b[lo]) for lo, _ in cuts], pa.int32()), pa.array(blobs, pa.binary())], names=["kind", "bucket", "blob"])


def _marks(kind: int, doc, lo, n, buckets: int):
    """Marks travel with the entries, spread over the buckets."""
    yield from _rows(kind, doc % buckets, MARK_TYPES, {"doc": doc, "lo": lo, "n": n})


def _sent(h, c, doc, lo, n, buckets: int, whole: bool):
    """What a task sends of its entries: one for each hash h.

    Of entries with equal h and c all but the first are covered at once. Where an h has several c, all are wanted
    for a closer look and the one sent says so; so no hash, however common, brings more than one entry from here.
    whole: h and c name a single string, so nothing needs a closer look.
    """
    order = np.lexsort((lo, doc, c, h))
    h, c, doc, lo, n = (x[order] for x in (h, c, doc, lo, n))
    new_h = np.concatenate([[True], h[1:] != h[:-1]])
    new_c = new_h | np.concatenate([[True], c[1:] != c[:-1]])
    group = np.cumsum(new_h) - 1
    many = np.bincount(group, new_c)[group] > 1
    if whole:
        new_h, many = new_c, np.zeros(len(many), bool)
    yield from _marks(COVERED, doc[~new_c], lo[~new_c], n[~new_c], buckets)
    want = new_c & many
    yield from _marks(WANTED, doc[want], lo[want], n[want], buckets)
    bucket = (h >> np.uint64(32)).astype(np.int64) % buckets
    columns = {"h": h & np.uint64(0xFFFFFFFF), "c": c & np.uint64(0xFFFFFFFF), "d": c >> np.uint64(48), "doc": doc, "lo": lo, "n": n, "many": many}
    by_place = np.lexsort((lo[new_h], doc[new_h]))
    yield from _rows(ENTRY, bucket[new_h][by_place], ENTRY_TYPES, {k: x[new_h][by_place] for k, x in columns.items()})


def _settle(entries: dict[str, np.ndarray], whole: bool):
    """Marks (kind, doc, lo, n) of a bucket's entries from all tasks."""
    h, doc, lo, n, many = (entries[k] for k in ("h", "doc", "lo", "n", "many"))
    c = entries["c"].astype(np.uint64) | entries["d"].astype(np.uint64) << np.uint64(32)
    order = np.lexsort((lo, doc, c, h))
    h, c, doc, lo, n, many = (x[order] for x in (h, c, doc, lo, n, many))
    new_h = np.concatenate([[True], h[1:] != h[:-1]])
    new_c = new_h | np.concatenate([[True], c[1:] != c[:-1]])
    if whole:
        return [(COVERED, doc[~new_c], lo[~new_c], n[~new_c])]
    group = np.cumsum(new_h) - 1
    mixed_up = (np.bincount(group, new_c) > 1) | (np.bincount(group, many) > 0)
    again = ~new_h & ~mixed_up[group]
    want = mixed_up[group] & (many == 0) & (np.bincount(group)[group] > 1)
    return [(COVERED, doc[again], lo[again], n[again]), (WANTED, doc[want], lo[want], n[want])]


def _compared(sent: DataFrame, buckets: int, whole: bool) -> DataFrame:
    """Marks (doc, kind, lo, n) from the rows that tasks send; a bucket's entries meet in one task."""

    def run(batches):
        at, parts = None, []

        def out(kind, doc, lo, n):
            if len(doc):
                yield pa.RecordBatch.from_arrays([pa.array(doc.astype(np.int64)), pa.array(np.full(len(doc), kind, np.int32)), pa.array(lo.astype(np.int32)), pa.array(n.astype(np.int32))], names=["doc", "kind", "lo", "n"])

        def close():
            if parts:
                for x in _settle({c: np.concatenate([p[c] for p in parts]) for c, _ in ENTRY_TYPES}, whole):
                    yield from out(*x)
                parts.clear()

        for batch in batches:
            for kind, bucket, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if kind != ENTRY:
                    m = unpack(MARK_TYPES, blob)
                    yield from out(kind, m["doc"], m["lo"], m["n"])
                    continue
                if bucket != at:
                    yield from close()
                    at = bucket
                parts.append(unpack(ENTRY_TYPES, blob))
        yield from close()

    n = int(sent.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = sent.repartition(n, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "doc long, kind int, lo int, n int")


class _Gather:
    """Entries of a task until there are enough to compare."""

    def __init__(self, buckets: int, whole: bool, flush: int) -> None:
        self.buckets, self.whole, self.flush, self.parts, self.size = buckets, whole, flush, [], 0

    def add(self, *columns):
        self.parts.append(columns)
        self.size += len(columns[0])
        if self.size >= self.flush:
            yield from self.close()

    def close(self):
        if self.size:
            yield from _sent(*(np.concatenate(x) for x in zip(*self.parts, strict=True)), self.buckets, self.whole)
        self.parts, self.size = [], 0


def _ids_are_keys(ids: DataFrame) -> bool:
    if ids.dtypes[0][1] not in ("bigint", "int"):
        return False
    ids = ids.toDF("doc")
    n, distinct, low = ids.agg(F.count(F.lit(1)), F.count_distinct("doc"), F.min("doc")).first()
    return n == distinct and (low is None or low >= 0)


def repeated_strings(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, flush: int = FLUSH) -> DataFrame:
    """(doc, lo, n): starts lo to lo + n of strings of `length` bytes that also start earlier, in texts (doc unique, >= 0; text).

    Earlier: in a smaller doc, or in the same doc at a smaller place. Each string's first place alone is left out.
    """
    buckets = BUCKETS * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def find(batches):
        gather = _Gather(buckets, False, flush)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            data, at = utf8_buffer(batch.column(1))
            for lo, hi in slices(at, 1 << 20):
                doc, start, n, h, c = anchors(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], length, gram)
                yield from gather.add(h, c, ids[lo + doc], start, n)
        yield from gather.close()

    def look(batches):
        gather = _Gather(buckets, True, flush)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            data, at = utf8_buffer(batch.column(1))
            wanted = batch.column(2)
            cuts, spans = wanted.offsets.to_numpy(), wanted.values
            los, ns = spans.field("lo").to_numpy().astype(np.int64), spans.field("n").to_numpy().astype(np.int64)
            for i in range(len(batch)):
                lo, n = los[cuts[i] : cuts[i + 1]], ns[cuts[i] : cuts[i + 1]] + 1
                start = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
                text = data[at[i] : at[i + 1]]
                h, c = (spans_hash(values[text], start, start + length) for values in (BYTE, _second))
                yield from gather.add(h, c, np.full(len(start), ids[i]), start, np.zeros(len(start), np.int64))
        yield from gather.close()

    sent = "kind int, bucket int, blob binary"
    marks = staged(_compared(texts.mapInArrow(find, sent), buckets, False))
    wanted = marks.where(F.col("kind") == WANTED).groupBy("doc").agg(F.collect_list(F.struct("lo", "n")).alias("w"))
    closer = staged(_compared(texts.join(wanted, "doc").select("doc", "text", "w").mapInArrow(look, sent), buckets, True))
    covered = marks.where(F.col("kind") == COVERED).union(closer.where(F.col("kind") == COVERED))
    return covered.select("doc", "lo", "n")


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", flush: int = FLUSH, carry: list[str] | None = None, as_text: bool = False) -> DataFrame:
    """id, n_bytes, kept (binary: the bytes left), removed (array of struct<start, length>, maximal runs) of every row.

    Every byte in a string of `length` bytes that also starts earlier is removed, judged on the input. Null texts are
    empty. Rows that repeat an id and text are one document and get the same result; rows that share an id with
    another text are ordered by a hash of the text; null ids come first. An empty table gives an empty result.
    carry: other columns to keep beside; the rest are not read. as_text: kept is a string, without the bytes of
    characters that were cut through.
    """
    names = list(carry or [])
    rest = F.struct(*(F.col(f"`{x}`").alias(f"c{i}") for i, x in enumerate(names))) if names else F.lit(None).cast("int")
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), rest.alias("rest"))
    by_id = _ids_are_keys(rows.select("_id"))
    if by_id:
        rows = rows.select(F.col("_id").cast("long").alias("doc"), "text", "rest", "_id")
        texts = rows
    else:
        rows = rows.withColumn("_h", F.xxhash64("text"))
        keys = gapless_slots(rows.select("_id", "_h", F.lit(0).alias("_one")).distinct(), "_one", ["_id", "_h"], "doc")
        match = rows["_id"].eqNullSafe(keys["_id"]) & (rows["_h"] == keys["_h"])
        rows = staged(rows.join(keys, match).select(keys["doc"], rows["text"], rows["rest"], rows["_id"]))
        texts = staged(rows.groupBy("doc").agg(F.first("text").alias("text")))
    spans = repeated_strings(texts.select("doc", "text"), length, gram, flush).groupBy("doc").agg(F.collect_list(F.struct("lo", "n")).alias("s"))

    def cut(batches):
        for batch in batches:
            data, at = utf8_buffer(batch.column(0))
            lists = batch.column(1).fill_null([]) if batch.column(1).null_count else batch.column(1)
            cuts = lists.offsets.to_numpy()
            los, ns = (lists.values.field(k).to_numpy().astype(np.int64) for k in ("lo", "n"))
            kept, removed = [], []
            for i in range(len(batch)):
                text = data[at[i] : at[i + 1]]
                edge = np.zeros(len(text) + 1, np.int64)
                np.add.at(edge, los[cuts[i] : cuts[i + 1]], 1)
                np.add.at(edge, los[cuts[i] : cuts[i + 1]] + ns[cuts[i] : cuts[i + 1]] + length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                turn = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                left = text[~gone].tobytes()
                kept.append(left.decode("utf-8", "ignore") if as_text else left)
                removed.append([{"start": int(a), "length": int(b - a)} for a, b in turn.reshape(-1, 2)])
            runs = pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(np.diff(at)), pa.array(kept, pa.string() if as_text else pa.binary()), runs], names=[*batch.schema.names[2:], "n_bytes", "kept", "removed"])

    joined = rows.join(spans, "doc", "left").select("text", "s", "_id", "rest")
    kinds = dict(joined.dtypes)
    out = joined.mapInArrow(cut, f"_id {kinds['_id']}, rest {kinds['rest']}, n_bytes long, kept {'string' if as_text else 'binary'}, removed array<struct<start: long, length: long>>")
    return out.select(F.col("_id").alias(id_col), *(F.col(f"rest.c{i}").alias(x) for i, x in enumerate(names)), "n_bytes", "kept", "removed")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    total = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["length"])
    return out.select("doc_id", "n_bytes", total.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
