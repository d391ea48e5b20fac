"""Helpers that several training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress, repeat
from operator import is_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these bytes; bytes.split() splits on the same set.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(column: pa.Array) -> list[bytes]:
    """Each text as UTF-8 bytes; null as empty."""
    return [x or b"" for x in column.cast(pa.large_string()).cast(pa.large_binary()).to_pylist()]


def utf8_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a batch as one array of bytes, and the n + 1 offsets into it; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]] if len(offsets) else whole, offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)


def slices(offsets: np.ndarray, at_most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch that hold at most so many bytes each, or one row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + at_most, "right")) - 1)
        yield lo, hi
        lo = hi


def with_columns_of(batch: pa.RecordBatch, names: list[str], arrays: list[pa.Array], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), *arrays], schema=schema)


def only(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns, by quoted name, so that odd names or extra columns of docs do no harm."""
    return docs.select(*(F.col(f"`{x}`") for x in names))


def vocabulary(spark: SparkSession, path: str):
    """A vocabulary file (a few MB whatever the data) sent to every executor once."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def unsigned_crc32(column: Column) -> Column:
    return F.crc32(F.coalesce(column, F.lit("")).cast("binary"))


class PieceCache:
    """Ids of text pieces: each distinct piece goes through the tokenizer once while a bounded cache holds it.

    many: gives for a list of pieces the int32 ids of each, as bytes. Emptied at `most` pieces; pieces over
    `longest` bytes are not kept. Neither changes a result. ordered: give new pieces in byte order.
    """

    def __init__(self, many, most: int = 200_000, longest: int = 256, ordered: bool = False) -> None:
        self.many, self.most, self.longest, self.ordered, self.known = many, most, longest, ordered, {}

    def ids(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and n + 1 offsets of the texts."""
        if len(self.known) > self.most:
            self.known.clear()
        known = self.known
        found = [list(map(known.get, x)) for x in texts]
        holes = [list(compress(range(len(f)), map(is_, f, repeat(None)))) for f in found]
        missing = list({p for x, h in zip(texts, holes, strict=True) for p in map(x.__getitem__, h)})
        if missing:
            if self.ordered:
                missing.sort()
            known.update(zip(missing, self.many(missing), strict=True))
            for x, f, h in zip(texts, found, holes, strict=True):
                for i in h:
                    f[i] = known[x[i]]
            for p in missing:
                if len(p) > self.longest:
                    del known[p]
        blobs = [b"".join(x) for x in found]
        ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in blobs], dtype=np.int64)])
        return np.frombuffer(b"".join(blobs), np.int32), ends
