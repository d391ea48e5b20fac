"""Byte-level BPE encoding and decoding with tiktoken and a local rank file."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.llm.common import PieceCache, only, slices, table, utf8_buffer, vocabulary

RANKS = "byte_bpe_multi_50k.tiktoken"

#: Places where a match of the pre-split pattern always ends, whatever stands around: no alternative of the pattern
#: holds white space after anything else, or a letter before punctuation or a digit, or a digit before those.
SAFE = regex.compile(r"(?<=\p{L})(?=[ \t\r\n0-9.,;:!?()。，、])|(?<=[0-9])(?=[ \t\r\nA-Za-z.,;:!?()。，、])")
#: Texts over so many characters are encoded in parts of about this size.
PART_CHARS = 1 << 16
#: A space after white space, or after a sign that might be taken for white space: no safe boundary.
UNSAFE_SPACE = re.compile(r"[\s\x1c-\x1f\x85\u200b\u180e\ufeff] ")

#: White space longer than a part: tiktoken's pattern would step back over it sign by sign, and fail at a million.
LONG_SPACE = regex.compile(r"\p{White_Space}{%d,}" % PART_CHARS)

_codecs: dict[tuple[int, str], tuple] = {}


def codec(raw: bytes, pattern: str):
    """A tiktoken encoding of a rank file's bytes, one that takes any text for one match, and the bytes of each id; made once in a process."""
    import tiktoken

    key = (hash(raw), pattern)
    if key not in _codecs:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}
        split, whole = (tiktoken.Encoding("local", pat_str=p, mergeable_ranks=ranks, special_tokens={}) for p in (pattern, r"(?s:.+)"))
        _codecs[key] = (split, whole, {b: a for a, b in ranks.items()})
    return _codecs[key]


def parts(text: str, size: int = PART_CHARS) -> Iterator[str]:
    """Cut a long text at safe places only, so that the parts' ids joined are those of the whole text.

    Long white space comes apart from what stands around it: the pattern matches it but for its last sign, which may
    belong to what follows, and at a text's end with it. No match crosses into it from before.
    """
    at = 0
    for run in LONG_SPACE.finditer(text):
        stop = run.end() - (run.end() < len(text))
        yield from _safe_parts(text, at, run.start(), size)
        yield text[run.start() : stop]
        at = stop
    yield from _safe_parts(text, at, len(text), size) if at < len(text) or not text else ()


def _safe_parts(text: str, at: int, end: int, size: int) -> Iterator[str]:
    while end - at > size:
        cut = SAFE.search(text, at + size, end)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    if at < end or not text:
        yield text[at:end]


_caches: dict[tuple[int, str], PieceCache] = {}


def _piece_encoder(raw: bytes, pattern: str) -> PieceCache:
    """Ids of pieces, by a cache that a process fills as it goes. Pieces are UTF-8 and may start with a space."""
    if (hash(raw), pattern) in _caches:
        return _caches[hash(raw), pattern]
    split, whole = (x.encode_ordinary for x in codec(raw, pattern)[:2])

    def part(text: str) -> list[int]:
        return whole(text) if len(text) >= PART_CHARS - 1 and LONG_SPACE.fullmatch(text + " ") else split(text)

    def many(pieces: list[bytes]) -> list[bytes]:
        texts = (p.decode() for p in pieces)
        return [np.array(split(t) if len(t) < PART_CHARS - 1 else [x for q in parts(t) for x in part(q)], np.int32).tobytes() for t in texts]

    return _caches.setdefault((hash(raw), pattern), PieceCache(many))


def _pieces(text: bytes) -> list[bytes]:
    """Cut before each space that follows no white space: matches of the pattern never cross such a place."""
    if b"  " in text or UNSAFE_SPACE.search(text.decode()):
        return [p.encode() for p in parts(text.decode())]
    first, *rest = text.split(b" ")
    return [first, *[b" " + x for x in rest]]


def encode_documents(docs: DataFrame, rank_path: str | None = None, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """id and `ids` (array<int>) of every whole text, as the tiktoken library gives without special tokens.

    Texts are cut at safe boundaries and each distinct piece is encoded by tiktoken once, as long as a bounded
    cache holds it. A null or empty text has no ids. Rows are kept one for one, repeated rows and null ids too;
    an empty table stays empty; other columns are not read. Nothing is shuffled. decoded: also give the bytes that
    the ids decode to, in the same pass.
    """
    raw = vocabulary(docs.sparkSession, rank_path or public_tokenizers.path(RANKS))

    def run(batches):
        strings = id_strings(raw.value, pattern) if decoded else None
        cache = _piece_encoder(raw.value, pattern)
        for batch in batches:
            data, at = utf8_buffer(batch.column(1))
            for lo, hi in slices(at, 4 << 20):
                flat, ends = cache.ids([_pieces(data[at[i] : at[i + 1]].tobytes()) for i in range(lo, hi)])
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
                back = [bytes_of(flat, ends, strings)] if decoded else []
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), ids, *back], names=[id_col, "ids", *["decoded"] * decoded])

    source = only(docs, id_col, text_col)
    return source.mapInArrow(run, f"`{id_col}` {source.dtypes[0][1]}, ids array<int>" + ", decoded binary" * decoded)


def laid_out(ids: np.ndarray, blob: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The byte strings of the ids one after another, and where each ends."""
    n = length[ids]
    ends = np.cumsum(n)
    return blob[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start[ids] - ends + n, n)], ends


def strings_of(by_id: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    length = np.array([len(x) for x in by_id], np.int64)
    return np.frombuffer(b"".join(by_id), np.uint8), np.cumsum(length) - length, length


def id_strings(raw: bytes, pattern: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    of = codec(raw, pattern)[2]
    return strings_of([of.get(i, b"") for i in range(max(of) + 1)])


def bytes_of(ids: np.ndarray, at: np.ndarray, strings: tuple) -> pa.Array:
    """The raw bytes of each list ids[at[i]:at[i + 1]]."""
    data, ends = laid_out(ids, *strings)
    ends = np.concatenate([[0], ends])[at]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())


def decode_documents(encoded: DataFrame, rank_path: str | None = None, pattern: str = public_tokenizers.PATTERN, ids_col: str = "ids") -> DataFrame:
    """Add `decoded` (binary): the raw bytes of the ids, joined. Null ids give no bytes; an id outside the file fails."""
    raw = vocabulary(encoded.sparkSession, rank_path or public_tokenizers.path(RANKS))

    def run(batches):
        strings = id_strings(raw.value, pattern)
        for batch in batches:
            lists = batch.column(ids_col).fill_null([]) if batch.column(ids_col).null_count else batch.column(ids_col)
            at = lists.offsets.to_numpy()
            values = lists.values.to_numpy()
            for lo, hi in slices(at.astype(np.int64), 1 << 20):
                decoded = bytes_of(values[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], strings)
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, decoded], names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in encoded.dtypes) + ", decoded binary")


def ids_sha256(ids: Column | str) -> Column:
    """Lowercase hex SHA-256 of the decimal ids joined by commas."""
    ids = F.col(ids) if isinstance(ids, str) else ids
    return F.sha2(F.array_join(ids.cast("array<string>"), ",").cast("binary"), 256)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), decoded=True).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        ids_sha256(F.col("ids")).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
