"""SimHash near-duplicates by exact tiled comparison of fingerprints."""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadloom.llm.common import only, table, text_bytes
from quadloom.operators.components import connected_components
from quadloom.sources.staging import staged

SHINGLE, RADIUS, SEED = 3, 2, 42
#: A fingerprint's population count is taken in so many parts; a tile holds the fingerprints of equal counts.
PARTS = 4
#: Fingerprints of a tile that are compared at once; larger tiles are split and all their parts still meet.
TILE = 4096


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of a text's word shingles, one for each place; a text of fewer words is one shingle."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(x, SEED) for x in joined], np.uint64)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a text's word shingles, as a signed number; 0 for a text without words."""
    return majority(shingle_hashes(text, shingle))


def majority(h: np.ndarray) -> int:
    """The bits set in over half the hashes, as a signed number; 0 without hashes."""
    if not len(h):
        return 0
    ones = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) of every whole text, row for row; null and blank texts get fingerprint 0."""

    def run(batches):
        for batch in batches:
            for lo in range(0, len(batch), 512):
                part = batch.slice(lo, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([fingerprint(t, shingle) for t in text_bytes(part.column(1))], pa.int64())], names=[id_col, "fp"])

    source = only(docs, id_col, text_col)
    return source.mapInArrow(run, f"`{id_col}` {source.dtypes[0][1]}, fp long")


def _forest(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Edges of the same connected groups as the pairs, at most one for each member."""
    a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def near_pairs(distinct: DataFrame, radius: int = RADIUS, parts: int = PARTS, tile: int = TILE) -> DataFrame:
    """Edges (a, b) whose connected groups are those of all pairs of fingerprints within the radius.

    distinct: fp, without repeats. Fingerprints of equal population counts in each of `parts` bit ranges make a
    tile. The Hamming distance is at least the sum of the counts' differences, so a tile meets only the tiles
    within the radius of it; those that meet are compared exactly by exclusive or and bit count. No pair within
    the radius is missed. Large tiles are cut, so a task holds one part of at most about `tile` fingerprints
    while the others pass by it.
    """
    width = 64 // parts
    radix = width + 1
    count = [F.bit_count(F.shiftrightunsigned("fp", width * i).bitwiseAND((1 << width) - 1 if width < 64 else -1)).cast("int") for i in range(parts)]
    code = lambda c: sum((x.cast("long") * radix**i for i, x in enumerate(c)), F.lit(0).cast("long"))
    rows = distinct.select("fp", *[x.alias(f"c{i}") for i, x in enumerate(count)])
    c = [F.col(f"c{i}") for i in range(parts)]
    rows = rows.select("fp", *c, code(c).alias("tile"))
    # a row for each occurring combination of counts: at most radix ** parts (83,521), whatever the data
    cuts = staged(rows.groupBy("tile").agg(F.ceil(F.count("*") / tile).cast("int").alias("cuts")))
    home = rows.join(F.broadcast(cuts), "tile").withColumn("cut", F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int"))
    ahead = [d for d in product(range(-radius, radius + 1), repeat=parts) if sum(map(abs, d)) <= radius and d > (0,) * parts]
    meets = [F.when(F.least(*[x + k for x, k in zip(c, d, strict=True)], F.lit(0)) < 0, None).when(F.greatest(*[x + k for x, k in zip(c, d, strict=True)], F.lit(width)) > width, None).otherwise(code([x + k for x, k in zip(c, d, strict=True)])) for d in ahead]
    away = rows.select("fp", F.explode(F.array_compact(F.array(*meets))).alias("tile")).join(F.broadcast(cuts), "tile")
    visits = away.select("fp", "tile", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"))
    own = home.where("cut < cuts - 1").select("fp", "tile", F.explode(F.sequence(F.col("cut") + 1, F.col("cuts") - 1)).alias("cut"))
    key = F.col("tile") * (1 << 33) + F.col("cut").cast("long") * 2
    both = home.select((key).alias("k"), "fp").union(visits.union(own).select((key + 1).alias("k"), "fp"))

    def compare(batches):
        at, stay, found = -1, np.zeros(0, np.uint64), []

        def meet(some: np.ndarray, among: np.ndarray, upper: bool = False) -> None:
            for lo in range(0, len(some), 64):
                near = np.bitwise_count(some[lo : lo + 64, None] ^ among[None, :]) <= radius
                if upper:
                    near &= np.arange(len(among))[None, :] > np.arange(lo, lo + len(near))[:, None]
                i, j = np.nonzero(near)
                if len(i):
                    found.append((some[lo + i], among[j]))
                if sum(len(x) for x, _ in found[-64:]) > 1 << 20:
                    found[:] = [_forest(found)]

        def edges():
            if found:
                a, b = _forest(found)
                found.clear()
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            k, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            bounds = np.concatenate([[0], np.flatnonzero(np.diff(k)) + 1, [len(k)]])
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                if hi == lo:
                    continue
                if k[lo] >> 1 != at:
                    yield from edges()
                    at, stay = k[lo] >> 1, np.zeros(0, np.uint64)
                if k[lo] & 1:
                    meet(fp[lo:hi], stay)
                else:
                    meet(fp[lo:hi], stay)
                    meet(fp[lo:hi], fp[lo:hi], True)
                    stay = np.concatenate([stay, fp[lo:hi]])
        yield from edges()

    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = both.repartition(n, F.shiftright("k", 1)).sortWithinPartitions("k")
    return dealt.mapInArrow(compare, "a long, b long")


def near_groups(prints: DataFrame, radius: int = RADIUS, id_col: str = "doc_id") -> DataFrame:
    """Add component_id, the smallest id reachable over links of at most `radius` differing bits, to a stored (id, fp, ...).

    Equal fingerprints are one node however many rows have them, so copies are never paired off.
    """
    distinct = staged(prints.groupBy("fp").agg(F.min(id_col).alias("least")))
    groups = connected_components(near_pairs(distinct.select("fp"), radius), "a", "b")
    root = F.coalesce("component", "fp")
    rooted = distinct.join(groups, distinct["fp"] == groups["node"], "left").select("fp", "least", root.alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = rooted.join(ids, "root").select("fp", "component_id")
    return prints.join(of, "fp").select(*prints.columns, "component_id")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp and component_id of every row of docs.

    Null and blank texts share fingerprint 0 and are linked like any other. Repeated rows keep their rows. Null ids
    are never a component's id unless all its ids are null. An empty table gives an empty result; other
    columns are not read.
    """
    return near_groups(staged(fingerprints(docs, shingle, id_col, text_col)), radius, id_col)


def marked_rows(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text, _text, _id): the whole row in one struct, so that its names can't clash, and marks by which rows are told apart."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    return docs.select(whole, "doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_text"), F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("")).alias("_id"))


def keep_first(docs: DataFrame, grouped: DataFrame) -> DataFrame:
    """docs with one row of each component in grouped (doc_id, _text, _id, component_id)."""
    first = Window.partitionBy("component_id").orderBy(F.col("doc_id").asc_nulls_last(), "_text")
    stay = grouped.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("_id", "_text").distinct()
    again = Window.partitionBy("_id", "_text").orderBy("_id")
    kept = marked_rows(docs).join(stay, ["_id", "_text"]).withColumn("_n", F.row_number().over(again)).where("_n = 1")
    return kept.select(*(F.col("row")[c].alias(c) for c in docs.columns))


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """docs with one row of each component: the smallest doc_id's; of rows that agree in id and text, one."""
    prints = staged(fingerprints(marked_rows(docs).select(F.struct("doc_id", "_text", "_id").alias("row"), "text"), shingle, "row").select("row.*", "fp"))
    return keep_first(docs, near_groups(prints, radius))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
