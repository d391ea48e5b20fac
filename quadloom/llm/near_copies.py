"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8, none missed.

SimHash fingerprints of the sets find most links first, by the tiled comparison of simhash.near_pairs; each is then held
against the whole sets. As near pairs lie at all distances, a prefix filter finds the links that no radius would.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadloom.llm.common import text_bytes
from quadloom.llm.simhash import SEED, keep_first, majority, marked_rows, near_pairs, shingle_hashes
from quadloom.operators.components import connected_components
from quadloom.sources.staging import discard, small, staged

SHINGLE = 5
#: Texts are near copies from 4 / 5 on, so of n and m shingles at least 4 (n + m) / 9 are shared.
NEEDED = "9 * {shared} >= 4 * ({n} + {m})"
#: One in so many texts tells which shingles are frequent, and at most COMMON of them are kept. Neither changes a
#: result: any one order of the shingles finds all pairs.
SAMPLE, COMMON = 16, 100_000
#: Rounds that compare each text with so many others of its bucket, before all that are still apart are compared.
STARS, CENTRES = 2, 6


def shingle_set(text: bytes) -> np.ndarray:
    return np.unique(shingle_hashes(text, SHINGLE))


def set_key(hashes: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in arrays], dtype=np.int64)]).astype(np.int32)
    flat = np.concatenate([np.zeros(0, np.uint64), *arrays]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _parts(batches):
    for batch in batches:
        for lo in range(0, len(batch), 256):
            yield batch.slice(lo, 256)


def common_shingles(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles in order of their hashes, and their places from the rarest (1) on."""

    def run(batches):
        for part in _parts(batches):
            yield pa.RecordBatch.from_arrays([_lists([shingle_set(t) for t in text_bytes(part.column(0))])], names=["g"])

    some = texts.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("text").distinct()
    counted = some.mapInArrow(run, "g array<long>").select(F.explode("g").alias("g")).groupBy("g").agg(F.count("*").alias("n")).where("n > 2")
    found = [r.g for r in counted.orderBy(F.desc("n"), "g").limit(COMMON).collect()][::-1]
    hashes = np.array(found, np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], order + 1


def prefixes(rows: DataFrame, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(row, key, n, fp, prefix) of rows (row, text): the set's key, size and fingerprint, and its first shingles, rarest first.

    Sets that share 4/5 of their union share one of their n - ceil(4n/5) + 1 first shingles, in whatever order.
    """
    sent = rows.sparkSession.sparkContext.broadcast(common)

    def run(batches):
        hashes, places = sent.value
        for part in _parts(batches):
            sets = [shingle_set(t) for t in text_bytes(part.column(1))]
            first, fps = [], [majority(x) for x in sets]
            for x in sets:
                if len(hashes) and len(x):
                    at = np.minimum(np.searchsorted(hashes, x), len(hashes) - 1)
                    x = x[np.lexsort((x, np.where(hashes[at] == x, places[at], 0)))]
                first.append(x[: len(x) - (4 * len(x) + 4) // 5 + 1])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([set_key(x) for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int64()), pa.array(fps, pa.int64()), _lists(first)], names=["row", "key", "n", "fp", "prefix"])

    return rows.mapInArrow(run, f"row {dict(rows.dtypes)['row']}, key long, n long, fp long, prefix array<long>")


def _sets(texts: DataFrame) -> DataFrame:
    def run(batches):
        for part in _parts(batches):
            sets = [shingle_set(t) for t in text_bytes(part.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array([set_key(x) for x in sets], pa.int64()), _lists(sets)], names=["key", "g"])

    return texts.mapInArrow(run, "key long, g array<long>")


def _possible(a: str, b: str) -> str:
    """Two sets can be near if the shingle that they share, at places i from 0, is the first that they do; true for that one in any near pair."""
    return NEEDED.format(shared=f"least({a}.n - {a}.i, {b}.n - {b}.i)", n=f"{a}.n", m=f"{b}.n")


def fingerprint_pairs(prints: DataFrame) -> DataFrame:
    """(a, b): keys of sets whose fingerprints are equal or linked by simhash.near_pairs; each fingerprint is stood for by its smallest key."""
    least = staged(prints.groupBy("fp").agg(F.min("key").alias("least")))
    equal = prints.select("fp", "key").distinct().join(least, "fp").where("key <> least").select(F.col("least").alias("a"), F.col("key").alias("b"))
    of = lambda c: least.select(F.col("fp").alias(c), F.col("least").alias(f"_{c}"))
    near = near_pairs(least.select("fp")).join(of("a"), "a").join(of("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    return equal.union(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_links(postings: DataFrame, sets_of, first: DataFrame) -> DataFrame:
    """Stored edges (a, b) whose connected groups are those of all near pairs.

    postings: stored (g, i, key, n), without repeats. sets_of: gives (key, g) of the keys of a stored table. first: pairs to
    try before all others. Star rounds tie most of a large group together by comparing its members with a few of them; the last
    round compares all pairs of like size that are still apart and share one of their first shingles.
    """

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Only the sets that some pair needs are made, and only those are dealt out."""
        pairs = staged(pairs)
        keys = staged(pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct())
        sets = sets_of(keys)
        both = pairs.join(sets.select(F.col("key").alias("a"), F.col("g").alias("x")), "a").join(sets.select(F.col("key").alias("b"), F.col("g").alias("y")), "b")
        new = staged(both.select("a", "b", F.expr(NEEDED.format(shared="size(array_intersect(x, y))", n="size(x)", m="size(y)")).alias("near")))
        discard(pairs, keys, sets)
        return new

    tried, old = confirmed(first), []
    for turn in range(STARS + 1):
        labels = staged(connected_components(tried.where("near"), "a", "b"))
        now = staged(postings.join(labels, postings["key"] == labels["node"], "left").select(*postings.columns, F.coalesce("component", "key").alias("label")))
        if turn < STARS:
            band = now.withColumn("band", F.floor(F.log("n") / F.log(F.lit(1.25))))
            # other members stand for their bucket in each round; a text that isn't near one centre of a large group is near another
            place = F.row_number().over(Window.partitionBy("g", "band").orderBy(F.xxhash64("key", F.lit(turn)), "key"))
            low = band.withColumn("place", place).where(F.col("place") <= CENTRES).drop("place")
            met = band.alias("p").join(low.alias("q"), ["g", "band"]).where("p.key <> q.key")
        else:
            # near sets differ in size by a quarter at most, so they are in one band or in neighbouring ones
            band = now.withColumn("band", F.floor(F.log("n") / F.log(F.lit(1.26))))
            up = band.select("*", F.explode(F.array(F.col("band"), F.col("band") - 1)).alias("at"))
            met = band.withColumn("at", F.col("band")).alias("p").join(up.alias("q"), ["g", "at"]).where("p.band < q.band OR p.key < q.key")
        pairs = met.where("p.label <> q.label").where(_possible("p", "q")).select(F.least("p.key", "q.key").alias("a"), F.greatest("p.key", "q.key").alias("b")).distinct()
        tried = tried.union(confirmed(pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti")))
        discard(now, labels)
    return tried.where("near").select("a", "b")


def near_copy_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, _text, _id, component_id) of every row: the smallest id reachable over near pairs. Texts without words, null ones among them,
    are one group. Texts of any length are taken whole; other columns are not read."""
    rows = marked_rows(docs).drop("row")
    prints = staged(prefixes(rows.select(F.struct("doc_id", "_text", "_id").alias("row"), "text"), common_shingles(docs.select("text"))))
    named = staged(prints.select("row", "key"))
    spread = prints.select("key", "n", F.posexplode("prefix").alias("i", "g")).distinct()
    shared = spread.groupBy("g").agg(F.count("*").alias("many")).where("many > 1").select("g")
    postings = staged(spread.join(shared, "g", "left_semi").select("g", "i", "key", "n"))
    first = staged(fingerprint_pairs(prints.select("fp", "key")))
    distinct = staged(named.groupBy("key").agg(F.min("row.doc_id").alias("least"), F.min("row._text").alias("_text")))
    discard(prints)

    def sets_of(keys: DataFrame) -> DataFrame:
        of = staged(distinct.join(small(keys), "key", "left_semi").select("_text"))
        texts = rows.join(small(of), "_text", "left_semi").groupBy("_text").agg(F.first("text").alias("text"))
        sets = staged(_sets(texts.select("text")).join(small(keys), "key", "left_semi"))
        discard(of)
        return sets

    groups = staged(connected_components(near_links(postings, sets_of, first), "a", "b"))
    discard(postings, first)
    rooted = distinct.join(groups, distinct["key"] == groups["node"], "left").select("key", "least", F.coalesce("component", "key").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = rooted.join(ids, "root").select("key", "component_id")
    return named.join(of, "key").select("row.*", "component_id")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of near copies: the smallest doc_id's; of rows that agree in id and text, one. Other columns pass
    through, whatever their names; an empty table stays empty."""
    return keep_first(docs, near_copy_groups(docs))
