"""Hard negatives for anchors by length buckets with sorted coordinate lists; all scores are exact whole numbers."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadloom.llm.centroids import whole_vector
from quadloom.llm.common import only, table
from quadloom.llm.sharding import gapless_slots
from quadloom.llm.topk import products
from quadloom.sources.staging import staged

SCALE, STEP, POSITIVES, NEGATIVES = 256, 50, 5, 3
#: A negative's score lies between these percentages of the positive's.
LOW, HIGH = 50, 95
#: Coordinates of an anchor whose sorted lists are searched in each bucket.
FOCUS = 4
#: Vectors of a bucket and anchors of a block at most, fewer where vectors are long; numbers in a bucket.
BUCKET, BLOCK, NUMBERS = 4096, 512, 1 << 20
#: Length classes to the power of two.
CLASSES = 8
LEAST, MOST = -(1 << 63), (1 << 63) - 1
#: Floats of lengths and angles may err by so much.
SLACK = 1e-9


def _length(vector: str) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def _class(length: Column) -> Column:
    return F.when(length > 0, F.floor(F.log2(length) * CLASSES)).otherwise(-1).cast("int")


def sorted_lists(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each coordinate of the unit vectors of a bucket: its values in ascending order, and whose they are."""
    x = flat.astype(np.float64)
    x /= np.maximum(np.sqrt((x * x).sum(axis=1)), 1e-300)[:, None]
    order = np.argsort(x, axis=0, kind="stable").astype(np.int32)
    return np.ascontiguousarray(np.take_along_axis(x, order, axis=0).T), np.ascontiguousarray(order.T)


def feasible(unit: np.ndarray, least: float, values: np.ndarray, order: np.ndarray, focus: int = FOCUS) -> np.ndarray:
    """Members of a bucket that can have a cosine of at least `least` > 0 with the unit vector, by its focus coordinates.

    A vector within the angle acos(least) of the anchor has each coordinate within that angle of the anchor's own;
    the ranges of the focus coordinates are cut from their sorted lists, and who is in all of them is left.
    """
    n = order.shape[1]
    angle = math.acos(min(1.0, least))
    places = np.argsort(-np.abs(unit), kind="stable")[:focus]
    hits = np.zeros(n, np.int8)
    for f in places:
        own = math.acos(max(-1.0, min(1.0, unit[f])))
        low, high = math.cos(min(math.pi, own + angle)), math.cos(max(0.0, own - angle))
        lo, hi = np.searchsorted(values[f], (low - SLACK, high + SLACK), "left")
        hits[order[f, lo:hi]] += 1
    return np.flatnonzero(hits == len(places))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by smaller id."""
    if len(scores) > k:
        place = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        place = np.arange(len(scores))
    return place[np.lexsort((ids[place], -scores[place]))[:k]]


def _packed(classes: DataFrame, width: int, base: dict[int, tuple[int, int]]) -> DataFrame:
    """(bucket, ids, labels, flat, top, values, order): buckets by length, longest first, with their sorted lists."""
    first, parts = (F.element_at(F.create_map(*(F.lit(x) for c, v in base.items() for x in (c, v[i]))), F.col("of")) for i in (0, 1))
    padded = F.concat("q", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("q")))
    rows = classes.select((first + F.pmod(F.xxhash64("cid"), parts)).cast("int").alias("bucket"), F.struct("label", "cid", padded.alias("q"), "length").alias("v"))
    packed = rows.groupBy("bucket").agg(F.array_sort(F.collect_list("v")).alias("v"))
    packed = packed.select("bucket", F.col("v.cid").alias("ids"), F.col("v.label").alias("labels"), F.flatten("v.q").alias("flat"), F.array_max("v.length").alias("top"))

    def lists(batches):
        for batch in batches:
            made = []
            for row in range(len(batch)):
                n = len(batch.column("ids")[row])
                values, order = sorted_lists(batch.column("flat")[row].values.to_numpy().reshape(n, -1))
                made.append((values.tobytes(), order.tobytes()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([m[i] for m in made], pa.binary()) for i in (0, 1))], names=[*batch.schema.names, "values", "order"])

    return staged(packed.mapInArrow(lists, "bucket int, ids array<long>, labels array<int>, flat array<long>, top double, values binary, order binary"))


def _scan(batches, same: bool, k: int):
    """(rid, cid, score): for each request of a block the k best vectors of a bucket that are of the same label, or not, within
    the request's limits and at its threshold or above."""
    for batch in batches:
        for row in range(len(batch)):
            take = lambda name: batch.column(name)[row].values.to_numpy()  # noqa: B023, E731
            ids, labels, top = take("ids"), take("labels"), batch.column("top")[row].as_py()
            q = take("flat").reshape(len(ids), -1)
            values = np.frombuffer(batch.column("values")[row].as_py(), np.float64).reshape(q.shape[1], -1)
            order = np.frombuffer(batch.column("order")[row].as_py(), np.int32).reshape(q.shape[1], -1)
            anchors, of = take("a_flat").reshape(-1, q.shape[1]), take("a_label")
            rid, at, lo, hi, least = (take(x) for x in ("r_id", "r_at", "r_lo", "r_hi", "r_least"))
            asked = np.argsort(at, kind="stable")
            cuts = np.searchsorted(at[asked], np.arange(len(of) + 1))
            out = [], [], []
            for i, anchor in enumerate(anchors):
                mine = asked[cuts[i] : cuts[i + 1]]
                if not len(mine):
                    continue
                floor = np.maximum(lo[mine], least[mine])
                lowest = int(floor.min())
                if same:  # a bucket is in order of labels
                    found = np.arange(*np.searchsorted(labels, (of[i], of[i] + 1)))
                else:
                    found = np.flatnonzero(labels != of[i])
                if lowest > 0 and len(found):
                    length = math.sqrt(float((anchor.astype(np.float64) ** 2).sum()))
                    cosine = lowest / (length * top) if length * top else 2.0
                    if cosine > 1 + SLACK:
                        continue
                    near = feasible(anchor / length, cosine - SLACK, values, order)
                    found = near[labels[near] == of[i]] if same else near[labels[near] != of[i]]
                if not len(found):
                    continue
                scores = products(q[found], anchor[None])[:, 0]
                for r, low in zip(mine, floor, strict=True):
                    fit = np.flatnonzero((scores >= low) & (scores <= hi[r]))
                    fit = fit[best(scores[fit], ids[found[fit]], k)]
                    for x, y in zip(out, (np.full(len(fit), rid[r]), ids[found[fit]], scores[fit]), strict=True):
                        x.append(y)
            arrays = [pa.array(np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)) for x in out]
            yield pa.RecordBatch.from_arrays(arrays, names=["rid", "cid", "score"])


class Index:
    """Classes of equal vectors and labels in length buckets, searched by blocks of requests."""

    def __init__(self, classes: DataFrame) -> None:
        """classes: (cid, label, q, length, of), stored; of is the length class."""
        sizes = {r.of: r.n for r in classes.groupBy("of").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each length class: some hundreds
        self.width = classes.agg(F.max(F.size("q"))).first()[0] or 1
        self.most = max(1, min(BUCKET, NUMBERS // self.width))
        self.base, n = {}, 0
        for c in sorted(sizes, reverse=True):
            parts = -(-sizes[c] // self.most)
            self.base[c] = (n, parts)
            n += parts
        self.n, self.classes = n, classes
        self.buckets = _packed(classes, self.width, self.base) if n else None

    def last(self, least: Column) -> Column:
        """The last bucket that can hold a vector of at least so great a length."""
        by = F.lit(-1)
        for c in sorted(self.base, reverse=True):  # the first class that is too short ends the list
            upper = float(2 ** ((c + 1) / CLASSES)) if c >= 0 else 1.0
            first, parts = self.base[c]
            by = F.when(least <= upper * (1 + SLACK), F.lit(first + parts - 1)).otherwise(by)
        return by

    def search(self, requests: DataFrame, same: bool, k: int) -> DataFrame:
        """(rid, cid, score) that hold, for each request (rid, cid, lo, hi), its k best classes of the same label as class cid, or of another, with
        lo <= score <= hi; ties to the smaller cid.

        The bucket of the longest vectors comes first and gives each request a threshold; in the others only what reaches
        it is verified, and buckets too short to reach it aren't visited.
        """
        schema = "rid long, cid long, score long"
        n_blocks = max(1, -(-requests.select("cid").distinct().count() // min(BLOCK, self.most)))
        block = F.pmod(F.xxhash64("cid", F.lit(7)), F.lit(n_blocks)).cast("int").alias("block")
        run = lambda cells: cells.mapInArrow(lambda batches: _scan(batches, same, k), schema)
        own = staged(requests.join(self.classes, "cid").select("cid", block, "label", "q", "length", "rid", "lo", "hi"))

        def cells(asked: DataFrame, bucket: Column) -> DataFrame:
            """Blocks of anchors, each beside the buckets that it visits."""
            padded = F.concat("q", F.array_repeat(F.lit(0).cast("long"), F.lit(self.width) - F.size("q")))
            each = asked.groupBy("block", "cid").agg(F.first("label").alias("label"), F.first(padded).alias("q"), F.first("length").alias("length"), F.collect_list(F.struct("rid", "lo", "hi", "least")).alias("r"))
            need = F.array_min(F.transform("r", lambda x: F.greatest(x["lo"], x["least"]))).cast("double")
            need = F.when(need > 0, F.when(F.col("length") > 0, need / F.col("length")).otherwise(float("inf"))).otherwise(0.0)
            packed = each.withColumn("need", need).groupBy("block").agg(F.collect_list(F.struct("label", "q", "r")).alias("a"), F.min("need").alias("need"))
            at = F.flatten(F.transform("a", lambda x, i: F.transform(x["r"], lambda y: i)))
            r = lambda name: F.flatten(F.transform("a", lambda x: F.transform(x["r"], lambda y: y[name]))).alias(f"r_{name}")
            flat = packed.select("need", F.col("a.label").alias("a_label"), F.flatten("a.q").alias("a_flat"), at.alias("r_at"), r("rid").alias("r_id"), r("lo"), r("hi"), r("least"))
            # shuffled, as what a few blocks grow to over their buckets isn't told by their size
            return flat.withColumn("bucket", F.explode(bucket)).join(self.buckets.hint("merge"), "bucket")

        first = staged(run(cells(own.withColumn("least", F.lit(LEAST)), F.array(F.lit(0)))))
        kth = Window.partitionBy("rid").orderBy(F.desc("score"), "cid")
        reached = first.withColumn("n", F.row_number().over(kth)).where(F.col("n") == k).select("rid", F.col("score").alias("least"))
        later = own.join(reached, "rid", "left").withColumn("least", F.coalesce("least", F.lit(LEAST)))
        last = self.last(F.col("need"))
        rest = run(cells(later, F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))))
        return first.union(rest).withColumn("n", F.row_number().over(kth)).where(F.col("n") <= k).select("rid", "cid", "score")


def hard_negatives(vectors: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the anchors (vec_id).

    vectors: (vec_id, label, q array<long>). An anchor's positives are its best other rows of the same label; for each of them the
    best rows of other labels whose score is within low and high percent of the positive's are returned, from rank 1. Higher scores
    come first, ties by smaller id.

    Rows of equal label and vector are one class with its few smallest ids, which are all that any list can hold, so copies make no
    pairs; classes are numbered in the order of their smallest ids. Shorter vectors count as padded with zeros; scores beyond a long count as its bounds.
    """
    rows = staged(vectors.where("vec_id is not null and label is not null and q is not null").select("vec_id", "label", "q").distinct())
    keep = max(positives + 1, negatives)
    copies = Window.partitionBy("label", "q").orderBy("vec_id")
    few = staged(rows.withColumn("n", F.row_number().over(copies)).where(F.col("n") <= keep))
    heads = gapless_slots(few.where("n = 1").select("vec_id", "label", "q", F.lit(0).alias("one")), "one", ["vec_id", "label", "q"], "cid")
    length = _length("q")
    classes = staged(heads.select(F.col("cid").cast("long").alias("cid"), "label", "q", length.alias("length"), _class(length).alias("of")))
    keys = classes.select("cid", "label", "q")
    members = staged(few.join(keys, ["label", "q"]).select("cid", "vec_id"))
    asked = staged(rows.join(anchors.select("vec_id").distinct(), "vec_id", "left_semi").join(keys, ["label", "q"]).select("cid", F.col("vec_id").alias("anchor_id")))
    index = Index(classes)
    empty = vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if index.buckets is None:
        return empty

    def spread(found: DataFrame, k: int) -> DataFrame:
        """Rows (rid, vec_id, score, n, own) of the classes found, the first k of each request; own: of the class rid."""
        first = Window.partitionBy("rid").orderBy(F.desc("score"), "vec_id")
        return found.join(members, "cid").withColumn("n", F.row_number().over(first)).where(F.col("n") <= k).select("rid", "vec_id", "score", "n", (F.col("cid") == F.col("rid")).alias("own"))

    wide = asked.select("cid").distinct().select(F.col("cid").alias("rid"), "cid", F.lit(LEAST).alias("lo"), F.lit(MOST).alias("hi"))
    alike = staged(spread(index.search(wide, True, positives + 1), positives + 1).select(F.col("rid").alias("cid"), "vec_id", "score", "own"))
    limits = alike.where("score >= 0").select("cid", "score").distinct()
    exact = lambda x: F.col("score").cast("decimal(38,0)") * x / 100
    ask = limits.select("cid", "score", F.ceil(exact(low)).cast("long").alias("lo"), F.floor(exact(high)).cast("long").alias("hi")).where("lo <= hi")
    ask = staged(ask.withColumn("rid", F.monotonically_increasing_id()))
    unlike = spread(index.search(ask.select("rid", "cid", "lo", "hi"), False, negatives), negatives)
    hard = staged(unlike.join(ask.select("rid", "cid", F.col("score").alias("positive_score")), "rid").select("cid", "positive_score", F.col("n").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")))
    near = asked.join(alike, "cid").where("NOT own OR vec_id <> anchor_id")
    first = Window.partitionBy("cid", "anchor_id").orderBy(F.desc("score"), "vec_id")
    near = near.withColumn("k", F.row_number().over(first)).where(F.col("k") <= positives).select("cid", "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return near.join(hard, ["cid", "positive_score"]).select(*empty.columns)


def mine(embeddings: DataFrame, step: int = STEP, **limits) -> DataFrame:
    """hard_negatives() of every row of embeddings (vec_id, embedding, label) whose id is divisible by step, against all rows.

    Rows with a null id, label or vector, or with null or non-finite components, take no part; repeated rows count once; rows
    that share an id but differ are rows of their own, and none is a positive of that id. Labels of ids divisible by 7 are first
    moved on by one, modulo 10. Other columns are not read; an empty table gives no rows.
    """
    rows = only(embeddings, "vec_id", "label", "embedding").toDF("vec_id", "l", "v")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("l") + 1) % 10).otherwise(F.col("l")).cast("int")
    rows = rows.select("vec_id", label.alias("label"), whole_vector(F.col("v"), SCALE, 1 << 62).alias("q"))
    return hard_negatives(rows, rows.where(F.col("vec_id") % step == 0), **limits)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "embeddings"))


OP12_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS INTEGER) AS label,
    list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS alike, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % {STEP} = 0
), p AS MATERIALIZED (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM (
    SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) AS n FROM s WHERE alike
  ) WHERE n <= {POSITIVES}
), r AS (
  SELECT p.*, s.other AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other) AS n
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.alike AND {LOW} * p.positive_score <= 100 * s.score AND 100 * s.score <= {HIGH} * p.positive_score
)
SELECT anchor_id, positive_id, CAST(n AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM r WHERE n <= {NEGATIVES}
"""
