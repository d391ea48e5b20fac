"""Clustering around centroids in whole numbers, by JVM expressions alone."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.llm.common import only, table
from quadloom.sources.staging import staged

DIMENSIONS, SCALE, CENTROIDS, ROUNDS, SEED = 64, 1024, 8, 10, 3
#: Components beyond this bound after scaling count as the bound, so that squares fit a decimal of 38 digits.
BOUND = 1 << 58
LONGEST = (1 << 63) - 1


def whole_vector(vector: Column, scale: int, bound: int = BOUND) -> Column:
    """floor(scale * x) of each component, within -bound and bound; null where the vector, or a component, is null or not finite."""
    limit = float(bound)
    fine = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.when(fine, F.transform(vector, lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(limit)), F.lit(-limit)))))


def nearest(vector: str, centroids: list[list[int]], kind: str) -> Column:
    """struct<distance, cluster> of the nearest of the given centroids, the smaller number of equally near ones."""
    zero = F.lit(0).cast(kind)

    def to(centroid: list[int]) -> Column:
        literal = F.expr(f"cast(array({', '.join(f'{x}L' for x in centroid)}) as array<{kind}>)")
        return F.aggregate(F.zip_with(vector, literal, lambda a, b: (a - b) * (a - b)), zero, lambda s, x: (s + x).cast(kind))

    return F.array_min(F.array(*(F.struct(to(c).alias("distance"), F.lit(i).alias("cluster")) for i, c in enumerate(centroids))))


def cluster(embeddings: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, centroid) of each row with a usable vector.

    Centroids start as the k vectors with the smallest sha256 of `seed:id`; each round assigns all vectors and moves every
    centroid that has some to the floor of their mean. A round is one pass that reduces to a row of sums for each task and cluster;
    only k rows of sums come to the driver. Rounds end early where no centroid moves, as later ones would change nothing.

    Vectors that are null, of another length, or hold nulls or non-finite numbers take no part and have no row. Repeated
    rows count each time; of rows that share an id the one with the smaller vector starts first; a null id starts
    last. Ties go to the smaller cluster. With fewer than k vectors there are fewer centroids; an empty table
    gives no rows. Other columns are not read. Sums are decimals where longs could overflow; a distance or an
    inertia beyond a long is given as the largest long.
    """
    q = whole_vector(F.col("v"), scale)
    rows = only(embeddings, id_col, vector_col).toDF("vec_id", "v").where(F.size("v") == dimensions).select("vec_id", q.alias("q"))
    rows = staged(rows.where("q is not null"))
    top, n = rows.agg(F.max(F.array_max(F.transform("q", F.abs))), F.count(F.lit(1))).first()
    kind = "bigint" if 4 * dimensions * (top or 0) ** 2 <= LONGEST and (top or 0) * n <= LONGEST else "decimal(38,0)"
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    centroids = [r.q for r in rows.orderBy(name.asc_nulls_last(), "q").select("q").limit(k).collect()]
    rows = rows.withColumn("q", F.col("q").cast(f"array<{kind}>"))
    if not centroids:
        centroids = [[0] * dimensions]  # of no use, as there are no rows
    for _ in range(rounds):
        of = rows.select("q", nearest("q", centroids, kind).alias("a")).groupBy("a.cluster")
        sums = of.agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col("q")[i]).alias(f"s{i}") for i in range(dimensions)))
        moved = list(centroids)
        for r in sums.collect():
            moved[r.cluster] = [int(r[f"s{i}"]) // r.n for i in range(dimensions)]
        if moved == centroids:
            break
        centroids = moved
    found = staged(rows.select("vec_id", nearest("q", centroids, kind).alias("a")).select("vec_id", "a.cluster", "a.distance"))
    inertia = {r.cluster: int(r.total) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    capped = lambda x: f"{min(x, LONGEST)}L"
    of = lambda values: F.element_at(F.expr(f"array({', '.join(values)})"), F.col("cluster") + 1)
    return found.select(
        "vec_id",
        "cluster",
        F.least(F.col("distance"), F.lit(LONGEST).cast(kind)).cast("long").alias("distance"),
        of([capped(inertia.get(i, 0)) for i in range(len(centroids))]).alias("cluster_inertia"),
        F.lit(min(sum(inertia.values()), LONGEST)).cast("long").alias("inertia"),
        of([f"'{hashlib.sha256(','.join(map(str, c)).encode()).hexdigest()}'" for c in centroids]).alias("centroid_sha256"),
        of([f"array({', '.join(f'{x}L' for x in c)})" for c in centroids]).alias("centroid"),
    )


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings")).drop("centroid")


def _rounds_sql(rounds: int) -> str:
    parts = []
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (
  SELECT vec_id, q, min({{'d': d, 'k': k}}) AS m FROM (
    SELECT vec_id, q, k, CAST(list_sum(list_transform(list_zip(q, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM v CROSS JOIN c{i}
  ) GROUP BY vec_id, q
)""")
        if i < rounds:
            parts.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT c{i}.k, coalesce(n.c, c{i}.c) AS c FROM c{i} LEFT JOIN (
    SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM (
      SELECT k, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT m.k AS k, unnest(range(1, {DIMENSIONS + 1})) AS i, unnest(q) AS x FROM a{i}) GROUP BY k, i
    ) GROUP BY k
  ) n ON n.k = c{i}.k
)""")
    return ", ".join(parts)


OP11_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT CAST(n AS INTEGER) AS k, q AS c FROM (SELECT q, row_number() OVER (ORDER BY sha256(concat('{SEED}:', vec_id)), q) - 1 AS n FROM v) WHERE n < {CENTROIDS}
), {_rounds_sql(ROUNDS)}
SELECT vec_id, m.k AS cluster, m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY m.k) AS BIGINT) AS cluster_inertia,
  CAST(sum(m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} ON c{ROUNDS}.k = m.k
"""
