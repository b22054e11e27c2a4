"""Exact centroid clustering with geometric drift tightening.

Every vector keeps an upper bound of the distance to its own centroid and a lower bound of the distance to any other. When
centroids move, the upper bound grows by the own centroid's drift. The lower bound need not shrink by the greatest drift:
all vectors of a cluster lie in a sphere about its old centroid, and over that sphere the distance to another centroid,
moved from ``p`` to ``q``, shrinks by at most ``|pq| cos(a - b)``. Here ``a`` is the angle at the middle of ``pq`` between
the direction of the move and the sphere's centre, and ``b`` the half angle under which the sphere is seen from there: the
difference of the distances to ``p`` and ``q`` is twice the product of the drift and the coordinate along it, over the sum
of both distances, which is at least twice the distance from the middle. A sphere that lies behind the middle loses
nothing. Vectors whose bounds overlap are scanned exactly, in integers.

The vectors are written once, in buckets of a row number. A round reads them beside the small table of bounds, bucket by
bucket, without a shuffle, and writes new bounds; only sums of moved vectors leave a task.
"""

from __future__ import annotations

import hashlib
import math
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlens.llm.common import op, table
from offerlens.session import new_table_dir, staged

CLUSTERS, ROUNDS, DIMENSIONS, SCALE, SEED = 8, 10, 64, 1024, "3"
#: Greatest absolute component after scaling; sums of squares up to it fit a long.
LARGEST = 1 << 27
#: Bounds are widened by this share and this distance, far above the rounding of double precision.
MARGIN, MARGIN_ABS = 1e-9, 1e-6
#: Vectors that are scanned at a time.
BLOCK = 1024


@dataclass(frozen=True)
class Move:
    """What a round tells the tasks: centroids, their drift, and by how much lower bounds loosen, by own cluster."""

    centroids: np.ndarray
    drift: np.ndarray
    loosening: np.ndarray
    first: bool = False


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """By own cluster, the most by which the distance to any other centroid can have shrunk for vectors of its sphere."""
    old, new = old.astype(np.float64), new.astype(np.float64)
    out = np.zeros(len(old))
    for own in range(len(old)):
        for other in range(len(old)):
            drift = float(np.linalg.norm(new[other] - old[other]))
            if own == other or drift == 0.0:
                continue
            middle = (old[other] + new[other]) / 2
            reach = float(np.linalg.norm(old[own] - middle))
            if radius[own] >= reach:
                loss = drift
            else:
                along = float((old[own] - middle) @ (new[other] - old[other])) / (drift * reach)
                angle = math.acos(max(-1.0, min(1.0, along))) - math.asin(radius[own] / reach)
                loss = drift * math.cos(angle) if 0.0 < angle < math.pi / 2 else drift if angle <= 0.0 else 0.0
            out[own] = max(out[own], loss)
    return out * (1 + MARGIN) + MARGIN_ABS


def moved(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> Move:
    drift = np.linalg.norm((new - old).astype(np.float64), axis=1)
    return Move(new, drift * (1 + MARGIN) + MARGIN_ABS, loosening(old, new, radius))


def scan(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of vectors to centroids, exact in integers."""
    return np.concatenate([((x[a : a + BLOCK, None, :] - centroids[None]) ** 2).sum(axis=2) for a in range(0, len(x), BLOCK)] or [np.zeros((0, len(centroids)), np.int64)])


def settle(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, move: Move) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """New (cluster, upper, lower) after a move, and how many vectors were scanned."""
    if move.first:
        open_ = np.arange(len(x))
        upper, lower = upper.copy(), lower.copy()
    else:
        upper, lower = upper + move.drift[cluster], lower - move.loosening[cluster]
        open_ = np.flatnonzero(upper >= lower)
        own = np.sqrt(((x[open_] - move.centroids[cluster[open_]]) ** 2).sum(axis=1).astype(np.float64))
        upper[open_] = own * (1 + MARGIN) + MARGIN_ABS
        open_ = open_[upper[open_] >= lower[open_]]
    cluster = cluster.copy()
    if len(open_):
        d = scan(x[open_], move.centroids)
        best = d.argmin(axis=1)  # the first of equal ones
        near = np.sqrt(d[np.arange(len(best)), best].astype(np.float64))
        d[np.arange(len(best)), best] = np.iinfo(np.int64).max
        other = np.sqrt(d.min(axis=1).astype(np.float64)) if d.shape[1] > 1 else np.full(len(best), np.inf)
        cluster[open_], upper[open_], lower[open_] = best, near * (1 + MARGIN) + MARGIN_ABS, other * (1 - MARGIN) - MARGIN_ABS
    return cluster, upper, lower, len(open_)


def integers(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, vec): vectors of ``dimensions`` components, none null or not finite, as floor(scale * component)."""
    fine = F.forall("embedding", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    kept = vectors.select("vec_id", "embedding").filter((F.size("embedding") == dimensions) & fine)
    limit = F.lit(LARGEST / scale)
    component = lambda x: F.when(F.abs(x) < limit, F.floor(x.cast("double") * scale)).otherwise(F.raise_error(F.lit("a component is too large for its squared distances to fit a long")))
    return kept.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform("embedding", lambda x: component(x).cast("int")).alias("vec"))


def _bucketed(rows: DataFrame, name: str, parts: int) -> DataFrame:
    """Write in buckets of ``row``, sorted, below the shared folder, and read back. The catalogue keeps no entry."""
    spark = rows.sparkSession
    entry = f"{name}_{os.urandom(8).hex()}"
    rows.write.bucketBy(parts, "row").sortBy("row").option("path", new_table_dir(spark, name)).saveAsTable(entry)
    out = spark.table(entry)
    spark.sql(f"DROP TABLE {entry}")  # files of a table with a path of its own stay
    return out


def _rounds(dim: int, k: int, shipped):
    """Task side of a round: bounds of every vector, then per task and cluster what its moved vectors add."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        move: Move = shipped.value
        added = np.zeros((k, dim + 2), dtype=np.int64)  # sums, count, greatest upper bound rounded up
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            row, was, upper, lower = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(4))
            x = batch.column(4).flatten().to_numpy().astype(np.int64).reshape(-1, dim)
            cluster, upper, lower, _ = settle(x, was.astype(np.int64), upper, lower, move)
            gone = np.flatnonzero(cluster != was)
            np.add.at(added[:, :dim], cluster[gone], x[gone])
            np.add.at(added[:, dim], cluster[gone], 1)
            left = gone[was[gone] >= 0]
            np.subtract.at(added[:, :dim], was[left], x[left])
            np.subtract.at(added[:, dim], was[left], 1)
            np.maximum.at(added[:, dim + 1], cluster, np.ceil(upper).astype(np.int64))
            last = row[-1]
            none = pa.nulls(len(row), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(cluster.astype(np.int32)), pa.array(upper), pa.array(lower), none], names=["row", "cluster", "upper", "lower", "added"])
        if last is not None:
            zero = pa.array(np.zeros(k))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(k, last)), pa.array(np.arange(k, dtype=np.int32)), zero, zero, pa.array(added.tolist(), pa.list_(pa.int64()))], names=["row", "cluster", "upper", "lower", "added"])

    return run


def cluster(points: DataFrame, seeds: list[list[int]], rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance) per row of ``points`` (vec_id, vec), final centroids).

    Centroids start as ``seeds``. Each round assigns every vector to the nearest centroid (squared Euclidean distance;
    of equally near ones the first) and replaces centroids by the componentwise floor of the mean of their vectors; a
    centroid without vectors stays. ``distance``: squared, after one more assignment. Equal vectors and repeated ids are
    rows of their own. Without points there are no rows.
    """
    spark = points.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    centroids = np.array(seeds, dtype=np.int64)
    k, dim = centroids.shape
    rows = points.withColumn("row", F.monotonically_increasing_id())
    rows = _bucketed(rows.repartition(parts, "row"), "points", parts)
    beside = rows.select("row", F.lit(-1).alias("cluster"), F.lit(0.0).alias("upper"), F.lit(0.0).alias("lower"), "vec", "vec_id")
    move = Move(centroids, np.zeros(k), np.zeros(k), first=True)
    sums, counts = [[0] * dim for _ in range(k)], [0] * k
    for _ in range(rounds):
        shipped = spark.sparkContext.broadcast(move)  # k centroids
        schema = "row bigint, cluster int, upper double, lower double, added array<bigint>"
        out = _bucketed(beside.drop("vec_id").mapInArrow(_rounds(dim, k, shipped), schema), "bounds", parts)
        whole = [F.sum(F.get("added", F.lit(c)).cast("decimal(38,0)")).alias(f"x{c}") for c in range(dim + 1)]
        totals = out.filter("added IS NOT NULL").groupBy("cluster").agg(*whole, F.max(F.get("added", F.lit(dim + 1))).alias("radius"))
        radius = np.zeros(k)
        for r in totals.collect():  # k rows
            own = r["cluster"]
            sums[own] = [s + int(r[f"x{c}"]) for c, s in enumerate(sums[own])]
            counts[own] += int(r[f"x{dim}"])
            radius[own] = r["radius"]
        new = np.array([[s // n for s in sums[c]] if (n := counts[c]) else centroids[c].tolist() for c in range(k)], dtype=np.int64)
        move, centroids = moved(centroids, new, radius), new
        beside = out.filter("added IS NULL").select("row", "cluster", "upper", "lower").join(rows, "row").select(*beside.columns)
    shipped = spark.sparkContext.broadcast(move)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            was, upper, lower = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(1, 4))
            x = batch.column(4).flatten().to_numpy().astype(np.int64).reshape(-1, dim)
            own, *_ = settle(x, was.astype(np.int64), upper, lower, shipped.value)
            distance = ((x - shipped.value.centroids[own]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(5), pa.array(own.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return beside.mapInArrow(last, "vec_id bigint, cluster int, distance bigint"), centroids


def seeds(points: DataFrame, k: int = CLUSTERS, salt: str = SEED) -> list[list[int]]:
    """The vectors of the ``k`` smallest SHA-256 of ``salt:vec_id``, in ascending order; ties by vector, null ids last."""
    drawn = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    return [list(r["vec"]) for r in points.orderBy(drawn.asc_nulls_last(), "vec").limit(k).select("vec").collect()]


_FINE = f"len(embedding) = {DIMENSIONS} AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))"


def _sql() -> str:
    """Plain rounds, unrolled, without any bound."""
    steps = []
    for n in range(ROUNDS + 1):
        near = "list_sum(list_transform(list_zip(p.vec, c.vec), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
        steps.append(
            f"a{n} AS MATERIALIZED (SELECT p.row, any_value(p.vec_id) AS vec_id, any_value(p.vec) AS vec, min(struct_pack(d := {near}, cluster := c.cluster)) AS best"
            f" FROM points p, c{n} c GROUP BY p.row)"
        )
        if n < ROUNDS:
            steps.append(
                f"m{n} AS (SELECT cluster, nth, sum(x) AS s, count(*) AS n FROM (SELECT best.cluster AS cluster, unnest(vec) AS x, generate_subscripts(vec, 1) AS nth FROM a{n}) GROUP BY ALL),"
                f" c{n + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(list(((m.s - ((m.s % m.n) + m.n) % m.n) // m.n)::BIGINT ORDER BY m.nth) FILTER (m.nth IS NOT NULL), any_value(c.vec)) AS vec"
                f" FROM c{n} c LEFT JOIN m{n} m ON m.cluster = c.cluster GROUP BY c.cluster)"
            )
    return f"""
WITH points AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS vec FROM embeddings WHERE {_FINE}),
c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id) NULLS LAST, vec) - 1)::INTEGER AS cluster, vec FROM points
  QUALIFY cluster < {CLUSTERS}),
{", ".join(steps)}
SELECT a.vec_id, a.best.cluster AS cluster, a.best.d AS distance, sum(a.best.d) OVER (PARTITION BY a.best.cluster)::BIGINT AS cluster_inertia,
  sum(a.best.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.vec, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN c{ROUNDS} c ON c.cluster = a.best.cluster"""


@op("op11_centroid_clusters", _sql())
def op11_centroid_clusters(spark, sf_dir):
    """One row per vector of ``embeddings`` with exactly 64 components, none null or not finite; no others take part.

    ``cluster``, squared ``distance`` to its final centroid, their sums over the cluster and over all, and a digest of
    the centroid. With fewer vectors than clusters each starts one. A null vec_id is clustered, and seeds last. Ties go
    to the smaller cluster number. Other columns play no part; an empty table gives no rows. A component of 131072 or
    more is an error, as its distances need not fit a long.
    """
    points = staged(integers(table(spark, sf_dir, "embeddings")), "integers")
    first = seeds(points)
    columns = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], columns)
    found, centroids = cluster(points, first)
    found = staged(found, "assigned")
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    own = {r["cluster"]: int(r["total"]) for r in found.groupBy("cluster").agg(total.alias("total")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    pick = lambda values, kind: F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("cluster") + 1)
    named = {"cluster_inertia": pick([own.get(c, 0) for c in range(len(digests))], "bigint"), "inertia": F.lit(sum(own.values())).cast("bigint"), "centroid_sha256": pick(digests, "string")}
    return found.select("vec_id", "cluster", "distance", *[c.alias(n) for n, c in named.items()])
