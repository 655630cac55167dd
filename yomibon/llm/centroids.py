"""Centroid clustering with exact results from fast float32 matrix products.

Components become integers, floor(SCALE x). Centroids start as the vectors whose ids have the smallest
hashes; each round gives every vector its nearest centroid (squared Euclidean distance, ties to the smaller
number) and each centroid the floor of its vectors' mean. A batch of vectors is screened by one float32
matrix product. For d components, u = 2**-24 and g = (d + 2) u / (1 - (d + 2) u), the product is within
g |x| |c| of the exact one in any order of summation, the rounding of x and c to float32 included, so
|c|^2 - 2 x c lies in a known interval. Centroids whose interval begins beyond the least upper end can't be
nearest; where more than one remains, their distances are computed anew with exact integers.

Each round is one scan whose tasks return count and sums by centroid, of a fixed size. Centroids are all that
the driver holds.

Defined results. Vectors that are null, of another length than DIMENSIONS, or with a null or non-finite
component are dropped. A vec_id that repeats counts each time, the lesser vector first; a null id comes
last. Fewer kept vectors than CENTROIDS make that many clusters. Integers stay within LARGEST, so that
squared distances fit a long; sums beyond a long are the greatest long. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, kernels
from .va_file import LONG, finite, integers

SCALE, DIMENSIONS, CENTROIDS, ROUNDS, SEED = 256, 64, 40, 5, 2
LARGEST = 1 << 27
#: Vectors that are screened at a time.
ROWS = 8192


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """vectors [n, d], centroids [k, d], integers: (number of the nearest centroid, squared distance, how many centroids were recomputed)."""
    n, d = vectors.shape
    u = 2.0**-24
    g = (d + 2) * u / (1 - (d + 2) * u)
    product = (vectors.astype(np.float32) @ centroids.astype(np.float32).T).astype(np.float64)
    lengths = [np.sqrt(np.einsum("nd,nd->n", x, x).astype(np.float64)) for x in (vectors.astype(np.float64), centroids.astype(np.float64))]
    squares = np.einsum("nd,nd->n", centroids, centroids).astype(np.float64)
    screen = squares - 2 * product
    # Twice the product's bound, and generous room for the float64 operations here.
    error = (2 * g * lengths[0][:, None] * lengths[1] + (squares + np.abs(product)) * 2.0**-48) * (1 + 2.0**-20)
    possible = screen - error <= (screen + error).min(axis=1, keepdims=True)
    best = possible.argmax(axis=1)
    open_rows = np.flatnonzero(possible.sum(axis=1) > 1)
    row, number = np.nonzero(possible[open_rows])
    if len(row):
        difference = vectors[open_rows[row]] - centroids[number]
        exact = np.full((len(open_rows), len(centroids)), LONG, np.int64)
        exact[row, number] = np.einsum("nd,nd->n", difference, difference)
        best[open_rows] = exact.argmin(axis=1)
    difference = vectors - centroids[best]
    return best, np.einsum("nd,nd->n", difference, difference), len(row)


SUMS = "cluster int, position int, n long, total long"


def summer(centroids: np.ndarray, scale: int) -> Callable:
    """Batches of (vector) -> a task's count and sum of the vectors of each centroid, by position."""

    @kernels.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, d = centroids.shape
        count, total = np.zeros(k, np.int64), np.zeros((k, d), np.int64)
        for batch in batches:
            for s in range(0, batch.num_rows, ROWS):
                vectors = integers(batch.column(0).slice(s, ROWS), d, scale, LARGEST)
                best = nearest(vectors, centroids)[0]
                count += np.bincount(best, minlength=k)
                np.add.at(total, best, vectors)
        cluster, position = (x.ravel().astype(np.int32) for x in np.indices((k, d)))
        yield pa.RecordBatch.from_arrays([pa.array(cluster), pa.array(position), pa.array(np.repeat(count, d)), pa.array(total.ravel())], [x.split()[0] for x in SUMS.split(", ")])

    return run


def assigner(centroids: np.ndarray, scale: int) -> Callable:
    """Batches of (vector, vec_id) -> vec_id, cluster, distance."""

    @kernels.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, ROWS):
                some = batch.slice(s, ROWS)
                best, distance, _ = nearest(integers(some.column(0), centroids.shape[1], scale, LARGEST), centroids)
                yield pa.RecordBatch.from_arrays([some.column(1), pa.array(best.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return run


def clustered(vectors: DataFrame, vector: str = "embedding", dimensions: int = DIMENSIONS, centroids: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """vectors (vec_id, vector) -> vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark = vectors.sparkSession
    kept = finite(vectors.select(F.col(vector).alias("vector"), "vec_id").where(F.size(vector) == dimensions), "vector")
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    start = kept.orderBy(rank.asc_nulls_last(), "vector").limit(centroids).select("vector").collect()
    schema = f"vec_id {kept.schema['vec_id'].dataType.simpleString()}, cluster int, distance long"
    found = integers(pa.array([r.vector for r in start], pa.list_(pa.float64())), dimensions, scale, LARGEST)
    if not len(found):
        return kept.where("false").select("vec_id", F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256"))
    for _ in range(rounds):
        # A row a component of a centroid.
        sums = kept.select("vector").mapInArrow(summer(found, scale), SUMS).groupBy("cluster", "position").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
        found = found.copy()
        for r in sums.where("n > 0").collect():
            found[r.cluster, r.position] = int(r.total) // r.n
    rows = common.written(kept.mapInArrow(assigner(found, scale), schema), "clusters")
    inertia = {r.cluster: int(r.s) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # a row a centroid
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.tolist()]
    facts = [(k, min(s, LONG), min(sum(inertia.values()), LONG), digests[k]) for k, s in sorted(inertia.items())]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
