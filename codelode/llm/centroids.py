"""Centroid clustering (Lloyd's rounds in integers) over zone maps in the order of a Hilbert curve (operator 12).

The vectors are sorted over the cluster by their place on a Hilbert curve and stored in blocks, each with
the least and the greatest value of every component. A round looks at the box of a block first: over a
box the difference of the squared distances to two centroids is a linear function, whose greatest value is a
sum over the components. A centroid that another one beats all over the box can be nearest to no vector of the
block and is left out; if one is left, no distance is computed. Otherwise all vectors of the block are
compared with the candidates left, exactly and at once.

A round returns counts and sums, added up in the tasks. Only the centroids come to the driver.

Results are integers and exact. Edge cases: rows that `vectors` leaves out (null, of another number of
components, non-finite, beyond 2**25 after scaling) take no part; rows with a null id are clustered, and chosen
as first centroids only after all others; rows that repeat count as often as they occur; fewer vectors than
centroids give fewer centroids; a cluster that is empty keeps its centroid; an empty table gives no row.
Inertia is exact while it fits in 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.llm.common import settled
from codelode.llm.vectors import curve, integer_vectors, matrix, place_on, products

#: Vectors of a block, and of a partition in the order of the curve.
BLOCK = 512
PARTITION = 1 << 16


def _blocks(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[int | None] = []
        vectors: list[bytes] = []

        def flush(n: int) -> pa.RecordBatch:
            x = np.frombuffer(b"".join(vectors[:n]), "<i4").reshape(n, -1)
            row = [
                pa.array([keys[:n]], pa.list_(pa.int64())), pa.array([x.shape[1]], pa.int32()),
                pa.array([x.tobytes()]), pa.array([x.min(axis=0).tobytes()]), pa.array([x.max(axis=0).tobytes()]),
            ]
            del keys[:n], vectors[:n]
            return pa.RecordBatch.from_arrays(row, ["keys", "n", "vectors", "low", "high"])

        for batch in batches:
            keys += batch.column(0).to_pylist()
            vectors += batch.column(1).to_pylist()
            while len(keys) >= size:
                yield flush(size)
        if keys:
            yield flush(len(keys))

    return run


def zones(vectors: DataFrame, block: int = BLOCK) -> DataFrame:
    """Blocks of vectors that are neighbours on the curve, with their boxes; settled.

    All vectors have the same number of components. Rows of one place are told apart by key and row number,
    so that equal vectors, however many, are spread over partitions.
    """
    path = curve(vectors)
    tasks = vectors.sparkSession.sparkContext.defaultParallelism
    parts = max(-(-path.rows // PARTITION), min(tasks, -(-path.rows // block)), 1)
    ordered = (
        vectors.select("key", "row", "vector", place_on(path).alias("place"))
        .repartitionByRange(parts, "place", "key", "row")
        .sortWithinPartitions("place", "key", "row")
        .select("key", "vector")
    )
    schema = "keys array<long>, n int, vectors binary, low binary, high binary"
    return settled(ordered.mapInArrow(_blocks(block), schema), "zones")


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that can be nearest to a vector of the box; equal distances go to the smaller."""
    lengths = (centroids * centroids).sum(axis=1)
    middle = (low + high) // 2
    best = int(np.argmin(lengths - 2 * (centroids @ middle)))
    # |x - best|^2 - |x - c|^2 is linear in x; greatest where x is at the side that the sign of its factor tells.
    factor = 2 * (centroids - centroids[best])
    greatest = lengths[best] - lengths + np.where(factor > 0, factor * high, factor * low).sum(axis=1)
    number = np.arange(len(centroids))
    return np.flatnonzero((greatest > 0) | ((greatest == 0) & (number < best)) | (number == best))


def assign(x: np.ndarray, low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest centroid of every vector of a block."""
    found = candidates(low, high, centroids)
    if len(found) == 1:
        return np.full(len(x), found[0])
    near = centroids[found]
    # |x|^2 is the same for all centroids.
    return found[np.argmin((near * near).sum(axis=1) - 2 * products(x, near), axis=1)]


def _block_of(batch: pa.RecordBatch, row: int) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    keys, n, vectors, low, high = (batch.column(k)[row].as_py() for k in range(5))
    x = np.frombuffer(vectors, "<i4").reshape(-1, n).astype(np.int64)
    return keys, x, np.frombuffer(low, "<i4").astype(np.int64), np.frombuffer(high, "<i4").astype(np.int64)


def _distances(x: np.ndarray, centroids: np.ndarray, nearest: np.ndarray) -> np.ndarray:
    apart = x - centroids[nearest]
    return (apart * apart).sum(axis=1)


def _sums(centroids: np.ndarray):
    """Of a task's blocks: count, sums of the components and sum of the distances of each cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, n = centroids.shape
        totals, rows, inertia = np.zeros((k, n), np.int64), np.zeros(k, np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                _, x, low, high = _block_of(batch, row)
                nearest = assign(x, low, high, centroids)
                far = _distances(x, centroids, nearest)
                for c in np.unique(nearest):
                    hit = nearest == c
                    totals[c] += x[hit].sum(axis=0)
                    rows[c] += hit.sum()
                    inertia[c] += far[hit].sum()
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(k, dtype=np.int32), n)), pa.array(np.tile(np.arange(n, dtype=np.int32), k)),
             pa.array(np.repeat(rows, n)), pa.array(totals.ravel()), pa.array(np.repeat(inertia, n))],
            ["cluster", "component", "rows", "total", "inertia"],
        )

    return run


def _round(blocks: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Count, component sums and inertia of the clusters."""
    schema = "cluster int, component int, rows long, total long, inertia long"
    table = (
        blocks.mapInArrow(_sums(centroids), schema)
        .groupBy("cluster", "component").agg(*(F.sum(c).alias(c) for c in ("rows", "total", "inertia")))
        .orderBy("cluster", "component").toArrow()  # a row for each component of a centroid
    )
    rows, total, inertia = (table.column(c).to_numpy().reshape(centroids.shape) for c in ("rows", "total", "inertia"))
    return rows[:, 0], total, inertia[:, 0]


def first_centroids(vectors: DataFrame, n: int, seed: str) -> np.ndarray:
    """The vectors with the least hashes of `<seed>:<key>`."""
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")), 256)
    least = vectors.withColumn("drawn", drawn).orderBy(F.asc_nulls_last("drawn"), "vector", "row").limit(n)
    rows = least.select("n", "vector").toArrow()
    return matrix(rows.column("vector").combine_chunks(), rows.column("n")[0].as_py()).astype(np.int64) if rows.num_rows else np.zeros((0, 0), np.int64)


def _assigned(centroids: np.ndarray, inertia: np.ndarray):
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                keys, x, low, high = _block_of(batch, row)
                nearest = assign(x, low, high, centroids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array(nearest.astype(np.int32)),
                     pa.array(_distances(x, centroids, nearest)), pa.array(inertia[nearest]),
                     pa.array(np.full(len(x), inertia.sum())), pa.array([names[c] for c in nearest], pa.string())],
                    ["key", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
                )

    return run


def clustered(
    frame: DataFrame, key: str, vector: Column, components: int, scale: float, n: int, rounds: int, seed: str,
    block: int = BLOCK,
) -> DataFrame:
    """`key`, `cluster`, `distance`, `cluster_inertia`, `inertia` and `centroid_sha256` of every vector.

    Components become floor(scale * x). A round moves every centroid that has vectors to the floor of their mean.
    """
    vectors = integer_vectors(frame, scale, F.col(key), vector, exactly=components)
    centroids = first_centroids(vectors, n, seed)
    schema = "key long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return frame.sparkSession.createDataFrame([], schema).withColumnRenamed("key", key)
    blocks = zones(vectors, block)
    for _ in range(rounds):
        rows, total, _ = _round(blocks, centroids)
        centroids = np.where(rows[:, None] > 0, total // np.maximum(rows, 1)[:, None], centroids)
    inertia = _round(blocks, centroids)[2]
    return blocks.mapInArrow(_assigned(centroids, inertia), schema).withColumnRenamed("key", key)
