"""Integer vectors, and their order along a Hilbert curve (shared by operators 11 and 12).

Vectors become a table (key, label, row, n, vector): `vector` holds `n` little-endian 32-bit integers,
`row` numbers the rows of the settled table and tells rows apart that are alike in all else.

Left out are rows without a vector, with no component, with a null or non-finite component, with more
than `MOST` components, or with one beyond `LARGEST` after scaling: products of those that stay, added
up over a vector, fit in 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.llm.common import settled

LARGEST = 1 << 25
MOST = 1 << 11
#: Components that the curve runs through, and bits of each.
CURVE_COMPONENTS, CURVE_BITS = 8, 7

_SCHEMA = "key long, label long, row long, n int, vector binary"


def _integers(scale: float, exactly: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            keys, labels, vectors = batch.columns
            sizes = np.diff(vectors.offsets.to_numpy())
            values = vectors.values.slice(vectors.offsets[0].as_py(), int(sizes.sum()))
            x = values.to_numpy(zero_copy_only=False).astype(np.float64)  # null becomes NaN
            with np.errstate(invalid="ignore", over="ignore"):
                x = np.floor(x * scale)
                bad = ~(np.abs(x) <= LARGEST)
            stops = np.cumsum(sizes)
            wrong = np.concatenate([[0], np.cumsum(bad)])
            good = (wrong[stops] == wrong[stops - sizes]) & (sizes > 0) & (sizes <= MOST)
            good &= vectors.is_valid().to_numpy(zero_copy_only=False)
            if exactly is not None:
                good &= sizes == exactly
            held = np.flatnonzero(good)
            raw = np.where(bad, 0, x).astype("<i4").tobytes()
            payload = [raw[4 * (stops[k] - sizes[k]) : 4 * stops[k]] for k in held]
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(held)), labels.take(pa.array(held)), pa.array(row + held, pa.int64()),
                 pa.array(sizes[held], pa.int32()), pa.array(payload, pa.binary())],
                ["key", "label", "row", "n", "vector"],
            )
            row += batch.num_rows

    return run


def integer_vectors(
    frame: DataFrame, scale: float, key: Column, vector: Column, label: Column | None = None, exactly: int | None = None
) -> DataFrame:
    """The table of integer vectors, each component being floor(scale * x); settled."""
    rows = frame.select(
        key.cast("long").alias("key"),
        (F.lit(None) if label is None else label).cast("long").alias("label"),
        F.coalesce(vector.cast("array<double>"), F.array().cast("array<double>")).alias("vector"),
    )
    return settled(rows.mapInArrow(_integers(scale, exactly), _SCHEMA), "vectors")


def matrix(payload: pa.Array, n: int) -> np.ndarray:
    """Rows of `n` integers each."""
    return np.frombuffer(b"".join(payload.to_pylist()), "<i4").reshape(-1, n)


@dataclass(frozen=True)
class Curve:
    """The components that the curve runs through, and where their cells lie."""

    rows: int
    components: np.ndarray
    low: np.ndarray
    width: np.ndarray


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        sizes = batch.column(0).to_numpy()
        for n in np.unique(sizes):
            x = matrix(batch.column(1).filter(pa.array(sizes == n)), int(n)).astype(np.float64)
            found = np.stack([np.full(n, float(len(x))), x.sum(axis=0), (x * x).sum(axis=0)])
            sums[n] = sums[n] + found if n in sums else found
    for n, found in sums.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, n), pa.int32()), pa.array(np.arange(n), pa.int32()), *map(pa.array, found)],
            ["n", "component", "rows", "total", "squares"],
        )


def curve(vectors: DataFrame) -> Curve:
    """The components of the largest variance. What comes to the driver is a row for each component."""
    found = (
        vectors.select("n", "vector").mapInArrow(_moments, "n int, component int, rows double, total double, squares double")
        .groupBy("n", "component").agg(*(F.sum(c).alias(c) for c in ("rows", "total", "squares")))
    )
    table = (
        found.groupBy("component").agg(*(F.sum(c).alias(c) for c in ("rows", "total", "squares")))
        .orderBy("component").toArrow()  # MOST rows at most
    )
    rows, total, squares = (table.column(c).to_numpy() for c in ("rows", "total", "squares"))
    mean = total / np.maximum(rows, 1)
    spread = np.sqrt(np.maximum(squares / np.maximum(rows, 1) - mean * mean, 0)) + 0.5
    best = np.sort(np.argsort(-spread, kind="stable")[:CURVE_COMPONENTS])
    return Curve(int(rows.max()) if len(rows) else 0, best, (mean - 2 * spread)[best], (4 * spread)[best])


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of each row of cell numbers (`bits` bits a component).

    The cell numbers are turned into the curve's "transposed" index bit by bit, from the highest down:
    a component whose bit is set mirrors the first one below that bit, one whose bit isn't set
    is exchanged with it there; a Gray decoding follows.
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for bit in range(bits - 1, 0, -1):
        below = (1 << bit) - 1
        for k in range(dims):
            is_set = (x[k] >> bit) & 1 == 1
            swapped = np.where(is_set, 0, (x[0] ^ x[k]) & below)
            x[0] ^= np.where(is_set, below, swapped)
            x[k] ^= swapped
    for k in range(1, dims):
        x[k] ^= x[k - 1]
    flips = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, 0, -1):
        flips ^= np.where((x[-1] >> bit) & 1 == 1, (1 << bit) - 1, 0)
    x ^= flips
    place = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, -1, -1):
        for k in range(dims):
            place = (place << 1) | ((x[k] >> bit) & 1)
    return place


def place_on(path: Curve) -> Column:
    """Where a vector (columns `n`, `vector`) lies on the curve; components that it lacks count as the middle."""

    def of(sizes: pa.Array, payload: pa.Array) -> pa.Array:
        sizes = sizes.to_numpy()
        places = np.zeros(len(sizes), np.int64)
        for n in np.unique(sizes):
            hit = sizes == n
            x = matrix(payload.filter(pa.array(hit)), int(n))
            cells = np.full((len(x), len(path.components)), 1 << (CURVE_BITS - 1))
            has = path.components < n
            share = (x[:, path.components[has]] - path.low[has]) / path.width[has]
            cells[:, has] = np.clip(share * (1 << CURVE_BITS), 0, (1 << CURVE_BITS) - 1)
            places[hit] = hilbert(cells, CURVE_BITS)
        return pa.array(places)

    return F.arrow_udf(of, "long")(F.col("n"), F.col("vector"))


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows, as 64-bit integers."""
    most = float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0)) * left.shape[1]
    if most < 1 << 53:
        return (left.astype(np.float64) @ right.astype(np.float64).T).astype(np.int64)
    return left.astype(np.int64) @ right.astype(np.int64).T
