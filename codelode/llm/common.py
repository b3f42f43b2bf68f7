"""What the operators share: settled tables and columns beside a caller's own."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from codelode.sources.shared import shared_folder

#: Rows that are Python objects at the same time.
ROWS = 256


def settled(frame: DataFrame, purpose: str) -> DataFrame:
    """The frame written as a table in the shared folder and read back.

    Cuts the lineage: a lost executor costs a read of that table, not the work before it.
    """
    folder = shared_folder(frame.sparkSession, purpose)
    frame.write.parquet(folder)
    return frame.sparkSession.read.schema(frame.schema).parquet(folder)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def free_name(frame: DataFrame, wanted: str) -> str:
    """A column name that the frame doesn't use yet, whatever its case."""
    taken = {name.lower() for name in frame.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def strings(column: pa.Array) -> Iterator[str | None]:
    """The values of a string column, a few at a time, so that a large batch isn't held twice."""
    for start in range(0, len(column), ROWS):
        yield from column.slice(start, ROWS).to_pylist()


def by_size(column: pa.Array, size: int) -> Iterator[pa.Array]:
    """A string column in slices of about `size` bytes, a row at least, so that results needn't be held whole.

    An empty column is one slice.
    """
    lengths = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum([0, *lengths], dtype=np.int64)
    low = 0
    while low < len(column) or not low:
        high = max(low + 1, int(np.searchsorted(ends, ends[low] + size, "right")) - 1)
        yield column.slice(low, high - low)
        low = high
