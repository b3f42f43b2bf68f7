"""The folder that all executors can reach."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder under `spark.checkpoint.dir`.

    Only where that is unset, as in tests on one machine, a temporary folder takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("Set spark.checkpoint.dir to a folder that all executors can reach.")
        base = tempfile.mkdtemp(prefix="codelode-")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def written(frame: DataFrame, purpose: str) -> DataFrame:
    """Rows written to the shared folder and read back, for plans that use them repeatedly.

    A lost executor then costs a read and not the work again.
    """
    folder = shared_folder(frame.sparkSession, purpose)
    frame.write.parquet(folder)
    return frame.sparkSession.read.schema(frame.schema).parquet(folder)
