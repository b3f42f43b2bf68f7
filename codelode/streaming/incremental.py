"""Scanning sources as they arrive (T-01).

A file never spans batches, so the scan keeps no state; `foreachBatch` runs the batch plan, which
a streaming DataFrame cannot run itself as its windows are in row order. Each batch overwrites a
folder of its own, so a batch that is repeated after a failure leaves no findings twice. The folder
has the id of the query in its name, which belongs to the checkpoint: batches of a new checkpoint
are numbered from 0 again and must not replace those of another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codelode.plans.findings import scan
from codelode.plans.rules import RuleSet

UNITS = "path string, language string, content string"


def scan_stream(
    spark: SparkSession,
    source: str,
    findings: str,
    checkpoint: str,
    rules: RuleSet | None = None,
    files_per_batch: int = 1000,
) -> StreamingQuery:
    """Scan the Parquet files of units under `source` that no earlier run has seen."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        query = _query_id(spark, checkpoint)
        scan(batch, rules).write.mode("overwrite").parquet(f"{findings}/query={query}/batch={batch_id}")

    return (
        spark.readStream.schema(UNITS)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(source)
        .writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that the query keeps in its checkpoint from its start."""
    metadata = spark.read.text(f"{checkpoint.rstrip('/')}/metadata", wholetext=True)
    return metadata.select(F.get_json_object("value", "$.id")).first()[0]


def read_findings(spark: SparkSession, findings: str) -> DataFrame:
    return spark.read.parquet(findings).drop("query", "batch")
