"""Findings in report order (O-01) and their sink (S-06)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelode.plans.rules import FINDING_COLUMNS, RuleSet
from codelode.sources.shared import shared_folder, written


def scan(units: DataFrame, rules: RuleSet | None = None) -> DataFrame:
    """Findings of a corpus, with `rule_ordinal` and `item_pos` for ordering."""
    return (rules or RuleSet()).analyse(units)


def settled(findings: DataFrame) -> DataFrame:
    """Findings written to the shared folder and read back, for plans that use them repeatedly."""
    return written(findings, "findings")


def path_key(path: Column) -> Column:
    """Paths compare by their components: `a/b` comes before `a-b`."""
    return F.split(path, "/")


def report_order() -> list[Column]:
    return [
        path_key(F.col("source_file_path")),
        F.col("line_number"),
        F.col("column_number"),
        F.col("rule_ordinal"),
        F.col("item_pos"),
        # Findings of a function rule have one `item_pos`; what they say orders them.
        *(F.col(name) for name in ("vulnerability_rule_id", "description", "severity", "recommendation")),
    ]


def ordered(findings: DataFrame) -> DataFrame:
    """Findings sorted for a report. The sort is by ranges, so it stays distributed."""
    return findings.orderBy(*report_order()).select(*FINDING_COLUMNS)


def numbered(findings: DataFrame) -> DataFrame:
    """Add `finding_no`, the number of the finding in its file, in report order."""
    order = Window.partitionBy("source_file_path").orderBy(*report_order()[1:])
    return findings.withColumn("finding_no", F.row_number().over(order))


def ranked(findings: DataFrame) -> DataFrame:
    """Add `rank`, the place of each finding in the report of all files, from 1.

    The findings are sorted by ranges and numbered in each range; only the sizes of the ranges, a row
    for each, are added up in one place.
    """
    order = report_order()
    placed = findings.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    folder = shared_folder(findings.sparkSession, "ranked")
    placed.write.parquet(folder)
    placed = findings.sparkSession.read.schema(placed.schema).parquet(folder)
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    before = sizes.select(
        F.col("part").alias("of_part"), (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before")
    )
    number = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    numbered_parts = placed.withColumn("number", number).join(F.broadcast(before), F.col("part") == F.col("of_part"))
    return numbered_parts.withColumn("rank", F.col("before") + F.col("number")).drop("part", "of_part", "before", "number")


def write(findings: DataFrame, directory: str, run: str, file_format: str = "parquet") -> None:
    """Write the findings of a run to a table partitioned by run and language.

    A run that is repeated replaces its own findings and no others.
    """
    findings.select(*FINDING_COLUMNS).write.mode("overwrite").partitionBy(
        "programming_language"
    ).format(file_format).save(f"{directory.rstrip('/')}/run={run}")
