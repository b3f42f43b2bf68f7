"""Report tables (A-01 to A-06, P-01 to P-04, J-03, J-05).

`code_context` and `finding_blocks` read the findings more than once: pass them through
`plans.findings.settled` first, so that the corpus is scanned once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelode import catalog
from codelode.functions import expressions as ex
from codelode.plans.findings import numbered


def severity_summary(findings: DataFrame) -> DataFrame:
    """P-04: the four severities with their counts and lines, and the total in every row.

    Counts are added up on each executor before the shuffle; without findings all are zero.
    """
    spark = findings.sparkSession
    counts = findings.groupBy("severity").agg(F.count("*").alias("n"))
    rows = (
        catalog.severities(spark)
        .join(F.broadcast(counts), "severity", "left")  # a row for each severity
        .withColumn("n", F.coalesce("n", F.lit(0)))
    )
    # A window over the four rows.
    total = F.sum("n").over(Window.partitionBy())
    return (
        rows.withColumn("total", total)
        .select(
            "rank",
            "severity",
            "n",
            "total",
            ex.summary_line(F.col("severity"), F.col("n")).alias("line"),
            F.when(F.col("total") > 0, ex.total_line(F.col("total")))
            .otherwise(F.lit("No vulnerabilities detected."))
            .alias("heading"),
        )
        .orderBy("rank")
    )


def findings_by_file(findings: DataFrame) -> DataFrame:
    """A-03, A-05: one row per file with its counts, first and last line, and its rules.

    Only aggregates of fixed size are kept per file; the findings themselves stay rows, numbered
    by `finding_no` and put in sections by `finding_blocks`.
    """
    def of(severity: str):
        return F.count(F.when(F.col("severity") == severity, True)).alias(f"n_{severity.lower()}")

    return findings.groupBy("source_file_path", "programming_language").agg(
        F.count("*").alias("n_findings"),
        *(of(severity) for severity in catalog.SEVERITIES),
        F.min("line_number").alias("first_line"),
        F.max("line_number").alias("last_line"),
        F.array_join(F.array_sort(F.collect_set("vulnerability_rule_id")), ",").alias("rules"),
    )


def rules_detected(findings: DataFrame) -> DataFrame:
    """A-05: the rules that fired, with the number of findings and of files."""
    per_file = findings.groupBy("vulnerability_rule_id", "source_file_path").agg(
        F.count("*").alias("n")
    )
    return per_file.groupBy("vulnerability_rule_id").agg(
        F.sum("n").alias("n_findings"), F.count("*").alias("n_files")
    )


def code_context(findings: DataFrame, units: DataFrame) -> DataFrame:
    """P-01: up to five lines of code around each finding.

    The line numbers that findings ask for are brought to the unit, which gives just these lines, so
    no other line is shuffled. The pair of keys spreads the findings of a long file over many tasks.

    Settled findings are small as files and many as rows, so the planner would take them for small tables: the joins
    say themselves that both sides grow with the corpus.
    """
    asked = numbered(findings).select(
        "source_file_path",
        "finding_no",
        F.col("line_number").alias("target"),
        F.explode(ex.context_range(F.col("line_number"))).alias("line"),
    )
    # No more numbers than the unit has lines.
    wanted = asked.groupBy("source_file_path").agg(F.collect_set("line").alias("numbers"))
    given = units.select("path", ex.code_lines(F.col("content")).alias("all")).join(
        wanted.hint("merge"), F.col("path") == F.col("source_file_path")
    )
    picked = F.transform(
        F.filter("numbers", lambda n: n <= F.size("all")),
        lambda n: F.struct(n.alias("line"), F.element_at("all", n).alias("text")),
    )
    lines = given.select("source_file_path", F.inline(picked))
    is_target = F.col("line") == F.col("target")
    return asked.join(lines.hint("merge"), ["source_file_path", "line"]).select(
        "source_file_path",
        "finding_no",
        "line",
        F.when(is_target, F.lit(">")).otherwise(F.lit(" ")).alias("marker"),
        "text",
        ex.code_line(is_target, F.col("line"), F.col("text")).alias("code_line"),
    )


def finding_blocks(findings: DataFrame, units: DataFrame) -> DataFrame:
    """P-02, P-03: the report text of each finding, with the heading of its file before the first.

    A block holds at most five lines of code. In `(path, finding_no)` order the blocks are the
    report.
    """
    code = (
        code_context(findings, units)
        .groupBy("source_file_path", "finding_no")
        .agg(F.array_sort(F.collect_list(F.struct("line", "code_line"))).alias("lines"))
        .select(
            "source_file_path", "finding_no", F.array_join("lines.code_line", "\n").alias("code")
        )
    )
    block = F.concat_ws(
        "\n",
        F.lit("-" * 80),
        ex.finding_header(
            F.col("severity"), F.col("vulnerability_rule_name"), F.col("vulnerability_rule_id")
        ),
        F.lit("\nLocation:"),
        F.concat(
            F.lit("  "),
            ex.finding_location(
                F.col("source_file_path"), F.col("line_number"), F.col("column_number")
            ),
        ),
        F.lit("\nDescription:"),
        F.concat(F.lit("  "), F.col("description")),
        F.lit("\nRecommendation:"),
        F.concat(F.lit("  "), F.col("recommendation")),
        F.lit("\nCode:\n"),
        F.coalesce("code", F.lit("")),
    )
    heading = F.concat(F.lit("File: "), F.col("source_file_path"), F.lit("\n\n"))
    return (
        numbered(findings)
        .join(code.hint("merge"), ["source_file_path", "finding_no"], "left")
        .select(
            "source_file_path",
            "finding_no",
            F.when(F.col("finding_no") == 1, F.concat(heading, block)).otherwise(block).alias("block"),
        )
    )
