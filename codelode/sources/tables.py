"""Units from text columns of tables (S-02), and the text mode of GEN001."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codelode import catalog
from codelode.functions import lexical as lx
from codelode.operators.tokens import after_last_newline, newlines


def units_of(rows: DataFrame, path: str, language: str, text: str) -> DataFrame:
    """One unit per row."""
    return rows.select(
        F.col(path).cast("string").alias("path"),
        F.lit(language).alias("language"),
        F.col(text).alias("content"),
    )


def page_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scripts of all web pages as JavaScript units."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")
    bodies = F.regexp_extract_all("html", F.lit(lx.SCRIPT_BODY), F.lit(1))
    return pages.select("page_id", F.posexplode(bodies).alias("number", "content")).select(
        F.format_string("pages/%d/script%d.js", "page_id", "number").alias("path"),
        F.lit(catalog.JAVASCRIPT).alias("language"),
        "content",
    )


def text_assignments(rows: DataFrame, path: str, text: str) -> DataFrame:
    """Assignments of quoted strings in running text, with their place.

    Running text is not code: apostrophes would open strings, so it is searched and not tokenised.
    Only lengths and not the text itself go into the window that adds them up, and only for rows
    that have a match.
    """
    pattern = lx.TEXT_ASSIGNMENT
    # Two cheap tests first: the full pattern is tried at every letter of a text.
    likely = F.col(text).contains("=") & F.col(text).rlike(r'=\s*"[^"\n]*"')
    found = rows.filter(likely).select(
        F.col(path).alias("path"),
        F.posexplode(
            F.arrays_zip(
                # The pieces around the matches: one more than matches, the last is dropped.
                F.split(text, pattern).alias("before"),
                F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)).alias("match"),
            )
        ).alias("ordinal", "part"),
    )
    before, match = F.col("part.before"), F.col("part.match")
    both = F.concat(before, match)
    measured = found.filter(match.isNotNull()).select(
        "path",
        "ordinal",
        F.regexp_extract(match, pattern, 1).alias("variable"),
        F.regexp_extract(match, pattern, 2).alias("value"),
        newlines(before).alias("breaks"),
        after_last_newline(before).alias("tail"),
        newlines(both).alias("all_breaks"),
        after_last_newline(both).alias("all_tail"),
        F.octet_length(both).alias("all_bytes"),
    )
    earlier = (
        Window.partitionBy("path").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    )
    # Bytes on the current line left by the parts before: since the last part with a line break.
    placed = measured.withColumns(
        {
            "breaks_before": F.coalesce(F.sum("all_breaks").over(earlier), F.lit(0)),
            "bytes_before": F.coalesce(F.sum("all_bytes").over(earlier), F.lit(0)),
        }
    ).withColumn(
        "line_start",
        F.coalesce(
            F.max(
                F.when(
                    F.col("all_breaks") > 0,
                    F.col("bytes_before") + F.col("all_bytes") - F.col("all_tail"),
                )
            ).over(earlier),
            F.lit(0),
        ),
    )
    return placed.select(
        "path",
        (F.col("ordinal") + 1).alias("ordinal"),
        (F.col("breaks_before") + F.col("breaks") + 1).cast("int").alias("line"),
        F.when(F.col("breaks") > 0, F.col("tail") + 1)
        .otherwise(F.col("bytes_before") - F.col("line_start") + F.col("tail") + 1)
        .cast("int")
        .alias("col"),
        "variable",
        "value",
    )


def text_credentials(rows: DataFrame, path: str, text: str) -> DataFrame:
    """R-01 and J-02 in text mode."""
    names = F.broadcast(catalog.credential_names(rows.sparkSession))
    return (
        text_assignments(rows, path, text)
        .join(names, F.lower("variable") == F.col("name"), "left_semi")
        .filter(F.length("value") >= catalog.MINIMUM_SECRET_LENGTH)
    )
