"""Source files as units, and the files that cannot be read (S-01, S-03 to S-05, J-06)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode import catalog


def suffix(path: Column) -> Column:
    """The last suffix of the file name; a name such as `.py` has none."""
    return F.regexp_extract(path, r"[^/](\.[^./]+)$", 1)


def with_language(rows: DataFrame) -> DataFrame:
    """Add `suffix` and `language`; the language is null for a suffix that is not supported."""
    languages = F.broadcast(
        catalog.languages(rows.sparkSession).withColumnRenamed("extension", "known_suffix")
    )
    return (
        rows.withColumn("suffix", suffix(F.col("path")))
        .join(languages, F.lower("suffix") == F.col("known_suffix"), "left")
        .drop("known_suffix")
    )


def _supported() -> str:
    return "\n".join(f"  • {language:<10} ({extension})" for language, extension in catalog.LANGUAGES)


def _unsupported_message() -> Column:
    return F.concat(
        F.lit("Unsupported file extension '"),
        F.col("suffix"),
        F.lit("'.\n\nSupported languages:\n" + _supported()),
    )


def checked(files: DataFrame) -> DataFrame:
    """Add `reason` and `message` to rows `(path, bytes)`; both are null for a good file.

    A suffix that is not supported is reported before bad encoding.
    """
    rows = with_language(files).withColumn("text", F.col("bytes").cast("string"))
    unsupported = F.col("language").isNull()
    invalid = ~F.is_valid_utf8("text")
    return rows.withColumns(
        {
            "reason": F.when(unsupported, F.lit("UNSUPPORTED")).when(invalid, F.lit("INVALID_UTF8")),
            "message": F.when(unsupported, _unsupported_message()).when(
                invalid, F.concat(F.lit("File is not valid utf-8: "), F.col("path"))
            ),
        }
    )


def units(files: DataFrame) -> DataFrame:
    """Readable files as units."""
    return (
        checked(files)
        .filter(F.col("reason").isNull())
        .select(
            "path",
            "language",
            F.col("text").alias("content"),
            F.length("bytes").cast("bigint").alias("n_bytes"),
        )
    )


def rejects(files: DataFrame, requested: DataFrame | None = None) -> DataFrame:
    """Files that cannot be analysed, with the reason. `requested` paths that are not there are
    reported too. No bad file stops the rest of the corpus."""
    bad = checked(files).filter(F.col("reason").isNotNull()).select("path", "reason", "message")
    if requested is None:
        return bad
    missing = requested.select("path").distinct().join(files.select("path"), "path", "left_anti")
    return bad.unionByName(
        missing.select(
            "path",
            F.lit("MISSING").alias("reason"),
            F.concat(F.lit("File not found: "), F.col("path")).alias("message"),
        )
    )


def read_files(spark: SparkSession, directory: str, listing: DataFrame | None = None) -> DataFrame:
    """All files under a folder as `(path, bytes)`; no filter on names, so that `rejects` can
    report the ones that are not supported. `directory` is any URI that Spark reads.

    Spark's readers leave out files of no bytes. Give a `listing` (path, length) of the store, with
    paths as Spark writes them, and its empty files are rows too.
    """
    read = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(directory)
        .select("path", F.col("content").alias("bytes"))
    )
    if listing is None:
        return read
    return read.unionByName(listing.filter("length = 0").select("path", F.lit(b"").alias("bytes")))


def _file_system(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def write_files(units: DataFrame, directory: str) -> None:
    """Write every unit to a file of its own; the tasks write in parallel."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filesystem, base = _file_system(directory)
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                target = f"{base}/{path}"
                filesystem.create_dir(target.rsplit("/", 1)[0], recursive=True)
                with filesystem.open_output_stream(target) as stream:
                    stream.write(content.encode())
            yield batch[["path"]]

    units.select("path", "content").mapInPandas(write, "path string").write.format("noop").mode(
        "overwrite"
    ).save()
