"""Damaged and empty units (E-17, E-18)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.catalog import PYTHON
from codelode.functions import lexical as lx
from codelode.operators.tokens import breaks_of, kind_of, with_neighbours, word_of


def source_health(units: DataFrame) -> DataFrame:
    """`has_error` for every unit: unbalanced brackets, an open quote, or `=` without a value.

    A unit without tokens has no error and stays in the result.
    """
    rows = with_neighbours(units)
    kind = F.col("kind")
    language = F.col("language")
    is_quoted = kind.isin(lx.STRING, lx.OTHER_QUOTED) & ~F.substring("tok", 1, 1).isin("/", "<")
    open_quote = F.when(is_quoted, ~lx.is_complete_string(language, F.col("tok")))
    at_end = kind_of("n1").isNull() | (kind_of("n1") == lx.END)
    no_value = (kind == lx.EQUALS) & (
        at_end
        | F.when(language == PYTHON, (F.col("depth") == 0) & breaks_of("n1"))
        .otherwise(False)
        | word_of("n1").isin(lx.words(")", "]", "}", ";"))
    )
    step = F.when(kind == lx.OPEN, 1).when(kind == lx.CLOSE, -1).otherwise(0)
    flags = rows.groupBy("path").agg(
        F.sum(step).alias("balance"),
        F.min(F.col("depth") + F.when(kind == lx.CLOSE, -1).otherwise(0)).alias("lowest"),
        F.max(F.coalesce(open_quote, F.lit(False)) | F.coalesce(no_value, F.lit(False))).alias("flawed"),
    )
    damaged = (F.col("balance") != 0) | (F.col("lowest") < 0) | F.col("flawed")
    return (
        units.select("path")
        .join(flags, "path", "left")
        .select("path", F.coalesce(damaged, F.lit(False)).alias("has_error"))
    )
