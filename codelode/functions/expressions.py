"""Scalar expressions shared by extraction, rules and report (X-01 to X-11)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: lines of code shown before and after a finding.
CONTEXT_LINES = 2


def display_name(qualifier: Column, name: Column) -> Column:
    """X-01: `qualifier.name`, or the name alone."""
    return F.when(F.coalesce(qualifier, F.lit("")) != "", F.concat_ws(".", qualifier, name)).otherwise(name)


def strip_quotes(text: Column) -> Column:
    """X-02: take away one pair of equal outer quotes."""
    quote = F.substring(text, 1, 1)
    return F.when(
        (F.length(text) >= 2) & (quote == F.right(text, F.lit(1))) & quote.isin("'", '"'),
        F.substring(text, F.lit(2), F.length(text) - 2),
    ).otherwise(text)


def unsafe_function_message(qualifier: Column, name: Column) -> Column:
    """X-06."""
    return F.concat(F.lit("Unsafe function '"), display_name(qualifier, name), F.lit("' detected."))


def finding_header(severity: Column, rule_name: Column, rule_id: Column) -> Column:
    """X-07, first line."""
    return F.format_string("[%s] %s (%s)", severity, rule_name, rule_id)


def finding_location(path: Column, line: Column, column: Column) -> Column:
    """X-07, location."""
    return F.format_string("%s:%d:%d", path, line, column)


def code_line(is_target: Column, line: Column, text: Column) -> Column:
    """X-08."""
    marker = F.when(is_target, F.lit(">")).otherwise(F.lit(" "))
    return F.format_string("%s%5d | %s", marker, line, text)


def summary_line(severity: Column, n: Column) -> Column:
    """X-09, one severity."""
    return F.format_string("%-8s : %d", severity, n)


def total_line(n: Column) -> Column:
    """X-09, total."""
    return F.format_string("Total findings : %d", n)


def code_lines(content: Column) -> Column:
    """X-10: the lines of a unit. Breaks at `\\n` only; a final empty piece is not a line."""
    pieces = F.transform(F.split(content, "\n"), lambda x: F.regexp_replace(x, "\r$", ""))
    return F.when(
        F.right(content, F.lit(1)) == "\n", F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    ).when(content == "", F.slice(pieces, F.lit(1), F.lit(0))).otherwise(pieces)


def context_range(line: Column) -> Column:
    """X-11: line numbers around a finding; numbers past the end find no line to join."""
    return F.sequence(F.greatest(F.lit(1), line - CONTEXT_LINES), line + CONTEXT_LINES)
