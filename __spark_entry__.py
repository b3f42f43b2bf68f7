"""Queries over the given tables, with an independent DuckDB statement for each.

Corpus queries run on source files made from all rows of `events`; their DuckDB statements give
the expected rows by statement number and never look at the text, so that the extraction is not
checked against a copy of itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_oracle
from codelode import catalog
from codelode.functions.expressions import display_name
from codelode.operators import extract, health
from codelode.operators.tokens import tokens
from codelode.plans import report
from codelode.plans.findings import numbered, ordered, ranked, scan, settled, write
from codelode.plans.rules import (
    COMMAND_INJECTION,
    FINDING_COLUMNS,
    HARDCODED_CREDENTIALS,
    UNSAFE_CODE_EXECUTION,
    Context,
    FunctionRule,
    RuleSet,
)
from codelode.sources import files, tables
from codelode.sources.corpus import altered_corpus, corpus
from codelode.sources.shared import shared_folder
from codelode.streaming.incremental import read_findings, scan_stream

try:
    import corpus_pipeline
    from codelode.llm import registry as llm
except ImportError:  # the library works without that subpackage
    corpus_pipeline = llm = None

_NUMBERED = [FINDING_COLUMNS[5], "finding_no", *(c for c in FINDING_COLUMNS if c != "source_file_path")]


def entry(spark: SparkSession) -> DataFrame:
    """All findings of the corpus, in report order."""
    return ordered(scan(corpus(spark, "/root/testdata/sf0.001")))


def _scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(corpus(spark, sf_dir))


def _one_rule(rule):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return scan(corpus(spark, sf_dir), RuleSet((rule,))).select(
            "source_file_path", "line_number", "column_number", "severity", "description"
        )

    return query


def sources_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.page_scripts(spark, sf_dir)


def language_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffixes = [".py", ".JAVA", ".js", ".Js", ".c", "", "/.py"]
    key = F.col("p_partkey")
    suffix = F.element_at(F.array(*(F.lit(s) for s in suffixes)), (key % 7 + 1).cast("int"))
    paths = spark.read.parquet(f"{sf_dir}/part.parquet").select(
        F.concat(F.lit("src/part"), key, suffix).alias("path"), F.lit(b"").alias("bytes")
    )
    return files.checked(paths).select("path", "suffix", "language", "reason", "message")


def utf8_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(
        key,
        F.concat(
            F.lit("src/part"), key, F.when(key % 3 == 0, F.lit(".c")).otherwise(F.lit(".py"))
        ).alias("path"),
        F.when(key % 5 == 0, F.unhex(F.lit("6162FFFE")))
        .otherwise(F.encode("p_name", "utf-8"))
        .alias("bytes"),
    )
    present = parts.filter(key % 11 != 0).select("path", "bytes")
    return files.rejects(present, parts.select("path"))


def read_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "files")
    uri = folder if "://" in folder else f"file://{folder}"
    files.write_files(corpus(spark, sf_dir), uri)
    return files.units(files.read_files(spark, uri)).select(
        F.regexp_extract("path", r"(corpus/[^/]+)$", 1).alias("path"), "language", "n_bytes"
    )


def tokens_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens(tables.page_scripts(spark, sf_dir)).drop("language")


def assignments_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.assignments(tables.page_scripts(spark, sf_dir)).select(
        "path", "line", "col", "variable", "value.kind", "value.text"
    )


def _calls(units: DataFrame) -> DataFrame:
    return extract.calls(units).select(
        "path",
        "language",
        "line",
        "col",
        "qualifier",
        "function_name",
        display_name(F.col("qualifier"), F.col("function_name")).alias("display_name"),
        F.array_join("arguments.kind", ",").alias("kinds"),
        F.size("arguments").alias("n_arguments"),
        F.col("ordinal").cast("bigint").alias("ordinal"),
    )


def calls_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calls(tables.page_scripts(spark, sf_dir)).drop("language", "qualifier", "ordinal")


def calls_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calls(corpus(spark, sf_dir))


def assignments_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.assignments(corpus(spark, sf_dir)).select(
        "path", "language", F.col("ordinal").cast("bigint").alias("ordinal"), "line", "col",
        "variable", "value.kind", "value.text",
    )


def call_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.call_arguments(corpus(spark, sf_dir)).select(
        "path", "function_name", "argument_no", "kind", "text"
    )


def source_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.source_health(altered_corpus(spark, sf_dir))


def units_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select(
        "path", "language", F.octet_length("content").cast("bigint").alias("n_bytes")
    )


def gen001_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return tables.text_credentials(documents, "doc_id", "text").select(
        F.col("path").alias("doc_id"), "line", "col", "variable", "value"
    )


def findings_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(_scan(spark, sf_dir)).select(
        *_NUMBERED[:1], F.col("finding_no").cast("bigint").alias("finding_no"), *_NUMBERED[2:]
    )


def _debug_output(context: Context) -> DataFrame:
    noisy = F.col("function_name").isin("print", "println", "log")
    return context.calls.filter(noisy).select(
        F.lit("DBG001").alias("vulnerability_rule_id"),
        F.lit("Debug Output").alias("vulnerability_rule_name"),
        F.lit("Debug output left in code.").alias("description"),
        F.lit("Use a logger.").alias("recommendation"),
        F.lit("LOW").alias("severity"),
        F.col("path").alias("source_file_path"),
        F.col("language").alias("programming_language"),
        F.col("line").alias("line_number"),
        F.col("col").alias("column_number"),
    )


def custom_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = RuleSet().unregister(UNSAFE_CODE_EXECUTION)
    rules = rules.register(FunctionRule("DBG001", "Debug Output", "Debug output.", _debug_output))
    return numbered(scan(corpus(spark, sf_dir), rules)).select(
        *_NUMBERED[:1], F.col("finding_no").cast("bigint").alias("finding_no"), *_NUMBERED[2:]
    )


def severity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.severity_summary(_scan(spark, sf_dir))


def findings_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.findings_by_file(_scan(spark, sf_dir))


def rules_detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.rules_detected(_scan(spark, sf_dir))


def code_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = corpus(spark, sf_dir)
    return report.code_context(settled(scan(units)), units).withColumn(
        "finding_no", F.col("finding_no").cast("bigint")
    )


def finding_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = corpus(spark, sf_dir)
    return report.finding_blocks(settled(scan(units)), units).withColumn(
        "finding_no", F.col("finding_no").cast("bigint")
    )


def incremental_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "incremental")
    corpus(spark, sf_dir).repartition(3).write.parquet(f"{folder}/units")
    # Three files, two of them in the first batch.
    scan_stream(
        spark, f"{folder}/units", f"{folder}/findings", f"{folder}/checkpoint", files_per_batch=2
    ).awaitTermination()
    return read_findings(spark, f"{folder}/findings").select(*FINDING_COLUMNS)


def findings_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(_scan(spark, sf_dir)).select("rank", *FINDING_COLUMNS)


def findings_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written twice, as a job that is repeated does, and read back."""
    folder = shared_folder(spark, "sink")
    found = settled(_scan(spark, sf_dir))
    for _ in range(2):
        write(found, folder, "1")
    write(found.filter(F.col("severity") == "CRITICAL"), folder, "2")
    return spark.read.parquet(folder).select("run", *FINDING_COLUMNS)


def no_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scripts of the pages have none."""
    return report.severity_summary(scan(tables.page_scripts(spark, sf_dir)))


def rules_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = RuleSet().table(spark)
    detected = report.rules_detected(_scan(spark, sf_dir)).withColumnRenamed("vulnerability_rule_id", "rule_id")
    return rules.join(detected, "rule_id", "left").select(
        "rule_ordinal", "rule_id", "name", "recommendation", "severity", "n_findings", "n_files"
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "sources_pages": sources_pages,
        "language_detect": language_detect,
        "utf8_rejects": utf8_rejects,
        "read_files": read_files,
        "units_corpus": units_corpus,
        "tokens_pages": tokens_pages,
        "assignments_pages": assignments_pages,
        "calls_pages": calls_pages,
        "assignments_corpus": assignments_corpus,
        "calls_corpus": calls_corpus,
        "call_arguments": call_arguments,
        "source_health": source_health,
        "gen001_documents": gen001_documents,
        "gen001_corpus": _one_rule(HARDCODED_CREDENTIALS),
        "gen002_corpus": _one_rule(UNSAFE_CODE_EXECUTION),
        "gen003_corpus": _one_rule(COMMAND_INJECTION),
        "findings_all": findings_all,
        "custom_rule": custom_rule,
        "severity_summary": severity_summary,
        "findings_by_file": findings_by_file,
        "rules_detected": rules_detected,
        "code_context": code_context,
        "finding_blocks": finding_blocks,
        "incremental_findings": incremental_findings,
        "findings_rank": findings_rank,
        "findings_sink": findings_sink,
        "no_findings": no_findings,
        "rules_overview": rules_overview,
        **({"pipeline": corpus_pipeline.run, **llm.queries()} if llm else {}),
    }


_SCRIPTS = r"""WITH bodies AS (
  SELECT page_id, regexp_extract_all(html, '<script[^>]*>([\s\S]*?)</script>', 1) AS b FROM pages
),
scripts AS (
  SELECT 'pages/' || page_id || '/script' || (n - 1) || '.js' AS path, b[n] AS content
  FROM (SELECT page_id, b, unnest(range(1, len(b) + 1)) AS n FROM bodies)
)"""

_SUPPORTED = "\n".join(f"  • {name:<10} ({suffix})" for name, suffix in catalog.LANGUAGES)


def _unsupported(suffix: str) -> str:
    return f"'Unsupported file extension ''' || {suffix} || '''.\n\nSupported languages:\n{_SUPPORTED}'"


def oracle_sql() -> dict[str, str]:
    names = ", ".join(f"'{name}'" for name in catalog.CREDENTIAL_NAMES)
    return {
        "sources_pages": f"{_SCRIPTS} SELECT path, 'javascript' AS language, content FROM scripts",
        "language_detect": f"""
WITH p AS (
  SELECT 'src/part' || p_partkey || CASE p_partkey % 7 WHEN 0 THEN '.py' WHEN 1 THEN '.JAVA'
           WHEN 2 THEN '.js' WHEN 3 THEN '.Js' WHEN 4 THEN '.c' WHEN 5 THEN '' ELSE '/.py' END AS path,
         CASE p_partkey % 7 WHEN 0 THEN '.py' WHEN 1 THEN '.JAVA' WHEN 2 THEN '.js' WHEN 3 THEN '.Js'
           WHEN 4 THEN '.c' ELSE '' END AS suffix,
         CASE p_partkey % 7 WHEN 0 THEN 'python' WHEN 1 THEN 'java' WHEN 2 THEN 'javascript'
           WHEN 3 THEN 'javascript' END AS language
  FROM part
)
SELECT path, suffix, language, CASE WHEN language IS NULL THEN 'UNSUPPORTED' END AS reason,
       CASE WHEN language IS NULL THEN {_unsupported("suffix")} END AS message
FROM p""",
        "utf8_rejects": f"""
WITH p AS (
  SELECT p_partkey AS k, 'src/part' || p_partkey || CASE WHEN p_partkey % 3 = 0 THEN '.c' ELSE '.py' END AS path
  FROM part
)
SELECT path, CASE WHEN k % 11 = 0 THEN 'MISSING' WHEN k % 3 = 0 THEN 'UNSUPPORTED' ELSE 'INVALID_UTF8' END AS reason,
       CASE WHEN k % 11 = 0 THEN 'File not found: ' || path WHEN k % 3 = 0 THEN {_unsupported("'.c'")}
         ELSE 'File is not valid utf-8: ' || path END AS message
FROM p WHERE k % 11 = 0 OR k % 3 = 0 OR k % 5 = 0""",
        "tokens_pages": _SCRIPTS
        + r""",
parts AS (
  SELECT path, regexp_extract_all(content, '\s*(?:"[^"]*"|[A-Za-z_]+|[0-9]+|[^\s])') AS e FROM scripts
),
toks AS (SELECT path, n - 1 AS pos, e[n] AS el FROM (SELECT path, e, unnest(range(1, len(e) + 1)) AS n FROM parts)),
placed AS (
  SELECT *, trim(el) AS tok,
         sum(length(el)) OVER (PARTITION BY path ORDER BY pos) - length(trim(el)) AS off,
         sum(CASE WHEN trim(el) = '(' THEN 1 WHEN trim(el) = ')' THEN -1 ELSE 0 END)
           OVER (PARTITION BY path ORDER BY pos) AS depth_after
  FROM toks
)
SELECT path, CAST(pos AS INTEGER) AS pos, tok, CAST(1 AS INTEGER) AS line, CAST(off + 1 AS INTEGER) AS col,
       CAST(off AS BIGINT) AS char_off, CAST(off AS BIGINT) AS byte_off,
       CAST(depth_after - CASE WHEN tok = '(' THEN 1 WHEN tok = ')' THEN -1 ELSE 0 END AS INTEGER) AS depth
FROM placed""",
        "assignments_pages": f"""{_SCRIPTS}
SELECT path, 1 AS line, 5 AS col, 't' AS variable, 'STRING' AS kind, '</p>' AS text FROM scripts""",
        "calls_pages": f"""{_SCRIPTS}
SELECT path, 1 AS line, 14 AS col, 'track' AS function_name, 'track' AS display_name, 'UNKNOWN' AS kinds,
       1 AS n_arguments FROM scripts""",
        "gen001_documents": rf"""
WITH found AS (
  SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*\s*=\s*"[^"\n]*"') AS m FROM documents
),
each AS (
  SELECT doc_id, m, regexp_split_to_array(text, '[A-Za-z_][A-Za-z0-9_]*\s*=\s*"[^"\n]*"') AS p,
         unnest(range(1, len(m) + 1)) AS n
  FROM found
),
cut AS (
  SELECT doc_id, m[n] AS hit,
         -- The text before the hit, put together again from what splitting at the hits leaves.
         coalesce(string_agg(p[n] || m[n], '') OVER (PARTITION BY doc_id ORDER BY n
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') || p[n] AS before
  FROM each
),
named AS (
  SELECT *, regexp_extract(hit, '^([A-Za-z0-9_]+)', 1) AS variable,
         regexp_extract(hit, '"([^"\n]*)"$', 1) AS value
  FROM cut
)
SELECT doc_id,
       CAST(length(before) - length(replace(before, chr(10), '')) + 1 AS INTEGER) AS line,
       CAST(strlen(regexp_extract(before, '[^\n]*$')) + 1 AS INTEGER) AS col, variable, value
FROM named WHERE lower(variable) IN ({names}) AND length(value) >= 6""",
        "no_findings": """
SELECT CAST(k AS INTEGER) AS rank, s AS severity, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS total,
       rpad(s, 8, ' ') || ' : 0' AS line, 'No vulnerabilities detected.' AS heading
FROM (VALUES (1, 'LOW'), (2, 'MEDIUM'), (3, 'HIGH'), (4, 'CRITICAL')) AS v(k, s)""",
        **corpus_oracle.statements(),
        **(llm.oracle_sql() if llm else {}),
    }
