"""From raw documents to token ids, in stages that each write a table and read it back.

    STAGES       (name, function) with function(spark, docs, sf_dir) -> DataFrame
    run          applies them to `documents`
    ORACLE_SQL   None: SQL can't express the estimation of rules or near duplicates; see tests/llm

All stages but the last return the columns of `documents`, and each works on all that the one before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.llm import mixing, near_duplicates, quality, registry, sentence_pieces, surrogates
from codelode.llm.common import documents, settled


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or are more likely bad than good go."""
    return quality.good_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the least id."""
    return near_duplicates.first_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes surrogates; `n_chars` follows the text."""
    changed = surrogates.replaced(docs, registry.SURROGATE_KEY)
    return changed.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights of their sources, in a random order."""
    return mixing.mixed(docs, registry.MIXTURE).select(*docs.columns)


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids of pieces, and whether these decode to the text again."""
    back = sentence_pieces.round_trip(docs, registry.PIECES)
    return back.select(
        "doc_id", "lang", "source", "n_chars", "n_pieces", "piece_ids",
        F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"),
    )


STAGES = [
    ("quality rules", quality_rules),
    ("minhash near-dedup", near_dedup),
    ("pii surrogates", personal_data),
    ("source mixture", source_mixture),
    ("sentence pieces", piece_ids),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = settled(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
