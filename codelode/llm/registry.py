"""The queries of this subpackage and, where SQL can express them, their DuckDB statements.

Tokenizer files must lie at the same path on every node. The key of the surrogates is a parameter of
the operator; the one used here stands for a secret.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.llm import (
    centroids,
    fingerprints,
    hard_negatives,
    language,
    mixing,
    near_duplicates,
    packing,
    quality,
    repeats,
    sentence_pieces,
    surrogates,
    token_counts,
    token_files,
)
from codelode.llm.common import documents

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SURROGATE_KEY = "codelode-demonstration-key"

#: The hot source is held down, four others are raised, and the rest share what is left.
MIXTURE = mixing.Mixture({"src0": 0.10, "src1": 0.10, "src2": 0.10, "src3": 0.10, "src4": 0.20}, others=0.40)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(documents(spark, sf_dir))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(documents(spark, sf_dir), MIXTURE)


def op3_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    back = sentence_pieces.round_trip(docs, PIECES)
    return back.select(
        "doc_id", "n_pieces", "piece_ids", "decoded", F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip")
    )


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), BYTE_BPE)


def op5_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replaced(documents(spark, sf_dir), SURROGATE_KEY)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(spark, sf_dir))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.written_and_read(documents(spark, sf_dir), BYTE_BPE)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprinted(documents(spark, sf_dir))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(documents(spark, sf_dir))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.components(documents(spark, sf_dir), width=4)


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, label = F.col("vec_id"), F.col("label").cast("long")
    moved = F.when(key % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives.mined(
        embeddings(spark, sf_dir), "vec_id", F.col("embedding"), moved, F.col("key") % 100 == 0, scale=256
    )


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered(
        embeddings(spark, sf_dir), "vec_id", F.col("embedding"), components=64, scale=1024, n=8, rounds=10, seed="3"
    )


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir), WORD_BPE)


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            op1_quality_rules, op2_source_mixing, op3_sentence_pieces, op4_token_counts, op5_surrogates,
            op6_language_id, op7_token_files, op8_fingerprints, op9_repeats, op10_near_duplicates,
            op11_hard_negatives, op12_centroids, op13_packing,
        )
    }


def _uniform(purpose: str, *parts: str) -> str:
    keyed = " || '|' || ".join((f"'{MIXTURE.seed}|{purpose}'", *parts))
    return f"CAST(('0x' || substr(md5({keyed}), 1, 13)) AS BIGINT) / 4503599627370496.0"


def _mixing_statement() -> str:
    """Poisson quantiles by cumulated probabilities, as a table of its own."""
    names = ", ".join(f"'{name}'" for name in sorted(MIXTURE.weights))
    weight = " ".join(f"WHEN '{name}' THEN {value!r}" for name, value in sorted(MIXTURE.weights.items()))
    return f"""
WITH counted AS (
  SELECT CASE WHEN source IN ({names}) THEN source END AS bucket, count(*) AS n FROM documents GROUP BY 1
),
weighted AS (
  SELECT bucket, n, CAST(CASE bucket {weight} ELSE {MIXTURE.others!r} END AS DOUBLE) AS weight FROM counted
),
rated AS (
  SELECT bucket, weight / (SELECT sum(weight) FROM weighted) * (SELECT CAST(sum(n) AS BIGINT) FROM weighted)
    * CAST({MIXTURE.size!r} AS DOUBLE) / n AS rate
  FROM weighted
),
numbers AS (
  SELECT bucket, rate, unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 30) AS BIGINT) + 1)) AS k FROM rated
),
cumulated AS (
  SELECT bucket, rate, sum(exp(k * ln(rate) - rate - lgamma(CAST(k + 1 AS DOUBLE)))) OVER (PARTITION BY bucket ORDER BY k) AS c
  FROM numbers
),
drawn AS (
  SELECT doc_id, text, lang, source, n_chars, CASE WHEN source IN ({names}) THEN source END AS bucket,
         {_uniform("copies", "doc_id")} AS u
  FROM documents
),
counts AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, any_value(c.rate) AS rate,
         CAST(count(*) FILTER (WHERE c.c <= d.u) AS INTEGER) AS copies
  FROM drawn d JOIN cumulated c ON d.bucket IS NOT DISTINCT FROM c.bucket
  GROUP BY d.doc_id, d.text, d.lang, d.source, d.n_chars
),
copied AS (
  SELECT *, CAST(unnest(range(1, copies + 1)) AS INTEGER) AS copy FROM counts
)
SELECT doc_id, text, lang, source, n_chars, copy, copies, rate, {_uniform("place", "doc_id", "copy")} AS place
FROM copied"""


def oracle_sql() -> dict[str, str]:
    return {"op2_source_mixing": _mixing_statement()}
