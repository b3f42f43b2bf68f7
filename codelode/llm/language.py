"""Language identification by multinomial naive Bayes over hashed character n-grams (operator 6).

Spark counts the n-grams of every language over all training rows: each task adds up its own rows
into one vector per language, and only bucket counts are shuffled. The matrix of log probabilities has
2**BITS rows and a column for each language, so its size doesn't grow with the documents; it is
broadcast. Scoring takes the rows of the matrix that a batch's n-grams hit (a sparse product) in numpy.

Edge cases: a null text or one without a letter is `und` with score 0; without any training row every
document is `und`; of equally good languages the first in order wins; a null id is neither held out
nor learned from; rows that repeat count and are returned as often as they occur; only the named
columns are used, so further columns don't matter. A very long text is cut in runs of `RUN` characters
that overlap by an n-gram, whose scores add up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.llm.common import strings

BITS = 15
ORDERS = 3
RUN = 1 << 18
UNKNOWN = "und"
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.uint32(32)


@cache
def _letters() -> np.ndarray:
    """For every code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _points(text: str) -> np.ndarray:
    """Lower-case letters, every run of other characters as one blank, a blank at both ends."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    points = np.concatenate([[_SPACE], np.where(_letters()[points], points, _SPACE), [_SPACE]])
    keep = points != _SPACE
    if not keep.any():
        return points[:0]
    keep[1:] |= points[:-1] != _SPACE
    keep[0] = True
    return points[keep]


def grams(text: str | None) -> Iterator[np.ndarray]:
    """The buckets of the n-grams of a text, run by run; nothing for a text without a letter."""
    points = _points(text) if text else np.zeros(0, np.uint32)
    for start in range(0, max(0, len(points) - 1), RUN):
        run = points[start : start + RUN + ORDERS - 1].astype(np.uint64)
        found, value = [], np.zeros(len(run), np.uint64)
        for order in range(1, ORDERS + 1):
            value = (value[: len(run) - order + 1] * _FACTOR + run[order - 1 :] + np.uint64(order)) * _FACTOR
            value ^= value >> np.uint64(29)
            # Starts beyond the run belong to the next one.
            found.append(((value[:RUN] * _FACTOR) >> np.uint64(64 - BITS)).astype(np.int32))
        yield np.concatenate(found)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's rows (text, lang): (lang, bucket, n), and the number of documents with an n-gram as bucket -1."""
    counts: dict[str, np.ndarray] = {}
    documents: dict[str, int] = {}
    for batch in batches:
        for text, lang in zip(strings(batch.column(0)), strings(batch.column(1)), strict=True):
            seen = False
            for run in grams(text):
                if lang not in counts:
                    counts[lang] = np.zeros(1 << BITS, np.int64)
                counts[lang] += np.bincount(run, minlength=1 << BITS)
                seen = True
            # Documents without letters count nowhere, whatever else a task has read.
            documents[lang] = documents.get(lang, 0) + seen
    for lang, vector in counts.items():
        hit = np.flatnonzero(vector)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * (len(hit) + 1)), pa.array(np.append(hit, -1).astype(np.int32)),
             pa.array(np.append(vector[hit], documents[lang]))], ["lang", "bucket", "n"],
        )


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    log_prior: np.ndarray
    log_gram: np.ndarray  # bucket by language


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", smoothing: float = 0.5) -> Model:
    """Count the n-grams of all rows that have a text and a language."""
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    table = (
        rows.filter("text is not null and lang is not null")
        .mapInArrow(_count, "lang string, bucket int, n long")
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
        .toArrow()  # no more than 2**BITS + 1 rows a language
    )
    names = table.column("lang").to_pylist()
    languages = tuple(sorted(set(names)))
    place = {name: k for k, name in enumerate(languages)}
    counts = np.zeros(((1 << BITS) + 1, len(languages)))
    counts[table.column("bucket").to_numpy(), [place[n] for n in names]] = table.column("n").to_numpy()
    documents, counts = counts[-1], counts[:-1] + smoothing
    return Model(languages, np.log(documents / max(1, documents.sum())), np.log(counts / counts.sum(axis=0)))


def score(texts: Iterator[str | None], model: Model) -> list[tuple[str, float]]:
    """Language and posterior probability of each text."""
    result = []
    for text in texts:
        total, seen = model.log_prior, False
        for run in grams(text) if model.languages else ():
            total, seen = total + model.log_gram.take(run, axis=0).sum(axis=0), True
        if not seen:
            result.append((UNKNOWN, 0.0))
            continue
        best = int(total.argmax())
        result.append((model.languages[best], float(1 / np.exp(total - total[best]).sum())))
    return result


def predicted(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """A struct of `lang_pred` and `score` of a text column, from the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def of(texts: pa.Array) -> pa.Array:
        found = score(strings(texts), shared.value)
        return pa.StructArray.from_arrays(
            [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
            ["lang_pred", "score"],
        )

    return F.arrow_udf(of, "lang_pred string, score double")(F.col(text))


def held_out(key: str = "doc_id", folds: int = 5) -> Column:
    """Whether a document isn't learned from: the checksum of its id is a multiple of `folds`."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % folds == 0, F.lit(False))


def identify(
    docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 5
) -> DataFrame:
    """`key`, `held_out`, `lang_pred` and `score` of every document; learned from the others' `lang`."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    model = learn(rows.filter(F.col("key").isNotNull() & ~held_out("key", folds)))
    return rows.select(
        "key", held_out("key", folds).alias("held_out"), predicted(rows, model).alias("found")
    ).select(F.col("key").alias(key), "held_out", "found.lang_pred", "found.score")
