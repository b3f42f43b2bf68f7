"""Token counts with overlap resynchronisation (operator 4).

A text of up to CHUNK characters is encoded whole. A longer one is cut in chunks that overlap, all
chunks are encoded on their own, spread over the cluster, and neighbours are spliced at the first
place in their overlap that is a token boundary of both and proven stable: a blank or line feed behind
other than white space, where neither side of the text can influence the other (see `pieces`). If an
overlap has no such place, the text is taken again with chunks and overlaps four times as long, until
its last resort, the whole text in one chunk. So the count always is that of the whole text.

Edge cases: null counts as empty, 0 tokens; special strings in a text are what the library takes them
for by default; long texts are told apart by their SHA-256, so null or repeated ids and repeated texts
don't matter and every row gets its count; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelode.llm.common import settled, strings
from codelode.llm.pieces import encoder, library

CHUNK = 1 << 15
OVERLAP = 256
_STABLE = re.compile(r"(?<=\S)(?=[ \n])")


def token_count(tokenizer: str, text: str = "text") -> Column:
    """The number of tokens of texts that are encoded whole."""

    def of(texts: pa.Array) -> pa.Array:
        own = encoder(tokenizer)
        return pa.array([len(ids) // own.kind.itemsize for ids in own.encode(strings(texts))], pa.int64())

    return F.arrow_udf(of, "long")(F.col(text))


def chunks(text: str, chunk: int, overlap: int) -> Iterator[tuple[int, int, str]]:
    """(number, start, text) of the chunks; each but the last reaches `overlap` into the next."""
    for number, start in enumerate(range(0, max(1, len(text)), chunk)):
        yield number, start, text[start : start + chunk + overlap]


def boundaries(tokenizer: str, start: int, text: str, low: int, high: int) -> tuple[int, list[int], list[int]]:
    """Tokens of a chunk; its stable token boundaries in [low, high] and the tokens before each.

    Places are counted in characters of the whole document.
    """
    encoding = library(tokenizer).encode(text, add_special_tokens=False)
    begins = np.array([a for a, _ in encoding.offsets], np.int64)
    places = np.array([m.start() for m in _STABLE.finditer(text)], np.int64)
    places = places[(places + start >= low) & (places + start <= high)]
    before = np.searchsorted(begins, places, "left")
    inside = before < len(begins)
    places, before = places[inside], before[inside]
    exact = begins[before] == places
    return len(begins), (places[exact] + start).tolist(), before[exact].tolist()


def _cut(chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                key, text = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                for number, start, part in chunks(text, chunk, overlap):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key]), pa.array([number], pa.int32()), pa.array([start], pa.int64()), pa.array([part])],
                        ["key", "number", "start", "part"],
                    )

    return run


_SIDE = "array<struct<place: long, before: long>>"
_ENCODED = f"n long, head {_SIDE}, tail {_SIDE}"


def _encoded(tokenizer: str, chunk: int, overlap: int) -> Column:
    """Tokens of a chunk and the stable boundaries in its overlap with the chunk before and after."""
    side = pa.list_(pa.struct([("place", pa.int64()), ("before", pa.int64())]))

    def of(starts: pa.Array, parts: pa.Array) -> pa.Array:
        rows = []
        for start, part in zip(starts.to_pylist(), strings(parts), strict=True):
            n, places, before = boundaries(tokenizer, start, part, start, start + chunk + overlap)
            both = [{"place": p, "before": b} for p, b in zip(places, before, strict=True)]
            rows.append({
                "n": n,
                "head": [x for x in both if x["place"] <= start + overlap],
                "tail": [x for x in both if x["place"] >= start + chunk],
            })
        return pa.array(rows, pa.struct([("n", pa.int64()), ("head", side), ("tail", side)]))

    return F.arrow_udf(of, _ENCODED)(F.col("start"), F.col("part"))


def _spliced(encoded: DataFrame) -> DataFrame:
    """(key, n_tokens); n_tokens is null where two neighbours share no stable boundary.

    A chunk counts from the place where it takes over to the place where the next one does.
    """
    order = Window.partitionBy("key").orderBy("number")
    next_head = F.lead("head").over(order)
    common = F.filter("tail", lambda x: F.exists(F.col("next"), lambda y: y["place"] == x["place"]))
    met = F.when(F.col("next").isNotNull(), F.get(common, F.lit(0)))
    there = F.filter("next", lambda y: y["place"] == F.col("met.place"))
    spliced = (
        encoded.withColumn("next", next_head).withColumn("met", met)
        # What this chunk has before the splice, and what the next one has there already.
        .withColumn("own", F.when(F.col("next").isNull(), F.col("n")).otherwise(F.col("met.before")))
        .withColumn("skipped", F.when(F.col("next").isNull(), 0).otherwise(F.get(there, F.lit(0))["before"]))
    )
    whole = F.count("own") == F.count(F.lit(1))
    return spliced.groupBy("key").agg(F.when(whole, F.sum(F.col("own") - F.col("skipped"))).alias("n_tokens"))


def long_counts(texts: DataFrame, tokenizer: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(key, n_tokens) of long texts given as (key, text)."""
    done, left = None, texts
    while True:
        parts = left.mapInArrow(_cut(chunk, overlap), "key string, number int, start long, part string")
        # By key and number, so that the chunks of one text go to many tasks; copies of it go away.
        spread = parts.dropDuplicates(["key", "number"])
        encoded = spread.select("key", "number", _encoded(tokenizer, chunk, overlap).alias("x"))
        counted = settled(_spliced(encoded.select("key", "number", "x.*")), "token-counts")
        found = counted.filter("n_tokens is not null")
        done = found if done is None else done.unionByName(found)
        failed = counted.filter("n_tokens is null").select("key")
        if failed.isEmpty():
            return done
        left = left.join(failed, "key", "left_semi")
        chunk, overlap = 4 * chunk, 4 * overlap


def token_counts(
    docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", limit: int = 512,
    chunk: int = CHUNK, overlap: int = OVERLAP,
) -> DataFrame:
    """`key`, `n_bytes`, `n_tokens` and `over_limit` (more than `limit` tokens) of every document."""
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = F.octet_length("text").cast("long").alias("n_bytes")
    is_long = F.char_length("text") > chunk
    counted = rows.filter(~is_long).select("id", size, token_count(tokenizer).alias("n_tokens"))
    long = rows.filter(is_long).withColumn("key", F.sha2("text", 256))
    counts = long_counts(long.select("key", "text"), tokenizer, chunk, overlap)
    joined = long.select("id", size, "key").join(counts, "key").select("id", "n_bytes", "n_tokens")
    return counted.unionByName(joined).select(
        F.col("id").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
