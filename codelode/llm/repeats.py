"""Repeated passages by prefix-free parsing (operator 9).

Every byte that lies in a string of LENGTH bytes which starts anywhere else too is removed.

A rolling hash of TRIGGER bytes makes the triggers: in every window of LENGTH bytes the place with the
least hash, the leftmost of equals. (The triggers of a fixed remainder, which leave some windows
without any, can't give exact results.) A window's trigger depends on its own bytes alone, so equal
windows have equal triggers at equal places. A document is parsed into phrases: the stretches of
windows that have the same trigger, in order and without gap. The phrases of all documents, by 128-bit
hash, are the dictionary, and the phrases of each document its parse.

* A trigger that the corpus has once proves all windows of its phrase unique.
* A phrase that occurs twice or more is repeated with all its windows. Long passages consist of such
  phrases but for their ends.
* What is left are phrases whose trigger occurs in other phrases too. These few entries of the
  dictionary are ordered by their windows, so that equal ones come together: the entries of a trigger
  meet in one task, unless there are more than TOGETHER; then their windows are shuffled by hash.

The order of suffixes is needed only to the depth of a window and only as far as it tells equal ones
from others, so equality of 128-bit hashes takes the place of sorted suffix arrays of dictionary and
parse: sorting all suffixes of a dictionary that, in text with few repeats, is about as large as the
corpus would shuffle every byte LENGTH times.

A hot phrase is counted before the shuffle; no group is gathered but the phrases of one document.
Texts are shuffled once, and those with a phrase of the last kind written once more.

Edge cases: null counts as empty; texts shorter than LENGTH have nothing to remove; documents are told
apart by their ids where these are unique and not null, and else by a 64-bit hash of id and text, where rows
that repeat count as several documents; very long texts are parsed in runs of RUN windows, which may end
a phrase early; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.llm.common import settled, strings
from codelode.llm.hashing import BASE, Stretches, mix

LENGTH = 200
TRIGGER = 48
#: Entries of one trigger that are ordered in one task, some 350 bytes each.
TOGETHER = 4096
RUN = 1 << 20
_LOW = np.uint64(0xFFFFFFFF)


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every `width` keys in a row."""
    n = len(keys) - width + 1
    padded = np.full(-(-len(keys) // width) * width, ~np.uint64(0), np.uint64)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    behind = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    return np.minimum(ahead[:n], behind[width - 1 : width - 1 + n])


def phrases(data: bytes, length: int, trigger: int, run: int = RUN) -> Iterator[tuple[np.ndarray, ...]]:
    """(first windows, numbers of windows, trigger hashes, phrase hashes) of the phrases, run by run."""
    for begin in range(0, len(data) - length + 1, run):
        raw = np.frombuffer(data, np.uint8)[begin : begin + run + length - 1]
        rolled = mix(Stretches(raw).all(trigger))
        keys = (rolled & ~_LOW) | np.arange(len(rolled), dtype=np.uint64)
        place = (_least(keys, length - trigger + 1) & _LOW).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        number = np.diff(np.append(first, len(place)))
        at = place[first]
        whole = Stretches(raw, 1).of(first, first + number - 1 + length)
        # With the trigger's place, as equal bytes must also be cut alike.
        whole = mix(mix(whole) + (number.astype(np.uint64) << np.uint64(32)) + (at - first).astype(np.uint64) * BASE)
        yield begin + first, number, rolled[at], whole


def windows(data: bytes, first: int, number: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each of some windows in a row."""
    raw = np.frombuffer(data, np.uint8)[first : first + number - 1 + length]
    return mix(Stretches(raw, 2).all(length)), mix(Stretches(raw, 3).all(length))


def removed(data: bytes, starts: Iterable[tuple[int, int]], length: int) -> tuple[int, int, str]:
    """Bytes and stretches removed, and SHA-256 of the rest, given (first, number) of repeated windows."""
    gone = total = 0
    until, digest = 0, hashlib.sha256()
    for first, number in sorted(starts):
        end = first + number - 1 + length
        if first > until or not gone:
            digest.update(data[until:first])
            gone, total = gone + 1, total + end - first
            until = end
        elif end > until:
            total, until = total + end - until, end
    digest.update(data[until:])
    return total, gone, digest.hexdigest()


_PARSE = "ident long, first int, number int, trigger long, phrase long"


def _parsed(length: int, trigger: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[list[np.ndarray]] = [[] for _ in range(5)]
            size = 0

            def record(held=held) -> pa.RecordBatch:
                joined = [np.concatenate(x) for x in held]
                return pa.RecordBatch.from_arrays(
                    [pa.array(joined[0]), pa.array(joined[1].astype(np.int32)), pa.array(joined[2].astype(np.int32)),
                     pa.array(joined[3].view(np.int64)), pa.array(joined[4].view(np.int64))],
                    ["ident", "first", "number", "trigger", "phrase"],
                )

            for ident, text in zip(batch.column(0).to_pylist(), strings(batch.column(1)), strict=True):
                for part in phrases((text or "").encode("utf-8", "replace"), length, trigger):
                    for column, values in zip(held, (np.full(len(part[0]), ident, np.int64), *part), strict=True):
                        column.append(values)
                    size += len(part[0])
                if size > 50_000:
                    yield record()
                    size = 0
                    for column in held:
                        column.clear()
            if size:
                yield record()

    return run


_SPANS = "array<struct<first: int, number: int>>"
_OPEN = "array<struct<first: int, number: int, copies: long, trigger: long, hot: boolean>>"
_RESULT = "id {id}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_FIRST = _RESULT + f", ident long, text string, known {_SPANS}, open {_OPEN}"


def _first_results(length: int, schema: pa.Schema):
    """Results of documents without open phrases; texts and phrases of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 128):
                rows = []
                for row in batch.slice(low, 128).to_pylist():
                    text = row["text"] or ""
                    data = text.encode("utf-8", "replace")
                    known, left = row["known"] or [], row["open"] or []
                    found = (None, None, None) if left else removed(data, ((s["first"], s["number"]) for s in known), length)
                    rows.append({
                        "id": row["id"], "n_bytes": len(data), "n_removed": found[0], "n_spans": found[1],
                        "kept_sha256": found[2], "ident": row["ident"], "text": text if left else None,
                        "known": known if left else None, "open": left or None,
                    })
                yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def _open_windows(length: int):
    """The windows of open phrases, each with its hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ident, text, left = (batch.column(k)[row].as_py() for k in range(3))
                data = text.encode("utf-8", "replace")
                for span in left:
                    a, b = windows(data, span["first"], span["number"], length)
                    n = len(a)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, ident, np.int64)), pa.array(np.arange(span["first"], span["first"] + n, dtype=np.int32)),
                         pa.array(np.full(n, span["copies"], np.int64)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))],
                        ["ident", "first", "copies", "a", "b"],
                    )

    return run


_ENTRY = "ident long, first int, number int, copies long, trigger long, bytes binary"


def _open_entries(length: int, schema: pa.Schema):
    """The bytes of open phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ident, text, left = (batch.column(k)[row].as_py() for k in range(3))
                data = text.encode("utf-8", "replace")
                yield pa.RecordBatch.from_pylist([
                    {**{k: span[k] for k in ("first", "number", "copies", "trigger")}, "ident": ident,
                     "bytes": data[span["first"] : span["first"] + span["number"] - 1 + length]}
                    for span in left
                ], schema)

    return run


def repeated_runs(entries: list[tuple[int, int, int, bytes]], length: int) -> Iterator[tuple[int, int, int]]:
    """(entry, first, number) of runs of repeated windows of entries (first, number, copies, bytes)."""
    first, number, copies = (np.array([e[k] for e in entries], np.int64) for k in range(3))
    raw = np.frombuffer(b"".join(e[3] for e in entries), np.uint8)
    ends = np.cumsum([len(e[3]) for e in entries])
    entry = np.repeat(np.arange(len(entries)), number)
    within = np.arange(len(entry)) - np.repeat(np.cumsum(number) - number, number)
    starts = np.repeat(np.concatenate([[0], ends[:-1]]), number) + within
    a, b = (Stretches(raw, table).of(starts, starts + length) for table in (2, 3))
    order = np.lexsort((b, a))
    new = np.concatenate([[True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])])
    group = np.cumsum(new) - 1
    total = np.bincount(group, weights=np.repeat(copies, number)[order])
    again = np.zeros(len(order), bool)
    again[order] = total[group] > 1
    hit = np.flatnonzero(again)
    cut = np.flatnonzero((np.diff(hit) != 1) | (np.diff(entry[hit]) != 0)) + 1
    for run in np.split(hit, cut) if len(hit) else ():
        k = int(entry[run[0]])
        yield k, int(first[k] + within[run[0]]), len(run)


def _ordered_entries(length: int, block: int = 2 << 20):
    """Runs of repeated windows of entries that come sorted by trigger."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None

        def record(found: list[tuple[int, int, int]]) -> pa.RecordBatch:
            columns = list(zip(*found, strict=True)) or [(), (), ()]
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32())],
                ["ident", "first", "number"],
            )

        def flush() -> pa.RecordBatch:
            runs = repeated_runs([x[1:] for x in held], length)
            return record([(held[k][0], first, number) for k, first, number in runs])

        for batch in batches:
            for row in batch.to_pylist():
                if size >= block and row["trigger"] != last:
                    yield flush()
                    held.clear()
                    size = 0
                held.append((row["ident"], row["first"], row["number"], row["copies"], row["bytes"]))
                size, last = size + len(row["bytes"]), row["trigger"]
        if held:
            yield flush()

    return run


def _last_results(length: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 128):
                rows = []
                for row in batch.slice(low, 128).to_pylist():
                    data = row["text"].encode("utf-8", "replace")
                    starts = [(s["first"], s["number"]) for s in row["known"] or []]
                    starts += [(s["first"], s["number"]) for s in row["found"] or []]
                    total, gone, digest = removed(data, starts, length)
                    rows.append({"id": row["id"], "n_bytes": len(data), "n_removed": total, "n_spans": gone, "kept_sha256": digest})
                yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def _identity(docs: DataFrame) -> Column:
    """What tells documents apart: the id, unless some ids are null or occur twice."""
    rows, ids, distinct = docs.agg(F.count(F.lit(1)), F.count("id"), F.count_distinct("id")).first()
    if rows == ids == distinct and dict(docs.dtypes)["id"] in ("bigint", "int", "smallint", "tinyint"):
        return F.col("id").cast("long")
    return F.xxhash64(F.col("id"), F.col("text"))


def _repeated(parse: DataFrame) -> DataFrame:
    """(ident, known, open): of each document the phrases that are repeated whole, and those that may be in part."""
    counts = (
        parse.groupBy("trigger")
        .agg(F.count(F.lit(1)).alias("n"), F.min("phrase").alias("least"), F.max("phrase").alias("most"))
        .filter("n > 1")
        .select("trigger", (F.col("least") < F.col("most")).alias("mixed"))
    )
    shared = settled(parse.join(counts, "trigger"), "shared-phrases")
    # The dictionary's entries whose triggers occur in several entries, each with one place.
    entries = settled(
        shared.filter("mixed").groupBy("trigger", "phrase")
        .agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("ident", "first", "number")).alias("place")),
        "mixed-phrases",
    )
    whole = shared.filter("not mixed").select("ident", "first", "number").unionByName(
        shared.filter("mixed").join(entries.filter("copies > 1").select("trigger", "phrase"), ["trigger", "phrase"], "left_semi")
        .select("ident", "first", "number")
    )
    sizes = entries.groupBy("trigger").agg((F.count(F.lit(1)) > TOGETHER).alias("hot"))
    known = whole.distinct().groupBy("ident").agg(F.collect_list(F.struct("first", "number")).alias("known"))
    left = entries.join(sizes, "trigger").select(
        "place.ident", "place.first", "place.number", "copies", "trigger", "hot"
    ).groupBy("ident").agg(F.collect_list(F.struct("first", "number", "copies", "trigger", "hot")).alias("open"))
    return known.join(left, "ident", "full")


def _runs(unsettled: DataFrame, length: int) -> DataFrame:
    """(ident, first, number) of the repeated windows of open phrases."""
    # Rows that repeat have one identity; one of them will do.
    by_kind = [
        unsettled.select("ident", "text", F.filter("open", lambda s: s["hot"] == hot).alias("open")).filter(F.size("open") > 0)
        for hot in (False, True)
    ]
    few = by_kind[0].mapInArrow(_open_entries(length, _arrow_schema(_ENTRY)), _ENTRY)
    together = (
        few.repartition("trigger").sortWithinPartitions("trigger")
        .mapInArrow(_ordered_entries(length), "ident long, first int, number int")
    )
    seen = settled(
        by_kind[1].mapInArrow(_open_windows(length), "ident long, first int, copies long, a long, b long"), "open-windows"
    )
    twice = seen.groupBy("a", "b").agg(F.sum("copies").alias("n")).filter("n > 1").select("a", "b")
    apart = seen.join(twice, ["a", "b"], "left_semi").select("ident", "first", F.lit(1).alias("number"))
    return together.unionByName(apart)


def without_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, trigger: int = TRIGGER
) -> DataFrame:
    """`key`, `n_bytes`, `n_removed`, `n_spans` (maximal removed runs) and `kept_sha256` of every document."""
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    rows = rows.withColumn("ident", _identity(rows))
    long = rows.filter(F.octet_length("text") >= length).select("ident", "text")
    parse = settled(long.mapInArrow(_parsed(length, trigger), _PARSE), "parse")
    found = rows.join(_repeated(parse), "ident", "left").select("id", "ident", "text", "known", "open")
    arrow = _arrow_schema(_FIRST.format(id=kind))
    first = settled(found.mapInArrow(_first_results(length, arrow), _FIRST.format(id=kind)), "first-results")
    unsettled = first.filter("open is not null")
    hits = _runs(unsettled, length).groupBy("ident").agg(F.collect_list(F.struct("first", "number")).alias("found"))
    last = unsettled.join(hits, "ident", "left").select("id", "text", "known", "found")
    result = pa.schema(list(arrow)[:5])
    return (
        first.filter("open is null").select("id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
        .unionByName(last.mapInArrow(_last_results(length, result), _RESULT.format(id=kind)))
        .withColumnRenamed("id", key)
    )


def _arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))
