"""Packing of documents into sequences by minimum bin slack (operator 13).

1. Every document becomes pieces of at most `capacity` tokens. The task that makes them numbers the
   pieces of each length, so that a piece is known by (task, length, number).
2. The pieces are counted by length. That table has at most `capacity` rows, whatever the input.
3. Sequences are filled one after the other. Each takes the longest piece there is, and a subset-sum
   computation over the available lengths, with a bit set of the reachable sums, finds the fullest
   combination that can stand beside it; of equally full ones that of the longest pieces. That combination
   is taken away. It stays the fullest for as long as all its lengths last, so it is taken as often as they do;
   each time one length at least runs out, so there are no more than `capacity` combinations.
4. The pieces of a length are dealt to the places of the combinations by their rank among all pieces of
   that length, which is their number in the task and the count of the tasks before.

No text and no id is shuffled; no step depends on how many pieces share a length.

Edge cases: null counts as empty, so has the end id alone; rows that repeat (and rows with a null id) are packed
each on its own; a very long text makes many pieces; an empty table gives no row.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelode.llm.common import settled, strings

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

CAPACITY = 2048
END = 0
#: Words that a worker remembers, and their longest length.
REMEMBERED = 800_000
LONGEST = 64

#: Letters whose lower case is one letter, and that no normal form takes apart and puts together otherwise.
_LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch


def _byte_alphabet() -> dict[int, str]:
    """The characters that stand for bytes in byte-level vocabularies: bytes that can't be seen are moved."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [byte for byte in range(256) if byte not in seen]
    return {byte: chr(256 + k) for k, byte in enumerate(hidden)}


_ALPHABET = _byte_alphabet()


class _Known(dict):
    """The ids of words; a word that isn't there yet is looked up once by `learn`."""

    def __init__(self, learn) -> None:
        self.learn = learn

    def __missing__(self, word: str) -> bytes:
        ids = self.learn(word)
        if len(word) <= LONGEST:
            self[word] = ids
        return ids


class WordEncoder:
    """Ids (little-endian, 32 bits) of texts whose tokens never reach over white space.

    Made for tokenizers that drop white space: every word between blanks and line feeds is encoded on its
    own, each distinct one once. Other white space stays in a word and is left to the library.

    The library's model encodes runs of Latin letters, which the tokenizer only makes lower-case; a mark
    behind such a run is a unit of its own. All other words go through the whole library.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # As `add_special_tokens=False` asks; padding and truncation of the file would change the ids.
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.runs, self.known = _Known(self._letters), _Known(self._word)
        self.marks = {mark: self._whole(mark) for mark in ".,;:!?"}
        probe = "One  two\nthree, it's 4567 <|endoftext|>x Éá ß?!\n\n(don't)"
        self.by_word = self._whole(probe) == b"".join(map(self._whole, self._words(probe)))
        probes = ["a", "The.", "Zürich,", "ÀÖØÞß", "naïve?", "x;"]
        self.plain = all(self._split(p) == self._whole(p) for p in probes)

    @staticmethod
    def _words(text: str) -> list[str]:
        return text.replace("\n", " ").split(" ")

    def _whole(self, word: str) -> bytes:
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def _letters(self, run: str) -> bytes:
        """The ids of a lower-case run of Latin letters."""
        spelled = run if run.isascii() else run.encode().decode("latin-1").translate(_ALPHABET)
        return array("I", [token.id for token in self.tokenizer.model.tokenize(spelled)]).tobytes()

    def _split(self, word: str) -> bytes | None:
        """The ids of a run of Latin letters and a mark (or none); None for other words."""
        end = self.marks.get(word[-1:], b"")
        run = word[:-1] if end else word
        return self.runs[run.lower()] + end if _LATIN(run) else None

    def _word(self, word: str) -> bytes:
        found = self._split(word) if self.plain else None
        return self._whole(word) if found is None else found

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text; null and empty texts have none."""
        for text in texts:
            if not text:
                yield b""
            elif self.by_word:
                yield b"".join(map(self.known.__getitem__, self._words(text)))
            else:
                yield self._whole(text)
            for known in (self.known, self.runs):
                if len(known) > REMEMBERED:
                    known.clear()


@cache
def encoder(path: str) -> WordEncoder:
    """One for each Python worker."""
    return WordEncoder(path)


def _cutter(tokenizer: str, capacity: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = encoder(tokenizer), TaskContext.get().partitionId()
        tail = array("I", [end]).tobytes()
        numbers = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            keys, pieces, starts, lengths, sums, ranks = [], [], [], [], [], []
            for key, ids in zip(batch.column(0).to_pylist(), own.encode(strings(batch.column(1))), strict=True):
                ids += tail
                for piece, low in enumerate(range(0, len(ids), 4 * capacity)):
                    own_ids = ids[low : low + 4 * capacity]
                    length = len(own_ids) // 4
                    keys.append(key)
                    pieces.append(piece)
                    starts.append(low // 4)
                    lengths.append(length)
                    sums.append(zlib.crc32(own_ids))
                    ranks.append(numbers[length])
                    numbers[length] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()),
                 pa.array(lengths, pa.int64()), pa.array(sums, pa.int64()),
                 pa.array([part] * len(keys), pa.int32()), pa.array(ranks, pa.int64())],
                ["key", "piece", "start", "length", "ids_crc32", "part", "number"],
            )

    return run


def pieces(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", end: int = END
) -> DataFrame:
    """The pieces of all documents, settled, each with its number among those of its length in its task."""
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    schema = "key long, piece int, start long, length long, ids_crc32 long, part int, number long"
    return settled(rows.mapInArrow(_cutter(tokenizer, capacity, end), schema), "pieces")


def fullest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """The lengths, and how often each, of the fullest combination of at most `room`; longest lengths first."""
    reach, mask = 1, (1 << (room + 1)) - 1
    # Shortest first: the last set that a sum is missing in tells the longest piece that can be its last.
    steps = []
    for length in sorted(counts):
        if length > room:
            break
        left, size = min(counts[length], room // length), 1
        while left:
            times = min(size, left)
            steps.append((length, times, reach))
            reach |= (reach << (length * times)) & mask
            left, size = left - times, 2 * size
    total, taken = reach.bit_length() - 1, {}
    for length, times, before in reversed(steps):
        # A sum that can be had without these pieces is left to shorter ones only if it must be.
        if total >= length * times and before >> (total - length * times) & 1:
            taken[length] = taken.get(length, 0) + times
            total -= length * times
    return sorted(taken.items(), reverse=True)


def combinations(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """How often each combination is used, and its lengths with how often each stands in it."""
    counts = {length: n for length, n in counts.items() if n}
    plan = []
    while counts:
        first = max(counts)
        beside = counts | {first: counts[first] - 1}
        chosen = dict(fullest(beside, capacity - first))
        chosen[first] = chosen.get(first, 0) + 1
        times = min(counts[length] // n for length, n in chosen.items())
        plan.append((times, sorted(chosen.items(), reverse=True)))
        for length, n in chosen.items():
            counts[length] -= times * n
            if not counts[length]:
                del counts[length]
    return plan


def _places(plan: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """For each stretch of ranks of a length: where it begins, how many stand in a sequence, its first sequence
    and the place there; in the order of (length, first rank)."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for times, lengths in plan:
        offset = 0
        for length, n in lengths:
            rows.append((length, used.get(length, 0), n, sequence, offset))
            used[length] = used.get(length, 0) + times * n
            offset += n * length
        sequence += times
    rows.sort()
    names = ("length", "rank", "each", "sequence", "offset")
    return {name: np.array([row[k] for row in rows], np.int64) for k, name in enumerate(names)}


def packed(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", end: int = END
) -> DataFrame:
    """`key`, `piece`, `start`, `length`, `ids_crc32`, `sequence_id` and `offset` of every piece."""
    found = pieces(docs, tokenizer, capacity, key, text, end)
    counts = settled(found.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    table = counts.groupBy("length").agg(F.sum("n").alias("n")).toArrow()  # a row for each length
    totals = dict(zip(table.column("length").to_pylist(), table.column("n").to_pylist(), strict=True))
    # At most `capacity` combinations of at most sqrt(2 * capacity) lengths.
    places = docs.sparkSession.sparkContext.broadcast(_places(combinations(totals, capacity)))

    def place(lengths: pa.Array, ranks: pa.Array) -> pa.Array:
        own, length, rank = places.value, lengths.to_numpy(), ranks.to_numpy()
        row = np.empty(len(length), np.int64)
        for each in np.unique(length):
            low, high = np.searchsorted(own["length"], [each, each + 1])
            hit = length == each
            row[hit] = low + np.searchsorted(own["rank"][low:high], rank[hit], "right") - 1
        within, n = rank - own["rank"][row], own["each"][row]
        return pa.StructArray.from_arrays(
            [pa.array(own["sequence"][row] + within // n), pa.array(own["offset"][row] + within % n * length)],
            ["sequence_id", "offset"],
        )

    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = found.join(before, ["part", "length"])
    spot = F.arrow_udf(place, "sequence_id long, offset long")(F.col("length"), F.col("number") + F.col("before"))
    return ranked.withColumn("spot", spot).select(
        F.col("key").alias(key), "piece", "start", "length", "ids_crc32", "spot.sequence_id", "spot.offset"
    )
