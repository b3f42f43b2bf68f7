"""Token ids in files of a range asymmetric numeral system (operator 7).

Documents are sorted by id over the cluster, encoded and packed in segments of whole documents. A
segment has one static table of frequencies, made from all its ids, and blocks that share the table
but are independent of each other otherwise. In a block, ids are dealt over many lanes, each with a
state of its own, whose words are interleaved in one stream; numpy works on all lanes at a time. The
directory of a segment holds a checkpoint for each block (its place in the stream and the lanes'
states) and checksums of the directory and of each block's ids, so that blocks can be read in any
order and in parallel, and a damaged one is noticed.

Layout of a segment, little-endian:

    magic "CLRA", version u8, bits u8, blocks u32, ids u64, bytes of the table u32, crc32 of what follows up to the words u32
    table: zlib of symbols u32 in ascending order, then their frequencies u32 (sum 2**bits)
    for each block: ids u32, lanes u32, words u32, crc32 of the ids as u32 numbers u32
    for each block: states of its lanes u64
    words u32 of all blocks

Segments are rows of Parquet files, written by Spark's writer to any store that it reaches, beside the
ids and token numbers of their documents.

Edge cases: null counts as empty, so has the end id alone; rows with a null id come first; rows of one
id are ordered by text (null first); rows that repeat are written as often as they occur; an empty table gives no
segment. A document is never split between segments, so a very long one makes its own segment larger.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codelode.llm.common import strings
from codelode.llm.pieces import encoder
from codelode.sources.shared import shared_folder

LANES = 2048
BLOCK = 1 << 19
SEGMENT = 1 << 21
END = 0

_MAGIC, _VERSION = b"CLRA", 1
_HEAD = struct.Struct("<4sBBIQII")
_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)


def frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Symbols in ascending order, their frequencies (each at least 1) and the bits of their sum."""
    symbols, counts = np.unique(ids, return_counts=True)
    bits = max(14, int(len(symbols)).bit_length() + 2)
    share = np.maximum(1, counts * (1 << bits) // max(1, len(ids)))
    over = int(share.sum()) - (1 << bits)
    if over < 0:
        share[share.argmax()] -= over
    while over > 0:
        # Rare symbols were raised to 1; the frequent ones give way.
        for place in np.argsort(-share, kind="stable"):
            less = min(over, int(share[place]) // 4)
            if not less:
                break
            share[place] -= less
            over -= less
    return symbols.astype(np.uint32), share.astype(np.uint32), bits


def _encode_block(codes: np.ndarray, share: np.ndarray, start: np.ndarray, bits: int, lanes: int):
    """Final states and words of a block; codes are places in the table."""
    state = np.full(lanes, _LOW, np.uint64)
    shift, room = np.uint64(bits), np.uint64(63 - bits)
    words = []
    for low in range((len(codes) - 1) // lanes * lanes, -1, -lanes):
        code = codes[low : low + lanes]
        x, f = state[: len(code)], share[code]
        full = x >= (f << room)
        words.append(x[full].astype(np.uint32))
        x[full] >>= _WORD
        whole = x // f
        x[:] = (whole << shift) + (x - whole * f) + start[code]
    return state, np.concatenate(words[::-1])


def pack(ids: np.ndarray, lanes: int = LANES, block: int = BLOCK) -> bytes:
    """The segment of some ids."""
    symbols, share, bits = frequencies(ids) if len(ids) else (np.zeros(0, np.uint32), np.zeros(0, np.uint32), 14)
    place = np.zeros(int(symbols[-1]) + 1 if len(symbols) else 1, np.int32)
    place[symbols] = np.arange(len(symbols), dtype=np.int32)
    wide = share.astype(np.uint64)
    start = np.cumsum(wide) - wide
    directory, states, words = [], [], []
    for low in range(0, len(ids), block):
        part = ids[low : low + block]
        # Few ids need few lanes, as each costs its state.
        state, word = _encode_block(place[part], wide, start, bits, max(1, min(lanes, len(part) >> 7)))
        directory.append((len(part), len(state), len(word), zlib.crc32(part.astype("<u4").tobytes())))
        states.append(state.astype("<u8").tobytes())
        words.append(word.astype("<u4").tobytes())
    table = zlib.compress(symbols.astype("<u4").tobytes() + share.astype("<u4").tobytes(), 1)
    body = table + np.array(directory, "<u4").tobytes() + b"".join(states)
    head = _HEAD.pack(_MAGIC, _VERSION, bits, len(directory), len(ids), len(table), zlib.crc32(body))
    return b"".join([head, body, *words])


class Segment:
    """A packed segment; its blocks can be decoded on their own and in any order."""

    def __init__(self, data: bytes) -> None:
        magic, version, self.bits, blocks, self.n_ids, table, checksum = _HEAD.unpack_from(data)
        if magic != _MAGIC or version != _VERSION:
            raise ValueError("This is not a segment of token ids.")
        at = _HEAD.size + table
        self.directory = np.frombuffer(data, "<u4", 4 * blocks, at).reshape(blocks, 4).astype(np.int64)
        self._states = at + 16 * blocks
        lanes = int(self.directory[:, 1].sum())
        self._words = self._states + 8 * lanes
        if zlib.crc32(data[_HEAD.size : self._words]) != checksum:
            raise ValueError("The directory of a segment is damaged.")
        pair = np.frombuffer(zlib.decompress(data[_HEAD.size : at]), "<u4").reshape(2, -1)
        self._symbols, self._share = pair[0], pair[1].astype(np.uint64)
        self._start = np.cumsum(self._share) - self._share
        self._code = np.repeat(np.arange(len(pair[0]), dtype=np.int32), pair[1])
        self._data = data

    def block(self, number: int) -> np.ndarray:
        n, lanes, n_words, checksum = (int(x) for x in self.directory[number])
        before = self.directory[:number].sum(axis=0)
        state = np.frombuffer(self._data, "<u8", lanes, self._states + 8 * int(before[1])).astype(np.uint64)
        words = np.frombuffer(self._data, "<u4", n_words, self._words + 4 * int(before[2])).astype(np.uint64)
        shift, mask = np.uint64(self.bits), np.uint64((1 << self.bits) - 1)
        codes, read = np.empty(n, np.int32), 0
        for low in range(0, n, lanes):
            x = state[: min(lanes, n - low)]
            slot = x & mask
            code = self._code[slot.astype(np.int64)]
            codes[low : low + len(x)] = code
            x[:] = self._share[code] * (x >> shift) + slot - self._start[code]
            few = np.flatnonzero(x < _LOW)
            x[few] = (x[few] << _WORD) | words[read : read + len(few)]
            read += len(few)
        ids = self._symbols[codes]
        if zlib.crc32(ids.tobytes()) != checksum:
            raise ValueError(f"Block {number} of a segment is damaged.")
        return ids

    def ids(self) -> np.ndarray:
        blocks = [self.block(k) for k in range(len(self.directory))]
        return np.concatenate(blocks) if blocks else np.zeros(0, np.uint32)


def _packer(tokenizer: str, segment: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        tail = np.array([end], own.kind).tobytes()
        part, number, start, total = TaskContext.get().partitionId(), 0, 0, 0
        keys, sizes, held = [], [], []

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), own.kind).astype(np.uint32)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([start], pa.int64()),
                 pa.array([len(ids)], pa.int64()), pa.array([keys], pa.list_(pa.int64())),
                 pa.array([sizes], pa.list_(pa.int64())), pa.array([pack(ids)], pa.binary())],
                ["part", "segment", "start", "n_ids", "keys", "sizes", "payload"],
            )

        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), own.encode(strings(batch.column(1))), strict=True):
                keys.append(key)
                held.append(ids + tail)
                sizes.append(len(held[-1]) // own.kind.itemsize)
                total += sizes[-1]
                if total >= segment:
                    yield flush()
                    number, start, total = number + 1, start + total, 0
                    keys, sizes, held = [], [], []
        if keys:
            yield flush()

    return run


_FILE = "part int, segment int, start long, n_ids long, keys array<long>, sizes array<long>, payload binary"


def write(
    docs: DataFrame, tokenizer: str, folder: str, key: str = "doc_id", text: str = "text", end: int = END,
    segment: int = SEGMENT,
) -> None:
    """Write the ids of all documents, each followed by `end`, in ascending order of the integer key."""
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    ordered = rows.repartitionByRange("key").sortWithinPartitions("key", "text")
    ordered.mapInArrow(_packer(tokenizer, segment, end), _FILE).write.option("compression", "none").parquet(folder)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            part, start, keys, sizes, payload = (batch.column(k)[row].as_py() for k in range(5))
            ids = Segment(payload).ids().astype("<u4")
            stops = np.cumsum(sizes)
            raw = ids.tobytes()
            crcs = [zlib.crc32(raw[4 * (b - n) : 4 * b]) for b, n in zip(stops.tolist(), sizes, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(keys), pa.int32()), pa.array(keys, pa.int64()),
                 pa.array(start + stops - np.array(sizes), pa.int64()), pa.array(sizes, pa.int64()),
                 pa.array(crcs, pa.int64())],
                ["part", "key", "start", "n_tokens", "ids_crc32"],
            )


def read_documents(spark: SparkSession, folder: str, key: str = "doc_id") -> DataFrame:
    """From the files: `key`, `start` (ids of all documents before), `n_tokens`, `ids_crc32`."""
    files = spark.read.schema(_FILE).parquet(folder)
    sums = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # One row for each file that was written.
    before = sums.select(
        F.col("part").alias("p"),
        (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"),
    )
    found = files.select("part", "start", "keys", "sizes", "payload").mapInArrow(
        _unpacked, "part int, key long, start long, n_tokens long, ids_crc32 long"
    )
    return found.join(F.broadcast(before), found["part"] == before["p"]).select(
        F.col("key").alias(key), (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )


def written_and_read(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the files to the shared folder and read them back."""
    folder = shared_folder(docs.sparkSession, "token-files")
    write(docs, tokenizer, folder, key, text)
    return read_documents(docs.sparkSession, folder, key)
