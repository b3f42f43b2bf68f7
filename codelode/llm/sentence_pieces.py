"""Encoding and decoding with SentencePiece models by a shared-prefix Viterbi search (operator 3).

A text becomes marked words (a marker for each blank, one in front of the text), as no piece reaches
from other characters over a marker. The distinct words of a block of documents are sorted, which
puts them in the order of a depth-first walk through their trie; the forward entries of the characters
that a word shares with the one before are kept, so that every node of the trie is computed once.

The forward entry of a prefix is the last piece of its best segmentation and that segmentation's score:

* unigram models: the score is the sum of the pieces' scores;
* BPE models: a segmentation counts if the merges leave each of its boundaries alone, that is, if
  encoding two neighbouring pieces alone gives these two again. Of each prefix exactly one
  segmentation has this property, and it is the one that the merges make. (The best sum of a BPE
  model's scores, which are mere ranks, would be another segmentation than the model's own.)

An entry also holds a node of an automaton over the model's pieces, which knows all pieces that end there.

Characters that no piece has become one piece per byte (byte fallback) or the unknown piece.

Supported are models without a text normaliser of their own (identity). Edge cases: null gives null
ids and text, empty gives none and empty; further columns come along, the added ones step aside; rows
that repeat are encoded as often as they occur; a very long word costs time in proportion to its length.
A decoded text equals the encoded one unless the model lacks byte fallback or the text has the marker
itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.llm.common import by_size, free_name, strings

MARK = "▁"
#: Characters of text whose words are sorted and walked through together.
BLOCK = 2 << 20
#: Words that a worker remembers between blocks, and their longest length.
REMEMBERED = 200_000
LONGEST = 48
#: Pairs of pieces whose boundary a worker remembers.
PAIRS = 150_000
#: Ids that are decoded together.
IDS = 1 << 20

_NORMAL, _UNKNOWN, _USER, _BYTE = 1, 2, 4, 6
_UNIGRAM, _BPE = 1, 2
_NOTHING = -float("inf")


class _Node:
    """The longest start of a piece that a text ends with, and the pieces that the text ends with, longest first."""

    __slots__ = ("text", "pieces", "following")

    def __init__(self, text: str, pieces: tuple[str, ...]) -> None:
        self.text, self.pieces = text, pieces
        self.following: dict[str, _Node] = {}


class Model:
    """The pieces of a model file and what its forward entries need."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        normal = proto.normalizer_spec
        if normal.precompiled_charsmap or normal.remove_extra_whitespaces or not normal.escape_whitespaces:
            raise ValueError("Models with a normaliser of their own aren't supported.")
        if proto.trainer_spec.model_type not in (_UNIGRAM, _BPE):
            raise ValueError("Only unigram and BPE models are supported.")
        self.bpe = proto.trainer_spec.model_type == _BPE
        self.prefix = normal.add_dummy_prefix
        self.ids = {p.piece: k for k, p in enumerate(proto.pieces) if p.type in (_NORMAL, _USER)}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("Models with pieces of several words aren't supported.")
        self.score = {p: proto.pieces[k].score for p, k in self.ids.items()}
        self.unknown = next(k for k, p in enumerate(proto.pieces) if p.type == _UNKNOWN)
        self.unknown_score = min(self.score.values()) - 10
        self.bytes = {int(p.piece[1:-1], 16): k for k, p in enumerate(proto.pieces) if p.type == _BYTE}
        self.pieces = [
            bytes([int(p.piece[1:-1], 16)]) if p.type == _BYTE
            else p.piece.replace(MARK, " ").encode() if p.type in (_NORMAL, _USER)
            else " ⁇ ".encode() if p.type == _UNKNOWN else b""
            for p in proto.pieces
        ]
        # The pieces as they are, and behind them once more as they stand at a start, without the first blank.
        starts = [p[1:] if self.prefix and p[:1] == b" " else p for p in self.pieces]
        self._spelled = pa.array(self.pieces + starts, pa.large_binary())
        self._empty = np.array([not p for p in self.pieces])
        self._starts = {p[:end] for p in self.ids for end in range(len(p) + 1)}
        self._nodes: dict[str, _Node] = {}
        self._root = self._node("")
        self._packed = {p: self._pack([k]) for p, k in self.ids.items()}
        self._sides: dict[str, tuple | None] = {}
        self._stays: dict[tuple[str, str], bool] = {}
        self.known: dict[str, bytes] = {}

    @staticmethod
    def _pack(ids: list[int]) -> bytes:
        return np.array(ids, "<i4").tobytes()

    def _node(self, text: str) -> _Node:
        """The node of a text, which need not be the start of a piece itself."""
        while text not in self._starts:
            text = text[1:]
        found = self._nodes.get(text)
        if found is None:
            ends = (text[k:] for k in range(len(text)))
            found = self._nodes[text] = _Node(text, tuple(p for p in ends if p in self.score))
        return found

    def _sides_of(self, piece: str) -> tuple | None:
        """How the merges that make a piece change its last and its first part; None if they don't make it.

        For either side, steps (score, part): the part that stands there after merges of at least this score.
        """
        if piece in self._sides:
            return self._sides[piece]
        parts = list(piece)
        last, first = [(0.0, parts[-1])], [(0.0, parts[0])]
        least_last = least_first = -_NOTHING
        while len(parts) > 1:
            best, at = _NOTHING, -1
            for k in range(len(parts) - 1):
                score = self.score.get(parts[k] + parts[k + 1])
                if score is not None and score > best:
                    best, at = score, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            least_last, least_first = min(least_last, best), min(least_first, best)
            if at == len(parts) - 1:
                last.append((least_last, parts[-1]))
                least_last = -_NOTHING
            if at == 0:
                first.append((least_first, parts[0]))
                least_first = -_NOTHING
        found = (tuple(last), tuple(first)) if len(parts) == 1 else None
        self._sides[piece] = found
        return found

    def stays(self, left: str, right: str) -> bool:
        """Whether merges make both pieces and keep the boundary between them. `left` is empty at a start.

        Merges inside the pieces go on in the order of their scores, of equal ones the leftmost, until the
        parts at the boundary have a better score together.
        """
        if not left:
            return self._sides_of(right) is not None
        pair = (left, right)
        found = self._stays.get(pair)
        if found is None:
            if len(self._stays) >= PAIRS:
                self._stays.clear()
            found = self._stays[pair] = self._kept_apart(left, right)
        return found

    def _kept_apart(self, left: str, right: str) -> bool:
        sides, others = self._sides_of(left), self._sides_of(right)
        if sides is None or others is None:
            return False
        last, first = sides[0], others[1]
        i = j = 0
        while True:
            score = self.score.get(last[i][1] + first[j][1])
            next_left = last[i + 1][0] if i + 1 < len(last) else _NOTHING
            next_right = first[j + 1][0] if j + 1 < len(first) else _NOTHING
            if score is not None and score > next_left and score >= next_right:
                return False
            if next_left == next_right == _NOTHING:
                return True
            if next_left >= next_right:
                i += 1
            else:
                j += 1

    def entry(self, word: str, end: int, entries: list[tuple[float, str, _Node]]) -> tuple[float, str, _Node]:
        """The forward entry of `word[:end]`, given those of all shorter prefixes."""
        char, node = word[end - 1], entries[-1][2]
        following = node.following.get(char)
        if following is None:
            following = self._node(node.text + char)
            if following is not self._root:  # characters without a piece have no bound
                node.following[char] = following
        if self.bpe:
            for piece in following.pieces:
                if self.stays(entries[end - len(piece)][1], piece):
                    return 0.0, piece, following
            return 0.0, char, following
        best, last = entries[end - 1][0] + self.score.get(char, self.unknown_score), char
        for piece in following.pieces:
            score = entries[end - len(piece)][0] + self.score[piece]
            if score > best:
                best, last = score, piece
        return best, last, following

    def _ids_of(self, piece: str) -> bytes:
        """The ids of a character that is no piece."""
        return self._pack([self.bytes[b] for b in piece.encode()] if self.bytes else [self.unknown])

    def walk(self, words: Iterable[str]) -> Iterator[tuple[str, bytes]]:
        """The ids of sorted distinct words; entries of a shared prefix are computed once."""
        before, entries, packed = "", [(0.0, "", self._root)], self._packed
        for word in words:
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del entries[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                entries.append(self.entry(word, end, entries))
            ids: list[bytes] = []
            end = len(word)
            while end:
                piece = entries[end][1]
                ids.append(packed.get(piece) or self._ids_of(piece))
                end -= len(piece)
            yield word, b"".join(reversed(ids))
            before = word

    def words(self, text: str) -> list[str]:
        """The marked words of a text, which together are the whole marked text."""
        marked = (MARK if self.prefix else "") + text.replace(" ", MARK)
        if MARK + MARK in marked:
            return re.findall(f"{MARK}+[^{MARK}]*|[^{MARK}]+", marked)
        parts = marked.split(MARK)
        return ([parts[0]] if parts[0] else []) + [MARK + p for p in parts[1:]]

    def packed(self, texts: Iterable[str | None], block: int = BLOCK) -> Iterator[bytes | None]:
        """The ids of each text as little-endian 32-bit numbers."""
        waiting: list[list[str] | None] = []
        held = 0
        for text in texts:
            waiting.append(None if text is None else self.words(text) if text else [])
            held += len(text or "")
            if held >= block:
                yield from self._flush(waiting)
                waiting, held = [], 0
        yield from self._flush(waiting)

    def _flush(self, waiting: list[list[str] | None]) -> Iterator[bytes | None]:
        distinct = set().union(*(words for words in waiting if words))
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        known.update(self.walk(sorted(w for w in distinct if w not in known)))
        for words in waiting:
            yield None if words is None else b"".join(map(known.__getitem__, words))
        for word in distinct:
            if len(word) > LONGEST:
                del known[word]

    def encode(self, texts: Iterable[str | None], block: int = BLOCK) -> Iterator[list[int] | None]:
        for ids in self.packed(texts, block):
            yield None if ids is None else np.frombuffer(ids, "<i4").tolist()

    def encoded(self, texts: Iterable[str | None]) -> pa.Array:
        """The ids of texts as lists in one buffer."""
        ids = list(self.packed(texts))
        ends = np.cumsum([0, *(len(x or b"") // 4 for x in ids)], dtype=np.int32)
        missing = pa.array([x is None for x in ids], pa.bool_())
        numbers = np.frombuffer(b"".join(x for x in ids if x), "<i4")
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(numbers, pa.int32()), mask=missing)

    def decode(self, ids: Iterable[int]) -> str:
        text = b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text

    def decoded(self, column: pa.Array) -> pa.Array:
        """The texts of lists of ids."""
        column = column.cast(pa.list_(pa.int32()))
        ends = np.cumsum([0, *column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)])
        done, low = [], 0
        while low < len(column):
            high = max(low + 1, int(np.searchsorted(ends, ends[low] + IDS, "right")) - 1)
            done.append(self._decoded_together(column.slice(low, high - low), ends[low : high + 1] - ends[low]))
            low = high
        return pa.concat_arrays(done) if done else pa.array([], pa.string())

    def _decoded_together(self, column: pa.Array, ends: np.ndarray) -> pa.Array:
        values = column.flatten()  # without what null rows may hold
        ids = values.to_numpy(zero_copy_only=False)
        firsts = ends[:-1][np.diff(ends) > 0]
        if not values.null_count and not (ids < 0).any() and not self._empty[ids[firsts]].any():
            at_start = ids.astype(np.int64)
            at_start[firsts] += len(self.pieces)
            spelled = self._spelled.take(pa.array(at_start))
            places = np.frombuffer(spelled.buffers()[1], "<i8", len(spelled) + 1, 8 * spelled.offset)
            texts = pa.Array.from_buffers(
                pa.string(), len(column),
                [None, pa.py_buffer(places[ends].astype("<i4").tobytes()), spelled.buffers()[2]],
            )
            try:
                texts.validate(full=True)
            except pa.ArrowInvalid:  # bytes that are no text
                pass
            else:
                return pc.if_else(column.is_null(), pa.scalar(None, pa.string()), texts)
        return pa.array((None if x is None else self.decode(x) for x in strings(column)), pa.string())


@cache
def model(path: str) -> Model:
    """One for each Python worker."""
    return Model(path)


def piece_ids(path: str, text: str) -> Column:
    """The ids of a text column."""

    def of(texts: pa.Array) -> pa.Array:
        return model(path).encoded(strings(texts))

    return F.arrow_udf(of, "array<int>")(F.col(text))


def text_of(path: str, ids: str) -> Column:
    """The text of a column of ids."""

    def of(column: pa.Array) -> pa.Array:
        return model(path).decoded(column)

    return F.arrow_udf(of, "string")(F.col(ids))


def there_and_back(path: str, text: str) -> Column:
    """A struct of the `ids` of a text column and the `text` that these decode to."""

    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = model(path)
        for texts in batches:
            for part in by_size(texts, BLOCK):
                ids = own.encoded(strings(part))
                yield pa.StructArray.from_arrays([ids, own.decoded(ids)], ["ids", "text"])

    return F.arrow_udf(of, "ids array<int>, text string")(F.col(text))


def encoded(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """The documents with `piece_ids` and `n_pieces`."""
    ids, n = free_name(docs, "piece_ids"), free_name(docs, "n_pieces")
    return docs.withColumn(ids, piece_ids(path, text)).withColumn(n, F.size(ids))


def decoded(docs: DataFrame, path: str, ids: str = "piece_ids") -> DataFrame:
    """The documents with the `decoded` text of their ids."""
    return docs.withColumn(free_name(docs, "decoded"), text_of(path, ids))


def round_trip(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """The documents with `piece_ids`, `n_pieces` and the `decoded` text of these ids, in one pass.

    `decoded` of `encoded` gives the same rows, but Spark then joins the two functions into one
    call beside the first, so that every text is encoded twice.
    """
    names = [free_name(docs, wanted) for wanted in ("piece_ids", "n_pieces", "decoded")]
    both = there_and_back(path, text)
    new = zip((both["ids"], F.size(both["ids"]), both["text"]), names, strict=True)
    return docs.select("*", *(column.alias(name) for column, name in new))
