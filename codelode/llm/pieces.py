"""Token ids of byte-level BPE by way of the distinct pieces of the texts.

A text may be cut in front of a blank or a line feed that follows other than white space: no
alternative of the pattern that splits text before the merges matches across that place, its only
look-ahead sees white space there on either side, and added tokens hold no white space. So each piece
can be encoded on its own. A task hands the library every distinct piece once and keeps what it gave.
"""

from __future__ import annotations

import os
import re
import string
from array import array
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: White space twice running, where a blank or line feed is no place to cut.
_DOUBLE = re.compile(r"\s[ \n]")
_CUT = re.compile(r"(?<=\S)(?=[ \n])")
#: White space other than a single blank or line feed; a text without any needs no closer look.
_OTHER_SPACE = ("  ", "\n ", " \n", "\n\n", *"\t\r\v\f\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000",
                *map(chr, range(0x2000, 0x200B)))
#: Pieces that are remembered.
REMEMBERED = 700_000
#: Pieces longer than that are encoded where they occur and not remembered.
LONGEST = 64
#: Signs that the splitting pattern keeps in one unit behind letters, and how many such units are remembered.
MARKS = string.punctuation
MARKS_KEPT = 50_000


@cache
def library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def cut(text: str) -> list[str]:
    if "\0" in text or any(space in text for space in _OTHER_SPACE) and _DOUBLE.search(text):
        return [piece for piece in _CUT.split(text) if piece]
    pieces = text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")
    return pieces if pieces[0] else pieces[1:]


def _alphabet() -> dict[int, str]:
    """The characters that stand for bytes in byte-level vocabularies: bytes that can't be seen are moved."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [byte for byte in range(256) if byte not in seen]
    return {byte: chr(256 + k) for k, byte in enumerate(hidden)}


class Encoder:
    """Ids of texts as little-endian bytes, two bytes each (four for vocabularies beyond 65,536).

    Most pieces are a run of letters, with a line feed or blank in front and marks behind, which the
    splitting pattern takes apart in just this way. The library's model encodes such runs without the
    library having to split them, and marks are learned once. All other pieces go through the whole library.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = library(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        # Pieces of late, and those before them, which come back if they are met again.
        self.known: dict[str, bytes] = {}
        self.earlier: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {"": b""}
        self.alphabet = _alphabet()
        self.line = self._whole(["\n"])[0]
        self.plain = True
        probes = ["a", " the", " Zürich,", "\nWord", "Naïve!", "\n日本語.", " ſœß?", " ẞ", " foo).", "x'", " a***", "\nb_-"]
        added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.plain = all(any(char.isalpha() for char in text) for text in added) and (
            self._learned(probes) == dict(zip(probes, self._whole(probes), strict=True))
        )

    def _ids(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def _whole(self, pieces: list[str]) -> list[bytes]:
        return [self._ids(e.ids) for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _mark(self, marks: str) -> bytes:
        """The ids of a few marks in a row."""
        found = self.marks.get(marks)
        if found is None:
            found = self._whole([marks])[0]
            if len(self.marks) < MARKS_KEPT:
                self.marks[marks] = found
        return found

    def _learned(self, pieces: Iterable[str]) -> dict[str, bytes]:
        """The ids of pieces that aren't known: a line feed or blank (or none), letters and marks (or none),
        or anything else."""
        known, marked, alphabet, code = self.known, self._mark, self.alphabet, self.code
        tokenize = self.tokenizer.model.tokenize
        found: dict[str, bytes] = {}
        others = []
        for piece in pieces:
            body = piece.rstrip(MARKS) if self.plain and len(piece) <= LONGEST else ""
            first = body[:1]
            letters = body[1:] if first == " " or first == "\n" else body
            if not letters.isalpha():
                others.append(piece)
                continue
            run = letters if first == "\n" else body
            ids = None if run is piece else known.get(run) or found.get(run)
            if ids is None:
                if letters.isascii():
                    spelled = letters if run is letters else "Ġ" + letters
                else:
                    spelled = run.encode().decode("latin-1").translate(alphabet)
                ids = array(code, [token.id for token in tokenize(spelled)]).tobytes()
            if first == "\n":
                ids = self.line + ids
            if body is not piece:
                ids += marked(piece[len(body) :])
            found[piece] = ids
        found.update(zip(others, self._whole(others), strict=True))
        return found

    def encode(self, texts: Iterable[str | None], block: int = 1 << 20) -> Iterator[bytes]:
        """The ids of each text; null gives none. `block`: characters that are cut at the same time."""
        waiting: list[list[str]] = []
        held = 0
        for text in texts:
            waiting.append(cut(text) if text else [])
            held += len(text or "")
            if held >= block:
                yield from self._flush(waiting)
                waiting, held = [], 0
        yield from self._flush(waiting)

    def _flush(self, waiting: list[list[str]]) -> Iterator[bytes]:
        get = self.known.get
        found = [list(map(get, pieces)) for pieces in waiting]
        gaps = [[k for k, ids in enumerate(row) if ids is None] for row in found]
        wanted = {pieces[k] for pieces, gap in zip(waiting, gaps, strict=True) for k in gap}
        new = {piece: self.earlier[piece] for piece in wanted if piece in self.earlier}
        new.update(self._learned(wanted.difference(new)))
        for pieces, row, gap in zip(waiting, found, gaps, strict=True):
            for k in gap:
                row[k] = new[pieces[k]]
            yield b"".join(row)
        if len(self.known) + len(new) > REMEMBERED // 2:
            self.known, self.earlier = {}, self.known
        self.known.update(new)
        for piece in new:
            if len(piece) > LONGEST:
                del self.known[piece]


@cache
def encoder(path: str) -> Encoder:
    """One for each Python worker, so that what it remembers serves the next task too."""
    return Encoder(path)
