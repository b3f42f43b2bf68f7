"""Plain versions of the operators, for comparison on small tables."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_figures(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def shingle_set(text: str | None, width: int) -> frozenset:
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    if len(words) < width:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def components(rows: list[tuple[int, str | None]], width: int) -> dict[int, int]:
    """The least id reachable over links of a similarity of 0.8 or more, by testing all pairs."""
    sets = [(i, shingle_set(t, width)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def top(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            common = len(a & b)
            if a and b and 100 * common >= 80 * (len(a) + len(b) - common):
                x, y = top(i), top(j)
                parent[max(x, y)] = min(x, y)
    return {i: top(i) for i, _ in rows}


def without_repeats(rows: list[tuple[int | None, str | None]], length: int) -> dict:
    """Bytes, removed bytes, removed runs and SHA-256 of the rest of every row, by id."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    starts = Counter(b[k : k + length] for _, b in texts for k in range(len(b) - length + 1))
    found: dict = {}
    for i, b in texts:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if starts[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        found.setdefault(i, []).append((len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return {i: sorted(v) for i, v in found.items()}


def hard_negatives(rows: list[tuple]) -> list[tuple]:
    """Rows of the mining contract from usable rows (vec_id, vector, label), by all products."""
    rows = [(k, [math.floor(256 * x) for x in v], (l + 1) % 10 if k % 7 == 0 else l) for k, v, l in rows]
    found = []
    for n, (anchor, a, label) in enumerate(rows):
        if anchor % 100:
            continue
        scored = sorted(
            (-sum(p * q for p, q in zip(a, v)), k, m)
            for m, (k, v, _) in enumerate(rows) if len(v) == len(a) and m != n
        )
        same = [x for x in scored if rows[x[2]][2] == label][:5]
        other = [x for x in scored if rows[x[2]][2] != label]
        for score, positive, _ in same:
            fits = [x for x in other if -80 * score <= -100 * x[0] <= -100 * score][:5]
            found += [(anchor, positive, r, k, -score, -s) for r, (s, k, _) in enumerate(fits, 1)]
    return found


def clusters(rows: list[tuple], dims: int, n: int, rounds: int) -> list[tuple]:
    """Rows of the clustering contract from rows (vec_id, vector, ...)."""
    kept = [
        (k, [math.floor(1024 * x) for x in v]) for k, v, *_ in rows
        if v and len(v) == dims and all(x is not None and abs(x) < 32768 for x in v)
    ]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest()))[:n]
    centres = [v for _, v in first]

    def nearest(v: list[int]) -> tuple[int, int]:
        return min((sum((p - q) ** 2 for p, q in zip(v, c)), k) for k, c in enumerate(centres))

    for _ in range(rounds):
        groups: dict[int, list] = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for k, group in groups.items():
            centres[k] = [sum(column) // len(group) for column in zip(*group)]
    found = [(k, *nearest(v)) for k, v in kept]
    inertia = Counter()
    for _, far, cluster in found:
        inertia[cluster] += far
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return [(k, c, far, inertia[c], sum(inertia.values()), names[c]) for k, far, c in found]
