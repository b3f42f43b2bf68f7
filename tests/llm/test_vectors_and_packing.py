"""Operators 11 to 13 against plain versions on small tables."""

from __future__ import annotations

import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from codelode.llm import centroids, hard_negatives, packing, registry
from codelode.llm.vectors import hilbert
from tests.llm import brute

SCHEMA = "vec_id long, embedding array<float>, label int, key string, row int"


def _table(spark, rows):
    """Rows (vec_id, vector, label) with further columns named like the operators' own."""
    return spark.createDataFrame([(*row, "x", 1) for row in rows], SCHEMA)


def _random_rows(n: int, dims: int, seed: int) -> list[tuple]:
    draw = np.random.default_rng(seed)
    middles = draw.normal(0, 0.4, (5, dims))
    x = (middles[draw.integers(0, 5, n)] + draw.normal(0, 0.15, (n, dims))).astype(np.float32)
    return [(k, x[k].tolist(), int(draw.integers(0, 10))) for k in range(n)]


ODD = [
    (100, None, 1), (200, [], 1), (300, [0.1, None, 0.2, 0.3], 1), (7, [float("nan")] * 4, 1), (400, [0.1] * 4, None),
    (500, [float("inf"), 0.0, 0.0, 0.0], 2), (None, [0.5, 0.5, 0.5, 0.5], 2), (9, [0.5, 0.5], 2), (700, [0.0] * 4, 2),
    (11, [3e38, 0.0, 0.0, 0.0], 2),
]


def _mined(frame, **more):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = hard_negatives.mined(
        frame, "vec_id", F.col("embedding"), moved, F.col("key") % 100 == 0, scale=256, **more
    )
    return sorted(tuple(row) for row in found.collect())


def _usable(rows):
    return [
        (k, v, l) for k, v, l in rows
        if k is not None and v and l is not None and all(x is not None and abs(x) < 1e5 for x in v)
    ]


def test_hard_negatives_equal_brute_force_over_many_trees_and_shards(spark):
    rows = _random_rows(1500, 4, 1) + ODD
    rows += [(2000 + k, [0.25, -0.5, 0.125, 0.75], 3) for k in range(200)]  # ties
    rows += rows[:40]  # repeated rows, anchors among them
    got = _mined(_table(spark, rows), tree=128, shard=300)
    assert got == sorted(brute.hard_negatives(_usable(rows)))
    assert len(got) > 200


def test_hard_negatives_of_long_vectors_with_little_to_prune(spark):
    rows = _random_rows(900, 64, 2)
    assert _mined(_table(spark, rows)) == sorted(brute.hard_negatives(rows))


@pytest.mark.parametrize("rows", [[], ODD[:6], [(100, [0.5, 0.5], 1)], [(100, [0.5], 1), (100, [0.5], 1)]])
def test_hard_negatives_without_any(spark, rows):
    assert _mined(_table(spark, rows)) == []


def test_products_beyond_floating_point_are_exact():
    draw = np.random.default_rng(3)
    x = draw.integers(-(1 << 25), 1 << 25, (300, 6)).astype(np.int64)
    label = draw.integers(0, 3, 300)
    ids = np.arange(300)
    tree = hard_negatives.Tree.build(ids, label, ids, x.astype(np.int32), leaf=8)
    low, high = np.full(300, -(1 << 62)), np.full(300, 1 << 62)
    found = hard_negatives.search([tree], {"vector": x, "label": label, "row": ids, "low": low, "high": high}, False, 5)
    for a in range(300):
        scores = [(-sum(int(p) * int(q) for p, q in zip(x[a], x[b])), b) for b in range(300) if label[b] != label[a]]
        assert [(-s, b) for s, b in sorted(scores)[:5]] == list(zip(found.score[a].tolist(), found.key[a].tolist()))


def test_bounds_of_a_cover_tree_hold_and_its_leaves_are_all_vectors():
    x = np.array([row[1] for row in _random_rows(3000, 6, 4)])
    x = np.floor(x * 256).astype(np.int32)
    ids = np.arange(len(x))
    tree = hard_negatives.Tree.build(ids, ids % 4, ids, x, leaf=16)
    queries = np.floor(np.random.default_rng(5).normal(0, 100, (20, 6))).astype(np.int32)
    low, high = tree.bounds(np.arange(len(tree.nodes)), queries, np.sqrt((queries.astype(float) ** 2).sum(axis=1)))
    for k, node in enumerate(tree.nodes):
        product = queries.astype(np.int64) @ tree.vectors[node["begin"] : node["end"]].T
        assert (low[:, k] <= product.min(axis=1)).all() and (product.max(axis=1) <= high[:, k]).all()
    leaves = tree.nodes[tree.nodes["children"] == 0]
    assert sorted(itertools.chain(*(range(n["begin"], n["end"]) for n in leaves))) == ids.tolist()
    assert sorted(tree.keys) == ids.tolist()


def test_a_narrow_search_opens_few_leaves():
    x = np.floor(np.array([row[1] for row in _random_rows(4000, 3, 6)]) * 256).astype(np.int32)
    ids = np.arange(len(x))
    tree = hard_negatives.Tree.build(ids, ids * 0, ids, x)
    looked, plain = [], hard_negatives.products
    hard_negatives.products = lambda a, b: looked.append(len(b)) or plain(a, b)
    try:
        query = {"vector": x[:1], "label": np.zeros(1, np.int64), "row": ids[:1], "low": np.full(1, -(1 << 62)), "high": np.full(1, 1 << 62)}
        hard_negatives.search([tree], query, True, 5)
    finally:
        hard_negatives.products = plain
    assert sum(looked) < 0.2 * len(x)


def test_neighbours_on_the_curve_are_neighbours_in_space():
    cells = np.array(list(itertools.product(range(8), repeat=3)))
    place = hilbert(cells, 3)
    assert sorted(place) == list(range(512))
    steps = np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(axis=1)
    assert (steps == 1).all()


def _clustered(frame, components, n=8, rounds=10):
    found = centroids.clustered(frame, "vec_id", F.col("embedding"), components, 1024, n, rounds, "3", block=64)
    return sorted((tuple(row) for row in found.collect()), key=str)


@pytest.mark.parametrize("dims", [4, 64])
def test_clusters_equal_brute_force(spark, dims):
    rows = _random_rows(1200, dims, 7) + [row for row in ODD if row[0] is not None]
    rows += [(3000 + k, [0.5] * dims, 1) for k in range(150)] + rows[:30]
    assert _clustered(_table(spark, rows), dims) == sorted(brute.clusters(rows, dims, 8, 10), key=str)


def test_clusters_of_few_vectors_and_of_rows_without_id(spark):
    rows = [(1, [0.5, 0.25], 0), (1, [0.5, 0.25], 0), (None, [0.0, -1.0], 0), (2, [7.0], 0)]
    assert _clustered(_table(spark, rows), 2) == sorted(brute.clusters(rows, 2, 8, 10), key=str)
    assert _clustered(_table(spark, []), 2) == []


def test_boxes_leave_out_only_centroids_that_are_nearest_to_nothing():
    draw = np.random.default_rng(8)
    dropped = 0
    for _ in range(300):
        middle = draw.integers(-200, 200, 5)
        x = middle + draw.integers(-40, 40, (50, 5))
        near = np.concatenate([draw.integers(-200, 200, (6, 5)), x[:1]])
        low, high = x.min(axis=0), x.max(axis=0)
        found = centroids.candidates(low, high, near)
        plain = np.argmin(((x[:, None, :] - near) ** 2).sum(axis=2), axis=1)
        assert set(plain) <= set(found)
        assert (centroids.assign(x, low, high, near) == plain).all()
        dropped += len(near) - len(found)
    assert dropped > 300


def _library():
    return Tokenizer.from_file(registry.WORD_BPE)


def test_words_have_the_ids_of_the_library():
    draw, library = random.Random(9), _library()
    parts = list("aBz 's \n\t\r\x0b\x1c\x85\xa0́éÉ'dDtxX1²Ⅷ漢字ß#!.µªİΣ") + [
        "<|startoftext|>", "<|endoftext|>", "'re", "  ", "Word,", " Über.", "ᄀ", "ᅡ", "ſ", "K",
    ]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 30))) for _ in range(4000)]
    texts += [None, "", " ", "x" * 3000, "é" * 3000, "a.b " * 2000]
    own = packing.WordEncoder(registry.WORD_BPE)
    assert own.by_word and own.plain
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text or "", add_special_tokens=False).ids, text


def test_the_fullest_combination():
    draw = random.Random(10)
    for _ in range(300):
        counts = {draw.randint(1, 30): draw.randint(1, 4) for _ in range(draw.randint(1, 6))}
        room = draw.randint(0, 60)
        chosen = packing.fullest(counts, room)
        assert all(0 < n <= counts[length] for length, n in chosen)
        sums = {0}
        for length, n in counts.items():
            sums = {s + length * k for s in sums for k in range(n + 1) if s + length * k <= room}
        assert sum(length * n for length, n in chosen) == max(sums)


TEXTS = ["one two", "", None, "x" * 50, "word " * 700, "many Words, here. " * 120, "é è " * 300, "one two"]


def _check_packed(rows, texts, capacity):
    """Pieces are the library's ids, and fill sequences without gap."""
    library = _library()
    wanted = []
    for key, text in texts:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, low in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[low : low + capacity], "<u4")
            wanted.append((key, piece, low, len(part), zlib.crc32(part.tobytes())))
    assert sorted(map(str, (tuple(row[:5]) for row in rows))) == sorted(map(str, wanted))
    sequences: dict[int, list[tuple[int, int]]] = {}
    for row in rows:
        sequences.setdefault(row["sequence_id"], []).append((row["offset"], row["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), sum(row["length"] for row in rows)


def _first_fit(lengths: list[int], capacity: int) -> int:
    """Sequences of first fit in decreasing order."""
    room: list[int] = []
    for length in sorted(lengths, reverse=True):
        at = next((k for k, r in enumerate(room) if r >= length), None)
        if at is None:
            room.append(capacity - length)
        else:
            room[at] -= length
    return len(room)


@pytest.mark.parametrize("capacity", [16, 200])
def test_packing(spark, capacity):
    draw = random.Random(11)
    texts = [(k, draw.choice(TEXTS)) for k in range(300)] + [(None, "null id"), (None, "null id"), (5, None)]
    texts += [(1000 + k, "w " * draw.randint(0, 80)) for k in range(500)]
    frame = spark.createDataFrame([(k, t, 1, 2) for k, t in texts], "doc_id long, text string, length int, key int")
    rows = packing.packed(frame.repartition(5), registry.WORD_BPE, capacity).collect()
    sequences, tokens = _check_packed(rows, texts, capacity)
    assert math.ceil(tokens / capacity) <= sequences <= _first_fit([row["length"] for row in rows], capacity)


def test_packing_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert packing.packed(empty, registry.WORD_BPE).collect() == []


def test_packing_takes_longest_pieces_first_and_few_combinations():
    counts = {length: 1000 for length in range(1, 100)}
    plan = packing.combinations(counts, 100)
    used: dict[int, int] = {}
    for times, lengths in plan:
        assert sum(length * n for length, n in lengths) <= 100
        for length, n in lengths:
            used[length] = used.get(length, 0) + times * n
    assert used == counts and len(plan) <= 100
