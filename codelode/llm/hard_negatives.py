"""Hard negatives by inner product, found with cover trees (operator 11).

Vectors get one component more, so that all have the norm of the longest one. On that sphere a query's inner
product with a vector falls as the angle between them grows, and all vectors below a node of a cover tree
lie within the covering radius (an angle) of its centre: cos(angle to the centre -+ radius) bounds all their
products from above and below.

1. Vectors are sorted over the cluster by label and by their place on a Hilbert curve. Runs of them become cover
   trees: the vectors of a node are covered by balls of a radius smaller by a fixed factor, each around a
   vector that no ball before has covered; the nodes of the next level. The trees are a table.
2. Trees are dealt to shards of bounded size. Anchors go to all shards, in blocks that stream through the task of a
   shard, which holds its trees and nothing else.
3. A block of anchors descends best first: of all open nodes the one with the greatest upper bound is opened next,
   for those of the anchors alone for which its bounds reach their windows and their fifth-best score so far. Products
   of the vectors in a leaf are computed exactly, in integers. Bounds are floating point, and are widened by more than
   their error, so they decide what is looked at but never what is found.

Positives are searched first, among rows of the anchor's label. Their scores give the windows of the second search,
among rows of other labels. Both return the best few of a shard; the best over shards follow by a window.

Edge cases: rows that `vectors` leaves out take no part, nor do rows with a null label or a null id; a pair with
different numbers of components has no score; rows that repeat count as often as they occur (a copy of an anchor is
another row); ties go to the smaller id; a positive with a negative score has an empty window; an empty table gives
no row.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelode.llm.common import settled
from codelode.llm.vectors import curve, integer_vectors, place_on, products

#: Vectors of a tree at most; of a leaf; how many times smaller the balls of the next level are.
TREE, LEAF, SHRINK = 4096, 64, 1.2
#: Balls in a row that cover little before the rest of a node is put in leaves by distance.
POOR = 16
#: Vectors of a shard, anchors of a block, and anchors that one task of a shard answers.
SHARD, ANCHORS, ANSWERED = 1 << 18, 256, 1 << 17
#: Bounds are widened by that share of the greatest possible product; far beyond the error of their sums.
_SLACK = 1e-6
_NONE = np.iinfo(np.int64).min + 1

_NODE = np.dtype([
    ("centre", "<i4"), ("first", "<i4"), ("children", "<i4"), ("begin", "<i4"), ("end", "<i4"),
    ("low_label", "<i8"), ("high_label", "<i8"), ("radius", "<f8"),
])


def _sphere(x: np.ndarray, norm: float) -> np.ndarray:
    """Unit vectors: the rows with one more component that makes their norm the same."""
    x = x.astype(np.float64)
    last = np.sqrt(np.maximum(norm * norm - (x * x).sum(axis=1), 0))
    return np.column_stack([x, last]) / norm


class Tree:
    """A cover tree: its vectors in the order of its leaves, and its nodes, the root first."""

    def __init__(self, keys, labels, rows, vectors, nodes, norm) -> None:
        self.keys, self.labels, self.rows, self.vectors = keys, labels, rows, vectors
        self.nodes, self.norm = nodes, norm

    @classmethod
    def build(cls, keys, labels, rows, vectors, leaf: int = LEAF, shrink: float = SHRINK) -> Tree:
        x = vectors.astype(np.float64)
        norm = max(float(np.sqrt((x * x).sum(axis=1).max())), 1.0)
        points = _sphere(vectors, norm)

        def angles(centre: int, among: np.ndarray) -> np.ndarray:
            # The chord is exact for small angles, where the cosine isn't.
            chord = np.sqrt(np.maximum(((points[among] - points[centre]) ** 2).sum(axis=1), 0))
            return 2 * np.arcsin(np.minimum(chord / 2, 1))

        # The order of the vectors, and nodes as (centre, members, radius); children follow their parent's turn.
        root = np.arange(len(x))
        open_nodes = [(0, root, float(angles(0, root).max()))]
        nodes, order, at = np.zeros(1, _NODE), [], 0
        found = [open_nodes[0]]
        spans: dict[int, tuple[int, int]] = {}

        def finish(number: int) -> tuple[int, int]:
            centre, members, radius = found[number]
            begin = len(order)
            if len(members) <= leaf or radius == 0:
                order.extend(members.tolist())
                first = children = 0
            else:
                parts = cover(centre, members, radius)
                first, children = len(found), len(parts)
                found.extend(parts)
                for k in range(first, first + children):
                    finish(k)
            spans[number] = (begin, len(order), first, children)
            return begin, len(order)

        def cover(centre: int, members: np.ndarray, radius: float) -> list[tuple[int, np.ndarray, float]]:
            parts, rest, target, poor = [], members, radius / shrink, 0
            while len(rest) > leaf and poor < POOR:
                far = angles(centre, rest)
                inside = far <= target
                poor = poor + 1 if inside.sum() <= leaf // 8 else 0
                parts.append((centre, rest[inside], float(far[inside].max())))
                rest = rest[~inside]
                if len(rest):
                    centre = int(rest[0])
            if len(rest):
                far = angles(members[0], rest)
                by_distance = np.argsort(far, kind="stable")
                for low in range(0, len(rest), leaf):
                    chunk = rest[by_distance[low : low + leaf]]
                    middle = int(chunk[0])
                    parts.append((middle, chunk, float(angles(middle, chunk).max())))
            return parts

        finish(0)
        nodes = np.zeros(len(found), _NODE)
        order = np.array(order, np.int64)
        for number, (centre, members, radius) in enumerate(found):
            begin, end, first, children = spans[number]
            own = labels[members]
            nodes[number] = (centre, first, children, begin, end, own.min(), own.max(), radius)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        nodes["centre"] = place[nodes["centre"]]
        return cls(keys[order], labels[order], rows[order], vectors[order], nodes, norm)

    def bounds(self, numbers: np.ndarray, queries: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bound of the products of queries (rows) with all vectors below the nodes (columns)."""
        product = queries.astype(np.float64) @ self.vectors[self.nodes["centre"][numbers]].astype(np.float64).T
        scale = np.maximum(norms, 1e-300)[:, None] * self.norm
        angle = np.arccos(np.clip(product / scale, -1, 1))
        radius = self.nodes["radius"][numbers][None, :]
        slack = _SLACK * scale
        return (
            np.cos(np.minimum(angle + radius, np.pi)) * scale - slack,
            np.cos(np.maximum(angle - radius, 0)) * scale + slack,
        )


class Best:
    """The best few of every query so far: scores, keys and rows, the best first."""

    def __init__(self, queries: int, n: int) -> None:
        self.score = np.full((queries, n), _NONE, np.int64)
        self.key = np.zeros((queries, n), np.int64)
        self.row = np.zeros((queries, n), np.int64)

    def offer(self, query: np.ndarray, score: np.ndarray, key: np.ndarray, row: np.ndarray) -> None:
        """Take in pairs of a query and a vector."""
        n = self.score.shape[1]
        touched = np.unique(query)
        all_query = np.concatenate([query, np.repeat(touched, n)])
        all_score = np.concatenate([score, self.score[touched].ravel()])
        all_key = np.concatenate([key, self.key[touched].ravel()])
        all_row = np.concatenate([row, self.row[touched].ravel()])
        order = np.lexsort((all_row, all_key, -all_score, all_query))
        all_query = all_query[order]
        first = np.searchsorted(all_query, all_query)
        rank = np.arange(len(order)) - first
        kept, order = rank < n, order[rank < n]
        place = (all_query[kept], rank[kept])
        self.score[place], self.key[place], self.row[place] = all_score[order], all_key[order], all_row[order]


def search(trees: list[Tree], queries: dict[str, np.ndarray], same: bool, n: int) -> Best:
    """The `n` best vectors of every query, among those of its label (`same`) or of other labels.

    `queries` has, a row for each query: vector, label, row (never found itself), low and high, the window.
    """
    vectors, label, own_row, low, high = (queries[c] for c in ("vector", "label", "row", "low", "high"))
    norms = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
    best = Best(len(vectors), n)
    heap: list[tuple[float, int, Tree, int, np.ndarray, np.ndarray]] = []
    count = 0

    def wanted(tree: Tree, numbers: np.ndarray, active: np.ndarray) -> None:
        nonlocal count
        lower, upper = tree.bounds(numbers, vectors[active], norms[active])
        nodes = tree.nodes[numbers]
        needed = np.maximum(low[active], best.score[active, -1])[:, None]
        mine = label[active][:, None]
        if same:
            fits = (nodes["low_label"] <= mine) & (mine <= nodes["high_label"])
        else:
            fits = (nodes["low_label"] != mine) | (nodes["high_label"] != mine)
        fits &= (upper >= needed) & (lower <= high[active][:, None])
        for k in np.flatnonzero(fits.any(axis=0)):
            hit = fits[:, k]
            count += 1
            heapq.heappush(heap, (-float(upper[hit, k].max()), count, tree, int(numbers[k]), active[hit], upper[hit, k]))

    everyone = np.arange(len(vectors))
    for tree in trees:
        if tree.vectors.shape[1] == vectors.shape[1]:
            wanted(tree, np.zeros(1, np.int64), everyone)
    while heap:
        _, _, tree, number, active, upper = heapq.heappop(heap)
        active = active[upper >= best.score[active, -1]]
        if not len(active):
            continue
        node = tree.nodes[number]
        if node["children"]:
            wanted(tree, np.arange(node["first"], node["first"] + node["children"]), active)
            continue
        span = slice(node["begin"], node["end"])
        score = products(vectors[active], tree.vectors[span])
        mine = label[active][:, None] == tree.labels[span][None, :]
        good = (mine if same else ~mine) & (tree.rows[span][None, :] != own_row[active][:, None])
        good &= (score >= np.maximum(low[active], best.score[active, -1])[:, None]) & (score <= high[active][:, None])
        query, place = np.nonzero(good)
        if len(query):
            at = node["begin"] + place
            best.offer(active[query], score[query, place], tree.keys[at], tree.rows[at])
    return best


def _packed(x: np.ndarray) -> bytes:
    small = np.abs(x).max(initial=0) < 1 << 15
    return (b"\2" if small else b"\4") + x.astype("<i2" if small else "<i4").tobytes()


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<i2" if raw[0] == 2 else "<i4", offset=1).reshape(-1, n)


def _in_runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of at most `most` rows of one number of components: it, keys, labels, rows, vectors."""
    held: list[pa.RecordBatch] = []
    size = 0

    def flush():
        table = pa.Table.from_batches(held)
        n = table.column("n")[0].as_py()
        x = np.frombuffer(b"".join(table.column("vector").to_pylist()), "<i4").reshape(-1, n)
        return n, *(table.column(c).to_numpy() for c in ("key", "label", "row")), x

    for batch in batches:
        sizes = batch.column("n").to_numpy()
        at = 0
        while at < len(sizes):
            other = np.flatnonzero(sizes[at:] != sizes[at])
            stop = at + (int(other[0]) if len(other) else len(sizes) - at)
            if held and held[-1].column("n")[0].as_py() != sizes[at]:
                yield flush()
                held, size = [], 0
            stop = min(stop, at + most - size)
            held.append(batch.slice(at, stop - at))
            size, at = size + stop - at, stop
            if size == most:
                yield flush()
                held, size = [], 0
    if size:
        yield flush()


_TREE_SCHEMA = "tree long, n int, size int, norm double, keys binary, labels binary, rows binary, vectors binary, nodes binary"
_ANCHOR_SCHEMA = "block long, n int, keys binary, labels binary, rows binary, vectors binary, low binary, high binary, owner binary"


def _make_trees(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, keys, labels, rows, x in _in_runs(batches, most):
            tree = Tree.build(keys, labels, rows, x)
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(rows.min())], pa.int64()), pa.array([n], pa.int32()), pa.array([len(x)], pa.int32()),
                 pa.array([tree.norm]), *(pa.array([a.astype("<i8").tobytes()]) for a in (tree.keys, tree.labels, tree.rows)),
                 pa.array([_packed(tree.vectors)]), pa.array([tree.nodes.tobytes()])],
                ["tree", "n", "size", "norm", "keys", "labels", "rows", "vectors", "nodes"],
            )

    return run


def _tree(row: dict) -> Tree:
    keys, labels, rows = (np.frombuffer(row[c], "<i8") for c in ("keys", "labels", "rows"))
    return Tree(keys, labels, rows, _unpacked(row["vectors"], row["n"]), np.frombuffer(row["nodes"], _NODE), row["norm"])


def _anchor_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for n, keys, labels, rows, x in _in_runs(batches, ANCHORS):
        yield pa.RecordBatch.from_arrays(
            [pa.array([int(rows.min())], pa.int64()), pa.array([n], pa.int32()),
             *(pa.array([a.astype("<i8").tobytes()]) for a in (keys, labels, rows)), pa.array([_packed(x)]),
             *(pa.array([None], pa.binary()) for _ in range(3))],
            ["block", "n", "keys", "labels", "rows", "vectors", "low", "high", "owner"],
        )


def _with_windows(up: int, down: int):
    """Blocks of anchors with the windows below their positives' scores (`highs`), flat, each with its anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ANCHORS):
                part = batch.slice(start, ANCHORS)
                sizes = part.column("n").to_numpy()
                for size in np.unique(sizes).tolist():
                    own = part.filter(pa.array(sizes == size))
                    keys, labels, rows = (own.column(c).to_numpy() for c in ("key", "label", "row"))
                    x = np.frombuffer(b"".join(own.column("vector").to_pylist()), "<i4").reshape(-1, size)
                    highs = own.column("highs").to_pylist()
                    owner = np.repeat(np.arange(len(x)), [len(h) for h in highs])
                    high = np.array([score for each in highs for score in each], np.int64)
                    low = -(-up * high // down)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(rows.min())], pa.int64()), pa.array([size], pa.int32()),
                         *(pa.array([a.astype("<i8").tobytes()]) for a in (keys, labels, rows)), pa.array([_packed(x)]),
                         *(pa.array([a.astype("<i8").tobytes()]) for a in (low, high, owner))],
                        ["block", "n", "keys", "labels", "rows", "vectors", "low", "high", "owner"],
                    )

    return run


_FOUND_SCHEMA = "anchor_row long, anchor_id long, window long, key long, row long, score long"


def _answers(same: bool, n: int):
    """Of a partition sorted by shard: the trees of a shard come first, then the anchor blocks, one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, trees = None, []
        for batch in batches:
            for at in range(batch.num_rows):
                row = {name: batch.column(name)[at].as_py() for name in batch.schema.names}
                if row["shard"] != shard:
                    shard, trees = row["shard"], []
                if row["nodes"] is not None:
                    trees.append(_tree(row))
                    continue
                keys, labels, rows = (np.frombuffer(row[c], "<i8") for c in ("keys", "labels", "rows"))
                x = _unpacked(row["vectors"], row["n"])
                if same:
                    owner = np.arange(len(x))
                    low, high = np.full(len(x), _NONE + 1), np.full(len(x), np.iinfo(np.int64).max)
                else:
                    owner, low, high = (np.frombuffer(row[c], "<i8") for c in ("owner", "low", "high"))
                queries = {"vector": x[owner], "label": labels[owner], "row": rows[owner], "low": low, "high": high}
                best = search(trees, queries, same, n)
                query, rank = np.nonzero(best.score > _NONE)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a) for a in (rows[owner[query]], keys[owner[query]], high[query],
                                           best.key[query, rank], best.row[query, rank], best.score[query, rank])],
                    ["anchor_row", "anchor_id", "window", "key", "row", "score"],
                )

    return run


def trees(vectors: DataFrame, size: int = TREE) -> DataFrame:
    """Cover trees over all vectors, in the order of label and curve; settled."""
    path = curve(vectors)
    parallel = vectors.sparkSession.sparkContext.defaultParallelism
    parts = max(-(-path.rows // (8 * size)), min(parallel, -(-path.rows // size)), 1)
    ordered = (
        vectors.withColumn("place", place_on(path))
        .repartitionByRange(parts, "n", "label", "place", "key", "row")
        .sortWithinPartitions("n", "label", "place", "key", "row")
        .select("key", "label", "row", "n", "vector")
    )
    return settled(ordered.mapInArrow(_make_trees(size), _TREE_SCHEMA), "cover-trees")


def _searched(grown: DataFrame, blocks: DataFrame, shards: int, parts: int, same: bool, n: int) -> DataFrame:
    """The `n` best of every window over all shards."""
    none = F.lit(None)
    # The tree of a shard goes to all parts of the anchors, an anchor block to all shards.
    dealt = grown.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select(
        F.pmod(F.xxhash64("tree"), F.lit(shards)).cast("int").alias("shard_no"), "part", F.lit(0).alias("kind"),
        F.col("tree").alias("number"), "n", "norm", "keys", "labels", "rows", "vectors", "nodes",
        *(none.cast("binary").alias(c) for c in ("low", "high", "owner")),
    )
    asked = blocks.withColumn("shard_no", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).select(
        "shard_no", F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int").alias("part"), F.lit(1).alias("kind"),
        F.col("block").alias("number"), "n", none.cast("double").alias("norm"), "keys", "labels", "rows", "vectors",
        none.cast("binary").alias("nodes"), "low", "high", "owner",
    )
    both = dealt.unionByName(asked).withColumn("shard", F.col("shard_no") * F.lit(parts) + F.col("part"))
    streamed = both.drop("shard_no", "part").repartitionById(shards * parts, F.col("shard")).sortWithinPartitions("shard", "kind", "number")
    found = streamed.mapInArrow(_answers(same, n), _FOUND_SCHEMA)
    order = Window.partitionBy("anchor_row", "window").orderBy(F.desc("score"), "key", "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def mined(
    frame: DataFrame, key: str, vector: Column, label: Column, is_anchor: Column, scale: float,
    positives: int = 5, negatives: int = 5, low_share: tuple[int, int] = (80, 100), tree: int = TREE, shard: int = SHARD,
) -> DataFrame:
    """Up to `negatives` rows of another label for each anchor and each of its `positives` best rows of its own.

    A negative's score lies between `low_share` of the positive's score and that score. Columns:
    `anchor_id`, `positive_id`, `rank`, `negative_id`, `positive_score`, `negative_score`.
    """
    usable = frame.filter(label.isNotNull() & F.col(key).isNotNull())
    vectors = integer_vectors(usable, scale, F.col(key), vector, label)
    grown = trees(vectors, tree)
    anchors = vectors.filter(is_anchor)
    total = grown.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n"), F.count("*").alias("trees")).first()
    n_anchors = anchors.count()
    parallel = frame.sparkSession.sparkContext.defaultParallelism
    shards = max(-(-total["n"] // shard), min(2 * parallel, total["trees"]), 1)
    parts = max(-(-n_anchors // ANSWERED), 1)
    # Neighbours in blocks: anchors of a label and a region of the curve open the same nodes.
    place = place_on(curve(anchors))
    spread = max(1, -(-n_anchors // (16 * ANCHORS)))

    def in_order(rows: DataFrame, *more: str) -> DataFrame:
        order = ("n", "label", "place", "key", "row")
        placed = rows.withColumn("place", place).repartitionByRange(spread, *order).sortWithinPartitions(*order)
        return placed.select("key", "label", "row", "n", "vector", *more)

    blocks = settled(in_order(anchors).mapInArrow(_anchor_blocks, _ANCHOR_SCHEMA), "anchors")
    near = settled(
        _searched(grown, blocks, shards, parts, True, positives).select(
            "anchor_row", "anchor_id", F.col("key").alias("positive_id"), F.col("row").alias("positive_row"),
            F.col("score").alias("positive_score"),
        ),
        "positives",
    )
    # No product lies between a share of a negative number and that number. A handful of scores an anchor.
    asked = near.filter("positive_score >= 0").groupBy("anchor_row").agg(F.collect_set("positive_score").alias("highs"))
    windows = in_order(anchors.join(asked, F.col("row") == F.col("anchor_row")), "highs")
    blocks = settled(windows.mapInArrow(_with_windows(*low_share), _ANCHOR_SCHEMA), "windows")
    found = _searched(grown, blocks, shards, parts, False, negatives).select(
        F.col("anchor_row").alias("of_row"), "window", "rank", F.col("key").alias("negative_id"),
        F.col("score").alias("negative_score"),
    )
    same_window = (F.col("anchor_row") == F.col("of_row")) & (F.col("positive_score") == F.col("window"))
    return near.join(found, same_window).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
