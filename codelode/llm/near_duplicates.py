"""Near duplicates by b-bit MinHash (operator 10).

Two documents are linked if their sets of word shingles have a Jaccard similarity of at least the
threshold. Documents of the same set are one class from the start, so copies cost one representative.

1. Each class gets MINIMA minima of its hashed shingles. Groups of ROWS minima make the bands, whose
   hashes are the buckets; of each minimum the lowest BITS bits are kept and packed as its signature.
2. Each bucket tests its members against a pivot, its member of the least id: pairs in proportion to
   the members. Pairs whose signatures, corrected for chance collisions of the few bits, say that the
   similarity is far below the threshold are dropped; the others are confirmed on full sets. A member's
   most similar pivot comes first, and what links have joined already isn't tested again.
3. Members of buckets that still hold several components, such as documents that share a common
   passage, are compared by rare shingles: in the order of their frequency among these documents, two
   sets at the threshold have one of their rarest n - ceil(threshold * n) + 1 shingles in common, and
   behind the first such shingle either set has as many left as the threshold asks for. This is exact,
   and passages that many share, being frequent, make no candidates. Pivots test what is left, more
   of them in each round, until every pair is joined or tested.

Two documents at the threshold share no bucket with a probability of
(1 - threshold ** ROWS) ** (MINIMA / ROWS), 5e-7 for 0.8, and the estimate would have to be SIGMAS
standard deviations off to lose them; the sets decide on all others.

Edge cases: null texts and texts without a word have an empty set and are linked with nothing; a text of
fewer words than a shingle has one shingle, all of them; rows of one id count as one document
with several texts; a row without an id is linked with nothing, its component is null and it is kept;
further columns are ignored by `components` and kept by `first_of_each`; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelode.llm.common import settled, strings
from codelode.llm.hashing import BASE, Stretches, mix

ROWS, BANDS = 6, 48
MINIMA = ROWS * BANDS
BITS = 4
SIGMAS = 6.0
#: Characters of text whose words are hashed at the same time.
BLOCK = 1 << 19

_U = np.uint64
_MASKS = {1: 0xFFFFFFFFFFFFFFFF, 2: 0x5555555555555555, 4: 0x1111111111111111, 8: 0x0101010101010101}


@cache
def _orders() -> tuple[np.ndarray, np.ndarray]:
    """An odd factor and a mask for each minimum."""
    draw = np.random.Generator(np.random.PCG64(20))
    factor, mask = draw.integers(0, 1 << 32, (2, MINIMA), np.uint32)
    return factor | np.uint32(1), mask


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words between ASCII white space."""
    raw = np.frombuffer(data, np.uint8)
    inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return Stretches(raw).of_any(starts, ends), starts


def _shingles_of(texts: list[str | None], width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    parts = [b"" if t is None else t.encode("utf-8", "replace").lower() for t in texts]  # A-Z alone
    words, starts = _word_hashes(b" ".join(parts))
    ends = np.cumsum([len(p) + 1 for p in parts])
    bounds = np.searchsorted(starts, np.concatenate([[0], ends]))
    rolled = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        rolled = rolled * BASE + words[k : k + len(rolled)]
    rolled = mix(rolled)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= width:
            yield np.unique(rolled[a : b - width + 1])
        elif b > a:
            short = _U(b - a)
            for word in words[a:b]:
                short = short * BASE + word
            yield mix(np.array([short], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def shingles(texts: Iterator[str | None], width: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's shingles of `width` words, lower-cased in A-Z."""
    waiting, held = [], 0
    with np.errstate(over="ignore"):
        for text in texts:
            waiting.append(text)
            held += len(text or "")
            if held >= BLOCK:
                yield from _shingles_of(waiting, width)
                waiting, held = [], 0
        if waiting:
            yield from _shingles_of(waiting, width)


def minima(found: np.ndarray) -> np.ndarray:
    """The least of the shingles' hashes under each of the MINIMA orders."""
    factor, mask = _orders()
    low = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    small = (found >> _U(32)).astype(np.uint32)
    for start in range(0, len(small), 2048):
        part = (small[start : start + 2048] ^ mask[:, None]) * factor[:, None]
        np.minimum(low, part.min(axis=1), out=low)
    return low


def packed(low: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Signatures (a row each) of minima: their lowest bits, packed in 64-bit words."""
    each = 64 // bits
    kept = (low & np.uint32((1 << bits) - 1)).astype(np.uint64).reshape(len(low), -1, each)
    return np.bitwise_or.reduce(kept << (np.arange(each, dtype=np.uint64) * _U(bits)), axis=2)


def bands(low: np.ndarray) -> np.ndarray:
    """The bucket of each band (a row for each document)."""
    groups = low.reshape(len(low), BANDS, ROWS).astype(np.uint64)
    value = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), groups.shape[:2])
    for k in range(ROWS):
        value = mix(value * BASE + groups[:, :, k])
    return value


def _lists(rows: np.ndarray) -> pa.Array:
    flat = pa.array(np.ascontiguousarray(rows).reshape(-1).view(np.int64))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), flat)


_SIGNED = "id long, n long, digest binary, bands array<long>, signature array<long>"


def _signed(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def record(ids: list, sizes: list, digests: list, lows: list) -> pa.RecordBatch:
            low = np.stack(lows)
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                 _lists(bands(low)), _lists(packed(low))],
                ["id", "n", "digest", "bands", "signature"],
            )

        for batch in batches:
            ids, sizes, digests, lows = [], [], [], []
            for key, found in zip(batch.column(0).to_pylist(), shingles(strings(batch.column(1)), width), strict=True):
                ids.append(key)
                sizes.append(len(found))
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                lows.append(minima(found))
                if len(ids) == 512:
                    yield record(ids, sizes, digests, lows)
                    ids, sizes, digests, lows = [], [], [], []
            if ids:
                yield record(ids, sizes, digests, lows)

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, found in zip(batch.column(0).to_pylist(), shingles(strings(batch.column(1)), width), strict=True):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key], pa.int64()), _lists(found.reshape(1, -1))], ["id", "shingles"]
                )

    return run


def estimate(a: Column, b: Column, bits: int = BITS) -> Column:
    """The similarity that two signatures tell: the share of equal minima, less what chance adds."""

    def differing(x: Column, y: Column) -> Column:
        both = x.bitwiseXOR(y)
        for shift in (1, 2, 4):
            if shift < bits:
                both = both.bitwiseOR(F.shiftrightunsigned(both, shift))
        return F.bit_count(both.bitwiseAND(F.lit(_MASKS[bits] if _MASKS[bits] < 1 << 63 else -1)))

    off = F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda total, n: total + n)
    chance = 2.0**-bits
    return (1 - off / float(MINIMA) - chance) / (1 - chance)


def _least(threshold: float) -> float:
    """Below that estimate a pair at the threshold is not to be expected."""
    chance = 2.0**-BITS
    equal = threshold + (1 - threshold) * chance
    return threshold - SIGMAS * float(np.sqrt(equal * (1 - equal) / MINIMA)) / (1 - chance)


def connected(links: DataFrame) -> DataFrame:
    """(id, component) of every id in the links (x, y); the component is the least id that is reached.

    Large and small stars in turn: each round points ids at lesser neighbours of their neighbours, and
    the rounds needed grow with the logarithm of the longest chain. Nothing is gathered by component.
    """
    edges = settled(
        links.select(F.greatest("x", "y").alias("high"), F.least("x", "y").alias("low"))
        .filter("high <> low").distinct(),
        "component-links",
    )
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("low").alias("high"), F.col("high").alias("low")))
        least = both.groupBy("high").agg(F.min("low").alias("m")).select(
            F.col("high").alias("node"), F.least("high", "m").alias("m")
        )
        large = (
            both.filter("low > high").join(least, F.col("high") == F.col("node"))
            .select(F.col("low").alias("high"), F.col("m").alias("low")).filter("high <> low").distinct()
        )
        large = settled(large, "component-links")
        small_least = large.groupBy("high").agg(F.min("low").alias("m")).select(F.col("high").alias("node"), "m")
        joined = large.join(small_least, F.col("high") == F.col("node"))
        edges = settled(
            joined.select(F.col("low").alias("high"), F.col("m").alias("low"))
            .unionByName(small_least.select(F.col("node").alias("high"), F.col("m").alias("low")))
            .filter("high <> low").distinct(),
            "component-links",
        )
        # Number and sum of hashes tell whether the links have changed.
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("high", "low").cast("decimal(20,0)"))).first()
        if state == before:
            return edges.select(F.col("high").alias("id"), F.col("low").alias("component"))
        before = state


class _Search:
    """The state of one search: texts, signatures, tested pairs, confirmed links and components."""

    def __init__(self, docs: DataFrame, signed: DataFrame, width: int, threshold: float) -> None:
        self.docs, self.width, self.threshold = docs, width, threshold
        self.signatures = signed.select("id", "n", "signature")
        self.sets: DataFrame | None = None
        self.links: DataFrame | None = None
        self.tested: DataFrame | None = None
        self.components: DataFrame | None = None

    def likely(self, pairs: DataFrame) -> DataFrame:
        """(x, y, likeness) of distinct pairs whose sizes and signatures allow a link."""
        x, y = (
            self.signatures.select(F.col("id").alias(name), F.col("n").alias(f"n_{name}"), F.col("signature").alias(f"s_{name}"))
            for name in "xy"
        )
        sizes = F.least("n_x", "n_y") >= F.greatest("n_x", "n_y") * (self.threshold - 1e-9)
        joined = pairs.join(x, "x").join(y, "y").filter(sizes)
        return (
            joined.select("x", "y", estimate(F.col("s_x"), F.col("s_y")).alias("likeness"))
            .filter(F.col("likeness") >= _least(self.threshold))
            .groupBy("x", "y").agg(F.max("likeness").alias("likeness"))
        )

    def _sets_of(self, pairs: DataFrame) -> DataFrame | None:
        """Full sets of the documents in the pairs; a text is read again only when its set is first needed."""
        ids = pairs.select(F.explode(F.array("x", "y")).alias("id")).distinct()
        if self.sets is not None:
            ids = ids.join(self.sets.select("id"), "id", "left_anti")
        ids = settled(ids, "near-ids")
        if not ids.isEmpty():
            new = settled(
                self.docs.join(ids, "id", "left_semi").select("id", "text")
                .mapInArrow(_sets(self.width), "id long, shingles array<long>"),
                "near-sets",
            )
            self.sets = new if self.sets is None else self.sets.unionByName(new)
        return self.sets

    def confirm(self, pairs: DataFrame) -> None:
        """Test pairs (x, y) on full sets; links and components take in what is found."""
        sets = self._sets_of(pairs)
        if sets is None:  # there are no pairs
            return
        x, y = (sets.select(F.col("id").alias(name), F.col("shingles").alias(f"set_{name}")) for name in "xy")
        common = F.size(F.array_intersect("set_x", "set_y"))
        union = F.size("set_x") + F.size("set_y") - F.col("common")
        found = settled(
            pairs.join(y, "y").join(x, "x").select("x", "y", common.alias("common"), "set_x", "set_y")
            .filter(F.col("common") >= union * F.lit(self.threshold) - 1e-6)
            .select("x", "y").distinct(),
            "near-links",
        )
        tested = pairs.select("x", "y")
        self.tested = tested if self.tested is None else self.tested.unionByName(tested)
        if self.links is None:
            self.links = found
        elif not found.isEmpty():
            self.links = self.links.unionByName(found)
        else:
            return
        # What is known already goes in as stars, not as all its links.
        base = found if self.components is None else found.unionByName(
            self.components.select(F.col("id").alias("x"), F.col("component").alias("y"))
        )
        self.components = connected(base)

    def with_component(self, rows: DataFrame, column: str, name: str) -> DataFrame:
        """The rows with the component of an id column; an id without links is its own."""
        if self.components is None:
            return rows.withColumn(name, F.col(column))
        own = self.components.select(F.col("id").alias("_id"), F.col("component").alias("_component"))
        return (
            rows.join(own, F.col(column) == F.col("_id"), "left")
            .withColumn(name, F.coalesce("_component", column)).drop("_id", "_component")
        )

    def apart(self, pairs: DataFrame) -> DataFrame:
        """The pairs that are neither tested nor joined."""
        left = self.with_component(self.with_component(pairs, "x", "c_x"), "y", "c_y")
        left = left.filter("c_x <> c_y").drop("c_x", "c_y")
        return left if self.tested is None else left.join(self.tested, ["x", "y"], "left_anti")

    def first_round(self, members: DataFrame) -> None:
        pairs = members.filter("id <> pivot").select(F.col("pivot").alias("x"), F.col("id").alias("y")).distinct()
        pairs = settled(self.likely(pairs), "near-pairs")
        best = pairs.groupBy("y").agg(F.max_by("x", F.struct("likeness", -F.col("x"))).alias("x")).select("x", "y")
        self.confirm(settled(best, "near-tests"))
        rest = settled(self.apart(pairs.select("x", "y")), "near-tests")
        if not rest.isEmpty():
            self.confirm(rest)

    def rare_shingles(self, ids: DataFrame) -> DataFrame:
        """(bucket, id, n, rank): the rarest shingles of the documents, of which two that are linked share one."""
        pairs = ids.select(F.col("id").alias("x"), F.col("id").alias("y"))
        sets = self._sets_of(pairs).join(ids, "id", "left_semi")
        each = sets.select(
            "id", F.xxhash64("shingles").alias("set"), F.size("shingles").alias("n"), F.explode("shingles").alias("bucket")
        )
        counts = each.groupBy("bucket").agg(F.count(F.lit(1)).alias("times"))
        order = Window.partitionBy("id", "set").orderBy("times", "bucket")  # the shingles of one text
        ranked = each.join(counts, "bucket").withColumn("rank", F.row_number().over(order))
        first = F.col("n") - F.ceil(F.col("n") * self.threshold - 1e-6) + 1
        return ranked.filter((F.col("rank") <= first) & (F.col("times") > 1)).select("bucket", "id", "n", "rank")

    def _torn(self, members: DataFrame) -> DataFrame:
        """The members (bucket, id ...), with their components `c`, of buckets that hold several."""
        placed = self.with_component(members, "id", "c")
        torn = placed.groupBy("bucket").agg(F.min("c").alias("a"), F.max("c").alias("b")).filter("a < b")
        return settled(placed.join(torn.select("bucket"), "bucket", "left_semi"), "near-members")

    def further_rounds(self, members: DataFrame) -> None:
        """Test what the first pivots of torn buckets have left, by rare shingles."""
        left = self._torn(members.filter("id <> pivot").select("bucket", "id"))
        if left.isEmpty():
            return
        left, pivots = self.rare_shingles(settled(left.select("id").distinct(), "near-torn")), 16
        while True:
            left = self._torn(left)
            if left.isEmpty():
                return
            chosen = left.groupBy("bucket", F.pmod(F.xxhash64("id"), F.lit(pivots)).alias("part")).agg(
                F.min_by(F.struct("id", "c", "n", "rank"), "id").alias("p")
            ).select("bucket", *(F.col("p")[x].alias(f"{x}_p") for x in ("id", "c", "n", "rank")))
            chosen = settled(chosen, "near-pivots")
            # The shingles that two sets can still have in common, and those that a link takes.
            most = 1 + F.least(F.col("n") - F.col("rank"), F.col("n_p") - F.col("rank_p"))
            asked = F.ceil((F.col("n") + F.col("n_p")) * (self.threshold / (1 + self.threshold)) - 1e-6)
            pairs = (
                left.join(chosen, "bucket").filter((F.col("id") != F.col("id_p")) & (F.col("c") != F.col("c_p")) & (most >= asked))
                .select(F.least("id", "id_p").alias("x"), F.greatest("id", "id_p").alias("y")).distinct()
            )
            if self.tested is not None:
                pairs = pairs.join(self.tested, ["x", "y"], "left_anti")
            likely = settled(self.likely(pairs).select("x", "y"), "near-tests")
            if not likely.isEmpty():
                self.confirm(likely)
            left = left.drop("c").join(
                chosen.select("bucket", F.col("id_p").alias("id")), ["bucket", "id"], "left_anti"
            )
            pivots *= 8


def components(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, threshold: float = 0.8
) -> DataFrame:
    """`key`, `n_shingles`, `component_id` (least id reachable) and `kept` (it is its own) of each row."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    signed = settled(rows.mapInArrow(_signed(width), _SIGNED), "near-signatures")
    full = signed.filter("id is not null and n > 0")
    classes = settled(full.groupBy("digest").agg(F.min("id").alias("class")), "near-classes")
    # One representative of each set: the row of the least id.
    first = full.join(
        classes.select(F.col("digest").alias("_digest"), "class"),
        (F.col("id") == F.col("class")) & (F.col("digest") == F.col("_digest")), "left_semi",
    ).dropDuplicates(["id", "digest"])
    placed = first.select("id", F.explode("bands").alias("bucket"))
    buckets = placed.groupBy("bucket").agg(F.min("id").alias("pivot"), F.max("id").alias("last")).filter("pivot < last")
    members = settled(placed.join(buckets.select("bucket", "pivot"), "bucket"), "near-buckets")
    search = _Search(rows.filter("id is not null"), settled(first.select("id", "n", "signature"), "near-first"), width, threshold)
    if not members.isEmpty():
        search.first_round(members)
        search.further_rounds(members)
    classed = signed.select("id", "n", "digest").join(classes, "digest", "left")
    alone = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("class")).otherwise(F.col("id"))
    result = search.with_component(classed.withColumn("class", alone), "class", "component")
    return result.select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"),
    )


def first_of_each(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, threshold: float = 0.8
) -> DataFrame:
    """The documents without those whose component has a lesser id."""
    gone = components(docs, key, text, width, threshold).filter("not kept").select(F.col(key).alias("_gone")).distinct()
    gone = settled(gone, "near-gone")
    return docs.join(gone, docs[key].cast("long") == gone["_gone"], "left_anti")
