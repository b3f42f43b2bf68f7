r"""Document fingerprints as Merkle trees (operator 8).

A document's paragraphs are its lines, and a section ends behind every paragraph whose hash has its
lowest two bits 0, so that an inserted paragraph changes one section and not all behind it. The
tree has a SHA-256 for each paragraph (of its text), each section (of its paragraphs' hashes) and the
root (of its sections' hashes). Roots are equal if and only if the texts are. Where they differ, only
sections that differ are descended into, and of those only paragraphs that differ: `changed_paragraphs`.

A fingerprint is `root:pieces`, with a short hash for every piece of a paragraph (up to four words).
The likeness of two fingerprints is the Dice coefficient of the sets of these.

DataFrame functions only. Successors in the order of ids are found in groups of GROUP neighbouring
ids; only the first and last rows of the groups are joined with those of other groups, and the order
of the groups is found on their numbers alone, by ranges. So no task holds an order of all rows.

Edge cases: null counts as the empty text, which is one empty paragraph and no piece; rows of the same id
follow each other by text; a null id has no place in the order, so its next text is empty; in a table of
one row that row is its own next; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelode.llm.common import settled

GROUP = 64
_PIECE = "[^ .]*(?: [^ .]*){0,3}[ .]?"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once, also where lambda functions refer to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _sections(paragraphs: Column) -> Column:
    """The hash of each section, from the hashes of the paragraphs."""
    numbered = F.filter(
        F.sequence(F.lit(1), F.size(paragraphs)),
        lambda k: F.substring(F.element_at(paragraphs, k), 64, 1).isin("0", "4", "8", "c"),
    )
    ends = F.array_union(numbered, F.array(F.size(paragraphs)))
    return _let(
        ends,
        lambda e: F.transform(
            F.sequence(F.lit(0), F.size(e) - 1),
            lambda k: F.sha2(
                F.array_join(
                    F.slice(
                        paragraphs,
                        F.coalesce(F.get(e, k - 1), F.lit(0)) + 1,
                        F.get(e, k) - F.coalesce(F.get(e, k - 1), F.lit(0)),
                    ),
                    ",",
                ),
                256,
            ),
        ),
    )


def tree(text: Column) -> Column:
    """A struct of `root`, `sections`, `paragraphs` (hashes) and `pieces` (short hashes)."""
    whole = F.coalesce(text, F.lit(""))
    return _let(
        F.split(whole, "\n"),
        lambda lines: _let(
            F.transform(lines, lambda line: F.sha2(line, 256)),
            lambda paragraphs: _let(
                _sections(paragraphs),
                lambda sections: F.struct(
                    F.sha2(F.array_join(sections, ","), 256).alias("root"),
                    sections.alias("sections"),
                    paragraphs.alias("paragraphs"),
                    F.flatten(
                        F.transform(
                            lines,
                            lambda line: F.transform(
                                F.filter(F.regexp_extract_all(line, F.lit(_PIECE), F.lit(0)), lambda p: p != ""),
                                lambda p: F.xxhash64(p).bitwiseAND(0xFFFFFFFF),
                            ),
                        )
                    ).alias("pieces"),
                ),
            ),
        ),
    )


def fingerprint(node: Column) -> Column:
    """The fingerprint of a tree as a string."""
    short = F.transform(node["pieces"], lambda p: F.lpad(F.lower(F.hex(p)), 8, "0"))
    return F.concat(node["root"], F.lit(":"), F.array_join(short, ""))


def _dice(a: Column, b: Column) -> Column:
    total = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / total)


def tree_likeness(a: Column, b: Column) -> Column:
    """The likeness of two trees' fingerprints, 0 to 1."""
    return F.when(a["root"] == b["root"], F.lit(1.0)).otherwise(_dice(a["pieces"], b["pieces"]))


def likeness(a: Column, b: Column) -> Column:
    """The likeness of two fingerprints, 0 to 1."""
    pieces = (F.regexp_extract_all(F.substring_index(x, ":", -1), F.lit("[0-9a-f]{8}"), F.lit(0)) for x in (a, b))
    return F.when(a == b, F.lit(1.0)).otherwise(_dice(*pieces))


def changed_paragraphs(a: Column, b: Column) -> Column:
    """Numbers (from 1) of the paragraphs of tree `a` that tree `b` has nowhere."""
    gone = F.when(
        F.size(F.array_except(a["sections"], b["sections"])) > 0, F.array_except(a["paragraphs"], b["paragraphs"])
    ).otherwise(F.array().cast("array<string>"))
    numbers = F.sequence(F.lit(1), F.size(a["paragraphs"]))
    return _let(
        F.struct(gone.alias("gone"), a["paragraphs"].alias("all"), numbers.alias("numbers")),
        lambda x: F.when(F.size(x["gone"]) == 0, F.array().cast("array<int>")).otherwise(
            F.filter(x["numbers"], lambda k: F.array_contains(x["gone"], F.element_at(x["all"], k)))
        ),
    )


def _next_groups(groups: DataFrame) -> DataFrame:
    """(g, next_g) of distinct group numbers, the first following the last."""
    ranged = settled(
        groups.repartitionByRange("g").select("g", F.spark_partition_id().alias("part")), "group-order"
    )
    inside = Window.partitionBy("part").orderBy("g")
    # One row for each partition of the ranges.
    firsts = ranged.groupBy("part").agg(F.min("g").alias("first"))
    following = firsts.select(
        F.col("part").alias("p"),
        F.coalesce(
            F.lead("first").over(Window.orderBy("part")),
            F.first("first").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)),
        ).alias("after"),
    )
    return ranged.withColumn("own", F.lead("g").over(inside)).join(
        F.broadcast(following), F.col("part") == F.col("p")
    ).select("g", F.coalesce("own", "after").alias("next_g"))


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, tree, next_text, next_tree) with the text that follows in ascending order of the ids."""
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # Negative ids too: groups must follow each other as their ids do. Never null, so that no branch
    # below adds a filter of its own and all of them read one exchange.
    group = F.coalesce(F.expr(f"(key - pmod(key, {GROUP})) div {GROUP}"), F.lit(0).cast("long"))
    placed = rows.filter("key is not null").withColumn("g", group)
    dealt = placed.repartition("g")
    order = Window.partitionBy("g").orderBy("key", "text")
    # The trees are made behind the exchange, so that only texts are shuffled.
    led = dealt.withColumn("tree", tree(F.col("text"))).select(
        "*", F.lead("text").over(order).alias("next_text"), F.lead("tree").over(order).alias("next_tree")
    )
    follow = _next_groups(placed.select("g").distinct())
    lasts = dealt.withColumn("next_text", F.lead("text").over(order)).filter("next_text is null").drop("next_text")
    firsts = dealt.withColumn("number", F.row_number().over(order)).filter("number = 1").select(
        F.col("g").alias("first_g"), F.col("text").alias("first_text")
    )
    ends = (
        lasts.join(follow, "g").join(firsts, F.col("next_g") == F.col("first_g"))
        .select("key", "text", tree(F.col("text")).alias("tree"), F.col("first_text").alias("next_text"),
                tree(F.col("first_text")).alias("next_tree"))
    )
    lone = rows.filter("key is null").select(
        "*", tree(F.col("text")).alias("tree"), F.lit("").alias("next_text"), tree(F.lit("")).alias("next_tree")
    )
    inner = led.filter("next_text is not null").select("key", "text", "tree", "next_text", "next_tree")
    return inner.unionByName(ends).unionByName(lone)


def fingerprinted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likenesses.

    The edited text has its last quarter replaced by as much of the start of the next text.
    """
    edited = F.concat(
        F.expr("substring(text, 1, char_length(text) - char_length(text) div 4)"),
        F.expr("substring(next_text, 1, cast(char_length(text) div 4 as int))"),
    )
    rows = with_next(docs, key, text).select(
        "key", F.char_length("text").cast("long").alias("n_chars"), "tree", "next_tree", edited.alias("edited")
    )
    both = rows.select(
        "key", "n_chars", "tree", "next_tree", F.sha2("edited", 256).alias("edited_sha256"),
        tree(F.col("edited")).alias("edited_tree"),
    )
    return both.select(
        F.col("key").alias(key),
        "n_chars",
        "edited_sha256",
        fingerprint(F.col("tree")).alias("fingerprint"),
        fingerprint(F.col("edited_tree")).alias("edited_fingerprint"),
        tree_likeness(F.col("tree"), F.col("edited_tree")).alias("near_edited"),
        tree_likeness(F.col("tree"), F.col("next_tree")).alias("near_next"),
    )
