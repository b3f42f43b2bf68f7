"""Mixing sources to target weights by Poisson replication (operator 2).

A source's documents are repeated, on average, as often as it takes for the source to reach its share
of the mixture. How often a document really comes is the Poisson quantile of a uniform number that a
keyed hash of its id gives: the same documents, weights and seed always give the same mixture, and a
document's number doesn't depend on any other. The copies then are dealt over the cluster in the order of
another hash.

DataFrame functions only. Sources are counted with sums made before the shuffle; the table of rates has a
row for each weighted source and one for the others, so it is broadcast; a hot source is never a key.

Edge cases: a null source belongs to the others; sources without a document take no part and the
weights of the rest are scaled up; null ids share one uniform number per distinct text, as repeated
rows do for an id; null texts are mixed as any other; further columns come along, the added ones step
aside for clashing names; an empty table gives an empty mixture.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.llm.common import free_name

#: Hexadecimal digits of a hash that make a uniform number; 2 to that power of bits is exact in a double.
_DIGITS = 13


@dataclass(frozen=True)
class Mixture:
    """Target weights: shares of the rows that named sources shall have, and of all others together.

    `size` is the number of rows aimed at, as a multiple of the rows there are.
    """

    weights: Mapping[str, float]
    others: float
    size: float = 1.0
    seed: str = "mix"


def _uniform(seed: str, purpose: str, *parts: Column) -> Column:
    """A number in [0, 1) from a hash of the parts. Null parts count as `null`."""
    keyed = F.concat_ws("|", F.lit(f"{seed}|{purpose}"), *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts))
    digits = F.conv(F.substring(F.md5(keyed), 1, _DIGITS), 16, 10).cast("double")
    return digits / float(16**_DIGITS)


def _cumulative(rate: Column) -> Column:
    """Cumulative Poisson probabilities of 0, 1, 2 ... as far as they matter, from their logarithms.

    `exp(-rate)` itself would be 0 for a large rate.
    """
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    start = F.struct((-rate).alias("log"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("all"))

    def step(state: Column, k: Column) -> Column:
        log = state["log"] + F.ln(rate) - F.ln(k.cast("double"))
        total = state["sum"] + F.exp(log)
        return F.struct(log.alias("log"), total.alias("sum"), F.concat(state["all"], F.array(total)).alias("all"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), last), start, step, lambda s: s["all"])).otherwise(
        F.array(F.lit(1.0))
    )


def rates(docs: DataFrame, mixture: Mixture, source: str = "source") -> DataFrame:
    """(bucket, rate, cdf): the mean number of copies of a document of each weighted source.

    `bucket` is null for all other sources. As many rows as there are weights, and one, at most.
    """
    named = sorted(mixture.weights)
    bucket = F.when(F.col(source).isin(named), F.col(source))
    counts = docs.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    weight = F.lit(float(mixture.others))
    for name in named:
        weight = F.when(F.col("bucket") == name, float(mixture.weights[name])).otherwise(weight)
    present = counts.withColumn("weight", weight)
    totals = present.agg(F.sum("n").alias("total"), F.sum("weight").alias("all_weights"))
    # One row joined to at most len(weights) + 1 rows.
    return present.join(F.broadcast(totals)).select(
        "bucket",
        F.when(
            F.col("all_weights") > 0,
            F.col("weight") / F.col("all_weights") * F.col("total") * float(mixture.size) / F.col("n"),
        ).otherwise(0.0).alias("rate"),
    ).withColumn("cdf", _cumulative(F.col("rate")))


def mixed(
    docs: DataFrame, mixture: Mixture, key: str = "doc_id", text: str = "text", source: str = "source"
) -> DataFrame:
    """The documents' columns and `copy` (from 1), `copies`, `rate` and `place` (order of the shuffle).

    Names that the documents use already get `_` at their end.
    """
    rate_of = rates(docs, mixture, source).select(
        F.col("bucket").alias("_bucket"), F.col("rate").alias("_rate"), F.col("cdf").alias("_cdf")
    )
    names = {name: free_name(docs, name) for name in ("copy", "copies", "rate", "place")}
    bucket = F.when(docs[source].isin(sorted(mixture.weights)), docs[source])
    columns = [docs[c] for c in docs.columns]
    # An id stands for its document; without one the text does.
    identity = F.coalesce(docs[key].cast("string"), F.sha2(docs[text], 256))
    joined = docs.join(F.broadcast(rate_of), bucket.eqNullSafe(F.col("_bucket"))).select(
        *columns,
        F.col("_rate").alias(names["rate"]),
        F.size(F.filter("_cdf", lambda c: c <= _uniform(mixture.seed, "copies", identity))).alias(names["copies"]),
        identity.alias("_identity"),
    )
    exploded = joined.filter(F.col(names["copies"]) > 0).select(
        "*", F.explode(F.sequence(F.lit(1), F.col(names["copies"]))).alias(names["copy"])
    )
    placed = exploded.withColumn(
        names["place"], _uniform(mixture.seed, "place", F.col("_identity"), F.col(names["copy"]))
    )
    return (
        placed.repartitionByRange(names["place"]).sortWithinPartitions(names["place"])
        .select(*docs.columns, *(names[n] for n in ("copy", "copies", "rate", "place")))
    )
