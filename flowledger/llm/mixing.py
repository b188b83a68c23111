"""Mixing sources to target weights by Poisson replication.

Each source has a mean repetition rate: its share of the mixture times the
corpus size over its own size.  A document's number of copies is the inverse of
the Poisson distribution with that mean at a uniform number hashed from its id,
so no state is kept and a rerun repeats every choice.  Rates above ``LONGEST``
are the sum of several such draws (Poisson variables add up), which keeps the
tables of cumulated probabilities short.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize
from .spans import bound

LONGEST = 32.0
MOST_SOURCES = 10_000
SALTS = 64
SEED = "mix"


def uniform(doc_id: Column, draw: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from 52 bits of an MD5 of the id, the number of the draw and the seed."""
    name = F.concat(F.lit(f"{seed}:"), draw.cast("string"), F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def cumulated(mean: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... until the rest is below any number that ``uniform`` tells apart."""
    last = F.ceil(mean + 12 * F.sqrt(mean) + 24).cast("int")
    step = lambda acc, k: F.struct((acc["p"] * mean / k).alias("p"), F.concat(acc["all"], F.array(F.element_at(acc["all"], -1) + acc["p"] * mean / k)).alias("all"))
    return F.aggregate(F.sequence(F.lit(1), last), F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("all")), step, lambda acc: acc["all"])


def rates(docs: DataFrame, source: str, text: str, weights: dict[str | None, float] | None = None, temperature: float = 0.5) -> DataFrame:
    """source and mean repetition rate.

    Sizes are code points of text plus one a document.  Without ``weights`` a
    source's weight is its size to the power ``temperature``; sources that given
    weights don't name get none.
    """
    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.sum(F.coalesce(F.char_length(text), F.lit(0)) + 1).cast("double").alias("size"))
    if weights is None:
        weight = F.sqrt("size") if temperature == 0.5 else F.pow("size", F.lit(float(temperature)))
    else:
        weight = F.coalesce(*[F.when(F.col("source").eqNullSafe(F.lit(k)), F.lit(float(v))) for k, v in weights.items()], F.lit(0.0)) if weights else F.lit(0.0)
    sized = sizes.withColumn("weight", weight)
    total = sized.agg(F.sum("size").alias("all_size"), F.sum("weight").alias("all_weight"))
    return sized.crossJoin(F.broadcast(total)).select("source", (F.try_divide(F.col("weight") * F.col("all_size"), F.col("all_weight") * F.col("size"))).alias("rate"))


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, temperature: float = 0.5, doc_id: str = "doc_id", source: str = "source", text: str = "text", seed: str = SEED) -> DataFrame:
    """The mixture: every column of ``docs`` and the number of the copy (``copy``, from 1), in a global random order.

    A null source is a source; a null text has size 1; null ids all hash alike,
    as do rows that repeat an id (with the same source they get as many copies).
    An existing column ``copy`` keeps its name and the new one gets an underscore.
    Which rows come out, and how often, depends on the rows alone; their order
    also on how the input is split, so that rows alike in all columns spread out.
    An empty table gives an empty one.
    """
    name, rate_source, table, draws, n, order = fresh(docs, "copy", "_rate_source", "_table", "_draws", "_n", "_order")
    rate = rates(docs, source, text, weights, temperature).where(F.col("rate") > 0)
    parts = F.ceil(F.col("rate") / LONGEST).cast("int")
    # Written once: both the count and the join read it, and sizes are summed in one pass over the rows.
    plan = materialize(rate.select(F.col("source").alias(rate_source), parts.alias(draws), cumulated(F.col("rate") / parts).alias(table)), "mixing-plan")
    if plan.limit(MOST_SOURCES + 1).count() <= MOST_SOURCES:
        joined = docs.join(F.broadcast(plan), docs[source].eqNullSafe(F.col(rate_source)))
    else:  # too many sources to send around: each one's rows go to SALTS places
        (salt,) = fresh(docs, "_salt")
        spread = plan.withColumn("_salt_r", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = docs.withColumn(salt, F.pmod(F.xxhash64(F.col(doc_id)), F.lit(SALTS)).cast("int"))
        joined = salted.join(spread, salted[source].eqNullSafe(F.col(rate_source)) & (F.col(salt) == F.col("_salt_r")))
    one = lambda i: bound(uniform(F.col(doc_id), i, seed), lambda u: F.size(F.filter(F.col(table), lambda c: c <= u)))
    counted = joined.withColumn(n, F.aggregate(F.sequence(F.lit(1), F.col(draws)), F.lit(0), lambda acc, i: acc + one(i))).where(F.col(n) > 0)
    copies = counted.select(*[counted[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col(n))).alias(name))
    shuffled = copies.withColumn(order, F.xxhash64(F.lit(seed), F.col(doc_id).cast("string"), F.col(name), F.monotonically_increasing_id()))
    return shuffled.repartition(F.col(order)).sortWithinPartitions(order).drop(order)
