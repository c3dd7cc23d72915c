"""Mixing sources to target weights (native: DataFrame functions only).

Words are summed per source; targets follow from the weights by water-filling; the repetition rate of a source is its target
over its size; each document is emitted floor(rate) times, and once more if a uniform number drawn from the hash of seed and
identifier lies below the rate's fraction.

Independent draws miss the target of a source of few documents by as much as its longest ones weigh. So a source's draws may be turned
together by one of PHASES equal steps around the unit circle, which leaves each draw uniform; the words that each step would take are
summed in one aggregate, and the step nearest to the target (the first of equals) is taken.

Targets: the weighted share of the total that a source would get is cut off at `cap` times its size, and what is cut off is
shared again by weight until no target is above its cap. That is the level L with sum(min(cap_i, L * weight_i)) = total, found
by one pass over the sources in the order of cap_i / weight_i. Only the table of sources (one row each) is ordered as a whole.

Edge cases: null or empty text has size 0 and is taken 0 words; a null source is a source, the last; a source without words
has rate 0; if all caps together are below the total every target is its cap; an empty table gives an empty result; rows that
share an identifier share their draw; documents without identifier draw as the identifier ''; a very long text is counted whole and taken
or not as a whole; equal rows are taken alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SALTS, materialise, n_words

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
SEED = "mix-1"
#: Steps by which a source's draws may be turned.
PHASES = 64


def uniform(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the first 52 bits of the MD5 of seed and identifier."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """sizes: (source, source_size), one row a source. Adds weight, target and rate."""
    by_name = W.orderBy(F.col("source").isNull(), F.col("source"))
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    ranked = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    ranked = ranked.withColumn("limit", F.col("source_size") * cap).withColumn("fill", F.col("limit") / F.col("weight"))
    full = W.orderBy("fill", F.col("source").isNull(), "source")
    before = full.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    ranked = (
        ranked.withColumn("total", F.sum("source_size").over(everything) * share)
        .withColumn("full_before", F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        .withColumn("open_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("full_before")) / F.col("open_weight"))
    )
    # the level falls from the first source that it does not fill; there it is the water level
    ranked = ranked.withColumn("level", F.max(F.when(F.col("level") <= F.col("fill"), F.col("level"))).over(everything))
    target = F.when(F.col("level").isNull(), F.col("limit")).otherwise(F.least(F.col("limit"), F.col("level") * F.col("weight")))
    return ranked.withColumn("target", target).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)).select("source", "source_size", "weight", "target", "rate")


#: Up to so many sources the table of rates (some 60 bytes a row) is broadcast; more are joined by a shuffle, dealt over SALTS parts.
BROADCAST_SOURCES = 20_000


def _turned(draw: Column, phase: Column) -> Column:
    """A draw turned by some steps; both are multiples of powers of two, so nothing is rounded."""
    moved = draw + phase / F.lit(float(PHASES))
    return moved - F.floor(moved)


def _once_more(rate: Column, draw: Column, phase: Column) -> Column:
    return F.when(_turned(draw, phase) < rate - F.floor(rate), 1).otherwise(0)


def _with_rates(rows: DataFrame, rates: DataFrame, few: bool, source: str, key: Column) -> DataFrame:
    """rows with their source's (target, rate, ...); a source of a third of all rows is dealt over parts where rates are not broadcast."""
    rates = rates.withColumnRenamed("source", "_mix_source")
    same = rows[source].eqNullSafe(F.col("_mix_source"))
    if few:
        return rows.join(F.broadcast(rates), same).drop("_mix_source")
    rates = rates.withColumn("_mix_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("_mix_salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))
    return rows.join(rates, rows[source].eqNullSafe(F.col("_mix_source")) & (F.col("_mix_salt") == F.col("_mix_part"))).drop("_mix_source", "_mix_part", "_mix_salt")


def _rates(sized: DataFrame, **how) -> tuple[DataFrame, bool]:
    """sized: (source, size, draw), written. Targets, rates and phases per source, written; whether they are few."""
    targets = materialise(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), **how), "targets")
    few = targets.count() <= BROADCAST_SOURCES
    drawn = _with_rates(sized, targets.select("source", "rate"), few, "source", F.col("draw"))
    more = [F.sum(F.col("size") * _once_more(F.col("rate"), F.col("draw"), F.lit(float(k)))).cast("double").alias(f"more{k}") for k in range(PHASES)]
    taken = drawn.groupBy("source").agg(*more)
    joined = targets.join(F.broadcast(taken) if few else taken, targets["source"].eqNullSafe(taken["source"])).drop(taken["source"])
    misses = F.array(*[F.abs(F.floor("rate") * F.col("source_size") + F.col(f"more{k}") - F.col("target")) for k in range(PHASES)])
    phase = (F.array_position(misses, F.array_min(misses)) - 1).cast("double")
    return materialise(joined.select("source", "source_size", "target", "rate", phase.alias("phase")), "rates"), few


def _copies(draw: Column) -> Column:
    return (F.floor("rate") + _once_more(F.col("rate"), draw, F.col("phase"))).cast("long")


def plan(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED, **how) -> DataFrame:
    """One row per document: key, size, source_size, target, rate, copies."""
    sized = materialise(docs.select(F.col(key).alias("id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), uniform(F.col(key), seed).alias("draw")), "sizes")
    rows = _with_rates(sized, *_rates(sized, **how), "source", F.col("draw"))
    return rows.select(F.col("id").alias(key), "size", "source_size", "target", "rate", _copies(F.col("draw")).alias("copies"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED, **how) -> DataFrame:
    """The mixed corpus: every document as often as its rate says, with its columns and the copy's number `copy` from 0 (a
    column of that name in the input gives way)."""
    sized = materialise(docs.select(F.col(source).alias("source"), n_words(F.col(text)).alias("size"), uniform(F.col(key), seed).alias("draw")), "sizes")
    rates, few = _rates(sized, **how)
    rates = rates.select("source", F.struct("rate", "phase").alias("_mix_how"))
    rows = _with_rates(docs, rates, few, source, uniform(docs[key], seed))
    more = _once_more(F.col("_mix_how.rate"), uniform(docs[key], seed), F.col("_mix_how.phase"))
    rows = rows.withColumn("_mix_copies", (F.floor("_mix_how.rate") + more).cast("int")).filter("_mix_copies > 0")
    return rows.select(*[docs[c] for c in docs.columns if c != "copy"], F.explode(F.sequence(F.lit(0), F.col("_mix_copies") - 1)).alias("copy"))
