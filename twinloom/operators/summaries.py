"""Aggregates over measurements: votes, presence, colour, latencies, progress."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def language_vote(votes: DataFrame, key: str) -> DataFrame:
    """(key, lang, confidence) of votes (key, turn, lang, prob): the language with the greatest sum of probabilities, the earliest
    of equal ones, and its mean. Sums are of whole hundredths, so they don't depend on the order of addition."""
    sums = votes.filter("lang <> 'unknown'").groupBy(key, "lang").agg(F.sum(F.round(F.col("prob") * 100).cast("long")).alias("total"), F.avg("prob").alias("confidence"), F.min("turn").alias("first"))
    best = F.min_by(F.struct("lang", "confidence"), F.struct(-F.col("total"), "first")).alias("v")
    return sums.groupBy(key).agg(best).select(key, "v.lang", "v.confidence")


def presence(probes: DataFrame, key: str, level_db: float = -60.0) -> DataFrame:
    """(key, audio_coverage) of probes (key, point, stream, db): the share of judged points at which any stream is louder than the
    level; 1.0 if no point could be judged."""
    points = probes.groupBy(key, "point").agg(F.max("db").alias("db"))
    return points.groupBy(key).agg(F.coalesce(F.avg(F.when(F.col("db").isNotNull(), (F.col("db") > level_db).cast("double"))), F.lit(1.0)).alias("audio_coverage"))


def longest_segment(segments: DataFrame, key: str) -> DataFrame:
    """(key, start, end) of the longest segment, the earliest of equal ones."""
    return segments.groupBy(key).agg(F.max_by(F.struct("start", "end"), F.struct(F.col("end") - F.col("start"), -F.col("start"))).alias("s")).select(key, "s.start", "s.end")


def color_descriptor(pixels: DataFrame, key: str = "path") -> DataFrame:
    """Colour statistics of pixel rows (key, r, g, b): clipped share, spread of channel means, saturation, contrast."""
    luma, mx, mn = F.col("r") * 0.299 + F.col("g") * 0.587 + F.col("b") * 0.114, F.greatest("r", "g", "b"), F.least("r", "g", "b")
    means = [F.avg(c) for c in "rgb"]
    return pixels.groupBy(key).agg(
        F.avg(F.when((luma < 5) | (luma > 250), 1.0).otherwise(0.0)).alias("clip"), ((F.greatest(*means) - F.least(*means)) / 255.0).alias("cast_"),
        F.avg((mx - mn) / (mx + 1e-6)).alias("saturation"), F.stddev_pop(luma / 255.0).alias("contrast"),
    )


def latency(probes: DataFrame, key: str, value: str) -> DataFrame:
    """(key, median, n) of measured latencies; exact, for few rows a key."""
    return probes.groupBy(key).agg(F.median(value).alias("median"), F.count(value).alias("n"))


def progress(jobs: DataFrame, group: str, order: str, size: str) -> DataFrame:
    """Adds `done`: the share of a group's bytes that is through once the job is, in order."""
    own = W.partitionBy(group)
    run = own.orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return jobs.withColumn("done", F.sum(size).over(run) / F.sum(size).over(own))
