"""The verdict of a pair: one CASE expression, first match wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..config import Thresholds
from ..functions.scalar import long_coverage

#: Columns of a signal row; those that are missing count as the default.
DEFAULTS = {
    "hash_a": None, "hash_b": None, "size_a": None, "size_b": None, "dur_a": 3600.0, "dur_b": 3600.0, "density_a": 0.0, "density_b": 0.0,
    "a_score": 0.0, "v_score": 0.0, "v_coverage": 0.0, "superset": False, "s_score": 0.0,
}


def decision(th: Thresholds | None = None, theta_v: Column | None = None, theta_a: Column | None = None, have: set[str] | None = None) -> Column:
    """struct(verdict, confidence, tier) of the signal columns; theta_v and theta_a may be columns, for sweeps."""
    th = th or Thresholds()
    c = {k: F.col(k) if have is None or k in have else F.lit(v) for k, v in DEFAULTS.items()}
    tv, ta = (F.lit(th.theta_v) if theta_v is None else theta_v), (F.lit(th.theta_a) if theta_a is None else theta_a)
    v, a, s, cov = c["v_score"], c["a_score"], c["s_score"], c["v_coverage"]
    distinct = F.least(c["dur_a"], c["dur_b"]) >= th.min_strong_duration_s
    covered = cov >= th.min_coverage
    part = long_coverage(cov, c["dur_a"], c["dur_b"]) < th.min_coverage_long
    row = lambda verdict, confidence, tier: F.struct(F.lit(verdict).alias("verdict"), (F.lit(confidence) if not isinstance(confidence, Column) else confidence).cast("double").alias("confidence"), F.lit(tier).alias("tier"))
    return (
        F.when((c["hash_a"] == c["hash_b"]) & (c["size_a"] == c["size_b"]), row("CERTAIN", 1.0, "T0"))
        .when(distinct & (v >= tv) & c["superset"], row("DIFFERENT_EDITION", F.least(F.lit(0.90), v), "edition"))
        .when((v >= tv) & covered & part, row("CONTAINS", F.least(F.lit(0.85), v), "contains"))
        .when(distinct & (a >= ta) & (v >= tv) & covered, row("CERTAIN", 0.99, "T1"))
        .when(distinct & (v >= th.theta_v_high) & covered & (a < th.theta_a_low), row("VERY_HIGH", 0.95, "T2"))
        .when(distinct & (v >= tv) & covered & (s >= th.theta_s), row("HIGH", 0.88, "T3"))
        .when((s >= th.theta_s_high) & (v < tv) & (c["density_a"] >= th.min_cut_density) & (c["density_b"] >= th.min_cut_density), row("PROBABLE", 0.65, "T4"))
        .when((v >= tv) & covered, row("PROBABLE", 0.55, "T4b"))
        .otherwise(row("DIFFERENT", 0.0, "T5"))
    )


def decide(signals: DataFrame, th: Thresholds | None = None) -> DataFrame:
    """Adds verdict, confidence and tier."""
    return signals.withColumn("_d", decision(th, have=set(signals.columns))).select("*", "_d.*").drop("_d")


def route(verdict: Column) -> Column:
    """Where a verdict goes: duplicates, review, editions or nowhere."""
    return F.when(verdict.isin(*schema.DUPLICATE), "duplicate").when(verdict == "PROBABLE", "review").when(verdict.isin("DIFFERENT_EDITION", "CONTAINS"), "editions").when(verdict == "NAME_COPY", "name_copy").otherwise("none")


def needs_audio(th: Thresholds) -> Column:
    """Whether the audio signal can still matter, once video is known."""
    return (F.col("v_score") >= th.theta_v) & (F.col("v_coverage") >= th.min_coverage)


def canonical_match(matches: DataFrame) -> DataFrame:
    """Smaller end first; what has a direction changes its sign with the order of the ends."""
    swap = F.col("a") > F.col("b")
    flips = [c for c in ("ad_offset_s", "superset_dir", "ad_dir") if c in matches.columns]
    rest = [c for c in matches.columns if c not in ("a", "b", *flips)]
    return matches.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *[F.when(swap, -F.col(c)).otherwise(F.col(c)).alias(c) for c in flips], *rest)
