"""Derived views: clusters with their files, verdicts, drift and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Thresholds
from ..functions.scalar import verdict_rank


def cluster_view(clusters: DataFrame, files: DataFrame, overrides: DataFrame, th: Thresholds) -> DataFrame:
    """clusters (cluster_id, path, is_keep) with files (path, size, height, audio_coverage); a missing file counts as zeros. A valid
    override makes the coverage 1.0."""
    own = overrides.select(F.col("path").alias("o_path")).distinct()
    out = clusters.join(files, "path", "left").join(own, F.col("path") == F.col("o_path"), "left")
    coverage = F.when(F.col("o_path").isNotNull(), 1.0).otherwise(F.coalesce("audio_coverage", F.lit(1.0)))
    return out.select("cluster_id", "path", "is_keep", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("height", F.lit(0)).alias("height"), coverage.alias("audio_coverage"))


def cluster_summary(view: DataFrame, th: Thresholds) -> DataFrame:
    """Copies, reclaimable bytes and audio warning per cluster; clusters of one are dropped."""
    return view.groupBy("cluster_id").agg(
        F.count("*").alias("n_copies"), F.sum(F.when(~F.col("is_keep"), F.col("size")).otherwise(0)).alias("reclaimable"),
        ((F.min("audio_coverage") < th.audio_ok) & (F.max("audio_coverage") - F.min("audio_coverage") > th.audio_tolerance)).alias("audio_warning"),
    ).filter("n_copies > 1")


def representative(matches: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster_id, verdict, confidence): the strongest verdict within each cluster; of equal rank the highest confidence, then
    the smallest pair."""
    own = clusters.select("cluster_id", "path")
    inside = matches.join(own.select(F.col("cluster_id").alias("ca"), F.col("path").alias("a")), "a").join(own.select(F.col("cluster_id").alias("cb"), F.col("path").alias("b")), "b").filter("ca = cb")
    first = F.min_by(F.struct("verdict", "confidence"), F.struct(-verdict_rank(F.col("verdict")), -F.col("confidence"), "a", "b")).alias("r")
    return inside.groupBy(F.col("ca").alias("cluster_id")).agg(first).select("cluster_id", "r.verdict", "r.confidence")


SORTS = {"copies": ["n_copies"], "space": ["reclaimable"], "confidence": ["confidence"]}


def sort_clusters(summary: DataFrame, by: str) -> DataFrame:
    """By copies, space or confidence, most first, then title; an unknown name means copies."""
    return summary.orderBy(*[F.desc(c) for c in SORTS.get(by, SORTS["copies"])], "title")


def drift(matches: DataFrame, files: DataFrame, version: str) -> dict[str, DataFrame]:
    """Files in matches, and those of them whose features are of another version."""
    ends = matches.select(F.col("a").alias("path")).union(matches.select("b")).distinct()
    known = files.join(ends, "path", "left_semi")
    return {"matched": ends, "stale": known.filter(F.col("feature_version") != version).select("path")}


def library_coverage(files: DataFrame, vector: str = "global_vec") -> DataFrame:
    return files.agg(F.count("*").alias("n_files"), F.count(vector).alias("n_indexed"))


def actionable(verdict: Column, warning: Column) -> Column:
    return verdict.isin("CERTAIN", "VERY_HIGH", "HIGH", "NAME_COPY") & ~warning


def search(summary: DataFrame, text: str, title: str = "title", members: str = "members") -> DataFrame:
    """Clusters whose title or any member holds the text, whatever the case."""
    q = text.lower()
    return summary.filter(F.lower(title).contains(q) | F.exists(F.col(members), lambda m: F.lower(m).contains(q)))


def within_height(rows: DataFrame, most: int, height: str = "height") -> tuple[DataFrame, DataFrame]:
    """(rows of at most that height or of an unknown one, the rows that are excluded)."""
    ok = F.col(height).isNull() | (F.col(height) <= most)
    return rows.filter(ok), rows.filter(~ok)


def audio_warnings(files: DataFrame, overrides: DataFrame, th: Thresholds) -> DataFrame:
    """Files whose audio covers too little, without those that a user overrode, the least coverage first."""
    low = files.filter(F.col("audio_coverage") < th.audio_ok)
    return low.join(overrides.select("path").distinct(), "path", "left_anti").orderBy("audio_coverage", "path")
