"""Which copy of a cluster to keep: quality score, then audio, then colour. Quality never changes a verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Thresholds
from ..functions.scalar import effective_bitrate, grade_distance


def quality_score(th: Thresholds, lang_ok: Column | None = None) -> Column:
    """From width, height, vcodec, bitrate_kbps, has_ads, cam_score and clip."""
    zero = F.lit(0)
    return (
        F.when(F.lit(False) if lang_ok is None else F.coalesce(lang_ok, F.lit(False)), 1e9).otherwise(0.0)
        + F.coalesce("width", zero) * F.coalesce("height", zero)
        - F.when(F.coalesce("has_ads", F.lit(False)), 5e5).otherwise(0.0)
        - F.coalesce("cam_score", F.lit(0.0)) * 1e5
        - F.coalesce("clip", F.lit(0.0)) * th.clip_weight
        + effective_bitrate(F.col("vcodec"), F.col("bitrate_kbps"))
    )


def ranked(members: DataFrame, cluster: str = "cluster_id", path: str = "path", score: str = "score") -> DataFrame:
    """Adds `rank`: best score first, then the shortest path, then the smallest."""
    own = W.partitionBy(cluster).orderBy(F.desc(score), F.length(F.col(path).cast("string")), path)
    return members.withColumn("rank", F.row_number().over(own))


def keep_by_audio(members: DataFrame, th: Thresholds, cluster: str = "cluster_id", path: str = "path") -> DataFrame:
    """(cluster, keep, audio_warning) of ranked members with audio_coverage.

    The first clean copy down the ranking; without one the first copy, with a warning if the coverages differ.
    """
    clean = F.col("audio_coverage") >= th.audio_ok
    found = members.groupBy(cluster).agg(
        F.min_by(path, F.when(clean, F.col("rank"))).alias("clean"), F.min_by(path, "rank").alias("first"),
        (F.max("audio_coverage") - F.min("audio_coverage") > th.audio_tolerance).alias("differ"),
    )
    return found.select(cluster, F.coalesce("clean", "first").alias("keep"), (F.col("clean").isNull() & F.coalesce("differ", F.lit(False))).alias("audio_warning"))


def color_diverges(members: DataFrame, th: Thresholds, cluster: str = "cluster_id", path: str = "path") -> DataFrame:
    """(cluster, diverges): whether any two members' grades differ enough. members: (cluster, path, color).

    Within a cluster, not over the library. Only distinct grades are paired.
    """
    own = members.select(cluster, "color").filter(F.col("color").isNotNull()).distinct()
    x, y = own.alias("x"), own.alias("y")
    order = F.struct("x.color.cast", "x.color.saturation", "x.color.contrast") < F.struct("y.color.cast", "y.color.saturation", "y.color.contrast")
    far = x.join(y, (F.col(f"x.{cluster}") == F.col(f"y.{cluster}")) & order & (grade_distance(F.col("x.color"), F.col("y.color")) > th.grade_divergence)).select(F.col(f"x.{cluster}").alias(cluster)).distinct().withColumn("diverges", F.lit(True))
    return members.select(cluster).distinct().join(far, cluster, "left").select(cluster, F.coalesce("diverges", F.lit(False)).alias("diverges"))


def keep_by_color(members: DataFrame, keeps: DataFrame, th: Thresholds, cluster: str = "cluster_id", path: str = "path") -> DataFrame:
    """keeps with `keep` changed to the least clipped copy where grades diverge and the kept copy clips clearly more, unless
    that copy has lost its audio. members: ranked, with color and audio_coverage."""
    least = members.groupBy(cluster).agg(F.min_by(F.struct(F.col(path).alias("p"), F.col("color.clip").alias("clip"), F.col("audio_coverage").alias("cov")), F.struct("color.clip", "rank")).alias("least"))
    kept = members.select(F.col(cluster).alias("c"), F.col(path).alias("p"), F.col("color.clip").alias("keep_clip"), F.col("audio_coverage").alias("keep_cov"))
    rows = keeps.join(color_diverges(members, th, cluster, path), cluster).join(least, cluster).join(kept, (F.col(cluster) == F.col("c")) & (F.col("keep") == F.col("p")))
    change = F.col("diverges") & (F.col("keep_clip") - F.col("least.clip") > th.clip_margin) & ~((F.col("keep_cov") >= th.audio_ok) & (F.col("least.cov") < th.audio_ok))
    return rows.select(cluster, F.when(change, F.col("least.p")).otherwise(F.col("keep")).alias("keep"), "audio_warning", "diverges")


def carries_ads(matches: DataFrame, members: DataFrame, th: Thresholds, cluster: str = "cluster_id", path: str = "path") -> DataFrame:
    """(cluster, path, has_ads): whether a match within the cluster marks the member as the copy with inserted material.

    matches: a, b, ad_offset_s, interleaved_ratio, ad_dir.
    """
    own = members.select(F.col(cluster).alias("c"), F.col(path).alias("p"))
    mid = (F.lit(th.ad_interleaved_min) > 0) & (F.coalesce("interleaved_ratio", F.lit(0.0)) >= th.ad_interleaved_min)
    marks_b = F.coalesce(F.col("ad_offset_s") > th.min_ad_s, F.lit(False)) | (mid & (F.coalesce("ad_dir", F.lit(0)) == 1))
    marks_a = F.coalesce(F.col("ad_offset_s") < -th.min_ad_s, F.lit(False)) | (mid & (F.coalesce("ad_dir", F.lit(0)) == -1))
    inside = (
        matches.join(own.select(F.col("c").alias("ca"), F.col("p").alias("a")), "a").join(own.select(F.col("c").alias("cb"), F.col("p").alias("b")), "b").filter("ca = cb")
        .select("ca", F.explode(F.array(F.struct(F.col("a").alias("p"), marks_a.alias("ads")), F.struct(F.col("b").alias("p"), marks_b.alias("ads")))).alias("m"))
        .groupBy("ca", "m.p").agg(F.bool_or("m.ads").alias("ads"))
    )
    return own.join(inside, (F.col("c") == F.col("ca")) & (own["p"] == inside["p"]), "left").select(F.col("c").alias(cluster), own["p"].alias(path), F.coalesce("ads", F.lit(False)).alias("has_ads"))
