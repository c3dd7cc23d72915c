"""Copies by name: files of a folder that differ in a trailing (N) only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import name_key


def name_siblings(files: DataFrame, path: str = "path") -> DataFrame:
    """(a, b): a star from the preferred file (shortest path, then smallest) of each name to its siblings."""
    rows = files.select(F.col(path).alias("p")).distinct().withColumn("key", name_key(F.col("p")))
    own = W.partitionBy("key").orderBy(F.length("p"), "p")
    return rows.withColumn("a", F.first("p").over(own)).filter("a <> p").select("a", F.col("p").alias("b"))


def name_copies(siblings: DataFrame, matches: DataFrame, content: DataFrame) -> DataFrame:
    """NAME_COPY edges: siblings without a match whose content verdict (content: a, b, verdict) is known and not DIFFERENT."""
    end = lambda d: d.withColumn("x", F.least("a", "b")).withColumn("y", F.greatest("a", "b")).drop("a", "b")
    out = end(siblings).join(end(matches.select("a", "b")), ["x", "y"], "left_anti").join(end(content.select("a", "b", "verdict").filter("verdict <> 'DIFFERENT'")), ["x", "y"], "left_semi")
    return out.select(F.col("x").alias("a"), F.col("y").alias("b"), F.lit("NAME_COPY").alias("verdict"), F.lit(0.75).alias("confidence"))
