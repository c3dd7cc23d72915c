"""Calibration from labelled pairs: confusion, threshold sweep, and re-deciding stored signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..config import Thresholds
from ..functions.scalar import is_same
from .decide import decision

#: Thresholds that a sweep tries.
GRID = tuple(round(0.50 + 0.05 * i, 2) for i in range(10))


def _bare(signals: DataFrame) -> set[str]:
    """A labelled signal has no files: durations are an hour, hashes differ, cuts are unknown."""
    return {"a_score", "v_score", "v_coverage", "superset", "s_score"} & set(signals.columns)


def with_verdicts(signals: DataFrame, th: Thresholds | None = None) -> DataFrame:
    """signals: label, a_score, v_score, v_coverage, s_score (and superset, genre). Adds verdict and same."""
    return signals.withColumn("verdict", decision(th, have=_bare(signals))["verdict"]).withColumn("same", is_same(F.col("label")))


def confusion_by_tier(signals: DataFrame, th: Thresholds | None = None) -> DataFrame:
    return with_verdicts(signals, th).groupBy("verdict").agg(F.count_if("same").alias("n_same"), F.count_if(~F.col("same")).alias("n_diff"))


def _share(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def confusion_by_genre(signals: DataFrame, th: Thresholds | None = None) -> DataFrame:
    """Precision and recall of the duplicate tiers per genre (null where undefined), and strict false positives."""
    rows = with_verdicts(signals, th).withColumn("dup", F.col("verdict").isin(*schema.DUPLICATE)).withColumn("strong", F.col("verdict").isin(*schema.STRONG))
    genre = F.coalesce(F.nullif(F.trim("genre"), F.lit("")), F.lit("(unlabeled)"))
    same, dup = F.col("same"), F.col("dup")
    out = rows.groupBy(genre.alias("genre")).agg(F.count("*").alias("n"), F.count_if(dup & same).alias("dup_same"), F.count_if(dup & ~same).alias("dup_diff"), F.count_if(same).alias("same_total"), F.count_if(~same & F.col("strong")).alias("fp_strict"))
    return out.select("genre", "n", _share(F.col("dup_same"), F.col("dup_same") + F.col("dup_diff")).alias("precision"), _share(F.col("dup_same"), F.col("same_total")).alias("recall"), "fp_strict")


def quality(signals: DataFrame, th: Thresholds | None = None) -> DataFrame:
    """Recall of the duplicate tiers and false positives of the strong ones, over all signals."""
    rows = with_verdicts(signals, th)
    caught = F.count_if(F.col("same") & F.col("verdict").isin(*schema.DUPLICATE))
    return rows.agg(F.coalesce(_share(caught, F.count_if("same")), F.lit(0.0)).alias("recall"), F.count_if(~F.col("same") & F.col("verdict").isin(*schema.STRONG)).alias("false_positives"))


def sweep(signals: DataFrame, th: Thresholds | None = None, grid: tuple[float, ...] = GRID) -> DataFrame:
    """(theta_v, theta_a, false_positives, recall) for every pair of thresholds. The grid is exploded on each signal's row, so
    one pass aggregates all of it; partial sums shuffle len(grid)^2 rows a task."""
    values = F.array(*[F.lit(x) for x in grid])
    rows = signals.withColumn("same", is_same(F.col("label"))).withColumn("theta_v", F.explode(values)).withColumn("theta_a", F.explode(values))
    rows = rows.withColumn("verdict", decision(th, F.col("theta_v"), F.col("theta_a"), have=_bare(signals))["verdict"])
    caught = F.count_if(F.col("same") & F.col("verdict").isin(*schema.DUPLICATE))
    return rows.groupBy("theta_v", "theta_a").agg(F.count_if(~F.col("same") & F.col("verdict").isin(*schema.STRONG)).alias("false_positives"), F.coalesce(_share(caught, F.count_if("same")), F.lit(0.0)).alias("recall"))


def suggest(signals: DataFrame, th: Thresholds | None = None, grid: tuple[float, ...] = GRID, least: int = 1) -> DataFrame:
    """One row: the thresholds with fewest false positives, then most recall, then the lowest; the present ones, marked as
    degenerate, if a class has too few labels."""
    th = th or Thresholds()
    best = sweep(signals, th, grid).orderBy("false_positives", F.desc("recall"), "theta_v", "theta_a").limit(1)
    counts = signals.agg(F.count_if(is_same(F.col("label"))).alias("n_same"), F.count_if(~is_same(F.col("label"))).alias("n_diff"))
    out = counts.join(best, F.lit(True), "left")
    bad = (F.col("n_same") < least) | (F.col("n_diff") < least)
    return out.select(bad.alias("degenerate"), "n_same", "n_diff", F.when(bad, th.theta_v).otherwise(F.col("theta_v")).alias("theta_v"), F.when(bad, th.theta_a).otherwise(F.col("theta_a")).alias("theta_a"), F.when(~bad, F.col("false_positives")).alias("false_positives"), F.when(~bad, F.round("recall", 3)).alias("recall"))


def report(signals: DataFrame, th: Thresholds | None = None, least: int = 1) -> dict[str, DataFrame]:
    """What a calibration run reports: confusion by verdict and genre, recall and strict false positives, the false positives of the
    strong verdicts, how many different pairs await review, and the thresholds to take."""
    rows = with_verdicts(signals, th)
    strong = rows.filter(~F.col("same") & F.col("verdict").isin(*schema.STRONG))
    review = rows.filter(F.col("verdict") == "PROBABLE").agg(F.count("*").alias("queued"), F.count_if(~F.col("same")).alias("noise"))
    out = {"verdicts": confusion_by_tier(signals, th), "quality": quality(signals, th), "strong_false_positives": strong, "review": review, "suggested": suggest(signals, th, least=least)}
    if "genre" in signals.columns:
        out["genres"] = confusion_by_genre(signals, th)
    return out


def transitions(signals: DataFrame, old: Thresholds, new: Thresholds) -> DataFrame:
    """(old_verdict, new_verdict, n): how verdicts of stored signals change; pairs without signals are left out."""
    have = set(signals.columns)
    rows = signals.filter(F.col("v_score").isNotNull())
    return rows.select(decision(old, have=have)["verdict"].alias("old_verdict"), decision(new, have=have)["verdict"].alias("new_verdict")).groupBy("old_verdict", "new_verdict").agg(F.count("*").alias("n"))


def redecide(matches: DataFrame, th: Thresholds) -> tuple[DataFrame, DataFrame]:
    """Stored signals decided anew: (rows that stay, with their new verdict; pairs that are now different and go)."""
    have = set(matches.columns)
    known = matches.filter(F.col("v_score").isNotNull())
    new = known.drop("verdict", "confidence", "tier").withColumn("_d", decision(th, have=have)).select("*", "_d.*").drop("_d")
    return new.filter("verdict <> 'DIFFERENT'"), new.filter("verdict = 'DIFFERENT'").select("a", "b")


def feedback_signals(feedback: DataFrame, matches: DataFrame, recompute) -> DataFrame:
    """Labelled signals of feedback (a, b, label): from the stored match where there is one, else from recompute(pairs), which gives
    (a, b, signal columns) for what it can; pairs without either are left out. Signal columns are those of a labelled signal."""
    columns = ["a_score", "v_score", "v_coverage", "superset", "s_score"]
    own = feedback.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "label")
    stored = matches.filter(F.col("v_score").isNotNull()).select("a", "b", *columns)
    known = own.join(stored, ["a", "b"])
    orphans = own.join(stored.select("a", "b"), ["a", "b"], "left_anti")
    return known.unionByName(orphans.join(recompute(orphans.select("a", "b")).select("a", "b", *columns), ["a", "b"]))
