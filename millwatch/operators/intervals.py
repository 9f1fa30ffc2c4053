"""Intervals of one table met with those of another, and paired one to one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import saved

DIGITS = 9


def overlapping(left: DataFrame, right: DataFrame, bucket_s: float = 600.0) -> DataFrame:
    """run_id, left, right (structs start_s, end_s), overlap_s, share (of what both cover together) of every pair of
    intervals (run_id, start_s, end_s) of a run that meet in more than a point.

    Each interval lies in the buckets that it touches; a pair counts in the first bucket that both have, so long
    recordings spread by bucket and no pair comes twice.
    """

    def spread(rows: DataFrame, name: str) -> DataFrame:
        sound = rows.where("start_s < end_s").select("run_id", F.struct("start_s", "end_s").alias(name)).distinct()
        first, last = F.floor(F.col(f"{name}.start_s") / bucket_s), F.floor(F.col(f"{name}.end_s") / bucket_s)
        return sound.withColumn(f"{name}_first", first).withColumn("bucket", F.explode(F.sequence(first, last)))

    met = spread(left, "left").join(spread(right, "right"), ["run_id", "bucket"]).where("bucket = greatest(left_first, right_first)")
    overlap = F.least("left.end_s", "right.end_s") - F.greatest("left.start_s", "right.start_s")
    both = F.greatest("left.end_s", "right.end_s") - F.least("left.start_s", "right.start_s")
    return met.select("run_id", "left", "right", overlap.alias("overlap_s"), F.round(overlap / both, DIGITS).alias("share")).where("overlap_s > 0")


def paired(pairs: DataFrame) -> DataFrame:
    """Of ``overlapping`` pairs those that give each interval one partner at most: the pair of the greatest share first
    (ties: the earlier left, then right), and so on among those left free.

    Found in rounds: pairs that both sides like best are taken, at once in all runs, and their intervals leave.
    """
    free, taken = saved(pairs, "pairs"), []
    while not free.isEmpty():
        rank = lambda side: F.max_by(F.struct("left", "right"), F.struct(F.col("share"), -F.col(f"{side}.start_s"), -F.col(f"{side}.end_s"))).alias("likes")
        mine = free.groupBy("run_id", "left").agg(rank("right")).select("run_id", "likes.left", "likes.right")
        theirs = free.groupBy("run_id", "right").agg(rank("left")).select("run_id", "likes.left", "likes.right")
        both = saved(free.join(mine, ["run_id", "left", "right"], "left_semi").join(theirs, ["run_id", "left", "right"], "left_semi"), "paired")
        taken.append(both)
        free = saved(free.join(both.select("run_id", "left"), ["run_id", "left"], "left_anti").join(both.select("run_id", "right"), ["run_id", "right"], "left_anti"), "pairs")
    out = taken[0] if taken else pairs.limit(0)
    for more in taken[1:]:
        out = out.unionByName(more)
    return out


def graded(events: DataFrame, labels: DataFrame, least_share: float = 0.0) -> DataFrame:
    """For each run with either: n_events, n_labels, n_matched (pairs of ``paired`` with at least that share), precision,
    recall and mean_share of the matched. Both tables: run_id, start_s, end_s; intervals that repeat count once, those
    without length or time not at all."""
    sound = lambda rows: saved(rows.where("start_s < end_s").select("run_id", "start_s", "end_s").distinct(), "intervals")
    events, labels = sound(events), sound(labels)
    matched = paired(overlapping(events, labels).where(F.col("share") >= least_share))
    count = lambda rows, name: rows.groupBy("run_id").agg(F.count("*").alias(name))
    out = count(events, "n_events").join(count(labels, "n_labels"), "run_id", "full")
    out = out.join(matched.groupBy("run_id").agg(F.count("*").alias("n_matched"), F.avg("share").alias("mean_share")), "run_id", "left").fillna(0, ["n_events", "n_labels", "n_matched"])
    return out.select("run_id", "n_events", "n_labels", "n_matched", F.try_divide("n_matched", "n_events").alias("precision"), F.try_divide("n_matched", "n_labels").alias("recall"), "mean_share")
