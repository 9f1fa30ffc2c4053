"""Projections to canonical columns, row contracts with quarantine, and counters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.scalars import REGIMES, SPLITS, number

# Channels of a recording.
CANONICAL = ("time_s", "ax", "ay", "az")
OPTIONAL = ("ae", "sound", "force_x", "force_y", "force_z", "spindle_current")
# End of fixed values.


def renamed(df: DataFrame, column_map: Mapping[str, str], keys: Sequence[str] = ()) -> DataFrame:
    """Keys, then the canonical and optional channels there are, renamed and made numbers; nothing else."""
    target = {src: dst for src, dst in column_map.items() if src in df.columns}
    names = {target.get(c, c): c for c in df.columns}
    return df.select(*keys, *[number(F.col(f"`{names[c]}`").cast("string")).alias(c) for c in (*CANONICAL, *OPTIONAL) if c in names])


def with_violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """``violations``: names of the rules that a row breaks. A rule is a condition that must be true."""
    broken = [F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]
    return df.withColumn("violations", F.array_compact(F.array(*broken)))


def kept(df: DataFrame) -> DataFrame:
    return df.where(F.size("violations") == 0).drop("violations")


def quarantined(df: DataFrame) -> DataFrame:
    return df.where(F.size("violations") > 0)


def spans_ordered(spans: Column) -> Column:
    return F.forall(spans, lambda s: s["start_s"].isNotNull() & s["end_s"].isNotNull() & (s["end_s"] >= s["start_s"]))


def incident_rules() -> dict[str, Column]:
    """What must hold of an incident."""
    return {
        "window": F.col("window_end_s") >= F.col("window_start_s"), "rate": F.col("fs_hz") > 0, "regime": F.col("regime_label").isin(*REGIMES), "split": F.col("split").isin(*SPLITS),
        "severity": F.col("severity_label").isin("low", "med", "high", "unknown"), "alignment": F.col("alignment_method").isin("label_match", "idle_fallback", "none"),
        "sensor_spans": spans_ordered(F.col("sensor_relevant_spans")), "video_spans": spans_ordered(F.col("video_relevant_spans")), "clip": (F.size("video_relevant_spans") == 0) | F.col("video_file").isNotNull(),
    }


def counters(df: DataFrame, **notes: Column) -> DataFrame:
    """One row: discovered, written and errors of rows with ``violations``, and how many rows each note holds for."""
    valid = F.size("violations") == 0
    return df.agg(F.count("*").alias("discovered"), F.count_if(valid).alias("written"), F.count_if(~valid).alias("errors"), *[F.count_if(c).alias(name) for name, c in notes.items()])


def observed(df: DataFrame, **notes: Column) -> tuple[DataFrame, Observation]:
    """``df`` (rows with ``violations``) and what ``counters`` says of it once an action has gone over all of it: the
    write itself counts, with no pass of its own. ``counts_of`` waits for the action."""
    seen, valid = Observation(), F.size("violations") == 0
    told = [F.count(F.lit(1)).alias("discovered"), F.count_if(valid).alias("written"), F.count_if(~valid).alias("errors"), *[F.count_if(c).alias(name) for name, c in notes.items()]]
    return df.observe(seen, *told), seen


def counts_of(df: DataFrame, seen: Observation) -> DataFrame:
    """What was counted, as one row."""
    return df.sparkSession.createDataFrame([tuple(seen.get.values())], ", ".join(f"`{c}` bigint" for c in seen.get))
