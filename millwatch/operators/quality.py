"""Measures of a set of incidents, and its grade."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import is_malformed, list_of_json
from ..sources.shared import saved

# Measure, comparison, target by tier, level if missed.
HARD = ("pct_missing_sensor_file", "pct_missing_video_file", "pct_dangling_chunk_id", "pct_malformed_json", "pct_bad_span", "pct_duplicate_incident_id", "fs_hz_plausible_violations")
TARGETS = (
    ("total_incident_hours", ">=", 2.0, 72.0, "FAIL"),
    ("pct_with_sop_and_maint", ">=", 0.80, 0.95, "FAIL"),
    ("pct_with_video", ">=", 0.70, 0.90, "WARN"),
    ("pct_fully_multimodal", ">=", 0.60, 0.85, "WARN"),
    ("dominant_class_share", "<=", 0.80, 0.50, "WARN"),
    ("pct_unknown_failure", "<=", 0.70, 0.30, "WARN"),
    ("entropy_failure", ">=", 0.30, 0.60, "WARN"),
    ("pct_with_sensor_span", ">=", 0.90, 0.98, "WARN"),
    ("pct_event_near_zero", ">=", 0.90, 0.98, "WARN"),
    ("pct_label_match_alignment", ">=", 0.50, 0.75, "WARN"),
    ("n_video_clips", ">=", 20.0, 1000.0, "WARN"),
    ("text_pages_equiv", ">=", 30.0, 300.0, "WARN"),
)
#: List columns of incidents, and their types; index files hold them as JSON text.
SPANS = "array<struct<start_s:double,end_s:double>>"
LISTS = {"sop_chunk_ids": "array<string>", "maintenance_chunk_ids": "array<string>", "sensor_relevant_spans": SPANS, "video_relevant_spans": SPANS}
# End of fixed values.


def distribution(rows: DataFrame, *dimensions: str) -> DataFrame:
    """dimension, value, n for each value of each column, in one pass."""
    spread = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions]))
    return rows.select(spread.alias("x")).select("x.*").groupBy("dimension", "value").agg(F.count("*").alias("n"))


def balance(rows: DataFrame, column: str, unknown: str = "unknown") -> DataFrame:
    """dominant_class_share, pct_unknown, entropy (over the classes there are, 1 if they are even)."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"), F.count("*").alias("classes"))
    p = F.col("n") / F.col("total")
    both = counts.join(F.broadcast(total))
    entropy = F.when(F.max("classes") > 1, -F.sum(p * F.ln(p)) / F.ln(F.max("classes"))).otherwise(F.lit(0.0))
    return both.agg(F.max(p).alias("dominant_class_share"), F.coalesce(F.sum(F.when(F.col(column) == unknown, p)), F.lit(0.0)).alias("pct_unknown_failure"), entropy.alias("entropy_failure"))


def _sound(s: Column) -> Column:
    return s["start_s"].isNotNull() & s["end_s"].isNotNull() & (s["end_s"] >= s["start_s"])


def _share(condition: Column) -> Column:
    return F.coalesce(F.avg(F.coalesce(condition, F.lit(False)).cast("double")), F.lit(0.0))


def incident_measures(incidents: DataFrame, pre_s: float, post_s: float, low_fs: float = 10.0, high_fs: float = 200_000.0) -> DataFrame:
    """One row: the measures of incidents alone, in one aggregate."""
    duration = F.greatest(F.col("window_end_s") - F.col("window_start_s"), F.lit(0.0))
    spans = F.coalesce(F.col("sensor_relevant_spans"), F.array().cast(SPANS))
    sound = F.filter(spans, _sound)
    covered = F.aggregate(sound, F.lit(0.0), lambda total, s: total + s["end_s"] - s["start_s"])
    has_sop, has_maint, has_video = F.size("sop_chunk_ids") > 0, F.size("maintenance_chunk_ids") > 0, F.col("video_file").isNotNull()
    n = F.count("*")
    return incidents.agg(
        n.cast("double").alias("n_incidents"),
        (F.coalesce(F.sum(duration), F.lit(0.0)) / 3600).alias("total_incident_hours"),
        F.count_distinct("source_dataset").cast("double").alias("n_sensor_datasets_used"),
        _share(has_video).alias("pct_with_video"),
        _share(has_sop).alias("pct_with_sop"),
        _share(has_maint).alias("pct_with_maint"),
        _share(has_sop & has_maint).alias("pct_with_sop_and_maint"),
        _share(has_sop & has_maint & has_video).alias("pct_fully_multimodal"),
        F.avg(F.size("sop_chunk_ids")).alias("mean_sop_chunks"),
        F.avg(F.size("maintenance_chunk_ids")).alias("mean_maint_chunks"),
        F.coalesce(F.try_divide(n - F.count_distinct("incident_id"), n), F.lit(0.0)).alias("pct_duplicate_incident_id"),
        F.coalesce(F.sum(F.size(spans) - F.size(sound)) / F.greatest(F.lit(1), F.sum(F.size(spans))), F.lit(0.0)).alias("pct_bad_span"),
        F.avg(F.least(covered / F.when(duration == 0, 1.0).otherwise(duration), F.lit(1.0))).alias("mean_sensor_span_frac"),
        F.avg(F.size(spans)).alias("mean_sensor_span_count"),
        _share(F.size(spans) > 0).alias("pct_with_sensor_span"),
        _share(F.exists(sound, lambda s: (s["start_s"] <= 0) & (s["end_s"] >= 0))).alias("pct_event_near_zero"),
        _share(F.abs(duration - (pre_s + post_s)) > 1.0).alias("pct_window_len_mismatch"),
        F.count_if(~F.col("fs_hz").between(low_fs, high_fs)).cast("double").alias("fs_hz_plausible_violations"),
        _share(F.col("alignment_method") == "label_match").alias("pct_label_match_alignment"),
    )


def long_form(row: DataFrame) -> DataFrame:
    """metric, value of a one-row table of measures."""
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in row.columns])
    return row.select(F.explode(pairs).alias("x")).select("x.*")


def _texts(incidents: DataFrame) -> list[str]:
    """The list columns that are JSON text."""
    return [f.name for f in incidents.schema.fields if f.name in LISTS and isinstance(f.dataType, T.StringType)]


def malformed_lists(incidents: DataFrame) -> DataFrame:
    """One row, pct_malformed_json: the share of incidents with a list column whose text isn't a JSON list; columns
    that are lists already can't be malformed."""
    bad = F.lit(False)
    for c in _texts(incidents):
        bad = bad | F.coalesce(is_malformed(F.col(c)) | ~F.ltrim(c).startswith("["), F.lit(False))
    return incidents.agg(_share(bad).alias("pct_malformed_json"))


def lost_share(rows: DataFrame, present: DataFrame, keys: list[str], name: str) -> DataFrame:
    """One row: the share of ``rows`` whose keys aren't among ``present``'s."""
    there = present.select(*keys).distinct().withColumn("__there", F.lit(1))
    return rows.select(*keys).join(there, keys, "left").agg(F.coalesce(F.avg(F.col("__there").isNull().cast("double")), F.lit(0.0)).alias(name))


def measures(incidents: DataFrame, clips: DataFrame, chunks: DataFrame, pre_s: float, post_s: float, waveforms: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """metric, value of incidents, their balance, and the clips and chunks beside them.

    ``files``: path of every file there is, for video_file and sensor_file; without it clips are those of ``clips``.
    ``waveforms``: the table of samples, for incidents kept in it rather than in files of their own; a row for each
    source_dataset and incident_id suffices. Incidents that name recordings without either of the two have no
    pct_missing_sensor_file, which violates its target; those that neither name any nor come with waveforms miss none.
    List columns may be lists or JSON text.
    """
    malformed = malformed_lists(incidents)
    incidents = incidents.withColumns({c: list_of_json(F.col(c), LISTS[c]) for c in _texts(incidents)})
    named = incidents.select(F.explode(F.concat("sop_chunk_ids", "maintenance_chunk_ids")).alias("chunk_id"))
    lost = lost_share(named, chunks, ["chunk_id"], "pct_dangling_chunk_id")
    there = clips if files is None else files.withColumnRenamed("path", "video_file")
    no_clip = lost_share(incidents.where("video_file IS NOT NULL"), there, ["video_file"], "pct_missing_video_file")
    parts = [incident_measures(incidents, pre_s, post_s), balance(incidents, "failure_family"), lost, no_clip, malformed, clips.agg(F.count("*").alias("n_video_clips")), chunks.agg(F.coalesce(F.sum("n_tokens") / 500, F.lit(0.0)).alias("text_pages_equiv"))]
    if waveforms is not None:
        parts.append(lost_share(incidents, waveforms, ["source_dataset", "incident_id"], "pct_missing_sensor_file"))
    elif "sensor_file" not in incidents.columns:
        parts.append(incidents.agg(F.lit(0.0).alias("pct_missing_sensor_file")))
    elif files is not None:
        parts.append(lost_share(incidents, files.withColumnRenamed("path", "sensor_file"), ["sensor_file"], "pct_missing_sensor_file"))
    out = long_form(parts[0])
    for part in parts[1:]:
        out = out.unionByName(long_form(part))
    return out


def topic_link_relevance(incidents: DataFrame, chunks: DataFrame, family_topics: Mapping[str, Sequence[str]], k: int = 30, seed: int = 13) -> DataFrame:
    """metric, value: how many links from incidents to chunks were looked at, and the share of them whose chunk has a topic
    of the incident's failure family. Looked at are the ``k`` links whose seeded hashes are least: a sample that any
    cluster draws alike, of which no more than ``k`` rows of a task move. ``chunks``: chunk_id, topic_tags."""
    links = incidents.select("incident_id", "failure_family", F.explode(F.array_union("sop_chunk_ids", "maintenance_chunk_ids")).alias("chunk_id"))
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), "incident_id", "chunk_id"))
    looked = saved(links.orderBy(digest, "incident_id", "chunk_id").limit(k), "links")
    topics = F.coalesce(F.element_at(F.create_map(*[x for f, t in family_topics.items() for x in (F.lit(f), F.array(*map(F.lit, t)).cast("array<string>"))]), F.col("failure_family")), F.array().cast("array<string>"))
    # k rows look for theirs
    met = chunks.select("chunk_id", "topic_tags").join(F.broadcast(looked), "chunk_id", "right")
    return long_form(met.agg(F.count("*").cast("double").alias("n_links_sampled"), _share(F.arrays_overlap("topic_tags", topics)).alias("topic_link_relevance")))


def spans_out_of_window(incidents: DataFrame) -> DataFrame:
    """metric, value: the share of sensor spans (relative to t_event_s) that leave their incident's window."""
    low, high = F.col("window_start_s") - F.col("t_event_s") - 1e-6, F.col("window_end_s") - F.col("t_event_s") + 1e-6
    outside = F.size(F.filter("sensor_relevant_spans", lambda s: (s["start_s"] < low) | (s["end_s"] > high)))
    return long_form(incidents.agg(F.coalesce(F.sum(outside) / F.greatest(F.lit(1), F.sum(F.size("sensor_relevant_spans"))), F.lit(0.0)).alias("pct_span_out_of_window")))


def family_floors(incidents: DataFrame, floor: int = 1, unknown: str = "unknown", families: Sequence[str] = ()) -> DataFrame:
    """failure_family, n, met of each known family there is or that should be: whether it has ``floor`` incidents."""
    counts = incidents.where(F.col("failure_family").isNotNull() & (F.col("failure_family") != unknown)).groupBy("failure_family").agg(F.count("*").alias("n"))
    wanted = incidents.sparkSession.createDataFrame([(f,) for f in families], "failure_family string")
    return counts.join(wanted, "failure_family", "full").select("failure_family", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) >= floor).alias("met"))


def violations(metrics: DataFrame, tier: str = "mvp") -> DataFrame:
    """metric, value, op, target, level of the targets that a tier sets and the measures miss; a target without a
    measure is missed, with a null value. An unknown tier is mvp, and having no incident violates a target too."""
    k = 3 if tier == "extended" else 2
    rows = [(m, "=", 0.0, "FAIL") for m in HARD] + [(t[0], t[1], t[k], t[4]) for t in TARGETS] + [("n_incidents", ">=", 1.0, "FAIL")]
    targets = metrics.sparkSession.createDataFrame(rows, "metric string, op string, target double, level string")
    v, t = F.col("value"), F.col("target")
    missed = F.when(F.col("op") == "=", v != t).when(F.col("op") == ">=", v < t).otherwise(v > t)
    return targets.join(metrics, "metric", "left").where(F.coalesce(missed, F.lit(True))).select("metric", "value", "op", "target", "level")


def grade(metrics: DataFrame, tier: str = "mvp") -> DataFrame:
    """One row: grade, n_failures, n_warnings."""
    found = violations(metrics, tier).agg(F.count_if(F.col("level") == "FAIL").alias("n_failures"), F.count_if(F.col("level") == "WARN").alias("n_warnings"))
    return found.select(F.when(F.col("n_failures") > 0, "FAIL").when(F.col("n_warnings") > 0, "WARN").otherwise("PASS").alias("grade"), "n_failures", "n_warnings")


def malformed_share(rows: DataFrame, column: str) -> DataFrame:
    return rows.agg(_share(is_malformed(F.col(column))).alias("pct_malformed_json"))
