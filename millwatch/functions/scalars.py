"""Scalar functions: identities, enumerations, probe documents, JSON lists, spans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start_s:double,end_s:double>>"

# The labels in use.
REGIMES = ("roughing", "finishing", "plunge", "idle", "drilling", "contouring", "unknown")
CONDITIONS = ("normal", "tool_wear_visible", "heavy_vibration", "coolant_issue", "chatter", "chip_packing", "unknown")
SPLITS = ("train", "val", "test", "human_eval")
TOPICS = {"tool_wear": ["tool_wear", "vibration", "feed_speed"], "chatter": ["vibration", "spindle", "feed_speed"], "clamping_loss": ["clamping", "vibration"], "coolant_fault": ["coolant", "spindle"], "unknown": ["vibration", "tool_wear"]}
TOPIC_KEYWORDS = {"vibration": ["vibration", "chatter", "oscillation", "resonance", "amplitude"], "tool_wear": ["tool wear", "worn", "flank wear", "dull", "edge breakdown"], "clamping": ["clamp", "fixture", "workholding", "vise", "runout"], "coolant": ["coolant", "lubricant", "flood", "mist", "overheating"], "spindle": ["spindle", "bearing", "rpm", "runout"], "feed_speed": ["feed rate", "spindle speed", "depth of cut", "doc"]}
MAINTENANCE_WORDS = ("maintenance", "lubricat", "service", "inspect", "replace", "clean", "grease", "repair", "troubleshoot", "wear", "fault", "alarm")
SOP_WORDS = ("operation", "operating", "procedure", "setup", "set-up", "install", "program", "workpiece", "fixture", "startup", "shutdown", "safety")
# End of fixed values.


def stable_hash(*parts: Column) -> Column:
    """Twelve hex digits that stand for the parts."""
    return F.substring(F.sha1(F.concat_ws("\x1f", *parts)), 1, 12)


def millis(seconds: Column) -> Column:
    """Seconds with three decimals, as text; halves of a millisecond round away from zero."""
    whole = F.round(seconds * 1000).cast("bigint")
    sign = F.when(whole < 0, "-").otherwise("")
    return F.concat(sign, F.floor(F.abs(whole) / 1000).cast("string"), F.lit("."), F.lpad((F.abs(whole) % 1000).cast("string"), 3, "0"))


def incident_id(dataset: Column, run: Column, t_event: Column) -> Column:
    return F.concat(F.lit("inc_"), dataset, F.lit("_"), stable_hash(dataset, run, millis(t_event)))


def video_id(source: Column, path: Column) -> Column:
    return F.concat(F.lit("vid_"), stable_hash(source, path))


def document_id(path: Column) -> Column:
    return F.concat(F.lit("doc_"), stable_hash(path))


def chunk_id(document: Column, ordinal: Column) -> Column:
    return F.format_string("%s__c%04d", document, ordinal)


def one_of(value: Column, allowed: Sequence[str], default: str = "unknown") -> Column:
    """The label without case and outer space if it is allowed, else the default."""
    clean = F.lower(F.trim(value))
    return F.when(clean.isin(*allowed), clean).otherwise(F.lit(default))


def number(value: Column) -> Column:
    """A double; what can't be read, or isn't a number, is null."""
    x = value.try_cast("double")
    return F.when(~F.isnan(x), x)


def severity(amplitude: Column, low: Column, high: Column) -> Column:
    known = amplitude.isNotNull() & low.isNotNull() & high.isNotNull() & ~F.isnan(amplitude) & (F.abs(amplitude) != F.lit(float("inf")))
    return F.when(~F.coalesce(known, F.lit(False)), "unknown").when(amplitude <= low, "low").when(amplitude <= high, "med").otherwise("high")


def json_list(value: Column) -> Column:
    return F.to_json(value)


def list_of_json(value: Column, kind: str = "array<string>") -> Column:
    """The list, empty for null."""
    return F.coalesce(F.from_json(value, kind), F.array().cast(kind))


def is_malformed(value: Column) -> Column:
    return value.isNotNull() & F.try_parse_json(value).isNull()


PROBE = "streams array<struct<codec_type string, codec_name string, avg_frame_rate string, r_frame_rate string, width string, height string, duration string>>, format struct<duration string>"


def probe(document: Column) -> Column:
    """fps, duration_s, codec, width, height of a clip's probe document.

    The first video stream counts, else the first of any kind; the average frame rate, else the nominal one,
    where a rate `0/0` or over zero is none; the stream's duration, else the container's, else 0.
    """
    whole = F.from_json(document, PROBE)
    streams = F.coalesce(whole["streams"], F.array().cast("array<struct<codec_type:string,codec_name:string,avg_frame_rate:string,r_frame_rate:string,width:string,height:string,duration:string>>"))
    stream = F.coalesce(F.get(F.filter(streams, lambda s: s["codec_type"] == "video"), 0), F.get(streams, 0))

    def rate(text: Column) -> Column:
        under = F.when(F.contains(text, F.lit("/")), F.split_part(text, F.lit("/"), F.lit(2)).try_cast("double")).otherwise(F.lit(1.0))
        return F.when((text != "0/0") & (under != 0), F.try_divide(F.split_part(text, F.lit("/"), F.lit(1)).try_cast("double"), under))

    return F.struct(
        F.round(F.coalesce(rate(stream["avg_frame_rate"]), rate(stream["r_frame_rate"]), F.lit(0.0)), 6).alias("fps"),
        F.coalesce(stream["duration"].try_cast("double"), whole["format"]["duration"].try_cast("double"), F.lit(0.0)).alias("duration_s"),
        F.coalesce(stream["codec_name"], F.lit("unknown")).alias("codec"),
        F.coalesce(stream["width"].try_cast("int"), F.lit(0)).alias("width"),
        F.coalesce(stream["height"].try_cast("int"), F.lit(0)).alias("height"),
    )


def is_conformant(clip: Column, height: int = 720, fps: float = 30.0) -> Column:
    """Whether a clip needn't be normalised again."""
    return (clip["height"] == height) & (F.abs(clip["fps"] - fps) < 0.5) & clip["codec"].isin("h264", "libx264")


def bucket_of(seed: int, name: Column, n: Column) -> Column:
    """A number from 0 to n - 1 that seed and name decide."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), name)), 1, 8), 16, 10).cast("bigint") % n


def whole_clip(duration: Column) -> Column:
    """The span of a whole clip; none without a duration."""
    span = F.array(F.struct(F.lit(0.0).alias("start_s"), duration.alias("end_s")))
    return F.when(duration > 0, span).otherwise(F.array().cast(SPAN))
