"""Clips by tags and labels, chunks by topics, and the assembly of incidents."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import CONDITIONS, REGIMES, SPAN, TOPICS, bucket_of, one_of, whole_clip

TAG_KEYS = ("video_id", "video_file", "file", "filename", "clip")
#: Rows of one numbering step that a window orders; positions over all rows are sums over such buckets.
RANK_BUCKETS = 256


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def tags_by_key(tags: DataFrame, order: str) -> DataFrame:
    """key, tag: the last row (by ``order``) that names each key, in full or by its base name."""
    columns = [c for c in TAG_KEYS if c in tags.columns]
    keys = F.array_distinct(F.array_compact(F.flatten(F.array(*[F.array(F.col(c).cast("string"), basename(F.col(c).cast("string"))) for c in columns]))))
    row = F.struct(*[F.col(c) for c in tags.columns])
    return tags.select(F.explode(keys).alias("key"), F.col(order).alias("seq"), row.alias("row")).groupBy("key").agg(F.max_by("row", "seq").alias("tag"))


def tagged(clips: DataFrame, tags: DataFrame, order: str, path: str = "video_file") -> DataFrame:
    """``clips`` with the tag of the first of path, base name and stem that has one; null without."""
    keys = F.array(F.col(path), basename(F.col(path)), stem(F.col(path)))
    looked = clips.select(path, F.posexplode(keys).alias("priority", "key")).join(tags_by_key(tags, order), "key")
    best = looked.groupBy(path).agg(F.min_by("tag", "priority").alias("tag"))
    return clips.join(best, path, "left")


def clip_labels(tagged_clips: DataFrame) -> DataFrame:
    """``tagged`` clips with regime_label and condition_label: what the tag says if it is a known label, else unknown."""
    said = lambda name, known: F.coalesce(one_of(F.col(f"tag.{name}"), known), F.lit("unknown")) if name in tagged_clips.schema["tag"].dataType.names else F.lit("unknown")
    return tagged_clips.withColumn("regime_label", said("regime", REGIMES)).withColumn("condition_label", said("condition", CONDITIONS))


def numbered(df: DataFrame, group: str, order: Sequence[Column], spread: Column, name: str) -> DataFrame:
    """``df`` with its 0-based place in its group, ordered by ``order`` whose first part is ``spread``, a number in
    [0, RANK_BUCKETS): places within a bucket are counted in parallel and the buckets' sizes summed up."""
    rows = df.withColumn("__b", spread)
    sizes = rows.groupBy(group, "__b").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(group, "__b", before.alias("__before"))
    place = F.row_number().over(Window.partitionBy(group, "__b").orderBy(*order)) - 1
    return rows.withColumn("__in", place).join(offsets, [group, "__b"]).withColumn(name, (F.col("__before") + F.col("__in")).cast("bigint")).drop("__b", "__in", "__before")


def by_hash(df: DataFrame, group: str, seed: int, key: str, name: str) -> DataFrame:
    """Places of rows in their group in the order of a seeded hash."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))
    spread = F.conv(F.substring(digest, 1, 2), 16, 10).cast("int")
    return numbered(df, group, [digest, F.col(key)], spread, name)


def matched_clips(incidents: DataFrame, clips: DataFrame, seed: int = 13, pool: str = "regime_label", idle: str | None = "idle") -> DataFrame:
    """``incidents`` with video_file and alignment_method: a seeded uniform pick of the clips of the same pool, each
    usable again; else one of the idle pool; else none."""
    ranked = by_hash(clips, pool, seed, "video_file", "place").select(pool, "place", "video_file")
    sizes = ranked.groupBy(pool).agg(F.count("*").alias("pool_n"))
    name, columns = F.col("incident_id"), [*incidents.columns, "video_file", "alignment_method"]
    asked = incidents.join(sizes, pool, "left")
    own = asked.where("pool_n IS NOT NULL").withColumn("place", bucket_of(seed, name, F.col("pool_n"))).join(ranked, [pool, "place"])
    own = own.withColumn("alignment_method", F.lit("label_match")).select(*columns)
    # only those without a pool of their own look further, so no join meets rows without a key
    rest = asked.where("pool_n IS NULL").drop("pool_n", "place")
    if idle is None:
        return own.unionByName(rest.withColumn("video_file", F.lit(None).cast("string")).withColumn("alignment_method", F.lit("none")).select(*columns))
    spare = ranked.where(F.col(pool) == idle).select("place", "video_file")
    idle_n = sizes.where(F.col(pool) == idle).select("pool_n").scalar()
    rest = rest.withColumn("place", bucket_of(seed, name, idle_n)).join(spare, "place", "left")
    return own.unionByName(rest.withColumn("alignment_method", F.when(F.col("video_file").isNull(), "none").otherwise("idle_fallback")).select(*columns))


def matched_once(incidents: DataFrame, clips: DataFrame, seed: int = 13, pool: str = "regime_label", idle: str = "idle") -> DataFrame:
    """As ``matched_clips``, but each clip serves one incident: the n-th incident of a pool, in the seeded order of
    incidents, gets the n-th clip of the pool's; those left over share the idle pool in the same order."""
    ranked = by_hash(clips, pool, seed, "video_file", "place").select(pool, "place", "video_file")
    own = by_hash(incidents, pool, seed, "incident_id", "place").join(ranked.withColumnRenamed("video_file", "own_clip"), [pool, "place"], "left")
    used = (F.col(pool) == idle) | F.col("own_clip").isNull()
    direct = own.where(~F.coalesce(used, F.lit(True))).withColumn("video_file", F.col("own_clip")).withColumn("alignment_method", F.lit("label_match"))
    rest = own.where(F.coalesce(used, F.lit(True))).drop("place").withColumn("spare_pool", F.lit(idle))
    spare = by_hash(rest, "spare_pool", seed, "incident_id", "place").join(ranked.where(F.col(pool) == idle).select("place", "video_file"), "place", "left")
    method = F.when(F.col("video_file").isNull(), "none").when(F.col(pool) == idle, "label_match").otherwise("idle_fallback")
    columns = [*incidents.columns, "video_file", "alignment_method"]
    return direct.select(*columns).unionByName(spare.withColumn("alignment_method", method).select(*columns))


def retrieved(families: DataFrame, chunks: DataFrame, family_topics: Mapping[str, Sequence[str]] = TOPICS, k: int = 3, others: Sequence[str] = ()) -> DataFrame:
    """failure_family, doc_type, chunk_ids: the k best chunks of each type for each family, by shared topics, then
    length, then chunk_id. Families are a closed list, those of ``family_topics`` and ``others`` without topics; each
    chunk is ranked once for each family that ``families`` has."""
    asked = {**{f: [] for f in others}, **family_topics}
    row = lambda f, t: F.struct(F.lit(f).alias("failure_family"), F.array(*map(F.lit, t)).cast("array<string>").alias("topics"))
    every = F.explode(F.array(*[row(f, t) for f, t in asked.items()])).alias("f")
    pairs = chunks.select("chunk_id", "doc_type", "n_tokens", "topic_tags", every).select("chunk_id", "doc_type", "n_tokens", "f.failure_family", F.size(F.array_intersect("topic_tags", "f.topics")).alias("shared"))
    pairs = pairs.join(families.select("failure_family").distinct(), "failure_family", "left_semi")
    order = Window.partitionBy("failure_family", "doc_type").orderBy(F.desc("shared"), F.desc("n_tokens"), "chunk_id")
    best = pairs.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("nth", "chunk_id"))), lambda x: x["chunk_id"])
    return best.groupBy("failure_family", "doc_type").agg(ids.alias("chunk_ids"))


def assembled(index: DataFrame, labels: DataFrame, clips: DataFrame, best_chunks: DataFrame, splits: DataFrame) -> DataFrame:
    """Incidents: the window index with labels, clip, chunk ids of both types and split, each joined to its left.

    ``labels``: incident_id, severity_label; ``clips``: incident_id, video_file, video_fps, duration_s,
    alignment_method; ``best_chunks``: as ``retrieved`` gives it; ``splits``: source_dataset, split.
    """
    of = lambda kind, name: best_chunks.where(F.col("doc_type") == kind).select("failure_family", F.col("chunk_ids").alias(name))
    out = index.join(labels, "incident_id", "left").join(clips, "incident_id", "left").join(of("sop", "sop_chunk_ids"), "failure_family", "left").join(of("maintenance", "maintenance_chunk_ids"), "failure_family", "left").join(splits, "source_dataset", "left")
    none = F.array().cast("array<string>")
    out = out.withColumn("sop_chunk_ids", F.coalesce("sop_chunk_ids", none)).withColumn("maintenance_chunk_ids", F.coalesce("maintenance_chunk_ids", none))
    out = out.withColumn("alignment_method", F.coalesce("alignment_method", F.lit("none"))).withColumn("split", F.coalesce("split", F.lit("train")))
    for name in ("phase_label", "root_cause_label", "severity_label", "regime_label"):
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit("unknown")) if name in out.columns else F.lit("unknown"))
    return out.withColumn("video_relevant_spans", F.coalesce(whole_clip(F.col("duration_s")), F.array().cast(SPAN)))


def dangling(incidents: DataFrame, chunks: DataFrame) -> DataFrame:
    """incident_id, chunk_id of references to chunks that aren't there."""
    named = incidents.select("incident_id", F.explode(F.concat("sop_chunk_ids", "maintenance_chunk_ids")).alias("chunk_id"))
    return named.join(chunks.select("chunk_id"), "chunk_id", "left_anti")


def missing(referenced: DataFrame, present: DataFrame, path: str = "path") -> DataFrame:
    """Referenced paths that aren't present."""
    return referenced.where(F.col(path).isNotNull()).join(present.select(path), path, "left_anti")


def assembly_notes(incidents: DataFrame, least: int = 1) -> DataFrame:
    """One row: incidents without a clip, with fewer than ``least`` chunks of a kind, and groups that splits keep whole."""
    short = (F.size("sop_chunk_ids") < least) | (F.size("maintenance_chunk_ids") < least)
    return incidents.agg(F.count("*").alias("written"), F.count_if(F.col("video_file").isNull()).alias("no_video"), F.count_if(short).alias("short_text"), F.count_distinct("source_dataset").alias("split_groups"))
