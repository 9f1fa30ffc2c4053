"""Queries that link clips, chunks and splits to incidents, and grade the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import contracts, matching, quality, retrieval, splits, vectors
from ..operators import timeseries as ts
from ..sources import readers, sinks
from ..sources.shared import new_path, saved
from . import detection, texts
from .detection import rounded

SEED = 13
POOLS = {0: "STANDARD", 1: "ECONOMY", 2: "PROMO", 3: "LARGE", 4: "SMALL", 5: "MEDIUM", 6: "MISSING"}
FAMILY_TOPICS = {"click": ["legal", "token"], "error": ["german"], "purchase": ["legal"], "signup": ["spanish", "token"], "view": []}
REFERRED = ("orders", "customer", "clips", "part", "chunks", "nation", "windows")
STATUS, PRIORITY = ("O", "F"), ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir).select("o_orderkey", F.array_join("violations", ",").alias("violations"))


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"status": F.col("o_orderstatus").isin(*STATUS), "price": F.col("o_totalprice") >= 1000, "priority": F.col("o_orderpriority").isin(*PRIORITY)}
    return contracts.with_violations(_read(spark, sf_dir, "orders"), rules)


def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _checked(spark, sf_dir)
    good, bad = contracts.kept(rows).groupBy("o_orderstatus").agg(F.count("*").alias("n")), contracts.quarantined(rows).groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    return good.withColumn("side", F.lit("kept")).unionByName(bad.withColumn("side", F.lit("quarantined")))


def stage_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.counters(_checked(spark, sf_dir), urgent=F.col("o_orderpriority") == "1-URGENT", no_clerk=F.col("o_orderkey").isNull())


def stage_counters_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``stage_counters``, counted by the stage's own write."""
    rows, seen = contracts.observed(_checked(spark, sf_dir), urgent=F.col("o_orderpriority") == "1-URGENT", no_clerk=F.col("o_orderkey").isNull())
    contracts.kept(rows).write.parquet(new_path(spark, "orders-kept"))
    return contracts.counts_of(rows, seen)


def label_normalization(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations")
    label = sc.one_of(F.concat(F.lit("  "), F.upper("role"), F.lit(" ")), ("user", "assistant"))
    return rows.select("conv_id", "turn", label.alias("label"))


def _probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    video = F.struct(
        F.lit("video").alias("codec_type"), F.when(size % 3 == 0, "h264").otherwise("vp9").alias("codec_name"), F.when(size % 4 == 0, "0/0").when(size % 4 == 1, "30/0").otherwise("30000/1001").alias("avg_frame_rate"),
        F.lit("30/1").alias("r_frame_rate"), F.lit(1280).alias("width"), F.when(size % 2 == 0, 720).otherwise(1080).alias("height"), F.when(size % 5 != 0, size.cast("string")).alias("duration"),
    )
    audio = F.struct(F.lit("audio").alias("codec_type"), F.lit("aac").alias("codec_name"), F.lit("0/0").alias("avg_frame_rate"), F.lit("0/0").alias("r_frame_rate"), F.lit(0).alias("width"), F.lit(0).alias("height"), F.lit("1").alias("duration"))
    streams = F.when(size % 11 == 0, F.array(audio)).otherwise(F.array(audio, video))
    document = F.to_json(F.struct(streams.alias("streams"), F.struct((size / 2).cast("string").alias("duration")).alias("format")))
    return _read(spark, sf_dir, "part").select("p_partkey", "p_type", F.concat(F.lit("clips/"), "p_brand", F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".mp4")).alias("video_file"), document.alias("document"))


def clip_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _probes(spark, sf_dir).withColumn("clip", sc.probe(F.col("document")))
    flagged = ~F.col("clip.duration_s").between(5.0, 30.0)
    return rounded(rows.select("p_partkey", sc.video_id(F.lit("part"), F.col("video_file")).alias("video_id"), "clip.fps", "clip.duration_s", "clip.codec", "clip.width", "clip.height", sc.is_conformant(F.col("clip")).alias("conformant"), flagged.alias("duration_flagged")))


def tag_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips = _probes(spark, sf_dir).select("video_file")
    nations = _read(spark, sf_dir, "nation").select(F.concat(F.col("n_nationkey").cast("string"), F.lit(".mp4")).alias("video_file"), F.lit(None).cast("string").alias("clip"), F.col("n_name").alias("regime"), F.col("n_nationkey").cast("long").alias("seq"))
    parts = _read(spark, sf_dir, "part").select(F.concat(F.lit("elsewhere/"), F.when(F.col("p_partkey") % 3 != 0, "none/x").otherwise(""), F.col("p_partkey").cast("string"), F.lit(".mp4")).alias("video_file"), F.when(F.col("p_partkey") % 6 == 0, F.col("p_partkey").cast("string")).alias("clip"), F.col("p_type").alias("regime"), (F.col("p_partkey") + 1000).cast("long").alias("seq"))
    found = matching.tagged(clips, nations.unionByName(parts), "seq")
    return found.select("video_file", F.coalesce("tag.regime", F.lit("unknown")).alias("regime"), F.col("tag.seq").alias("seq"))


def _clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("video_file"), F.col("p_type").alias("regime_label"), F.col("p_size").cast("double").alias("duration_s"), F.lit(30.0).alias("video_fps"))


def _asking(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = F.element_at(F.create_map(*[F.lit(x) for kv in POOLS.items() for x in kv]), (F.col("c_nationkey") % 7).cast("int"))
    return _read(spark, sf_dir, "customer").select(F.concat(F.lit("inc_"), F.col("c_custkey").cast("string")).alias("incident_id"), pool.alias("regime_label"))


def video_match_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.matched_clips(_asking(spark, sf_dir), _clips(spark, sf_dir), SEED, idle="SMALL").select("incident_id", "video_file", "alignment_method")


def video_match_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.matched_clips(_asking(spark, sf_dir), _clips(spark, sf_dir), SEED, idle=None).select("incident_id", "video_file", "alignment_method")


def video_match_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.matched_once(_asking(spark, sf_dir), _clips(spark, sf_dir), SEED, idle="SMALL").select("incident_id", "video_file", "alignment_method")


def _best(spark: SparkSession, sf_dir: str, chunks: DataFrame) -> DataFrame:
    families = _read(spark, sf_dir, "events").select(F.col("event_type").alias("failure_family"))
    return matching.retrieved(families, chunks, FAMILY_TOPICS, 3)


def topic_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best(spark, sf_dir, texts.chunks(spark, sf_dir)).select("failure_family", "doc_type", F.array_join("chunk_ids", ",").alias("chunk_ids"))


def topic_retrieval_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``topic_retrieval``, by the words of a family's topics."""
    families = _read(spark, sf_dir, "events").select(F.col("event_type").alias("failure_family"))
    best = retrieval.retrieved_by_words(families, texts.chunks(spark, sf_dir), FAMILY_TOPICS, texts.KEYWORDS, 3)
    return best.select("failure_family", "doc_type", F.array_join("chunk_ids", ",").alias("chunk_ids"))


def _vector_search(spark: SparkSession, sf_dir: str, exact: bool) -> DataFrame:
    rows = _read(spark, sf_dir, "embeddings")
    index = vectors.indexed(rows, "vec_id", "embedding", dims=64, k=10)
    return vectors.nearest(index, rows.where("vec_id % 100 = 0"), "vec_id", "embedding", 10, exact).withColumnRenamed("id", "vec_id")


def embedding_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every hundredth vector, by the lists nearest to it."""
    return _vector_search(spark, sf_dir, exact=False)


def embedding_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``embedding_retrieval``, going on until no list can hold a nearer one."""
    return _vector_search(spark, sf_dir, exact=True)


def split_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.greedy(_read(spark, sf_dir, "customer"), "c_nationkey")


def split_greedy_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.greedy(_read(spark, sf_dir, "documents"), "source")


def split_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.prefix(_read(spark, sf_dir, "orders"), "o_custkey")


def split_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups in several splits: of a split by groups, and of one by rows."""
    orders = _read(spark, sf_dir, "orders")
    sides = {"by_group": orders.join(splits.prefix(orders, "o_custkey"), "o_custkey"), "by_row": orders.withColumn("split", F.col("o_orderpriority"))}
    parts = [splits.leaks(rows, "o_custkey").agg(F.count("*").alias("n_leaking_groups")).withColumn("side", F.lit(side)) for side, rows in sides.items()]
    return parts[0].unionByName(parts[1])


def split_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of each split for fractions other than the usual."""
    return splits.prefix(_read(spark, sf_dir, "orders"), "o_custkey", {"train": 0.5, "val": 0.3, "test": 0.2}).groupBy("split").agg(F.count("*").alias("n_groups"))


def _waveforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples of all windows, carved once."""
    return saved(detection.carved(spark, sf_dir), "waveforms")


def _index(waveforms: DataFrame) -> DataFrame:
    """The window index with amplitudes; a run is a dataset and a failure family here."""
    index = ts.with_spans(ts.window_index(waveforms, detection.FS, with_amplitude=True))
    index = index.withColumn("source_dataset", F.col("run_id")).withColumn("failure_family", F.col("run_id"))
    return index.withColumn("regime_label", F.element_at(F.create_map(F.lit("click"), F.lit("LARGE"), F.lit("view"), F.lit("MISSING")), F.col("run_id")))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks without their texts, cut once."""
    return saved(texts.chunks(spark, sf_dir).drop("text"), "chunks")


def incidents(spark: SparkSession, sf_dir: str, chunks: DataFrame | None = None, waveforms: DataFrame | None = None) -> DataFrame:
    """Incidents of the recordings, written once."""
    index = saved(_index(_waveforms(spark, sf_dir) if waveforms is None else waveforms), "window-index")
    labels = detection.with_severity(index.select("incident_id", "amplitude")).select("incident_id", "severity_label")
    clips = _clips(spark, sf_dir)
    matched = matching.matched_clips(index.select("incident_id", "regime_label"), clips, SEED, idle="SMALL").select("incident_id", "video_file", "alignment_method")
    matched = matched.join(clips.select("video_file", "video_fps", "duration_s"), "video_file", "left")
    best = saved(_best(spark, sf_dir, _chunks(spark, sf_dir) if chunks is None else chunks), "best-chunks")
    return saved(matching.assembled(index.drop("amplitude"), labels, matched, best, splits.greedy(index, "source_dataset")), "incidents")


def incident_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the incidents break of their contract: the regimes of these tables aren't those in use."""
    told = contracts.with_violations(incidents(spark, sf_dir), contracts.incident_rules())
    return told.select("incident_id", F.array_join("violations", ",").alias("violations"))


def assembly_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.assembly_notes(incidents(spark, sf_dir), least=2)


def clip_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips seen, written and left out for having no duration, and how many have one out of bounds."""
    rows = _probes(spark, sf_dir).withColumn("clip", sc.probe(F.col("document")))
    told = contracts.with_violations(rows, {"duration": F.col("clip.duration_s") > 1.5})
    return contracts.counters(told, duration_flagged=~F.col("clip.duration_s").between(5.0, 30.0))


def assemble_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = F.get("video_relevant_spans", 0)
    return rounded(incidents(spark, sf_dir).select("incident_id", "source_dataset", "failure_family", "window_start_s", "window_end_s", "n_samples", "video_file", span["end_s"].alias("clip_end_s"), "alignment_method", "severity_label", "regime_label", "phase_label", F.array_join("sop_chunk_ids", ",").alias("sop_chunk_ids"), F.array_join("maintenance_chunk_ids", ",").alias("maintenance_chunk_ids"), "split"))


def grounding_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of how incidents are grounded: links whose chunk has the family's topic, and spans within windows."""
    chunks = _chunks(spark, sf_dir)
    built = incidents(spark, sf_dir, chunks)
    return rounded(quality.topic_link_relevance(built, chunks, FAMILY_TOPICS, 30, SEED).unionByName(quality.spans_out_of_window(built)))


def family_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("failure_family"))
    return quality.family_floors(rows.where("failure_family <> '2-HIGH'"), 3000, "4-NOT SPECIFIED", ("1-URGENT", "2-HIGH"))


def quality_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.distribution(incidents(spark, sf_dir), "failure_family", "regime_label", "severity_label", "split")


def quality_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.balance(_read(spark, sf_dir, "orders"), "o_orderpriority", "4-NOT SPECIFIED"))


def _measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, waveforms = _chunks(spark, sf_dir), _waveforms(spark, sf_dir)
    built = incidents(spark, sf_dir, chunks, waveforms)
    waveforms = waveforms.select(F.col("run_id").alias("source_dataset"), "incident_id")
    return saved(quality.measures(built, _clips(spark, sf_dir), chunks.select("chunk_id", "n_tokens"), detection.PRE, detection.POST, waveforms), "measures")


def quality_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_measures(spark, sf_dir))


def hard_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All seven gates over incidents with lost files, broken lists, spans out of order, repeated ids and odd rates."""
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    rows = _read(spark, sf_dir, "orders").select(
        F.concat(F.lit("inc_"), (k - k % 2).cast("string")).alias("incident_id"), F.col("o_orderstatus").alias("source_dataset"), F.lit("unknown").alias("failure_family"), F.lit(0.0).alias("window_start_s"), F.lit(5.0).alias("window_end_s"),
        F.when(k % 50 == 0, 5.0).otherwise(100.0).alias("fs_hz"), F.concat(F.lit("w/"), c).alias("sensor_file"), F.when(k % 3 == 0, F.concat(F.lit("v/"), c)).alias("video_file"), F.lit("none").alias("alignment_method"),
        F.when(k % 10 == 0, '["k1').when(k % 10 != 1, '["k1","k2"]').alias("sop_chunk_ids"), F.lit("[]").alias("maintenance_chunk_ids"), F.when(k % 8 == 0, '[{"start_s":2.0,"end_s":1.0}]').otherwise('[{"start_s":-1.0,"end_s":1.0}]').alias("sensor_relevant_spans"),
    )
    customers = _read(spark, sf_dir, "customer")
    there = lambda kind, n: customers.where(F.col("c_custkey") % n != 0).select(F.concat(F.lit(kind), F.col("c_custkey").cast("string")).alias("path"))
    chunks = customers.select(F.when(F.col("c_custkey") % 2 == 1, "k1").otherwise("other").alias("chunk_id"), F.lit(1).cast("long").alias("n_tokens")).distinct()
    metrics = quality.measures(saved(rows, "gated"), _clips(spark, sf_dir), chunks, detection.PRE, detection.POST, files=there("w/", 5).unionByName(there("v/", 7)))
    return rounded(quality.violations(metrics).where(F.col("metric").isin(*quality.HARD)).select("metric", "value", "level"))


def quality_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.violations(_measures(spark, sf_dir), "extended"))


def quality_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.grade(_measures(spark, sf_dir), "mvp")


def span_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.array(F.struct(F.when(F.col("o_orderkey") % 5 != 0, -1.0).alias("start_s"), (F.col("o_orderkey") % 4 - 2).cast("double").alias("end_s")))
    rows = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("incident_id"), F.lit("a").alias("source_dataset"), F.lit(0.0).alias("window_start_s"), F.lit(5.0).alias("window_end_s"), F.lit(5.0).alias("fs_hz"), F.lit(None).cast("string").alias("video_file"), F.lit("none").alias("alignment_method"), F.array().cast("array<string>").alias("sop_chunk_ids"), F.array().cast("array<string>").alias("maintenance_chunk_ids"), spans.alias("sensor_relevant_spans"))
    return rounded(quality.incident_measures(rows, 3.0, 2.0).select("pct_bad_span", "mean_sensor_span_frac", "pct_event_near_zero", "fs_hz_plausible_violations", "pct_window_len_mismatch"))


def dangling_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir)
    found = matching.dangling(incidents(spark, sf_dir, chunks), chunks.where("n_tokens < 175"))
    return found.groupBy("chunk_id").agg(F.count("*").alias("n"))


def malformed_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = F.when(F.col("event_id") % 4 == 0, F.substring("props", 1, 3)).otherwise(F.col("props"))
    return rounded(quality.malformed_share(_read(spark, sf_dir, "events").select(cut.alias("j")), "j"))


def json_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 7 != 0, sc.json_list(F.array("p_brand", "p_type"))).alias("j"))
    back = sc.list_of_json(F.col("j"))
    return rows.select("p_partkey", "j", F.size(back).alias("n"), F.array_join(back, "/").alias("items"))


def missing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What orders refer to and isn't among the files, and how often."""
    name = F.element_at(F.array(*map(F.lit, REFERRED)), (F.col("o_orderkey") % len(REFERRED) + 1).cast("int"))
    asked = _read(spark, sf_dir, "orders").select(F.concat(name, F.lit(".parquet")).alias("path"))
    there = readers.files_below(spark, sf_dir, "*.parquet").select(F.substring_index("path", "/", 1).alias("path")).distinct()
    return matching.missing(asked, there).groupBy("path").agg(F.count("*").alias("n"))


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts written as a file for each source and read again as documents."""
    path = new_path(spark, "document-files")
    rows = _read(spark, sf_dir, "documents").select("doc_id", "source", F.concat(F.col("doc_id").cast("string"), F.lit(": "), F.length("text").cast("string")).alias("line"))
    rows.repartition("source").sortWithinPartitions("source", "doc_id").select("line", "source").write.partitionBy("source").text(path)
    back = readers.read_documents(spark, path)
    sound = F.col("doc_id") == sc.document_id(F.col("path"))
    return back.select(F.regexp_extract("path", "source=([^/]+)/", 1).alias("source"), F.md5(F.regexp_replace("text", "\n$", "")).alias("text_md5"), sound.alias("sound_id"))


def tag_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags written as CSV, read again and counted, beside the empty table that stands for no tags."""
    path = new_path(spark, "tags")
    _read(spark, sf_dir, "part").select(F.col("p_name").alias("video_file"), F.col("p_type").alias("regime"), F.lit("normal").alias("condition"), F.col("p_brand").alias("source")).write.option("header", True).csv(path)
    told = readers.read_tags(spark, path).unionByName(readers.read_tags(spark, None))
    return told.groupBy("regime", "condition").agg(F.count("*").alias("n"), F.count_distinct("video_file").alias("n_files"))


def index_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index written, read again with its lists as JSON text, one only rehearsed, and one that isn't there."""
    rows = _read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("incident_id"), F.array("p_brand", "p_type").alias("sop_chunk_ids"))
    path, dry = new_path(spark, "index"), new_path(spark, "index")
    sinks.write_index(rows, path)
    sinks.write_index(rows, dry, dry_run=True)
    schema = "incident_id string, sop_chunk_ids string"
    parts = [readers.read_index(spark, p, schema).withColumn("side", F.lit(side)) for side, p in (("written", path), ("dry", dry))]
    return parts[0].unionByName(parts[1])


def report_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures written as a report and read again."""
    path = new_path(spark, "report")
    row = quality.balance(_read(spark, sf_dir, "orders"), "o_orderpriority", "4-NOT SPECIFIED")
    sinks.write_report(quality.long_form(row), path)
    return rounded(spark.read.schema("metric string, value double").json(path))


def _bucket(name: str, n: str) -> str:
    return f"(('0x' || substr(md5('{SEED}|' || {name}), 1, 8))::BIGINT % {n})"


_CLIPS = "clips AS (SELECT p_partkey::VARCHAR AS video_file, p_type AS regime_label, p_size::DOUBLE AS duration_s FROM part)"
_RANKED = f"ranked AS (SELECT *, row_number() OVER (PARTITION BY regime_label ORDER BY md5('{SEED}|' || video_file), video_file) - 1 AS place FROM clips), sizes AS (SELECT regime_label, count(*) AS n FROM clips GROUP BY 1)"
_ASKING = f"asking AS (SELECT 'inc_' || c_custkey AS incident_id, [{', '.join(repr(x) for x in POOLS.values())}][c_nationkey % 7 + 1] AS regime_label FROM customer)"
_OWN = f"own AS (SELECT a.incident_id, a.regime_label, r.video_file FROM asking a LEFT JOIN sizes s USING (regime_label) LEFT JOIN ranked r ON r.regime_label = a.regime_label AND r.place = {_bucket('a.incident_id', 's.n')})"
_MATCHED = f"matched AS (SELECT o.incident_id, coalesce(o.video_file, i.video_file) AS video_file, CASE WHEN o.video_file IS NOT NULL THEN 'label_match' WHEN i.video_file IS NOT NULL THEN 'idle_fallback' ELSE 'none' END AS alignment_method FROM own o LEFT JOIN ranked i ON o.video_file IS NULL AND i.regime_label = 'SMALL' AND i.place = {_bucket('o.incident_id', '(SELECT n FROM sizes WHERE regime_label = ' + chr(39) + 'SMALL' + chr(39) + ')')})"
_FAMILIES = "families AS (SELECT * FROM (VALUES " + ", ".join(f"('{f}', [{', '.join(repr(t) for t in ts_)}]::VARCHAR[])" for f, ts_ in FAMILY_TOPICS.items()) + ") v(failure_family, topics) WHERE failure_family IN (SELECT event_type FROM events))"
_RETRIEVED = f"{texts.DOC_CHUNKS}, {_FAMILIES}, scored AS (SELECT failure_family, doc_type, chunk_id, row_number() OVER (PARTITION BY failure_family, doc_type ORDER BY len(list_intersect(topic_tags, topics)) DESC, n_tokens DESC, chunk_id) AS nth FROM typed, families), best AS (SELECT failure_family, doc_type, string_agg(chunk_id, ',' ORDER BY nth) AS chunk_ids FROM scored WHERE nth <= 3 GROUP BY 1, 2)"


_WORDS = ", ".join(f"('{f}', '{w}')" for f, topics in FAMILY_TOPICS.items() for w in sorted({w for t in topics for k in texts.KEYWORDS[t] for w in k.lower().split()}))
_BM25 = f"""{texts.DOC_CHUNKS}, asked AS (SELECT * FROM (VALUES {_WORDS}) AS v(failure_family, term)), fams AS (SELECT DISTINCT event_type AS failure_family FROM events),
terms AS (SELECT chunk_id, doc_type, n_tokens, regexp_extract_all(lower(text), '[\\pL\\pN]+') AS ws FROM typed JOIN chunks USING (chunk_id, n_tokens)),
stats AS (SELECT doc_type, count(*) AS n, avg(len(ws)) AS mean FROM terms GROUP BY 1),
tfs AS (SELECT doc_type, chunk_id, term, count(*) AS tf, any_value(size) AS size FROM (SELECT doc_type, chunk_id, len(ws) AS size, unnest(ws) AS term FROM terms) GROUP BY 1, 2, 3),
dfs AS (SELECT doc_type, term, count(*) AS df FROM tfs GROUP BY 1, 2),
scored AS (SELECT failure_family, doc_type, chunk_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * size / mean))), 9) AS score FROM tfs JOIN asked USING (term) JOIN fams USING (failure_family) JOIN dfs USING (doc_type, term) JOIN stats USING (doc_type) GROUP BY 1, 2, 3),
hit AS (SELECT failure_family, doc_type, chunk_id, row_number() OVER (PARTITION BY failure_family, doc_type ORDER BY score DESC, chunk_id) AS nth FROM scored),
usual AS (SELECT doc_type, first(chunk_id ORDER BY n_tokens DESC, chunk_id) AS chunk_id FROM typed GROUP BY 1),
filled AS (SELECT * FROM hit WHERE nth <= 3 UNION ALL SELECT failure_family, doc_type, chunk_id, 1 FROM fams, usual WHERE (failure_family, doc_type) NOT IN (SELECT (failure_family, doc_type) FROM hit))"""


def _greedy(table: str, key: str) -> str:
    """Recursive part: the groups of ``table`` in order, each to the split that lacks most."""
    lack = "[0.7::DOUBLE * total - taken[1], 0.15::DOUBLE * total - taken[2], 0.1::DOUBLE * total - taken[3], 0.05::DOUBLE * total - taken[4]]"
    return f"""groups AS (SELECT {key} AS g, count(*) AS n, row_number() OVER (ORDER BY md5('42|' || coalesce({key}::VARCHAR, ''))) AS r, sum(count(*)) OVER () AS total FROM {table} GROUP BY {key}),
walk AS (SELECT 0::BIGINT AS r, [0, 0, 0, 0]::BIGINT[] AS taken, 0::BIGINT AS pick UNION ALL
SELECT q.r, list_transform(q.taken, lambda x, i: CASE WHEN i = q.pick THEN x + q.n ELSE x END), q.pick FROM (SELECT g.r, g.n, w.taken, list_position({lack}, list_max({lack}))::BIGINT AS pick FROM walk w JOIN groups g ON g.r = w.r + 1) q),
split_of AS (SELECT g.g, ['train', 'val', 'test', 'human_eval'][w.pick] AS split FROM groups g JOIN walk w USING (r))"""


_INCIDENTS = f"""{detection.CARVED}, {_RETRIEVED}, {_CLIPS}, {_RANKED},
asking AS (SELECT incident_id, CASE run_id WHEN 'click' THEN 'LARGE' WHEN 'view' THEN 'MISSING' END AS regime_label FROM idx), {_OWN}, {_MATCHED}, {_greedy('idx', 'run_id')},
inc AS (SELECT x.incident_id, x.run_id AS source_dataset, x.run_id AS failure_family, window_start_s, window_end_s, n_samples, m.video_file, CASE WHEN c.duration_s > 0 THEN c.duration_s END AS clip_end_s, m.alignment_method, v.severity_label, coalesce(a.regime_label, 'unknown') AS regime_label, 'unknown' AS phase_label, coalesce(s.chunk_ids, '') AS sop_chunk_ids, coalesce(t.chunk_ids, '') AS maintenance_chunk_ids, p.split, sp.start_s, sp.end_s
FROM idx x JOIN asking a USING (incident_id) JOIN matched m USING (incident_id) LEFT JOIN clips c ON c.video_file = m.video_file JOIN sev v USING (incident_id) JOIN spans sp USING (incident_id) LEFT JOIN best s ON s.failure_family = x.run_id AND s.doc_type = 'sop' LEFT JOIN best t ON t.failure_family = x.run_id AND t.doc_type = 'maintenance' JOIN split_of p ON p.g = x.run_id)"""

_NAMED = "named AS (SELECT unnest(list_filter(string_split(sop_chunk_ids || ',' || maintenance_chunk_ids, ','), lambda x: x <> '')) AS chunk_id FROM inc)"
_FAMILY_COUNTS = "fam AS (SELECT failure_family, count(*) AS n, sum(count(*)) OVER () AS total, count(*) OVER () AS classes FROM inc GROUP BY 1)"
_METRICS = f"""{_INCIDENTS}, {_NAMED}, {_FAMILY_COUNTS},
one AS (SELECT count(*)::DOUBLE AS n_incidents, sum(window_end_s - window_start_s) / 3600 AS total_incident_hours, count(DISTINCT source_dataset)::DOUBLE AS n_sensor_datasets_used, avg((video_file IS NOT NULL)::INT) AS pct_with_video, avg((sop_chunk_ids <> '')::INT) AS pct_with_sop, avg((maintenance_chunk_ids <> '')::INT) AS pct_with_maint,
avg((sop_chunk_ids <> '' AND maintenance_chunk_ids <> '')::INT) AS pct_with_sop_and_maint, avg((sop_chunk_ids <> '' AND maintenance_chunk_ids <> '' AND video_file IS NOT NULL)::INT) AS pct_fully_multimodal, avg(len(list_filter(string_split(sop_chunk_ids, ','), lambda x: x <> ''))) AS mean_sop_chunks, avg(len(list_filter(string_split(maintenance_chunk_ids, ','), lambda x: x <> ''))) AS mean_maint_chunks,
(count(*) - count(DISTINCT incident_id)) / count(*)::DOUBLE AS pct_duplicate_incident_id, avg((end_s < start_s)::INT) AS pct_bad_span, avg(least((end_s - start_s) / (window_end_s - window_start_s), 1)) AS mean_sensor_span_frac, 1.0::DOUBLE AS mean_sensor_span_count, 1.0::DOUBLE AS pct_with_sensor_span, avg((start_s <= 0 AND end_s >= 0)::INT) AS pct_event_near_zero, avg((abs(window_end_s - window_start_s - 5) > 1)::INT) AS pct_window_len_mismatch, 0.0::DOUBLE AS fs_hz_plausible_violations, avg((alignment_method = 'label_match')::INT) AS pct_label_match_alignment FROM inc),
two AS (SELECT max(n / total::DOUBLE) AS dominant_class_share, 0.0::DOUBLE AS pct_unknown_failure, CASE WHEN max(classes) > 1 THEN -sum(n / total::DOUBLE * ln(n / total::DOUBLE)) / ln(max(classes)) ELSE 0 END AS entropy_failure FROM fam),
three AS (SELECT coalesce(avg((c.chunk_id IS NULL)::INT), 0) AS pct_dangling_chunk_id FROM named LEFT JOIN chunks c USING (chunk_id)),
gates AS (SELECT avg((incident_id NOT IN (SELECT incident_id FROM wave))::INT) AS pct_missing_sensor_file, coalesce(avg((video_file NOT IN (SELECT video_file FROM clips))::INT), 0) AS pct_missing_video_file, 0.0::DOUBLE AS pct_malformed_json FROM inc),
four AS (SELECT count(*)::DOUBLE AS n_video_clips FROM clips), five AS (SELECT sum(n_tokens) / 500::DOUBLE AS text_pages_equiv FROM chunks),
metrics AS (UNPIVOT (SELECT one.*, two.*, three.*, gates.*, four.*, five.* FROM one, two, three, gates, four, five) ON COLUMNS(*) INTO NAME metric VALUE value)"""


def _missed(k: int) -> str:
    rows = [(m, "=", 0.0, "FAIL") for m in quality.HARD] + [(t[0], t[1], t[k], t[4]) for t in quality.TARGETS] + [("n_incidents", ">=", 1.0, "FAIL")]
    return f"{_METRICS}, targets AS (SELECT * FROM (VALUES {', '.join(f'({m!r}, {o!r}, {t}::DOUBLE, {lv!r})' for m, o, t, lv in rows)}) v(metric, op, target, level)), missed AS (SELECT metric, value, op, target, level FROM targets LEFT JOIN metrics USING (metric) WHERE value IS NULL OR CASE op WHEN '=' THEN value <> target WHEN '>=' THEN value < target ELSE value > target END)"


_EDGES = [sum(list(splits.FRACTIONS.values())[: i + 1]) for i in range(3)]
_RULES = f"list_filter([CASE WHEN NOT o_orderstatus IN {STATUS!r} THEN 'status' END, CASE WHEN o_totalprice < 1000 THEN 'price' END, CASE WHEN NOT o_orderpriority IN {PRIORITY!r} THEN 'priority' END], lambda x: x IS NOT NULL)"
_TAG_KEYS = "tags AS (SELECT n_nationkey || '.mp4' AS video_file, NULL::VARCHAR AS clip, n_name AS regime, n_nationkey::BIGINT AS seq FROM nation UNION ALL SELECT 'elsewhere/' || CASE WHEN p_partkey % 3 <> 0 THEN 'none/x' ELSE '' END || p_partkey || '.mp4', CASE WHEN p_partkey % 6 = 0 THEN p_partkey::VARCHAR END, p_type, p_partkey + 1000 FROM part), keys AS (SELECT key, arg_max(regime, seq) AS regime, max(seq) AS seq FROM (SELECT unnest([video_file, regexp_extract(video_file, '[^/]*$'), clip]) AS key, regime, seq FROM tags) WHERE key IS NOT NULL GROUP BY key)"

SQL = {
    "row_contract": f"SELECT o_orderkey, array_to_string({_RULES}, ',') AS violations FROM orders",
    "quarantine": f"SELECT o_orderstatus, count(*) AS n, CASE WHEN len(v) = 0 THEN 'kept' ELSE 'quarantined' END AS side FROM (SELECT o_orderstatus, {_RULES} AS v FROM orders) GROUP BY 1, 3",
    "stage_counters": f"SELECT count(*) AS discovered, count(*) FILTER (len(v) = 0) AS written, count(*) FILTER (len(v) > 0) AS errors, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (o_orderkey IS NULL) AS no_clerk FROM (SELECT *, {_RULES} AS v FROM orders)",
    "stage_counters_written": f"SELECT count(*) AS discovered, count(*) FILTER (len(v) = 0) AS written, count(*) FILTER (len(v) > 0) AS errors, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (o_orderkey IS NULL) AS no_clerk FROM (SELECT *, {_RULES} AS v FROM orders)",
    "label_normalization": "SELECT conv_id, turn, CASE WHEN role IN ('user', 'assistant') THEN role ELSE 'unknown' END AS label FROM conversations",
    "clip_index": """WITH p AS (SELECT p_partkey, 'clips/' || p_brand || '/' || p_partkey || '.mp4' AS f, p_size AS s, p_size % 11 = 0 AS lone FROM part), q AS (SELECT *, CASE WHEN lone THEN 0 WHEN s % 4 <= 1 THEN 30 ELSE 30000 / 1001::DOUBLE END AS fps0, CASE WHEN lone THEN 1 WHEN s % 5 = 0 THEN s / 2::DOUBLE ELSE s END::DOUBLE AS dur, CASE WHEN lone THEN 'aac' WHEN s % 3 = 0 THEN 'h264' ELSE 'vp9' END AS codec, CASE WHEN lone THEN 0 ELSE 1280 END AS width, CASE WHEN lone THEN 0 WHEN s % 2 = 0 THEN 720 ELSE 1080 END AS height FROM p)
SELECT p_partkey, 'vid_' || substr(sha1(concat_ws(chr(31), 'part', f)), 1, 12) AS video_id, round(fps0, 6) AS fps, round(dur, 6) AS duration_s, codec, width, height, height = 720 AND abs(fps0 - 30) < 0.5 AND codec = 'h264' AS conformant, NOT dur BETWEEN 5 AND 30 AS duration_flagged FROM q""",
    "tag_lookup": f"WITH {_TAG_KEYS}, c AS (SELECT 'clips/' || p_brand || '/' || p_partkey || '.mp4' AS video_file, p_partkey FROM part) SELECT c.video_file, coalesce(b.regime, s.regime, 'unknown') AS regime, coalesce(b.seq, s.seq) AS seq FROM c LEFT JOIN keys b ON b.key = c.p_partkey || '.mp4' LEFT JOIN keys s ON s.key = c.p_partkey::VARCHAR",
    "video_match_reuse": f"WITH {_CLIPS}, {_RANKED}, {_ASKING}, {_OWN}, {_MATCHED} SELECT incident_id, video_file, alignment_method FROM matched",
    "video_match_strict": f"WITH {_CLIPS}, {_RANKED}, {_ASKING}, {_OWN} SELECT incident_id, video_file, CASE WHEN video_file IS NULL THEN 'none' ELSE 'label_match' END AS alignment_method FROM own",
    "video_match_once": f"""WITH {_CLIPS}, {_RANKED}, {_ASKING}, placed AS (SELECT *, md5('{SEED}|' || incident_id) AS h, row_number() OVER (PARTITION BY regime_label ORDER BY md5('{SEED}|' || incident_id), incident_id) - 1 AS place FROM asking),
first AS (SELECT p.*, r.video_file FROM placed p LEFT JOIN ranked r ON r.regime_label = p.regime_label AND r.place = p.place AND p.regime_label <> 'SMALL'),
rest AS (SELECT incident_id, regime_label, row_number() OVER (ORDER BY h, incident_id) - 1 AS place FROM first WHERE video_file IS NULL)
SELECT incident_id, video_file, 'label_match' AS alignment_method FROM first WHERE video_file IS NOT NULL UNION ALL SELECT t.incident_id, i.video_file, CASE WHEN i.video_file IS NULL THEN 'none' WHEN t.regime_label = 'SMALL' THEN 'label_match' ELSE 'idle_fallback' END FROM rest t LEFT JOIN ranked i ON i.regime_label = 'SMALL' AND i.place = t.place""",
    "topic_retrieval": f"WITH {_RETRIEVED} SELECT * FROM best",
    "embedding_nearest": "WITH pairs AS (SELECT q.vec_id, r.vec_id AS neighbour, round(list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[]), 6) AS similarity FROM embeddings q JOIN embeddings r ON q.vec_id % 100 = 0 AND q.vec_id <> r.vec_id), placed AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, neighbour)::INTEGER AS nth FROM pairs) SELECT vec_id, nth, neighbour, similarity FROM placed WHERE nth <= 10",
    "topic_retrieval_bm25": f"WITH {_BM25} SELECT failure_family, doc_type, string_agg(chunk_id, ',' ORDER BY nth) AS chunk_ids FROM filled GROUP BY 1, 2",
    "split_greedy": f"WITH RECURSIVE {_greedy('customer', 'c_nationkey')} SELECT g AS c_nationkey, split FROM split_of",
    "split_greedy_sources": f"WITH RECURSIVE {_greedy('documents', 'source')} SELECT g AS source, split FROM split_of",
    "split_prefix": f"WITH s AS (SELECT o_custkey, count(*) AS n, md5('42|' || o_custkey) AS h FROM orders GROUP BY 1), m AS (SELECT o_custkey, (sum(n) OVER (ORDER BY h, o_custkey) - n / 2::DOUBLE) / sum(n) OVER () AS x FROM s) SELECT o_custkey, CASE WHEN x < {_EDGES[0]!r}::DOUBLE THEN 'train' WHEN x < {_EDGES[1]!r}::DOUBLE THEN 'val' WHEN x < {_EDGES[2]!r}::DOUBLE THEN 'test' ELSE 'human_eval' END AS split FROM m",
    "split_leakage": "SELECT 'by_group' AS side, 0::BIGINT AS n_leaking_groups UNION ALL SELECT 'by_row', count(*) FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) > 1)",
    "split_shares": "WITH s AS (SELECT o_custkey, count(*) AS n, md5('42|' || o_custkey) AS h FROM orders GROUP BY 1), m AS (SELECT o_custkey, (sum(n) OVER (ORDER BY h, o_custkey) - n / 2::DOUBLE) / sum(n) OVER () AS x FROM s) SELECT CASE WHEN x < 0.5 THEN 'train' WHEN x < 0.8 THEN 'val' ELSE 'test' END AS split, count(*) AS n_groups FROM m GROUP BY 1",
    "family_floors": "WITH c AS (SELECT o_orderpriority AS failure_family, count(*) AS n FROM orders WHERE o_orderpriority NOT IN ('2-HIGH', '4-NOT SPECIFIED') GROUP BY 1) SELECT failure_family, n, n >= 3000 AS met FROM c UNION ALL SELECT '2-HIGH', 0, false",
    "grounding_measures": f"WITH RECURSIVE {_INCIDENTS}, links AS (SELECT DISTINCT incident_id, failure_family, unnest(list_filter(string_split(sop_chunk_ids || ',' || maintenance_chunk_ids, ','), lambda x: x <> '')) AS chunk_id FROM inc), looked AS (SELECT * FROM links ORDER BY md5('13|' || incident_id || '|' || chunk_id), incident_id, chunk_id LIMIT 30), checked AS (SELECT len(list_intersect(t.topic_tags, f.topics)) > 0 AS good FROM looked l LEFT JOIN typed t USING (chunk_id) LEFT JOIN families f USING (failure_family)) SELECT 'n_links_sampled' AS metric, count(*)::DOUBLE AS \"value\" FROM checked UNION ALL SELECT 'topic_link_relevance', round(avg(CASE WHEN good THEN 1.0::DOUBLE ELSE 0 END), 6) FROM checked UNION ALL SELECT 'pct_span_out_of_window', round(avg(CASE WHEN s.start_s < i.window_start_s - i.t_event_s - 1e-6 OR s.end_s > i.window_end_s - i.t_event_s + 1e-6 THEN 1.0::DOUBLE ELSE 0 END), 6) FROM spans s JOIN idx i USING (incident_id)",
    "incident_contract": f"WITH RECURSIVE {_INCIDENTS} SELECT incident_id, concat_ws(',', CASE WHEN regime_label <> 'unknown' THEN 'regime' END, CASE WHEN end_s < start_s THEN 'sensor_spans' END) AS violations FROM inc",
    "assembly_notes": f"WITH RECURSIVE {_INCIDENTS} SELECT count(*) AS written, count(*) FILTER (video_file IS NULL) AS no_video, count(*) FILTER (len(list_filter(string_split(sop_chunk_ids, ','), lambda x: x <> '')) < 2 OR len(list_filter(string_split(maintenance_chunk_ids, ','), lambda x: x <> '')) < 2) AS short_text, count(DISTINCT source_dataset) AS split_groups FROM inc",
    "clip_notes": "WITH d AS (SELECT CASE WHEN p_size % 11 = 0 THEN 1 WHEN p_size % 5 = 0 THEN p_size / 2::DOUBLE ELSE p_size END::DOUBLE AS d FROM part) SELECT count(*) AS discovered, count(*) FILTER (d > 1.5) AS written, count(*) FILTER (d <= 1.5) AS errors, count(*) FILTER (NOT d BETWEEN 5 AND 30) AS duration_flagged FROM d",
    "hard_gates": """WITH o AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders), m AS (SELECT avg((c NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 <> 0))::INT) AS pct_missing_sensor_file, avg((c NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0))::INT) FILTER (k % 3 = 0) AS pct_missing_video_file,
0.5::DOUBLE AS pct_dangling_chunk_id, avg((k % 10 = 0)::INT) AS pct_malformed_json, avg((k % 8 = 0)::INT) AS pct_bad_span, (count(*) - count(DISTINCT k - k % 2)) / count(*)::DOUBLE AS pct_duplicate_incident_id, count(*) FILTER (k % 50 = 0)::DOUBLE AS fs_hz_plausible_violations FROM o)
SELECT metric, round(value, 6) AS value, 'FAIL' AS level FROM (UNPIVOT m ON COLUMNS(*) INTO NAME metric VALUE value) WHERE value <> 0""",
    "missing_files": f"SELECT path, count(*) AS n FROM (SELECT [{', '.join(repr(x) for x in REFERRED)}][o_orderkey % {len(REFERRED)} + 1] || '.parquet' AS path FROM orders) WHERE path IN ('clips.parquet', 'chunks.parquet', 'windows.parquet') GROUP BY 1",
    "document_files": "SELECT source, md5(string_agg(doc_id || ': ' || length(text), chr(10) ORDER BY doc_id)) AS text_md5, true AS sound_id FROM documents GROUP BY source",
    "tag_files": "SELECT p_type AS regime, 'normal' AS condition, count(*) AS n, count(DISTINCT p_name) AS n_files FROM part GROUP BY 1",
    "index_files": """SELECT p_partkey::VARCHAR AS incident_id, '["' || p_brand || '","' || p_type || '"]' AS sop_chunk_ids, 'written' AS side FROM part""",
    "report_file": "WITH c AS (SELECT o_orderpriority AS v, count(*) AS n, sum(count(*)) OVER () AS t FROM orders GROUP BY 1) SELECT metric, round(value, 6) AS value FROM (UNPIVOT (SELECT max(n / t::DOUBLE) AS dominant_class_share, sum(CASE WHEN v = '4-NOT SPECIFIED' THEN n / t::DOUBLE ELSE 0 END) AS pct_unknown_failure, -sum(n / t::DOUBLE * ln(n / t::DOUBLE)) / ln(count(*)) AS entropy_failure FROM c) ON COLUMNS(*) INTO NAME metric VALUE value)",
    "assemble_incidents": f"WITH RECURSIVE {_INCIDENTS} SELECT incident_id, source_dataset, failure_family, round(window_start_s, 6) AS window_start_s, round(window_end_s, 6) AS window_end_s, n_samples, video_file, clip_end_s, alignment_method, severity_label, regime_label, phase_label, sop_chunk_ids, maintenance_chunk_ids, split FROM inc",
    "quality_distribution": f"WITH RECURSIVE {_INCIDENTS} SELECT 'failure_family' AS dimension, failure_family AS value, count(*) AS n FROM inc GROUP BY 2 UNION ALL SELECT 'regime_label', regime_label, count(*) FROM inc GROUP BY 2 UNION ALL SELECT 'severity_label', severity_label, count(*) FROM inc GROUP BY 2 UNION ALL SELECT 'split', split, count(*) FROM inc GROUP BY 2",
    "quality_entropy": "WITH c AS (SELECT o_orderpriority AS v, count(*) AS n, sum(count(*)) OVER () AS t FROM orders GROUP BY 1) SELECT round(max(n / t::DOUBLE), 6) AS dominant_class_share, round(sum(CASE WHEN v = '4-NOT SPECIFIED' THEN n / t::DOUBLE ELSE 0 END), 6) AS pct_unknown_failure, round(-sum(n / t::DOUBLE * ln(n / t::DOUBLE)) / ln(count(*)), 6) AS entropy_failure FROM c",
    "quality_metrics": f"WITH RECURSIVE {_METRICS} SELECT metric, round(value, 6) AS value FROM metrics",
    "quality_violations": f"WITH RECURSIVE {_missed(3)} SELECT metric, round(value, 6) AS value, op, target, level FROM missed",
    "quality_grade": f"WITH RECURSIVE {_missed(2)} SELECT CASE WHEN count(*) FILTER (level = 'FAIL') > 0 THEN 'FAIL' WHEN count(*) > 0 THEN 'WARN' ELSE 'PASS' END AS grade, count(*) FILTER (level = 'FAIL') AS n_failures, count(*) FILTER (level = 'WARN') AS n_warnings FROM missed",
    "span_checks": "WITH s AS (SELECT CASE WHEN o_orderkey % 5 <> 0 THEN -1.0::DOUBLE END AS a, (o_orderkey % 4 - 2)::DOUBLE AS b FROM orders), t AS (SELECT a, b, coalesce(b >= a, false) AS ok FROM s) SELECT round(avg((NOT ok)::INT), 6) AS pct_bad_span, round(avg(CASE WHEN ok THEN least((b - a) / 5, 1) ELSE 0 END), 6) AS mean_sensor_span_frac, round(avg((ok AND a <= 0 AND b >= 0)::INT), 6) AS pct_event_near_zero, count(*)::DOUBLE AS fs_hz_plausible_violations, 0.0::DOUBLE AS pct_window_len_mismatch FROM t",
    "dangling_chunks": f"WITH RECURSIVE {_INCIDENTS}, {_NAMED} SELECT chunk_id, count(*) AS n FROM named WHERE chunk_id NOT IN (SELECT chunk_id FROM chunks WHERE n_tokens < 175) GROUP BY 1",
    "malformed_lists": "SELECT round(avg((event_id % 4 = 0)::INT), 6) AS pct_malformed_json FROM events",
    "json_lists": """SELECT p_partkey, CASE WHEN p_size % 7 <> 0 THEN '["' || p_brand || '","' || p_type || '"]' END AS j, CASE WHEN p_size % 7 <> 0 THEN 2 ELSE 0 END AS n, CASE WHEN p_size % 7 <> 0 THEN p_brand || '/' || p_type ELSE '' END AS items FROM part""",
}

#: Of these SQL can't tell the result: tests do.
UNTOLD = ("embedding_retrieval",)
QUERIES = {name: globals()[name] for name in (*SQL, *UNTOLD)}
