from collections import Counter

import pytest
from pyspark.sql import functions as F

from millwatch.functions import scalars as sc
from millwatch.operators import contracts, matching, quality, splits
from millwatch.sources import readers, sinks


def clips(spark):
    return spark.createDataFrame([("a", "roughing"), ("b", "idle"), ("c", "finishing")], "video_file string, regime_label string")


def asked(spark, *regimes):
    return spark.createDataFrame([(f"i{k}", r) for k, r in enumerate(regimes)], "incident_id string, regime_label string")


def methods(df):
    return {r.incident_id: (r.video_file, r.alignment_method) for r in df.collect()}


def test_matching_falls_back_to_idle(spark):
    got = methods(matching.matched_clips(asked(spark, "roughing", "plunge", None), clips(spark)))
    assert got == {"i0": ("a", "label_match"), "i1": ("b", "idle_fallback"), "i2": ("b", "idle_fallback")}
    assert methods(matching.matched_clips(asked(spark, "plunge"), clips(spark), idle=None)) == {"i0": (None, "none")}


def test_matching_is_seeded_and_spreads(spark):
    many = spark.range(40).select(F.concat(F.lit("v"), "id").alias("video_file"), F.lit("roughing").alias("regime_label"))
    ask = asked(spark, *["roughing"] * 200)
    one, two = methods(matching.matched_clips(ask, many)), methods(matching.matched_clips(ask, many.repartition(3)))
    assert one == two
    assert len({v for v, _ in one.values()}) > 30


def test_clips_used_once(spark):
    got = methods(matching.matched_once(asked(spark, "roughing", "roughing", "finishing", "idle", "plunge"), clips(spark)))
    used = [v for v, _ in got.values() if v]
    assert len(used) == len(set(used)) == 3
    assert Counter(m for _, m in got.values())["none"] == 2


def test_tags_by_path_name_and_stem(spark):
    tags = spark.createDataFrame([("x/a.mp4", None, "first", 0), ("a.mp4", None, "later", 1), (None, "b", "stem", 2)], "video_file string, clip string, regime string, seq int")
    files = spark.createDataFrame([("x/a.mp4",), ("y/a.mp4",), ("z/b.mp4",), ("z/c.mp4",)], "video_file string")
    got = {r.video_file: r.regime for r in matching.tagged(files, tags, "seq").select("video_file", "tag.regime").collect()}
    assert got == {"x/a.mp4": "first", "y/a.mp4": "later", "z/b.mp4": "stem", "z/c.mp4": None}


def test_retrieval_takes_shared_topics_then_length(spark):
    rows = [("c1", "sop", ["vibration"], 10), ("c2", "sop", ["tool_wear", "vibration"], 5), ("c3", "sop", [], 99), ("m1", "maintenance", [], 3)]
    chunks = spark.createDataFrame(rows, "chunk_id string, doc_type string, topic_tags array<string>, n_tokens long")
    families = spark.createDataFrame([("unknown",), ("spindle_fault",)], "failure_family string")
    got = {(r.failure_family, r.doc_type): r.chunk_ids for r in matching.retrieved(families, chunks, sc.TOPICS, 2, ["spindle_fault"]).collect()}
    assert got["unknown", "sop"] == ["c2", "c1"]
    assert got["spindle_fault", "sop"] == ["c3", "c1"]
    assert got["unknown", "maintenance"] == ["m1"]


def test_greedy_split(spark):
    rows = spark.range(100).withColumnRenamed("id", "g")
    got = Counter(r.split for r in splits.greedy(rows, "g").collect())
    assert abs(got["train"] - 70) <= 2 and abs(got["val"] - 15) <= 2 and abs(got["test"] - 10) <= 2
    one = spark.range(50).select(F.lit("x").alias("g"))
    assert [r.split for r in splits.greedy(one, "g").collect()] == ["train"]
    assert sorted(map(tuple, splits.greedy(rows, "g").collect())) == sorted(map(tuple, splits.greedy(rows.repartition(3), "g").collect()))


def test_prefix_split_has_no_leaks(spark):
    rows = spark.range(20_000).select((F.col("id") % 3000).alias("g"))
    parts = splits.prefix(rows, "g")
    share = Counter(r.split for r in parts.collect())
    assert abs(share["train"] / 3000 - 0.7) < 0.02
    assert splits.leaks(rows.join(parts, "g"), "g").count() == 0
    with pytest.raises(ValueError, match="sum"):
        splits.prefix(rows, "g", {"train": 0.5})


def test_severity(spark):
    rows = spark.createDataFrame([(5.0,), (15.0,), (25.0,), (None,), (float("nan"),)], "a double")
    assert [r[0] for r in rows.select(sc.severity(F.col("a"), F.lit(10.0), F.lit(20.0))).collect()] == ["low", "med", "high", "unknown", "unknown"]
    assert rows.select(sc.severity(F.col("a"), F.lit(None), F.lit(20.0))).distinct().collect()[0][0] == "unknown"


PROBES = [
    ('{"streams":[{"codec_type":"audio","codec_name":"aac"},{"codec_type":"video","codec_name":"h264","avg_frame_rate":"30/1","width":1280,"height":720,"duration":"7.5"}]}', (30.0, 7.5, "h264", 1280, 720)),
    ('{"streams":[{"codec_type":"video","avg_frame_rate":"0/0","r_frame_rate":"30000/1001"}],"format":{"duration":"3"}}', (29.97003, 3.0, "unknown", 0, 0)),
    ('{"streams":[]}', (0.0, 0.0, "unknown", 0, 0)),
    ("{}", (0.0, 0.0, "unknown", 0, 0)),
]


def test_probe_documents(spark):
    rows = spark.createDataFrame([(p,) for p, _ in PROBES], "p string").select(sc.probe(F.col("p")).alias("c"))
    assert [tuple(r.c) for r in rows.collect()] == [want for _, want in PROBES]
    assert [r[0] for r in rows.select(sc.is_conformant(F.col("c"))).collect()] == [True, False, False, False]


def test_identities(spark):
    import hashlib

    row = spark.range(1).select(sc.incident_id(F.lit("d"), F.lit("r"), F.lit(1.5)).alias("a"), sc.millis(F.lit(0.0625)).alias("b"), sc.chunk_id(F.lit("x"), F.lit(7)).alias("c")).first()
    assert row.a == "inc_d_" + hashlib.sha1("\x1f".join(["d", "r", "1.500"]).encode()).hexdigest()[:12]
    assert (row.b, row.c) == ("0.063", "x__c0007")


def test_contracts_and_counters(spark):
    rows = spark.createDataFrame([(1, "a"), (None, "a"), (2, "z")], "n int, k string")
    told = contracts.with_violations(rows, {"n": F.col("n").isNotNull(), "k": F.col("k") == "a"})
    assert [list(r.violations) for r in told.collect()] == [[], ["n"], ["k"]]
    assert contracts.kept(told).count() == 1 and contracts.quarantined(told).count() == 2
    assert tuple(contracts.counters(told, twos=F.col("n") == 2).first()) == (3, 1, 2, 1)


def test_renaming_makes_numbers(spark):
    rows = spark.createDataFrame([("1.5", "x", "NaN", "junk")], "X string, Y string, Z string, junk string")
    out = contracts.renamed(rows, {"X": "ax", "Y": "ay", "Z": "az"})
    assert out.columns == ["ax", "ay", "az"] and tuple(out.first()) == (1.5, None, None)


def incident(**more):
    base = {"incident_id": "i", "source_dataset": "d", "window_start_s": 0.0, "window_end_s": 5.0, "fs_hz": 100.0, "video_file": None, "alignment_method": "none", "sop_chunk_ids": ["c"], "maintenance_chunk_ids": ["c"], "sensor_relevant_spans": [(-1.0, 1.0)], "failure_family": "unknown"}
    return base | more


SCHEMA = "incident_id string, source_dataset string, window_start_s double, window_end_s double, fs_hz double, video_file string, alignment_method string, sop_chunk_ids array<string>, maintenance_chunk_ids array<string>, sensor_relevant_spans array<struct<start_s:double,end_s:double>>, failure_family string"


def measured(spark, rows, tier="mvp"):
    df = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)
    chunks = spark.createDataFrame([("c", 30_000)], "chunk_id string, n_tokens long")
    metrics = quality.measures(df, clips(spark), chunks, 3.0, 2.0)
    return {r.metric: r.value for r in metrics.collect()}, {r.metric: r.level for r in quality.violations(metrics, tier).collect()}, quality.grade(metrics, tier).first().grade


def test_measures_and_grade(spark):
    m, missed, grade = measured(spark, [incident(), incident(incident_id="j", sensor_relevant_spans=[(5.0, 1.0)], sop_chunk_ids=["gone"])])
    assert m["pct_bad_span"] == 0.5 and m["pct_dangling_chunk_id"] == 0.25 and m["pct_event_near_zero"] == 0.5 and m["entropy_failure"] == 0
    assert missed["pct_bad_span"] == "FAIL" and missed["total_incident_hours"] == "FAIL" and missed["pct_with_video"] == "WARN"
    assert grade == "FAIL"


def test_lost_files_and_malformed_lists_fail(spark):
    long = [incident(incident_id=f"i{k}", window_end_s=9000.0, failure_family=["unknown", "chatter"][k % 2], video_file="ab"[k % 2]) for k in range(4)]
    df = spark.createDataFrame([tuple(r.values()) for r in long], SCHEMA).withColumn("sensor_file", F.concat(F.lit("w/"), "incident_id"))
    chunks = spark.createDataFrame([("c", 30_000)], "chunk_id string, n_tokens long")
    files = spark.createDataFrame([("w/i0",), ("w/i1",), ("w/i2",), ("a",), ("a",)], "path string")
    waves = spark.createDataFrame([("d", "i0"), ("d", "i0"), ("d", "i1"), ("e", "i2")], "source_dataset string, incident_id string")
    texts = sinks.interchange(df).withColumn("sop_chunk_ids", F.when(F.col("incident_id") == "i1", '["c').when(F.col("incident_id") == "i2", '{"c": 1}').otherwise(F.col("sop_chunk_ids")))

    def told(incidents, **there):
        metrics = quality.measures(incidents, clips(spark), chunks, 3.0, 2.0, **there)
        failed = {r.metric: r.value for r in quality.violations(metrics).collect() if r.level == "FAIL"}
        return failed, quality.grade(metrics).first().grade

    assert told(df, files=files) == ({"pct_missing_sensor_file": 0.25, "pct_missing_video_file": 0.5}, "FAIL")
    assert told(df, waveforms=waves) == ({"pct_missing_sensor_file": 0.5}, "FAIL")
    assert told(df) == ({"pct_missing_sensor_file": None}, "FAIL")
    assert told(df.withColumn("video_file", F.lit("gone")).drop("sensor_file")) == ({"pct_missing_video_file": 1.0}, "FAIL")
    failed, grade = told(texts.drop("sensor_file"))
    assert failed["pct_malformed_json"] == 0.5 and grade == "FAIL"
    assert told(sinks.interchange(df).drop("sensor_file")) == told(df.drop("sensor_file")) == ({}, "WARN")


def test_no_incidents_fail(spark):
    assert measured(spark, [])[2] == "FAIL"


def test_warnings_only(spark):
    long = [incident(incident_id=f"i{k}", window_end_s=9000.0, failure_family=["unknown", "chatter"][k % 2]) for k in range(4)]
    m, missed, grade = measured(spark, long, "no such tier")
    assert grade == "WARN" and set(missed.values()) == {"WARN"} and m["dominant_class_share"] == 0.5


def test_csv_runs(spark, tmp_path):
    for folder, lines in (("good", 3), ("other", 2)):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "a.csv").write_text("x,y,z\n" + "".join(f"{k},0,0\n" for k in range(lines)))
    rows = readers.read_runs(spark, str(tmp_path), "x double, y double, z double")
    assert sorted((r.run_id, r.quality, r.i, r.x) for r in rows.where("quality = 'good'").collect()) == [("good/a.csv", "good", k, float(k)) for k in range(3)]
    assert rows.where("quality IS NULL").count() == 2
    (tmp_path / "doc.md").write_text("# hi\nthere")
    assert [(r.path, r.text) for r in readers.read_documents(spark, str(tmp_path)).collect()] == [("doc.md", "# hi\nthere")]
    assert readers.files_below(spark, str(tmp_path), "*.csv").count() == 2


def test_file_names_stay_themselves(spark, tmp_path):
    (tmp_path / "a+b").mkdir()
    (tmp_path / "a+b" / "x y%41.csv").write_text("x\n1\n2\n")
    (tmp_path / "a+b" / "empty.csv").write_text("x\n")
    (tmp_path / "a+b" / "t+é.md").write_text("t")
    rows = readers.read_runs(spark, str(tmp_path), "x double")
    assert sorted((r.run_id, r.i, r.x) for r in rows.collect()) == [("a+b/x y%41.csv", 0, 1.0), ("a+b/x y%41.csv", 1, 2.0)]
    assert [r.path for r in readers.unread_runs(spark, str(tmp_path), rows).collect()] == ["a+b/empty.csv"]
    assert [r.path for r in readers.read_documents(spark, str(tmp_path)).collect()] == ["a+b/t+é.md"]


def test_long_files_are_numbered_by_blocks(spark, tmp_path):
    (tmp_path / "long.csv").write_text("x\n" + "".join(f"{k}\n" for k in range(50_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        rows = readers.read_runs(spark, str(tmp_path), "x double")
        assert rows.rdd.getNumPartitions() > 1
        got = sorted((r.i, r.x) for r in rows.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [(k, float(k)) for k in range(50_000)]


def test_array_runs_need_three_numbers(spark):
    rows = spark.createDataFrame([("a", [[1.0, 2.0, 3.0, 4.0]]), ("b", [[1.0, 2.0]])], "k string, d array<array<double>>")
    assert [tuple(r) for r in readers.array_runs(rows, "k", "d").collect()] == [("a", 0, 1.0, 2.0, 3.0)]


def test_indices(spark, tmp_path):
    rows = spark.createDataFrame([("a", [1]), ("b", [])], "incident_id string, l array<int>")
    sinks.write_index(rows, str(tmp_path / "x"))
    assert {r.l for r in spark.read.parquet(str(tmp_path / "x")).collect()} == {"[1]", "[]"}
    sinks.write_index(rows, str(tmp_path / "dry"), dry_run=True)
    assert not (tmp_path / "dry").exists()
    assert readers.read_index(spark, str(tmp_path / "none"), "a string").count() == 0
    with pytest.raises(FileNotFoundError, match="sensor"):
        readers.read_index(spark, str(tmp_path / "none"), "a string", "sensor")
    assert [r.incident_id for r in sinks.not_yet_built(rows, rows.where("incident_id = 'a'")).collect()] == ["b"]
    waves = spark.createDataFrame([("d", "i", 0.0), ("d", "i", 1.0)], "source_dataset string, incident_id string, time_s double")
    sinks.write_waveforms(waves, str(tmp_path / "w"))
    assert spark.read.parquet(str(tmp_path / "w")).count() == 2
    assert readers.first_units(spark.range(9).select((F.col("id") % 3).alias("u")), "u", 2).count() == 6


def test_tags_give_known_labels_only(spark):
    tags = spark.createDataFrame([("a.mp4", " Roughing", "Chatter ", 1), ("b.mp4", "flying", None, 2)], "video_file string, regime string, condition string, seq long")
    clips = spark.createDataFrame([("x/a.mp4",), ("x/b.mp4",), ("x/c.mp4",)], "video_file string")
    got = {r.video_file: (r.regime_label, r.condition_label) for r in matching.clip_labels(matching.tagged(clips, tags, "seq")).collect()}
    assert got == {"x/a.mp4": ("roughing", "chatter"), "x/b.mp4": ("unknown", "unknown"), "x/c.mp4": ("unknown", "unknown")}
