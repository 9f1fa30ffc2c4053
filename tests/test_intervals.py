"""Marked intervals, evidence of most energy, short tails and rewritten waveforms against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from millwatch.operators import chunks as ch
from millwatch.operators import contracts, intervals
from millwatch.operators import timeseries as ts
from millwatch.sources import readers, sinks


def plain_pairs(left, right):
    """Greedy: the pair of the greatest share first, then the earlier."""
    share = {}
    for a in left:
        for b in right:
            overlap = min(a[1], b[1]) - max(a[0], b[0])
            if a[0] < a[1] and b[0] < b[1] and overlap > 0:
                share[a, b] = round(overlap / (max(a[1], b[1]) - min(a[0], b[0])), 9)
    out, used = set(), set()
    for (a, b), _ in sorted(share.items(), key=lambda x: (-x[1], x[0])):
        if ("a", a) not in used and ("b", b) not in used:
            used |= {("a", a), ("b", b)}
            out.add((a, b))
    return out


@pytest.mark.parametrize("bucket", [1.0, 600.0])
def test_pairs_are_those_of_the_greedy_choice(spark, bucket):
    rng = random.Random(3)
    sides = [{(s, s + rng.choice([0, 0.5, 1, 2, 7])) for s in (rng.randint(0, 80) / 2 for _ in range(40))} for _ in range(2)]
    left, right = (spark.createDataFrame([("r", *x) for x in side] + [("r", None, 1.0), ("r", 5.0, 4.0)], "run_id string, start_s double, end_s double") for side in sides)
    got = intervals.paired(intervals.overlapping(left, right, bucket)).collect()
    want = plain_pairs(*sides)
    assert {((r.left.start_s, r.left.end_s), (r.right.start_s, r.right.end_s)) for r in got} == want and len(got) == len(want)
    grade = intervals.graded(left, right).collect()[0]
    assert (grade.n_matched, grade.n_events, grade.n_labels) == (len(want), *[sum(a < b for a, b in side) for side in sides])
    assert intervals.graded(left.limit(0), right.limit(0)).count() == 0
    alone = intervals.graded(left, right.limit(0)).collect()[0]
    assert (alone.n_matched, alone.n_labels, alone.precision, alone.recall) == (0, 0, 0.0, None)


def test_labels_without_sound_bounds_are_no_events(spark):
    rows = [("r", 1.0, 2.0), ("r", 2.5, 3.0), ("r", 9.0, 8.0), ("r", None, 4.0), ("r", float("nan"), 5.0), ("r", 6.0, float("inf")), ("s", 1.0, 1.0)]
    got = ts.labelled(spark.createDataFrame(rows, "run_id string, start_s double, end_s double"), ts.Detection(fs_hz=10, min_separation_s=1.0, min_duration_s=0.5)).collect()
    assert [(r.run_id, r.t_event_s, r.t_start_s, r.t_end_s, r.score) for r in got] == [("r", 2.0, 1.0, 3.0, 1.0)]


def test_energy_spans_do_not_overlap(spark):
    rng = random.Random(1)
    grid = [("r", k, k / 4, rng.choice([1.0, 2.0, 3.0])) for k in range(500)]
    windows = [("i1", "r", 50.0, 40.0, 70.0), ("i2", "r", 100.0, 95.0, 124.0), ("i3", "s", 5.0, 0.0, 10.0)]
    index = spark.createDataFrame(windows, "incident_id string, run_id string, t_event_s double, window_start_s double, window_end_s double")
    got = {r.incident_id: [(s.start_s, s.end_s) for s in r.sensor_relevant_spans] for r in ts.with_energy_spans(index, spark.createDataFrame(grid, "run_id string, k long, t_s double, rms double"), 1.0, 0.5, 4).collect()}
    for name, run, event, low, high in windows:
        kept = []
        for _, t in sorted((-rms, t) for r, _, t, rms in grid if r == run and low <= t <= high):
            if len(kept) < 4 and all(abs(t - x) >= 1.0 for x in kept):
                kept.append(t)
        assert got[name] == [(max(t - 1.0, low) - event, min(t + 1.0, high) - event) for t in sorted(kept)]


@pytest.mark.parametrize("most", [20, 14])
def test_tails_keep_both_bounds(spark, most):
    texts = [(n, " ".join(f"w{i}" for i in range(n))) for n in range(0, 70)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    found = {}
    for r in ch.chunked(df, target=12, most=most, overlap=3, respect_headings=False, least=8).collect():
        found.setdefault(int(r.doc_id), []).append((r.ordinal, r.text.split()))
    for n, text in texts:
        parts = [p for _, p in sorted(found.get(n, []))]
        assert all(len(p) <= max(12, most) for p in parts) and all(len(p) >= 8 for p in parts if n >= 8)
        assert [w for w in text.split() if not any(w in p for p in parts)] == []
    with pytest.raises(ValueError, match="at least"):
        ch.token_windows(F.lit("x"), target=5, least=6)


def test_waveforms_written_again_do_not_double(spark, tmp_path):
    rows = spark.createDataFrame([(f"i{k % 7}", "d" if k % 7 < 4 else "e", k / 10, 1.0) for k in range(70)], "incident_id string, source_dataset string, time_s double, az double")
    path = str(tmp_path / "w")
    sinks.write_waveforms(rows, path, buckets=3)
    sinks.write_waveforms(rows.where("incident_id = 'i1'").withColumn("az", F.lit(5.0)), path, buckets=3)
    sinks.write_waveforms(spark.read.parquet(path).where("source_dataset = 'd'").drop("bucket"), path, buckets=3)
    back = spark.read.parquet(path)
    assert back.count() == 70 and {(r.incident_id, r.az) for r in back.collect()} == {("i1", 5.0)} | {(f"i{k}", 1.0) for k in range(7) if k != 1}
    files = {r.path for r in readers.files_below(spark, path).collect()}
    sinks.write_waveforms(rows.where("incident_id = 'i2'"), path, buckets=3)
    assert len(files & {r.path for r in readers.files_below(spark, path).collect()}) > 1  # buckets without a new window stay


def test_counts_of_a_write(spark, tmp_path):
    told = contracts.with_violations(spark.range(100).toDF("id"), {"small": F.col("id") < 90})
    rows, seen = contracts.observed(told, even=F.col("id") % 2 == 0)
    contracts.kept(rows).write.parquet(str(tmp_path / "kept"))
    assert contracts.counts_of(rows, seen).collect() == contracts.counters(told, even=F.col("id") % 2 == 0).collect()
