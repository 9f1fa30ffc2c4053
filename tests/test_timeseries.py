import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millwatch.operators import selection
from millwatch.operators import timeseries as ts
from millwatch.operators.timeseries import Detection

HOW = {"fs_hz": 200.0, "window_s": 0.5, "hop_s": 0.1, "method": "zscore", "threshold": 4.0, "baseline_s": 5.0, "min_separation_s": 1.0, "min_duration_s": 0.1}


def recording(spark, bursts=(5, 10, 15), seconds=20, fs=200, amp=12.0, dc=-1015.0, seed=0, width=0.6, run="r"):
    rng = np.random.default_rng(seed)
    t = np.arange(int(seconds * fs)) / fs
    z = rng.normal(0, 1, len(t)) + dc
    for b in bursts:
        at = np.abs(t - b) <= width / 2
        z[at] += rng.normal(0, amp, at.sum())
    rows = [(run, i, float(x), 0.1, 0.2, float(v)) for i, (x, v) in enumerate(zip(t, z, strict=True))]
    return spark.createDataFrame(rows, "run_id string, i long, time_s double, ax double, ay double, az double").repartition(3)


def found(df):
    return sorted(r.t_event_s for r in df.collect())


def test_bursts_are_found_within_a_second(spark):
    times = found(ts.detected(recording(spark), Detection(**HOW)))
    assert len(times) == 3
    assert np.abs(np.asarray(times) - [5, 10, 15]).max() < 1


def test_noise_has_no_events(spark):
    assert not found(ts.detected(recording(spark, bursts=(), seed=3), Detection(**HOW | {"threshold": 6.0})))


def test_close_bursts_merge_and_short_ones_go(spark):
    close = recording(spark, bursts=(5.0, 5.5))
    assert len(found(ts.detected(close, Detection(**HOW | {"min_separation_s": 2.0})))) == 1
    assert not found(ts.detected(close, Detection(**HOW | {"min_duration_s": 5.0})))


def test_a_higher_threshold_never_adds(spark):
    rows = recording(spark, bursts=(5, 10, 15, 20), seconds=30)
    assert len(found(ts.detected(rows, Detection(**HOW | {"threshold": 6.0})))) <= len(found(ts.detected(rows, Detection(**HOW | {"threshold": 3.0}))))


def test_rms_is_that_of_each_window(spark):
    rows = recording(spark, seconds=5)
    z = np.asarray([r.az for r in rows.orderBy("i").collect()])
    x = z - z.mean()
    got = {r.k: r.rms for r in ts.sliding_rms(rows, Detection(**HOW)).collect()}
    want = {k: np.sqrt((x[s : s + 100] ** 2).mean()) for k, s in enumerate(range(0, len(x) - 99, 20))}
    assert got.keys() == want.keys()
    assert max(abs(got[k] - want[k]) for k in want) < 1e-9


def test_each_run_has_its_own_rate_and_axes(spark):
    fast, slow = recording(spark, fs=200, run="fast"), recording(spark, fs=80, run="slow").withColumn("az", F.col("ax") * 0 + F.col("az"))
    lacking = slow.withColumn("run_id", F.lit("lacking")).withColumn("ay", F.col("az")).withColumn("az", F.lit(None).cast("double"))
    rows = fast.unionByName(slow).unionByName(lacking)
    rates = ts.chosen_rate(ts.median_rate(rows).withColumnRenamed("fs_hz", "median_fs").withColumn("meta_fs", F.lit(None).cast("double")))
    events = ts.detected(rows, Detection(**HOW), rates)
    for run in ("fast", "slow", "lacking"):
        times = found(events.where(F.col("run_id") == run))
        assert len(times) == 3 and np.abs(np.asarray(times) - [5, 10, 15]).max() < 1
    size = ts.sliding_rms(rows, Detection(**HOW | {"channel": "magnitude"}), rates).groupBy("run_id").agg(F.max("rms").alias("most")).collect()
    assert len(size) == 3 and all(r.most > 1 for r in size)
    index = ts.window_index(ts.carved(rows, events, 1.0, 1.0), rates)
    assert {(r.run_id, round(r.fs_hz, 6)) for r in index.collect()} == {("fast", 200.0), ("slow", 80.0), ("lacking", 80.0)}


def test_magnitude_is_over_the_axes_there_are(spark):
    rows = spark.createDataFrame([("r", i, i / 10, None, 3.0 * (i % 2), 4.0 * (i % 2)) for i in range(8)], "run_id string, i long, time_s double, ax double, ay double, az double")
    how = Detection(fs_hz=10.0, window_s=0.2, hop_s=0.2, channel="magnitude")
    assert [r.rms for r in ts.sliding_rms(rows, how).collect()] == pytest.approx([2.5] * 4)


def test_a_run_shorter_than_the_window_has_no_grid(spark):
    assert ts.sliding_rms(recording(spark, seconds=0.2), Detection(**HOW)).count() == 0


def test_time_is_repaired_for_the_whole_run(spark):
    rows = [("a", i, t) for i, t in enumerate([0.0, 0.0, 0.5, 0.2, 0.9])] + [("b", i, t) for i, t in enumerate([1.0, 2.0, 4.0])] + [("c", 0, 1.0), ("c", 1, None)]
    got = {(r.run_id, r.i): r.time_s for r in ts.repaired_time(spark.createDataFrame(rows, "run_id string, i long, time_s double"), 10).collect()}
    assert [got["a", i] for i in range(5)] == [0.0, 0.1, 0.2, 0.3, 0.4]
    assert [got["b", i] for i in range(3)] == [1.0, 2.0, 4.0]
    assert [got["c", i] for i in range(2)] == [0.0, 0.1]


def test_rates(spark):
    rows = spark.range(1000).select(F.lit("a").alias("run_id"), F.col("id").alias("i"), (F.col("id") / 2000).alias("time_s"))
    assert ts.median_rate(rows).first().fs_hz == pytest.approx(2000, rel=0.01)
    runs = spark.createDataFrame([("a", 5.0, None), ("b", 2000.0, 100.0), ("c", None, None)], "run_id string, median_fs double, meta_fs double")
    got = {r.run_id: (r.fs_hz, r.reason) for r in ts.chosen_rate(runs, low=100).collect()}
    assert got == {"a": (None, "fs_implausible"), "b": (2000.0, None), "c": (None, "fs_missing")}
    assert {r.fs_hz for r in ts.chosen_rate(runs, "fixed", 1000.0).collect()} == {1000.0}
    assert {r.reason for r in ts.chosen_rate(runs, "fixed").collect()} == {"fs_missing"}


@pytest.mark.parametrize("target", [40.0, 64.0, 333.0])
def test_resampling_is_linear_interpolation(spark, target):
    rows = recording(spark, seconds=2.005, fs=100)
    local = rows.orderBy("i").toPandas()
    for out in (ts.resampled(rows, 100.0, target), ts.resampled_uneven(rows, target)):
        got = out.orderBy("i").toPandas()
        n = max(2, round((local.time_s.max() - local.time_s.min()) * target))
        grid = np.arange(n) / target
        assert len(got) == n
        assert np.allclose(got.az, np.interp(grid, local.time_s, local.az))
    assert ts.resampled(rows, 100.0, None) is rows


def carved(spark, t, drop=True, pre=60.0, post=30.0):
    event = spark.createDataFrame([("r", t, t - 0.3, t + 0.3, 10.0)], "run_id string, t_event_s double, t_start_s double, t_end_s double, score double")
    rows = spark.range(40_000).select(F.lit("r").alias("run_id"), F.col("id").alias("i"), (F.col("id") / 200).alias("time_s"), F.lit(0.0).alias("ax"), F.lit(0.0).alias("ay"), F.sin("id").alias("az"))
    return ts.carved(rows, event, pre, post, drop)


def test_windows_and_spans(spark):
    waves = carved(spark, 100.0)
    row = ts.with_spans(ts.window_index(waves, 200.0, with_amplitude=True)).first()
    assert (row.window_start_s, row.window_end_s, row.n_samples) == (40.0, 130.0, 18_001)
    span = row.sensor_relevant_spans[0]
    assert span.start_s <= -0.3 and span.end_s >= 0.3 and len(row.sensor_relevant_spans) <= 5
    ends = waves.agg(F.min("t_rel_s"), F.max("t_rel_s")).first()
    assert tuple(ends) == (-60.0, 30.0)
    assert row.amplitude == pytest.approx(1, abs=0.01)


def test_partial_windows(spark):
    assert carved(spark, 5.0).count() == 0
    assert carved(spark, 5.0, drop=False).count() == 7001


def test_channels_fall_back(spark):
    rows = spark.createDataFrame([("a", 1.0, 1.0, None), ("b", 1.0, None, None), ("c", None, None, None), ("d", 1.0, 1.0, float("nan"))], "run_id string, ax double, ay double, az double")
    assert {r.run_id: r.channel for r in ts.usable_channel(rows).collect()} == {"a": "ay", "b": "ax", "d": "ay"}


def test_caps_take_the_first_events(spark):
    events = spark.createDataFrame([("a", float(t)) for t in (3, 1, 2)] + [("b", 9.0)], "run_id string, t_event_s double")
    assert sorted(map(tuple, ts.capped(events, 2).collect())) == [("a", 1.0), ("a", 2.0), ("b", 9.0)]


def plain_islands(points, apart):
    """Stretches over the threshold of (k, t, stat), then merged when closer than ``apart``."""
    found, run = [], []
    for k, t, stat in [*sorted(points), (10**9, 0, -1)]:
        if run and (stat <= 1 or k != run[-1][0] + 1):
            best = max(run, key=lambda p: (p[2], -p[0]))
            found.append([best[1], run[0][1], run[-1][1], best[2]])
            run = []
        if stat > 1:
            run.append((k, t, stat))
    return found, plain_merged(found, apart)


def plain_merged(found, apart):
    out = []
    for event in sorted(found, key=lambda e: (e[1], e[2], e[0])):
        if out and event[1] - max(e[2] for e in out[-1]) < apart:
            out[-1].append(event)
        else:
            out.append([event])
    return [(max(g, key=lambda e: (e[3], -e[1]))[0], min(e[1] for e in g), max(e[2] for e in g), max(e[3] for e in g)) for g in out]


@pytest.mark.parametrize("segment,span", [(3, 1.0), (8192, 3600.0)])
def test_stretches_and_events_across_segments(spark, monkeypatch, segment, span):
    monkeypatch.setattr(ts, "SEGMENT", segment)
    monkeypatch.setattr(ts, "SPAN_S", span)
    rng = random.Random(segment)
    runs = {f"r{n}": [(k, k / 4, rng.choice([0.5, 1.5, 2.0, 2.5] if k // 20 % 2 else [0.5, 3.0])) for k in range(120) if rng.random() < 0.97] for n in range(3)} | {"all": [(k, k / 4, 2.0) for k in range(50)]}
    grid = spark.createDataFrame([(r, *p, 1.0) for r, points in runs.items() for p in points], "run_id string, k long, t_s double, stat double, threshold double").repartition(3)
    found = ts.islands(grid)
    for name, got, pick in (("islands", found, 0), ("merged", ts.merged(found, 1.1), 1)):
        rows = {}
        for r in got.select("run_id", "t_event_s", "t_start_s", "t_end_s", "score").collect():
            rows.setdefault(r[0], set()).add(tuple(r)[1:])
        assert rows == {r: {tuple(e) for e in plain_islands(points, 1.1)[pick]} for r, points in runs.items()}, name


def test_events_that_reach_over_spans_are_merged(spark, monkeypatch):
    monkeypatch.setattr(ts, "SPAN_S", 2.0)
    rng = random.Random(4)
    events = [[s + 0.1, s, s + rng.choice([0.5, 0.5, 0.5, 9.0]), float(rng.randint(0, 5))] for s in (rng.randint(0, 400) / 4 for _ in range(60))]
    got = ts.merged(spark.createDataFrame([("r", *e) for e in events], "run_id string, t_event_s double, t_start_s double, t_end_s double, score double"), 1.0)
    assert sorted((r.t_start_s, r.t_end_s, r.score) for r in got.collect()) == sorted(e[1:] for e in plain_merged(events, 1.0))


@pytest.mark.parametrize("kind", ["equal", "wide"])
def test_quantiles_are_exact_whatever_the_groups_size(spark, monkeypatch, kind):
    monkeypatch.setattr(selection, "SMALL", 20)
    monkeypatch.setattr(selection, "CELLS", 32)
    rng = random.Random(kind)
    value = {"plain": lambda: rng.gauss(0, 1), "equal": lambda: rng.choice([1.0, 1.0, 1.0, 2.0, 1e9]), "wide": lambda: rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 308), "two": lambda: rng.choice([0.1, 0.1 + 1e-17, 0.3])}[kind]
    groups = {"a": [value() for _ in range(400)], "b": [value() for _ in range(19)], "c": [value() for _ in range(21)] + [None, float("nan")], "d": [None]}
    df = spark.createDataFrame([(g, v) for g, values in groups.items() for v in values], "g string, v double").repartition(3)
    shares = [0.5, 1 / 3, 1.0]
    got = {r.g: tuple(r)[1:] for r in selection.quantiles(df, ["g"], "v", shares).collect()}
    for g, values in groups.items():
        x = sorted(v for v in values if v is not None and v == v)
        for share, have in zip(shares, got[g], strict=True):
            if not x:
                assert have is None
                continue
            at = share * (len(x) - 1)
            low, high = x[int(at)], x[-int(-at // 1)]
            assert have == pytest.approx(low + (at - int(at)) * (high - low), rel=1e-12, abs=1e-300)


def test_neighbours_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(ts, "BLOCK", 4)
    rows = [("r", i, i * i / 10) for i in range(30) if i != 12] + [("s", i, None) for i in range(5)]
    df = spark.createDataFrame(rows, "run_id string, i long, time_s double").repartition(4)
    got = {(r.run_id, r.i): r.before for r in ts._before(df).collect()}
    times = {(r, i): t for r, i, t in rows}
    assert got == {(r, i): times.get((r, i - 1)) for r, i, _ in rows}
    assert ts.untimed(df).count() == 5
