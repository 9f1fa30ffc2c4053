"""Detection of events in long recordings, and the windows around them.

Recordings are rows (run_id, i, time_s, channels).  Neighbouring samples meet within blocks of a run, to which the last
sample of the block before is lent.  What needs the order of a run works on a grid of hops, to which samples are
summed first, and there too within segments: rolling figures with lent neighbours, stretches and merged events by
summaries of segments, of which a run has one for thousands of rows.  Quantiles are selected by histograms.  So
neither samples nor grid rows of a run are ordered in one place.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import incident_id
from ..sources.shared import saved
from .selection import quantiles

AXES = ("ax", "ay", "az")
#: Samples of a block, and points of the grid in a segment, which one window orders; seconds of events in one.
BLOCK, SEGMENT, SPAN_S = 1 << 16, 1 << 13, 3600.0


@dataclass(frozen=True)
class Detection:
    """How events are found. ``method`` is quantile, zscore or absolute; ``threshold`` in its units; ``fs_hz`` is the
    rate of runs that bring none of their own."""

    fs_hz: float
    window_s: float = 1.0
    hop_s: float = 0.25
    method: str = "quantile"
    threshold: float = 0.8
    baseline_s: float = 30.0
    min_separation_s: float = 10.0
    min_duration_s: float = 2.0
    channel: str = "az"

    @property
    def baseline(self) -> int:
        return max(1, round(self.baseline_s / self.hop_s))


def lent(rows: DataFrame, order: str, size: Column | int, before: int, after: int) -> DataFrame:
    """``rows`` with block and own: each run is cut by ``order`` into blocks of ``size``, and the rows of a block's first
    ``after`` and last ``before`` places are lent (not own) to the block before and after."""
    block, place = F.floor(F.col(order) / size).cast("bigint"), F.col(order) % size
    to = F.array_compact(F.array(block, F.when(place >= size - before, block + 1), F.when(place < after, block - 1)))
    return rows.withColumn("__own", block).withColumn("block", F.explode(to)).withColumn("own", F.col("block") == F.col("__own")).drop("__own")


def _before(samples: DataFrame) -> DataFrame:
    """``samples`` with before, the time of sample i - 1 of the run."""
    near = Window.partitionBy("run_id", "block").orderBy("i")
    last = F.lag(F.struct("i", "time_s")).over(near)
    rows = lent(samples, "i", BLOCK, 1, 0).withColumn("before", last)
    return rows.where("own").withColumn("before", F.when(F.col("before.i") == F.col("i") - 1, F.col("before.time_s"))).drop("block", "own")


def median_rate(samples: DataFrame) -> DataFrame:
    """run_id, fs_hz: one over the median of the positive time steps; null if there are none."""
    steps = _before(samples.select("run_id", "i", "time_s")).select("run_id", (F.col("time_s") - F.col("before")).alias("dt"))
    sound = F.when((F.col("dt") > 0) & (F.col("dt") < float("inf")), F.col("dt"))  # NaN is above infinity
    usual = quantiles(saved(steps.select("run_id", sound.alias("dt")), "steps"), ["run_id"], "dt", [0.5])
    return usual.select("run_id", (1 / F.col("q0")).alias("fs_hz"))


def chosen_rate(runs: DataFrame, method: str = "median_dt", dataset_fs: float | None = None, low: float = 10.0, high: float = 200_000.0) -> DataFrame:
    """``runs`` (run_id, median_fs, meta_fs) with fs_hz and reason: an override wins, then the method's source; a
    missing or implausible rate leaves a reason and no rate."""
    source = F.lit(dataset_fs).cast("double") if dataset_fs is not None else {"metadata": F.col("meta_fs"), "fixed": F.lit(None).cast("double")}.get(method, F.col("median_fs"))
    sound = source.isNotNull() & ~F.isnan(source) & (source > 0) & source.between(low, high)
    return runs.withColumn("fs_hz", F.when(sound, source)).withColumn("reason", F.when(source.isNull(), "fs_missing").when(~sound, "fs_implausible"))


def repaired_time(samples: DataFrame, fs: Column | float) -> DataFrame:
    """time_s is kept in runs where it is finite and rises at every sample; else it is i / fs in the whole run."""
    steps, t = _before(samples.select("run_id", "i", "time_s")), F.col("time_s")
    fine = t.isNotNull() & ~F.isnan(t) & (F.abs(t) < F.lit(float("inf"))) & ((F.col("i") == 0) | (t > F.col("before")))
    usable = steps.groupBy("run_id").agg(F.bool_and(F.coalesce(fine, F.lit(False))).alias("usable"))
    fs = fs if isinstance(fs, Column) else F.lit(float(fs))
    return samples.join(usable, "run_id").withColumn("time_s", F.when(F.col("usable"), t).otherwise(F.col("i") / fs)).drop("usable")


def resampled(samples: DataFrame, fs: float, target: float | None, channels: tuple[str, ...] = AXES) -> DataFrame:
    """Channels at ``target`` Hz by linear interpolation between samples i and i + 1 of evenly sampled runs."""
    if target is None or abs(target - fs) < 1e-6:
        return samples
    runs = samples.groupBy("run_id").agg(F.count("*").alias("n"), F.min("time_s").alias("t0"), F.max("time_s").alias("t1"))
    # the grid is laid out sample by sample: each sample owns the points between itself and the next
    size = F.greatest(F.lit(2), F.bround((F.col("t1") - F.col("t0")) * target)).cast("bigint")
    own = samples.join(runs.withColumn("new_n", size), "run_id")
    low, high = F.ceil(F.col("i") * (target / fs) - 1e-9), F.ceil((F.col("i") + 1) * (target / fs) - 1e-9) - 1
    high = F.least(F.when(F.col("i") == F.col("n") - 1, F.col("new_n") - 1).otherwise(high), F.col("new_n") - 1)
    points = own.where(low <= high).withColumn("k", F.explode(F.sequence(low, high)))
    after = samples.select("run_id", (F.col("i") - 1).alias("i"), *[F.col(c).alias(f"{c}_next") for c in channels])
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("k") * (fs / target) - F.col("i")))
    both = points.join(after, ["run_id", "i"], "left").withColumn("share", share)
    return both.select("run_id", F.col("k").alias("i"), (F.col("t0") + F.col("k") / F.lit(target)).alias("time_s"), *[(F.col(c) + F.coalesce(F.col("share") * (F.col(f"{c}_next") - F.col(c)), F.lit(0.0))).alias(c) for c in channels])


def _untimed() -> Column:
    return F.col("time_s").isNull() | F.isnan("time_s") | (F.abs("time_s") == float("inf"))


def untimed(samples: DataFrame) -> DataFrame:
    """Samples without a time, for quarantine: they have no place in the order of time."""
    return samples.where(_untimed())


def in_order_of_time(samples: DataFrame, bucket_s: float = 60.0) -> DataFrame:
    """``samples`` that have a time with j, the place in the run by time_s: places within buckets of time, and the sizes
    of the buckets before added. ``untimed`` gives the others."""
    keyed = samples.where(~_untimed()).withColumn("__b", F.floor(F.col("time_s") / bucket_s))
    sizes = keyed.groupBy("run_id", "__b").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("run_id").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("run_id", "__b", F.coalesce(before, F.lit(0)).alias("__start"))
    inner = F.row_number().over(Window.partitionBy("run_id", "__b").orderBy("time_s", "i")) - 1
    return keyed.withColumn("__in", inner).join(starts, ["run_id", "__b"]).withColumn("j", F.col("__start") + F.col("__in")).drop("__b", "__in", "__start")


def resampled_uneven(samples: DataFrame, target: float, channels: tuple[str, ...] = AXES) -> DataFrame:
    """As ``resampled`` for runs of uneven steps: each pair of neighbouring samples fills the points between."""
    numbered = in_order_of_time(samples)
    after = numbered.select("run_id", (F.col("j") - 1).alias("j"), F.col("time_s").alias("t_next"), *[F.col(c).alias(f"{c}_next") for c in channels])
    ahead = numbered.select("run_id", "j", "time_s", *channels).join(after, ["run_id", "j"], "left")
    runs = samples.groupBy("run_id").agg(F.min("time_s").alias("t0"), F.max("time_s").alias("t1"))
    own = ahead.join(runs, "run_id").withColumn("new_n", F.greatest(F.lit(2), F.bround((F.col("t1") - F.col("t0")) * target)).cast("bigint"))
    low = F.ceil((F.col("time_s") - F.col("t0")) * target - 1e-9)
    high = F.least(F.coalesce(F.ceil((F.col("t_next") - F.col("t0")) * target - 1e-9) - 1, F.col("new_n") - 1), F.col("new_n") - 1)
    points = own.where(low <= high).withColumn("k", F.explode(F.sequence(low, high)))
    at = F.col("t0") + F.col("k") / F.lit(target)
    share = F.coalesce(F.try_divide(at - F.col("time_s"), F.col("t_next") - F.col("time_s")), F.lit(0.0))
    return points.select("run_id", F.col("k").alias("i"), at.alias("time_s"), *[(F.col(c) + F.coalesce(share * (F.col(f"{c}_next") - F.col(c)), F.lit(0.0))).alias(c) for c in channels])


def _value(c: str) -> Column:
    return F.when(~F.isnan(c), F.col(c))


def usable_channel(samples: DataFrame, channel: str = "az") -> DataFrame:
    """run_id, channel: the wanted channel if the run has values of it, else the first of az, ay, ax that it has;
    runs without any axis are left out."""
    return _channels(samples, channel).select("run_id", "channel").where("channel IS NOT NULL")


def _channels(samples: DataFrame, channel: str, more: Sequence[Column] = ()) -> DataFrame:
    """run_id, channel (as ``usable_channel``), how many values of each axis there are, and ``more`` of each run."""
    has = samples.groupBy("run_id").agg(*[F.count(_value(a)).alias(f"n_{a}") for a in AXES], *more)
    wanted = F.col(f"n_{channel}") > 0 if channel in AXES else sum((F.col(f"n_{a}") for a in AXES), F.lit(0)) > 0
    return has.withColumn("channel", F.coalesce(F.when(wanted, F.lit(channel)), *[F.when(F.col(f"n_{a}") > 0, F.lit(a)) for a in ("az", "ay", "ax")]))


def energy() -> Column:
    """The value of the run's channel, or the magnitude over the axes that the run has (null where one of these is)."""
    squares = [F.when(F.col(f"n_{a}") > 0, _value(a) * _value(a)).otherwise(F.lit(0.0)) for a in AXES]
    return F.when(F.col("channel") == "magnitude", F.sqrt(sum(squares[1:], squares[0]))).otherwise(F.coalesce(*[F.when(F.col("channel") == a, _value(a)) for a in AXES]))


def _means(channel: str) -> tuple[list[Column], Column]:
    """Sums over a run, and from them the mean of its energy: that of its channel, or of the magnitude over its axes."""
    if channel != "magnitude":
        of = [F.when(F.col("channel") == a, F.try_divide(F.col(f"sum_{a}"), F.col(f"n_{a}"))) for a in AXES]
        return [F.sum(_value(a)).alias(f"sum_{a}") for a in AXES], F.coalesce(*of, F.lit(0.0))
    sums, of = [], []
    for k in range(1, 8):  # which axes a run has shows only when it is read: sums for each set of them
        axes = [a for j, a in enumerate(AXES) if k >> j & 1]
        size = F.sqrt(sum((_value(a) * _value(a) for a in axes[1:]), _value(axes[0]) * _value(axes[0])))
        sums += [F.sum(size).alias(f"sum_{k}"), F.count(size).alias(f"count_{k}")]
        has = [(F.col(f"n_{a}") > 0) == (a in axes) for a in AXES]
        of.append(F.when((F.col("channel") == "magnitude") & has[0] & has[1] & has[2], F.try_divide(F.col(f"sum_{k}"), F.col(f"count_{k}"))))
    return sums, F.coalesce(*of, F.lit(0.0))


def run_plan(samples: DataFrame, how: Detection, rates: DataFrame | None = None) -> DataFrame:
    """A row for each run that can be searched: channel, the mean of its energy, fs_hz, samples of its window and hop, and
    their greatest common divisor, by one pass over the samples. ``rates``: run_id, fs_hz; runs without a rate there are
    left out."""
    sums, mean = _means(how.channel)
    runs = _channels(samples, how.channel, sums).where("channel IS NOT NULL").withColumn("mean", mean)
    runs = runs.select("run_id", "channel", *[f"n_{a}" for a in AXES], "mean")
    runs = runs.withColumn("fs_hz", F.lit(float(how.fs_hz))) if rates is None else runs.join(rates.select("run_id", "fs_hz").where("fs_hz IS NOT NULL"), "run_id")
    size = lambda seconds: F.greatest(F.lit(1), F.bround(F.col("fs_hz") * float(seconds))).cast("bigint")
    runs = runs.withColumn("window", size(how.window_s)).withColumn("hop", size(how.hop_s))
    pair = F.struct(F.col("window").alias("a"), F.col("hop").alias("b"))
    euclid = F.aggregate(F.sequence(F.lit(1), F.lit(92)), pair, lambda x, _: F.when(x["b"] == 0, x).otherwise(F.struct(x["b"].alias("a"), (x["a"] % F.greatest(x["b"], F.lit(1))).alias("b"))))
    return runs.withColumn("step", euclid["a"])


def centred(samples: DataFrame, runs: DataFrame) -> DataFrame:
    """run_id, i, x, and the columns of ``runs``: energy with gaps filled by the run's mean, less that mean."""
    told = samples.select("run_id", "i", *AXES).join(runs, "run_id")
    return told.withColumn("x", F.coalesce(energy(), "mean") - F.col("mean")).drop(*AXES)


def sliding_rms(samples: DataFrame, how: Detection, rates: DataFrame | None = None) -> DataFrame:
    """run_id, k, t_s, rms on each run's own hop grid; only windows that lie within the run.

    Samples are summed to buckets of the common divisor of window and hop; each bucket then counts in every window
    that it lies in, so a run of any length and rate is sums by equal keys.  The plan of the runs is written first, so
    Spark knows its size: where that is small, samples stay where they are.
    """
    by = ["run_id", "window", "hop", "step", "fs_hz"]
    rows = centred(samples, saved(run_plan(samples, how, rates), "runs"))
    sums = rows.groupBy(*by, F.floor(F.col("i") / F.col("step")).alias("b")).agg(F.sum(F.col("x") * F.col("x")).alias("e"), F.count("*").alias("n"))
    start = F.col("b") * F.col("step")
    first = F.greatest(F.lit(0), F.ceil((start + F.col("step") - F.col("window")) / F.col("hop"))).cast("bigint")
    last = F.floor(start / F.col("hop")).cast("bigint")
    # a hop longer than the window leaves buckets that no window holds
    inside = sums.where(first <= last).withColumn("k", F.explode(F.sequence(first, last)))
    grid = inside.groupBy(*by, "k").agg(F.sum("e").alias("e"), F.sum("n").alias("n")).where("n = window")
    middle = (F.col("k") * F.col("hop") + F.floor(F.col("window") / 2)) / F.col("fs_hz")
    return grid.select("run_id", "k", middle.alias("t_s"), F.sqrt(F.col("e") / F.col("window")).alias("rms"))


def scored(grid: DataFrame, how: Detection) -> DataFrame:
    """The grid with stat and threshold by the method. It is read more than once: give one that is written."""
    if how.method == "absolute":
        return grid.withColumn("stat", F.col("rms")).withColumn("threshold", F.lit(float(how.threshold)))
    if how.method == "quantile":
        cut = quantiles(grid, ["run_id"], "rms", [how.threshold]).withColumnRenamed("q0", "threshold")
        return grid.join(saved(cut, "thresholds"), "run_id").withColumn("stat", F.col("rms"))
    if how.method != "zscore":
        raise ValueError(f"unknown method {how.method}")
    n = how.baseline
    frame = Window.partitionBy("run_id", "block").orderBy("k").rowsBetween(-(n // 2), (n - 1) // 2)
    spread = grid.groupBy("run_id").agg(F.stddev_pop("rms").alias("run_sd"))
    whole = quantiles(grid, ["run_id"], "rms", [0.5, 0.1]).join(spread, "run_id").select("run_id", ((F.col("q0") - F.col("q1")) / 1.2816).alias("global_sd"), "run_sd")
    rows = lent(grid, "k", max(SEGMENT, 4 * n), n // 2, (n - 1) // 2)
    local = rows.withColumn("median", F.percentile("rms", 0.5).over(frame)).withColumn("q10", F.percentile("rms", 0.1).over(frame)).where("own").drop("block", "own")
    local = local.join(saved(whole, "run-spreads"), "run_id")
    positive = lambda x: F.when((x > 0) & ~F.isnan(x), x)
    sd = F.coalesce(positive((F.col("median") - F.col("q10")) / 1.2816), positive(F.col("global_sd")), positive(F.col("run_sd")), F.lit(1.0))
    return local.withColumn("stat", (F.col("rms") - F.col("median")) / sd).withColumn("threshold", F.lit(float(how.threshold))).drop("median", "q10", "global_sd", "run_sd")


def islands(stats: DataFrame) -> DataFrame:
    """run_id, t_event_s, t_start_s, t_end_s, score of each stretch of grid points over the threshold.

    Stretches are found within segments; only those that touch a segment's end, two a segment at most, are ordered
    over the run and joined where they meet.
    """
    over = stats.where(F.col("stat") > F.col("threshold")).withColumn("segment", F.floor(F.col("k") / SEGMENT))
    place = F.row_number().over(Window.partitionBy("run_id", "segment").orderBy("k"))
    peak = F.max_by(F.struct("t_s", "stat", "k"), F.struct(F.col("stat"), -F.col("k")))
    parts = over.withColumn("island", F.col("k") - place).groupBy("run_id", "segment", "island").agg(peak.alias("peak"), F.min("t_s").alias("t_start_s"), F.max("t_s").alias("t_end_s"), F.min("k").alias("first"), F.max("k").alias("last"))
    parts = saved(parts.drop("segment", "island"), "stretches")
    touching = (F.col("first") % SEGMENT == 0) | (F.col("last") % SEGMENT == SEGMENT - 1)
    order = Window.partitionBy("run_id").orderBy("first")
    begins = F.when(F.lag("last").over(order) == F.col("first") - 1, 0).otherwise(1)
    joined = parts.where(touching).withColumn("begins", begins).withColumn("g", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    best = F.max_by("peak", F.struct(F.col("peak.stat"), -F.col("peak.k")))
    joined = joined.groupBy("run_id", "g").agg(best.alias("peak"), F.min("t_start_s").alias("t_start_s"), F.max("t_end_s").alias("t_end_s"))
    columns = ["run_id", F.col("peak.t_s").alias("t_event_s"), "t_start_s", "t_end_s", F.col("peak.stat").alias("score")]
    return parts.where(~touching).select(*columns).unionByName(joined.select(*columns))


def merged(events: DataFrame, min_separation_s: float) -> DataFrame:
    """Events closer than the separation are one; the higher score gives its peak, the earlier among equals.

    Events are ordered within spans of time; of each span only its latest end and its number of beginnings are carried
    on, by a scan of the spans' summaries.
    """
    rows = saved(events.withColumn("span", F.floor(F.col("t_start_s") / SPAN_S)), "events-apart")
    inside = Window.partitionBy("run_id", "span").orderBy("t_start_s", "t_end_s", "t_event_s")
    earlier = Window.partitionBy("run_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy("run_id", "span").agg(F.max("t_end_s").alias("end")).withColumn("end", F.max("end").over(earlier))
    last = F.greatest(F.max("t_end_s").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.col("end"))
    begun = rows.join(ends, ["run_id", "span"]).withColumn("before", last).withColumn("begins", F.when(F.col("before").isNull() | (F.col("t_start_s") - F.col("before") >= min_separation_s), 1).otherwise(0))
    begun = saved(begun.drop("end", "before"), "events-begun")
    counts = begun.groupBy("run_id", "span").agg(F.sum("begins").alias("n")).withColumn("n", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    grouped = begun.join(counts, ["run_id", "span"]).withColumn("g", F.col("n") + F.sum("begins").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    peak = F.max_by("t_event_s", F.struct(F.col("score"), -F.col("t_start_s")))
    return grouped.groupBy("run_id", "g").agg(peak.alias("t_event_s"), F.min("t_start_s").alias("t_start_s"), F.max("t_end_s").alias("t_end_s"), F.max("score").alias("score")).drop("g")


def detected(samples: DataFrame, how: Detection, rates: DataFrame | None = None) -> DataFrame:
    """Events of all runs, each at its own rate (``rates``: run_id, fs_hz; ``how.fs_hz`` without) and by the channel
    that it has."""
    found = merged(islands(scored(saved(sliding_rms(samples, how, rates), "grid"), how)), how.min_separation_s)
    return found.where(F.lit(how.min_duration_s <= 0) | (F.col("t_end_s") - F.col("t_start_s") >= how.min_duration_s))


def labelled(labels: DataFrame, how: Detection) -> DataFrame:
    """Events from intervals that people marked (run_id, start_s, end_s), in place of detection: merged and long enough as
    detected ones, with their middle as the event and a score of 1. Intervals without a bound, or that end before they
    start, are left out."""
    sound = labels.where("start_s <= end_s").where(~F.isnan("start_s") & (F.abs("start_s") < float("inf")) & ~F.isnan("end_s") & (F.abs("end_s") < float("inf")))
    marked = sound.select("run_id", F.lit(0.0).alias("t_event_s"), F.col("start_s").alias("t_start_s"), F.col("end_s").alias("t_end_s"), F.lit(1.0).alias("score"))
    found = merged(marked, how.min_separation_s).withColumn("t_event_s", (F.col("t_start_s") + F.col("t_end_s")) / 2)
    return found.where(F.lit(how.min_duration_s <= 0) | (F.col("t_end_s") - F.col("t_start_s") >= how.min_duration_s))


def capped(events: DataFrame, most: int) -> DataFrame:
    """The first events of each run, by time: the cap that a user asks for."""
    return events.withColumn("nth", F.row_number().over(Window.partitionBy("run_id").orderBy("t_event_s"))).where(F.col("nth") <= most).drop("nth")


def carved(samples: DataFrame, events: DataFrame, pre_s: float, post_s: float, drop_partial: bool = True, dataset: str = "recordings") -> DataFrame:
    """incident_id, run_id, event columns and the samples from ``pre_s`` before to ``post_s`` after each event, both
    ends included, with t_rel_s. Samples and events meet in buckets of one window's length, so the samples of a
    long run spread over many tasks."""
    reach = pre_s + post_s
    bounds = samples.groupBy("run_id").agg(F.min("time_s").alias("run_start_s"), F.max("time_s").alias("run_end_s"))
    windows = events.join(bounds, "run_id").withColumn("w0", F.col("t_event_s") - pre_s).withColumn("w1", F.col("t_event_s") + post_s)
    partial = (F.col("w0") < F.col("run_start_s") - 1e-9) | (F.col("w1") > F.col("run_end_s") + 1e-9)
    windows = windows.withColumn("is_partial", partial).drop("run_start_s", "run_end_s")
    windows = windows.where("NOT is_partial") if drop_partial else windows
    windows = windows.withColumn("incident_id", incident_id(F.lit(dataset), F.col("run_id"), F.col("t_event_s")))
    spread = windows.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("w0") / reach), F.floor(F.col("w1") / reach))))
    inside = samples.withColumn("bucket", F.floor(F.col("time_s") / reach)).join(spread, ["run_id", "bucket"]).where("time_s BETWEEN w0 AND w1")
    return inside.withColumn("t_rel_s", F.col("time_s") - F.col("t_event_s")).drop("bucket", "w0", "w1")


def window_index(waveforms: DataFrame, fs_hz: float | DataFrame, dataset: str = "recordings", machine: str = "mill", failure: str = "unknown", with_amplitude: bool = False) -> DataFrame:
    """One row for each window: its bounds, number of samples and the fixed columns of the index; its amplitude too,
    in the same pass, if asked. ``fs_hz``: the rate of all runs, or a table run_id, fs_hz."""
    keys = ["incident_id", "run_id", "t_event_s", "t_start_s", "t_end_s", "score"]
    out = waveforms.groupBy(*keys).agg(F.min("time_s").alias("window_start_s"), F.max("time_s").alias("window_end_s"), F.count("*").alias("n_samples"), *([_amplitude()] if with_amplitude else []))
    out = out.withColumn("source_dataset", F.lit(dataset)).withColumn("machine_family", F.lit(machine)).withColumn("failure_family", F.lit(failure))
    return out.join(fs_hz.select("run_id", "fs_hz"), "run_id", "left") if isinstance(fs_hz, DataFrame) else out.withColumn("fs_hz", F.lit(float(fs_hz)))


def with_spans(index: DataFrame, pad_s: float = 0.5, most: int = 5) -> DataFrame:
    """sensor_relevant_spans: the event and its padding relative to the peak, within the window."""
    event = F.col("t_event_s")
    start = F.greatest(F.col("t_start_s") - event - pad_s, F.col("window_start_s") - event)
    end = F.least(F.col("t_end_s") - event + pad_s, F.col("window_end_s") - event)
    span = F.array(F.struct(start.alias("start_s"), end.alias("end_s")))
    return index.withColumn("sensor_relevant_spans", F.slice(F.when(end >= start, span).otherwise(F.array().cast("array<struct<start_s:double,end_s:double>>")), 1, most))


def with_energy_spans(index: DataFrame, grid: DataFrame, window_s: float, pad_s: float = 0.5, most: int = 5) -> DataFrame:
    """sensor_relevant_spans: up to ``most`` windows of the RMS grid with the most energy, none of which overlap, padded,
    cut to the incident's window, relative to the peak and in order of time. Among equals the earlier comes first.

    Grid points and incidents meet in buckets of time; an incident has as many points as its window has hops.
    """
    spread = F.greatest(F.lit(1e-9), F.lit(float(window_s)))
    reach = 60.0
    keys = index.select("incident_id", "run_id", "window_start_s", "window_end_s").withColumn("bucket", F.explode(F.sequence(F.floor(F.col("window_start_s") / reach), F.floor(F.col("window_end_s") / reach))))
    inside = grid.withColumn("bucket", F.floor(F.col("t_s") / reach)).join(keys, ["run_id", "bucket"]).where("t_s BETWEEN window_start_s AND window_end_s")
    # RMS falls, then time rises, in an array sorted upwards
    points = inside.groupBy("incident_id").agg(F.sort_array(F.collect_list(F.struct((-F.round("rms", 9)).alias("less"), "t_s"))).alias("points"))
    none = F.array().cast("array<double>")
    fits = lambda kept, p: (F.size(kept) < most) & F.forall(kept, lambda t: F.round(F.abs(t - p["t_s"]), 9) >= spread)
    best = F.aggregate("points", none, lambda kept, p: F.when(fits(kept, p), F.concat(kept, F.array(p["t_s"]))).otherwise(kept))
    event, half = F.col("t_event_s"), window_s / 2 + pad_s
    span = lambda t: F.struct((F.greatest(t - half, F.col("window_start_s")) - event).alias("start_s"), (F.least(t + half, F.col("window_end_s")) - event).alias("end_s"))
    told = index.join(points.select("incident_id", F.array_sort(best).alias("best")), "incident_id", "left")
    return told.withColumn("sensor_relevant_spans", F.transform(F.coalesce("best", none), span)).drop("best")


def _amplitude() -> Column:
    def largest(name: str) -> Column:
        x = F.when(~F.isnan(name), F.col(name))
        return F.greatest(F.max(x) - F.avg(x), F.avg(x) - F.min(x))

    return F.coalesce(*[largest(c) for c in ("az", "ay", "ax")]).alias("amplitude")


def amplitudes(waveforms: DataFrame) -> DataFrame:
    """incident_id, amplitude: the largest distance from the window's mean in the first of az, ay, ax that has
    values."""
    return waveforms.groupBy("incident_id").agg(_amplitude())


def total_hours(index: DataFrame) -> DataFrame:
    return index.agg((F.sum(F.greatest(F.col("window_end_s") - F.col("window_start_s"), F.lit(0.0))) / 3600).alias("total_incident_hours"))
