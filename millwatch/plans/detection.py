"""Queries over ``events`` taken for recordings: a run for each event_type, sampled at 100 Hz in order of time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import number, severity, stable_hash
from ..operators import intervals
from ..operators import timeseries as ts
from ..operators.contracts import renamed
from ..operators.selection import quantiles
from ..sources import readers, sinks
from ..sources.shared import new_path, saved

FS = 100.0
HOW = ts.Detection(fs_hz=FS, window_s=0.5, hop_s=0.1, method="quantile", threshold=0.8, baseline_s=5.0, min_separation_s=1.0, min_duration_s=0.1)
PRE, POST = 3.0, 2.0


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = readers.numbered_runs(spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("event_type"), F.col("ts"), F.col("event_id"))
    rows = rows.select("run_id", "i", (F.col("i") / F.lit(FS)).alias("t"), "value", "user_id", F.get_json_object("props", "$.k").alias("k"))
    return renamed(rows, {"t": "time_s", "value": "az", "user_id": "ay", "k": "ax"}, ["run_id", "i"])


def events(spark: SparkSession, sf_dir: str, method: str = "quantile", threshold: float = 0.8) -> DataFrame:
    how = ts.Detection(**{**HOW.__dict__, "method": method, "threshold": threshold})
    return ts.detected(saved(samples(spark, sf_dir), "samples"), how)


def carved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples are numbered once, for the search of events and for the windows around them."""
    rows = saved(samples(spark, sf_dir), "samples")
    return ts.carved(rows, saved(ts.detected(rows, HOW), "events"), PRE, POST)


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ts.with_spans(ts.window_index(carved(spark, sf_dir), FS))


#: Where runs differ in rate, steps of the grid fall beside these borders, however a rate is rounded.
MIXED = ts.Detection(**{**HOW.__dict__, "min_separation_s": 0.95, "min_duration_s": 0.15})


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of runs at different rates, some of which lack axes."""
    rows = samples(spark, sf_dir).withColumn("time_s", F.col("i") / (F.lit(FS) + 10 * F.length("run_id")))
    return rows.withColumn("az", F.when(F.col("run_id") != "click", F.col("az"))).withColumn("ax", F.when(~F.col("run_id").isin("click", "view"), F.col("ax")))


def events_mixed_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run at its own estimated rate, by the channel that it has."""
    rows = saved(mixed(spark, sf_dir), "samples")
    rates = ts.chosen_rate(ts.median_rate(rows).withColumnRenamed("fs_hz", "median_fs").withColumn("meta_fs", F.lit(None).cast("double")))
    return rounded(ts.detected(rows, MIXED, saved(rates, "rates")))


def magnitude_of_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The magnitude over the axes that a run has."""
    return rounded(ts.sliding_rms(saved(mixed(spark, sf_dir), "samples"), ts.Detection(**{**HOW.__dict__, "channel": "magnitude"})))


def csv_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings written as CSV, a file for each run, and read again."""
    path = new_path(spark, "csv-runs")
    rows = samples(spark, sf_dir).select("i", "az", F.col("run_id").alias("run"), F.lit("good").alias("quality"))
    rows.repartition("run").sortWithinPartitions("run", "i").select("az", "run", "quality").write.partitionBy("run", "quality").option("header", True).csv(path)
    back = readers.read_runs(spark, path, "az double")
    return rounded(back.select(F.regexp_extract("run_id", "run=([^/]+)/", 1).alias("run"), F.regexp_extract("run_id", "/quality=([^/]+)/", 1).alias("quality"), "i", "az"))


def _mixed_headers(spark: SparkSession, sf_dir: str) -> str:
    """A CSV file for each run: its columns in another order, with one more, or without one; those of errors end with a
    row of too many fields."""
    path = new_path(spark, "csv-headers")
    rows = samples(spark, sf_dir).select("run_id", F.col("i"), F.col("i").cast("string").alias("n"), *[F.col(c).cast("string").alias(c) for c in ("time_s", "ax", "ay", "az")])
    size = F.length("run_id") % 3
    layout = lambda f: F.when(size == 0, F.array(*map(f, ("az", "ax", "time_s", "ay")))).when(size == 1, F.array(*map(f, ("n", "time_s", "ax", "ay", "az")))).otherwise(F.array(*map(f, ("time_s", "az", "ay"))))
    line = lambda f: F.array_join(layout(f), ",", "")
    lines = rows.select("run_id", "i", line(F.col).alias("line")).unionAll(rows.groupBy("run_id").agg(F.lit(-1).cast("long").alias("i")).select("run_id", "i", line(F.lit)))
    last = rows.where("run_id = 'error'").groupBy("run_id").agg((F.max("i") + 1).alias("i")).withColumn("line", F.lit("1,2,3,4,5,6,7"))
    spread = lines.unionAll(last).repartition("run_id").sortWithinPartitions("run_id", "i")
    spread.select("line", F.col("run_id").alias("run")).write.partitionBy("run").option("sep", "\x01").csv(path)  # commas are text here
    return path


AXIS_SCHEMA = "time_s double, ax double, ay double, az double"


def csv_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns by name from files whose headers differ."""
    back = readers.read_runs(spark, _mixed_headers(spark, sf_dir), AXIS_SCHEMA)
    return rounded(back.select(F.regexp_extract("run_id", "run=([^/]+)/", 1).alias("run"), "i", "time_s", "ax", "ay", "az"))


def csv_unread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are left out as a whole."""
    path = _mixed_headers(spark, sf_dir)
    return readers.unread_runs(spark, path, readers.read_runs(spark, path, AXIS_SCHEMA)).select(F.regexp_extract("path", "run=([^/]+)/", 1).alias("run"))


def waveform_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows written as waveforms and read again."""
    path = new_path(spark, "waveforms")
    sinks.write_waveforms(carved(spark, sf_dir).withColumn("source_dataset", F.lit("recordings")), path)
    back = spark.read.parquet(path)
    return rounded(back.groupBy("source_dataset", "incident_id").agg(F.count("*").alias("n"), F.min("t_rel_s").alias("from_s"), F.max("t_rel_s").alias("to_s"), F.sum("az").alias("sum_az")))


def waveform_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waveforms written, then written again: all of them, and some with other values."""
    path, rows = new_path(spark, "waveforms"), saved(carved(spark, sf_dir).withColumn("source_dataset", F.lit("recordings")), "carved")
    sinks.write_waveforms(rows, path)
    sinks.write_waveforms(rows, path)
    sinks.write_waveforms(rows.where("run_id = 'click'").withColumn("az", F.lit(1.0)), path)
    back = spark.read.parquet(path)
    return rounded(back.groupBy("source_dataset", "incident_id").agg(F.count("*").alias("n"), F.sum("az").alias("sum_az")))


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals around the highest values, taken for what people marked; some overlap, some run backwards or lack an end."""
    i, t = F.col("i"), F.col("i") / F.lit(FS)
    rows = samples(spark, sf_dir).where("az > 250")
    return rows.select("run_id", (t - 0.4).alias("start_s"), F.when(i % 11 == 0, t - 0.5).when(i % 13 != 0, t + 0.6).alias("end_s"))


def events_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ts.labelled(_marked(spark, sf_dir), HOW))


def detection_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detected events against marked intervals."""
    bounds = lambda rows: rows.select("run_id", F.round("t_start_s", 6).alias("start_s"), F.round("t_end_s", 6).alias("end_s"))
    return rounded(intervals.graded(bounds(events(spark, sf_dir)), bounds(ts.labelled(_marked(spark, sf_dir), HOW))))


def evidence_spans_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of the most energy in each window."""
    rows = saved(samples(spark, sf_dir), "samples")
    grid = saved(ts.sliding_rms(rows, HOW), "grid")
    found = saved(ts.detected(rows, HOW), "events")
    told = ts.with_energy_spans(saved(ts.window_index(ts.carved(rows, found, PRE, POST), FS), "window-index"), grid, HOW.window_s, 0.1, 3)
    return rounded(told.select("incident_id", F.explode("sensor_relevant_spans").alias("s")).select("incident_id", "s.start_s", "s.end_s"))


def dataset_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each dataset, counted as the union is written, and which are disabled or unknown."""
    datasets = {"events": samples(spark, sf_dir).drop("time_s"), "arrays": array_samples(spark, sf_dir), "off": samples(spark, sf_dir)}
    asked = {"off": False, "nowhere": True}
    seen = Observation()
    union = readers.union_datasets(datasets, asked)
    union.observe(seen, *[F.count_if(F.col("source_dataset") == name).alias(name) for name in datasets]).write.parquet(new_path(spark, "union"))
    return readers.dataset_counters(spark, datasets, asked, seen.get)


def incremental_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs whose last sample is newer than what was built of them."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.col("event_type").alias("incident_id")).agg(F.max("ts").alias("stamp"))
    built = rows.where("incident_id <> 'view'").withColumn("stamp", F.when(F.col("incident_id") == "click", F.col("stamp") - F.expr("INTERVAL 1 SECOND")).otherwise(F.col("stamp")))
    return sinks.not_yet_built(rows, built, stamp="stamp").select("incident_id")


def samples_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(samples(spark, sf_dir))


def numeric_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).when(F.col("o_orderkey") % 3 == 1, F.lit("NaN")).otherwise(F.col("o_totalprice").cast("string"))
    return rows.select("o_orderkey", F.round(number(text), 6).alias("x"))


def time_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir)
    t = F.when(F.col("run_id") == "click", (F.col("i") * 7919 % 100) / F.lit(FS)).otherwise(F.col("i") / F.lit(FS) + 0.5)
    return rounded(ts.repaired_time(rows.withColumn("time_s", t), FS).select("run_id", "i", "time_s"))


def fs_median_dt(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir).withColumn("time_s", F.col("i") / (F.lit(FS) + 10 * F.length("run_id")))
    rates = ts.median_rate(rows).withColumnRenamed("fs_hz", "median_fs").withColumn("meta_fs", F.lit(None).cast("double"))
    return rounded(ts.chosen_rate(rates, low=10, high=155).select("run_id", "fs_hz", "reason"))


def channel_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir)
    lacking = rows.withColumn("az", F.when(F.col("run_id") != "click", F.col("az"))).withColumn("ay", F.when(~F.col("run_id").isin("click", "view"), F.col("ay")))
    return ts.usable_channel(lacking.withColumn("az", F.when(F.col("run_id") != "error", F.col("az"))))


def resample_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ts.resampled(samples(spark, sf_dir), FS, 40.0))


def resample_uneven(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir).withColumn("time_s", F.col("i") / F.lit(FS) + F.col("i") % 3 / 1000)
    return rounded(ts.resampled_uneven(rows, 40.0))


def quality_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/part.parquet")
    path = F.concat(F.lit("file:/runs/"), F.lower("p_type"), F.lit("/"), F.element_at(F.array(*map(F.lit, ("good", "BAD", "ok", "nok", "other"))), F.col("p_size") % 5 + 1), F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".csv"))
    return rows.select("p_partkey", readers.quality_of(path).alias("quality"))


def sliding_rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ts.sliding_rms(saved(samples(spark, sf_dir), "samples"), HOW))


def magnitude_rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ts.sliding_rms(saved(samples(spark, sf_dir), "samples"), ts.Detection(**{**HOW.__dict__, "channel": "magnitude"})))


def events_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(events(spark, sf_dir))


def events_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(events(spark, sf_dir, "zscore", 3.0))


def events_absolute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(events(spark, sf_dir, "absolute", 50.0))


def event_cap_per_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ts.capped(events(spark, sf_dir), 2))


def carve_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(carved(spark, sf_dir).select("incident_id", "run_id", "i", "time_s", "t_rel_s", "ax", "ay", "az"))


def window_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(index(spark, sf_dir).select("incident_id", "run_id", "t_event_s", "window_start_s", "window_end_s", "n_samples", "fs_hz"))


def evidence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = index(spark, sf_dir).select("incident_id", F.explode("sensor_relevant_spans").alias("s"))
    return rounded(spans.select("incident_id", "s.start_s", "s.end_s"))


def incident_amplitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ts.amplitudes(carved(spark, sf_dir)))


def with_severity(amplitudes: DataFrame) -> DataFrame:
    """A cut may be one of the amplitudes: rounded, it stays equal to it however sums are ordered."""
    amplitudes = amplitudes.withColumn("amplitude", F.round("amplitude", 9))
    cuts = saved(quantiles(amplitudes.withColumn("all", F.lit(0)), ["all"], "amplitude", [1 / 3, 2 / 3]), "cuts")
    return amplitudes.withColumn("severity_label", severity(F.col("amplitude"), cuts.select("q0").scalar(), cuts.select("q1").scalar()))


def incident_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(with_severity(saved(ts.amplitudes(carved(spark, sf_dir)), "amplitudes")))


def incident_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ts.total_hours(index(spark, sf_dir)))


def array_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    points = F.transform(F.sequence(F.lit(0), F.floor(F.size("embedding") / 3).cast("int") - 1), lambda k: F.slice("embedding", k * 3 + 1, 3))
    return readers.array_runs(rows.select("vec_id", points.alias("data")), "vec_id", "data")


def array_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(array_samples(spark, sf_dir))


def dataset_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = readers.union_datasets({"events": samples(spark, sf_dir).drop("time_s"), "arrays": array_samples(spark, sf_dir), "off": samples(spark, sf_dir)}, {"off": False})
    return rounded(both.groupBy("source_dataset", "run_id").agg(F.count("*").alias("n"), F.sum("az").alias("sum_az")))


def unit_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.first_units(samples(spark, sf_dir), "run_id", 2).groupBy("run_id").agg(F.count("*").alias("n"))


def incremental_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = ts.window_index(carved(spark, sf_dir), FS).select("incident_id", "run_id")
    return sinks.not_yet_built(wanted, wanted.where("run_id IN ('click', 'view')"))


def hashed_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return rows.select("o_orderkey", stable_hash(F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_orderkey").cast("string")).alias("h"))


NORM = """samples AS (SELECT event_type AS run_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i, (props->>'k')::DOUBLE AS ax, user_id::DOUBLE AS ay, value::DOUBLE AS az FROM events),
norm AS (SELECT run_id, i, i / 100::DOUBLE AS time_s, ax, ay, az FROM samples)"""


def _rms(x: str = "az") -> str:
    return f"""{NORM},
chan AS (SELECT run_id, i, {x} AS v FROM norm),
means AS (SELECT run_id, coalesce(avg(v), 0) AS m FROM chan GROUP BY run_id),
cen AS (SELECT c.run_id, i, coalesce(v, m) - m AS x FROM chan c JOIN means USING (run_id)),
slid AS (SELECT run_id, i, sum(x * x) OVER w AS e, count(*) OVER w AS c FROM cen WINDOW w AS (PARTITION BY run_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
grid AS (SELECT run_id, i // 10 AS k, (i + 25) / 100::DOUBLE AS t_s, sqrt(e / 50) AS rms FROM slid WHERE c = 50 AND i % 10 = 0)"""


_STAT = {
    "quantile": "stat AS (SELECT g.run_id, k, t_s, rms AS stat, thr FROM grid g JOIN (SELECT run_id, quantile_cont(rms, 0.8) AS thr FROM grid GROUP BY run_id) USING (run_id))",
    "absolute": "stat AS (SELECT run_id, k, t_s, rms AS stat, 50.0::DOUBLE AS thr FROM grid)",
    "zscore": """run_wide AS (SELECT run_id, (quantile_cont(rms, 0.5) - quantile_cont(rms, 0.1)) / 1.2816::DOUBLE AS gsd, stddev_pop(rms) AS psd FROM grid GROUP BY run_id),
loc AS (SELECT run_id, k, t_s, rms, quantile_cont(rms, 0.5) OVER w AS med, quantile_cont(rms, 0.1) OVER w AS q10 FROM grid WINDOW w AS (PARTITION BY run_id ORDER BY k ROWS BETWEEN 25 PRECEDING AND 24 FOLLOWING)),
stat AS (SELECT l.run_id, k, t_s, (rms - med) / CASE WHEN (med - q10) / 1.2816::DOUBLE > 0 THEN (med - q10) / 1.2816::DOUBLE WHEN gsd > 0 THEN gsd WHEN psd > 0 THEN psd ELSE 1 END AS stat, 3.0::DOUBLE AS thr FROM loc l JOIN run_wide USING (run_id))""",
}


_MIXED = f"""{NORM},
mixed AS (SELECT run_id, i, 100 + 10 * length(run_id) AS fs, CASE WHEN run_id NOT IN ('click', 'view') THEN ax END AS ax, ay, CASE WHEN run_id <> 'click' THEN az END AS az FROM norm)"""


def _windowed(x: str, fs: str) -> str:
    """The grid of each run by lists: the squares of its samples, and sums of slices of them."""
    return f"""{_MIXED},
vals AS (SELECT run_id, i, {fs}::DOUBLE AS fs, {x} AS v FROM mixed),
lists AS (SELECT run_id, any_value(fs) AS fs, round(any_value(fs) * 0.5::DOUBLE)::BIGINT AS w, round(any_value(fs) * 0.1::DOUBLE)::BIGINT AS h, list((v - m) * (v - m) ORDER BY i) AS xs FROM vals JOIN (SELECT run_id, avg(v) AS m FROM vals GROUP BY run_id) USING (run_id) GROUP BY run_id),
ks AS (SELECT *, unnest(range(0, greatest((len(xs) - w) // h + 1, 0))) AS k FROM lists),
grid AS (SELECT run_id, k, (k * h + w // 2) / fs AS t_s, sqrt(list_sum(xs[k * h + 1 : k * h + w]) / w) AS rms FROM ks)"""


def _found(grid: str, stat: str, apart: float, least: float) -> str:
    return f"""{grid},
{stat},
over_thr AS (SELECT *, k - row_number() OVER (PARTITION BY run_id ORDER BY k) AS isl FROM stat WHERE stat > thr),
ev0 AS (SELECT run_id, first(t_s ORDER BY stat DESC, k) AS t_event_s, min(t_s) AS t_start_s, max(t_s) AS t_end_s, max(stat) AS score FROM over_thr GROUP BY run_id, isl),
ev1 AS (SELECT *, max(t_end_s) OVER (PARTITION BY run_id ORDER BY t_start_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_end FROM ev0),
ev2 AS (SELECT *, sum(CASE WHEN prev_end IS NULL OR t_start_s - prev_end >= {apart} THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY t_start_s) AS g FROM ev1),
ev AS (SELECT * FROM (SELECT run_id, first(t_event_s ORDER BY score DESC, t_start_s) AS t_event_s, min(t_start_s) AS t_start_s, max(t_end_s) AS t_end_s, max(score) AS score FROM ev2 GROUP BY run_id, g) WHERE t_end_s - t_start_s >= {least}::DOUBLE)"""


def events_cte(method: str = "quantile") -> str:
    return _found(_rms(), _STAT[method], 1.0, 0.1)


CARVED = f"""{events_cte()},
bounds AS (SELECT run_id, min(time_s) AS a, max(time_s) AS b FROM norm GROUP BY run_id),
wins AS (SELECT e.*, 'inc_recordings_' || substr(sha1(concat_ws(chr(31), 'recordings', e.run_id, (round(t_event_s * 1000)::BIGINT // 1000)::VARCHAR || '.' || lpad((round(t_event_s * 1000)::BIGINT % 1000)::VARCHAR, 3, '0'))), 1, 12) AS incident_id FROM ev e JOIN bounds USING (run_id) WHERE t_event_s - 3 >= a - 1e-9 AND t_event_s + 2 <= b + 1e-9),
wave AS (SELECT w.*, n.i, n.time_s, n.time_s - w.t_event_s AS t_rel_s, n.ax, n.ay, n.az FROM wins w JOIN norm n ON n.run_id = w.run_id AND n.time_s BETWEEN w.t_event_s - 3 AND w.t_event_s + 2),
idx AS (SELECT incident_id, run_id, t_event_s, t_start_s, t_end_s, score, min(time_s) AS window_start_s, max(time_s) AS window_end_s, count(*) AS n_samples FROM wave GROUP BY ALL),
spans AS (SELECT incident_id, greatest(t_start_s - t_event_s - 0.5, window_start_s - t_event_s) AS start_s, least(t_end_s - t_event_s + 0.5, window_end_s - t_event_s) AS end_s FROM idx),
amp AS (SELECT incident_id, round(coalesce(max(abs(az - m)), 0), 9) AS amplitude FROM (SELECT incident_id, az, avg(az) OVER (PARTITION BY incident_id) AS m FROM wave) GROUP BY incident_id),
sev AS (SELECT incident_id, amplitude, CASE WHEN amplitude <= lo THEN 'low' WHEN amplitude <= hi THEN 'med' ELSE 'high' END AS severity_label FROM amp, (SELECT quantile_cont(amplitude, 1/3::DOUBLE) AS lo, quantile_cont(amplitude, 2/3::DOUBLE) AS hi FROM amp))"""

_LABELLED = f"""{NORM},
marks AS (SELECT run_id, i / 100::DOUBLE - 0.4 AS s, CASE WHEN i % 11 = 0 THEN i / 100::DOUBLE - 0.5 WHEN i % 13 <> 0 THEN i / 100::DOUBLE + 0.6 END AS e FROM norm WHERE az > 250),
sound AS (SELECT * FROM marks WHERE s <= e),
m1 AS (SELECT *, max(e) OVER (PARTITION BY run_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM sound),
m2 AS (SELECT *, sum(CASE WHEN p IS NULL OR s - p >= 1.0 THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY s, e) AS g FROM m1),
ev AS (SELECT run_id, (min(s) + max(e)) / 2 AS t_event_s, min(s) AS t_start_s, max(e) AS t_end_s, 1.0::DOUBLE AS score FROM m2 GROUP BY run_id, g HAVING max(e) - min(s) >= 0.1)"""


def _folded(pairs: str, state: str) -> str:
    """The greedy choice among ranked rows (key, r, a, b, w): each is taken if neither a nor b is."""
    return f"""fold AS (SELECT DISTINCT {state} AS key, 0::BIGINT AS r, []::DOUBLE[] AS xs, []::DOUBLE[] AS ys, []::DOUBLE[] AS ws FROM {pairs}
UNION ALL SELECT f.key, p.r, CASE WHEN list_contains(xs, p.a) OR list_contains(ys, p.b) THEN xs ELSE list_append(xs, p.a) END, CASE WHEN list_contains(xs, p.a) OR list_contains(ys, p.b) THEN ys ELSE list_append(ys, p.b) END, CASE WHEN list_contains(xs, p.a) OR list_contains(ys, p.b) THEN ws ELSE list_append(ws, p.w) END FROM fold f JOIN {pairs} p ON p.{state} = f.key AND p.r = f.r + 1)"""


_GRADE = f"""RECURSIVE det AS (WITH {events_cte()} SELECT run_id, round(t_start_s, 6) AS s, round(t_end_s, 6) AS e FROM ev WHERE round(t_start_s, 6) < round(t_end_s, 6)),
lab AS (WITH {_LABELLED} SELECT run_id, round(t_start_s, 6) AS s, round(t_end_s, 6) AS e FROM ev WHERE round(t_start_s, 6) < round(t_end_s, 6)),
met AS (SELECT d.run_id, d.s AS a, l.s AS b, round((least(d.e, l.e) - greatest(d.s, l.s)) / (greatest(d.e, l.e) - least(d.s, l.s)), 9) AS w FROM det d JOIN lab l ON d.run_id = l.run_id AND least(d.e, l.e) > greatest(d.s, l.s)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY w DESC, a, b) AS r FROM met),
{_folded('ranked', 'run_id')},
won AS (SELECT key AS run_id, max_by(ws, r) AS ws FROM fold GROUP BY 1),
nd AS (SELECT run_id, count(*) AS n_events FROM det GROUP BY 1), nl AS (SELECT run_id, count(*) AS n_labels FROM lab GROUP BY 1)"""

_ENERGY = f"""{CARVED.replace("spans AS (", "old_spans AS (", 1)},
pts AS (SELECT incident_id, t_event_s, window_start_s, window_end_s, g.t_s, row_number() OVER (PARTITION BY incident_id ORDER BY round(rms, 9) DESC, g.t_s) AS r FROM idx JOIN grid g ON g.run_id = idx.run_id AND g.t_s BETWEEN window_start_s AND window_end_s),
fold AS (SELECT DISTINCT incident_id, 0::BIGINT AS r, []::DOUBLE[] AS kept FROM pts
UNION ALL SELECT f.incident_id, p.r, CASE WHEN len(kept) < 3 AND len(list_filter(kept, lambda t: round(abs(t - p.t_s), 9) < 0.5)) = 0 THEN list_append(kept, p.t_s) ELSE kept END FROM fold f JOIN pts p ON p.incident_id = f.incident_id AND p.r = f.r + 1),
picked AS (SELECT incident_id, unnest(max_by(kept, r)) AS t FROM fold GROUP BY 1)"""

_EV = "SELECT run_id, round(t_event_s, 6) AS t_event_s, round(t_start_s, 6) AS t_start_s, round(t_end_s, 6) AS t_end_s, round(score, 6) AS score FROM ev"
_OWN_CHANNEL = "CASE WHEN run_id = 'click' THEN ay ELSE az END"
_ARRAYS = "arr AS (SELECT vec_id::VARCHAR AS run_id, u AS i, embedding[u * 3 + 1]::DOUBLE AS ax, embedding[u * 3 + 2]::DOUBLE AS ay, embedding[u * 3 + 3]::DOUBLE AS az FROM (SELECT vec_id, embedding, unnest(range(0, len(embedding) // 3)) AS u FROM embeddings))"

SQL = {
    "samples_normalized": f"WITH {NORM} SELECT run_id, i, round(time_s, 6) AS time_s, ax, ay, round(az, 6) AS az FROM norm",
    "numeric_coercion": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN round(o_totalprice::DOUBLE, 6) END AS x FROM orders",
    "time_repair": f"WITH {NORM} SELECT run_id, i, round(CASE WHEN run_id = 'click' THEN i / 100::DOUBLE ELSE i / 100::DOUBLE + 0.5 END, 6) AS time_s FROM norm",
    "fs_median_dt": f"WITH {NORM}, t AS (SELECT run_id, i / (100 + 10 * length(run_id))::DOUBLE AS s, lag(i / (100 + 10 * length(run_id))::DOUBLE) OVER (PARTITION BY run_id ORDER BY i) AS p FROM norm), f AS (SELECT run_id, 1 / quantile_cont(s - p, 0.5) AS fs FROM t WHERE s - p > 0 GROUP BY run_id) SELECT run_id, CASE WHEN fs BETWEEN 10 AND 155 THEN round(fs, 6) END AS fs_hz, CASE WHEN NOT fs BETWEEN 10 AND 155 THEN 'fs_implausible' END AS reason FROM f",
    "channel_fallback": "SELECT DISTINCT event_type AS run_id, CASE WHEN event_type IN ('click') THEN 'ax' WHEN event_type = 'error' THEN 'ay' ELSE 'az' END AS channel FROM events",
    "resample_linear": f"WITH {NORM}, r AS (SELECT run_id, count(*) AS n, greatest(2, round_even((max(time_s) - min(time_s)) * 40, 0))::BIGINT AS m FROM norm GROUP BY run_id), g AS (SELECT run_id, n, unnest(range(m)) AS k FROM r), p AS (SELECT run_id, k, least(floor(k * 2.5::DOUBLE)::BIGINT, n - 1) AS lo, least(floor(k * 2.5::DOUBLE)::BIGINT + 1, n - 1) AS hi, k * 2.5::DOUBLE AS pos FROM g) SELECT p.run_id, p.k AS i, round(p.k / 40::DOUBLE, 6) AS time_s, round(a.ax + (pos - lo) * (b.ax - a.ax), 6) AS ax, round(a.ay + (pos - lo) * (b.ay - a.ay), 6) AS ay, round(a.az + (pos - lo) * (b.az - a.az), 6) AS az FROM p JOIN norm a ON a.run_id = p.run_id AND a.i = lo JOIN norm b ON b.run_id = p.run_id AND b.i = hi",
    "resample_uneven": f"WITH {NORM}, u AS (SELECT run_id, i, i / 100::DOUBLE + (i % 3) / 1000::DOUBLE AS t, ax, ay, az FROM norm), s AS (SELECT *, lead(t) OVER w AS t2, lead(ax) OVER w AS ax2, lead(ay) OVER w AS ay2, lead(az) OVER w AS az2 FROM u WINDOW w AS (PARTITION BY run_id ORDER BY t)), r AS (SELECT run_id, min(t) AS t0, greatest(2, round_even((max(t) - min(t)) * 40, 0))::BIGINT AS m FROM u GROUP BY run_id), g AS (SELECT run_id, k, t0 + k / 40::DOUBLE AS at FROM (SELECT run_id, t0, unnest(range(m)) AS k FROM r)) SELECT g.run_id, g.k AS i, round(g.at, 6) AS time_s, round(s.ax + coalesce((g.at - s.t) / (s.t2 - s.t) * (s.ax2 - s.ax), 0), 6) AS ax, round(s.ay + coalesce((g.at - s.t) / (s.t2 - s.t) * (s.ay2 - s.ay), 0), 6) AS ay, round(s.az + coalesce((g.at - s.t) / (s.t2 - s.t) * (s.az2 - s.az), 0), 6) AS az FROM g ASOF JOIN s ON g.run_id = s.run_id AND g.at >= s.t",
    "quality_folder": "SELECT p_partkey, [NULL, 'good', 'bad', 'ok', 'nok', NULL][(p_size % 5) + 2] AS quality FROM part",
    "events_mixed_rates": f"WITH {_found(_windowed(_OWN_CHANNEL, 'fs'), _STAT['quantile'], 0.95, 0.15)} {_EV}",
    "magnitude_of_axes": f"WITH {_windowed('sqrt(coalesce(ax * ax, 0) + coalesce(ay * ay, 0) + coalesce(az * az, 0))', '100')} SELECT run_id, k, round(t_s, 6) AS t_s, round(rms, 6) AS rms FROM grid",
    "csv_runs": f"WITH {NORM} SELECT run_id AS run, 'good' AS quality, i, round(az, 6) AS az FROM norm",
    "csv_headers": f"WITH {NORM} SELECT run_id AS run, i, round(time_s, 6) AS time_s, CASE WHEN length(run_id) % 3 <> 2 THEN ax END AS ax, ay, round(az, 6) AS az FROM norm WHERE run_id <> 'error'",
    "csv_unread": "SELECT DISTINCT event_type AS run FROM events WHERE event_type = 'error'",
    "waveform_table": f"WITH {CARVED} SELECT 'recordings' AS source_dataset, incident_id, count(*) AS n, round(min(t_rel_s), 6) AS from_s, round(max(t_rel_s), 6) AS to_s, round(sum(az), 6) AS sum_az FROM wave GROUP BY 2",
    "waveform_rewrite": f"WITH {CARVED} SELECT 'recordings' AS source_dataset, incident_id, count(*) AS n, round(sum(CASE WHEN run_id = 'click' THEN 1.0::DOUBLE ELSE az END), 6) AS sum_az FROM wave GROUP BY 2",
    "events_labelled": f"WITH {_LABELLED} {_EV}",
    "detection_grade": f"WITH {_GRADE} SELECT run_id, coalesce(n_events, 0) AS n_events, coalesce(n_labels, 0) AS n_labels, coalesce(len(ws), 0) AS n_matched, round(coalesce(len(ws), 0) / n_events, 6) AS \"precision\", round(coalesce(len(ws), 0) / n_labels, 6) AS recall, round(list_avg(ws), 6) AS mean_share FROM nd FULL JOIN nl USING (run_id) LEFT JOIN won USING (run_id)",
    "evidence_spans_energy": f"WITH RECURSIVE {_ENERGY} SELECT incident_id, round(greatest(t - 0.35, window_start_s) - t_event_s, 6) AS start_s, round(least(t + 0.35, window_end_s) - t_event_s, 6) AS end_s FROM picked JOIN idx USING (incident_id)",
    "dataset_states": "SELECT 'events' AS source_dataset, 'enabled' AS state, count(*) AS n FROM events UNION ALL SELECT 'arrays', 'enabled', sum(len(embedding) // 3)::BIGINT FROM embeddings UNION ALL SELECT 'off', 'disabled', 0 UNION ALL SELECT 'nowhere', 'unknown', 0",
    "incremental_stamp": "SELECT DISTINCT event_type AS incident_id FROM events WHERE event_type IN ('click', 'view')",
    "sliding_rms": f"WITH {_rms()} SELECT run_id, k, round(t_s, 6) AS t_s, round(rms, 6) AS rms FROM grid",
    "magnitude_rms": f"WITH {_rms('sqrt(ax * ax + ay * ay + az * az)')} SELECT run_id, k, round(t_s, 6) AS t_s, round(rms, 6) AS rms FROM grid",
    "events_quantile": f"WITH {events_cte()} {_EV}",
    "events_zscore": f"WITH {events_cte('zscore')} {_EV}",
    "events_absolute": f"WITH {events_cte('absolute')} {_EV}",
    "event_cap_per_run": f"WITH {events_cte()} {_EV} QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY t_event_s) <= 2",
    "carve_windows": f"WITH {CARVED} SELECT incident_id, run_id, i, round(time_s, 6) AS time_s, round(t_rel_s, 6) AS t_rel_s, ax, ay, round(az, 6) AS az FROM wave",
    "window_index": f"WITH {CARVED} SELECT incident_id, run_id, round(t_event_s, 6) AS t_event_s, round(window_start_s, 6) AS window_start_s, round(window_end_s, 6) AS window_end_s, n_samples, 100.0::DOUBLE AS fs_hz FROM idx",
    "evidence_spans": f"WITH {CARVED} SELECT incident_id, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s FROM spans",
    "incident_amplitude": f"WITH {CARVED} SELECT incident_id, round(amplitude, 6) AS amplitude FROM amp",
    "incident_severity": f"WITH {CARVED} SELECT incident_id, round(amplitude, 6) AS amplitude, severity_label FROM sev",
    "incident_hours": f"WITH {CARVED} SELECT round(sum(window_end_s - window_start_s) / 3600, 6) AS total_incident_hours FROM idx",
    "array_runs": f"WITH {_ARRAYS} SELECT run_id, i, round(ax, 6) AS ax, round(ay, 6) AS ay, round(az, 6) AS az FROM arr",
    "dataset_union": f"WITH {NORM}, {_ARRAYS} SELECT 'events' AS source_dataset, run_id, count(*) AS n, round(sum(az), 6) AS sum_az FROM norm GROUP BY run_id UNION ALL SELECT 'arrays', run_id, count(*), round(sum(az), 6) FROM arr GROUP BY run_id",
    "unit_limit": "SELECT event_type AS run_id, count(*) AS n FROM events WHERE event_type IN (SELECT DISTINCT event_type FROM events ORDER BY 1 LIMIT 2) GROUP BY 1",
    "incremental_antijoin": f"WITH {CARVED} SELECT incident_id, run_id FROM idx WHERE run_id NOT IN ('click', 'view')",
    "hashed_identity": "SELECT o_orderkey, substr(sha1(concat_ws(chr(31), o_orderstatus, o_orderpriority, o_orderkey::VARCHAR)), 1, 12) AS h FROM orders",
}

QUERIES = {name: globals()[name] for name in SQL}
