"""Writers of indices, waveforms and reports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import saved


def interchange(df: DataFrame) -> DataFrame:
    """List columns as JSON text, as index files hold them."""
    return df.select(*[F.to_json(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name) for f in df.schema.fields])


def write_index(df: DataFrame, path: str, dry_run: bool = False) -> None:
    """Replace the index; a dry run does all the work but keeps nothing."""
    writer = interchange(df).write.mode("overwrite")
    writer.format("noop").save() if dry_run else writer.parquet(path)


def not_yet_built(wanted: DataFrame, built: DataFrame, key: str = "incident_id", stamp: str | None = None) -> DataFrame:
    """Rows whose key isn't built, or whose input (by ``stamp``) is newer than what was built."""
    if stamp is None:
        return wanted.join(built.select(key).distinct(), key, "left_anti")
    done = built.groupBy(key).agg(F.max(stamp).alias("__built"))
    return wanted.join(done, (wanted[key] == done[key]) & (wanted[stamp] <= done["__built"]), "left_anti")


def write_waveforms(waveforms: DataFrame, path: str, buckets: int = 64) -> None:
    """Put waveforms into one table, parted by dataset and bucket of incidents; a window's samples lie together and in
    order. A window that is there already is replaced, others stay: of the buckets that windows fall into, and of no
    others, what they hold besides is written again with them, and takes the bucket's place when all is written."""
    bucket = F.pmod(F.xxhash64("incident_id"), F.lit(buckets)).cast("int")
    rows = waveforms.withColumn("bucket", bucket)
    spark, there = waveforms.sparkSession, None
    try:
        there = spark.read.schema(rows.schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    if there is not None:
        rows = saved(rows, "new-waveforms")  # they may be read from the table itself
        touched = rows.select("source_dataset", "bucket").distinct()
        others = there.join(F.broadcast(touched) if buckets <= 4096 else touched, ["source_dataset", "bucket"], "left_semi").join(rows.select("source_dataset", "incident_id").distinct(), ["source_dataset", "incident_id"], "left_anti")
        rows = rows.unionByName(saved(others, "kept-waveforms"))
    spread = rows.repartition("source_dataset", "bucket").sortWithinPartitions("source_dataset", "bucket", "incident_id", "time_s")
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_dataset", "bucket").parquet(path)


def write_report(metrics: DataFrame, path: str) -> None:
    metrics.coalesce(1).write.mode("overwrite").json(path)
