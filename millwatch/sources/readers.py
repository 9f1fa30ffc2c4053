"""Recordings, documents, clip metadata and tags from files and tables."""

from __future__ import annotations

import csv
import functools
import re
from collections.abc import Iterator, Mapping
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUALITY_FOLDERS = ("good", "bad", "ok", "nok")


def _below(root: str, path: Column) -> Column:
    """The path relative to the root, without scheme."""
    base = root.split("://", 1)[-1].removeprefix("file:").rstrip("/") + "/"
    return F.substring_index(path, base, -1)


def _plain(uri: Column) -> Column:
    """A file's path from its URI, where a plus sign is itself."""
    return F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))


def quality_of(path: Column) -> Column:
    """The parent folder's name if it is a label of quality."""
    folder = F.lower(F.regexp_extract(path, r"([^/]+)/[^/]+$", 1))
    return F.when(folder.isin(*QUALITY_FOLDERS), folder)


def headers(spark: SparkSession, root: str, pattern: str = "*.csv") -> DataFrame:
    """path (a URI) and line, the first one, of each file below a folder.

    Each file is a task of its own that ends after its first lines, whatever the file's length.
    """
    session, alone = spark.newSession(), str(1 << 40)
    for name, value in {"spark.sql.files.openCostInBytes": alone, "spark.sql.files.maxPartitionBytes": alone, "spark.sql.execution.arrow.maxRecordsPerBatch": "8"}.items():
        session.conf.set(name, value)
    one_file = session.conf.get("spark.sql.files.openCostInBytes") == alone
    rows = session.read.options(recursiveFileLookup=True, pathGlobFilter=pattern, ignoreCorruptFiles=True).text(root)
    rows = rows.where("_metadata.file_block_start = 0").select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = None
        for batch in batches:
            for k, path in enumerate(batch.column(0).to_pylist()):
                if path != seen:
                    yield batch.slice(k, 1)
                    if one_file:
                        return
                    seen = path

    return rows.mapInArrow(first, rows.schema)


def read_runs(spark: SparkSession, root: str, schema: str | T.StructType, bound: int = 1000) -> DataFrame:
    """Recordings in CSV files below a folder: the columns of ``schema`` by the names in each file's header, with run_id
    (the relative path), quality, and i, the row's place in its file.

    Files that share a header are one scan; columns that a file lacks are null, others aren't read. Of a name that a
    header repeats the first counts. What isn't of a column's type is null. A file with a row of more fields than
    its header, or with bytes that aren't text in these columns, is left out as a whole, as one that can't be read
    (``unread_runs`` lists them). More than ``bound`` different headers are an error. Rows of one block of a file lie in
    a row, so only the blocks' sizes are needed to number a file of any length.
    """
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    found = headers(spark, root).groupBy("line").agg(F.collect_list("path").alias("paths")).limit(bound + 1).collect()
    if len(found) > bound:
        raise ValueError(f"over {bound} different headers below {root}")
    parts = [_scan(spark, next(csv.reader([r.line.removeprefix("\ufeff")]), []), r.paths, wanted) for r in sorted(found, key=lambda r: r.line)]
    if not parts:
        return spark.createDataFrame([], T.StructType([*wanted.fields, *(T.StructField(c, t) for c, t in (("i", T.LongType()), ("run_id", T.StringType()), ("quality", T.StringType())))]))
    rows = functools.reduce(DataFrame.unionAll, parts)
    blocks = rows.groupBy("__file", "__block").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"), F.bool_or("__odd").alias("__odd"))
    whole, earlier = Window.partitionBy("__file"), Window.partitionBy("__file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("__file", "__block", (F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__first")).alias("__shift"), F.bool_or("__odd").over(whole).alias("__unfit"))
    placed = rows.join(starts.where("NOT __unfit").drop("__unfit"), ["__file", "__block"]).withColumn("i", F.col("__at") + F.col("__shift"))
    out = placed.withColumn("run_id", _below(root, _plain(F.col("__file")))).withColumn("quality", quality_of(_plain(F.col("__file"))))
    return out.drop("__file", "__block", "__at", "__shift", "__odd")


def _scan(spark: SparkSession, header: list[str], paths: list[str], wanted: T.StructType) -> DataFrame:
    """The files of one header: the wanted columns, where a row lies, and whether it can't belong to such a file."""
    place = {name: k for k, name in reversed(list(enumerate(header)))}
    texts = T.StructType([T.StructField(f"c{k}", T.StringType()) for k in range(len(header) + 1)])  # one more than there should be
    rows = spark.read.options(header=True, ignoreCorruptFiles=True, mode="PERMISSIVE").schema(texts).csv([_plain_path(p) for p in paths])
    read = [F.col(f"c{place[f.name]}") for f in wanted if f.name in place]
    odd = functools.reduce(Column.__or__, [c.contains("\ufffd") for c in read], F.col(f"c{len(header)}").isNotNull())
    columns = [(F.col(f"c{place[f.name]}").try_cast(f.dataType) if f.name in place else F.lit(None).cast(f.dataType)).alias(f.name) for f in wanted]
    return rows.select(*columns, F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__at"), F.coalesce(odd, F.lit(False)).alias("__odd"))


def _plain_path(uri: str) -> str:
    """A path to read: decoded, and what would be a pattern as it stands."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", unquote(uri))


def unread_runs(spark: SparkSession, root: str, runs: DataFrame) -> DataFrame:
    """path of the CSV files below ``root`` of which ``runs`` has no row: those that can't be read, are left out as unfit, or hold a header alone.
    Files of no bytes at all are never listed by Spark."""
    return files_below(spark, root, "*.csv").join(runs.select(F.col("run_id").alias("path")).distinct(), "path", "left_anti")


def array_runs(table: DataFrame, key: str, data: str, attributes: str | None = None) -> DataFrame:
    """Samples of recordings kept as arrays of points: run_id, i, ax, ay, az (the first three numbers of a point).
    Runs with a point of fewer numbers are left out."""
    whole = table.where(F.forall(F.col(data), lambda p: F.size(p) >= 3))
    meta = [F.col(attributes).alias("meta")] if attributes else []
    points = whole.select(F.col(key).cast("string").alias("run_id"), *meta, F.posexplode(F.col(data)).alias("i", "p"))
    return points.select("run_id", *[c for c in points.columns if c == "meta"], F.col("i").cast("bigint").alias("i"), *[F.col("p")[k].cast("double").alias(a) for k, a in enumerate(("ax", "ay", "az"))])


def numbered_runs(rows: DataFrame, run: Column, at: Column, tie: Column, bucket_s: int = 3600) -> DataFrame:
    """``rows`` with run_id and i, the place in its run by time: places are counted within buckets of time, and the
    sizes of the buckets before are added, so that no run is ordered in one piece."""
    keyed = rows.withColumn("run_id", run).withColumn("__at", at).withColumn("__tie", tie)
    keyed = keyed.withColumn("__b", F.floor(F.unix_micros(F.col("__at").cast("timestamp")) / (bucket_s * 1_000_000)))
    sizes = keyed.groupBy("run_id", "__b").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("run_id").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("run_id", "__b", F.coalesce(before, F.lit(0)).alias("__start"))
    inner = F.row_number().over(Window.partitionBy("run_id", "__b").orderBy("__at", "__tie")) - 1
    return keyed.withColumn("__in", inner).join(starts, ["run_id", "__b"]).withColumn("i", (F.col("__start") + F.col("__in")).cast("bigint")).drop("__at", "__tie", "__b", "__in", "__start")


def dataset_counters(spark: SparkSession, datasets: Mapping[str, DataFrame], enabled: Mapping[str, bool], rows: Mapping[str, int]) -> DataFrame:
    """source_dataset, state, n of every dataset that is there or asked for: enabled, disabled, or unknown where none is
    there by that name. ``rows``: counted when the union was written."""
    state = lambda name: "unknown" if name not in datasets else "enabled" if enabled.get(name, True) else "disabled"
    told = [(name, state(name), rows.get(name, 0) if state(name) == "enabled" else 0) for name in dict.fromkeys([*datasets, *enabled])]
    return spark.createDataFrame(told, "source_dataset string, state string, n bigint")


def union_datasets(datasets: Mapping[str, DataFrame], enabled: Mapping[str, bool] | None = None) -> DataFrame:
    """All enabled datasets in one table with source_dataset; columns that one lacks are null there. Names asked for that
    no dataset has are passed over; ``dataset_counters`` tells them."""
    parts = [df.withColumn("source_dataset", F.lit(name)) for name, df in datasets.items() if (enabled or {}).get(name, True)]
    if not parts:
        raise ValueError("no dataset is enabled")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def read_documents(spark: SparkSession, root: str) -> DataFrame:
    """doc_id, path, text of the md, markdown and txt files below a folder."""
    from ..functions.scalars import document_id

    rows = spark.read.text(root, wholetext=True, recursiveFileLookup=True).select(F.col("value").alias("text"), _below(root, _plain(F.col("_metadata.file_path"))).alias("path"))
    kept = rows.where(F.col("path").rlike(r"(?i)\.(md|markdown|txt)$"))
    return kept.select(document_id(F.col("path")).alias("doc_id"), "path", "text")


def read_tags(spark: SparkSession, path: str | None) -> DataFrame:
    """The table of human tags; an empty one without a path."""
    schema = "video_file string, regime string, condition string, source string"
    return spark.createDataFrame([], schema) if path is None else spark.read.option("header", True).csv(path)


def read_index(spark: SparkSession, path: str, schema: str | T.StructType, required_from: str | None = None) -> DataFrame:
    """An index table; if it isn't there, an empty one, or an error that names the stage to run first."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        if required_from is not None:
            raise FileNotFoundError(f"{path} isn't there; run the {required_from} stage first") from e
        return spark.createDataFrame([], schema)


def first_units(rows: DataFrame, unit: str, limit: int | None) -> DataFrame:
    """Rows of the first ``limit`` units (runs, documents, clips), not of the first rows."""
    if limit is None:
        return rows
    units = rows.select(unit).distinct().orderBy(unit).limit(limit)
    return rows.join(units, unit, "left_semi")


def files_below(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path of every file below a folder; their content isn't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select(_below(root, F.col("path")).alias("path"))
