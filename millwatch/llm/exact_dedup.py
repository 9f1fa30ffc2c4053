"""Exact deduplication as a stream with disk-backed state.

Texts count as equal when they are identical without the characters of ``[\\x20\\x09-\\x0D]``.  Tasks of the stream
cut that white space, write each different text of some MB of input once to a content file in the shared folder, and
send on its digest, the id that would stay, the number of copies and a locator of its bytes, never the text.  State
keyed by digest (a streaming aggregate in RocksDB, checkpointed, without expiry) holds the id that stays, the number of
copies and the locator of the bytes seen first.  After each batch all locators that came for a digest that was there
already are read and their bytes compared in full with those seen first.  Should two texts share a digest, that digest
is noted, and its rows are told apart by their bytes.  A group of copies of any size sends one row for each some MB of
input to its key.

``absorb`` may run again on the same folder: new files are matched with all that came before.  ``judge`` gives every
row its class: classes that hold over 1 / 4096 of all rows, at most 4095 then, are broadcast, the rest joined.

Defined results: null counts as empty, and all empty texts, or texts of white space only, are equal; of equal texts
the row with the most code points (white space included), then the smallest id stays, rows without id last;
repeated rows are rows of one group, and where the id that stays repeats with equal text, all of its rows are kept;
texts of any length are read whole; other columns are not read, whatever they are called; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import posixpath
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
import zstandard
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rows import freed
from .storage import new_path, saved
from .words import small_batches

WHITE_SPACE = b" \t\n\v\f\r"
#: Bytes of text of which a task keeps the different ones before it writes and sends them, and of a compressed piece.
WINDOW_BYTES, PIECE_BYTES = 32 << 20, 128 << 10
#: A class of more than this share of all rows is broadcast.
LARGE_SHARE = 4096

LOCATOR = "file string, offset long, size long, start long, length long"
FOUND = f"digest string, id long, has_id boolean, chars long, copies long, at long, {LOCATOR}"


class Contents:
    """Texts in compressed pieces of files of a folder."""

    def __init__(self, folder: str) -> None:
        self.store, self.root = fs.FileSystem.from_uri(folder)
        self.pieces: dict[tuple[str, int], bytes] = {}

    def write(self, texts: list[bytes]) -> list[tuple[str, int, int, int, int]]:
        """A locator for each text; the file has a name of its own, so a task that runs again harms nothing."""
        name, offset, places, k = uuid.uuid4().hex, 0, [], 0
        pack = zstandard.ZstdCompressor(level=1)
        self.store.create_dir(self.root, recursive=True)
        with self.store.open_output_stream(posixpath.join(self.root, name), compression=None) as out:
            while k < len(texts):
                piece, size, starts = [], 0, []
                while k < len(texts) and (not piece or size + len(texts[k]) <= PIECE_BYTES):
                    piece.append(texts[k])
                    starts.append(size)
                    size, k = size + len(texts[k]), k + 1
                data = pack.compress(b"".join(piece))
                out.write(data)
                places += [(name, offset, len(data), s, len(t)) for s, t in zip(starts, piece, strict=True)]
                offset += len(data)
        return places

    def read(self, file: str, offset: int, size: int, start: int, length: int) -> bytes:
        if (file, offset) not in self.pieces:
            if len(self.pieces) >= 16:
                self.pieces.pop(next(iter(self.pieces)))
            with self.store.open_input_file(posixpath.join(self.root, file)) as f:
                self.pieces[file, offset] = zstandard.ZstdDecompressor().decompress(f.read_at(size, offset))
        return self.pieces[file, offset][start : start + length]


def _uri(folder: str) -> str:
    return folder if ":/" in folder else f"file://{folder}"


def _narrow(text: str | None) -> bytes:
    return (text or "").encode().translate(None, WHITE_SPACE)


def _rank(chars: int, has_id: bool, i: int) -> tuple[int, bool, int]:
    """Of equal texts the row with the least rank stays."""
    return (-chars, not has_id, i)


def _told(rows: DataFrame, folder: str, bits: int) -> DataFrame:
    """A row for each different text of some MB of input, its bytes written, and the row itself to an index of the batch
    (``at``), by which ``_checked`` finds it. What a task that ran twice left there is compared twice."""
    schema = T._parse_datatype_string(FOUND)
    types = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contents, held, size = Contents(f"{folder}/texts"), {}, 0

        def sent(at: int) -> pa.RecordBatch:
            places = contents.write(list(held))
            digests = [hashlib.sha256(t).hexdigest()[: bits // 4] for t in held]
            rows = [(d, i, not none, -chars, n, at, *p) for d, ((chars, none, i), n), p in zip(digests, held.values(), places, strict=True)]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=schema.names)
            index = f"{contents.root.removesuffix('/texts')}/index/at={at}"
            contents.store.create_dir(index, recursive=True)
            pq.write_table(pa.Table.from_batches([out]).drop(["at"]), f"{index}/{uuid.uuid4().hex}.parquet", filesystem=contents.store)
            return out

        at = 0
        for big in batches:
            for batch in small_batches(big, 1):
                for i, text, at in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                    # as a key of a dict a text is compared byte by byte
                    key, rank = _narrow(text), _rank(len(text or ""), i is not None, i or 0)
                    if (before := held.get(key)) is None:
                        held[key], size = [rank, 1], size + len(key)
                    else:
                        before[0], before[1] = min(before[0], rank), before[1] + 1
                if size >= WINDOW_BYTES:
                    yield sent(at)
                    held, size = {}, 0
        if held:
            yield sent(at)

    return rows.mapInArrow(freed(run), schema)


def _unequal(pairs: DataFrame, folder: str) -> DataFrame:
    """The digests of rows whose two locators lead to different bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contents = Contents(f"{folder}/texts")
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            other = {d for d, *places in rows if places[4] != places[9] or contents.read(*places[:5]) != contents.read(*places[5:])}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(other), pa.string())], names=["digest"])

    return pairs.mapInArrow(freed(run), "digest string")


def _checked(spark: SparkSession, folder: str, updates: DataFrame, batch: int) -> None:
    """Keep the classes that a batch changed, and compare the bytes of its hits. A batch that runs again replaces both."""
    updates.write.mode("overwrite").parquet(f"{folder}/classes/batch={batch}")
    classes = spark.read.schema(updates.schema).parquet(f"{folder}/classes/batch={batch}")
    at = classes.agg(F.max("at")).first()[0]
    if at is None:
        spark.createDataFrame([], "digest string").write.mode("overwrite").parquet(f"{folder}/unequal/batch={batch}")
        return
    before = spark.read.schema(f"{CLASSES}, batch long").parquet(f"{folder}/classes").where(F.col("batch") < batch).agg(F.max("at")).first()[0]
    if before is not None and before >= at:
        raise ValueError("the clock went back: which bytes came first isn't known")
    place = [c.split()[0] for c in LOCATOR.split(", ")]
    hits = classes.where("parts > 1").select("digest", *[F.col(f"seen.{c}").alias(f"seen_{c}") for c in place])
    came = spark.read.schema(FOUND.replace("at long, ", "")).parquet(f"{folder}/index/at={at}").select("digest", *place)
    pairs = came.join(hits, "digest").where("file <> seen_file OR offset <> seen_offset OR start <> seen_start")
    _unequal(pairs.select("digest", *place, *[f"seen_{c}" for c in place]), _uri(folder)).write.mode("overwrite").parquet(f"{folder}/unequal/batch={batch}")


CLASSES = f"digest string, best struct<less_chars:long,no_id:boolean,id:long>, copies long, parts long, at long, seen struct<at:long,{LOCATOR.replace(' ', ':').replace(',:', ',')}>"


def absorb(stream: DataFrame, folder: str, text: str = "text", row_id: str = "doc_id", bits: int = 256) -> None:
    """Match all rows that ``stream`` has now; ``folder`` holds state, contents and classes.

    Called again with a stream of the same source it goes on where it stopped.
    """
    spark = stream.sparkSession
    rows = stream.select(F.col(row_id).cast("long").alias("id"), F.col(text).alias("text"), F.unix_micros(F.current_timestamp()).alias("at"))
    rank = F.struct((-F.col("chars")).alias("less_chars"), (~F.col("has_id")).alias("no_id"), F.col("id").alias("id"))
    place = [c.split()[0] for c in LOCATOR.split(", ")]
    kept = _told(rows, _uri(folder), bits).groupBy("digest").agg(
        F.min(rank).alias("best"), F.sum("copies").alias("copies"), F.count("*").alias("parts"), F.max("at").alias("at"), F.min(F.struct("at", *place)).alias("seen"),
    )
    query = kept.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    query.foreachBatch(lambda updates, batch: _checked(spark, folder, updates, batch)).start().awaitTermination()


def classes_of(spark: SparkSession, folder: str) -> DataFrame:
    """digest, id (the one that stays), has_id, copies: the last state of each digest."""
    rows = spark.read.schema(CLASSES).parquet(f"{folder}/classes")
    last = rows.groupBy("digest").agg(F.max_by(F.struct("best", "copies"), "copies").alias("last"))
    return last.select("digest", F.col("last.best.id").alias("id"), (~F.col("last.best.no_id")).alias("has_id"), "last.copies")


def stream_of(spark: SparkSession, path: str, batch_bytes: int = 1 << 40) -> DataFrame:
    """The Parquet files of a path as a stream, in a session of its own that keeps state in RocksDB."""
    session = spark.newSession()
    for name, value in {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true", "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
        "spark.sql.streaming.noDataMicroBatches.enabled": "false",
        "spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions"), "spark.sql.session.timeZone": spark.conf.get("spark.sql.session.timeZone"),
    }.items():
        session.conf.set(name, value)
    rows = spark.read.parquet(path)
    if [posixpath.basename(f) for f in rows.inputFiles()] == [posixpath.basename(path)]:  # one file: streams take folders or patterns
        path = f"{path[:-1]}[{path[-1]}]"
    return session.readStream.schema(rows.schema).option("maxBytesPerTrigger", batch_bytes).parquet(path)


def _digested(docs: DataFrame, text: str, row_id: str, bits: int, with_text: bool = False) -> DataFrame:
    """Id, text_sha256, digest and, if asked, length and the text without white space of each row."""
    more = [T.StructField("chars", T.LongType()), T.StructField("narrow", T.BinaryType())] * with_text
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("text_sha256", T.StringType()), *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in small_batches(big, 1):
                whole = batch.column(1).to_pylist()
                texts = [_narrow(t) for t in whole]
                columns = [batch.column(0), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())]
                if with_text:
                    columns += [pa.array([len(t or "") for t in whole], pa.int64()), pa.array(texts, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    rows = docs.select(F.col(row_id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(freed(run), schema)
    return rows.withColumn("digest", F.substring("text_sha256", 1, bits // 4))


def judge(docs: DataFrame, folder: str, text: str = "text", row_id: str = "doc_id", bits: int = 256) -> DataFrame:
    """id, keep_id, group_size, kept and text_sha256 of every row of ``docs``, all of which ``folder`` has absorbed."""
    spark = docs.sparkSession
    shared = spark.read.schema("digest string").parquet(f"{folder}/unequal").distinct()
    several = not shared.isEmpty()
    rows, classes = saved(_digested(docs, text, row_id, bits), "digests"), classes_of(spark, folder)
    if several:  # different texts with one digest: told apart by their bytes
        whole = _digested(docs, text, row_id, bits, with_text=True).join(shared, "digest", "left_semi")
        best = F.min(F.struct(-F.col("chars"), F.col("id").isNull(), F.col("id"))).alias("best")
        groups = whole.groupBy("digest", "narrow").agg(best, F.count("*").alias("copies"))
        by_bytes = whole.join(groups.select("digest", "narrow", F.col("best.id").alias("keep"), F.col("best.id").isNotNull().alias("has_id"), "copies"), ["digest", "narrow"]).select(*_verdict())
        rows, classes = rows.join(shared, "digest", "left_anti"), classes.join(shared, "digest", "left_anti")
    one = saved(classes.withColumnRenamed("id", "keep"), "classes")
    large = F.col("copies") * LARGE_SHARE > (one.agg(F.sum("copies")).first()[0] or 0)
    # at most LARGE_SHARE - 1 classes can hold that share of the rows each
    met = rows.join(F.broadcast(one.where(large)), "digest").select(*_verdict())
    rest = rows.join(F.broadcast(one.where(large).select("digest")), "digest", "left_anti").join(one.where(~large), "digest").select(*_verdict())
    out = met.unionAll(rest)
    return out.unionAll(by_bytes) if several else out


def _verdict() -> list[Column]:
    keep = F.when(F.col("has_id"), F.col("keep"))
    return [F.col("id"), keep.alias("keep_id"), F.col("copies").alias("group_size"), F.col("id").eqNullSafe(keep).alias("kept"), F.col("text_sha256")]


def deduplicate(spark: SparkSession, path: str, batch_bytes: int = 1 << 40, text: str = "text", row_id: str = "doc_id", bits: int = 256) -> DataFrame:
    """``judge`` of all rows of the Parquet files of a path, in a new folder of the shared place."""
    folder = new_path(spark, "exact-dedup")
    absorb(stream_of(spark, path, batch_bytes), folder, text, row_id, bits)
    return judge(spark.read.parquet(path), folder, text, row_id, bits).withColumnRenamed("id", row_id)
