"""Deterministic sharded WARC archives.

Records are sorted by ranges of url, page_id and digest.  The borders of the ranges, which are the shards, come from the
records alone: of each as many hundredths of a shard as it has bytes, as a hash of it tells, is a mark, and every
so manieth mark in order is a border.  So shards are even in bytes whatever host, url or payload is frequent, and the
same rows give the same bytes on any cluster; only rows that repeat another with its page_id can't be parted.  A task
writes a shard record by record (each a gzip member of its own), rolls to a new file where the compressed size passes a
bound, and builds headers and digests anew.  Files are written under temporary names and moved to their own when whole;
the manifest, a table that Spark commits last, names the files that count.  A task that is run again writes the same
files, and readers look at no file outside the manifest.  In the manifest's order an archive reads in order of its
records.

Of the records with equal payloads of ``least`` bytes or more, the one with the smallest page_id is a response
and the others revisit it.

Defined results: null html is an empty payload; a null url has no target; a row that repeats another, page_id
included, is a record of the same type; a null page_id never is the smallest unless it is the only one; pages of
any length are one record; extra columns aren't archived; an empty table gives an archive without files.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rows import freed
from .storage import new_path, saved

LEAST, ROLL_BYTES, SHARD_BYTES = 100, 256 << 20, 512 << 20
#: An archive of less than SHARD_BYTES for each of so many shards has so many, but none planned under LEAST_SHARD_BYTES.
USUAL_SHARDS, LEAST_SHARD_BYTES = 64, 1 << 20
#: Marks for each shard, and characters of a url that count in the order: those of borders reach the driver.
MARKS, URL_CHARS = 64, 200
DATE = "2024-01-01T00:00:00Z"
MANIFEST = "shard long, file string, records long, bytes long, sha256 string"
RECORD = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType()), T.StructField("file", T.StringType())])


def record_types(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, refers_to (null for responses)."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.octet_length(html).cast("long").alias("payload_bytes"), F.sha2(html, 256).alias("payload_digest"))
    shared = rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.count("*").alias("n"), F.min("page_id").alias("first_id")).where("n > 1 AND first_id IS NOT NULL").select("payload_digest", "first_id")
    # written first: both sides of the join are then plain exchanges, of which Spark splits hot digests
    joined = rows.join(saved(shared, "warc-shared"), "payload_digest", "left")
    return joined.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))).drop("first_id")


def _headers(fields: list[tuple[str, object]]) -> bytes:
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields if v is not None) + b"\r\n"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def record(page_id: int | None, url: str | None, html: str, digest: str, refers_to: int | None) -> bytes:
    """One record, uncompressed. Digests are worked out from the payload again."""
    payload = html.encode()
    own = hashlib.sha256(payload).hexdigest()
    if own != digest:
        raise ValueError(f"page {page_id}: payload digest {own} isn't {digest}")
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    target = None if url is None else "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", DATE), ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha256:{own}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(block)),
        ("WARC-Refers-To", None if refers_to is None else record_id(refers_to, digest)), ("WARC-Profile", None if refers_to is None else "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        ("X-Page", json.dumps({"id": page_id, "url": url, "bytes": len(payload), "refers_to": refers_to})),
    ]
    return _headers(fields) + block + b"\r\n\r\n"


class ShardFiles:
    """Files of one shard: at most one is open; ``done`` gets a manifest row for each that is whole."""

    def __init__(self, folder: str, shard: int, roll_bytes: int) -> None:
        self.store, self.folder = fs.FileSystem.from_uri(folder)
        self.shard, self.roll_bytes, self.number, self.out, self.done = shard, roll_bytes, 0, None, []

    def add(self, data: bytes) -> None:
        if self.out is None:
            self.temporary = posixpath.join(self.folder, "_temporary_warc", f"{self.shard:06d}-{self.number:04d}-{uuid.uuid4().hex}")
            self.store.create_dir(posixpath.dirname(self.temporary), recursive=True)
            self.out, self.size, self.records, self.digest = self.store.open_output_stream(self.temporary, compression=None), 0, 0, hashlib.sha256()
        pack = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = pack.compress(data) + pack.flush()
        self.out.write(member)
        self.digest.update(member)
        self.size, self.records = self.size + len(member), self.records + 1
        if self.size >= self.roll_bytes:
            self.close()

    def close(self) -> None:
        if self.out is None:
            return
        self.out.close()
        name = f"part-{self.shard:06d}-{self.number:04d}.warc.gz"
        self.store.move(self.temporary, posixpath.join(self.folder, name))
        self.done.append((self.shard, name, self.records, self.size, self.digest.hexdigest()))
        self.number, self.out = self.number + 1, None


ORDER = ["head", "page_id", "payload_digest"]


def _sorted_key(head: str | None, page_id: float | None, digest: str) -> tuple:
    """Rows without url, or without page_id, come last, as in Spark's order."""
    return (head is None, head or "", page_id is None, page_id or 0, digest)


def borders(rows: DataFrame, shard_bytes: int) -> list[tuple]:
    """Keys at which shards of about ``shard_bytes`` begin, but for the first: one for each shard, whatever the number of
    records."""
    chance = F.least(F.lit(1.0), F.col("weight") * (MARKS / shard_bytes))
    hashed = F.shiftright(F.xxhash64(*ORDER), 11) / float(1 << 53) + 0.5
    order = [F.asc_nulls_last(c) for c in ORDER]
    marks = rows.where(hashed < chance).select(*ORDER, "weight")
    # of a record of many marks only one is here: it counts for all of them
    marks = marks.withColumn("marks", F.greatest(F.lit(1.0), F.col("weight") * (MARKS / shard_bytes)))
    marks = marks.repartitionByRange(*order).sortWithinPartitions(*order)
    marks = saved(marks.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)), "warc-marks")
    before = F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    sizes = marks.groupBy("part").agg(F.sum("marks").alias("size")).select("part", before.alias("before"))  # a row for each partition
    upto = F.col("before") + F.sum("marks").over(Window.partitionBy("part").orderBy("at"))
    placed = marks.join(F.broadcast(sizes), "part").withColumn("upto", F.round(upto, 6))
    found = placed.where(F.floor(F.col("upto") / MARKS) > F.floor(F.round(F.col("upto") - F.col("marks"), 6) / MARKS)).select(*ORDER).distinct().collect()
    return sorted(_sorted_key(*r) for r in found)


def write(pages: DataFrame, folder: str, least: int = LEAST, shard_bytes: int | None = None, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Archive ``pages`` under ``folder`` (a URI that all executors reach); returns the manifest. ``shard_bytes``: of
    payload in a shard, by default as the bytes of all pages tell."""
    spark = pages.sparkSession
    if shard_bytes is None:
        size = pages.agg(F.sum(F.octet_length("html")).alias("n")).first().n or 0
        shard_bytes = max(LEAST_SHARD_BYTES, min(SHARD_BYTES, size // USUAL_SHARDS))
    rows = record_types(pages, least).withColumn("head", F.substring("url", 1, URL_CHARS))
    # a record is 1 KB or so of headers besides its payload
    starts = borders(rows.select(*ORDER, (F.col("payload_bytes") + 1024).alias("weight")), shard_bytes)

    @F.pandas_udf("int")
    def shard_of(head: pd.Series, page_id: pd.Series, digest: pd.Series) -> pd.Series:
        keys = zip(head, page_id.astype(object).where(page_id.notna(), None), digest, strict=True)
        return pd.Series([bisect.bisect_right(starts, _sorted_key(h, None if i is None else int(i), d)) for h, i, d in keys], dtype="int32")

    # ids are sent as text: as numbers a column with nulls would lose digits
    rows = rows.withColumn("shard", shard_of("head", F.col("page_id").cast("string"), "payload_digest"))
    order = [F.asc_nulls_last(c) for c in (*ORDER, "url")]
    ordered = rows.repartitionById(len(starts) + 1, "shard").sortWithinPartitions(*order).select(F.col("shard").cast("long").alias("shard"), "page_id", "url", "html", "payload_digest", "refers_to")
    spark_schema = T._parse_datatype_string(MANIFEST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: ShardFiles | None = None
        done: list[tuple] = []
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                for row in batch.slice(low, 64).to_pylist():
                    if files is None or files.shard != row["shard"]:
                        if files is not None:
                            files.close()
                            done += files.done
                        files = ShardFiles(folder, row["shard"], roll_bytes)
                    files.add(record(row["page_id"], row["url"], row["html"], row["payload_digest"], row["refers_to"]))
        if files is not None:
            files.close()
            done += files.done
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=spark_schema.names)

    ordered.mapInArrow(freed(run), spark_schema).write.parquet(f"{folder}/manifest")
    return spark.read.schema(spark_schema).parquet(f"{folder}/manifest")


def members(stream: object, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a stream, each unpacked; one is in memory at a time."""
    unpack, parts = zlib.decompressobj(31), []
    while data := stream.read(chunk):
        while data:
            parts.append(unpack.decompress(data))
            data = b""
            if unpack.eof:
                yield b"".join(parts)
                data, unpack, parts = unpack.unused_data, zlib.decompressobj(31), []
    if parts and any(parts):
        raise ValueError("the archive ends inside a record")


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record; checks its length and digests."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n" or f"sha256:{hashlib.sha256(block).hexdigest()}" != fields["WARC-Block-Digest"]:
        raise ValueError(f"{fields.get('WARC-Record-ID')} is damaged")
    return fields, block


def read(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """The records of an archive, by its manifest; each file is streamed by one task."""
    schema = T.StructType(RECORD.fields + ([T.StructField("payload", T.StringType())] if with_payload else []))
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()] + [pa.string()] * with_payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, size = [], 0
                with store.open_input_stream(posixpath.join(root, name), compression=None) as stream:
                    for data in members(stream):
                        fields, block = parse(data)
                        page = json.loads(fields["X-Page"])
                        payload = block.partition(b"\r\n\r\n")[2]
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                        if fields["WARC-Type"] == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != page["bytes"]):
                            raise ValueError(f"{fields['WARC-Record-ID']}: payload doesn't match its digest")
                        rows.append((page["id"], page["url"], page["bytes"], digest, fields["WARC-Type"], page["refers_to"], name) + ((payload.decode() if fields["WARC-Type"] == "response" else None,) if with_payload else ()))
                        size += len(payload)
                        if size > 4 << 20 or len(rows) >= 2000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=schema.names)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=schema.names)

    # a few names only: dealt out by their number, or one task would get all of them
    files = manifest.agg(F.count("*").alias("n")).first().n
    numbered = manifest.select("file", (F.row_number().over(Window.orderBy("file")) - 1).alias("number"))
    return numbered.repartitionById(max(1, files), "number").select("file").mapInArrow(freed(run), schema)


def round_trip(pages: DataFrame, **options: int) -> DataFrame:
    """Archive ``pages`` in a new folder of the shared place and read the archive back."""
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    write(pages, folder, **options)
    return read(spark, folder, with_payload=False)
