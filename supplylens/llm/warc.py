"""WARC archives: a deterministic sharded writer, and a reader that checks what it reads."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from supplylens.llm.store import Workspace

#: fixed names of the format
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def _record_id(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page:{page}:{digest}')}>"


def _digest(raw: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()


def _clean(value: str | None) -> str:
    """A header value: no line breaks or other controls."""
    return "".join(c if c.isprintable() else "%%%02X" % ord(c) for c in value or "")


def record(page: int | None, url: str | None, payload: bytes, target: int | None) -> bytes:
    """One record as a gzip member of its own; a revisit (``target`` given) has headers only."""
    sha1 = hashlib.sha1(payload).hexdigest()
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block = http if target is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if target is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page, sha1)}",
             f"WARC-Date: {DATE}", f"WARC-Target-URI: {_clean(url) or 'urn:page:%s' % page}",
             "Content-Type: application/http; msgtype=response", f"WARC-Block-Digest: {_digest(block)}",
             f"WARC-Payload-Digest: {_digest(payload)}", f"Content-Length: {len(block)}"]
    if page is not None:
        lines.append(f"WARC-Page-ID: {page}")
    if target is not None:
        lines += [f"WARC-Refers-To: {_record_id(target, sha1)}", f"WARC-Refers-To-Page-ID: {target}", f"WARC-Profile: {REVISIT_PROFILE}"]
    raw = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


class _Shards:
    """Files of one range: a new one begins where the next record would pass ``limit`` bytes."""

    def __init__(self, folder: str, bucket: int, limit: int):
        self.store, self.path = pafs.FileSystem.from_uri(folder)
        self.bucket, self.limit, self.number = bucket, limit, 0
        self.buffer, self.records = io.BytesIO(), 0

    def add(self, raw: bytes) -> Iterator[tuple]:
        if self.records and self.buffer.tell() + len(raw) > self.limit:
            yield from self.close()
        self.buffer.write(raw)
        self.records += 1

    def close(self) -> Iterator[tuple]:
        """Write under a name of this attempt and rename: a reader never sees half a file, and a task that
        runs again puts the same bytes under the same name."""
        if not self.records:
            return
        name = f"part-{self.bucket:06d}-{self.number:06d}.warc.gz"
        raw, temporary = self.buffer.getvalue(), f"{self.path}/_temporary-{uuid.uuid4().hex}-{name}"
        with self.store.open_output_stream(temporary, compression=None) as out:
            out.write(raw)
        self.store.move(temporary, f"{self.path}/{name}")
        yield name, self.records, len(raw), hashlib.sha256(raw).hexdigest()
        self.number, self.records, self.buffer = self.number + 1, 0, io.BytesIO()


MANIFEST = "name string, records long, bytes long, sha256 string"


def _written(folder: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, done, target = None, [], None
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("bucket", "page_id", "digest", "kind", "target"))
            urls, pages = batch.column("url"), batch.column("html")
            for k, (bucket, page, digest, kind, refers) in enumerate(zip(*columns, strict=True)):
                if kind == 0:  # a note before the pages that it is about
                    target = (page, digest, refers)
                    continue
                if shards is None or shards.bucket != bucket:
                    if shards:
                        done += shards.close()
                    shards = _Shards(folder, bucket, limit)
                noted = target[2] if target and target[:2] == (page, digest) else None
                done += shards.add(record(page, urls[k].as_py(), (html.encode() if (html := pages[k].as_py()) else b""), noted))
        if shards:
            done += shards.close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["name", "records", "bytes", "sha256"])
    return run


def _bounds(pages: DataFrame, ranges: int) -> list[int]:
    """Cuts between ranges, from the ids with the lowest hashes: the same for the same pages,
    however they are partitioned. At most 64 ids a range reach the driver."""
    if ranges < 2:
        return []
    sample = sorted(r.page_id for r in pages.where("page_id is not null").select("page_id", F.xxhash64("page_id").alias("h"))
                    .orderBy("h", "page_id").limit(64 * ranges).collect())
    return sorted({sample[len(sample) * k // ranges] for k in range(1, ranges)}) if sample else []


def write_archives(pages: DataFrame, folder: str, range_bytes: int = 32 << 20, shard_bytes: int = 8 << 20,
                   least: int = 1000) -> DataFrame:
    """Write ``page_id, url, html`` as WARC shards in ``folder`` and return the manifest.

    Pages are put into ranges of ``page_id`` of about ``range_bytes``, sorted within each, and
    rolled into files of ``shard_bytes`` compressed. Of equal payloads of at least ``least`` bytes
    the one with the largest id is a response, the others are revisits of it; the largest id, if
    repeated, is a response each time. Headers, record ids and digests follow from the page, the
    date is fixed, so the same pages give the same files. Every file appears by a rename; the
    manifest is written last and makes the archive complete.

    Pages move once, with short notes on who is a revisit sorted before them.
    """
    spark = pages.sparkSession
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.octet_length(html).alias("size"), F.sha1(html).alias("digest"))
    shape = slim.agg(F.sum(F.col("size") + 300).alias("bytes")).first()
    cuts = _bounds(slim, max(1, -(-(shape.bytes or 0) // range_bytes)))
    largest = (slim.where(F.col("size") >= least).groupBy("digest").agg(F.max("page_id").alias("target"), F.count("*").alias("n"))
               .where("n > 1").drop("n"))
    notes = (slim.where(F.col("size") >= least).join(largest, "digest").where("page_id is null or page_id < target")
             .select("page_id", "digest", F.lit(0).alias("kind"), "target", F.lit(None).cast("string").alias("url"),
                     F.lit(None).cast("string").alias("html")).distinct())
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha1(html).alias("digest"), F.lit(1).alias("kind"),
                        F.lit(None).cast("long").alias("target"), F.col("url").cast("string").alias("url"), html.alias("html"))
    edges = np.array(cuts, np.int64)

    @F.pandas_udf("int")
    def bucket(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, ids, "right"))

    ranged = rows.unionByName(notes).withColumn(
        "bucket", F.when(F.col("page_id").isNull(), 0).otherwise(bucket(F.coalesce("page_id", F.lit(0)))))
    store, path = pafs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    manifest = (ranged.repartitionById(len(cuts) + 1, "bucket").sortWithinPartitions("bucket", "page_id", "digest", "kind")
                .mapInArrow(_written(folder, shard_bytes), MANIFEST))
    manifest.write.parquet(f"{folder}/_manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")


def _parsed(folder: str):
    def records(stream: io.BufferedIOBase) -> Iterator[tuple]:
        while line := stream.readline():
            if line.strip() == b"":
                continue
            if line.strip() != b"WARC/1.1":
                raise ValueError("not a WARC record")
            headers = {}
            while (line := stream.readline().rstrip(b"\r\n")):
                name, _, value = line.partition(b": ")
                headers[name.decode().lower()] = value.decode()
            block = stream.read(int(headers["content-length"]))
            if _digest(block) != headers["warc-block-digest"]:
                raise ValueError(f"damaged block of {headers['warc-record-id']}")
            head, _, payload = block.partition(b"\r\n\r\n")
            size = int(next(x for x in head.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
            kind = headers["warc-type"]
            if kind == "response" and (_digest(payload) != headers["warc-payload-digest"] or len(payload) != size):
                raise ValueError(f"damaged payload of {headers['warc-record-id']}")
            page, target = headers.get("warc-page-id"), headers.get("warc-refers-to-page-id")
            yield (int(page) if page else None, size, base64.b32decode(headers["warc-payload-digest"][5:]).hex(), kind,
                   int(target) if target else None, payload.decode() if kind == "response" else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = pafs.FileSystem.from_uri(folder)
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "html"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        for batch in batches:
            for name in batch.column("name").to_pylist():
                with store.open_input_stream(f"{path}/{name}", compression=None) as raw:
                    rows, size = [], 0
                    for row in records(io.BufferedReader(gzip.GzipFile(fileobj=raw))):
                        rows.append(row)
                        size += row[1]
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)
    return run


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The records of all files that the manifest of ``folder`` names, with checked digests.

    ``page_id, payload_bytes, payload_digest, record_type, refers_to, html``; a revisit has no
    html of its own. A damaged block or payload is an error.
    """
    files = spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")
    n = files.count()
    # a file for each task: the sort gives every file a place of its own
    spread = files.select("name").repartitionByRange(max(1, n), "name") if n else files.select("name")
    return spread.mapInArrow(_parsed(folder), "page_id long, payload_bytes long, payload_digest string, record_type string, "
                             "refers_to long, html string")


def archived(spark: SparkSession, pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write all pages and read the archives back.

    Null html is an empty payload; a null url becomes a name made from the id; a null id stays
    null and is never the target of a revisit unless all copies have none. Repeated rows are
    records of their own. Other columns are ignored.
    """
    folder = folder or f"{Workspace(spark, 'warc').root}/archive"
    write_archives(pages, folder)
    return read_archives(spark, folder)
