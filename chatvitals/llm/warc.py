"""WARC archives, index first.

`write_archives` writes one gzip member per record and returns the index: file, offset, length, URL, digest and
record type of every record.  Of rows with equal payloads (at least `least` bytes), the one with the smallest page_id is a
response and the others are revisits of it, without a payload of their own.  `read_records` takes
index rows, sorts them by place, coalesces ranges that lie close together into one read, and parses
the records from the bytes.

Files go to the folder that the cluster shares, under a name of the task attempt; only rows of the attempt
that Spark keeps name its files, so a lost executor leaves an orphan at worst.  The index is a written table, so that
archives are not written again when it is read twice.

Null html counts as an empty payload, null URLs as empty; control characters in URLs are percent-encoded.  Rows
that repeat the smallest page_id are all responses; rows without page_id are responses unless their payload
has a page_id elsewhere.  A payload of any length is one record, and is read in one range of its own if it is longer than `most`.  Empty tables give
an empty index and no records.  Other columns are dropped.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INDEX = T.StructType([T.StructField(n, t) for n, t in (("file", T.StringType()), ("offset", T.LongType()), ("length", T.LongType()), ("url", T.StringType()), ("digest", T.StringType()), ("page_id", T.LongType()), ("record_type", T.StringType()))])
RECORDS = T.StructType([T.StructField(n, t) for n, t in (("page_id", T.LongType()), ("payload_bytes", T.LongType()), ("payload_digest", T.StringType()), ("record_type", T.StringType()), ("refers_to", T.LongType()), ("url", T.StringType()), ("payload", T.BinaryType()))])
_INDEX = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string())])
_RECORDS = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.large_binary())])
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def _packed(data: bytes, level: int) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def record(page_id, url: str, payload: bytes, digest: str, refers_to, revisit: bool) -> bytes:
    """The record's bytes; a revisit keeps the HTTP head (and in it the payload's length) only."""
    block = HTTP % len(payload) + (b"" if revisit else payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {re.sub('[\x00-\x20\x7f]', lambda m: f'%{ord(m[0]):02X}', url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head[3:3] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """A record's fields from its bytes; raises if lengths or digests do not hold."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if lines[0] != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError("payload and digest differ")
    page = lambda name: int(x) if (x := fields.get(name, "<urn:page:>")[10:-1]) else None
    return {"page_id": page("WARC-Record-ID"), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": page("WARC-Refers-To"), "url": fields["WARC-Target-URI"], "payload": payload if kind == "response" else None}


def write_archives(df: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0, level: int = 1, most_bytes: int = 1 << 30) -> DataFrame:
    """Writes the archives and returns their index."""
    from .common import shared_dir, written

    spark = df.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    pages = df.select(F.col(page_id).cast("long").alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    pages = pages.withColumn("sha1", F.unhex(F.sha1("payload")))
    # only payloads that occur more than once are joined: few rows, and a join that Spark may broadcast after measuring, or split when a payload is hot
    shared = pages.filter(F.length("payload") >= least).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select(F.col("sha1").alias("shared"), "first")
    pages = pages.join(shared, (F.col("sha1") == F.col("shared")) & (F.length("payload") >= least), "left").select("page_id", "url", "payload", "first")

    def run(batches):
        import os

        from pyarrow.fs import FileSystem
        from pyspark import TaskContext

        fs, root = FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        task, files, out, at = TaskContext.get(), 0, None, 0
        try:
            for batch in (whole.slice(i, 256) for whole in batches for i in range(0, whole.num_rows, 256)):  # payloads become Python objects
                rows = []
                for page, link, payload, first in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "first"))):
                    if out is None or at >= most_bytes:
                        if out is not None:
                            out.close()
                        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{files:04d}-{os.urandom(4).hex()}.warc.gz"
                        out, at, files = fs.open_output_stream(f"{root}/{name}", compression=None), 0, files + 1
                    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    revisit = first is not None and first != page
                    data = _packed(record(page, link, payload, digest, first, revisit), level)
                    out.write(data)
                    rows.append({"file": name, "offset": at, "length": len(data), "url": link, "digest": digest, "page_id": page, "record_type": "revisit" if revisit else "response"})
                    at += len(data)
                yield pa.RecordBatch.from_pylist(rows, _INDEX)
        finally:
            if out is not None:
                out.close()

    index = written(pages.mapInArrow(run, INDEX), "warc-index")
    return index.withColumn("file", F.concat(F.lit(folder + "/"), "file"))


def read_records(index: DataFrame, gap: int = 1 << 16, most: int = 8 << 20, stretch: int = 16 << 20) -> DataFrame:
    """The records of the given index rows.  Files are dealt in stretches; in each, ranges at most `gap` apart become one read of up to `most` bytes."""
    # a fixed number of partitions: index rows are small, what they stand for is not, so they must not be put together by size
    tasks = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = index.select("file", "offset", "length").withColumn("stretch", F.floor(F.col("offset") / stretch)).repartition(tasks, "file", "stretch").sortWithinPartitions("file", "offset")

    def run(batches):
        from pyarrow.fs import FileSystem

        opened, handle, waiting = None, None, []

        def flush():
            if not waiting:
                return []
            start = waiting[0][0]
            data = handle.read_at(waiting[-1][0] + waiting[-1][1] - start, start)
            found = [parse(zlib.decompress(data[o - start : o - start + n], 31)) for o, n in waiting]
            waiting.clear()
            return found

        try:
            for batch in batches:
                for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))):
                    if waiting and (file != opened or offset - sum(waiting[-1]) > gap or offset + length - waiting[0][0] > most):
                        yield pa.RecordBatch.from_pylist(flush(), _RECORDS)
                    if file != opened:
                        if handle is not None:
                            handle.close()
                        fs, path = FileSystem.from_uri(file)
                        opened, handle = file, fs.open_input_file(path)
                    waiting.append((offset, length))
            yield pa.RecordBatch.from_pylist(flush(), _RECORDS)
        finally:
            if handle is not None:
                handle.close()

    return placed.mapInArrow(run, RECORDS)


def op8(spark, sf_dir: str) -> DataFrame:
    from .common import read

    return read_records(write_archives(read(spark, sf_dir, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
