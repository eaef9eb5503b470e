"""WARC archives of page payloads, written and read as streams, with a chunked record table.

A record never has to be held whole: the writer feeds its compressor from slices of the payload, and the reader turns
each record into rows (record identifier, chunk number, bytes) that carry the digest of the payload so far; the
last chunk of a record carries the digest of all of it. Equal payloads are stored once; other records revisit.
"""

from __future__ import annotations

import hashlib
import zlib
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch

CHUNK = 256 * 1024
SALTS = 16  # one payload may make up a third of all pages
CHUNK_SCHEMA = "record_id string, page_id {id}, url string, record_type string, refers_to {id}, payload_bytes bigint, payload_digest string, chunk int, bytes_so_far bigint, digest_so_far string, last boolean, data binary"


def _open(uri: str):
    """A pyarrow file system and path for a folder that driver and executors share (local path, file:, hdfs:, s3: ...)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if ":" in uri.split("/")[0] else (fs.LocalFileSystem(), uri)


def mark_revisits(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url", least_bytes: int = 1000) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to).

    Among equal payloads (by SHA-1 and length) of at least ``least_bytes``, the largest page id is the response and
    the others revisit it; every row that holds that id is a response. Null ids come last; if a payload's ids are all null its rows are responses. Null payload: empty.
    """
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("bigint")).withColumn("payload_digest", F.sha1("payload"))
    large = rows.filter(F.col("payload_bytes") >= least_bytes)
    repeated = large.groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("owner"), F.count("*").alias("copies")).filter("copies > 1")
    salted = repeated.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(salted, ["payload_digest", "payload_bytes", "salt"], "left")
    revisit = F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner"))
    return joined.select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"), F.when(revisit, F.col("owner")).alias("refers_to"),
    )


def _quoted(page_id) -> str:
    """An id as it can stand in a header line, whatever its characters."""
    return quote(str(page_id), safe="")


def _header(row: dict, record_id: str) -> bytes:
    revisit = row["record_type"] == "revisit"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: <{record_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {''.join(row['url'].split())}",
        f"WARC-Payload-Digest: sha1:{row['payload_digest']}",
        f"X-Payload-Length: {row['payload_bytes']}",
        f"Content-Length: {0 if revisit else row['payload_bytes']}",
    ]
    if row["page_id"] is not None:
        lines.append(f"X-Page-ID: {_quoted(row['page_id'])}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{_quoted(row['refers_to'])}>", f"X-Refers-To-Page-ID: {_quoted(row['refers_to'])}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def write_archives(records: DataFrame, folder: str, file_bytes: int = 256 << 20, level: int = 1) -> DataFrame:
    """Write records of ``mark_revisits`` to gzip-per-record WARC files; (path, records, bytes), one row per file.

    Each task writes files of about ``file_bytes`` under a name of its attempt and renames them when complete, so
    a task run twice leaves the same files. ``folder`` must be shared by driver and executors.
    """

    def run(batches):
        store, base = _open(folder)
        store.create_dir(base, recursive=True)
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        number, count, out, temp = 0, 0, None, None

        def finish():
            size = out.tell()
            out.close()
            final = f"{base}/part-{part:06d}-{number:05d}.warc.gz"
            store.move(temp, final)
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{final.rsplit('/', 1)[1]}"], "records": [count], "bytes": [size]})

        for batch in batches:
            meta = batch.drop_columns(["payload"])
            payloads = batch.column("payload")
            for i in range(batch.num_rows):
                if out is None:
                    temp = f"{base}/.{part}-{number}-{attempt}.tmp"
                    out, count = store.open_output_stream(temp), 0
                row = {k: meta.column(k)[i].as_py() for k in meta.schema.names}
                owner = _quoted(row["page_id"]) if row["page_id"] is not None else f"null-{part}-{number}-{count}"
                gz = zlib.compressobj(level, wbits=31)
                out.write(gz.compress(_header(row, f"urn:page:{owner}")))
                if row["record_type"] == "response":
                    body = memoryview(payloads[i].as_buffer())
                    for at in range(0, len(body), CHUNK):
                        out.write(gz.compress(body[at : at + CHUNK]))
                out.write(gz.compress(b"\r\n\r\n") + gz.flush())
                count += 1
                if out.tell() >= file_bytes:
                    yield finish()
                    number, out = number + 1, None
        if out is not None:
            yield finish()

    return records.mapInArrow(run, "path string, records bigint, bytes bigint")


class _Inflated:
    """Reads the concatenated gzip members of a stream, a little at a time."""

    def __init__(self, stream):
        self.stream, self.gz, self.buffer = stream, zlib.decompressobj(wbits=31), bytearray()

    def more(self) -> bool:
        while True:
            raw = self.gz.unused_data if self.gz.eof else self.gz.unconsumed_tail
            raw = raw or self.stream.read(64 * 1024)
            if not raw:
                return False
            if self.gz.eof:
                self.gz = zlib.decompressobj(wbits=31)
            got = self.gz.decompress(raw, CHUNK)
            if got:
                self.buffer += got
                return True

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n:
            if not self.more():
                raise ValueError("archive ends within a record")
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out

    def header(self) -> dict[str, str] | None:
        while (end := self.buffer.find(b"\r\n\r\n")) < 0:
            if not self.more():
                if self.buffer:
                    raise ValueError("archive ends within a header")
                return None
        lines = self.take(end + 4).decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        return dict(line.split(": ", 1) for line in lines[1:] if line)


def record_chunks(stream, chunk: int = CHUNK):
    """Yield the chunked record table of an opened archive as dictionaries; an empty payload gives one empty chunk."""
    source = _Inflated(stream)
    while (head := source.header()) is not None:
        length, sha, done, number = int(head["Content-Length"]), hashlib.sha1(), 0, 0
        page, refers = (None if v is None else unquote(v) for v in (head.get("X-Page-ID"), head.get("X-Refers-To-Page-ID")))
        while True:
            data = source.take(min(chunk, length - done))
            sha.update(data)
            done += len(data)
            yield {
                "record_id": head["WARC-Record-ID"][1:-1], "page_id": page, "url": head.get("WARC-Target-URI", ""), "record_type": head["WARC-Type"], "refers_to": refers,
                "payload_bytes": int(head["X-Payload-Length"]), "payload_digest": head["WARC-Payload-Digest"].removeprefix("sha1:"),
                "chunk": number, "bytes_so_far": done, "digest_so_far": sha.hexdigest(), "last": done == length, "data": data,
            }
            number += 1
            if done == length:
                break
        source.take(4)


def read_archives(files: DataFrame, id_type: str = "bigint", chunk: int = CHUNK, with_data: bool = True) -> DataFrame:
    """The chunked record table of the archives named in column ``path``; without ``data`` the bytes are left out."""

    def rows(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, name = _open(path)
                with store.open_input_stream(name, compression=None) as stream:
                    for row in record_chunks(stream, chunk):
                        if not with_data:
                            row["data"] = None
                        yield row

    schema = CHUNK_SCHEMA.format(id="string")
    names = [c.split()[0] for c in schema.split(", ")]
    types = pa.schema([("record_id", pa.string()), ("page_id", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("chunk", pa.int32()), ("bytes_so_far", pa.int64()), ("digest_so_far", pa.string()), ("last", pa.bool_()), ("data", pa.binary())])

    def run(batches):
        held, size = [], 0
        for row in rows(batches):
            held.append(row)
            size += 200 + len(row["data"] or b"")
            if size > 4 << 20:
                yield pa.RecordBatch.from_pylist(held, schema=types)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=types)

    out = files.mapInArrow(run, schema)
    return out.select(*[F.col(c).cast(id_type).alias(c) if c in ("page_id", "refers_to") else F.col(c) for c in names])


def archive(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url", least_bytes: int = 1000, with_data: bool = False) -> DataFrame:
    """Write all pages as WARC records to the shared folder and read the archives back as a chunked record table.

    One record per row; repeated rows give repeated records. Null payloads are empty, null urls blank. Ids may be strings of any characters. An empty
    table gives no rows.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    marked = mark_revisits(pages, id_col, payload_col, url_col, least_bytes)
    manifest = scratch.put(write_archives(marked, scratch.path("archives")), "manifest")
    files = manifest.select("path").repartition(max(1, manifest.count()), "path")
    return read_archives(files, pages.schema[id_col].dataType.simpleString(), with_data=with_data)
