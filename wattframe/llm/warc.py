"""WARC archives: whole-stream gzip files rewritten with a gzip member for each record and an offset index beside them."""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattframe.llm.common import new_folder
from wattframe.session import stage

#: Payload bytes after which a task begins another file, bytes inflated at a time, and bytes of a file read by a task at once.
FILE_BYTES = 128 << 20
CHUNK = 1 << 20
READ_BYTES = 8 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"
INDEX = "file string, offset long, length long, record_id string, record_type string"


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a shared folder (a URI or a plain path), and the path there."""
    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(record: str | None) -> int | None:
    number = record.removeprefix("<urn:page:").removesuffix(">") if record else ""
    return int(number) if number else None


def _one_line(value: str) -> str:
    return " ".join(value.split())


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record: an HTTP response, or a revisit that has the HTTP headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_one_line(url)}")
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; the last of a repeated one counts."""
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if ":" in x)}


def write_streams(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write records (page_id, url, payload, digest, refers_to, revisit) as WARC files of one gzip stream each.

    A task writes files under names of its own, so a task run again never meets an earlier run's file; the
    returned names (file) are those of runs that ended well, and are checkpointed.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = opened(folder)
        store.create_dir(path)
        out, name, squeeze, size = None, "", None, 0
        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to", "revisit")]
            for i in range(batch.num_rows):
                if out is None:
                    name, squeeze, size = f"whole-{uuid.uuid4().hex}.warc.gz", zlib.compressobj(6, zlib.DEFLATED, 31), 0
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                page, url, payload, digest, refers, revisit = (c[i].as_py() for c in columns)
                out.write(squeeze.compress(record(page, url, payload, digest, refers, revisit)))
                size += len(payload)
                if size >= file_bytes:
                    out.write(squeeze.flush())
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_arrays([pa.array([name])], ["file"])
        if out is not None:
            out.write(squeeze.flush())
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name])], ["file"])

    return stage(pages.select("page_id", "url", "payload", "digest", "refers_to", "revisit").mapInArrow(write, "file string"))


class Inflated:
    """The inflated bytes of a gzip file of any number of members, read forward in bounded steps."""

    def __init__(self, source: pa.NativeFile):
        self.source, self.inflate, self.ready = source, zlib.decompressobj(31), bytearray()

    def _more(self) -> bool:
        data = self.inflate.unconsumed_tail or self.source.read(CHUNK)
        if not data:
            return False
        self.ready += self.inflate.decompress(data, CHUNK)
        while self.inflate.eof:
            rest = self.inflate.unused_data or self.source.read(CHUNK)
            if not rest:
                break
            self.inflate = zlib.decompressobj(31)
            self.ready += self.inflate.decompress(rest, CHUNK)
        return True

    def until(self, mark: bytes) -> bytes:
        """Bytes up to and including the mark; empty at the end."""
        seen = 0
        while (at := self.ready.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.ready)
            if not self._more():
                if self.ready.strip():
                    raise ValueError("a record ends before its headers do")
                return b""
        out = bytes(self.ready[: at + len(mark)])
        del self.ready[: at + len(mark)]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        """The next n bytes, in steps."""
        while n:
            if not self.ready and not self._more():
                raise ValueError("a record ends before its block does")
            part = bytes(self.ready[:n])
            del self.ready[: len(part)]
            n -= len(part)
            if part:
                yield part


def normalise(files: DataFrame, folder: str) -> DataFrame:
    """Rewrite whole-stream files so that each record is a gzip member, with an index file beside each; returns the index.

    A file is inflated once, from front to end; a record passes through in steps, so neither a file nor
    a record has to fit in memory. Index rows: file, offset, length (of the member), record_id, record_type.
    """

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = opened(folder)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                new = f"{uuid.uuid4().hex}.warc.gz"
                rows: list[tuple] = []
                with (
                    store.open_input_stream(f"{path}/{name}", compression=None) as source,
                    store.open_output_stream(f"{path}/{new}", compression=None) as out,
                    store.open_output_stream(f"{path}/{new}.index", compression=None) as index,
                ):
                    stream, offset = Inflated(source), 0
                    while head := stream.until(b"\r\n\r\n"):
                        fields = headers(head.lstrip(b"\r\n"))
                        squeeze, length = zlib.compressobj(6, zlib.DEFLATED, 31), 0
                        parts = [head.lstrip(b"\r\n")]
                        for part in (*parts, *stream.take(int(fields["content-length"])), b"\r\n\r\n"):
                            length += out.write(squeeze.compress(part))
                        length += out.write(squeeze.flush())
                        for _ in stream.take(4):
                            pass
                        row = (new, offset, length, fields.get("warc-record-id"), fields.get("warc-type"))
                        index.write(json.dumps(row).encode() + b"\n")
                        rows.append(row)
                        offset += length
                        if len(rows) >= 10_000:
                            yield _index(rows)
                            rows = []
                if rows:
                    yield _index(rows)

    return stage(files.repartition(files.sparkSession.sparkContext.defaultParallelism, "file").mapInArrow(rewrite, INDEX))


def _index(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)],
        ["file", "offset", "length", "record_id", "record_type"],
    )


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """The index rows of every normalised file of a folder, from the index files."""
    lines = spark.read.text(folder, pathGlobFilter="*.index")
    row = F.from_json("value", "array<string>")
    return lines.select(row.alias("r")).select(
        F.get("r", 0).alias("file"),
        F.get("r", 1).cast("long").alias("offset"),
        F.get("r", 2).cast("long").alias("length"),
        F.get("r", 3).alias("record_id"),
        F.get("r", 4).alias("record_type"),
    )


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """Records read by offset: page_id, url, payload (null for a revisit), payload_bytes, payload_digest, record_type, refers_to.

    The digest of a response is that of the payload as read, and must agree with its header.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = opened(folder)
        name, source = None, None
        for batch in batches:
            files, offsets, lengths = (batch.column(c).to_pylist() for c in ("file", "offset", "length"))
            out, held = [], 0
            for file, offset, length in zip(files, offsets, lengths, strict=True):
                if file != name:
                    if source is not None:
                        source.close()
                    name, source = file, store.open_input_file(f"{path}/{file}")
                source.seek(offset)
                data = zlib.decompress(source.read(length), 31)
                head, _, block = data.partition(b"\r\n\r\n")
                fields = headers(head)
                block = block[: int(fields["content-length"])]
                http, _, payload = block.partition(b"\r\n\r\n")
                digest = fields["warc-payload-digest"].removeprefix("sha1:")
                revisit = fields["warc-type"] == "revisit"
                size = int(headers(http)["content-length"])
                if not revisit and (payload_digest(payload) != digest or len(payload) != size):
                    raise ValueError(f"the payload of {fields['warc-record-id']} differs from its digest")
                out.append(
                    (
                        page_of(fields["warc-record-id"]),
                        fields.get("warc-target-uri"),
                        None if revisit else payload,
                        size,
                        digest,
                        fields["warc-type"],
                        page_of(fields.get("warc-refers-to")),
                    )
                )
                held += len(payload)
                if held > 32 * CHUNK:
                    yield _records(out)
                    out, held = [], 0
            if out:
                yield _records(out)

    runs = index.repartition("file", F.floor(F.col("offset") / READ_BYTES)).sortWithinPartitions("file", "offset")
    return runs.mapInArrow(
        read, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
    )


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64())
    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [payload_digest(p.as_buffer()) for p in batch.column("payload")]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], [*batch.schema.names, "digest"])


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Pages as records: of those with equal payloads of at least `min_bytes` bytes the largest page_id is the response.

    The others revisit it. Smaller payloads are all responses. Null html is an empty payload. Null ids are
    smallest; rows that repeat the winning id are all responses, as are the rows of a payload without any id.
    """
    plain = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        "url",
        F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"),
    ).mapInArrow(_digests, "page_id long, url string, payload binary, digest string")
    size = F.octet_length("payload")
    largest = plain.where(size >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("_largest"))
    joined = plain.join(largest, "digest", "left")
    revisit = F.col("_largest").isNotNull() & (size >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("_largest"))
    return joined.select(
        "page_id", "url", "payload", "digest", F.when(revisit, F.col("_largest")).alias("refers_to"), revisit.alias("revisit")
    )


def archived(pages: DataFrame, min_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Write pages to archives in the shared folder, normalise them, and read every record back."""
    folder = folder or new_folder(pages.sparkSession, "warc")
    files = write_streams(with_revisits(pages, min_bytes), folder)
    return read_records(normalise(files, folder), folder)
