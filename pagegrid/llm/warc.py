"""WARC archives as a Spark data source, and pages written to and read from them.

Every record is a gzip member whose header carries its own length in the extra field ``sl``,
so a reader that does not want a record goes on to the next one without inflating it. Within
a member the WARC headers end at a flush, so they inflate without the payload. Members of
other writers, without that field, are inflated to find their end.

The reader plans one partition per file, parses headers first, takes predicates on the record
type and on the other header columns, and inflates the payload only of records that pass.
A folder that this module wrote holds a list of its committed files; files that lost or
repeated tasks left behind are not in it and are not read.

Defined cases for pages: null html is the empty payload; a null url is left out of the record;
a page without an id is never the smallest of its group unless no page of it has an id. Pages
repeated with the same id and payload are each written as the group's response or revisit. No
pages give an archive without records. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    In,
    InputPartition,
    WriterCommitMessage,
)

from pagegrid.llm.common import spread_lookup

SCHEMA = (
    "page_id bigint, url string, record_type string, refers_to bigint, payload_digest string, "
    "payload_bytes bigint, payload string"
)
#: Every commit leaves a list of its files, under a name of its own that starts so.
COMMITTED = "_files"
#: Bytes after which a task starts its next file, so that no file outgrows a reading task.
FILE_BYTES = 64 << 20
DATE = "1970-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
MAGIC = b"\x1f\x8b"
EXTRA = struct.Struct("<2sHII")
#: Header columns a predicate may be pushed down on.
PUSHED = ("page_id", "url", "record_type", "refers_to", "payload_digest")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}').urn}>"


def member(headers: bytes, block: bytes) -> bytes:
    """One gzip member with its length in the header; the headers end at a flush."""
    deflate = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = deflate.compress(headers) + deflate.flush(zlib.Z_FULL_FLUSH)
    body += deflate.compress(block) + deflate.flush()
    raw = len(headers) + len(block)
    checksum = zlib.crc32(block, zlib.crc32(headers))
    size = 10 + 2 + EXTRA.size + len(body) + 8
    head = MAGIC + b"\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H", EXTRA.size)
    extra = EXTRA.pack(b"sl", 8, size, raw)
    return head + extra + body + struct.pack("<II", checksum, raw & 0xFFFFFFFF)


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to, revisit: bool) -> bytes:
    """The record of one page: its response, or a revisit of an equal payload."""
    digest = payload_digest(payload)
    block = b"" if revisit else HTTP % len(payload) + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Payload-Length", str(len(payload))),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if page_id is not None:
        fields.append(("X-Page-Id", str(page_id)))
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="%/:?#[]@!$&'()*+,;=~-._")))
        if fields[-1][1] != url:
            fields.append(("X-Url", json.dumps(url)))
    if revisit:
        fields += [("WARC-Profile", REVISIT)]
        if refers_to is not None:
            fields += [
                ("WARC-Refers-To", record_id(refers_to, digest)),
                ("X-Refers-To-Page", str(refers_to)),
            ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return member(head.encode(), block + b"\r\n\r\n")


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def commit_lists(store: fs.FileSystem, folder: str) -> list[str]:
    """Paths of the lists of files that commits have left in a folder."""
    found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted(x.path for x in found if x.base_name.startswith(COMMITTED))


# Writing ---------------------------------------------------------------------------------------


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, file_bytes: int, overwrite: bool = False) -> None:
        self.path, self.file_bytes, self.overwrite = path, file_bytes, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """Each task writes files under names of its own; only those it reports count."""
        files, out = [], None
        store, folder = _open(self.path)
        store.create_dir(folder, recursive=True)
        try:
            for batch in iterator:
                columns = ("page_id", "url", "payload", "refers_to", "revisit")
                for row in zip(*(batch.column(k).to_pylist() for k in columns), strict=True):
                    page_id, url, payload, refers_to, revisit = row
                    if out is None or out.tell() >= self.file_bytes:
                        if out is not None:
                            out.close()
                        files.append(f"pages-{uuid.uuid4().hex}.warc.gz")
                        out = store.open_output_stream(f"{folder}/{files[-1]}", compression=None)
                    out.write(page_record(page_id, url, payload.encode(), refers_to, revisit))
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = _open(self.path)
        store.create_dir(folder, recursive=True)
        files = sorted(f for m in messages if m is not None for f in m.files)
        earlier = commit_lists(store, folder) if self.overwrite else []
        name = f"{folder}/{COMMITTED}-{uuid.uuid4().hex}.json"
        with store.open_output_stream(name, compression=None) as out:
            out.write(json.dumps(files).encode())
        # Files in no list are never read.
        for path in earlier:
            store.delete_file(path)

    def abort(self, messages: list[Written | None]) -> None:
        """Nothing is committed: the files are in no list and are never read."""


# Reading ---------------------------------------------------------------------------------------


@dataclass
class ArchiveFile(InputPartition):
    path: str


class Reader:
    """Records of one file, headers first."""

    def __init__(self, file) -> None:
        self.file, self.buffer, self.at = file, b"", 0

    def _fill(self, size: int) -> None:
        """Have ``size`` bytes from ``at`` on in the buffer, if the file has them."""
        if len(self.buffer) - self.at < size:
            self.buffer = self.buffer[self.at :] + self.file.read(max(size, 1 << 16))
            self.at = 0

    def _skip(self, size: int) -> None:
        beyond = size - (len(self.buffer) - self.at)
        if beyond > 0:
            self.file.seek(self.file.tell() + beyond)
            self.buffer, self.at = b"", 0
        else:
            self.at += size

    def records(self, wanted) -> Iterator[tuple[dict[str, str], bytes | None]]:
        """(headers, block) of every record, block None where ``wanted(headers)`` is not true."""
        while True:
            self._fill(10 + 2 + EXTRA.size)
            start = self.buffer[self.at : self.at + 12 + EXTRA.size]
            if not start:
                return
            size = 0
            if start[:2] == MAGIC and start[3] & 4 and start[12:14] == b"sl":
                size = EXTRA.unpack(start[12:])[2]
            yield from self._sized(size, wanted) if size else self._foreign(wanted)

    def _sized(self, size: int, wanted):
        skip = 12 + EXTRA.size
        inflate, head, taken = zlib.decompressobj(-15), b"", skip
        while b"\r\n\r\n" not in head:
            step = min(1024, size - 8 - taken)
            if step <= 0:
                raise ValueError("a record's headers do not end")
            self._fill(taken + step)
            head += inflate.decompress(self.buffer[self.at + taken : self.at + taken + step])
            taken += step
        headers, _, rest = head.partition(b"\r\n\r\n")
        fields = parse_headers(headers)
        block = None
        if wanted(fields):
            self._fill(size)
            rest += inflate.decompress(self.buffer[self.at + taken : self.at + size - 8])
            block = rest[: int(fields["content-length"])]
        self._skip(size)
        yield fields, block

    def _foreign(self, wanted):
        """A member without a length: inflate to its end; it may hold several records."""
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:
            self._fill(1)
            if self.at >= len(self.buffer):
                raise ValueError("a record's member does not end")
            parts.append(inflate.decompress(self.buffer[self.at :]))
            self.at = len(self.buffer)
        self.buffer, self.at = inflate.unused_data + self.buffer[self.at :], 0
        data = b"".join(parts)
        while data.strip(b"\r\n"):
            headers, _, rest = data.lstrip(b"\r\n").partition(b"\r\n\r\n")
            fields = parse_headers(headers)
            length = int(fields["content-length"])
            yield fields, rest[:length] if wanted(fields) else None
            data = rest[length:]


def parse_headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def _number(text: str | None) -> int | None:
    return None if text is None else int(text)


def columns_of(headers: dict[str, str]) -> dict:
    """The header columns of one record."""
    url = headers.get("warc-target-uri")
    digest = headers.get("warc-payload-digest")
    return {
        "page_id": _number(headers.get("x-page-id")),
        "url": json.loads(headers["x-url"]) if "x-url" in headers else url,
        "record_type": headers.get("warc-type"),
        "refers_to": _number(headers.get("x-refers-to-page")),
        "payload_digest": digest and digest.removeprefix("sha1:"),
        "payload_bytes": _number(headers.get("x-payload-length")),
    }


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: str) -> None:
        self.path, self.payload, self.tests = path, payload, []

    def pushFilters(self, filters):
        """Take equality and membership tests on header columns."""
        for test in filters:
            if isinstance(test, (EqualTo, In)) and len(test.attribute) == 1 and test.attribute[0] in PUSHED:
                values = test.value if isinstance(test, In) else (test.value,)
                self.tests.append((test.attribute[0], frozenset(values) - {None}))
            else:
                yield test

    def partitions(self) -> list[ArchiveFile]:
        store, folder = _open(self.path)
        lists, names = commit_lists(store, folder), []
        for path in lists:
            with store.open_input_stream(path, compression=None) as file:
                names += json.loads(file.read())
        if not lists:
            found = store.get_file_info(fs.FileSelector(folder))
            names = sorted(x.base_name for x in found if x.base_name.endswith(".warc.gz"))
        return [ArchiveFile(f"{self.path.rstrip('/')}/{name}") for name in names] or [ArchiveFile("")]

    def read(self, partition: ArchiveFile) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = {"bigint": pa.int64(), "string": pa.string()}
        schema = pa.schema([(n, kinds[x.split()[1]]) for n, x in zip(names, SCHEMA.split(", "), strict=True)])
        last: dict = {}

        def passes(headers: dict[str, str]) -> bool:
            last["row"] = row = columns_of(headers)
            last["ok"] = all(row[name] in values for name, values in self.tests)
            return last["ok"] and self.payload != "none" and row["record_type"] == "response"

        store, path = _open(partition.path)
        rows, held = [], 0
        with store.open_input_file(path) as file:
            for _, block in Reader(file).records(passes):
                if not last["ok"]:
                    continue
                row = last["row"] | {"payload": None}
                if block is not None:
                    body = block.partition(b"\r\n\r\n")[2]
                    if payload_digest(body) != row["payload_digest"]:
                        raise ValueError(f"payload of page {row['page_id']} differs from its digest")
                    row["payload_bytes"] = len(body)
                    if self.payload == "text":
                        row["payload"] = body.decode("utf-8", "replace")
                        held += len(body)
                rows.append(row)
                if len(rows) >= 4096 or held > 16 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class WarcSource(DataSource):
    """Format ``warc``. Options: path; payload = text, check (read and verified, not returned)
    or none (never inflated); file_bytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "text"))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], int(self.options.get("file_bytes", FILE_BYTES)), overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to the session, with predicate pushdown for such sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def page_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, refers_to, revisit: what each page's record will be.

    Of equal payloads of at least ``min_bytes`` bytes the page with the smallest id keeps the
    payload. Payloads are compared by SHA-256 and size; only classes of several pages are
    looked up, and the pages of a hot class are dealt out by salt.
    """
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"),
    )
    keyed = rows.withColumn("_sha", F.sha2("payload", 256)).withColumn(
        "_size", F.octet_length("payload")
    )
    repeated = (
        keyed.where(F.col("_size") >= min_bytes)
        .groupBy("_sha", "_size")
        .agg(F.min("page_id").alias("_first"), F.count("*").alias("_pages"))
        .where("_pages > 1")
    )
    salt = F.xxhash64("page_id", "url")
    found = spread_lookup(keyed, repeated, ["_sha", "_size"], salt)
    revisit = F.col("_pages").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return found.select(
        "page_id",
        "url",
        "payload",
        F.when(revisit, F.col("_first")).alias("refers_to"),
        revisit.alias("revisit"),
    )


def write_pages(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write one record per page to the archive folder ``path``."""
    register(pages.sparkSession)
    page_records(pages, min_bytes).write.format("warc").mode("append").save(path)


def read_records(spark: SparkSession, path: str, payload: str = "text") -> DataFrame:
    """Records of an archive folder; filter on header columns to skip payloads."""
    register(spark)
    return spark.read.format("warc").option("payload", payload).load(path)
