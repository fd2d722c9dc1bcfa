"""WARC archives: a writer that runs in tasks and a Python data source that reads them."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    StringStartsWith,
)

from labelworks.llm.common import new_path, prepare, written

SPLIT_BYTES = 64 << 20
READ_BYTES = 4 << 20
DATE = "1970-01-01T00:00:00Z"  # pages carry no time of their own
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = (
    "warc_type string, record_id string, target_uri string, warc_date string, payload_digest string, "
    "payload_length long, headers map<string, string>, payload binary"
)
# Columns that are a header each; predicates on them are decided before a payload is decoded.
HEADER_OF = {
    "warc_type": "warc-type",
    "record_id": "warc-record-id",
    "target_uri": "warc-target-uri",
    "warc_date": "warc-date",
    "payload_digest": "warc-payload-digest",
}


def filesystem(path: str):
    """The store of a path and the path in it; any store that pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _line(value: str) -> str:
    """A header's value on one line."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(page_id, url, payload: bytes, refers_to) -> bytes:
    """One record. A revisit (``refers_to`` not null) has no payload, but its length and digest."""
    revisit = refers_to is not None
    http = (
        f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if revisit else http + payload
    digest = sha1_base32(payload)
    name = f"urn:page:{page_id}" if page_id is not None else f"urn:sha1:{digest}"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{name}>"]
    head.append(f"WARC-Date: {DATE}")
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    head.append(f"Payload-Length: {len(payload)}")
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def storing(folder: str):
    def store(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Writes one archive and its index (where each compressed record begins) per task. They get
        their names when complete, and a task that runs again replaces them."""
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        task = TaskContext.get()
        name = f"{root}/part-{task.partitionId():06d}.warc.gz"
        own = f"{root}/_{task.taskAttemptId()}.tmp"
        starts, at = [0], 0
        with fs.open_output_stream(own) as out:
            for batch in batches:
                for page_id, url, html, refers_to in zip(
                    batch["page_id"], batch["url"], batch["html"], batch["refers_to"]
                ):
                    raw = record(
                        None if pd.isna(page_id) else int(page_id),
                        url,
                        (html or "").encode("utf-8", "surrogatepass"),
                        None if pd.isna(refers_to) else int(refers_to),
                    )
                    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                    member = packer.compress(raw) + packer.flush()
                    out.write(member)
                    at += len(member)
                    starts.append(at)
        if len(starts) == 1:
            fs.delete_file(own)
            return
        with fs.open_output_stream(own + ".idx") as out:
            out.write(np.array(starts, "<i8").tobytes())
        fs.move(own + ".idx", name + ".idx")
        fs.move(own, name)
        yield pd.DataFrame({"file": [name], "records": [len(starts) - 1], "bytes": [at]})

    return store


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes a record per page (page_id, url, html) and returns (file, records, bytes).

    Of pages with equal payloads that with the smallest id is a response and the others revisit it.
    Null html is an empty payload; an empty payload is a payload like any other. Null ids come last; in a
    group without ids all are responses, and rows that repeat the smallest id are responses too.
    """
    prepare(pages.sparkSession)
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html"
    ).withColumn("digest", F.sha2(F.coalesce("html", F.lit("")), 256))
    firsts = (
        rows.groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("first")).filter("n > 1")
    )
    refers = F.when(F.col("page_id").eqNullSafe(F.col("first")), None).otherwise(F.col("first"))
    decided = rows.join(firsts.select("digest", "first"), "digest", "left").select(
        "page_id", "url", "html", refers.alias("refers_to")
    )
    return written(decided.mapInPandas(storing(folder), "file string, records long, bytes long"), "warc-files")


@dataclass
class Span(InputPartition):
    """Some whole records of a file; ``end`` None: all of them, found by reading on."""

    file: str
    starts: bytes | None


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.path = options["path"]
        self.verify = options.get("verify", "false").lower() == "true"
        self.columns = columns
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]):
        """Takes equality, membership and prefixes of header columns; returns the others."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in HEADER_OF and isinstance(f, EqualTo):
                self.tests.append((column, "in", frozenset([f.value])))
            elif column in HEADER_OF and isinstance(f, In):
                self.tests.append((column, "in", frozenset(f.value)))
            elif column in HEADER_OF and isinstance(f, StringStartsWith):
                self.tests.append((column, "starts", f.value))
            else:
                yield f

    def partitions(self):
        """Records of about ``SPLIT_BYTES`` for files with an index; whole files else."""
        from pyarrow import fs as pafs

        fs, root = filesystem(self.path)
        found = fs.get_file_info(pafs.FileSelector(root, recursive=True))
        names = {f.path for f in found if f.is_file}
        spans = []
        for name in sorted(n for n in names if n.endswith((".warc", ".warc.gz"))):
            if name + ".idx" not in names:
                spans.append(Span(name, None))
                continue
            with fs.open_input_stream(name + ".idx") as f:
                starts = np.frombuffer(f.read(), "<i8")
            at = 0
            while at < len(starts) - 1:
                to = max(at + 1, int(np.searchsorted(starts, starts[at] + SPLIT_BYTES, "right")) - 1)
                spans.append(Span(name, starts[at : to + 1].tobytes()))
                at = to
        return spans or [Span("", None)]

    def _wanted(self, row: dict) -> bool:
        for column, kind, value in self.tests:
            have = row[column]
            if have is None or (have not in value if kind == "in" else not have.startswith(value)):
                return False
        return True

    def _row(self, head: bytes) -> dict:
        headers = {}
        for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            headers[name.strip().lower()] = value.strip()
        row = {c: headers.get(h) for c, h in HEADER_OF.items()}
        row["record_id"] = row["record_id"] and row["record_id"].strip("<>")
        row["payload_digest"] = row["payload_digest"] and row["payload_digest"].removeprefix("sha1:")
        row["headers"] = headers
        length = headers.get("payload-length")
        row["payload_length"] = int(length) if length is not None else None
        row["payload"] = None
        return row

    def _finish(self, row: dict, block: bytes):
        """Adds the payload of a response, and compares its digest with the header's."""
        if row["warc_type"] == "response":
            payload = block.partition(b"\r\n\r\n")[2]
        elif row["warc_type"] == "revisit":
            return
        else:
            payload = block
        if self.verify and row["payload_digest"] is not None and sha1_base32(payload) != row["payload_digest"]:
            raise ValueError(f"{row['record_id']}: the payload does not have the digest of its header")
        row["payload"] = payload
        row["payload_length"] = len(payload)

    def _needs_block(self, row: dict) -> bool:
        if row["warc_type"] == "revisit":
            return False
        unknown = "payload_length" in self.columns and row["payload_length"] is None
        return self.verify or "payload" in self.columns or unknown

    def read(self, partition: Span):
        if not partition.file:
            return
        fs, _ = filesystem(self.path)
        with fs.open_input_file(partition.file) as f:
            for row in self._indexed(f, partition.starts) if partition.starts else self._scanned(f, partition.file):
                yield tuple(row[c] for c in self.columns)

    def _indexed(self, f, starts: bytes):
        """Members at known places: the headers are inflated first, the rest only where it is needed."""
        bounds = np.frombuffer(starts, "<i8").tolist()
        i = 0
        while i < len(bounds) - 1:
            j = i + 1
            while j < len(bounds) - 1 and bounds[j + 1] - bounds[i] <= READ_BYTES:
                j += 1
            f.seek(bounds[i])
            data = f.read(bounds[j] - bounds[i])
            for k in range(i, j):
                inflate = zlib.decompressobj(31)
                raw = inflate.decompress(data[bounds[k] - bounds[i] : bounds[k + 1] - bounds[i]], 2048)
                while b"\r\n\r\n" not in raw and inflate.unconsumed_tail:
                    raw += inflate.decompress(inflate.unconsumed_tail, 8192)
                head, _, block = raw.partition(b"\r\n\r\n")
                row = self._row(head)
                if not self._wanted(row):
                    continue
                if self._needs_block(row):
                    block += inflate.decompress(inflate.unconsumed_tail) if inflate.unconsumed_tail else b""
                    self._finish(row, block[: int(row["headers"].get("content-length", 0))])
                yield row
            i = j

    def _scanned(self, f, name: str):
        """Archives without an index, read from the start; unwanted blocks are passed over."""
        stream = Inflated(f) if name.endswith(".gz") else f
        while True:
            head = b""
            while not head.endswith(b"\r\n\r\n"):
                line = _read_line(stream)
                if not line:
                    return
                if head or line.strip():
                    head += line
            row = self._row(head[:-4])
            length = int(row["headers"].get("content-length", 0))
            if self._wanted(row):
                if self._needs_block(row):
                    self._finish(row, stream.read(length))
                else:
                    stream.seek(length, 1)
                yield row
            else:
                stream.seek(length, 1)


def _read_line(stream) -> bytes:
    out = bytearray()
    while not out.endswith(b"\n"):
        c = stream.read(1)
        if not c:
            break
        out += c
    return bytes(out)


class Inflated:
    """The text of a row of gzip members, read forward in bounded memory."""

    def __init__(self, f):
        self.f, self.z, self.rest, self.ready = f, zlib.decompressobj(31), b"", b""

    def read(self, n: int) -> bytes:
        parts, missing = [], n
        while missing:
            if not self.ready:
                if self.z.eof:
                    self.rest, self.z = self.z.unused_data, zlib.decompressobj(31)
                data = self.rest or self.f.read(1 << 16)
                if not data:
                    break
                self.ready = self.z.decompress(data, 1 << 20)
                self.rest = self.z.unconsumed_tail
                continue
            parts.append(self.ready[:missing])
            self.ready = self.ready[len(parts[-1]) :]
            missing -= len(parts[-1])
        return b"".join(parts)

    def seek(self, n: int, whence: int = 1) -> None:
        while n > 0 and (part := self.read(min(n, 1 << 20))):
            n -= len(part)


class WarcDataSource(DataSource):
    """``spark.read.format("warc").load(folder)``.

    Columns that a schema leaves out are not decoded: without ``payload`` only headers are read. Option
    ``verify``: payloads are decoded and compared with the digests in their headers. A folder without
    archives has no rows.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options), schema.fieldNames())


def read_archives(spark: SparkSession, folder: str, schema: str | None = None, verify: bool = False) -> DataFrame:
    prepare(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
    reader = spark.read.format("warc").option("verify", str(verify).lower())
    return (reader.schema(schema) if schema else reader).load(folder)


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Writes pages as archives to the shared folder and reads them back: page_id, payload_bytes,
    payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    write_archives(pages, folder)
    schema = "warc_type string, payload_digest string, payload_length long, headers map<string, string>"
    back = read_archives(spark, folder, schema, verify=True)
    back = back.filter(F.col("warc_type").isin("response", "revisit"))
    refers = F.regexp_extract(F.element_at("headers", "warc-refers-to"), r"^<urn:page:(-?\d+)>$", 1)
    return back.select(
        F.element_at("headers", "page-id").cast("long").alias("page_id"),
        F.col("payload_length").alias("payload_bytes"),
        "payload_digest",
        F.col("warc_type").alias("record_type"),
        F.when(F.col("warc_type") == "revisit", refers.cast("long")).alias("refers_to"),
    )
