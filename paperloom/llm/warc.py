"""WARC archives: a writer on Spark's text sink and a Python data source that reads them.

A record is one line of the text sink, with CR LF CR LF as the line separator, which is just what
ends a WARC record; so records are written in the JVM, to any file system Spark knows, under its
commit protocol. The reader plans a partition for each file or few small files, takes record-type
and header predicates, parses a record's headers first, and seeks past the blocks it needn't decode.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, StringStartsWith

from .shared import fresh_path, written

#: Bytes of archive that one read partition takes, unless a file alone is larger.
PARTITION_BYTES = 32 << 20
#: Revisits that are broadcast to the writers, 24 bytes each; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000
_DATE = "2000-01-01T00:00:00Z"

# --- writer


def base32_sha1(payload: Column) -> Column:
    """Upper-case base 32 of a binary's SHA-1, 40 bits at a time."""
    digits = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digits, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _urn(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(">"))


def write_warc(pages: DataFrame, path: str) -> None:
    """A WARC/1.1 record for each row of `pages` (page_id, url, html, any others); the payload is the html's UTF-8.

    Of equal payloads the row with the largest page_id is written as a response, the others as revisits
    of it, without payload. A null html is an empty payload, and empty payloads are equal like any.
    A null page_id is below all; repeated rows with the largest page_id are all responses. A null url
    has no target header; line breaks in one are percent-encoded.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", base32_sha1(payload).alias("digest"), F.octet_length(payload).alias("bytes"))
    keys = written(rows.select("page_id", "digest"), "warc-digests")
    largest = keys.groupBy("digest").agg(F.max("page_id").alias("refers"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisits = written(keys.join(largest, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers"))).distinct(), "warc-revisits")
    other = revisits.select(F.col("page_id").alias("__id"), F.col("digest").alias("__digest"), "refers")
    if revisits.count() <= BROADCAST_ROWS:
        other = F.broadcast(other)
    rows = rows.join(other, (F.col("digest") == F.col("__digest")) & F.col("page_id").eqNullSafe(F.col("__id")), "left")
    kind = F.when(F.col("refers").isNull(), "response").otherwise("revisit")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes"), F.lit("\r\n\r\n"))
    block = F.when(kind == "response", F.concat(http, F.coalesce("html", F.lit("")))).otherwise(http)
    url = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", _urn(F.col("page_id"))),
        line("WARC-Date", F.lit(_DATE)),
        F.coalesce(line("WARC-Target-URI", url), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(kind == "revisit", F.concat(line("WARC-Refers-To", _urn(F.col("refers"))), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block)),
        F.lit("\r\n"),
    )
    rows.select(F.concat(head, block).alias("value")).write.text(path, lineSep="\r\n\r\n")


# --- reader

#: Column of the data source -> the header that it comes from.
_HEADERS = {
    "record_type": "warc-type",
    "record_id": "warc-record-id",
    "date": "warc-date",
    "target_uri": "warc-target-uri",
    "payload_digest": "warc-payload-digest",
    "refers_to": "warc-refers-to",
}
_SCHEMA = ", ".join(f"{c} string" for c in _HEADERS) + ", content_length long, payload_length long, payload binary"


def _test(f: Filter):  # noqa: ANN202
    """A predicate on the header columns' values, or None if this filter isn't one of those that are taken."""
    if len(getattr(f, "attribute", ())) != 1 or f.attribute[0] not in _HEADERS:
        return None
    c = f.attribute[0]
    if isinstance(f, EqualTo):
        return lambda row: row[c] is not None and row[c] == f.value
    if isinstance(f, EqualNullSafe):
        return lambda row: row[c] == f.value
    if isinstance(f, In):
        return lambda row: row[c] is not None and row[c] in f.value
    if isinstance(f, IsNull):
        return lambda row: row[c] is None
    if isinstance(f, IsNotNull):
        return lambda row: row[c] is not None
    if isinstance(f, StringStartsWith):
        return lambda row: row[c] is not None and row[c].startswith(f.value)
    return None


class WarcPartition(InputPartition):
    def __init__(self, files: list[str]):
        super().__init__(files)


class WarcReader(DataSourceReader):
    """Options: `payload` (none, the default: not decoded; full), `verify` (true: a response's payload
    digest is computed and must agree with its header)."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = options.get("payload", "none")
        self.verify = options.get("verify", "false").lower() == "true"
        self.tests: list = []
        self.bytes = int(options.get("partitionbytes", PARTITION_BYTES))

    def pushFilters(self, filters: list[Filter]):  # noqa: ANN201, N802
        for f in filters:
            if test := _test(f):
                self.tests.append(test)
            else:
                yield f

    def partitions(self) -> list[WarcPartition]:
        fs, root = pafs.FileSystem.from_uri(self.path)
        info = fs.get_file_info(root)
        found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(root, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File and f.size and f.base_name[0] not in "._")
        groups: list[list[str]] = []
        held = self.bytes
        for path, size in files:
            if held + size > self.bytes:
                groups.append([])
                held = 0
            groups[-1].append(path)
            held += size
        return [WarcPartition(g) for g in groups] or [WarcPartition([])]

    def read(self, partition: WarcPartition) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([*((c, pa.string()) for c in _HEADERS), ("content_length", pa.int64()), ("payload_length", pa.int64()), ("payload", pa.binary())])
        rows: list[dict] = []
        size = 0
        fs = pafs.FileSystem.from_uri(self.path)[0]
        for path in partition.value:
            for row in self.records(fs, path):
                rows.append(row)
                size += 500 + len(row["payload"] or b"")
                if size > 4 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema)

    def records(self, fs: pafs.FileSystem, path: str) -> Iterator[dict]:
        raw = fs.open_input_file(path)
        packed = path.endswith(".gz")
        with io.BufferedReader(gzip.GzipFile(fileobj=raw) if packed else raw, 1 << 20) as file:
            while True:
                line = file.readline()
                while line in (b"\r\n", b"\n"):  # the end of the record before
                    line = file.readline()
                if not line:
                    return
                if not line.startswith(b"WARC/"):
                    raise ValueError(f"{path}: no WARC record at byte {file.tell() - len(line)}")
                head: dict[str, str] = {}
                while (line := file.readline()) not in (b"\r\n", b"\n", b""):
                    name, _, value = line.decode("utf-8", "replace").partition(":")
                    head[name.strip().lower()] = value.strip()
                if not head.get("content-length", "").isdigit():
                    raise ValueError(f"{path}: a WARC record before byte {file.tell()} doesn't say how long it is")
                left = int(head["content-length"])
                row: dict = {c: head.get(h) for c, h in _HEADERS.items()}
                if not all(test(row) for test in self.tests):
                    file.seek(left, 1)
                    continue
                row |= {"content_length": left, "payload_length": None, "payload": None}
                http = head.get("content-type", "").startswith("application/http")
                if http:
                    while left and (line := file.readline(left)):
                        left -= len(line)
                        if line in (b"\r\n", b"\n"):
                            break
                        if m := re.match(rb"content-length:\s*(\d+)", line, re.I):
                            row["payload_length"] = int(m[1])
                else:
                    row["payload_length"] = left
                check = self.verify and row["record_type"] == "response" and (row["payload_digest"] or "").startswith("sha1:")
                if self.payload == "full" or check:
                    body = file.read(left)
                    if check and base64.b32encode(hashlib.sha1(body).digest()).decode() != row["payload_digest"][5:]:
                        raise ValueError(f"{path}: {row['record_id']} isn't what its digest says")
                    if check or row["record_type"] != "revisit":
                        row["payload_length"] = len(body)
                    if self.payload == "full":
                        row["payload"] = body
                else:
                    file.seek(left, 1)
                yield row


class WarcDataSource(DataSource):
    """`spark.read.format("warc").load(path)`, path a file or folder that all executors can open."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> WarcReader:  # noqa: ANN001
        return WarcReader(dict(self.options))


def read_warc(spark: SparkSession, path: str, payload: str = "none", verify: bool = False) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
    return spark.read.format("warc").option("payload", payload).option("verify", str(verify).lower()).load(path)


def round_trip(pages: DataFrame) -> DataFrame:
    """`page_id, payload_bytes, payload_digest, record_type, refers_to` per row of `pages`, from archives
    written and read again; every response's payload is read and held against its digest. An
    empty table gives none."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_warc(pages, path)
    page = lambda c: F.nullif(F.regexp_extract(c, r"^<urn:page:(-?\d*)>$", 1), F.lit("")).cast("long")
    return read_warc(spark, path, verify=True).select(
        page("record_id").alias("page_id"),
        F.col("payload_length").alias("payload_bytes"),
        F.substring("payload_digest", 6, 32).alias("payload_digest"),
        "record_type",
        page("refers_to").alias("refers_to"),
    )


ORACLE_SQL = """
with p as (select page_id, sha1(coalesce(html, '')) as h, octet_length(encode(coalesce(html, ''))) as payload_bytes from pages),
d as (select page_id, payload_bytes,
        array_to_string(flatten(list_transform([1, 11, 21, 31], lambda i: list_transform([35, 30, 25, 20, 15, 10, 5, 0],
            lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(((cast('0x' || substr(h, i, 10) as bigint) >> b) & 31) + 1 as integer), 1)))), '') as payload_digest
      from p),
m as (select *, max(page_id) over (partition by payload_digest) as last from d)
select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest,
       case when page_id is not distinct from last then 'response' else 'revisit' end as record_type,
       case when page_id is not distinct from last then null else last end as refers_to
from m
"""
