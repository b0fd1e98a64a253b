"""WARC archives as a PySpark data source: `spark.read.format("warc")` and `df.write.format("warc")`.

Reading plans partitions of files and of byte ranges of large files, parses the headers of a record first, and leaves the
payload alone where a pushed predicate fails on them or the reader doesn't want payloads. Each record is a gzip member that
states its own length in the `sl` extra field, so that what isn't wanted is jumped over, not inflated; members of other
writers, without that field, are inflated to find their end but not parsed further. Files that aren't packed are read too.
"""

from __future__ import annotations

import base64
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    Not,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)

from .common import filesystem, materialise, new_path

#: Columns with the header that fills each.
HEADERS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "warc_date": "WARC-Date",
    "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest",
    "page_id": "WARC-X-Page-Id",
    "refers_to_page": "WARC-X-Refers-To-Page-Id",
    "content_length": "Content-Length",
}
LONGS = {"page_id", "refers_to_page", "content_length", "payload_bytes"}
SCHEMA = (
    "record_type string, record_id string, target_uri string, warc_date string, refers_to string, payload_digest string, "
    "page_id long, refers_to_page long, content_length long, payload_bytes long, payload binary"
)
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
ARROW = pa.schema([(c, pa.int64() if c in LONGS else pa.binary() if c == "payload" else pa.string()) for c in COLUMNS])
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Keys that rows of one payload are spread over.
SALTS = 16
FILE_BYTES, SPLIT_BYTES, BATCH_BYTES = 1 << 30, 64 << 20, 8 << 20
MAGIC = b"\x1f\x8b\x08"


def gzip_member(data: bytes, level: int = 3) -> bytes:
    """One gzip member with the lengths of its packed and plain data in an `sl` extra field."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    head = MAGIC + b"\x04" + b"\0\0\0\0" + b"\0\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<HII", 8, len(body) + 32, len(data) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _clean(value: object) -> str:
    """A header value on one line."""
    return " ".join(str(value).split())


def record(row: dict) -> bytes:
    """A response with its HTTP headers and payload, or a revisit with HTTP headers alone, which keep the payload's length."""
    payload = row["payload"] or b""
    revisit = row["record_type"] == "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes'] if revisit else len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    digest = base64.b32encode(bytes.fromhex(row["payload_digest"])).decode() if row.get("payload_digest") else None
    values = {**row, "payload_digest": digest and f"sha1:{digest}", "content_length": len(block)}
    lines = ["WARC/1.1", *[f"{h}: {_clean(values[c])}" for c, h in HEADERS.items() if values.get(c) is not None]]
    lines += ["Content-Type: application/http; msgtype=response", *[f"WARC-Profile: {PROFILE}"] * revisit]
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Files go to `_temporary`; those of the attempts that Spark commits are moved into place."""

    def __init__(self, path: str, overwrite: bool, file_bytes: int):
        self.path, self.overwrite, self.file_bytes = path.rstrip("/"), overwrite, file_bytes

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, top = filesystem(self.path)
        store.create_dir(f"{top}/_temporary", recursive=True)
        out, size, files = None, 0, []
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None or size > self.file_bytes:
                    if out:
                        out.close()
                    files.append(f"{uuid.uuid4().hex}.warc.gz")
                    out, size = store.open_output_stream(f"{top}/_temporary/{files[-1]}", compression=None), 0
                member = gzip_member(record(row))
                out.write(member)
                size += len(member)
        if out:
            out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, top = filesystem(self.path)
        from pyarrow import fs

        store.create_dir(top, recursive=True)
        if self.overwrite:
            for f in store.get_file_info(fs.FileSelector(top)):
                if f.type == fs.FileType.File:
                    store.delete_file(f.path)
        for name in (x for m in messages if m for x in m.files):
            store.move(f"{top}/_temporary/{name}", f"{top}/{name}")
        self.abort([])

    def abort(self, messages: list[Written | None]) -> None:
        store, top = filesystem(self.path)
        from pyarrow import fs

        if store.get_file_info(f"{top}/_temporary").type == fs.FileType.Directory:
            store.delete_dir(f"{top}/_temporary")


@dataclass
class Ranges(InputPartition):
    """(file, first byte, byte after the last): records that start in there."""

    ranges: list[tuple[str, int, int]]


class Buffered:
    """A file from some place on, with what has been read but not used."""

    def __init__(self, file, at: int, end: int):
        self.file, self.at, self.size, self.data = file, at, end, b""
        file.seek(at)

    def fill(self, n: int) -> bool:
        """Have n bytes at hand if the file has them."""
        while len(self.data) < n:
            more = self.file.read(max(1 << 16, n - len(self.data)))
            if not more:
                return False
            self.data += more
        return True

    def skip(self, n: int) -> None:
        """Go n bytes on; beyond what is at hand, by seeking."""
        if n > len(self.data):
            self.file.seek(self.at + n)
            self.data = b""
        else:
            self.data = self.data[n:]
        self.at += n


def _stated_length(head: bytes) -> int | None:
    """Length of the member as its `sl` field has it."""
    if head[3] & 4 and head[10:14] == b"\x0c\0sl":
        return struct.unpack("<I", head[16:20])[0]
    return None


def _is_record(data: bytes) -> bool:
    try:
        return zlib.decompressobj(31).decompress(data, 5).startswith(b"WARC/")
    except zlib.error:
        return False


def _sync(b: Buffered, end: int) -> bool:
    """Go to the first member of a record that starts before `end`."""
    while b.at < end and b.fill(64):
        at = b.data.find(MAGIC)
        if at < 0:
            b.skip(max(1, len(b.data) - 2))
            continue
        b.skip(at)
        b.fill(1 << 12)
        if b.at < end and _is_record(b.data[: 1 << 12]):
            return True
        b.skip(1)
    return False


def _inflate(b: Buffered, wanted: bool) -> bytes:
    """The member at hand, and go behind it; if not wanted, only its end is looked for."""
    unpack, out = zlib.decompressobj(31), []
    while not unpack.eof:
        if not b.data and not b.fill(1):
            raise ValueError("a record ends before its time")
        part = unpack.decompress(b.data)
        b.at += len(b.data) - len(unpack.unused_data)
        b.data = unpack.unused_data
        if wanted:
            out.append(part)
    return b"".join(out)


class Unpacked:
    """What stands at a place of a file, unpacked as far as it is asked for; the place stays where it is."""

    def __init__(self, b: Buffered, packed: bool = True):
        self.b, self.used, self.data, self.at = b, 0, bytearray(), 0
        self.unpack = zlib.decompressobj(31) if packed else None

    def _more(self) -> bool:
        if self.unpack and self.unpack.eof or self.used == len(self.b.data) and not self.b.fill(self.used + 1):
            return False
        part = self.b.data[self.used : self.used + 4096]
        self.used += len(part)
        self.data += self.unpack.decompress(part) if self.unpack else part
        return True

    def upto_blank(self) -> bytes:
        """What comes up to the next blank line, or to the end."""
        scanned = self.at
        while (end := self.data.find(b"\r\n\r\n", scanned)) < 0:
            scanned = max(self.at, len(self.data) - 3)
            if not self._more():
                end = len(self.data)
                break
        part, self.at = bytes(self.data[self.at : end]), end + 4
        return part


def _fill_payload(row: dict, block: bytes) -> None:
    row["payload"] = block.partition(b"\r\n\r\n")[2] if block.startswith(b"HTTP/") else bytes(block)
    row["payload_bytes"] = len(row["payload"])


def _sized(row: dict, http: dict[str, str]) -> dict:
    """A row without payload has its length from the HTTP headers."""
    if row["payload_bytes"] is None and http.get("content-length", "").isdigit():
        row["payload_bytes"] = int(http["content-length"])
    return row


def parse_headers(data: bytes) -> dict[str, str]:
    """Headers by lower-case name; continued lines are joined."""
    found: dict[str, str] = {}
    name = ""
    for line in data.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            found[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            found[name] = value.strip()
    return found


def _digest(value: str | None) -> str | None:
    """Bare lower-case hexadecimal of a SHA-1 digest in base 32 or 16; others as they are."""
    kind, _, text = (value or "").partition(":")
    if kind.lower() != "sha1":
        return value
    return base64.b32decode(text.upper()).hex() if len(text) == 32 else text.lower()


def header_row(headers: dict[str, str]) -> dict:
    row: dict = {c: headers.get(h.lower()) for c, h in HEADERS.items()}
    for c in LONGS & set(row):
        row[c] = int(row[c]) if row[c] and row[c].lstrip("-").isdigit() else None
    return row | {"payload_digest": _digest(row["payload_digest"]), "payload_bytes": None, "payload": None}


def passes(f: Filter, row: dict) -> bool:
    """Whether a row can satisfy a filter on columns that come from headers; as in SQL, null fails a comparison."""
    if isinstance(f, Not):
        return row[f.child.attribute[0]] is not None and not passes(f.child, row)
    value = row[f.attribute[0]]
    if isinstance(f, IsNull):
        return value is None
    if isinstance(f, EqualNullSafe):
        return value == f.value
    if value is None:
        return False
    tests = {
        EqualTo: lambda: value == f.value,
        In: lambda: value in f.value,
        GreaterThan: lambda: value > f.value,
        GreaterThanOrEqual: lambda: value >= f.value,
        LessThan: lambda: value < f.value,
        LessThanOrEqual: lambda: value <= f.value,
        StringStartsWith: lambda: value.startswith(f.value),
        StringEndsWith: lambda: value.endswith(f.value),
        StringContains: lambda: f.value in value,
        IsNotNull: lambda: True,
    }
    return tests[type(f)]()


_COMPARED = (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, StringStartsWith, StringEndsWith, StringContains)


def pushable(f: Filter) -> bool:
    if isinstance(f, Not):
        return isinstance(f.child, _COMPARED) and pushable(f.child)
    return isinstance(f, (*_COMPARED, IsNull, IsNotNull, EqualNullSafe)) and len(f.attribute) == 1 and f.attribute[0] in HEADERS


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool, split_bytes: int):
        self.path, self.payload, self.split_bytes, self.filters = path, payload, split_bytes, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if pushable(f):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Ranges]:
        """Large files in ranges, small ones together, each partition of about split_bytes. Files that aren't packed stay whole:
        where a record starts, only the lengths of those before it tell; payloads that aren't wanted are jumped over."""
        from pyarrow import fs

        store, top = filesystem(self.path)
        info = store.get_file_info(top)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(top, recursive=True))
        found, held, size = [], [], 0
        for f in sorted((f for f in files if f.type == fs.FileType.File and f.path.endswith((".warc.gz", ".warc")) and "/_temporary/" not in f.path), key=lambda f: f.path):
            step = self.split_bytes if f.path.endswith(".gz") else max(1, f.size)
            for lo in range(0, f.size, step):
                hi = min(f.size, lo + step)
                if held and size + hi - lo > self.split_bytes:
                    found.append(Ranges(held))
                    held, size = [], 0
                held.append((f.path, lo, hi))
                size += hi - lo
        return [*found, Ranges(held)] if held or not found else found

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        store, _ = filesystem(self.path)
        rows, size = [], 0
        for path, lo, hi in partition.ranges:
            with store.open_input_file(path) as file:
                for row in self._records(file, lo, hi) if path.endswith(".gz") else self._plain_records(file, hi):
                    rows.append(row)
                    size += 500 + len(row["payload"] or b"")
                    if size > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=ARROW)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW)

    def _records(self, file, lo: int, hi: int) -> Iterator[dict]:
        b = Buffered(file, lo, hi)
        if lo and not _sync(b, hi):
            return
        while b.at < hi and b.fill(20):
            length = _stated_length(b.data)
            row, _, http = self._head(Unpacked(b))
            wanted = row is not None and self.payload and row["record_type"] != "revisit"
            if length and not wanted:
                b.skip(length)
            else:
                data = _inflate(b, wanted)
                if wanted:
                    start = data.index(b"\r\n\r\n") + 4
                    _fill_payload(row, data[start : start + (row["content_length"] or 0)])
            if row is not None:
                yield _sized(row, http)

    def _plain_records(self, file, end: int) -> Iterator[dict]:
        b = Buffered(file, 0, end)
        while b.at < end and b.fill(20):
            head = Unpacked(b, packed=False)
            row, headers, http = self._head(head)
            if not head.data.startswith(b"WARC/") or not headers.get("content-length", "").isdigit():
                raise ValueError("this is no WARC record")
            length = head.data.index(b"\r\n\r\n") + 4 + int(headers["content-length"])
            if row is not None:
                if self.payload and row["record_type"] != "revisit":
                    b.fill(length)
                    _fill_payload(row, b.data[length - row["content_length"] : length])
                yield _sized(row, http)
            b.skip(length + 4)

    def _head(self, head: Unpacked) -> tuple[dict | None, dict[str, str], dict[str, str]]:
        """The columns from the headers of a record, or None where a filter fails on them; its headers, and its HTTP headers.

        No more is unpacked than the headers take: up to the first blank line, and only of records that pass and hold an HTTP
        message up to the next one.
        """
        headers = parse_headers(head.upto_blank())
        row = header_row(headers)
        if not all(passes(f, row) for f in self.filters):
            return None, headers, {}
        http = headers.get("content-type", "").lower().startswith("application/http")
        return row, headers, parse_headers(head.upto_blank()) if http else {}


class WarcSource(DataSource):
    """Options: path, payload (false: read headers only), splitBytes, fileBytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() == "true", int(self.options.get("splitBytes", SPLIT_BYTES)))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], overwrite, int(self.options.get("fileBytes", FILE_BYTES)))


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with its predicates pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def plan_records(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """A WARC record for each page, as write.format("warc") takes them.

    The payload is the html in UTF-8 (null: empty). Of equal payloads of `least_bytes` bytes or more, the largest page_id is
    the response and the others revisit it; smaller ones are all responses. Repeated rows of the largest page_id are all
    responses, and a null page_id revisits whatever page has the same payload, or responds if there is none. Largest
    page_ids are found for digests alone; only those of more than one row are joined back, spread over SALTS keys each, so
    that a payload of very many pages is no hot key where they are too many to broadcast. Other columns are ignored; an empty
    table makes no record.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha1("payload"))
    large = rows.filter(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    shared = materialise(large.filter("n > 1 AND first IS NOT NULL").select(F.col("payload_digest").alias("d"), "first"), "warc-shared")
    shared = shared.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
    rows = rows.join(shared, (rows["payload_digest"] == shared["d"]) & (salt == shared["s"]) & (rows["payload_bytes"] >= least_bytes), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    name = lambda c: F.when(c.isNotNull(), F.format_string("<urn:page:%d>", c))
    return rows.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.coalesce(name(F.col("page_id")), F.concat(F.lit("<urn:sha1:"), "payload_digest", F.lit(">"))).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit("1970-01-01T00:00:00Z").alias("warc_date"),
        name(F.when(revisit, F.col("first"))).alias("refers_to"),
        "payload_digest",
        "page_id",
        F.when(revisit, F.col("first")).alias("refers_to_page"),
        "payload_bytes",
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def write_pages(pages: DataFrame, path: str) -> None:
    register(pages.sparkSession)
    plan_records(pages).write.format("warc").mode("append").save(path)


def op8_warc(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    records = spark.read.format("warc").load(path)
    digest = F.when(F.col("payload").isNotNull(), F.sha1("payload")).otherwise(F.col("payload_digest"))
    return records.select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", F.col("refers_to_page").alias("refers_to"))


OP8_SQL = """
WITH rows AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
sized AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS payload_digest FROM rows),
firsts AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS f FROM sized)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN f IS NOT NULL AND page_id IS DISTINCT FROM f THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f IS NOT NULL AND page_id IS DISTINCT FROM f THEN f END AS refers_to
FROM firsts
"""
