"""Legacy archive converter: ARC files in, WARC files out.

An ARC record is a header line of blank-separated fields, with other fields in
version 1 and version 2, and as many bytes as its last field declares. The
converter reads them as declared, and synthesises what WARC wants and ARC lacks:
record ids from the place in the archive, ISO timestamps from 14-digit dates,
record types from the URL and the content, block and payload digests. Equal
payloads of ``min_revisit`` bytes or more become one response and revisits.

Archives are read with the ``binaryFile`` source, gzip members or plain, and
parsed as a stream; they are written with the text writer, some thousand records a
file, so every path is one that Spark itself can read and write.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkgauge.session import scratch_path, ship_package

BATCH = 1 << 23
FILE_RECORDS = 5_000  # a file is one task's work when it is read

# The fields of a URL record in both versions of the ARC format.
ARC_FIELDS = {
    "1": ("url", "ip", "date", "mime", "length"),
    "2": ("url", "ip", "date", "mime", "status", "checksum", "location", "offset", "filename", "length"),
}
ARC_HEAD = {
    "1": "URL IP-address Archive-date Content-type Archive-length",
    "2": "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}


def _stream(content: bytes):
    return gzip.GzipFile(fileobj=io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)


def arc_records(content: bytes) -> Iterator[dict]:
    """Records of one ARC file: header fields, offset in the unpacked file, block.

    The version block says which header lines follow; blank lines between records
    are skipped. A file that ends inside a record raises ``ValueError``.
    """
    stream, fields, at = _stream(content), ARC_FIELDS["1"], 0
    while line := stream.readline():
        here = at
        at += len(line)
        if not line.strip(b"\r\n"):
            continue
        parts = line.rstrip(b"\r\n").decode("utf-8", "replace").split(" ")
        if parts[0].startswith("filedesc://"):
            length = int(parts[-1])
            block = stream.read(length)
            version = block.split(b" ", 1)[0].strip().decode()
            fields = ARC_FIELDS.get(version, ARC_FIELDS["1"])
            record = dict(zip(ARC_FIELDS["1"], [*parts[:4], parts[-1]]))
        else:
            # a URL may hold blanks: fields are counted from the end
            spare = len(parts) - len(fields)
            if spare < 0:
                raise ValueError(f"no ARC header at {here}: {parts[:3]}")
            parts = [" ".join(parts[: spare + 1]), *parts[spare + 1 :]]
            record = dict(zip(fields, parts))
            length = int(record["length"])
            block = stream.read(length)
        if len(block) < length:
            raise ValueError(f"record at {here} declares {length} bytes, {len(block)} are left")
        at += length
        yield record | {"offset": here, "block": block}


def iso_date(date: str) -> str:
    """``YYYYMMDDhhmmss``, or the first digits of it, as a WARC timestamp."""
    digits = (date + "00000101000000"[len(date) :])[:14] if date.isdigit() else "00000101000000"
    return f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}T{digits[8:10]}:{digits[10:12]}:{digits[12:14]}Z"


def http_parts(block: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (small letters) and body of an HTTP message; a block that is none is all body."""
    if not block.startswith(b"HTTP/"):
        return {}, block
    head, _, body = block.partition(b"\r\n\r\n")
    lines = head.decode("latin-1").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, body


def _record_rows(name: str, content: bytes) -> Iterator[tuple]:
    for r in arc_records(content):
        headers, body = http_parts(r["block"])
        http = r["block"].startswith(b"HTTP/")
        kind = "warcinfo" if r["url"].startswith("filedesc://") else "response" if http else "resource"
        mime = "application/http; msgtype=response" if http else "text/plain" if kind == "warcinfo" else r["mime"]
        key = headers.get("x-page-id")
        yield (
            f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}#{r["offset"]}')}", r["url"], iso_date(r["date"]), kind, mime,
            r["ip"], int(key) if key and key.lstrip("-").isdigit() else None, len(body), hashlib.sha1(body).hexdigest(), r["block"],
        )


_CONVERTED = "record_id string, url string, date string, kind string, mime string, ip string, key long, payload_bytes long, digest string, block binary"
_READ = "record_id string, url string, date string, kind string, key long, payload_bytes long, digest string, refers_to_id string, refers_to long, block binary"


def _batched(rows: Iterator[tuple], schema: pa.Schema, size_of) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)

    for row in rows:
        held.append(row)
        size += size_of(row) + 200
        if size > BATCH:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[t]) for n, t in (x.strip().split(" ") for x in ddl.split(","))])


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the ARC files under ``path`` with the values that WARC wants."""
    ship_package(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for name, content in zip(b.column(0), b.column(1)):
                    yield from _record_rows(name.as_py().rsplit("/", 1)[-1], content.as_py())

        yield from _batched(rows(), _schema(_CONVERTED), lambda r: len(r[-1]))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, _CONVERTED)


def with_revisits(records: DataFrame, min_revisit: int = 1000) -> DataFrame:
    """Adds ``refers_to_id`` and ``refers_to`` to responses whose payload another record holds.

    Of equal payloads the record with the largest key (null smallest) is the response.
    Only digests that repeat reach the join; copies may be a third of all records.
    """
    large = (F.col("kind") == "response") & (F.col("payload_bytes") >= min_revisit)
    held = records.filter(large).groupBy("digest").agg(F.max(F.struct("key", "record_id")).alias("first"), F.count("*").alias("n"))
    held = held.filter("n > 1").select(F.col("digest").alias("_digest"), "first")
    found = records.join(held, large & (F.col("digest") == F.col("_digest")), "left")
    revisit = F.col("first").isNotNull() & (F.col("first.record_id") != F.col("record_id"))
    return found.select(
        *records.columns,
        F.when(revisit, F.col("first.record_id")).alias("refers_to_id"),
        F.when(revisit, F.col("first.key")).alias("refers_to"),
        revisit.alias("revisit"),
    )


def _write_text(lines: DataFrame, path: str, end: str) -> None:
    lines.write.option("lineSep", end).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def _line(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(name + ": "), value, F.lit("\r\n")), F.lit(""))


def write_warc(records: DataFrame, path: str) -> None:
    """Write WARC/1.1 files, gzip-compressed, of at most FILE_RECORDS records. A revisit keeps the HTTP header only.

    Blocks may hold any bytes: the cast to text keeps them as they are, and so does the text writer.
    """
    text = F.col("block").cast("string")
    head = F.concat(F.substring_index(text, "\r\n\r\n", 1), F.lit("\r\n\r\n"))
    body = F.when(F.col("revisit"), head).otherwise(text)
    kind = F.when(F.col("revisit"), "revisit").otherwise(F.col("kind"))
    profile = F.when(F.col("revisit"), F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    bare = F.col("kind") == "warcinfo"
    value = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", kind),
        _line("WARC-Record-ID", F.concat(F.lit("<"), "record_id", F.lit(">"))),
        _line("WARC-Date", F.col("date")),
        _line("WARC-Target-URI", F.when(~bare, F.col("url"))),
        _line("WARC-IP-Address", F.when(~bare & (F.col("ip") != "0.0.0.0"), F.col("ip"))),
        _line("WARC-Payload-Digest", F.when(~bare, F.concat(F.lit("sha1:"), "digest"))),
        _line("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.sha1(body.cast("binary")))),
        _line("WARC-Profile", profile),
        _line("WARC-Refers-To", F.concat(F.lit("<"), "refers_to_id", F.lit(">"))),
        # extension fields, so that a reader needs no second look at the response
        _line("X-Payload-Length", F.when(~bare, F.col("payload_bytes").cast("string"))),
        _line("X-Refers-To-Page", F.col("refers_to").cast("string")),
        _line("Content-Type", F.col("mime")),
        _line("Content-Length", F.octet_length(body).cast("string")),
        F.lit("\r\n"), body, F.lit("\r\n"),
    )
    _write_text(records.select(value.alias("value")), path, "\r\n")


def warc_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (small letters) and block of each record of one WARC file."""
    stream = _stream(content)
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        fields: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            fields[name.strip().lower()] = value.strip()
        length = int(fields["content-length"])
        block = stream.read(length)
        if len(block) < length:
            raise ValueError(f"record {fields.get('warc-record-id')} is cut off")
        yield fields, block


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the WARC files under ``path``. Digests are checked against the blocks that are there."""
    ship_package(spark)

    def rows(content: bytes) -> Iterator[tuple]:
        for f, block in warc_records(content):
            headers, body = http_parts(block)
            kind, digest = f["warc-type"], f.get("warc-payload-digest", "sha1:")[5:]
            if f["warc-block-digest"] != "sha1:" + hashlib.sha1(block).hexdigest():
                raise ValueError(f"record {f['warc-record-id']} is damaged")
            size = len(body) if kind != "revisit" else int(f["x-payload-length"])
            if kind == "response":
                digest = hashlib.sha1(body).hexdigest()
            key, to = headers.get("x-page-id"), f.get("x-refers-to-page")
            yield (f["warc-record-id"].strip("<>"), f.get("warc-target-uri"), f["warc-date"], kind, int(key) if key else None, size,
                   digest, f.get("warc-refers-to", "").strip("<>") or None, int(to) if to else None, block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = (r for b in batches for c in b.column(0) for r in rows(c.as_py()))
        yield from _batched(every, _schema(_READ), lambda r: len(r[-1]))

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, _READ)


def write_arc(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html",
              date: str = "20000101000000") -> None:
    """Write pages as ARC files of at most FILE_RECORDS records, version 1 and 2 in turn by task; the key travels in an HTTP field.

    A null page is an empty payload, a null URL ``unknown:``; white space in a URL is
    percent-encoded. The first record of a file is its version block.
    """
    place = F.monotonically_increasing_id()
    page = F.coalesce(F.col(f"`{html}`").cast("string"), F.lit(""))
    number = F.coalesce(F.concat(F.lit("X-Page-Id: "), F.col(f"`{key}`").cast("string"), F.lit("\r\n")), F.lit(""))
    block = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), number, F.lit("\r\n"), page)
    address = F.coalesce(F.col(f"`{url}`").cast("string"), F.lit("unknown:"))
    address = F.regexp_replace(F.regexp_replace(address, "[\\r\\n\\t]", ""), " ", "%20")
    rows = pages.select(place.alias("at"), address.alias("url"), block.alias("block"))
    second = F.shiftright("at", 33) % 2 == 1
    size = F.octet_length("block").cast("string")
    middle = F.when(second, F.lit(" 200 - - 0 - ")).otherwise(F.lit(" "))
    record = F.concat("url", F.lit(f" 0.0.0.0 {date} text/html"), middle, size, F.lit("\n"), "block")

    def version(v: str) -> str:
        body = f"{v} 0 sparkgauge\n{ARC_HEAD[v]}\n"
        fields = f"filedesc://pages.arc 0.0.0.0 {date} text/plain" + (" 200 - - 0 pages.arc" if v == "2" else "")
        return f"{fields} {len(body)}\n{body}\n"

    start = F.when(F.col("at").bitwiseAND((1 << 33) - 1) % FILE_RECORDS == 0, F.when(second, version("2")).otherwise(version("1"))).otherwise("")
    out = rows.select(F.concat(start, record).alias("value"))
    _write_text(out, path, "\n")


def convert(spark: SparkSession, arc_path: str, warc_path: str, min_revisit: int = 1000) -> None:
    """Convert the ARC files under one path into WARC files under another."""
    write_warc(with_revisits(read_arc(spark, arc_path), min_revisit), warc_path)


def archive_round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", min_revisit: int = 1000) -> DataFrame:
    """Pages to ARC files, ARC to WARC, WARC read back: one row per page record.

    (key, url, payload_bytes, payload_digest, record_type, refers_to). Repeated rows and keys are records of their
    own; an empty table writes no record and gives no row.
    """
    spark = pages.sparkSession
    arc, warc = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    write_arc(pages, arc, key, url, html)
    convert(spark, arc, warc, min_revisit)
    found = read_warc(spark, warc).filter("kind <> 'warcinfo'")
    return found.select(F.col("key").alias(key), F.col("url"), "payload_bytes", F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to")
