"""Legacy web archives made into WARC.

ARC records are parsed by their version's header line and its declared length; a WARC record with
synthesised identifier, date, type and digests is written for each, and a payload that is there
already becomes a revisit of the record that has it. Archives are files that Spark writes and reads
(``text`` with the format's own separators, ``binaryFile``), one gzip stream each; within a task
they are streamed, so that memory holds the compressed archive and one record.

Defined results: a null payload is an empty one, a null key leaves its header out, a null address
becomes the record's own urn in WARC; blanks and control characters of an address are
percent-encoded. An ARC header line that does not parse is passed over up to the next that does; a
record that ends before its declared length is kept as far as it goes and marked truncated. Equal
rows are records of their own. No rows make archives without records. Other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime
from typing import BinaryIO
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, met_by, settle

#: The fields of a header line by version of the format, and what a version block says of them.
FIELDS = {
    1: ("url", "ip", "date", "content_type", "length"),
    2: ("url", "ip", "date", "content_type", "status", "checksum", "location", "offset", "filename", "length"),
}
DEFINITION = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: Fixed value: the profile of revisits by equal payload.
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads below this are stored again rather than referred to.
MIN_REVISIT_BYTES = 1000
#: A header of the stored response that carries the row's key through both formats.
KEY_HEADER = "X-Source-Key"
#: About so many bytes of records go to Spark at a time.
BATCH_BYTES = 8 << 20
#: ARC dates may be shorter than 14 digits; the rest of them is this.
EARLIEST = "00000101000000"
HEADS = "archive string, name string, offset long, version int, uri string, ip string, date string, content_type string, status int, truncated boolean, key string, payload_bytes long, sha1 binary, sha256 binary, record_id string"
RECORDS = "archive string, record_id string, type string, uri string, date string, content_type string, key string, payload_bytes long, payload_digest string, digest_ok boolean, refers_to string, payload binary"

_UNSAFE = re.compile(rb"[\x00-\x20\x7f]")
_KEY = re.compile(rb"(?im)^" + KEY_HEADER.encode() + rb":[ \t]*(.*?)[ \t]*\r?$")


def stream_of(content: bytes) -> BinaryIO:
    """An archive's bytes as a stream, whether it is compressed (in one member or many) or not."""
    raw = io.BytesIO(content)
    return io.BufferedReader(gzip.GzipFile(fileobj=raw)) if content[:2] == b"\x1f\x8b" else raw


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """Headers, with the blank line that ends them, and payload of a stored response; no headers if it is none."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    ends = [at + len(mark) for mark in (b"\r\n\r\n", b"\n\n") if (at := block.find(mark)) >= 0]
    return (block[: min(ends)], block[min(ends) :]) if ends else (block, b"")


def key_of(headers: bytes) -> str | None:
    found = _KEY.search(headers)
    return unquote(found.group(1).decode("utf-8", "replace")) if found else None


# --- ARC


def header_line(version: int, **values: str | bytes) -> bytes:
    """The line before a record: its version's fields, with ``-`` for those that are not known."""
    parts = [values.get(name, b"-") for name in FIELDS[version]]
    return b" ".join(_UNSAFE.sub(lambda m: b"%%%02X" % ord(m.group()), p.encode() if isinstance(p, str) else p) or b"-" for p in parts)


def parsed_line(line: bytes, version: int) -> dict[str, bytes] | None:
    """Fields of a header line, read from its end, as addresses in old archives may hold blanks; None if it is none."""
    names = FIELDS[version]
    parts = line.rstrip(b"\r\n").rsplit(b" ", len(names) - 1)
    if len(parts) < len(names) or not parts[-1].isdigit():
        return None
    return dict(zip(names, parts, strict=True))


def arc_records(stream: BinaryIO) -> Iterator[tuple[int, int, dict[str, bytes], bytes]]:
    """``(offset, version, fields, block)`` of an archive, version blocks (``filedesc:``) among them; they set the version of what follows."""
    version, at = 1, 0
    while line := stream.readline():
        offset, at = at, at + len(line)
        described = line.startswith(b"filedesc:")
        # A version block's own line has the fields of the version that it declares.
        tried = (parsed_line(line, v) for v in ((2, 1) if described else (version,)))
        fields = next((f for f in tried if f), None) if line.strip() else None
        if fields is None:
            continue
        block = stream.read(int(fields["length"]))
        at += len(block)
        if described and (declared := re.match(rb"[0-9]+", block)):
            version = 2 if int(declared.group()) >= 2 else 1
        yield offset, version, fields, block


def iso_date(date: bytes, other: str = "1970-01-01T00:00:00Z") -> str:
    digits = date.decode("ascii", "replace")
    try:
        return datetime.strptime(digits + EARLIEST[len(digits) :], "%Y%m%d%H%M%S").replace(tzinfo=UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return other


def record_id(name: str, offset: int, uri: bytes, date: str, sha1: bytes) -> str:
    """The same for the same record on every run: archives of a collection differ in the names that their version blocks give."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}#{offset}#{uri.decode("utf-8", "replace")}#{date}#{sha1.hex()}')}>"


def arc_heads(archive: str, content: bytes) -> Iterator[tuple[dict, bytes, bytes]]:
    """What is known of each record of an archive, as a row of HEADS, with its HTTP headers and payload."""
    name, begun = archive.rsplit("/", 1)[-1], "1970-01-01T00:00:00Z"
    for offset, version, f, block in arc_records(stream_of(content)):
        if f["url"].startswith(b"filedesc:"):
            name, begun = f["url"].removeprefix(b"filedesc:").lstrip(b"/").decode("utf-8", "replace"), iso_date(f["date"], begun)
            continue
        http, payload = split_http(block)
        sha1, date = hashlib.sha1(payload).digest(), iso_date(f["date"], begun)
        status = f.get("status") or (http.split(b" ", 2)[1] if http.count(b" ") > 1 else b"")
        yield {
            "archive": archive, "name": name, "offset": offset, "version": version, "uri": None if f["url"] == b"-" else f["url"].decode("utf-8", "replace"), "ip": None if f["ip"] in (b"-", b"0.0.0.0") else f["ip"].decode("ascii", "replace"),
            "date": date, "content_type": f["content_type"].decode("utf-8", "replace"), "status": int(status) if status.isdigit() else None, "truncated": len(block) < int(f["length"]), "key": key_of(http),
            "payload_bytes": len(payload), "sha1": sha1, "sha256": hashlib.sha256(payload).digest(), "record_id": record_id(name, offset, f["url"], date, sha1),
        }, http, payload


def _batches(records: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for record in records:
        held.append(record)
        n += len(record)
        if n >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.large_binary())], ["value"])
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.large_binary())], ["value"])


def _written(records: DataFrame, path: str, separator: str) -> None:
    """Records into files, one for each partition, each record followed by the format's separator."""
    records.select(F.col("value").cast("string").alias("value")).write.option("lineSep", separator).option("compression", "gzip").text(path)


def write_arc(rows: DataFrame, path: str, key: str, url: str, payload: str, captured: str = "20000101000000", prefix: str = "pages", versions: tuple[int, ...] = (1, 2)) -> None:
    """``rows`` as ARC archives, one for each partition, in turn in the given versions of the format: each payload as an HTTP response."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        version = versions[part % len(versions)]

        def records() -> Iterator[bytes]:
            block = f"{version} 0 {prefix}\n{DEFINITION[version]}\n".encode()
            yield header_line(version, url=f"filedesc://{prefix}-{part:05d}.arc", ip="0.0.0.0", date=captured, content_type="text/plain", status="200", length=str(len(block))) + b"\n" + block
            for batch in batches:
                for k, address, body in zip(*(batch.column(i) for i in range(3)), strict=True):
                    body = body.as_py() or b""
                    own = f"{KEY_HEADER}: {quote(k.as_py())}\r\n" if k.is_valid else ""
                    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n{own}\r\n".encode()
                    line = header_line(version, url=address.as_py() or "-", ip="0.0.0.0", date=captured, content_type="text/html", status="200", length=str(len(http) + len(body)))
                    yield b"".join((line, b"\n", http, body))

        yield from _batches(records())

    _written(rows.select(F.col(key).cast("string"), F.col(url), F.col(payload).cast("binary")).mapInArrow(run, "value binary"), path, "\n")


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("archive"), "content")


def _rows(found: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(found, schema)


_TYPES = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}


def _arrow(columns: str) -> pa.Schema:
    return pa.schema([(name, _TYPES[kind]) for name, kind in (c.split() for c in columns.split(", "))])


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """HEADS of all records of the archives under ``path``, without their blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _arrow(HEADS)
        for batch in batches:
            for archive, content in zip(batch.column(0), batch.column(1), strict=True):
                held = []
                for row, _, _ in arc_heads(archive.as_py(), content.as_py()):
                    held.append(row)
                    if len(held) == 10_000:
                        yield _rows(held, schema)
                        held = []
                yield _rows(held, schema)

    return files(spark, path).mapInArrow(run, HEADS)


# --- WARC


def sha1_name(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def warc_record(kind: str, block: bytes, **fields: str | None) -> bytes:
    """A record without the separator after it; fields are written with dashes for underscores, None left out."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{name.replace('_', '-')}: {value}" for name, value in fields.items() if value is not None), f"WARC-Block-Digest: {sha1_name(hashlib.sha1(block).digest())}", f"Content-Length: {len(block)}"]
    return b"".join(("\r\n".join(lines).encode(), b"\r\n\r\n", block))


def converted(row: dict, http: bytes, payload: bytes, ref: dict | None) -> bytes:
    """The WARC record of an ARC record: a revisit if ``ref`` names the record that has its payload, else a response, or a resource where no HTTP headers were stored."""
    identifier, digest = row["record_id"], sha1_name(row["sha1"])
    common = {"WARC_Record_ID": identifier, "WARC_Date": row["date"], "WARC_Target_URI": row["uri"] or identifier.strip("<>"), "WARC_IP_Address": row["ip"], "WARC_Payload_Digest": digest}
    stored = {"Content_Type": "application/http; msgtype=response" if http else row["content_type"]}
    if ref is not None:
        return warc_record("revisit", http, **common, WARC_Profile=REVISIT, WARC_Refers_To=ref["record_id"], WARC_Refers_To_Target_URI=ref["uri"], WARC_Refers_To_Date=ref["date"], WARC_Truncated="length", **stored)
    return warc_record("response" if http else "resource", http + payload, **common, WARC_Truncated="unspecified" if row["truncated"] else None, **stored)


def repeated(heads: DataFrame, first: Column, min_bytes: int) -> DataFrame:
    """``archive, offset, ref`` of records whose payload another has: of equal payloads (by SHA-256) the one with the largest ``first`` keeps it.

    Only digests are shuffled; groups are pre-aggregated, and a group of any size is met without being gathered.
    """
    large = heads.where(F.col("payload_bytes") >= min_bytes).withColumn("_first", first)
    own = F.struct(F.col("_first").alias("first"), "name", "offset", "record_id", F.coalesce("uri", F.regexp_replace("record_id", "[<>]", "")).alias("uri"), "date", "archive")
    groups = settle(large.groupBy("sha256").agg(F.max(own).alias("ref"), F.count("*").alias("n")).where("n > 1"))
    met = met_by(large.select("sha256", "archive", "offset"), groups, "sha256", heads.count())
    again = met.where((F.col("archive") != F.col("ref.archive")) | (F.col("offset") != F.col("ref.offset")))
    return again.select("archive", "offset", F.struct("ref.record_id", "ref.uri", "ref.date").alias("ref"))


def arc_to_warc(spark: SparkSession, arc: str, warc: str, first: Column | None = None, min_bytes: int = MIN_REVISIT_BYTES) -> None:
    """Converts the archives under ``arc`` into WARC files under ``warc``.

    Of records with equal payloads of ``min_bytes`` or more that with the largest ``first`` (a column
    over HEADS; by default the latest date) is stored, and the others refer to it. What is to be
    said of an archive's records is one row for each archive, so that blocks are never shuffled;
    that is broadcast if few records are concerned, else the compressed archives are dealt to it.
    """
    heads = settle(read_arc(spark, arc))
    again = settle(repeated(heads, F.col("date") if first is None else first, min_bytes))
    refs = again.groupBy("archive").agg(F.collect_list(F.struct("offset", "ref.*")).alias("refs"))
    refs = F.broadcast(refs) if again.count() <= BROADCAST_ROWS else refs.hint("shuffle_hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[bytes]:
            for batch in batches:
                for archive, content, told in zip(*(batch.column(i) for i in range(3)), strict=True):
                    known = {r["offset"]: r for r in told.as_py() or []}
                    name = archive.as_py()
                    info = f"software: hushframe\r\nformat: WARC File Format 1.1\r\ndescription: converted from {name.rsplit('/', 1)[-1]}\r\n".encode()
                    own = None
                    for row, http, payload in arc_heads(name, content.as_py()):
                        if own != row["name"]:
                            own = row["name"]
                            yield warc_record("warcinfo", info, WARC_Record_ID=record_id(own, -1, b"", row["date"], b""), WARC_Date=row["date"], WARC_Filename=own, Content_Type="application/warc-fields")
                        yield converted(row, http, payload, known.get(row["offset"]))

        yield from _batches(records())

    told = files(spark, arc).join(refs, "archive", "left").select("archive", "content", "refs")
    _written(told.mapInArrow(run, "value binary"), warc, "\r\n\r\n")


def warc_records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """``(fields, block)`` of an archive; names in lower case, folded lines joined."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        fields, last = {}, None
        while (line := stream.readline()).strip():
            if line[:1] in b" \t" and last:
                fields[last] += " " + line.strip().decode("utf-8", "replace")
                continue
            name, _, value = line.partition(b":")
            last = name.strip().lower().decode("utf-8", "replace")
            fields[last] = value.strip().decode("utf-8", "replace")
        yield fields, stream.read(int(fields.get("content-length", "0")))


def declared_sha1(value: str | None) -> bytes | None:
    """A ``sha1:`` digest, in base 32 as archives have it or in hexadecimal digits."""
    if not value or not value.lower().startswith("sha1:"):
        return None
    text = value[5:]
    try:
        return bytes.fromhex(text) if len(text) == 40 else base64.b32decode(text.upper())
    except ValueError:
        return None


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """RECORDS of the archives under ``path``, ``warcinfo`` left out.

    The digest of a stored payload is worked out from what was read and compared with the declared
    one (``digest_ok``); that of a revisit is the declared one, and its size null: it is that of
    the record referred to (see ``resolved``).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _arrow(RECORDS)
        for batch in batches:
            for archive, content in zip(batch.column(0), batch.column(1), strict=True):
                held, n = [], 0
                for f, block in warc_records(stream_of(content.as_py())):
                    kind = f.get("warc-type")
                    if kind == "warcinfo":
                        continue
                    http, payload = split_http(block)
                    stored, declared = kind != "revisit", declared_sha1(f.get("warc-payload-digest"))
                    digest = hashlib.sha1(payload).digest() if stored else declared
                    held.append({
                        "archive": archive.as_py(), "record_id": f.get("warc-record-id"), "type": kind, "uri": f.get("warc-target-uri"), "date": f.get("warc-date"), "content_type": f.get("content-type"), "key": key_of(http),
                        "payload_bytes": len(payload) if stored else None, "payload_digest": digest.hex() if digest else None, "digest_ok": digest == declared if stored and declared else None, "refers_to": f.get("warc-refers-to"), "payload": payload if stored and with_payload else None,
                    })
                    n += len(payload) if with_payload else 0
                    if n >= BATCH_BYTES or len(held) == 10_000:
                        yield _rows(held, schema)
                        held, n = [], 0
                yield _rows(held, schema)

    return files(spark, path).mapInArrow(run, RECORDS)


def resolved(records: DataFrame) -> DataFrame:
    """``records`` with ``refers_to_key`` and the size of a revisit's payload, both from the record that it refers to; a record met by any number of revisits is not gathered with them."""
    records = settle(records.drop("payload"))
    own = records.where("type <> 'revisit'").drop("refers_to", "archive").withColumns({"refers_to_key": F.lit(None).cast("string")})
    asked = records.where("type = 'revisit'").drop("archive")
    counts = asked.groupBy("refers_to").agg(F.count("*").alias("n"))
    held = own.groupBy(F.col("record_id").alias("refers_to")).agg(F.max("key").alias("refers_to_key"), F.max("payload_bytes").alias("_bytes"))
    target = settle(counts.join(held.hint("merge"), "refers_to", "left"))
    met = met_by(asked, target, "refers_to", asked.count()).withColumn("payload_bytes", F.col("_bytes")).drop("_bytes", "refers_to")
    lost = asked.where(F.col("refers_to").isNull()).drop("refers_to").withColumn("refers_to_key", F.lit(None).cast("string"))
    return own.unionByName(met).unionByName(lost)
