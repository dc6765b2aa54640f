"""Legacy ARC archives to WARC (operator 2).

``write_arc`` writes pages as ARC files of version 1 and 2, ``parse_arc`` reads such files by the
field list of their version block and by declared lengths, ``convert`` writes the equivalent WARC
records with synthesised ids, dates, types and digests, and ``read_warc`` reads those back.

Which of the records with equal payloads is the ``response`` is decided over all archives: digests are
grouped without the payloads, so a payload that makes up a third of all records is a group of narrow rows
that is aggregated before the shuffle. The places of the revisits are written down, and the records are
read again and meet them by their own places: where Spark finds the written table small, payloads stay where
they were read, else they are shuffled once, evenly.

Files are written by Spark's text writer, a row per record; the separator after a row is the end
that the format gives to a record. Files are read as whole files, one at a time in a task: an
archive must stay below the 2 GB that a value can hold.

Defined results: a null url becomes ``urn:unknown``, white space and controls in urls are escaped; a
null payload is an empty one; a null number gives a record without number. Repeated rows are records
of their own. Of records with equal payloads and equal greatest numbers, the last in the order of
archives is the response. Bytes between records that no header line explains are skipped, and so are WARC records
without a type, an id or a length that the file holds; a revisit without digest or length has null there. Numbers
are longs; others count as none. An empty table gives archives without records. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reqsieve.llm.stored import only, settle

# The header fields of the two versions of the format, and the names of the HTTP field
# and the WARC fields that carry a record's number and the length of its payload.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset",
        "Filename", "Archive-length"],
}
NUMBER, LENGTH = "X-Record-Number", "X-Payload-Length"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")

#: How archives are written: packed, in little time.
PACKED = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}
#: Records in bytes that are handed to Spark at a time.
BATCH_BYTES = 4 << 20
_UNSAFE = re.compile(r"[\x00-\x20\x7f-\xa0\s]")
_DATE = re.compile(rb"\d{8,14}")


def _batched(rows: Iterator[bytes], name: str) -> Iterator[pa.RecordBatch]:
    held: list[bytes] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row)
        if size > BATCH_BYTES:
            yield pa.record_batch([pa.array(held, pa.binary())], [name])
            held, size = [], 0
    yield pa.record_batch([pa.array(held, pa.binary())], [name])


def escape_url(url: str | None) -> str:
    if not url:
        return "urn:unknown"
    return _UNSAFE.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)


def arc_record(version: int, url: str, ip: str, date: str, mime: str, block: bytes, name: str = "-", status: str = "200") -> bytes:
    fields = {"URL": url, "IP-address": ip, "Archive-date": date, "Content-type": mime, "Result-code": status,
              "Checksum": "-", "Location": "-", "Offset": "0", "Filename": name, "Archive-length": str(len(block))}
    return " ".join(fields[f] for f in ARC_FIELDS[version]).encode() + b"\n" + block


def version_block(version: int, name: str, date: str) -> bytes:
    block = f"{version} 0 reqsieve\n{' '.join(ARC_FIELDS[version])}\n".encode()
    return arc_record(version, f"filedesc://{name}", "0.0.0.0", date, "text/plain", block, name)


def write_arc(pages: DataFrame, path: str, number: str = "page_id", url: str = "url", payload: str = "html",
              date: str = "20000101000000") -> None:
    """One ARC file per task, of version 1 and 2 in turn, with an HTTP response per row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        part = TaskContext.get().partitionId()
        version, name = 1 + part % 2, f"part-{part:05d}.arc.gz"
        yield version_block(version, name, date)
        for batch in batches:
            for n, address, body in zip(*batch.columns):
                body = body.as_buffer().to_pybytes() if body.is_valid else b""
                head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                if n.is_valid:
                    head += f"{NUMBER}: {n.as_py()}\r\n"
                head += f"Content-Length: {len(body)}\r\n\r\n"
                yield arc_record(version, escape_url(address.as_py()), "0.0.0.0", date, "text/html", head.encode() + body, name)

    (
        only(pages, number=F.col(number).cast("long"), url=url, payload=F.col(payload).cast("binary"))
        .mapInArrow(lambda b: _batched(rows(b), "record"), "record binary").select(F.col("record").cast("string"))
        .write.options(lineSep="\n", **PACKED).text(path)
    )


def unpacked(content: bytes) -> bytes:
    """A file's bytes; gzip files may be of several members."""
    out = []
    while content[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        out.append(member.decompress(content))
        content = member.unused_data
    return b"".join(out) if out else content


@dataclass
class Record:
    """A record as parsed: ``head`` is the HTTP header, if the block has one."""

    at: int
    fields: dict[str, str]
    head: bytes
    payload: bytes
    names: dict[str, str] = field(default_factory=dict)

    @property
    def number(self) -> int | None:
        said = self.names.get(NUMBER.lower(), "")
        number = int(said) if re.fullmatch(r"-?\d{1,19}", said) else None
        return number if number is not None and -(1 << 63) <= number < 1 << 63 else None


def header_fields(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out


def _http(block: bytes) -> tuple[bytes, bytes]:
    if block.startswith(b"HTTP/"):
        head, end, payload = block.partition(b"\r\n\r\n")
        if end:
            return head + end, payload
    return b"", block


def _header(line: bytes, names: list[str], rest: int) -> dict[str, str] | None:
    """The fields of a header line, counted from the right: old urls may hold spaces."""
    said = line.rsplit(b" ", len(names) - 1)
    if len(said) != len(names) or not said[-1].isdigit() or int(said[-1]) > rest:
        return None
    out = {n: v.decode("utf-8", "replace") for n, v in zip(names, said)}
    return out if _DATE.fullmatch(said[names.index("Archive-date")]) else None


def parse_arc(data: bytes) -> Iterator[Record]:
    """The records of an archive. The version block names the fields; version 1 holds until then."""
    names, at = ARC_FIELDS[1], 0
    while at < len(data):
        end = data.find(b"\n", at)
        if end < 0:
            return
        line, rest = data[at:end], len(data) - end - 1
        tried = [names] if not line.startswith(b"filedesc://") else [ARC_FIELDS[2], ARC_FIELDS[1]]
        fields = next((f for n in tried if (f := _header(line, n, rest))), None)
        if fields is None:
            at = end + 1
            continue
        length = int(fields["Archive-length"])
        block = data[end + 1: end + 1 + length]
        if line.startswith(b"filedesc://"):
            said = block.split(b"\n")
            stated = said[1].decode("utf-8", "replace").split() if len(said) > 1 else []
            version = int(said[0][:1]) if said[0][:1] in (b"1", b"2") else 1
            names = stated if {"Archive-date", "URL"} <= set(stated) and stated[-1] == "Archive-length" else ARC_FIELDS[version]
        else:
            head, payload = _http(block)
            yield Record(at, fields, head, payload, header_fields(head))
        at = end + 1 + length


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(archive: int, at: int, fields: dict[str, str]) -> str:
    """The same id whenever the same archive is converted."""
    return f"urn:uuid:{uuid.uuid5(NAMESPACE, f'{archive} {at} {fields["URL"]} {fields["Archive-date"]}')}"


def iso_date(date: str) -> str:
    d = date.ljust(14, "0")
    month, day = max(1, int(d[4:6] or 1)), max(1, int(d[6:8] or 1))
    return f"{d[:4]}-{month:02d}-{day:02d}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


PLACE = "archive long, at long"
NARROW = f"{PLACE}, record_id string, number long, digest string, payload_bytes long"
WIDE = f"{PLACE}, record_id string, uri string, date string, digest string, payload_bytes long, ip string, mime string, head binary, payload binary"


def _archives(spark: SparkSession, path: str) -> DataFrame:
    """Whole files, numbered by their names: by Spark's own numbers where Spark wrote them."""
    name = F.element_at(F.split("path", "/"), -1)
    own = F.regexp_extract(name, r"^part-(\d+)-", 1).try_cast("long")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "[!_.]*").load(path)
    return files.select(F.coalesce(own, F.xxhash64(name)).alias("archive"), "content")


def arc_records(spark: SparkSession, path: str, payloads: bool) -> DataFrame:
    """Records of the ARC files: what identifies them, or what they hold."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.binary() if t == "binary" else pa.int64() if t == "long" else pa.string())
                            for n, t in (c.split() for c in (WIDE if payloads else NARROW).split(", "))])
        for batch in batches:
            for archive, content in zip(*batch.columns):
                made: list[tuple] = []
                size, archive = 0, archive.as_py()
                for r in parse_arc(unpacked(content.as_buffer().to_pybytes())):
                    f = r.fields
                    name, digest_, length = record_id(archive, r.at, f), digest(r.payload), len(r.payload)
                    made.append(
                        (archive, r.at, name, f["URL"], iso_date(f["Archive-date"]), digest_, length, f["IP-address"], f["Content-type"], r.head, r.payload)
                        if payloads else (archive, r.at, name, r.number, digest_, length))
                    size += length if payloads else 300
                    if size > BATCH_BYTES:
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*made), schema.types)], schema=schema)
                        made, size = [], 0
                if made:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*made), schema.types)], schema=schema)

    return _archives(spark, path).mapInArrow(rows, WIDE if payloads else NARROW)


def warc_record(kind: str, record: dict, block: bytes) -> bytes:
    """Without the empty lines at its end, which the writer adds."""
    fields = {
        "WARC-Type": kind, "WARC-Record-ID": f"<{record['record_id']}>", "WARC-Date": record["date"],
        "WARC-Target-URI": record.get("uri"), "WARC-IP-Address": record.get("ip"),
        "WARC-Payload-Digest": record.get("digest") and f"sha1:{record['digest']}", LENGTH: record.get("payload_bytes"),
        "WARC-Block-Digest": f"sha1:{digest(block)}",
    }
    if kind == "revisit":
        fields |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": f"<{record['refers_to']}>"}
    fields["Content-Type"] = record["type"]
    fields["Content-Length"] = len(block)
    lines = [f"{k}: {v}" for k, v in fields.items() if v is not None]
    return "\r\n".join(["WARC/1.0", *lines, "", ""]).encode() + block


def convert(spark: SparkSession, arc_path: str, warc_path: str, min_revisit_bytes: int = 0) -> None:
    """ARC files to WARC files. Equal payloads of fewer than ``min_revisit_bytes`` stay responses."""
    narrow = settle(arc_records(spark, arc_path, payloads=False))
    last = (
        narrow.where(F.col("payload_bytes") >= min_revisit_bytes).groupBy("digest")
        .agg(F.max(F.struct("number", "archive", "at", "record_id")).alias("last"))
        .select("digest", F.col("last.record_id").alias("refers_to"))
    )
    revisits = settle(
        narrow.where(F.col("payload_bytes") >= min_revisit_bytes).join(last, "digest")
        .where(F.col("refers_to") != F.col("record_id")).select("archive", "at", "refers_to"))
    wide = arc_records(spark, arc_path, payloads=True)
    rows = wide.join(revisits, ["archive", "at"], "left").select(
        "record_id", "uri", "date", "ip", "digest", "payload_bytes", "refers_to", "mime", "head",
        F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        part = TaskContext.get().partitionId()
        info = f"software: reqsieve\r\nformat: WARC File Format 1.0\r\nisPartOf: {part:05d}\r\n".encode()
        yield warc_record("warcinfo", {"record_id": f"urn:uuid:{uuid.uuid5(NAMESPACE, f'warcinfo {part}')}",
                                       "date": "2000-01-01T00:00:00Z", "type": "application/warc-fields"}, info)
        for batch in batches:
            names = batch.schema.names[:-1]
            for *said, payload in zip(*batch.columns):
                record = dict(zip(names, (x.as_py() for x in said)))
                head = record.pop("head")
                record["type"] = "application/http; msgtype=response" if head else record.pop("mime")
                if record["refers_to"] is not None:
                    yield warc_record("revisit", record, head)
                else:
                    yield warc_record("response" if head else "resource", record, head + payload.as_buffer().to_pybytes())

    (
        rows.mapInArrow(lambda b: _batched(write(b), "record"), "record binary").select(F.col("record").cast("string"))
        .write.options(lineSep="\r\n\r\n", **PACKED).text(warc_path)
    )


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of a WARC file: fields by lower-case names, and the block.

    What has no length that the file holds, no type or no id is skipped up to the next record.
    """
    at = data.find(b"WARC/1.")
    while 0 <= at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        fields = header_fields(data[at:end])
        said = fields.get("content-length", "")
        length = int(said) if re.fullmatch(r"[0-9]{1,18}", said) else -1
        if not 0 <= length <= len(data) - end - 4 or not fields.get("warc-type") or not fields.get("warc-record-id"):
            at = data.find(b"WARC/1.", at + 1)
            continue
        yield fields, data[end + 4: end + 4 + length]
        at = data.find(b"WARC/1.", end + 4 + length)


def _said_digest(fields: dict[str, str]) -> str | None:
    said = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    return said or None


def _said_length(fields: dict[str, str]) -> int | None:
    said = fields.get(LENGTH.lower(), "")
    return int(said) if re.fullmatch(r"[0-9]{1,18}", said) else None


WARC_ROW = ("record_id string, record_type string, uri string, date string, number long, payload_digest string, "
            "payload_bytes long, refers_to_id string")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record but for ``warcinfo``. Lengths and digests of responses are those of the payloads read."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, content in zip(*batch.columns):
                made = []
                for f, block in parse_warc(unpacked(content.as_buffer().to_pybytes())):
                    if (kind := f["warc-type"]) == "warcinfo":
                        continue
                    head, payload = _http(block)
                    kept = kind != "revisit"
                    number = Record(0, {}, head, b"", header_fields(head)).number
                    made.append({
                        "record_id": f["warc-record-id"].strip("<>"), "record_type": kind, "uri": f.get("warc-target-uri"),
                        "date": f.get("warc-date"), "number": number,
                        "payload_digest": digest(payload) if kept else _said_digest(f),
                        "payload_bytes": len(payload) if kept else _said_length(f),
                        "refers_to_id": f.get("warc-refers-to", "").strip("<>") or None,
                    })
                if made:
                    yield pa.RecordBatch.from_pylist(made, pa.schema(
                        [(n, pa.int64() if t == "long" else pa.string()) for n, t in (c.split() for c in WARC_ROW.split(", "))]))

    return _archives(spark, path).mapInArrow(rows, WARC_ROW)


def page_records(spark: SparkSession, warc_path: str) -> DataFrame:
    """The records read back, with the number of the response that a revisit points to."""
    read = settle(read_warc(spark, warc_path))
    responses = read.where("record_type <> 'revisit'").select(
        F.col("record_id").alias("refers_to_id"), F.col("number").alias("refers_to"))
    return read.join(responses, "refers_to_id", "left").select(
        F.col("number").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "uri", "date", "record_id")


#: ``page_records`` over the table ``pages``: base32 is four characters for every five hex digits.
ORACLE = """
with hashed as (
    select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h, max(page_id) over (partition by coalesce(html, '')) as best from pages
), groups as (
    select *, list_transform(range(8), lambda i: cast('0x' || substr(h, cast(5 * i + 1 as bigint), 5) as integer)) as g from hashed
)
select page_id, cast(octet_length(encode(html)) as bigint) as payload_bytes,
       array_to_string(list_transform(g, lambda v: array_to_string(list_transform([15, 10, 5, 0],
         lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> s) & 31) + 1, 1)), '')), '') as payload_digest,
       case when page_id = best then 'response' else 'revisit' end as record_type,
       case when page_id <> best then best end as refers_to
from groups
"""
