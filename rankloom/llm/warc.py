"""Legacy ARC archives, converted to WARC and read back.

An ARC file is a version line block and then records: a header line whose fields depend
on the file's version, and a body of the declared length. The converter reads them by
these lengths alone and makes WARC records with identifiers, timestamps, types and
digests. Archives are written as text files whose rows end in the formats' record
separators, so Spark's own writer makes valid archives in any store; they are read back
as whole files of bounded size, by declared lengths again.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import shared_folder, written

#: Payloads from this many bytes on are replaced by a reference where they repeat.
REVISIT_BYTES = 1000
#: Records in one archive file.
FILE_RECORDS = 2000

# The fields of ARC header lines, by the version of the file.
ARC_FIELDS = {
    1: ["url", "ip", "date", "type", "length"],
    2: ["url", "ip", "date", "type", "result", "checksum", "location", "offset", "filename", "length"],
}
NO_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MISSING = "-"
#: How the body of a version block begins.
_VERSION = re.compile(rb"[12] \d+ [^\n]+\n")


@dataclass(frozen=True)
class ArcRecord:
    """One record: its header fields and its body."""

    fields: dict[str, str]
    body: bytes

    @property
    def payload(self) -> bytes:
        """What follows the HTTP header, if the body has one."""
        return split_http(self.body)[1]


def split_http(body: bytes) -> tuple[bytes, bytes]:
    """The HTTP header with its blank line and the rest; no header if there is none."""
    if not body.startswith(b"HTTP/"):
        return b"", body
    at = body.find(b"\r\n\r\n")
    return (body, b"") if at < 0 else (body[: at + 4], body[at + 4 :])


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC file of either version, without its version block.

    Bodies are taken by the declared length, so they may hold anything. Line ends between
    records are skipped. A version block is a record of type text/plain whose url begins
    with ``filedesc://`` and whose body names the version, a number, the maker and the fields. A header line with the wrong number of fields, or a body that
    ends early, raises ``ValueError`` with its place.
    """
    version, at = 1, 0
    while at < len(data):
        if data[at : at + 1] in b"\r\n":
            at += 1
            continue
        end = data.find(b"\n", at)
        line = data[at : end if end >= 0 else len(data)].decode("utf-8", "replace").rstrip("\r")
        # A version block is one by its body, too; a page may have such a url.
        about = line.startswith("filedesc://") and bool(_VERSION.match(data, end + 1)) and end >= 0
        names = ARC_FIELDS[1 if about else version]
        values = line.split(" ")
        if about and len(values) == len(ARC_FIELDS[2]):
            names = ARC_FIELDS[2]
        if len(values) != len(names) or not values[-1].isdigit() or end < 0:
            raise ValueError(f"no ARC header line at byte {at}: {line[:80]!r}")
        fields = dict(zip(names, values))
        body = data[end + 1 : end + 1 + int(fields["length"])]
        if len(body) != int(fields["length"]):
            raise ValueError(f"the record at byte {at} ends early")
        at = end + 1 + len(body)
        if about:
            version = int(body.split(b" ", 1)[0] or b"1")
        else:
            yield ArcRecord(fields, body)


def record_id(name: str) -> str:
    """A WARC identifier that is the same whenever the record is converted again."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def warc_date(arc_date: str) -> str:
    """``YYYYMMDDhhmmss`` (or a prefix from the day on) as a WARC timestamp."""
    digits = (arc_date + "00000000000000")[:14] if len(arc_date) >= 8 else "19700101000000"
    if not digits.isdigit():
        digits = "19700101000000"
    d = digits
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def payload_digest(payload: bytes) -> str:
    return hashlib.sha1(payload).hexdigest()


def _base32(sha1_hex: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def to_warc(record: ArcRecord, refers_to: str | None) -> bytes:
    """The WARC record for an ARC record, without the separator behind it.

    With ``refers_to``, a record name, it is a revisit that holds the HTTP header alone.
    Without an HTTP header it is a resource. All digests are of the full payload.
    """
    header, payload = split_http(record.body)
    kind = "revisit" if refers_to else "response" if header else "resource"
    block = header if refers_to else record.body
    http = "application/http; msgtype=response"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(record_name(record))}",
        f"WARC-Target-URI: {record.fields['url']}",
        f"WARC-Date: {warc_date(record.fields['date'])}",
        f"WARC-Payload-Digest: {_base32(payload_digest(payload))}",
        f"Content-Type: {http if header else record.fields['type']}",
        f"WARC-Original-Payload-Length: {len(payload)}",
    ]
    if record.fields.get("ip", _MISSING) not in (_MISSING, "0.0.0.0"):
        lines.append(f"WARC-IP-Address: {record.fields['ip']}")
    if record.fields.get("filename", _MISSING) != _MISSING:
        lines += [f"WARC-Filename: {record.fields['filename']}", f"ARC-Offset: {record.fields['offset']}"]
    if refers_to:
        lines += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {NO_PROFILE}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def record_name(record: ArcRecord) -> str:
    """What a record's identifier is made from; equal names mean equal payloads."""
    fields = [record.fields.get(k, _MISSING) for k in ("filename", "offset", "url", "date")]
    return " ".join([*fields, payload_digest(record.payload)])


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of a WARC file."""
    at = 0
    while at < len(data):
        if data[at : at + 1] in b"\r\n":
            at += 1
            continue
        end = data.find(b"\r\n\r\n", at)
        lines = data[at : end if end >= 0 else len(data)].decode("utf-8", "replace").split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        if end < 0 or not lines[0].startswith("WARC/") or not fields.get("content-length", "").isdigit():
            raise ValueError(f"no WARC header at byte {at}")
        at = end + 4 + int(fields["content-length"])
        if at > len(data):
            raise ValueError("the last record ends early")
        yield fields, data[end + 4 : at]


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """Whole files of a folder, unpacked: ``(path, content)``, read by Spark."""
    return spark.read.format("binaryFile").load(folder).select("path", "content")


def _unpacked(content: bytes) -> bytes:
    return gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content


def write_arc(pages: DataFrame, folder: str) -> None:
    """Write ``(page_id, url, html)`` as ARC files of version 2.

    The page's id is kept as the record's offset in a file name made up for it. A null
    html is an empty body, a null or blank url stays a dash; white space in a url is
    escaped, as it would end the field.
    """
    url = F.regexp_replace(F.coalesce(F.nullif(F.trim("url"), F.lit("")), F.lit(_MISSING)), r"\s", "%20")
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    size = F.octet_length(html).cast("string")
    body = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size,
        F.lit("\r\n\r\n"), html,
    )
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(_MISSING))
    line = F.concat_ws(
        " ", url, F.lit("0.0.0.0"), F.lit("20240101000000"), F.lit("text/html"), F.lit("200"),
        F.lit(_MISSING), F.lit(_MISSING), page, F.lit("pages.arc"), F.octet_length(body).cast("string"),
    )
    names = "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename"
    about = f"2 0 rankloom\n{names} Archive-length\n"
    first = F.lit(f"filedesc://pages.arc 0.0.0.0 20240101000000 text/plain {len(about)}\n{about}")
    # Each record comes with its own version block, so that files may be cut anywhere.
    rows = pages.select(F.concat(first, line, F.lit("\n"), body).alias("value"))
    _write(rows, folder, "\n")


def _write(rows: DataFrame, folder: str, separator: str) -> None:
    writer = rows.write.option("lineSep", separator).option("compression", "gzip")
    writer.option("maxRecordsPerFile", FILE_RECORDS).text(folder)


def _as_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else ([] for _ in schema)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


_ARC = pa.schema([
    ("path", pa.string()), ("name", pa.string()), ("page_id", pa.int64()),
    ("bytes", pa.int64()), ("sha256", pa.string()),
])
_WARC = pa.schema([
    ("record_id", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_id", pa.string()),
    ("target_uri", pa.string()), ("date", pa.string()),
])


def _number(text: str) -> int | None:
    return int(text) if text.removeprefix("-").isdigit() else None


def arc_records(spark: SparkSession, folder: str) -> DataFrame:
    """What choosing responses needs of each ARC record: file, name, page, size and digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = []
                for record in read_arc(_unpacked(content.as_py())):
                    payload, page = record.payload, _number(record.fields.get("offset", ""))
                    sha256 = hashlib.sha256(payload).hexdigest()
                    rows.append((path, record_name(record), page, len(payload), sha256))
                yield _as_batch(rows, _ARC)

    schema = "path string, name string, page_id bigint, bytes bigint, sha256 string"
    return _files(spark, folder).mapInArrow(run, schema)


def revisits(records: DataFrame, least_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Rows ``(path, name, refers_to)`` of the records that repeat a payload of such a size.

    Of equal payloads the record with the largest page, then name, is the response. A
    class of very many records is one row a task before the shuffle, and the join back
    meets two plain exchanges, which Spark can split.
    """
    large = written(records.where(F.col("bytes") >= least_bytes), "arc-index")
    first = large.groupBy("sha256", "bytes").agg(
        F.max(F.struct("page_id", "name")).alias("first"), F.count(F.lit(1)).alias("members")
    )
    first = first.where("members > 1").select("sha256", "bytes", F.col("first.name").alias("refers_to"))
    first = written(first, "responses")
    found = large.join(first, ["sha256", "bytes"]).where("name <> refers_to")
    return found.select("path", "name", "refers_to").distinct()


def convert(spark: SparkSession, arc_folder: str, warc_folder: str, least_bytes: int = REVISIT_BYTES) -> None:
    """Write the records of all ARC files of a folder as WARC files."""
    repeats = revisits(arc_records(spark, arc_folder), least_bytes)
    # A file holds a bounded number of records, and so does its list.
    pairs = F.collect_list(F.struct("name", "refers_to"))
    lists = repeats.groupBy("path").agg(F.map_from_entries(pairs).alias("refers"))
    files = _files(spark, arc_folder).join(lists, "path", "left").select(
        "content",
        F.map_keys("refers").alias("names"),
        F.map_values("refers").alias("refers"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, names, refers in zip(*batch.columns):
                known = dict(zip(names.as_py() or [], refers.as_py() or []))
                out, size = [], 0
                for record in read_arc(_unpacked(content.as_py())):
                    out.append(to_warc(record, known.get(record_name(record))))
                    size += len(out[-1])
                    if size > 1 << 24:
                        yield pa.record_batch([pa.array(out, pa.binary())], ["value"])
                        out, size = [], 0
                yield pa.record_batch([pa.array(out, pa.binary())], ["value"])

    # Bytes cast to a string stay the bytes they are.
    _write(files.mapInArrow(run, "value binary").select(F.col("value").cast("string")), warc_folder, "\r\n\r\n")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The records of all WARC files of a folder, one row each; ``refers_id`` of revisits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(1):
                rows = []
                for fields, block in read_warc(_unpacked(content.as_py())):
                    kind = fields["warc-type"]
                    sha1 = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                    size = int(fields["warc-original-payload-length"])
                    if kind != "revisit":
                        payload = split_http(block)[1] if kind == "response" else block
                        if (len(payload), payload_digest(payload)) != (size, sha1):
                            raise ValueError(f"{fields['warc-record-id']} has another payload than it declares")
                    rows.append((
                        fields["warc-record-id"], _number(fields.get("arc-offset", "")), size, sha1,
                        kind, fields.get("warc-refers-to"), fields["warc-target-uri"], fields["warc-date"],
                    ))
                yield _as_batch(rows, _WARC)

    schema = (
        "record_id string, page_id bigint, payload_bytes bigint, payload_digest string,"
        " record_type string, refers_id string, target_uri string, date string"
    )
    return _files(spark, folder).mapInArrow(run, schema)


def archived_pages(pages: DataFrame, least_bytes: int = REVISIT_BYTES) -> DataFrame:
    """``pages`` as ARC files, converted to WARC files and read back, one row a page.

    Columns ``(page_id, payload_bytes, payload_digest, record_type, refers_to, record_id,
    target_uri, date)``; the payload is the html in UTF-8, null as empty. A page without
    id is a record without one. Rows that repeat are written each and have equal rows;
    other columns are not read, and an empty table gives no rows. The archives stay in
    the shared folder.
    """
    spark = pages.sparkSession
    arc, warc = shared_folder(spark, "arc"), shared_folder(spark, "warc")
    write_arc(pages, arc)
    convert(spark, arc, warc, least_bytes)
    records = written(read_archives(spark, warc), "warc-index")
    targets = records.where("record_type = 'response'").select(
        F.col("record_id").alias("refers_id"), F.col("page_id").alias("refers_to")
    )
    targets = targets.distinct()
    targets = written(targets, "warc-targets")
    return records.join(targets, "refers_id", "left").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to",
        "record_id", "target_uri", "date",
    )
