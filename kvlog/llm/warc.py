"""Legacy web archives to WARC.

``parse_arc`` reads ARC files of version 1 and 2: the version block names the header layout, each record's header
line is split by it, and the declared length says where the payload ends (payloads may hold anything, header lines
too).  ``_convert`` and ``_records`` give a record what WARC asks for and ARC lacks: a record id (a UUID made of source, offset and
URL, so a rerun gives the same), an ISO timestamp, a record type and digests.  Of records with equal payloads of at
least MIN_DUPLICATE bytes the one with the largest key stays a response and the others become revisits of it.

Archives are written by Spark's text writer (each record is a line that ends in CRLF CRLF; compressed with gzip),
so any store that Spark can write takes them, and read by the binaryFile source, a file a row.

Defined results: a null payload is empty; a URL keeps its place with blanks and control characters quoted, a missing one
is "unknown:"; a null page_id is never the largest; a very long page is one record, held whole by one task; an unknown date becomes 1970-01-01; equal payloads below MIN_DUPLICATE
bytes are all responses; ties cannot occur between distinct keys, repeated keys with equal payloads are a response
each if theirs is the largest; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import frugal, strings
from .scratch import scratch_path

# The two layouts of ARC header lines, by version.
FIELDS = {
    "1": ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    "2": ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
MIN_DUPLICATE = 1000
#: Rows of one archive file; a file is one row when it is read back.
FILE_ROWS = 4000
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


class ArcError(ValueError):
    pass


def quoted(url: str | None) -> str:
    """A URL as one field of a header line; a missing one is "unknown:"."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or "unknown:"


def write_arc(records: list[dict], version: str, name: str = "pages.arc") -> bytes:
    """An ARC file of records {url, ip, date, type, payload: bytes, status, location}."""
    head = f"{version} 0 kvlog\n{' '.join(FIELDS[version])}\n".encode()
    extra = " - - - 0 " + name if version == "2" else ""
    out = [f"filedesc://{name} 0.0.0.0 19700101000000 text/plain{' 200' + extra if version == '2' else ''} {len(head)}\n".encode(), head, b"\n"]
    at = sum(map(len, out))
    for r in records:
        url = quoted(r.get("url"))
        more = f" {r.get('status', 200)} - - {at} {name}" if version == "2" else ""
        line = f"{url} {r.get('ip', '0.0.0.0')} {r.get('date', '19700101000000')} {r.get('type', 'text/html')}{more} {len(r['payload'])}\n".encode()
        out += [line, r["payload"], b"\n"]
        at += len(line) + len(r["payload"]) + 1
    return b"".join(out)


def parse_arc(data: bytes, name: str = "") -> Iterator[dict]:
    """Records of an ARC file: its fields by their names, ``payload`` and ``offset``.  The version block is no record."""
    fields, at = None, 0
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ArcError(f"{name}: header line without end at {at}")
        parts = data[at:end].rstrip(b"\r").decode("utf-8", "replace").split(" ")
        try:
            length = int(parts[-1])
        except ValueError:
            raise ArcError(f"{name}: no length in the header line at {at}") from None
        payload = data[end + 1 : end + 1 + length]
        if length < 0 or len(payload) < length:
            raise ArcError(f"{name}: record at {at} is cut off")
        if parts[0].startswith("filedesc:"):
            lines = payload.decode("utf-8", "replace").split("\n")
            version = lines[0].split(" ")[0]
            fields = FIELDS.get(version)
            if fields is None:
                raise ArcError(f"{name}: version {version!r} is unknown")
        elif fields is None:
            raise ArcError(f"{name}: no version block before the record at {at}")
        else:
            if len(parts) != len(fields):  # an unquoted blank in the URL, as old crawlers wrote them
                parts = [" ".join(parts[: len(parts) - len(fields) + 1]), *parts[len(parts) - len(fields) + 1 :]]
            if len(parts) != len(fields):
                raise ArcError(f"{name}: {len(parts)} fields in the header line at {at}")
            yield dict(zip(fields, parts)) | {"payload": payload, "offset": at}
        at = end + 1 + length


def iso_date(date: str) -> str:
    """14 (or 12, or 8) digits to the form of WARC-Date; anything else is the epoch."""
    m = re.fullmatch(r"(\d{4})(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])(?:([01]\d|2[0-3])([0-5]\d)([0-5]\d)?)?", date)
    return "{}-{}-{}T{}:{}:{}Z".format(*(x or "00" for x in m.groups())) if m else "1970-01-01T00:00:00Z"


def record_id(source: str, url: str) -> str:
    return str(uuid.uuid5(_NAMESPACE, f"{source} {url}"))


def warc_head(record_type: str, rid: str, url: str, date: str, digest: str, length: int, content_type: str, page: str, refers_to: tuple[str, str] | None = None, full: int | None = None) -> str:
    lines = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <urn:uuid:{rid}>", f"WARC-Target-URI: {url}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Page-Key: {page}"]
    if refers_to:
        lines += [f"WARC-Refers-To: <urn:uuid:{refers_to[0]}>", f"X-Refers-To-Key: {refers_to[1]}", f"X-Payload-Length: {full}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join([*lines, f"Content-Type: {content_type}", f"Content-Length: {length}", "", ""])


def parse_warc(source: bytes | BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and payload of each record, by declared lengths; one record at a time is held."""
    stream = io.BytesIO(source) if isinstance(source, bytes) else source
    while first := stream.readline():
        if not first.startswith(b"WARC/"):
            raise ValueError("no WARC record where one should begin")
        head = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            head[name.lower()] = value
        n = int(head["content-length"])
        body = stream.read(n)
        if len(body) < n or stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record is cut off")
        yield head, body


@frugal
def _convert(batches):
    """Rows to ARC records, those through the parser, and what it finds to the parts of a WARC record."""
    for batch in batches:
        keys, urls = batch.column("page_id").to_pylist(), strings(batch.column("url"))
        bodies = [x or b"" for x in batch.column("html").cast(pa.binary()).to_pylist()]
        out: dict[str, list] = {c: [] for c in _PARTS}
        for version, part in (("1", range(0, len(keys), 2)), ("2", range(1, len(keys), 2))):
            data = write_arc([{"url": urls[i], "payload": bodies[i]} for i in part], version)
            for i, r in zip(part, parse_arc(data)):
                payload = r["payload"]
                found = (keys[i], payload, record_id(f"page {keys[i]}", r["URL"]), r["URL"], iso_date(r["Archive-date"]), r["Content-type"], hashlib.sha1(payload).hexdigest(), hashlib.sha256(payload).digest(), len(payload))
                for c, x in zip(_PARTS, found):
                    out[c].append(x)
        yield pa.RecordBatch.from_arrays([pa.array(out[c], t) for c, t in _PARTS.items()], names=list(_PARTS))


_PARTS = {"page_id": pa.int64(), "payload": pa.binary(), "rid": pa.string(), "uri": pa.string(), "date": pa.string(), "type": pa.string(), "sha1": pa.string(), "sha256": pa.binary(), "size": pa.int64()}
_PARTS_SQL = "page_id long, payload binary, rid string, uri string, date string, type string, sha1 string, sha256 binary, size long"


@frugal
def _records(batches):
    for batch in batches:
        lines = []
        for r in batch.to_pylist():
            page = "" if r["page_id"] is None else str(r["page_id"])
            refers = (record_id(f"page {r['winner']}", r["winner_uri"]), str(r["winner"])) if r["revisit"] else None
            head = warc_head("revisit" if refers else "response", r["rid"], r["uri"], r["date"], r["sha1"], 0 if refers else r["size"], r["type"], page, refers, r["size"])
            lines.append(head.encode() + (r["payload"] or b""))
        yield pa.RecordBatch.from_arrays([pa.array(lines, pa.binary())], names=["value"])


def write_archives(pages: DataFrame, path: str) -> None:
    """One WARC record per row of ``pages`` (page_id, url, html), in compressed files under ``path``.  Payload, URI,
    type and date of each are what the ARC parser returned."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    parts = rows.mapInArrow(_convert, _PARTS_SQL)
    body = F.coalesce("html", F.lit("")).cast("binary")
    large = rows.where(F.octet_length(body) >= MIN_DUPLICATE).select("page_id", "url", F.sha2(body, 256).alias("hex"))
    # the winner of each repeated payload, as narrow rows; then one wide equi-join, which may split a hot digest
    winner = large.groupBy("hex").agg(F.max(F.struct("page_id", "url")).alias("w"), F.count("*").alias("n")).where("n > 1")
    # quoted as ``quoted`` does, so that the name made of it is that of the winner's record
    uri = F.coalesce(F.col("w.url"), F.lit(""))
    for c in (*range(0x21), 0x7F):
        uri = F.replace(uri, F.lit(chr(c)), F.lit(f"%{c:02X}"))
    uri = F.when(uri == "", F.lit("unknown:")).otherwise(uri)
    winner = winner.select(F.unhex("hex").alias("sha256"), F.col("w.page_id").alias("winner"), uri.alias("winner_uri"))
    joined = parts.join(winner, "sha256", "left")
    revisit = F.coalesce((F.col("winner") != F.col("page_id")) | F.col("page_id").isNull(), F.lit(False)) & F.col("winner").isNotNull() & (F.col("size") >= MIN_DUPLICATE)
    joined = joined.withColumn("revisit", revisit).withColumn("payload", F.when(~F.col("revisit"), F.col("payload")))
    lines = joined.drop("sha256").mapInArrow(_records, "value binary").select(F.col("value").cast("string").alias("value"))
    lines.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", FILE_ROWS).text(path)


def arc_pages(spark, path: str) -> DataFrame:
    """The records of the ARC files (plain or gzip) under ``path`` as rows for ``write_archives``: page_id (made of file
    and offset), url, html, and the fields of their header line.  A file is parsed by one task."""

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                data = gzip.decompress(data) if data.startswith(b"\x1f\x8b") else data
                for r in parse_arc(data, name):
                    key = int.from_bytes(hashlib.sha1(f"{name} {r['offset']}".encode()).digest()[:8], "big", signed=True)
                    row = {"page_id": key, "url": r["URL"], "html": r["payload"], "ip": r["IP-address"], "date": iso_date(r["Archive-date"]), "type": r["Content-type"], "status": r.get("Result-code"), "checksum": r.get("Checksum"), "location": r.get("Location")}
                    yield pa.RecordBatch.from_pylist([row], schema=schema)

    texts = ("ip", "date", "type", "status", "checksum", "location")
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.binary())] + [(c, pa.string()) for c in texts])
    found = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "page_id long, url string, html binary, " + ", ".join(f"{c} string" for c in texts))
    return found.withColumn("html", F.col("html").cast("string"))


@frugal
def _read(batches):
    for batch in batches:
        for data in batch.column("content").to_pylist():
            rows = []
            for head, body in parse_warc(gzip.open(io.BytesIO(data))):
                size, digest = len(body), hashlib.sha1(body).hexdigest()
                stated = head["warc-payload-digest"].removeprefix("sha1:")
                if head["warc-type"] == "revisit":
                    size, digest = int(head["x-payload-length"]), stated
                elif digest != stated:
                    raise ValueError(f"digest of {head['warc-record-id']} differs")
                key, other = head["x-page-key"], head.get("x-refers-to-key")
                rows.append((int(key) if key else None, head["warc-target-uri"], head["warc-date"], size, digest, head["warc-type"], int(other) if other else None, head["warc-record-id"], head.get("warc-refers-to")))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _TYPES)], names=_NAMES)


_NAMES = ["page_id", "url", "date", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "refers_to_id"]
_TYPES = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
_READ = "page_id long, url string, date string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, refers_to_id string"


def read_archives(spark, path: str) -> DataFrame:
    """One row per record of the archives under ``path``; payload digests of responses are verified."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(_read, _READ)


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every row, from archives written and read."""
    path = scratch_path(pages.sparkSession, "warc")
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
w AS (SELECT html, max(page_id) AS winner FROM p WHERE n >= {MIN_DUPLICATE} GROUP BY html)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN winner IS NOT NULL AND winner IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN winner IS DISTINCT FROM page_id THEN winner END AS refers_to
FROM p LEFT JOIN w USING (html)
"""
