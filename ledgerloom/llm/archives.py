"""Web archives: the legacy ARC format, versions 1 and 2, converted to WARC.

An archive is a row of a text table with one row a file, so Spark's own writer puts it where it belongs and Spark's own reader
brings it back; tasks only see bytes. An ARC file opens with a version block that names the fields of the header lines that
follow; each record has as many bytes as its line declares, whatever they hold. A record becomes a WARC record with an
identifier that follows from its place, its timestamp in ISO form, SHA-1 digests of block and payload, and a type: the version
block's is ``warcinfo``, that of an HTTP answer ``response``, or ``revisit`` where a later equal payload is kept, and that of
anything else ``resource``.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, ship, written

#: Bytes of an archive, about, and of what a task hands on at once.
ARCHIVE, HANDED = 32_000_000, 4_000_000
#: Smaller payloads are never revisits.
REVISIT = 1000
#: What archives are written with; pages have no time of their own.
CODEC, LEVEL, FETCHED, HOST = "gzip", "BEST_SPEED", "19960101000000", "0.0.0.0"
#: Fixed values of the formats: names of an ARC's fields by version, and the profile of a revisit.
FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: Fields of our own: whose page it is, how long a payload is that a revisit leaves out, and whose page has it.
PAGE, LENGTH, REFERS = "Page-ID", "Payload-Length", "Refers-To-Page-ID"


def _one_line(text: str) -> str:
    """A value for a header: controls and blanks as percent escapes."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in text)


def _whole(data: bytes) -> bytes:
    """The bytes of a file, of any number of gzip members or plain."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data[:2] == b"\x1f\x8b":
        one = zlib.decompressobj(31)
        out.append(one.decompress(data))
        data = one.unused_data
    return b"".join(out)


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _split(block: bytes) -> tuple[bytes, bytes] | None:
    """(head, payload) of an HTTP answer."""
    if not block.startswith(b"HTTP/"):
        return None
    end = block.find(b"\r\n\r\n")
    return (block, b"") if end < 0 else (block[: end + 4], block[end + 4 :])


def _values(head: bytes) -> dict[str, str]:
    """Fields of a head, by lower-case name."""
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines if line)}


def _files(sep: str, opening, size: int, record):
    """Rows of one archive each: ``opening(name)`` and then ``record(row)`` after ``record(row)``. The last ``sep`` is left to
    the writer."""

    def of(batches):
        made, held, parts = 0, 0, []

        def close():
            nonlocal made, held
            made += 1
            data = b"".join(parts)[: -len(sep)]
            held = 0
            parts.clear()
            # A text column may hold any bytes: payloads need not be UTF-8, and nobody decodes them.
            ends = pa.py_buffer(np.array([0, len(data)], np.int32))
            return pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.string(), 1, [None, ends, pa.py_buffer(data)])], ["value"])

        for b in batches:
            for i in range(b.num_rows):
                if not parts:
                    parts.append(opening(f"{TaskContext.get().partitionId():06}-{made:06}"))
                one = record({name: column[i].as_py() for name, column in zip(b.schema.names, b.columns, strict=True)})
                parts.append(one)
                held += len(one)
                if held >= size:
                    yield close()
        if parts:
            yield close()

    return of


def _write(rows: DataFrame, path: str, sep: str) -> None:
    rows.write.option("maxRecordsPerFile", 1).option("lineSep", sep).option("compression", CODEC).option("zlib.compress.level", LEVEL).text(path)


# ---- ARC -------------------------------------------------------------------------------------------------------------


def _arc_line(version: int, url: str, mime: str, status: str, name: str, length: int) -> bytes:
    known = {"URL": url, "IP-address": HOST, "Archive-date": FETCHED, "Content-type": mime, "Result-code": status, "Checksum": "-", "Location": "-", "Offset": "0", "Filename": name, "Archive-length": str(length)}
    return " ".join(known[f] for f in FIELDS[version]).encode() + b"\n"


def write_arc(pages: DataFrame, path: str, size: int = ARCHIVE, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write a record for every row into ARC files under ``path``, those of even tasks in version 1, of odd ones in version 2.

    A null html is an empty payload, a null url ``unknown:``; the id goes into the answer's head, a null one is left out;
    repeated rows are records of their own; other columns are not written; an empty table gives no archive.
    """
    ship(pages.sparkSession)

    def opening(name: str) -> bytes:
        version = 1 + TaskContext.get().partitionId() % 2
        block = f"{version} 0 Ledgerloom\n{' '.join(FIELDS[version])}\n".encode()
        return _arc_line(version, f"filedesc://{name}.arc", "text/plain", "200", f"{name}.arc", len(block)) + block + b"\n"

    def record(row: dict) -> bytes:
        payload = (row["html"] or "").encode()
        page = "" if row["id"] is None else f"{PAGE}: {_one_line(row['id'])}\r\n"
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{page}\r\n".encode()
        url = "unknown:" if row["url"] is None else _one_line(row["url"]) or "unknown:"
        return _arc_line(1 + TaskContext.get().partitionId() % 2, url, "text/html", "200", "-", len(head) + len(payload)) + head + payload + b"\n"

    rows = pages.select(F.col(id_col).cast("string").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    _write(rows.mapInArrow(_files("\n", opening, size, record), "value string"), path, "\n")


def arc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields of the header line, block) of every record of an ARC file, the version block first. Raises where the file opens
    with none, a line has too few fields, or a block is shorter than declared."""
    names, at = None, 0
    while at < len(data):
        end = data.find(b"\n", at)
        line = data[at : len(data) if end < 0 else end].decode("utf-8", "replace").rstrip("\r")
        if not line:
            at = end + 1 if end >= 0 else len(data)
            continue
        if names is None:
            # The version stands in the block, whose length is the last field of either version.
            found = data[end + 1 : end + 2]
            if not line.startswith("filedesc:") or found not in (b"1", b"2"):
                raise ValueError("an ARC file opens with its version block")
            names = FIELDS[int(found)]
        # A URL with blanks keeps them: the other fields have none.
        fields = line.rsplit(" ", len(names) - 1)
        if len(fields) < len(names) or not fields[-1].isdigit():
            raise ValueError(f"no ARC header: {line[:200]!r}")
        length = int(fields[-1])
        block = data[end + 1 : end + 1 + length]
        if end < 0 or len(block) < length:
            raise ValueError(f"{length} bytes declared, {len(block)} there: {line[:200]!r}")
        yield dict(zip(names, fields, strict=True)), block
        at = end + 1 + length


ARC = "archive string, at long, kind string, url string, ip string, fetched string, mime string, page_id string, payload_bytes long, payload_digest string, content binary, head binary, payload binary"


def _read_arc(payloads: bool):
    def of(batches):
        rows, held = [], 0
        types = [pa.string(), pa.int64(), *[pa.string()] * 6, pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary()]
        names = [x.split()[0] for x in ARC.split(", ")]

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
            rows.clear()
            return out

        for b in batches:
            for path, content in zip(b["path"].to_pylist(), b["content"], strict=True):
                for at, (f, block) in enumerate(arc_records(_whole(content.as_py()))):
                    parts = _split(block)
                    head, payload = parts or (b"", block)
                    kind = "warcinfo" if at == 0 else "response" if parts else "resource"
                    page = _values(head).get(PAGE.lower()) if parts else None
                    kept = (head, payload) if payloads else (None, None)
                    rows.append((path, at, kind, f["URL"], f["IP-address"], f["Archive-date"], f["Content-type"], page, len(payload), hashlib.sha1(payload).hexdigest(), hashlib.sha256(payload).digest(), *kept))
                    held += len(block) if payloads else 300
                    if held >= HANDED:
                        yield flush()
                        held = 0
        if rows:
            yield flush()

    return of


def read_arc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all ARC files under ``path``: file and place, kind (``warcinfo``, ``response``, ``resource``), the header's
    fields, ``page_id`` where the answer's head has one, and the payload's bytes, SHA-1 (hex), SHA-256 (``content``), and,
    unless ``payloads`` is false, head and payload. A damaged file fails the job. No files, no rows."""
    ship(spark)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_read_arc(payloads), ARC)


# ---- WARC ------------------------------------------------------------------------------------------------------------


def _record_id(*of) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1('/'.join(map(str, of)).encode()).digest()[:16], version=5)}>"


def _warc(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))] if v is not None)
    return b"WARC/1.0\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def _iso(fetched: str) -> str:
    """An ARC's timestamp in ISO form; what it leaves out (older files stop at the day) is the first of its kind."""
    d = (fetched if fetched.isdigit() else "").ljust(4, "0")
    d += "00000101000000"[len(d) :] if len(d) < 14 else ""
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def _warc_record(row: dict) -> bytes:
    revisit = row["last_at"] is not None and (row["archive"], row["at"]) != (row["last_archive"], row["last_at"])
    kind = "revisit" if revisit else row["kind"]
    http = row["kind"] == "response"
    block = row["head"] if revisit else row["head"] + row["payload"]
    fields = [
        ("WARC-Type", kind),
        ("WARC-Target-URI", None if kind == "warcinfo" else row["url"]),
        ("WARC-Date", _iso(row["fetched"])),
        ("WARC-Record-ID", _record_id(row["archive"], row["at"])),
        ("WARC-IP-Address", row["ip"] if http else None),
        ("WARC-Profile", PROFILE if revisit else None),
        ("WARC-Refers-To", _record_id(row["last_archive"], row["last_at"]) if revisit else None),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(row["payload_digest"])).decode() if http else None),
        ("WARC-Block-Digest", _sha1(block)),
        (PAGE, row["page_id"]),
        (LENGTH, str(row["payload_bytes"]) if revisit else None),
        (REFERS, row["last_page"] if revisit else None),
        ("Content-Type", "application/http; msgtype=response" if http else row["mime"]),
    ]
    return _warc(fields, block)


def convert(spark: SparkSession, arc_path: str, path: str, size: int = ARCHIVE) -> None:
    """Write all records of the ARC files under ``arc_path`` as WARC files under ``path``.

    Of HTTP answers with one payload of ``REVISIT`` bytes or more, the one of the largest page (as a number; then the last by
    file and place) is the response and the others revisit it. Answers meet by SHA-256 of the payload; a payload that a third
    of all share is one row of the side they meet.
    """
    order = F.struct(F.col("page_id").try_cast("decimal(38,0)").alias("number"), "page_id", "archive", "at")
    seen = read_arc(spark, arc_path, payloads=False).filter((F.col("kind") == "response") & (F.col("payload_bytes") >= REVISIT))
    last = seen.groupBy("content").agg(F.max(order).alias("last"), F.count("*").alias("n")).filter("n > 1")
    last = written(last.select("content", F.col("last.page_id").alias("last_page"), F.col("last.archive").alias("last_archive"), F.col("last.at").alias("last_at")))
    rows = read_arc(spark, arc_path).join(last, "content", "left")

    def opening(name: str) -> bytes:
        block = b"software: Ledgerloom\r\nformat: WARC File Format 1.0\r\n"
        return _warc([("WARC-Type", "warcinfo"), ("WARC-Date", _iso(FETCHED)), ("WARC-Record-ID", _record_id("warcinfo", name)), ("WARC-Filename", f"{name}.warc"), ("WARC-Block-Digest", _sha1(block)), ("Content-Type", "application/warc-fields")], block)

    _write(rows.mapInArrow(_files("\r\n\r\n", opening, size, _warc_record), "value string"), path, "\r\n\r\n")


def warc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of every record of a WARC file. Raises where a record has no such head, no length, or
    fewer bytes than declared."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC head: {data[at : at + 80]!r}")
        fields = _values(data[at:end])
        length = fields.get("content-length", "")
        if not length.isdigit():
            raise ValueError("a WARC record without its length")
        block = data[end + 4 : end + 4 + int(length)]
        if len(block) < int(length) or not data.startswith(b"\r\n\r\n", end + 4 + int(length)):
            raise ValueError(f"{length} bytes declared, {len(block)} there, or no end of the record")
        yield fields, block
        at = end + 8 + int(length)


WARC = "archive string, at long, record_id string, record_type string, target string, date string, page_id string, payload_bytes long, payload_digest string, refers_to_record string, refers_to string, payload binary"


def _hex(digest: str | None) -> str | None:
    return base64.b32decode(digest.removeprefix("sha1:")).hex() if digest else None


def _read_warc(payloads: bool):
    def of(batches):
        rows, held = [], 0
        types = [pa.string(), pa.int64(), *[pa.string()] * 5, pa.int64(), *[pa.string()] * 3, pa.binary()]
        names = [x.split()[0] for x in WARC.split(", ")]

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
            rows.clear()
            return out

        for b in batches:
            for path, content in zip(b["path"].to_pylist(), b["content"], strict=True):
                for at, (f, block) in enumerate(warc_records(_whole(content.as_py()))):
                    if f.get("warc-block-digest", _sha1(block)) != _sha1(block):
                        raise ValueError(f"{path}: record {at} is not what its digest says")
                    kind = f.get("warc-type")
                    parts = _split(block)
                    payload = None if kind == "revisit" else parts[1] if parts else block
                    length = len(payload) if payload is not None else int(f[LENGTH.lower()]) if LENGTH.lower() in f else None
                    digest = _hex(f.get("warc-payload-digest")) if payload is None else hashlib.sha1(payload).hexdigest()
                    rows.append((path, at, f.get("warc-record-id"), kind, f.get("warc-target-uri"), f.get("warc-date"), f.get(PAGE.lower()), length, digest, f.get("warc-refers-to"), f.get(REFERS.lower()), payload if payloads else None))
                    held += len(block) if payloads else 500
                    if held >= HANDED:
                        yield flush()
                        held = 0
        if rows:
            yield flush()

    return of


def read_warc(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """The records of all WARC files under ``path``, with their digests checked: identifier, type, target, date, page, bytes and
    SHA-1 (hex) of the payload (of a revisit's, which is elsewhere, as stated), the record and page it refers to, and the
    payload itself where asked for. A damaged file fails the job. No files, no rows."""
    ship(spark)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_read_warc(payloads), WARC)


def archive_pages(pages: DataFrame, size: int = ARCHIVE) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as ARC files to the shared folder, convert them to WARC, and read those back: a row a
    page with ``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type`` and ``refers_to``.

    Nulls and repeated rows as in ``write_arc`` and ``convert``: of rows of one id and html one is the response. An empty table
    gives no rows.
    """
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/archives/{uuid.uuid4().hex}"
    kind = pages.schema["page_id"].dataType
    write_arc(pages, f"{folder}/arc", size)
    convert(spark, f"{folder}/arc", f"{folder}/warc", size)
    back = read_warc(spark, f"{folder}/warc").filter(F.col("record_type").isin("response", "revisit"))
    return back.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
