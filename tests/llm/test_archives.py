"""Archives against plain reading and grouping."""

import gzip
import hashlib
from collections import Counter, defaultdict

import pytest

from ledgerloom.llm import archives

COLUMNS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
BIG = "<p>é WARC/1.0\r\n\r\nfiledesc:// 1 2 3\n" * 60


def brute(rows):
    by = defaultdict(list)
    for i, (page, _, html) in enumerate(rows):
        by[(html or "").encode()].append((page is not None, page or 0, i))
    out = []
    for payload, members in by.items():
        last = max(members)
        for m in members:
            again = len(payload) >= 1000 and m is not last
            out.append((m[1] if m[0] else None, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if again else "response", (last[1] if last[0] else None) if again else None))
    return Counter(out)


ROWS = [
    *((i, f"http://h/{i}", BIG) for i in range(40)),
    *((100 + i, f"http://h/{i}", f"page {i % 3}" * 200) for i in range(9)),
    *((200 + i, "http://small/", "x" * n) for i, n in enumerate((0, 1, 999, 999, 1000, 1000, 1001))),
    (300, None, None), (301, "", ""), (302, "http://h/a b\n\t\x00c", "\r\n\r\n"), (303, "unknown:", "WARC/1.0\r\nContent-Length: 5\r\n\r\nabc\r\n\r\n"),
    (9, "again", BIG), (9, "again", BIG), (-5, "minus", BIG), (None, "no id", BIG), (None, "no id", "few"), (10**18, "long", "y" * 2_000_000), (10**18 + 1, "long", "y" * 2_000_000),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, archive string, at long").repartition(5)


@pytest.mark.parametrize("size", [archives.ARCHIVE, 20_000, 1])
def test_round_trip(spark, size):
    got = archives.archive_pages(frame(spark, ROWS), size).collect()
    assert Counter(tuple(r[c] for c in COLUMNS) for r in got) == brute(ROWS)


def test_empty(spark):
    assert archives.archive_pages(frame(spark, [])).count() == 0


def test_files_are_what_others_write(spark, tmp_path):
    """A version 1 and a version 2 file by hand, one of two gzip members, with blanks in a URL, a record that is no HTTP and short dates."""
    v1 = b"filedesc://x.arc 1.2.3.4 19970101 text/plain 69\n1 0 Someone\nURL IP-address Archive-date Content-type Archive-length\n\n"
    v1 = v1.replace(b" 69\n", b" %d\n" % (len(v1) - v1.index(b"1 0 Some") - 1))
    answer = b"HTTP/1.0 200 OK\r\nServer: s\r\n\r\n" + b"p" * 1200
    v1 += b"http://a/b c 1.1.1.1 19970203040506 text/html %d\n" % len(answer) + answer + b"\n"
    plain = b"dns answer\nwith lines and bytes \xff\xfe\x00"
    v1 += b"dns:a 1.1.1.1 199702 text/dns %d\n" % len(plain) + plain + b"\n"
    block = b"2 0 Someone\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n"
    v2 = b"filedesc://y.arc 1.2.3.4 19980101000000 text/plain 200 - - 0 y.arc %d\n" % len(block) + block + b"\n"
    second = b"http://c/ 2.2.2.2 19990909090909 text/html 200 - - 77 y.arc %d\n" % len(answer) + answer + b"\n"
    folder = tmp_path / "arc"
    folder.mkdir()
    (folder / "x.arc").write_bytes(v1)
    (folder / "y.arc.gz").write_bytes(gzip.compress(v2) + gzip.compress(second))
    records = archives.read_arc(spark, f"file://{folder}").orderBy("archive", "at").collect()
    assert [(r.kind, r.url, r.fetched, r.mime, r.payload_bytes) for r in records] == [
        ("warcinfo", "filedesc://x.arc", "19970101", "text/plain", len(b"1 0 Someone\nURL IP-address Archive-date Content-type Archive-length\n")), ("response", "http://a/b c", "19970203040506", "text/html", 1200), ("resource", "dns:a", "199702", "text/dns", len(plain)),
        ("warcinfo", "filedesc://y.arc", "19980101000000", "text/plain", len(block)), ("response", "http://c/", "19990909090909", "text/html", 1200),
    ]
    assert bytes(records[2].payload) == plain and bytes(records[1].head).endswith(b"\r\n\r\n")
    archives.convert(spark, f"file://{folder}", f"file://{tmp_path}/warc")
    back = {r.target: r for r in archives.read_warc(spark, f"file://{tmp_path}/warc", payloads=True).filter("target is not null").collect()}
    assert back["http://a/b c"].record_type == "revisit" and back["http://a/b c"].refers_to_record == back["http://c/"].record_id
    assert back["http://c/"].record_type == "response" and bytes(back["http://c/"].payload) == b"p" * 1200 and back["http://c/"].date == "1999-09-09T09:09:09Z"
    assert back["dns:a"].record_type == "resource" and bytes(back["dns:a"].payload) == plain and back["dns:a"].date == "1997-02-01T00:00:00Z"
    assert back["http://a/b c"].payload_digest == back["http://c/"].payload_digest == hashlib.sha1(b"p" * 1200).hexdigest()


@pytest.mark.parametrize("data", [b"http://a 1 2 3 4\n", b"filedesc://x 1 2 t 3\n1 0\nhttp://a 1 2 t 99\nshort", b"filedesc://x 1 2 t 3\n1 0\nnot enough\n"])
def test_damaged_arc(data):
    with pytest.raises(ValueError):
        list(archives.arc_records(data))


@pytest.mark.parametrize("data", [b"HTTP/1.1 200\r\n\r\n", b"WARC/1.0\r\nWARC-Type: x\r\n\r\n", b"WARC/1.0\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n"])
def test_damaged_warc(data):
    with pytest.raises(ValueError):
        list(archives.warc_records(data))
