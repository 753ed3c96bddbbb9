"""Legacy archives: both versions of the format, damaged ones, and the way of pages through ARC and WARC against a plain version."""

import gzip
import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from hushframe.llm import archives, queries

HTTP = b"HTTP/1.0 200 OK\r\nContent-Type: text/plain\r\nX-Source-Key: 7\r\n\r\n"
_ABOUT = b"1 0 Someone\nURL IP-address Archive-date Content-type Archive-length\n"
V1 = b"filedesc://old.arc 0.0.0.0 19970101000000 text/plain %d\n%s\n" % (len(_ABOUT), _ABOUT)


def v1(url, date, block, kind=b"text/plain"):
    return b"\n" + b" ".join([url, b"192.0.2.1", date, kind, str(len(block)).encode()]) + b"\n" + block


def v2(url, date, block):
    return b"\n" + b" ".join([url, b"192.0.2.1", date, b"text/plain", b"404", b"-", b"-", b"0", b"new.arc", str(len(block)).encode()]) + b"\n" + block


def heads(content, name="x/file.arc"):
    return [(row, http, payload) for row, http, payload in archives.arc_heads(name, content)]


def test_version_one():
    payload = b"one\n\nhttp://no.record 192.0.2.1 19970102030405 text/plain 3\nabc"  # looks like a record, lies within one
    found = heads(V1 + v1(b"http://a.example/x y", b"19970102030405", HTTP + payload) + v1(b"http://b.example/", b"199701020304", b"plain", b"text/css"))
    assert [(r["name"], r["uri"], r["date"], r["version"]) for r, _, _ in found] == [("old.arc", "http://a.example/x y", "1997-01-02T03:04:05Z", 1), ("old.arc", "http://b.example/", "1997-01-02T03:04:00Z", 1)]
    assert found[0][2] == payload and found[0][0]["status"] == 200 and found[0][0]["key"] == "7"
    assert found[1][1] == b"" and found[1][2] == b"plain" and found[1][0]["content_type"] == "text/css"


def test_version_two_and_members():
    block = b"2 0 Someone\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n"
    first = b"filedesc://new.arc 0.0.0.0 20010101000000 text/plain 200 - - 0 new.arc " + str(len(block)).encode() + b"\n" + block
    plain = first + v2(b"http://a.example/", b"20010203040506", b"x" * 5000) + v2(b"http://c.example/", b"bad date", b"")
    members = b"".join(gzip.compress(part) for part in (plain[:300], plain[300:]))
    for content in (plain, members):
        found = [r for r, _, _ in heads(content)]
        assert [(r["version"], r["status"], r["date"], r["payload_bytes"]) for r in found] == [(2, 404, "2001-02-03T04:05:06Z", 5000), (2, 404, "2001-01-01T00:00:00Z", 0)]
    assert len({r["record_id"] for r in found}) == 2 and [r["record_id"] for r in found] == [r["record_id"] for r, _, _ in heads(plain)]


def test_damaged():
    content = V1 + b"\nhttp://a.example/ no length here\nrubbish\n" + v1(b"http://b.example/", b"19970102030405", b"body") + v1(b"http://c.example/", b"19970102030405", b"cut off")[:-3]
    assert [(r["uri"], r["truncated"], p) for r, _, p in heads(content)] == [("http://b.example/", False, b"body"), ("http://c.example/", True, b"cut ")]
    assert heads(b"") == [] and heads(V1) == []


def test_conversion_of_bytes_that_are_no_text(spark, tmp_path):
    odd = bytes(range(256)) * 8
    (tmp_path / "arc").mkdir()
    (tmp_path / "arc" / "old.arc.gz").write_bytes(gzip.compress(V1 + v1(b"http://a.example/", b"19970102030405", HTTP + odd) + v1(b"http://b.example/", b"19990102030405", HTTP + odd) + v1(b"dns:b.example", b"19990102030405", b"192.0.2.1", b"text/dns")))
    archives.arc_to_warc(spark, str(tmp_path / "arc"), str(tmp_path / "warc"))
    raw = b"".join(gzip.decompress(f.read_bytes()) for f in (tmp_path / "warc").glob("part*"))
    assert raw.count(b"WARC/1.1\r\n") == 4 and b"WARC-Refers-To-Date: 1999-01-02T03:04:05Z" in raw and odd in raw
    found = {r["uri"]: r for r in archives.read_warc(spark, str(tmp_path / "warc")).collect()}
    assert {u: r["type"] for u, r in found.items()} == {"http://a.example/": "revisit", "http://b.example/": "response", "dns:b.example": "resource"}
    assert bytes(found["http://b.example/"]["payload"]) == odd and found["http://b.example/"]["digest_ok"] and found["http://a.example/"]["digest_ok"] is None
    assert found["http://a.example/"]["refers_to"] == found["http://b.example/"]["record_id"] and found["http://a.example/"]["payload_digest"] == hashlib.sha1(odd).hexdigest()


def plain(rows):
    groups = defaultdict(list)
    for i, (page, html) in enumerate(rows):
        groups[html or ""].append((page is not None, page or 0, i, page))
    out = []
    for html, same in groups.items():
        body = html.encode()
        same.sort(key=lambda x: (x[0], x[1]))
        for at, (_, _, _, page) in enumerate(same):
            again = len(body) >= 1000 and at < len(same) - 1
            out.append((page, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", same[-1][3] if again else None))
    return out


ROWS = [(1, "a" * 999), (2, "a" * 999), (3, "b" * 1000), (9, "b" * 1000), (4, "b" * 1000), (5, None), (6, ""), (None, "b" * 1000), (None, "c" * 2000), (7, "é" * 500), (8, "é" * 500), (8, "é" * 500), (10, "x\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nyy" * 50), (11, "long " * 400_000), (12, "\x00\n\nfiledesc://x 0 0 0 3\n")]


@pytest.mark.parametrize("rows", [ROWS, [], [(i, "same page " * 200) for i in range(3000)]])
def test_pages_through_both_formats(spark, tmp_path, rows):
    pages = spark.createDataFrame([(p, None if (p or 0) % 4 == 1 else f"http://ü.example/a b\n{p}", h, "own") for p, h in rows], "page_id long, url string, html string, type string").repartition(3)
    pages.withColumns({c: F.lit("own") for c in ("payload", "ref", "key", "n")}).write.parquet(str(tmp_path / "pages.parquet"))
    got = queries.op11_archives(spark, str(tmp_path)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain(rows)))
