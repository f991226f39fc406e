"""ZIP-packaged WARC: round trips, directories with and without ZIP64, packages of other writers."""

import gzip
import io
import json
import struct
import zipfile
from collections import Counter

import pytest

from flowwarden.llm import warc
from tests.llm import brute

SCHEMA = "page_id long, url string, html string"
BIG = "<p>" + "much the same " * 20
PAGES = [(5, "http://a/5", BIG), (3, "http://a/3 x\r\ny", BIG), (9, None, BIG), (3, "http://a/3", BIG), (None, "u", BIG), (1, "é", "short"),
         (2, "", "short"), (4, "z", None), (None, "n", None), (6, "w", ""), (7, "q", "x" * 99), (8, "q", "x" * 99), (10, "r", "x" * 100), (11, "s", "x" * 100),
         (12, "t", "é" * 50), (13, "t", "é" * 50), (14, "b", "\r\n\r\nWARC/1.1 \x00﻿" * 9), (None, "o", "only without ids " * 9), (None, "o", "only without ids " * 9)]


def rows_of(frame):
    return Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in frame.collect())


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, 1) for p in PAGES], SCHEMA + ", first int").repartition(3)


def test_round_trip(spark, pages, tmp_path):
    manifest = warc.write_packages(pages, f"file://{tmp_path}/packages")
    found = warc.read_packages(manifest, 3, with_payload=True)
    assert rows_of(found) == Counter(brute.archived([(p[0], p[2]) for p in PAGES]))
    texts = {r.page_id: r.payload.decode() for r in found.filter("record_type = 'response' AND page_id IS NOT NULL").collect()}
    assert all(texts[i] == (h or "") for i, _, h in PAGES if i in texts)
    urls = Counter(r.url for r in found.collect())
    assert urls["http://a/3%20x%0D%0Ay"] == 1 and urls[None] == 1 and urls["é"] == 1
    for row in manifest.collect():
        with zipfile.ZipFile(row.package.removeprefix("file://")) as z:
            assert z.testzip() is None and all(i.compress_type == zipfile.ZIP_STORED for i in z.infolist())
            assert json.loads(z.read(warc.ABOUT))["resources"][0]["bytes"] == row.bytes


def test_many_packages_and_slabs(spark, pages, tmp_path, monkeypatch):
    assert warc.tasks_for(spark, spark.createDataFrame([("p", 1, 100 * warc.SLAB_BYTES)], warc.MANIFEST)) == 50
    many = spark.createDataFrame([(i, f"http://h/{i}", f"page {i % 40} " * 30) for i in range(400)], SCHEMA).repartition(2)
    manifest = warc.write_packages(many, str(tmp_path / "many"))
    assert rows_of(warc.read_packages(manifest, 5)) == Counter(brute.archived([(i, f"page {i % 40} " * 30) for i in range(400)]))


def test_empty_table(spark, tmp_path):
    manifest = warc.write_packages(spark.createDataFrame([], SCHEMA), str(tmp_path / "none"))
    assert manifest.count() == 0 and warc.read_packages(manifest, 2).count() == 0


def packed(members, comment=b"", before=b"", stored=True):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, data in members:
            z.writestr(name, data, zipfile.ZIP_STORED if stored or "index" not in name else zipfile.ZIP_DEFLATED)
        z.comment = comment
    return before + out.getvalue()


def records(n):
    return [gzip.compress(warc.record("response", f"{i}", i, f"u{i}", 6 + len(str(i)), "", b"hello " + str(i).encode())) for i in range(n)]


def index_of(own, name):
    at, lines = 0, ["!meta"]
    for r in own:
        lines.append("u 0 " + json.dumps({"offset": at, "length": str(len(r)), "filename": name}))
        at += len(r)
    return "\n".join(lines).encode()


def read_all(raw):
    package = warc.Package(io.BytesIO(raw), len(raw))
    return [warc.parse(package.read(at, n))[2] for at, n in package.places()]


@pytest.mark.parametrize("kind", ["plain", "deflated index", "gzip index", "no index", "comment", "prefix"])
def test_packages_of_other_writers(kind):
    own = records(300)
    index = index_of(own, "d.warc.gz")
    members = [("readme", b"x" * 10), ("archive/d.warc.gz", b"".join(own))]
    if kind == "gzip index":
        members.append(("indexes/index.cdx.gz", gzip.compress(index[:500]) + gzip.compress(index[500:])))
    elif kind != "no index":
        members.append(("indexes/index.cdxj", index))
    raw = packed(members, b"PK\x05\x06 looks like an end" if kind == "comment" else b"", b"#!/bin/sh\n" if kind == "prefix" else b"", kind != "deflated index")
    assert read_all(raw) == [f"hello {i}".encode() for i in range(300)]


@pytest.mark.parametrize("before", [b"", b"prefix"])
def test_zip64_directories(before):
    """Every short field is full, so the locator, the ZIP64 end record and the extra fields have the values."""
    own = records(5)
    data, name = b"".join(own), b"archive/d.warc.gz"
    local = struct.pack("<4s5H3I2H", b"PK\x03\x04", 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), 20) + name + struct.pack("<2H2Q", 1, 16, len(data), len(data))
    extra = struct.pack("<2H3s", 9, 3, b"abc") + struct.pack("<2H3Q", 1, 24, len(data), len(data), 0)
    central = struct.pack("<4s6H3I5H2I", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra
    begin = len(local) + len(data)
    end64 = struct.pack("<4sQ2H2I4Q", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, len(central), begin)
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, begin + len(central), 1)
    end = struct.pack("<4s4H2IH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    assert read_all(before + local + data + central + end64 + locator + end) == [f"hello {i}".encode() for i in range(5)]


def test_many_entries_need_zip64():
    raw = packed([(f"m/{i}", b"") for i in range(66_000)] + [("archive/d.warc.gz", records(1)[0])])
    assert read_all(raw) == [b"hello 0"]


@pytest.mark.parametrize("raw", [b"", b"PK", b"x" * 100])
def test_no_package(raw):
    with pytest.raises(ValueError):
        warc.Package(io.BytesIO(raw), len(raw))


def test_plain_records_and_damage():
    fields, http, payload = warc.parse(warc.record("response", "n", 7, "u", 3, "d", b"abc"))
    assert (fields["x-page-id"], http["content-length"], payload) == ("7", "3", b"abc")
    with pytest.raises(ValueError):
        warc.parse(b"HTTP/1.1 200")
    cut = records(2)
    raw = packed([("archive/d.warc.gz", (cut[0] + cut[1])[:-9])])
    with pytest.raises(ValueError):
        read_all(raw)
