"""WARC records in ZIP packages: writing, and reading by byte ranges without extraction.

A package is a ZIP file with one stored member of gzipped WARC records, one stored index with the offset and length of every record,
and a small description. Its reader parses the end record, the ZIP64 locator and end record, and the central directory, finds
stored members by their local headers, and reads records by ranges; nothing is extracted. Without an index
the archive member is walked record by record in bounded pieces.

Tasks write and read packages through Arrow's file systems, at a URI that all executors reach. A task names its packages
anew in each attempt, and only those named in the stored manifest count, so retries and lost executors leave no doubt.

Of equal payloads of at least `MIN_REVISIT` bytes the one of the smallest page id is a response and the others revisit it: a
revisit has the headers only, with the digest and length of the payload.

Defined results: a null payload is empty; every row is a record, so rows that repeat the smallest id of their payload are all
responses; a row without id is a revisit only if its payload has a row with an id; null URLs stay null; an empty table gives no
records; other columns are ignored; payloads are handled whole, one at a time.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowwarden.llm.common import python_tasks, release, stored

MIN_REVISIT = 100
#: Bytes after which a package ends, bytes of records that a reading task takes at a time, bytes of a range read of directories.
PACKAGE_BYTES, SLAB_BYTES, RANGE = 256 << 20, 8 << 20, 1 << 16
DATE = "1970-01-01T00:00:00Z"
MANIFEST = "package string, records bigint, bytes bigint"
SLABS = "package string, places array<struct<at: bigint, length: bigint>>"
RECORDS = "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint"

# Signatures and sizes of ZIP structures, and names of the packaged members.
_LOCAL, _CENTRAL, _END, _LOCATOR64, _END64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x07", b"PK\x06\x06"
_END_SIZE, _LOCATOR_SIZE, _END64_SIZE, _CENTRAL_SIZE, _LOCAL_SIZE = 22, 20, 56, 46, 30
_FULL16, _FULL32, _MOST_COMMENT = 0xFFFF, 0xFFFFFFFF, 0xFFFF
ARCHIVE, INDEX, ABOUT = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# Records

def record(kind: str, name: str, page_id: int | None, url: str | None, size: int, digest: str, payload: bytes = b"",
           refers_to: int | None = None, refers_url: str | None = None) -> bytes:
    """One WARC record, not compressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Date", DATE), ("WARC-Target-URI", _line(url)),
              ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Page-Id", page_id), ("Content-Type", "application/http;msgtype=response")]
    if kind == "revisit":
        fields += [("WARC-Profile", IDENTICAL), ("X-Refers-To-Page-Id", refers_to), ("WARC-Refers-To-Target-URI", _line(refers_url))]
    fields.append(("Content-Length", len(http) + len(payload)))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return head.encode() + b"\r\n" + http + payload + b"\r\n\r\n"


def _line(url: str | None) -> str | None:
    """A URL without line breaks and outer blanks, which would end or blur a header; others stay."""
    return None if url is None else "".join(f"%{ord(c):02X}" if c < "!" or c == "\x7f" else c for c in url)


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields and payload of one record, gzipped or not."""
    if raw[:2] == b"\x1f\x8b":
        raw = zlib.decompress(raw, 31)
    if raw[:5] != b"WARC/":
        raise ValueError("no WARC record at this place")
    split = raw.index(b"\r\n\r\n")
    fields = _fields(raw[:split])
    block = raw[split + 4:split + 4 + int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, _fields(http), payload


# Packages

def _open(uri: str):
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    flags: int
    packed: int
    size: int
    header: int


class Package:
    """Members of a ZIP file by range reads: `file` is anything with seek, read and a known size."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size
        self.shift, self.begin, self.length, self.entries = self._directory()

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        out = self.file.read(n)
        if len(out) < n:
            raise ValueError("the package ends before its data")
        return out

    def _directory(self) -> tuple[int, int, int, int]:
        """Bytes before the package itself; begin, length and entries of the central directory."""
        n = min(self.size, _END_SIZE + _MOST_COMMENT)
        tail = self.read(self.size - n, n)
        at = tail.rfind(_END)
        while at >= 0 and (at + _END_SIZE > n or at + _END_SIZE + struct.unpack_from("<H", tail, at + 20)[0] != n):
            at = tail.rfind(_END, 0, at)  # a comment may hold the signature
        if at < 0:
            raise ValueError("no end of a ZIP directory")
        entries, length, begin = struct.unpack_from("<HII", tail, at + 10)
        end = self.size - n + at
        place = end - _LOCATOR_SIZE
        if place >= 0 and (locator := self.read(place, _LOCATOR_SIZE))[:4] == _LOCATOR64:
            told = struct.unpack_from("<Q", locator, 8)[0]
            for where in (told, place - _END64_SIZE):  # the second if bytes stand before the package
                if 0 <= where <= place - _END64_SIZE and (found := self.read(where, _END64_SIZE))[:4] == _END64:
                    entries, length, begin = struct.unpack_from("<QQQ", found, 32)
                    end = where
                    break
            else:
                raise ValueError("no ZIP64 end record where its locator points")
        return end - length - begin, begin, length, entries

    def members(self) -> Iterator[Member]:
        """Entries of the central directory, read in ranges."""
        at, past, left = self.shift + self.begin, self.shift + self.begin + self.length, b""
        for _ in range(self.entries):
            while len(left) < _CENTRAL_SIZE or len(left) < _CENTRAL_SIZE + sum(struct.unpack_from("<HHH", left, 28)):
                if at >= past:
                    raise ValueError("the central directory ends early")
                more = self.read(at, min(RANGE, past - at))
                left, at = left + more, at + len(more)
            if left[:4] != _CENTRAL:
                raise ValueError("no entry of a central directory")
            flags, method = struct.unpack_from("<HH", left, 8)
            packed, size = struct.unpack_from("<II", left, 20)
            n_name, n_extra, n_comment = struct.unpack_from("<HHH", left, 28)
            header = struct.unpack_from("<I", left, 42)[0]
            name = left[_CENTRAL_SIZE:_CENTRAL_SIZE + n_name].decode("utf-8" if flags & 0x800 else "cp437")
            extra = left[_CENTRAL_SIZE + n_name:_CENTRAL_SIZE + n_name + n_extra]
            size, packed, header = _wide(extra, size, packed, header)
            left = left[_CENTRAL_SIZE + n_name + n_extra + n_comment:]
            yield Member(name, method, flags, packed, size, header)

    def begin_of(self, member: Member) -> int:
        """Place of a member's first byte: behind its local header, whose extra field may differ from the directory's."""
        head = self.read(self.shift + member.header, _LOCAL_SIZE)
        if head[:4] != _LOCAL:
            raise ValueError(f"no local header of {member.name}")
        if member.flags & 1:
            raise ValueError(f"{member.name} is encrypted")
        return self.shift + member.header + _LOCAL_SIZE + sum(struct.unpack_from("<HH", head, 26))

    def lines(self, member: Member) -> Iterator[str]:
        """Lines of an index member, stored or deflated, plain or gzipped, read in ranges."""
        at = self.begin_of(member)
        past, steps, left = at + member.packed, [zlib.decompressobj(-15)] if member.method == 8 else [], b""
        if member.name.endswith(".gz"):
            steps.append(zlib.decompressobj(31))
        while at < past:
            piece = self.read(at, min(RANGE, past - at))
            at += len(piece)
            for k, step in enumerate(steps):
                out = step.decompress(piece)
                while step.eof and (rest := step.unused_data):  # gzip files may follow each other
                    step = steps[k] = zlib.decompressobj(31)
                    out += step.decompress(rest)
                piece = out
            *whole, left = (left + piece).split(b"\n")
            yield from (line.decode() for line in whole)
        if left:
            yield left.decode()

    def records(self, archive: Member) -> Iterator[tuple[int, int]]:
        """(place, length) of each record of a stored archive member without an index: its gzip members one after the other."""
        at = self.begin_of(archive)
        past = at + archive.packed
        while at < past:
            step, n = zlib.decompressobj(31), 0
            while not step.eof:
                piece = self.read(at + n, min(RANGE, past - at - n)) if at + n < past else b""
                if not piece:
                    raise ValueError("an archive ends inside a record")
                n += len(piece)
                while not step.eof and piece:
                    step.decompress(piece, RANGE)
                    piece = step.unconsumed_tail
            n -= len(step.unused_data)
            yield at, n
            at += n

    def places(self) -> Iterator[tuple[int, int]]:
        """(place, length) of every record of the package, by its indexes, else by walking archives that no index names."""
        members = list(self.members())
        archives = {m.name.rpartition("/")[2]: m for m in members if m.name.endswith((".warc.gz", ".warc"))}
        begins: dict[str, int] = {}
        for index in members:
            if index.name.endswith((".cdxj", ".cdx", ".cdxj.gz", ".cdx.gz")):
                for line in self.lines(index):
                    if "{" not in line:
                        continue
                    told = json.loads(line[line.index("{"):])
                    name = told["filename"].rpartition("/")[2]
                    if name not in begins:
                        if archives[name].method:
                            raise ValueError(f"{name} is not stored")
                        begins[name] = self.begin_of(archives[name])
                    yield begins[name] + int(told["offset"]), int(told["length"])
        for name, archive in archives.items():
            if name not in begins and archive.packed:
                if archive.method:
                    raise ValueError(f"{name} is not stored")
                yield from self.records(archive)


def _wide(extra: bytes, size: int, packed: int, header: int) -> tuple[int, int, int]:
    """Sizes and place of an entry, from the ZIP64 extra field where the short ones are full."""
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            values = iter(struct.unpack_from(f"<{n // 8}Q", extra, at + 4))
            size = next(values) if size == _FULL32 else size
            packed = next(values) if packed == _FULL32 else packed
            header = next(values) if header == _FULL32 else header
        at += 4 + n
    return size, packed, header


class Writer:
    """One package under way; the archive member is open until `close`."""

    def __init__(self, uri: str):
        self.uri, self.count, self.offset, self.index = uri, 0, 0, io.BytesIO()
        system, path = fs.FileSystem.from_uri(uri)
        self.stream = system.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.archive, self.digest = self.zip.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True), hashlib.sha256()

    def add(self, raw: bytes, url: str | None, digest: str, kind: str) -> None:
        packed = gzip.compress(raw, 6, mtime=0)
        self.archive.write(packed)
        self.digest.update(packed)
        told = {"url": url, "digest": f"sha256:{digest}", "type": kind, "offset": str(self.offset), "length": str(len(packed)),
                "filename": ARCHIVE.rpartition("/")[2]}
        self.index.write(f"{_line(url) or '-'} {DATE} {json.dumps(told)}\n".encode())
        self.offset, self.count = self.offset + len(packed), self.count + 1

    def close(self) -> tuple[str, int, int]:
        self.archive.close()
        index = self.index.getvalue()
        self.zip.writestr(zipfile.ZipInfo(INDEX), index)
        about = [{"path": ARCHIVE, "bytes": self.offset, "hash": f"sha256:{self.digest.hexdigest()}"},
                 {"path": INDEX, "bytes": len(index), "hash": f"sha256:{hashlib.sha256(index).hexdigest()}"}]
        self.zip.writestr(zipfile.ZipInfo(ABOUT), json.dumps({"profile": "data-package", "resources": about}))
        self.zip.close()
        self.stream.close()
        return self.uri, self.count, self.offset


# Spark jobs

def marked(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, payload, size, digest, and first: the id and URL that an equal payload's record has, null for responses.

    The first of each payload comes from a pre-aggregated table; it meets the rows in a join that is unique on its side, so
    a payload of very many rows can be split. Payloads too small to be revisited are dealt by row instead.
    """
    payload = F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"size": F.octet_length("payload").cast("long"), "digest": F.sha2("payload", 256)})
    large = F.col("size") >= MIN_REVISIT
    rows = rows.withColumn("_key", F.when(large, F.col("digest")).otherwise(F.hex(F.xxhash64("page_id", "url"))))
    firsts = rows.filter(large).groupBy(F.col("digest").alias("_key")).agg(
        F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"), F.count(F.lit(1)).alias("_n"))
    known = rows.join(firsts.filter("_n > 1").drop("_n"), "_key", "left").drop("_key")
    revisits = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    return known.withColumn("first", F.when(revisits, F.col("first")))


def _written(path: str):
    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        system, place = fs.FileSystem.from_uri(path)
        system.create_dir(place, recursive=True)
        part, attempt, k, own = TaskContext.get().partitionId(), uuid.uuid4().hex, 0, None

        def told(writer: Writer) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(("package", "records", "bytes"), writer.close(), strict=True))])

        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(c)[i].as_py() for c, n in enumerate(batch.schema.names)}
                own = own or Writer(f"{path}/{part:06d}-{k:04d}-{attempt}.wacz")
                first, name = row["first"], str(uuid.uuid5(uuid.NAMESPACE_URL, f"{part} {k} {own.count} {row['digest']}"))
                kind = "revisit" if first else "response"
                raw = record(kind, name, row["page_id"], row["url"], row["size"], row["digest"], b"" if first else row["payload"],
                             first and first["page_id"], first and first["url"])
                own.add(raw, row["url"], row["digest"], kind)
                if own.offset >= PACKAGE_BYTES:
                    yield told(own)
                    own, k = None, k + 1
        if own:
            yield told(own)

    return written


def write_packages(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write a record for every page into packages below `path`; returns the stored manifest (package, records, bytes)."""
    python_tasks(pages.sparkSession)
    rows = marked(pages, page_id, url, html).select("page_id", "url", "payload", "size", "digest", "first")
    return stored(rows.mapInArrow(_written(path), MANIFEST), "warc-manifest")


def _slabs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri in batch.column(0).to_pylist():
            with _open(uri) as file:
                some, size = [], 0
                for at, length in Package(file, file.size()).places():
                    some.append({"at": at, "length": length})
                    size += length
                    if size >= SLAB_BYTES:
                        yield pa.RecordBatch.from_pylist([{"package": uri, "places": some}])
                        some, size = [], 0
                if some:
                    yield pa.RecordBatch.from_pylist([{"package": uri, "places": some}])


def _read(with_payload: bool):
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()] + [pa.binary()] * with_payload
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to"] + ["payload"] * with_payload

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for uri, places in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                with _open(uri) as file:
                    rows = []
                    for place in places.as_py():
                        fields, http, payload = parse(file.read_at(place["length"], place["at"]))
                        kind, digest = fields["warc-type"], fields.get("warc-payload-digest", "").removeprefix("sha256:")
                        size = int(http.get("content-length", len(payload)))
                        if kind == "response" and (len(payload) != size or digest != hashlib.sha256(payload).hexdigest()):
                            raise ValueError(f"record at {place['at']} of {uri} does not have the payload it names")
                        whole = {"page_id": fields.get("x-page-id"), "refers_to": fields.get("x-refers-to-page-id")}
                        page, first = (None if v is None else int(v) for v in (whole["page_id"], whole["refers_to"]))
                        rows.append((page, fields.get("warc-target-uri"), kind, size, digest, first, *[payload] * with_payload))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return read


def read_packages(packages: DataFrame, tasks: int, with_payload: bool = False) -> DataFrame:
    """Records of the packages named in column `package` (URIs), read by ranges in `tasks` tasks.

    Indexes are read first, one package at a time; then slabs of neighbouring records are dealt out evenly, so a large
    package is read by many tasks. Payloads of responses are checked against their digests.
    """
    spark = packages.sparkSession
    python_tasks(spark)
    slabs = packages.select("package").repartition(tasks).mapInArrow(_slabs, SLABS).repartition(tasks)
    return slabs.mapInArrow(_read(with_payload), RECORDS + ", payload binary" * with_payload)


def tasks_for(spark: SparkSession, manifest: DataFrame) -> int:
    """Two slabs a task, one task a core at least."""
    total = manifest.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    return max(spark.sparkContext.defaultParallelism, -(-total // (2 * SLAB_BYTES)))
