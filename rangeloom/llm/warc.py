"""WARC records in ZIP-packaged web archives: writer, and a reader that range-reads records without extraction.

An archive is a ZIP file whose members are stored, not compressed again: gzip-per-record
WARC members under archive/, CDXJ indexes under indexes/. The reader parses the end
record, the ZIP64 locator and record, and the central directory; it resolves each member's
data offset from its local header, turns index lines into byte ranges, and spreads the
ranges over tasks that read only these bytes.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, saved

# Signatures and fields of the ZIP format, and names of the WARC format.
END, END64, LOCATOR64, CENTRAL, LOCAL = 0x06054B50, 0x06064B50, 0x07064B50, 0x02014B50, 0x04034B50
STORED, ZIP64_EXTRA, MAX32, MAX16 = 0, 0x0001, 0xFFFFFFFF, 0xFFFF
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Compressed bytes of one WARC member; bytes of one range read; bytes of ranges per task.
MEMBER_BYTES, RANGE_BYTES, TASK_BYTES = 16 << 20, 2 << 20, 16 << 20
ID = "urn:page:"


class Member(NamedTuple):
    name: str
    method: int
    size: int
    header_at: int


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI; executors open it themselves."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


class ZipWriter:
    """Stored members written in one pass; ZIP64 fields where sizes or counts need them, or always."""

    def __init__(self, out, zip64: bool = False):
        self.out, self.zip64, self.at, self.members = out, zip64, 0, []

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, name: str, data: bytes) -> None:
        self.members.append((name.encode(), zlib.crc32(data), len(data), self.at))
        large = self.zip64 or len(data) >= MAX32
        extra = struct.pack("<HHQQ", ZIP64_EXTRA, 16, len(data), len(data)) if large else b""
        size = MAX32 if large else len(data)
        self._write(struct.pack("<IHHHHHIIIHH", LOCAL, 45, 0x800, STORED, 0, 33, zlib.crc32(data), size, size, len(name.encode()), len(extra)) + name.encode() + extra)
        self._write(data)

    def close(self) -> None:
        start = self.at
        for name, crc, size, at in self.members:
            values = [(size, size), (at,)]
            large = self.zip64 or size >= MAX32, self.zip64 or at >= MAX32
            body = b"".join(struct.pack(f"<{len(v)}Q", *v) for v, far in zip(values, large, strict=True) if far)
            extra = struct.pack("<HH", ZIP64_EXTRA, len(body)) + body if body else b""
            size32, at32 = MAX32 if large[0] else size, MAX32 if large[1] else at
            self._write(struct.pack("<IHHHHHHIIIHHHHHII", CENTRAL, 45, 45, 0x800, STORED, 0, 33, crc, size32, size32, len(name), len(extra), 0, 0, 0, 0, at32) + name + extra)
        length, n = self.at - start, len(self.members)
        far = self.zip64 or n >= MAX16 or start >= MAX32
        if far:
            at = self.at
            self._write(struct.pack("<IQHHIIQQQQ", END64, 44, 45, 45, 0, 0, n, n, length, start))
            self._write(struct.pack("<IIQI", LOCATOR64, 0, at, 1))
        n16, length32, start32 = (MAX16, MAX32, MAX32) if far else (n, length, start)
        self._write(struct.pack("<IHHHHIIH", END, 0, 0, n16, n16, length32, start32, 0))


def _at(file, start: int, length: int) -> bytes:
    file.seek(start)
    data = file.read(length)
    if len(data) != length:
        raise ValueError(f"archive ends early: {len(data)} of {length} bytes at {start}")
    return data


def directory(file) -> list[Member]:
    """The members of a ZIP file, from its central directory."""
    size = file.size()
    tail_at = max(0, size - MAX16 - 22)
    tail = _at(file, tail_at, size - tail_at)
    at = tail.rfind(struct.pack("<I", END))
    while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(struct.pack("<I", END), 0, at)
    if at < 0:
        raise ValueError("no end of central directory: not a ZIP file")
    n, length, start = struct.unpack_from("<HII", tail, at + 10)
    end_at = tail_at + at
    if end_at >= 20:
        mark, _, end64_at, _ = struct.unpack("<IIQI", _at(file, end_at - 20, 20))
        if mark == LOCATOR64:
            mark, *_, n, length, start = struct.unpack("<IQHHIIQQQQ", _at(file, end64_at, 56))
            if mark != END64:
                raise ValueError("the ZIP64 locator points to no ZIP64 record")
    found, raw, at = [], _at(file, start, length), 0
    for _ in range(n):
        mark, _, _, _, method, _, _, _, packed, full, n_name, n_extra, n_comment, _, _, _, header_at = struct.unpack_from("<IHHHHHHIIIHHHHHII", raw, at)
        if mark != CENTRAL:
            raise ValueError("damaged central directory")
        name = raw[at + 46 : at + 46 + n_name].decode()
        extra, here = raw[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while here + 4 <= len(extra):
            kind, n_field = struct.unpack_from("<HH", extra, here)
            if kind == ZIP64_EXTRA:
                field = here + 4
                for which in ("full", "packed", "header_at"):
                    if {"full": full, "packed": packed, "header_at": header_at}[which] == MAX32:
                        value = struct.unpack_from("<Q", extra, field)[0]
                        field += 8
                        full, packed, header_at = (value if which == "full" else full, value if which == "packed" else packed, value if which == "header_at" else header_at)
            here += 4 + n_field
        found.append(Member(name, method, packed, header_at))
        at += 46 + n_name + n_extra + n_comment
    return found


def data_offset(file, member: Member) -> int:
    """Where a stored member's bytes begin."""
    if member.method != STORED:
        raise ValueError(f"{member.name} is compressed again; only stored members can be range-read")
    head = _at(file, member.header_at, 30)
    if struct.unpack_from("<I", head)[0] != LOCAL:
        raise ValueError(f"{member.name}: no local header")
    n_name, n_extra = struct.unpack_from("<HH", head, 26)
    return member.header_at + 30 + n_name + n_extra


def ranges(file) -> Iterator[tuple[int, int]]:
    """Byte ranges of whole records: neighbours of the indexes joined up to RANGE_BYTES; members that no index names, whole."""
    members = {m.name: m for m in directory(file)}
    spans: dict[str, list[tuple[int, int]]] = {name: [] for name in members if name.startswith("archive/")}
    for name, member in members.items():
        if name.startswith("indexes/"):
            for line in _at(file, data_offset(file, member), member.size).splitlines():
                if line.strip() and not line.startswith(b"!"):
                    entry = json.loads(line[line.index(b"{") :])
                    spans["archive/" + entry["filename"]].append((int(entry["offset"]), int(entry["offset"]) + int(entry["length"])))
    for name, of in spans.items():
        base, joined = data_offset(file, members[name]), None
        for start, end in sorted(set(of)) or [(0, members[name].size)]:
            if joined and joined[1] == start and end - joined[0] <= RANGE_BYTES:
                joined = (joined[0], end)
            else:
                if joined:
                    yield base + joined[0], base + joined[1]
                joined = (start, end)
        if joined and joined[1] > joined[0]:
            yield base + joined[0], base + joined[1]


def _headers(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each WARC record; every record is a gzip member of its own."""
    while data:
        unzip = zlib.decompressobj(31)
        raw = unzip.decompress(data) + unzip.flush()
        if not unzip.eof:
            raise ValueError("a WARC record ends early")
        data = unzip.unused_data
        head, _, rest = raw.partition(b"\r\n\r\n")
        headers = _headers(head)
        yield headers, rest[: int(headers["content-length"])]


def base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def _record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{ID}{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {urllib.parse.quote(url, safe=''':/?#[]@!$&'()*+,;=%-._~''')}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{ID}{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    zipped = zlib.compressobj(3, zlib.DEFLATED, 31)
    return zipped.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + zipped.flush()


def _write_archives(folder: str, zip64: bool):
    def run(batches):
        fs, root = open_folder(folder)
        name = f"{uuid.uuid4().hex}.wacz"  # an attempt that is lost leaves a file that no manifest names
        out, n = None, 0
        member, index, size, no = [], [], 0, 0

        def flush() -> None:
            nonlocal member, size, no
            archive.add(f"archive/data-{no:05d}.warc.gz", b"".join(member))
            member, size, no = [], 0, no + 1

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{root}/{name}")
                    archive = ZipWriter(out, zip64)
                digest = base32(row["digest"])
                data = _record(row["page_id"], row["url"], row["payload"], digest, row["refers_to"])
                entry = {"url": row["url"], "digest": f"sha1:{digest}", "filename": f"data-{no:05d}.warc.gz", "offset": str(size), "length": str(len(data))}
                index.append(f"page:{row['page_id']} 19700101000000 {json.dumps(entry)}\n")
                member.append(data)
                size, n = size + len(data), n + 1
                if size >= MEMBER_BYTES:
                    flush()
        if out is not None:
            if member:
                flush()
            archive.add("indexes/index.cdxj", "".join(sorted(index)).encode())
            archive.add("datapackage.json", json.dumps({"profile": "data-package", "wacz_version": "1.1.1"}).encode())
            archive.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "n_bytes": [archive.at], "n_records": [n]})

    return run


def write_archives(pages: DataFrame, zip64: bool = False, at_least: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write one record per page into archives of the shared folder; the manifest (path, n_bytes, n_records) names the whole ones.

    Of pages with equal payloads of at least `at_least` bytes the one with the largest id
    is the response and the others revisit it; rows that repeat this id are responses
    too. A null html is an empty payload, a null url writes no target, a page without
    an id revisits another page or is a response without an id.
    """
    payload = F.coalesce(F.encode(F.col(html), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "n": F.octet_length("payload")})
    groups = rows.where(F.col("n") >= at_least).groupBy("digest").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("copies"))
    last = saved(groups.where((F.col("copies") > 1) & F.col("last").isNotNull()).select(F.col("digest").alias("of"), "last"), "groups")
    joined = rows.join(last, rows["digest"] == last["of"], "left")
    refers_to = F.when(~F.col("last").eqNullSafe(F.col("page_id")), F.col("last"))
    spark = pages.sparkSession
    written = joined.select("page_id", "url", "payload", "digest", refers_to.alias("refers_to"))
    return saved(written.mapInArrow(_write_archives(new_path(spark, "archives"), zip64), "path string, n_bytes long, n_records long"), "manifest")


def _list_ranges(batches):
    for batch in batches:
        for path in batch["path"].to_pylist():
            fs, at = open_folder(path)
            with fs.open_input_file(at) as file:
                found = list(ranges(file))
            yield pa.RecordBatch.from_pydict({"path": pa.array([path] * len(found), pa.string()), "start": pa.array([s for s, _ in found], pa.int64()), "end": pa.array([e for _, e in found], pa.int64())})


RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
RECORD_COLUMNS = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def _page(of: str | None) -> int | None:
    number = (of or "").removeprefix(f"<{ID}").removesuffix(">")
    return int(number) if number else None


def _read_ranges(payloads: bool):
    def parsed(headers: dict[str, str], block: bytes) -> tuple:
        http, _, payload = block.partition(b"\r\n\r\n")
        length, kind = int(_headers(http)["content-length"]), headers["warc-type"]
        digest = headers["warc-payload-digest"].removeprefix("sha1:")
        if kind == "response" and (len(payload) != length or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
            raise ValueError(f"{headers['warc-record-id']}: the payload doesn't match its digest")
        url = headers.get("warc-target-uri")
        return _page(headers["warc-record-id"]), None if url is None else urllib.parse.unquote(url), kind, _page(headers.get("warc-refers-to")), digest, length, payload if payloads and kind == "response" else None

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                fs, at = open_folder(row["path"])
                with fs.open_input_file(at) as file:
                    data = _at(file, row["start"], row["end"] - row["start"])
                found = [parsed(*r) for r in records(data)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), RECORD, strict=True)], schema=RECORD)

    return run


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the archives: page_id, url, record_type, refers_to, payload_digest, payload_bytes of the full payload, and the payload of responses (null without `payloads`)."""
    total = manifest.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    spark: SparkSession = manifest.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    found = manifest.select("path").repartition(tasks, "path").mapInArrow(_list_ranges, "path string, start long, end long")
    return found.repartition(tasks, "path", "start").mapInArrow(_read_ranges(payloads), RECORD_COLUMNS)


def page_records(pages: DataFrame) -> DataFrame:
    """Write the pages and read the archives back, without the payloads."""
    return read_archives(write_archives(pages), payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
