"""WARC records in ZIP packages: a writer, and a reader that never extracts.

A package is a ZIP file of stored members: ``archive/data.warc.gz`` with one gzip member per record, and
``indexes/index.cdxj`` with a line of JSON for each record.  The reader takes the end of the file, follows the end record
(and its ZIP64 form) to the central directory, finds where the stored members' bytes lie in the package, and reads records
by range from there.  It works on any URI that pyarrow's filesystems open.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm._files import filesystem, open_new
from keyloom.llm._shared import bounded, cut, fresh_path, quoted, tasks_of

WARC, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PACKAGE = 128 << 20  # bytes of records after which a writer starts another package
RANGE = 1 << 20  # bytes of neighbouring records that are read at once
PER_TASK = 64  # ranges that a task reads one after the other, where there are many
DATE = "2024-01-01T00:00:00Z"  # records are the same on every run


@dataclass
class Member:
    """A file in a ZIP package: where its bytes lie, how many they are, and how they are packed (0: stored)."""

    name: str
    method: int
    start: int
    size: int


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def urn(page_id: str | None) -> str:
    """A page's identifier; null has one that no text has."""
    return "<urn:no-page>" if page_id is None else f"<urn:page:{quote(page_id, safe='')}>"


def page_of(name: str | None) -> str | None:
    return unquote(name.removeprefix("<urn:page:").removesuffix(">")) if name and name.startswith("<urn:page:") else None


def record(page_id: str | None, url: str | None, payload: bytes, refers_to: str | None, revisit: bool) -> bytes:
    """One WARC record, as bytes.  A revisit has the response's HTTP headers, its payload's length among them, but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    uri = "".join(c if c.isprintable() and not c.isspace() else f"%{ord(c):02X}" for c in url or "")
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": urn(page_id),
        "WARC-Target-URI": uri,
        "WARC-Date": DATE,
        "WARC-Payload-Digest": f"sha1:{digest(payload)}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(block),
    }
    if revisit:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": urn(refers_to)}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers, by lower-cased name, and block of a WARC record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return fields, rest[: int(fields["content-length"])]


class _Package:
    """A package being written: records go to the stored WARC member as they come, the index follows at the end."""

    def __init__(self, folder: str):
        self.uri, self.out = open_new(folder, "pages.wacz")
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED)
        self.warc = self.zip.open(zipfile.ZipInfo(WARC, (2024, 1, 1, 0, 0, 0)), "w", force_zip64=True)
        self.at, self.lines = 0, []

    def add(self, page_id: str | None, url: str | None, raw: bytes) -> None:
        packed = gzip.compress(raw, 1, mtime=0)
        self.warc.write(packed)
        self.lines.append(json.dumps({"id": page_id, "url": url, "offset": self.at, "length": len(packed)}))
        self.at += len(packed)

    def close(self) -> str:
        self.warc.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX, (2024, 1, 1, 0, 0, 0)), "\n".join(self.lines))
        self.zip.close()
        self.out.close()
        return self.uri


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write a record per row to packages under ``folder``; returns (package), one row each.

    The payload is the html in UTF-8, nothing for null.  Of rows with equal payloads those with the largest key (by the
    order of its type) are responses and the others revisits that refer to it; null keys come last.  Only digests with more
    than one row are looked up, and each attempt of a task writes packages of its own, of which only those returned count.
    Keys may be of any type that reads back from its text.  Other columns are ignored.
    """
    body = F.coalesce(quoted(html), F.lit("")).cast("binary")
    rows = pages.select(quoted(key).alias("page_id"), quoted(url).cast("string").alias("url"), quoted(html).cast("string").alias("html"), F.sha1(body).alias("digest"))
    shared = rows.groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("refers_to")).where("n > 1").drop("n")
    marked = rows.join(bounded(cut(shared, "digests")), "digest", "left")
    revisit = F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    marked = marked.select(F.col("page_id").cast("string"), "url", "html", F.when(revisit, F.col("refers_to")).cast("string").alias("refers_to"), revisit.alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package, done = None, []
        for batch in batches:
            for k in range(batch.num_rows):
                page_id, link, text, refers_to, again = (batch.column(i)[k].as_py() for i in range(5))
                package = package or _Package(folder)
                package.add(page_id, link, record(page_id, link, (text or "").encode(), refers_to, again))
                if package.at >= PACKAGE:
                    done.append(package.close())
                    package = None
        if package:
            done.append(package.close())
        yield pa.RecordBatch.from_pydict({"package": pa.array(done, pa.string())})

    return cut(marked.mapInArrow(run, "package string"), "packages")


class Reader:
    """A ZIP package read by range."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        self.file = fs.open_input_file(path)
        self.size = self.file.size()

    def range(self, start: int, size: int) -> bytes:
        return self.file.read_at(size, start)

    def members(self) -> dict[str, Member]:
        """What the central directory lists, with ZIP64 sizes and offsets where the plain fields are full."""
        tail_at = max(0, self.size - 65_557)  # an end record and the longest comment
        tail = self.range(tail_at, self.size - tail_at)
        end = tail.rfind(b"PK\x05\x06")
        if end < 0:
            raise ValueError("no ZIP end record")
        count, size, at = struct.unpack_from("<10xHII", tail, end)
        if count == 0xFFFF or size == 0xFFFFFFFF or at == 0xFFFFFFFF:
            where = tail_at + end - 20
            mark, _, end64, _ = struct.unpack("<4sIQI", self.range(where, 20))
            if mark != b"PK\x06\x07":
                raise ValueError("no ZIP64 locator")
            mark, count, size, at = struct.unpack("<4s28xQQQ", self.range(end64, 56))
            if mark != b"PK\x06\x06":
                raise ValueError("no ZIP64 end record")
        listing, found, p = self.range(at, size), {}, 0
        for _ in range(count):
            mark, method, packed, plain, name_size, extra_size, note_size, local = struct.unpack_from("<4s6xH8xIIHHH8xI", listing, p)
            if mark != b"PK\x01\x02":
                raise ValueError("no ZIP directory entry")
            name = listing[p + 46 : p + 46 + name_size].decode()
            extra = listing[p + 46 + name_size : p + 46 + name_size + extra_size]
            p += 46 + name_size + extra_size + note_size
            wide = self._zip64(extra)
            for field in ("plain", "packed", "local"):  # the order in which the extra field has those that overflow
                value = {"plain": plain, "packed": packed, "local": local}[field]
                if value == 0xFFFFFFFF:
                    value = wide.pop(0)
                if field == "packed":
                    packed = value
                elif field == "local":
                    local = value
            mark, own_name, own_extra = struct.unpack("<4s22xHH", self.range(local, 30))
            if mark != b"PK\x03\x04":
                raise ValueError("no ZIP member header")
            found[name] = Member(name, method, local + 30 + own_name + own_extra, packed)
        return found

    @staticmethod
    def _zip64(extra: bytes) -> list[int]:
        p = 0
        while p + 4 <= len(extra):
            kind, size = struct.unpack_from("<HH", extra, p)
            if kind == 1:
                return list(struct.unpack_from(f"<{size // 8}Q", extra, p + 4))
            p += 4 + size
        return []

    def stored(self, name: str) -> Member:
        member = self.members()[name]
        if member.method:
            raise ValueError(f"{name} is compressed; ranges need stored members")
        return member


def locate(packages: DataFrame, size: int = RANGE) -> DataFrame:
    """(package, start, length): ranges of neighbouring records, from the packages' directories and indexes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                reader = Reader(uri)
                warc, index = reader.stored(WARC), reader.stored(INDEX)
                starts, lengths = [], []
                for line in io.BytesIO(reader.range(index.start, index.size)):
                    entry = json.loads(line)
                    if starts and lengths[-1] + entry["length"] <= size:
                        lengths[-1] += entry["length"]
                    else:
                        starts.append(warc.start + entry["offset"])
                        lengths.append(entry["length"])
                yield pa.RecordBatch.from_pydict({"package": [uri] * len(starts), "start": pa.array(starts, pa.int64()), "length": pa.array(lengths, pa.int64())})

    return packages.select("package").mapInArrow(run, "package string, start long, length long")


def read(ranges: DataFrame) -> DataFrame:
    """The records in ``ranges``: (page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload).

    A revisit's payload is null, its length and digest those of the full payload that it stands for; a response's are
    computed from what was read, and a digest that differs from the record's header is an error.
    """
    schema = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start, length in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                raw, rows = gzip.GzipFile(fileobj=io.BytesIO(Reader(uri).range(start, length))), []
                while line := raw.readline():
                    head = line
                    while (line := raw.readline()) != b"\r\n":
                        head += line
                    size = int(next(x for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
                    fields, block = parse_record(head + b"\r\n" + raw.read(size))
                    raw.read(4)
                    http, _, payload = block.partition(b"\r\n\r\n")
                    again = fields["warc-type"] == "revisit"
                    told = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
                    stated = fields["warc-payload-digest"].removeprefix("sha1:")
                    if not again and (len(payload) != told or digest(payload) != stated):
                        raise ValueError(f"record {fields['warc-record-id']} is damaged")
                    rows.append((page_of(fields["warc-record-id"]), fields["warc-target-uri"], told, stated, fields["warc-type"], page_of(fields.get("warc-refers-to")), None if again else payload))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return ranges.mapInArrow(run, schema)


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write ``pages`` to packages in the shared folder and read the records back from them: a row for every row, with page_id of the key's type.

    Repeated rows, null keys and empty pages come back as they are; an empty table gives an empty result.
    """
    packages = write(pages, fresh_path(pages.sparkSession, "archives"), key, url, html)
    ranges = cut(locate(packages), "ranges")
    back = read(ranges.repartition(tasks_of(ranges, PER_TASK), "package", "start"))
    kind = pages.select(quoted(key)).schema[0].dataType
    return back.withColumns({"page_id": F.col("page_id").cast(kind), "refers_to": F.col("refers_to").cast(kind)})
