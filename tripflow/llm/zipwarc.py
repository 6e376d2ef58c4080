"""WARC records in ZIP packages: written by tasks, read back by byte range without extraction.

A package is a ZIP file with stored (uncompressed) members: ``archive/data.warc.gz``, one gzip
member per WARC record, and ``indexes/index.cdxj``, a line per record with its offset and length in
the archive. The reader parses the end record, the ZIP64 end record if there is one, and the
central directory, finds where the two members' bytes begin, and reads single records by range.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripflow.llm.files import store, write_file
from tripflow.sources.staging import new_path, settle

#: Bytes of records after which a task begins the next package.
PACKAGE_BYTES = 64 << 20
#: Payloads of fewer bytes are stored again each time.
MIN_REVISIT_BYTES = 0
DATE = "2000-01-01T00:00:00Z"
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _safe(url: str) -> str:
    """A URL for a header line: control characters and spaces as percent codes."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 33 or ord(c) == 127 else c for c in url)


def warc_record(
    payload: bytes, url: str | None, kind: str, names: dict[str, object], date: str = DATE
) -> bytes:
    """A response or revisit record; ``names`` are further header fields, nulls left out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    fields = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>",
        "WARC-Date": date,
        "WARC-Target-URI": None if url is None else _safe(url),
        "WARC-Payload-Digest": f"sha1:{payload_digest(payload)}",
        "WARC-Profile": _REVISIT if kind == "revisit" else None,
        "Content-Type": "application/http; msgtype=response",
        **names,
        "Content-Length": len(block),
    }
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def read_record(record: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Header fields, HTTP header fields and body of a WARC record."""

    def fields(head: bytes) -> dict[str, str]:
        lines = head.decode().split("\r\n")[1:]
        return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines if line)}

    head, _, rest = record.partition(b"\r\n\r\n")
    warc = fields(head)
    http, _, body = rest[: int(warc["content-length"])].partition(b"\r\n\r\n")
    return warc, fields(http), body


def package(records: list[tuple[dict, bytes]], zip64: bool = False) -> bytes:
    """A ZIP package of (index entry, WARC record); ``zip64`` writes the large form in any case."""
    lines, archive, at = [], io.BytesIO(), 0
    for entry, record in records:
        at += archive.write(packed := gzip.compress(record, 6, mtime=0))
        where = {"offset": at - len(packed), "length": len(packed)}
        lines.append(json.dumps(entry | where, sort_keys=True))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        for name, data in ((ARCHIVE, archive.getbuffer()), (INDEX, "".join(f"{x}\n" for x in lines).encode())):
            with z.open(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), "w", force_zip64=zip64) as member:
                member.write(data)
    return out.getvalue()


class ZipDirectory:
    """Members of a ZIP file as (offset of the header, size, method), read from its directory."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        tail_at = max(0, size - 65_557)
        tail = source.read_at(size - tail_at, tail_at)
        end = tail.rfind(b"PK\x05\x06")
        while end >= 0 and end + 22 + int.from_bytes(tail[end + 20 : end + 22], "little") != len(tail):
            end = tail.rfind(b"PK\x05\x06", 0, end)
        if end < 0:
            raise ValueError("not a ZIP file: no end record")
        count, length, start = struct.unpack("<HII", tail[end + 10 : end + 20])
        locator = tail_at + end - 20
        if locator >= 0 and (found := source.read_at(20, locator))[:4] == b"PK\x06\x07":
            record = source.read_at(56, struct.unpack("<Q", found[8:16])[0])
            if record[:4] != b"PK\x06\x06":
                raise ValueError("ZIP64 end record is not where its locator says")
            count, length, start = struct.unpack("<QQQ", record[32:56])
        self.members = self._read(source.read_at(length, start), count)

    @staticmethod
    def _read(directory: bytes, count: int) -> dict[str, tuple[int, int, int]]:
        members, at = {}, 0
        for _ in range(count):
            if directory[at : at + 4] != b"PK\x01\x02":
                raise ValueError("central directory is damaged")
            flags, method = struct.unpack("<HH", directory[at + 8 : at + 12])
            packed, size, n, m, k = struct.unpack("<IIHHH", directory[at + 20 : at + 34])
            offset = struct.unpack("<I", directory[at + 42 : at + 46])[0]
            name = directory[at + 46 : at + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
            extra, e = directory[at + 46 + n : at + 46 + n + m], 0
            while e + 4 <= len(extra):
                kind, length = struct.unpack("<HH", extra[e : e + 4])
                if kind == 1:
                    # 64-bit values stand only for the fields that say 0xFFFFFFFF, in this order.
                    wide = iter(struct.unpack(f"<{length // 8}Q", extra[e + 4 : e + 4 + length // 8 * 8]))
                    size = next(wide) if size == 0xFFFFFFFF else size
                    packed = next(wide) if packed == 0xFFFFFFFF else packed
                    offset = next(wide) if offset == 0xFFFFFFFF else offset
                e += 4 + length
            members[name] = (offset, packed, method)
            at += 46 + n + m + k
        return members

    def stored(self, name: str) -> tuple[int, int]:
        """Where a stored member's bytes begin, and how many there are."""
        offset, size, method = self.members[name]
        if method != 0:
            raise ValueError(f"{name} is compressed and can't be read by range")
        header = self.source.read_at(30, offset)
        if header[:4] != b"PK\x03\x04":
            raise ValueError(f"{name} has no local header where the directory says")
        n, m = struct.unpack("<HH", header[26:30])
        return offset + 30 + n + m, size


class _Source:
    """Positioned reads over an open pyarrow file."""

    def __init__(self, file):
        self.file = file

    def size(self) -> int:
        return self.file.size()

    def read_at(self, n: int, at: int) -> bytes:
        return self.file.read_at(n, at)


def read_package(source) -> Iterator[tuple[dict, dict[str, str], dict[str, str], bytes]]:
    """(index entry, WARC fields, HTTP fields, body) of every record, each read by its range."""
    directory = ZipDirectory(source)
    first, size = directory.stored(INDEX)
    base, _ = directory.stored(ARCHIVE)
    for line in source.read_at(size, first).splitlines():
        entry = json.loads(line)
        packed = source.read_at(entry["length"], base + entry["offset"])
        yield entry, *read_record(gzip.decompress(packed))


def with_revisits(pages: DataFrame, least: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(page_id, url, html, first): ``first`` is the page whose response holds the same payload.

    Null where the payload occurs once or has fewer than ``least`` bytes. Only digests are grouped;
    pages are joined with the digests that occur more than once.
    """
    digest = F.unhex(F.sha1(F.coalesce("html", F.lit(""))))
    bytes_ = F.coalesce(F.octet_length("html"), F.lit(0))
    rows = pages.select("page_id", "url", "html", F.when(bytes_ >= least, digest).alias("digest"))
    repeated = rows.where("digest is not null").groupBy("digest").agg(
        F.min("page_id").alias("first"), F.count("*").alias("n")
    )
    repeated = settle(repeated.where("n > 1").select("digest", "first"), "repeated")
    return rows.join(repeated, "digest", "left").select("page_id", "url", "html", "first")


def _entry(page: int | None, url: str | None, kind: str) -> dict:
    return {"page": page, "url": url, "type": kind}


def write_packages(pages: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write (page_id, url, html, first) as packages under ``folder``; returns their (path, records).

    Each task writes packages of its own under fresh names. A task that is run again writes new
    ones, and only the names that the finished tasks return are ever read.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def flush() -> pd.DataFrame:
            path = f"{folder}/{uuid.uuid4().hex}.wacz"
            write_file(path, [package(held)])
            return pd.DataFrame({"path": [path], "records": [len(held)]})

        for batch in batches:
            ids = batch["page_id"].astype("object").where(batch["page_id"].notna(), None)
            firsts = batch["first"].astype("object").where(batch["first"].notna(), None)
            for page, url, text, first in zip(ids, batch["url"], batch["html"], firsts, strict=True):
                page = None if page is None else int(page)
                first = None if first is None else int(first)
                kind = "response" if first is None or first == page else "revisit"
                names = {"X-Page-ID": page, "X-Refers-To-Page-ID": first if kind == "revisit" else None}
                record = warc_record((text or "").encode(), url, kind, names)
                held.append((_entry(page, url, kind), record))
                size += len(record)
                if size >= package_bytes:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return pages.mapInPandas(write, "path string, records long")


READ_SCHEMA = (
    "page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
    "refers_to long, payload string"
)


def read_packages(paths: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the packages named in ``paths.path``, as ``READ_SCHEMA``.

    A response's payload is checked against its digest. A revisit has no payload of its own: its
    size and digest are those its headers give for the payload it refers to.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                system, name = store(path)
                rows, size = [], 0
                with system.open_input_file(name) as file:
                    for entry, warc, http, body in read_package(_Source(file)):
                        digest = warc["warc-payload-digest"].removeprefix("sha1:")
                        if warc["warc-type"] == "response" and payload_digest(body) != digest:
                            raise ValueError(f"{path}: payload of page {entry['page']} is damaged")
                        page, refers = warc.get("x-page-id"), warc.get("x-refers-to-page-id")
                        rows.append((
                            page and int(page), entry["url"], int(http["content-length"]), digest,
                            warc["warc-type"], refers and int(refers),
                            body.decode() if payloads and warc["warc-type"] == "response" else None,
                        ))
                        size += len(body) if payloads else 64
                        if size > 8 << 20:
                            yield _frame(rows)
                            rows, size = [], 0
                yield _frame(rows)

    return paths.select("path").mapInPandas(read, READ_SCHEMA)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    frame = pd.DataFrame(rows, columns=names)
    return frame.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64"})


def archive(pages: DataFrame, least: int = MIN_REVISIT_BYTES, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as packages in the shared folder; (path, records).

    A null html is an empty payload, a null url has no target field. Of equal payloads the one
    with the smallest page_id is the response and the others are revisits; a page without id
    is a revisit if any page with an id has its payload, else a response. Rows repeated under
    the smallest id are responses each. No pages: no packages.
    """
    folder = new_path(pages.sparkSession, "packages")
    return settle(write_packages(with_revisits(pages, least), folder, package_bytes), "package_list")
