"""WARC records in ZIP packages, written by partition and read back by range.

A package holds gzipped WARC records, one gzip member each, in a stored (not compressed)
member ``archive/data.warc.gz``, and a stored ``indexes/index.cdxj`` with each record's
place.  The reader opens a package in its shared folder, finds the end of central
directory from the file's tail, follows ZIP64 records where sizes or places need them,
checks that the members it wants are stored, and reads just the ranges of the
index and of each record.  Nothing is extracted.

Packages of others are read too: any stored members ``archive/*``, found through their stored
``indexes/*`` of CDXJ lines (a key, a time and JSON with ``offset``, ``length`` and, where there
are several archives, ``filename``), gzipped or not.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, cut, shared_dir, small_batches

# Signatures and sizes of the ZIP format's records.
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
LOCAL_SIZE, CENTRAL_SIZE, END_SIZE, END64_SIZE, LOCATOR64_SIZE = 30, 46, 22, 56, 20
MAX16, MAX32 = 0xFFFF, 0xFFFFFFFF
STORED = 0

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
DATE = "2000-01-01T00:00:00Z"
STAMP = "20000101000000"  # the same time as CDXJ has it
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class ZipWriter:
    """Writes stored members one after the other, sizes and checksums after the data's place is known.

    ``zip64_from`` is the size or place from which ZIP64 fields are used.
    """

    def __init__(self, out, zip64_from: int = MAX32):
        self.out, self.members, self.place, self.limit = out, [], 0, zip64_from

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.place += len(data)

    def add(self, name: str, chunks: list[bytes]) -> int:
        """Add a member made of chunks; returns the place of its data."""
        size, crc = sum(map(len, chunks)), 0
        for c in chunks:
            crc = zlib.crc32(c, crc)
        raw, at = name.encode(), self.place
        large = size >= self.limit
        extra = struct.pack("<HHQQ", 1, 16, size, size) if large else b""
        shown = MAX32 if large else size
        self._write(LOCAL + struct.pack("<HHHHHIIIHH", 45, 0x800, STORED, 0, 33, crc, shown, shown, len(raw), len(extra)) + raw + extra)
        start = self.place
        for c in chunks:
            self._write(c)
        self.members.append((raw, at, size, crc))
        return start

    def close(self) -> None:
        start = self.place
        for raw, at, size, crc in self.members:
            fields = [x for x in (size, size) if size >= self.limit] + [at] * (at >= self.limit)
            extra = struct.pack(f"<HH{len(fields)}Q", 1, 8 * len(fields), *fields) if fields else b""
            shown = MAX32 if size >= self.limit else size
            place = MAX32 if at >= self.limit else at
            head = struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0x800, STORED, 0, 33, crc, shown, shown, len(raw), len(extra), 0, 0, 0, 0, place)
            self._write(CENTRAL + head + raw + extra)
        size, n = self.place - start, len(self.members)
        if start >= self.limit or size >= self.limit or n >= MAX16:
            end64 = self.place
            self._write(END64 + struct.pack("<QHHIIQQQQ", END64_SIZE - 12, 45, 45, 0, 0, n, n, size, start))
            self._write(LOCATOR64 + struct.pack("<IQI", 0, end64, 1))
            n, size, start = MAX16, MAX32, MAX32
        self._write(END + struct.pack("<HHHHIIH", 0, 0, n, n, size, start, 0))


class ZipReader:
    """The directory of a ZIP file that can be read by range; members are read without extraction."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size
        count, length, start = self._end()
        raw = self.read(start, length)
        self.members: dict[str, tuple[int, int, int, int]] = {}
        at = 0
        for _ in range(count):
            if raw[at : at + 4] != CENTRAL:
                raise ValueError("the central directory is damaged")
            flags, method = struct.unpack_from("<HH", raw, at + 8)
            crc, packed, full, n, m, k = struct.unpack_from("<IIIHHH", raw, at + 16)
            place = struct.unpack_from("<I", raw, at + 42)[0]
            name = raw[at + CENTRAL_SIZE : at + CENTRAL_SIZE + n].decode("utf-8" if flags & 0x800 else "cp437")
            full, packed, place = self._wide(raw[at + CENTRAL_SIZE + n : at + CENTRAL_SIZE + n + m], full, packed, place)
            self.members[name] = (method, packed, place, crc)
            at += CENTRAL_SIZE + n + m + k

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        data = self.file.read(n)
        if len(data) != n:
            raise ValueError(f"the file ends before {at + n}")
        return data

    def _end(self) -> tuple[int, int, int]:
        """(entries, bytes, place) of the central directory, from the last end record that fits the file."""
        tail = self.read(max(0, self.size - END_SIZE - MAX16 - LOCATOR64_SIZE), min(self.size, END_SIZE + MAX16 + LOCATOR64_SIZE))
        at = tail.rfind(END)
        while at >= 0 and (at + END_SIZE > len(tail) or at + END_SIZE + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
            at = tail.rfind(END, 0, at)
        if at < 0:
            raise ValueError("not a ZIP file")
        count, length, start = struct.unpack_from("<HII", tail, at + 10)
        before = at - LOCATOR64_SIZE
        if before >= 0 and tail[before : before + 4] == LOCATOR64:
            end64 = self.read(struct.unpack_from("<Q", tail, before + 8)[0], END64_SIZE)
            if end64[:4] != END64:
                raise ValueError("the ZIP64 end record is damaged")
            count, length, start = struct.unpack_from("<QQQ", end64, 32)
        return count, length, start

    @staticmethod
    def _wide(extra: bytes, full: int, packed: int, place: int) -> tuple[int, int, int]:
        """Sizes and place, from the ZIP64 field for those that don't fit 32 bits."""
        at, values = 0, [full, packed, place]
        while at + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, at)
            if kind == 1:
                pos = at + 4
                for i, x in enumerate(values):
                    if x == MAX32:
                        values[i] = struct.unpack_from("<Q", extra, pos)[0]
                        pos += 8
            at += 4 + n
        return tuple(values)

    def stored(self, name: str) -> tuple[int, int]:
        """(place, size) of a stored member's data."""
        if name not in self.members:
            raise KeyError(f"no member {name}")
        method, size, at, _ = self.members[name]
        if method != STORED:
            raise ValueError(f"{name} is compressed, so its records can't be read by range")
        head = self.read(at, LOCAL_SIZE)
        if head[:4] != LOCAL:
            raise ValueError(f"{name} has no local header")
        return at + LOCAL_SIZE + sum(struct.unpack_from("<HH", head, 26)), size


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def response_id(page_id: int, digest: str) -> str:
    """The record id of a page's response, which revisits elsewhere can name: page and payload alone decide it."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}/{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    """A WARC 1.1 record: a response with its payload, or a revisit of the page ``first`` with the HTTP head alone.

    The HTTP head names the payload's length in both.  Rows that repeat a response's page and payload repeat its id.
    """
    name = response_id(page_id, digest) if first is None and page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if first is not None else head + payload
    fields = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {name}", f"WARC-Date: {DATE}"]
    if page_id is not None:
        fields.append(f"WARC-Page-ID: {page_id}")
    if url is not None:
        shown = quote(url, safe=_PRINTABLE)
        fields.append(f"WARC-Target-URI: {shown}")
        if shown != url:  # what a header can't hold as it is
            fields.append(f"WARC-Page-URL: {base64.b64encode(url.encode()).decode()}")
    fields.append(f"WARC-Payload-Digest: sha1:{digest}")
    if first is not None:
        fields += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {response_id(first, digest)}", f"WARC-Refers-To-Page-ID: {first}"]
    fields += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join([*fields, "", ""]).encode() + block + b"\r\n\r\n"


_PRINTABLE = "".join(map(chr, range(33, 127)))


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """A record's fields (names in lower case) and its block."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    n = int(fields["content-length"])
    if len(rest) < n:
        raise ValueError("the record is cut off")
    return fields, rest[:n]


def _page(fields: dict[str, str], block: bytes) -> tuple | None:
    """(page_id, URL, payload or None, bytes of the full payload, digest, type, page revisited); None for other kinds of records.

    What others leave out: a response's digest and length are its payload's, a revisit's are null; digests
    in other than SHA-1 stay as they are, unchecked.
    """
    kind = fields.get("warc-type")
    if kind not in ("response", "revisit"):
        return None
    head, _, payload = block.partition(b"\r\n\r\n") if fields.get("content-type", "").startswith("application/http") else (b"", b"", block)
    http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])}
    said, length = fields.get("warc-payload-digest"), http.get("content-length", "")
    digest = said.removeprefix("sha1:") if said else digest_of(payload) if kind == "response" else None
    size = int(length) if length.isdigit() else len(payload) if kind == "response" else None
    # A length in the HTTP head that isn't the payload's is an error in records of our own alone; servers send such.
    own = "warc-page-id" in fields
    if kind == "response" and said and said.startswith("sha1:") and digest_of(payload) != digest or kind == "response" and own and size != len(payload):
        raise ValueError(f"the payload of page {fields.get('warc-page-id') or fields.get('warc-target-uri')} doesn't match its digest")
    size = len(payload) if kind == "response" else size
    number = lambda name: int(fields[name]) if name in fields else None
    url = base64.b64decode(fields["warc-page-url"]).decode() if "warc-page-url" in fields else fields.get("warc-target-uri")
    return number("warc-page-id"), url, payload if kind == "response" else None, size, digest, kind, number("warc-refers-to-page-id")


def index_line(url: str | None, digest: str, offset: int, length: int) -> str:
    """A CDXJ line: key, time and JSON; a key has no blanks."""
    key = quote(url or "-", safe="/:?=&%.,()-_~") or "-"
    return f"{key} {STAMP} " + json.dumps({"url": url, "digest": f"sha1:{digest}", "filename": DATA.rpartition("/")[2], "offset": offset, "length": length}, separators=(",", ":"))


def entries(package: ZipReader) -> list[tuple[int, int]]:
    """(place in the file, bytes) of each record in a package, by place, from its stored indexes.

    Lines without JSON, as headers, say nothing; places are numbers or strings of digits.  A line without a
    file name is of the only archive.  A package with archives and no index is an error, and so is a line of an archive that isn't there.
    """
    archives = sorted(x for x in package.members if x.startswith("archive/") and not x.endswith("/"))
    indexes = sorted(x for x in package.members if x.startswith("indexes/") and x.endswith((".cdxj", ".cdx", ".cdxj.gz", ".cdx.gz")))
    if archives and not indexes:
        raise ValueError("the package has no index")
    found = set()
    for name in indexes:
        raw = package.read(*package.stored(name))
        lines = (gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw).decode("utf-8").splitlines()
        for line in lines:
            start = line.find("{")
            entry = json.loads(line[start:]) if start >= 0 and not line.startswith("!") else {}
            if "offset" not in entry or "length" not in entry:
                continue
            named = [x for x in archives if "filename" not in entry or x == entry["filename"] or x == f"archive/{entry['filename']}"]
            if len(named) != 1:
                raise ValueError(f"an index line is of no archive: {entry.get('filename')}")
            place, size = package.stored(named[0])
            offset, length = int(entry["offset"]), int(entry["length"])
            if offset < 0 or length < 0 or offset + length > size:
                raise ValueError("the index points past the archive")
            found.add((place + offset, length))
    return sorted(found)


#: Payloads that at least one page in so many has, at most so many of them, are told to all tasks; the others are joined.
HOT_SHARE = 1000


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id, url, payload, digest, first``: ``first`` is the least id of an equal payload of at least ``min_bytes``, if another has it.

    Only digests that occur twice meet the pages again; a digest of any number of pages
    is one partial minimum a task.  The most frequent ones, up to ``HOT_SHARE`` by their share of all
    pages, are broadcast, so that no task of the join for the others gets more than a small share of the pages.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    same = rows.filter(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("least"), F.count("*").alias("n"))
    same = cut(same)
    pages_counted = same.agg(F.sum("n")).first()[0] or 0
    same = same.filter("n > 1")
    hot, cold = (same.filter(x).select("digest", "least") for x in (F.col("n") * HOT_SHARE >= pages_counted, F.col("n") * HOT_SHARE < pages_counted))
    told = rows.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "digest", "left")
    rest = told.filter("hot is null").drop("least", "hot").join(cold, "digest", "left")
    out = told.filter("hot").drop("hot").unionByName(rest)
    return out.select("page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("least")), F.col("least")).alias("first"))


def write(pages: DataFrame, folder: str, min_bytes: int = 0, package_bytes: int = 8 << 20, level: int = 4, zip64_from: int = MAX32) -> DataFrame:
    """Write pages (``page_id, url, html``) as packages in ``folder``; returns ``path, bytes, records`` for each.

    A package is closed at about ``package_bytes``, which bounds a task's memory.  A task
    that is run again writes files of its own; only the files of tasks that ended are listed.
    """

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        records, index, size = [], [], 0

        def close() -> pa.RecordBatch:
            path = f"{root}/{uuid.uuid4().hex}.wacz"
            with store.open_output_stream(path) as out:
                package = ZipWriter(out, zip64_from)
                package.add(DATA, records)
                package.add(INDEX, ["\n".join(sorted(index)).encode()])
                package.add("datapackage.json", [b'{"profile":"data-package","wacz_version":"1.1.1"}'])
                package.close()
                total = package.place
            return pa.RecordBatch.from_pydict({"path": [path], "bytes": [total], "records": [len(records)]})

        for batch in batches:
            for k in range(len(batch)):
                page_id, url, payload, digest, first = (batch[c][k].as_py() for c in ("page_id", "url", "payload", "digest", "first"))
                named = base64.b32encode(bytes.fromhex(digest)).decode()
                raw = gzip.compress(record(page_id, url, payload, named, first), level, mtime=0)
                index.append(index_line(url, named, size, len(raw)))
                records.append(raw)
                size += len(raw)
                if size >= package_bytes:
                    yield close()
                    records, index, size = [], [], 0
        if records:
            yield close()

    return cut(small_batches(revisits(pages, min_bytes)).mapInArrow(written, "path string, bytes long, records long"))


def gunzipped(raw: bytes) -> bytes:
    """A record's bytes, which may be stored without gzip."""
    return gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw


def read(packages: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """All records of the packages listed in ``packages`` (column ``path``), read by range through their indexes.

    Returns ``page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to``; the
    payload, null for revisits, only ``with_payload``.  Responses are checked against their SHA-1 digests.
    Records of other kinds (requests, metadata ...) are left out; what other writers don't say is null.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch["path"].to_pylist():
                with store.open_input_file(path) as file:
                    package = ZipReader(file, file.size())
                    rows, held = [], 0
                    for place, length in entries(package):
                        page = _page(*parse_record(gunzipped(package.read(place, length))))
                        if page is None:
                            continue
                        rows.append(page if with_payload else (*page[:2], None, *page[3:]))
                        held += len(page[2] or b"") * with_payload
                        if len(rows) == 500 or held > BATCH_BYTES:
                            yield batch_of(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch_of(rows)

    types = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64())
    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    schema = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
    files = packages.select("path")
    return files.repartition(max(1, int(packages.sparkSession.conf.get("spark.sql.shuffle.partitions")))).mapInArrow(found, schema)


def round_trip(pages: DataFrame, min_bytes: int = 0, **how) -> DataFrame:
    """Write ``pages`` (``page_id, url, html``) to packages in the shared folder and read them back.

    Of equal payloads of at least ``min_bytes``, the page with the least id is a response, the
    others revisit it; smaller ones are all responses.

    Defined cases: null html is an empty payload; a null URL stays null; a null id is never
    the least, and a page without one revisits a page with one (pages that only have null ids are
    responses); rows that repeat the least id are responses all; an empty table writes no
    package; other columns are ignored.
    """
    folder = f"{shared_dir(pages.sparkSession)}/stallwise/archives-{uuid.uuid4().hex}"
    rows = pages.select(F.col("page_id").cast("long"), "url", "html")
    return read(write(rows, folder, min_bytes, **how), folder)


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages
), d AS (
  SELECT page_id, octet_length(encode(h)) AS n, min(page_id) OVER (PARTITION BY x) AS first,
         array_to_string(list_transform(range(8), lambda i: list_transform([CAST('0x' || substr(x, CAST(5 * i + 1 AS INT), 5) AS INT)],
           lambda v: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v >> 15) % 32 + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v >> 10) % 32 + 1, 1)
             || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v >> 5) % 32 + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', v % 32 + 1, 1))[1]), '') AS digest
  FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""
