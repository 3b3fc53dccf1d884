import gzip
import io
import random
import zipfile

import pyarrow.fs as pafs
import pytest

from stallwise.llm import archives as ar
from stallwise.llm.common import shared_dir


class Ranges(io.BytesIO):
    """A file that notes which ranges are read."""

    def __init__(self, data):
        super().__init__(data)
        self.read_bytes = 0

    def read(self, n=-1):
        self.read_bytes += n
        return super().read(n)


@pytest.mark.parametrize("zip64_from", [ar.MAX32, 0, 100])
def test_packages_are_zip_files(zip64_from):
    out = io.BytesIO()
    writer = ar.ZipWriter(out, zip64_from)
    big = random.Random(1).randbytes(200_000)
    members = {"a.txt": [b"x", b"yz"], "ü/empty": [b""], "big": [big]}
    for name, chunks in members.items():
        writer.add(name, chunks)
    writer.close()
    with zipfile.ZipFile(io.BytesIO(out.getvalue())) as z:
        assert z.testzip() is None and {n: z.read(n) for n in z.namelist()} == {n: b"".join(c) for n, c in members.items()}
    file = Ranges(out.getvalue())
    reader = ar.ZipReader(file, len(out.getvalue()))
    assert {n: reader.read(*reader.stored(n)) for n in members} == {n: b"".join(c) for n, c in members.items()}
    file.read_bytes = 0
    start, _ = reader.stored("big")
    assert reader.read(start + 1000, 10) == big[1000:1010] and file.read_bytes < 100


def test_foreign_zip_files():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("s", b"stored", zipfile.ZIP_STORED)
        z.writestr("d", b"deflated" * 9, zipfile.ZIP_DEFLATED)
        z.comment = b"with a comment PK\x05\x06 in it"
    reader = ar.ZipReader(out, len(out.getvalue()))
    assert reader.read(*reader.stored("s")) == b"stored"
    with pytest.raises(ValueError, match="compressed"):
        reader.stored("d")
    with pytest.raises(KeyError):
        reader.stored("x")
    with pytest.raises(ValueError, match="not a ZIP"):
        ar.ZipReader(io.BytesIO(b"no"), 2)


def brute(rows, min_bytes=0):
    least = {}
    for i, _, h in rows:
        if i is not None:
            least[h or ""] = min(i, least.get(h or "", i))
    out = []
    for i, u, h in rows:
        raw = (h or "").encode()
        first = least.get(h or "") if len(raw) >= min_bytes else None
        revisit = first is not None and first != i
        out.append((i, u, len(raw), ar.digest_of(raw), "revisit" if revisit else "response", first if revisit else None))
    return out


ROWS = [
    (5, "http://a/ü x?q=%41", "<p>é</p>"), (3, "http://b", "<p>é</p>"), (9, None, None), (4, "", ""), (7, "x\r\ny: z", "long " * 40_000),
    (None, "http://n", "<p>é</p>"), (None, "http://o", "only"), (3, "http://b", "<p>é</p>"), (11, "u", "HTTP\r\n\r\nWARC/1.1\r\n\r\n"), (12, "v", "t"),
]


@pytest.mark.parametrize("how", [{}, {"package_bytes": 200, "zip64_from": 0}, {"min_bytes": 5}])
def test_round_trip(spark, how):
    pages = spark.createDataFrame([(*r, "x") for r in ROWS], "page_id long, url string, html string, digest string")
    out = ar.round_trip(pages.repartition(3), **how).drop("payload").collect()
    assert sorted(map(tuple, out), key=repr) == sorted(brute(ROWS, how.get("min_bytes", 0)), key=repr)
    assert ar.round_trip(pages.limit(0)).collect() == []


def test_payloads_come_back(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    folder = f"{shared_dir(spark)}/test-archives"
    packages = ar.write(pages.repartition(2), folder)
    out = ar.read(packages, folder, with_payload=True).filter("record_type = 'response'").collect()
    texts = {(i, u): (h or "").encode() for i, u, h in ROWS}
    assert out and all(bytes(x["payload"]) == texts[x["page_id"], x["url"]] for x in out)
    store, root = pafs.FileSystem.from_uri(folder)
    path = packages.first()["path"]
    data = bytearray(store.open_input_file(path).read())
    data[60] ^= 1  # inside the first record
    with store.open_output_stream(path) as f:
        f.write(bytes(data))
    with pytest.raises(Exception):  # noqa: B017
        ar.read(packages, folder).collect()


def foreign_record(kind, fields, block):
    lines = [f"WARC/1.1\r\nWARC-Type: {kind}", *fields, f"Content-Length: {len(block)}"]
    return "\r\n".join([*lines, "", ""]).encode() + block + b"\r\n\r\n"


def test_packages_of_others(spark):
    http = "Content-Type: application/http; msgtype=response"
    records = [
        foreign_record("warcinfo", ["Content-Type: application/warc-fields"], b"software: x"),
        foreign_record("response", ["WARC-Target-URI: http://a/", http], b"HTTP/1.1 200 OK\r\nContent-Length: 99\r\n\r\nhello"),
        foreign_record("response", ["WARC-Target-URI: http://b/", http, "WARC-Payload-Digest: sha256:ab"], b"HTTP/1.1 200 OK\r\n\r\n"),
        foreign_record("revisit", ["WARC-Target-URI: http://c/", "WARC-Refers-To: <urn:x>", http], b"HTTP/1.1 200 OK\r\n\r\n"),
    ]
    want = [("http://a/", 5, ar.digest_of(b"hello"), "response"), ("http://b/", 0, "sha256:ab", "response"), ("http://c/", None, None, "revisit")]
    for packed in (True, False):
        raws = [gzip.compress(x) if packed else x for x in records]
        lines, archives = ['!meta 0 {"offset": 1}', ""], {"archive/one.warc": b"", "archive/two.warc": b""}
        for k, raw in enumerate(raws):
            name = "archive/one.warc" if k < 2 else "archive/two.warc"
            lines.append(f'com,x)/ 2020 {{"offset": "{len(archives[name])}", "length": {len(raw)}, "filename": "{name[8:]}"}}')
            archives[name] += raw
        index = "\n".join(lines).encode()
        folder = f"{shared_dir(spark)}/foreign-{packed}"
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root)
        with store.open_output_stream(f"{root}/x.wacz") as out:
            whole = io.BytesIO()
            with zipfile.ZipFile(whole, "w") as z:
                for name, data in archives.items():
                    z.writestr(name, data)
                z.writestr("indexes/index.cdx.gz" if packed else "indexes/index.cdxj", gzip.compress(index) if packed else index)
                z.writestr("pages/pages.jsonl", b"{}", zipfile.ZIP_DEFLATED)
            out.write(whole.getvalue())
        got = ar.read(spark.createDataFrame([(f"{root}/x.wacz",)], "path string"), folder).collect()
        assert sorted((x["url"], x["payload_bytes"], x["payload_digest"], x["record_type"]) for x in got) == want


def test_bad_indexes():
    def package(**members):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, data in members.items():
                z.writestr(name.replace("__", "/") + (".cdxj" if name.startswith("indexes") else ""), data)
        return ar.ZipReader(out, len(out.getvalue()))

    assert ar.entries(package()) == []
    for members, error in (
        ({"archive__a": b"x"}, "no index"),
        ({"archive__a": b"x", "indexes__i": b'k 1 {"offset": 0, "length": 2}'}, "past"),
        ({"archive__a": b"x", "indexes__i": b'k 1 {"offset": 0, "length": 1, "filename": "b"}'}, "no archive"),
        ({"archive__a": b"x", "archive__b": b"x", "indexes__i": b'k 1 {"offset": 0, "length": 1}'}, "no archive"),
    ):
        with pytest.raises(ValueError, match=error):
            ar.entries(package(**members))


def test_revisits_name_the_record(spark):
    pages = spark.createDataFrame([(5, "b", "same"), (2, "a", "same"), (7, "c", "same")], "page_id long, url string, html string")
    folder = f"{shared_dir(spark)}/test-refers"
    path = ar.write(pages.repartition(3), folder).collect()
    store, _ = pafs.FileSystem.from_uri(folder)
    records = []
    for row in path:
        data = store.open_input_file(row["path"]).read()
        package = ar.ZipReader(io.BytesIO(data), len(data))
        records += [ar.parse_record(gzip.decompress(package.read(*x)))[0] for x in ar.entries(package)]
    response = [x for x in records if x["warc-type"] == "response"]
    assert len(response) == 1 and response[0]["warc-page-id"] == "2"
    assert {x["warc-refers-to"] for x in records if x["warc-type"] == "revisit"} == {response[0]["warc-record-id"]} and len(records) == 3


def test_many_different_pages_and_a_hot_payload(spark):
    """Payloads on both sides of the share from which they are broadcast."""
    rows = [(i, f"u{i}", f"text {i // 2}" if i % 3 else "hot") for i in range(6000)]
    out = ar.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).drop("payload").collect()
    assert sorted(map(tuple, out)) == sorted(brute(rows))
