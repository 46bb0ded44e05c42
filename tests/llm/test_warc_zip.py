"""WARC packages: round trips, the ZIP reader against the standard library's writer, and packages of others."""

import base64
import gzip
import hashlib
import io
import json
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from addrspark.llm import warc_zip as w


def sha(body):
    return hashlib.sha256(body).hexdigest()


def read(data):
    f = pa.BufferReader(data)
    return [x for r in w.ranges(f, len(data)) for x in w.records_in(f, r)]


@pytest.mark.parametrize("zip64", [False, True])
def test_members_of_both_directories(zip64):
    package = w.Package(zip64)
    for k in range(200):
        body = b"x\r\n\r\n" * k
        url = f"http://{'zyx'[k % 3]}.org/{k}"
        package.add(url, sha(body), w.record(str(k), url, body, sha(body), "3" if k % 5 == 4 else None))
    data = b"".join(package.parts())
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.testzip() is None and z.namelist() == [w.DATA, w.INDEX]
        places = {x.filename: x.file_size for x in z.infolist()}
        listed = z.read(w.INDEX).decode().split("\n")
    assert listed == sorted(listed) and all(w.place(x.encode())[0] == "data.warc.gz" for x in listed)
    assert {n: m.plain for n, m in w.members(pa.BufferReader(data), len(data)).items()} == places
    rows = read(data)
    assert [r["record_id"] for r in rows] == [f"<urn:page:{k}>" for k in range(200)]
    assert [r["payload_bytes"] for r in rows] == [5 * k for k in range(200)]
    assert all((r["payload"] is None) == (r["refers_to"] == "<urn:page:3>") for r in rows)


def foreign(packed_archive=False):
    """A package as another tool writes it: two archives, one plain and without an index, the other indexed in url order."""
    body = lambda k: b"<p>" + b"%d" % k * (k * 700)
    http = lambda k: b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + body(k)

    def rec(k, kind="response", digest=True):
        block = http(k) if kind == "response" else b"software: x\r\n"
        mark = "sha1:" + base64.b32encode(hashlib.sha1(body(k)).digest()).decode()
        head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{k}>", f"Content-Type: {'application/http; msgtype=response' if kind == 'response' else 'application/warc-fields'}", f"Content-Length: {len(block)}"]
        return ("WARC/1.0\r\n" + "\r\n".join(head + [f"WARC-Payload-Digest: {mark}"] * (kind == "response" and digest)) + "\r\n\r\n").encode() + block + b"\r\n\r\n"

    one, index, at = b"", [], 0
    for k in range(40):
        raw = gzip.compress(rec(k))
        index.append(f"org,z{(k * 7) % 40:02})/ 2024 " + json.dumps({"filename": "a.warc.gz", "offset": at, "length": str(len(raw)), "url": "u"}))
        one, at = one + raw, at + len(raw)
    two = rec(99, "warcinfo") + b"".join(rec(k, digest=k % 2) for k in range(100, 104))
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        z.comment = b"PK" * 100
        z.writestr("datapackage.json", "{}" * 500)
        z.writestr("pages/pages.jsonl", "{}\n" * 500)
        z.writestr("archive/a.warc.gz", one, zipfile.ZIP_DEFLATED if packed_archive else zipfile.ZIP_STORED)
        z.writestr("archive/b.warc", two, zipfile.ZIP_STORED)
        z.writestr("indexes/index.cdx.gz", gzip.compress("\n".join(sorted(index)[:20]).encode()) + gzip.compress(("\n" + "\n".join(sorted(index)[19:])).encode()), zipfile.ZIP_STORED)
        z.writestr("indexes/index.idx", "!meta\n")
    return buffer.getvalue(), {f"<urn:uuid:{k}>": sha(body(k)) for k in [*range(40), *range(100, 104)]}


def test_packages_of_others(spark, tmp_path):
    data, want = foreign()
    rows = read(data)
    assert {r["record_id"]: r["payload_digest"] for r in rows if r["record_type"] == "response"} == want and len(rows) == 45
    with pytest.raises(ValueError, match="not stored"):
        read(foreign(packed_archive=True)[0])
    with pytest.raises(ValueError):
        read(b"nothing")
    with pytest.raises(ValueError, match="damaged"):
        w.parse(w.record("1", "u", b"abc", sha(b"abd"), None))
    paths = []
    for k in range(3):
        paths.append((str(tmp_path / f"{k}.wacz"),))
        (tmp_path / f"{k}.wacz").write_bytes(data)
    got = w.read_packages(spark.createDataFrame(paths, "path string"), payloads=True)
    assert got.count() == 135 and got.where("record_type = 'response' and sha2(payload, 256) <> payload_digest").isEmpty()


def test_a_package_and_many_are_read_by_many_tasks(spark):
    pages = spark.range(600).select(F.col("id").alias("page_id"), F.lit("http://a/").alias("url"), F.sha2(F.col("id").cast("string"), 512).alias("html"))
    for size, files in ((1 << 30, 4), (2000, 40)):
        written = w.write_packages(w.plan_records(pages.repartition(4)), w.shared_path(spark, "w"), package_bytes=size)
        assert written.count() >= files
        parts = w.read_packages(written, read_bytes=2000).select(F.spark_partition_id().alias("p"), "record_id").groupBy("p").count().collect()
        assert len(parts) == 2 * spark.sparkContext.defaultParallelism and sum(r["count"] for r in parts) == 600
        assert max(r["count"] for r in parts) < 200


def test_archive_pages(spark):
    long, other = "é" * 60, "z" * 200
    rows = [(5, "u", long), (3, None, long), (3, "u\r\nx: y", long), (9, "u", long), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (6, "u", ""), (7, "u", other), (None, "u", other), (8, "http://[x", "w" * 500000), (10, "u", "v" * 99), (11, "u", "v" * 99)]
    pages = spark.createDataFrame([(*r, 0, 1, 2) for r in rows], "page_id bigint, url string, html string, refers_to int, `a.b` int, digest int")
    for kind in ("bigint", "string"):
        id_of = (lambda x: x) if kind == "bigint" else (lambda x: None if x is None else f"p {x:02}/é%")
        given = pages if kind == "bigint" else pages.withColumn("page_id", F.concat(F.lit("p "), F.lpad(F.col("page_id").cast("string"), 2, "0"), F.lit("/é%")))
        got = w.archive_pages(given, package_bytes=300, zip64=True)
        assert dict(got.dtypes)["page_id"] == dict(got.dtypes)["refers_to"] == kind
        want = []
        for page, _, html in rows:
            body = (html or "").encode()
            first = {long: 3, other: 7}.get(html)
            again = first is not None and page != first
            want.append((id_of(page), len(body), sha(body), "revisit" if again else "response", id_of(first) if again else None))
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert w.archive_pages(pages.limit(0)).count() == 0
