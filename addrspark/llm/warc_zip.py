"""WARC records in ZIP packages, and their reader.

A package is a ZIP file whose members under archive/ hold WARC records and whose members under indexes/ say where each
record lies. The writer makes packages of two stored members: archive/data.warc.gz, in which every record is a gzip
member of its own, and indexes/index.cdxj, a line of url key, time and JSON for each. The reader takes any such package,
its own or another's: it parses the end-of-archive records (ZIP64 where needed) and the central directory, finds the
stored archive members and the indexes, sorts what they list by file and place into ranges of about READ_BYTES, and
these ranges, not the packages, are dealt over the tasks; nothing is unpacked. Archive members that no index names are
read through from their start. Packages lie in the folder that all executors share, and are opened through pyarrow's
file systems, so that folder may be local or in a store.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Narrow, discard, shared_path, staged, table, text_bytes, text_of

#: Payloads shorter than this are always written in full.
MIN_SHARED = 100
#: A package is closed at about this many bytes.
PACKAGE_BYTES = 64 << 20
#: Records are fetched by ranges of about this many bytes, in which no more than GAP_BYTES at once are of no use.
READ_BYTES, GAP_BYTES = 1 << 20, 64 << 10
#: Bytes of ranges, and packages, that one task reads.
TASK_BYTES, TASK_PACKAGES = 64 << 20, 64
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
TIME = "2000-01-01T00:00:00Z"
_END, _END64, _LOCATOR, _ENTRY, _LOCAL = 0x06054B50, 0x06064B50, 0x07064B50, 0x02014B50, 0x04034B50
_RECORD = "record_type string, record_id string, target_uri string, refers_to string, payload_bytes bigint, payload_digest string"


def open_store(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[5:]
    return pyarrow.fs.FileSystem.from_uri(uri) if ":" in uri else (pyarrow.fs.LocalFileSystem(), uri)


# --- writing


def header(name: str, fields: list[tuple[str, str]]) -> bytes:
    return "".join([name, "\r\n", *(f"{k}: {v}\r\n" for k, v in fields), "\r\n"]).encode()


def page_urn(page: str | None) -> str:
    return "<urn:page>" if page is None else f"<urn:page:{quote(page, safe='')}>"


def record(page: str | None, url: str, payload: bytes, digest: str, refers: str | None) -> bytes:
    """One WARC record. A revisit holds the HTTP header alone, whose Content-Length is still the payload's."""
    http = header("HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))])
    block = http if refers is not None else http + payload
    fields = [("WARC-Type", "response" if refers is None else "revisit"), ("WARC-Record-ID", page_urn(page)), ("WARC-Target-URI", url), ("WARC-Date", TIME), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if refers is not None:
        fields += [("WARC-Refers-To", page_urn(refers)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    return header("WARC/1.1", [*fields, ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]) + block + b"\r\n\r\n"


def url_key(url: str) -> str:
    """The key that an index sorts by: the host's parts from the last to the first, then path and query."""
    try:
        parts = urlsplit(url)
        host = ",".join(reversed((parts.hostname or "").split(".")))
    except ValueError:
        return quote(url, safe="/:?=&")
    return quote(f"{host}){parts.path or '/'}{'?' + parts.query if parts.query else ''}".lower(), safe=",)/:?=&")


class Package:
    """A ZIP file being written in one pass: the data member's header is patched in memory before the file is sent."""

    def __init__(self, zip64: bool = False):
        self.data, self.lines, self.zip64 = bytearray(), [], zip64

    def add(self, url: str, digest: str, raw: bytes) -> None:
        packed = gzip.compress(raw, 1, mtime=0)
        about = {"url": url, "mime": "text/html", "status": "200", "digest": f"sha256:{digest}", "length": str(len(packed)), "offset": str(len(self.data)), "filename": DATA.split("/")[1]}
        self.lines.append(f"{url_key(url)} {re.sub('[^0-9]', '', TIME)} {json.dumps(about)}")
        self.data += packed

    def parts(self) -> list[bytes]:
        out, at, entries = [], 0, []
        for name, body in ((DATA, self.data), (INDEX, "\n".join(sorted(self.lines)).encode())):
            crc, n = zlib.crc32(body), len(body)
            wide = self.zip64 or n >= 0xFFFFFFFF
            size, extra = (0xFFFFFFFF, struct.pack("<HHQQ", 1, 16, n, n)) if wide else (n, b"")
            local = struct.pack("<IHHHHHIIIHH", _LOCAL, 45, 0x800, 0, 0, 33, crc, size, size, len(name), len(extra)) + name.encode() + extra
            far = self.zip64 or at >= 0xFFFFFFFF
            values = [n, n] * wide + [at] * far
            more = struct.pack(f"<HH{len(values)}Q", 1, 8 * len(values), *values) if values else b""
            entries.append(struct.pack("<IHHHHHHIIIHHHHHII", _ENTRY, 45, 45, 0x800, 0, 0, 33, crc, size, size, len(name), len(more), 0, 0, 0, 0, 0xFFFFFFFF if far else at) + name.encode() + more)
            out += [local, body]
            at += len(local) + n
        central = b"".join(entries)
        out.append(central)
        if self.zip64 or at >= 0xFFFFFFFF:
            out.append(struct.pack("<IQHHIIQQQQ", _END64, 44, 45, 45, 0, 0, len(entries), len(entries), len(central), at))
            out.append(struct.pack("<IIQI", _LOCATOR, 0, at + len(central), 1))
            out.append(struct.pack("<IHHHHIIH", _END, 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0))
        else:
            out.append(struct.pack("<IHHHHIIH", _END, 0, 0, len(entries), len(entries), len(central), at, 0))
        return out


# --- reading: the ZIP directory


class Member(NamedTuple):
    """A member of a ZIP file: where its local header is, its bytes packed and plain, and the method of packing."""

    header: int
    packed: int
    plain: int
    method: int


def members(f, size: int) -> dict[str, Member]:
    """The members of a ZIP file by name, from its central directory."""
    tail_at = max(0, size - 65_557)
    tail = f.read_at(size - tail_at, tail_at)
    at = tail.rfind(struct.pack("<I", _END))
    if at < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack_from("<HII", tail, at + 10)
    if count == 0xFFFF or 0xFFFFFFFF in (length, start):
        mark, _, where, _ = struct.unpack("<IIQI", f.read_at(20, tail_at + at - 20))
        if mark != _LOCATOR:
            raise ValueError("no ZIP64 locator")
        mark, *_, count, length, start = struct.unpack("<IQHHIIQQQQ", f.read_at(56, where))
        if mark != _END64:
            raise ValueError("no ZIP64 end of central directory")
    directory, at, out = f.read_at(length, start), 0, {}
    for _ in range(count):
        mark, _, _, _, method, _, _, _, packed, plain, n, m, k, _, _, _, local = struct.unpack_from("<IHHHHHHIIIHHHHHII", directory, at)
        if mark != _ENTRY:
            raise ValueError("broken central directory")
        name, extra = directory[at + 46 : at + 46 + n].decode(errors="replace"), directory[at + 46 + n : at + 46 + n + m]
        at += 46 + n + m + k
        while len(extra) >= 4:
            kind, width = struct.unpack_from("<HH", extra)
            if kind == 1:
                wide = iter(struct.unpack(f"<{width // 8}Q", extra[4 : 4 + width // 8 * 8]))
                plain, packed, local = (next(wide) if x == 0xFFFFFFFF else x for x in (plain, packed, local))
            extra = extra[4 + width :]
        out[name] = Member(local, packed, plain, method)
    return out


def data_at(f, name: str, m: Member) -> int:
    """Where the data of a member begins."""
    mark, n, k = struct.unpack("<I22xHH", f.read_at(30, m.header))
    if mark != _LOCAL:
        raise ValueError(f"no local header of {name}")
    return m.header + 30 + n + k


def blocks(f, start: int, length: int) -> Iterator[bytes]:
    for at in range(start, start + length, READ_BYTES):
        yield f.read_at(min(READ_BYTES, start + length - at), at)


def inflated(parts: Iterator[bytes], wbits: int) -> Iterator[bytes]:
    """The plain bytes of a packed stream, of several gzip members too."""
    z = zlib.decompressobj(wbits)
    for part in parts:
        while part:
            yield z.decompress(part)
            part = z.unused_data
            if part:
                z = zlib.decompressobj(wbits)


def lines(parts: Iterator[bytes]) -> Iterator[bytes]:
    held = b""
    for part in parts:
        *whole, held = (held + part).split(b"\n")
        yield from whole
    yield held


def index_lines(f, name: str, m: Member) -> Iterator[bytes]:
    """The lines of an index, read in blocks; it may be deflated in the ZIP file or gzipped by itself."""
    if m.method not in (0, 8):
        raise ValueError(f"{name} is packed by method {m.method}")
    parts = blocks(f, data_at(f, name, m), m.packed)
    if m.method == 8:
        parts = inflated(parts, -15)
    return lines(inflated(parts, 31) if name.endswith(".gz") else parts)


def place(line: bytes) -> tuple[str, int, int] | None:
    """(file, offset, length) of an index line, of JSON or of eleven fields; None if it names no record."""
    text = line.decode(errors="replace").strip()
    at = text.find("{")
    try:
        if at >= 0:
            about = json.loads(text[at:])
            return about["filename"], int(about["offset"]), int(about["length"])
        parts = text.split(" ")
        return (parts[10], int(parts[9]), int(parts[8])) if len(parts) == 11 else None
    except (KeyError, ValueError):
        return None


def ranges(f, size: int, read_bytes: int = READ_BYTES) -> Iterator[dict]:
    """What to fetch of a package: member, start and length in the file, and the offsets and lengths of records in it.

    An empty list of offsets means that the member is read through from its start, for no index names it. Of the entries
    16 bytes each are held.
    """
    found = members(f, size)
    archives = {n: m for n, m in found.items() if re.fullmatch(r"archive/.*\.warc(\.gz)?", n)}
    for name, m in archives.items():
        if m.method:
            raise ValueError(f"{name} is not stored")
    listed: dict[str, tuple[array, array]] = {n: (array("q"), array("q")) for n in archives}
    known = {n.removeprefix("archive/"): n for n in archives} | {n: n for n in archives}
    for name, m in found.items():
        if re.fullmatch(r"indexes/.*\.cdxj?(\.gz)?", name):
            for line in index_lines(f, name, m):
                if (at := place(line)) and at[0] in known:
                    for held, x in zip(listed[known[at[0]]], at[1:], strict=True):
                        held.append(x)
    for name, (offsets, lengths) in listed.items():
        base = data_at(f, name, archives[name])
        if not offsets:
            yield {"member": name, "start": base, "length": archives[name].packed, "offsets": [], "lengths": []}
            continue
        held: list[tuple[int, int]] = []
        for x in sorted({*zip(offsets, lengths, strict=True)}):
            if held and (x[0] - sum(held[-1]) > GAP_BYTES or sum(x) - held[0][0] > read_bytes):
                yield _range(name, base, held)
                held = []
            held.append(x)
        yield _range(name, base, held)


def _range(name: str, base: int, held: list[tuple[int, int]]) -> dict:
    first = held[0][0]
    return {"member": name, "start": base + first, "length": max(map(sum, held)) - first, "offsets": [a - first for a, _ in held], "lengths": [n for _, n in held]}


# --- reading: records


def fields_of(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode(errors="replace").split("\r\n")[1:])}


def same_digest(stated: str, payload: bytes) -> bool:
    """Whether a stated digest (name:hex or base32) is the payload's; true of names that are not known."""
    name, _, value = stated.partition(":")
    if name.lower() not in ("sha1", "sha256"):
        return True
    d = hashlib.new(name.lower(), payload)
    return value.lower() == d.hexdigest() or value.upper().rstrip("=") == base64.b32encode(d.digest()).decode().rstrip("=")


def parse(raw: bytes) -> dict:
    """What a record says: its type, id, target, and its payload with length and SHA-256.

    The payload is what follows the HTTP header, or the whole block if there is none. A revisit has none; its length is
    what the HTTP header says, and its digest what the record says, if that is SHA-256 in hex; else both are null.
    """
    head, _, rest = raw.partition(b"\r\n\r\n")
    warc = fields_of(head)
    block = rest[: int(warc["content-length"])]
    if rest[len(block) :] not in (b"\r\n\r\n", b"") or len(block) != int(warc["content-length"]):
        raise ValueError("a record does not end where it says")
    http, payload = b"", block
    if warc.get("content-type", "").lower().startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
    stated, kind = warc.get("warc-payload-digest", ""), warc.get("warc-type", "")
    out = {"record_type": kind, "record_id": warc.get("warc-record-id"), "target_uri": warc.get("warc-target-uri"), "refers_to": warc.get("warc-refers-to")}
    if kind == "revisit":
        length, digest = fields_of(http).get("content-length"), re.fullmatch("sha256:([0-9a-fA-F]{64})", stated)
        return out | {"payload_bytes": None if length is None else int(length), "payload_digest": digest and digest[1].lower(), "payload": None}
    if kind in ("response", "resource") and not same_digest(stated, payload):
        raise ValueError(f"the payload of {out['record_id']} is damaged")
    return out | {"payload_bytes": len(payload), "payload_digest": hashlib.sha256(payload).hexdigest(), "payload": payload}


def through(parts: Iterator[bytes]) -> Iterator[bytes]:
    """The records of a plain WARC stream; one is held at a time."""
    held = b""
    for part in parts:
        held += part
        while (at := held.find(b"\r\n\r\n")) >= 0:
            stop = at + 8 + int(fields_of(held[:at])["content-length"])
            if len(held) < stop:
                break
            yield held[:stop]
            held = held[stop:]
    if held.strip():
        raise ValueError("the last record is not whole")


def records_in(f, r: dict) -> Iterator[dict]:
    """The parsed records of a range."""
    packed = r["member"].endswith(".gz")
    if not r["offsets"]:
        parts = blocks(f, r["start"], r["length"])
        yield from map(parse, through(inflated(parts, 31) if packed else parts))
        return
    data = f.read_at(r["length"], r["start"])
    for at, n in zip(r["offsets"], r["lengths"], strict=True):
        raw = data[at : at + n]
        yield parse(gzip.decompress(raw) if packed else raw)


# --- tables


def plan_records(pages: DataFrame) -> DataFrame:
    """page, url and payload of every row with its digest and, for revisits, refers.

    Payloads of MIN_SHARED bytes or more are equal if their SHA-256 is; the smallest page_id is the response. Rows that
    repeat it are responses too. A null page_id is never referred to, and is a response if there is no other.
    """
    rows = Narrow(pages, [], page=("page_id", lambda c: c), url=("url", text_of), payload=("html", text_bytes)).df.withColumn("digest", F.sha2("payload", 256))
    long = rows.where(F.octet_length("payload") >= MIN_SHARED).select("page", "digest")
    shared = staged(long.groupBy("digest").agg(F.min("page").alias("refers"), F.count("*").alias("n")).where("n > 1").drop("n"), "shared")
    # only rows that refer to another are joined by digest, without their payload; payloads meet them by page and digest
    revisits = staged(long.join(shared, "digest").where("page > refers or (page is null and refers is not null)").distinct(), "revisits")
    discard(shared)
    r = revisits.select(F.col("page").alias("p"), F.col("digest").alias("d"), "refers")
    joined = rows.join(r, F.col("page").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left")
    return joined.select(F.col("page").cast("string").alias("page"), "url", "payload", "digest", F.col("refers").cast("string").alias("refers"))


def write_packages(records: DataFrame, folder: str, *, package_bytes: int = PACKAGE_BYTES, zip64: bool = False) -> DataFrame:
    """Write records (page, url, payload, digest, refers) to packages in folder; (path, records) of those that count.

    Each attempt of a task writes files of its own names, and only the paths that finished tasks returned are in the
    table, so a repeated task leaves a stray file at worst.
    """
    store, root = open_store(folder)
    store.create_dir(root, recursive=True)
    schema = pa.schema([("path", pa.string()), ("records", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        now = Package(zip64)

        def close() -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.wacz"
            with store.open_output_stream(f"{root}/{name}") as f:
                for part in now.parts():
                    f.write(part)
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": [len(now.lines)]}, schema=schema)

        for batch in batches:
            for k in range(batch.num_rows):
                page, url, payload, digest, refers = (c[k].as_py() for c in batch.columns)
                url = " ".join(url.split())
                now.add(url, digest, record(page, url, payload, digest, refers))
                if len(now.data) >= package_bytes:
                    yield close()
                    now = Package(zip64)
        if now.lines:
            yield close()

    return staged(records.mapInArrow(run, "path string, records bigint"), "packages")


def _spread(spark: SparkSession, least: int, most: int) -> int:
    """A number of partitions: least, but enough for all cores, and no more than most. As a number it is not merged."""
    return max(1, min(most, max(least, 2 * spark.sparkContext.defaultParallelism)))


def read_packages(packages: DataFrame, *, payloads: bool = False, read_bytes: int = READ_BYTES) -> DataFrame:
    """Every record of the packages (path: by any URI that pyarrow opens), with path, member and payload if payloads.

    First the directories and indexes are read, a few packages a task; what to fetch is a table of ranges, and these are
    dealt evenly, so that a large package is read by many tasks. A package without archive members gives no row.
    """
    spark = packages.sparkSession
    fields = [f.split(" ")[0] for f in _RECORD.split(", ")] + ["payload"] * payloads

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("member", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("offsets", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64()))])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, at = open_store(path)
                with store.open_input_file(at) as f:
                    held = []
                    for r in ranges(f, f.size(), read_bytes):
                        held.append(r | {"path": path})
                        if len(held) == 64:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held = []
                    yield pa.RecordBatch.from_pylist(held, schema)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = dict.fromkeys(["path", "member", *fields], pa.string()) | {"payload_bytes": pa.int64()} | ({"payload": pa.binary()} if payloads else {})
        schema = pa.schema([*text.items()])
        for batch in batches:
            for r in batch.to_pylist():
                store, at = open_store(r["path"])
                with store.open_input_file(at) as f:
                    held, size = [], 0
                    for x in records_in(f, r):
                        held.append(x | {"path": r["path"], "member": r["member"]})
                        size += len(x["payload"] or b"") if payloads else 0
                        if len(held) == 1024 or size > READ_BYTES:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
                    yield pa.RecordBatch.from_pylist(held, schema)

    n = packages.count()
    found = packages.select("path").repartitionByRange(_spread(spark, n // TASK_PACKAGES, n), "path").mapInArrow(plan, "path string, member string, start bigint, length bigint, offsets array<bigint>, lengths array<bigint>")
    found = staged(found, "ranges")
    total = found.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first()
    dealt = found.repartitionByRange(_spread(spark, total["bytes"] // TASK_BYTES, total["n"]), "path", "start")
    return dealt.mapInArrow(fetch, f"path string, member string, {_RECORD}" + ", payload binary" * payloads)


def archive_pages(pages: DataFrame, *, package_bytes: int = PACKAGE_BYTES, zip64: bool = False) -> DataFrame:
    """Write a record of each row of pages to packages in the shared folder, and read them back.

    page_id may be of any type that survives a cast to text and back; null stays null. A null html is an empty payload, a
    null url an empty one; repeated rows give repeated records; an empty table gives no package. Columns other than
    page_id, url and html are not looked at, whatever their names.
    """
    written = write_packages(plan_records(pages), shared_path(pages.sparkSession, "warc"), package_bytes=package_bytes, zip64=zip64)
    kind = Narrow(pages, [], page=("page_id", lambda c: c)).df.dtypes[0][1]

    def page(c: str):
        return F.when(F.startswith(F.col(c), F.lit("<urn:page:")), F.url_decode(F.regexp_extract(c, "^<urn:page:(.*)>$", 1))).cast(kind)

    return read_packages(written).select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


def op4_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages"))


OP4_SQL = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to FROM m
"""
