"""ZIP-packaged web archives: WARC records in stored, per-record gzip members, with an index.

A package is a ZIP file of stored members: ``archive/data-N.warc.gz`` (records, each a gzip
member of its own), ``indexes/index-N.cdxj`` (a line a record: where it lies in which archive)
and ``datapackage.json``. Readers parse the central directory (and its ZIP64 form), find the
stored members, and read records by byte range; nothing is extracted.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import zlib
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.blobs import Ranges, list_blobs, write_blobs

#: Bytes after which an archive member ends, and of one ranged read.
MEMBER_BYTES, RANGE_BYTES = 4 << 20, 4 << 20
#: Bytes of packages that a reading task is meant to have.
TASK_BYTES = 16 << 20
#: Payloads of so many bytes are stored once; others that equal one refer to it.
REVISIT_BYTES = 1000
DATE = "2020-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BIG = 0xFFFFFFFF


class ZipWriter:
    """Makes the parts of a ZIP file of stored members; a newline follows each part, which
    between members is slack and at the end is the archive's comment."""

    def __init__(self, big: int = _BIG, many: int = 0xFFFF):
        self.at, self.entries, self.big, self.many = 0, [], big, many

    def member(self, name: str, data: bytes) -> bytes:
        crc, raw = zlib.crc32(data), name.encode()
        wide = len(data) >= self.big
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if wide else b""
        n = _BIG if wide else len(data)
        self.entries.append((raw, crc, len(data), self.at))
        out = struct.pack("<IHHHHHIIIHH", 0x04034B50, 45 if wide else 20, 0x800, 0, 0, 0x21, crc, n, n, len(raw), len(extra)) + raw + extra + data
        self.at += len(out) + 1
        return out

    def end(self) -> bytes:
        out = b""
        for raw, crc, n, at in self.entries:
            wide = [x for x in (n, n, at) if x >= self.big]
            extra = struct.pack(f"<HH{len(wide)}Q", 1, 8 * len(wide), *wide) if wide else b""
            m, o = (_BIG if n >= self.big else n), (_BIG if at >= self.big else at)
            out += struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45 if wide else 20, 0x800, 0, 0, 0x21, crc, m, m, len(raw), len(extra), 0, 0, 0, 0, o) + raw + extra
        n, size, at = len(self.entries), len(out), self.at
        if n >= self.many or size >= self.big or at >= self.big:
            out += struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, n, n, size, at)
            out += struct.pack("<IIQI", 0x07064B50, 0, at + size, 1)
            n, size, at = 0xFFFF, _BIG, _BIG
        return out + struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, n, n, size, at, 1)


def zip_directory(file: Ranges) -> list[dict]:
    """name, method, size, crc and at (of the local header) of each member."""
    tail_at = max(0, file.size - 65557)
    tail = file.read(tail_at, file.size - tail_at)
    k = len(tail)
    while True:
        k = tail.rfind(b"PK\x05\x06", 0, k + 3)
        if k < 0:
            raise ValueError("no end of central directory")
        if k + 22 <= len(tail) and k + 22 + struct.unpack_from("<H", tail, k + 20)[0] == len(tail):
            break
    n, size, at = struct.unpack_from("<HII", tail, k + 10)
    if n == 0xFFFF or size == _BIG or at == _BIG:
        where = tail_at + k - 20
        if where >= 0 and (x := file.read(where, 20))[:4] == b"PK\x06\x07":
            head = file.read(struct.unpack_from("<Q", x, 8)[0], 56)
            if head[:4] != b"PK\x06\x06":
                raise ValueError("the ZIP64 directory is damaged")
            n, size, at = struct.unpack_from("<QQQ", head, 32)
    raw, p, out = file.read(at, size), 0, []
    for _ in range(n):
        sig, _, _, _, method, _, _, crc, csize, usize, ln, le, lc, _, _, _, off = struct.unpack_from("<IHHHHHHIIIHHHHHII", raw, p)
        if sig != 0x02014B50:
            raise ValueError("the central directory is damaged")
        name, extra = raw[p + 46 : p + 46 + ln].decode("utf-8", "replace"), raw[p + 46 + ln : p + 46 + ln + le]
        e = 0
        while e + 4 <= len(extra):
            kind, size_e = struct.unpack_from("<HH", extra, e)
            if kind == 1:
                wide = iter(struct.unpack_from(f"<{size_e // 8}Q", extra, e + 4))
                usize = next(wide) if usize == _BIG else usize
                csize = next(wide) if csize == _BIG else csize
                off = next(wide) if off == _BIG else off
            e += 4 + size_e
        out.append({"name": name, "method": method, "crc": crc, "size": csize, "at": off})
        p += 46 + ln + le + lc
    return out


def member_start(file: Ranges, entry: dict) -> int:
    """Where a stored member's bytes begin."""
    head = file.read(entry["at"], 30)
    if head[:4] != b"PK\x03\x04" or entry["method"] != 0:
        raise ValueError(f"{entry['name']} is not a stored member")
    return entry["at"] + 30 + sum(struct.unpack_from("<HH", head, 26))


def record(kind: str, record_id: str, url: str, sha1: bytes, payload_bytes: int, payload: bytes, refers_to: str | None) -> bytes:
    """One WARC record; a revisit holds the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1).decode()}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """record_type, record_id, url, refers_to, payload, payload_bytes and payload_digest (hex)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    h = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(h["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    told = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("latin-1").split("\r\n")[1:])}
    digest = base64.b32decode(h["warc-payload-digest"].removeprefix("sha1:")).hex()
    kind = h["warc-type"]
    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"{h['warc-record-id']}: the payload is damaged")
    strip = lambda x: x and x.strip("<>")
    return {"record_type": kind, "record_id": strip(h["warc-record-id"]), "url": h.get("warc-target-uri"), "refers_to": strip(h.get("warc-refers-to")), "payload": None if kind == "revisit" else payload, "payload_bytes": int(told["content-length"]) if kind == "revisit" else len(payload), "payload_digest": digest}


def page_uri(page_id) -> str:
    return f"urn:x-page:{'null' if page_id is None else page_id}"


def _surt(url: str) -> str:
    try:
        x = urlsplit(url)
        return ",".join(reversed((x.hostname or "").split("."))) + ")" + quote(x.path or "/", safe="/%")
    except ValueError:
        return ")/"


def with_types(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, html, payload_bytes, sha1, record_type and refers_to of each page.

    Of equal payloads of ``least`` bytes or more, the page of largest page_id (each row, if it
    is repeated) is the response; a null page_id is never that if another has one.
    """
    d = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    d = d.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("sha1", F.unhex(F.sha1(F.encode("html", "UTF-8"))))
    heads = d.filter(F.col("payload_bytes") >= least).groupBy("sha1", "payload_bytes").agg(F.max("page_id").alias("head"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    d = d.join(heads, ["sha1", "payload_bytes"], "left")
    later = F.col("head").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("head")))
    d = d.withColumn("record_type", F.when(later, "revisit").otherwise("response")).withColumn("refers_to", F.when(later, F.col("head")))
    return d.select("page_id", "url", "html", "payload_bytes", "sha1", "record_type", "refers_to")


def write_packages(typed: DataFrame, path: str, member_bytes: int = MEMBER_BYTES, big: int = _BIG, many: int = 0xFFFF) -> None:
    """Write one package a partition of what with_types gives."""

    def run(batches):
        blob = lambda x: pa.RecordBatch.from_arrays([pa.array([x], pa.binary())], names=["blob"])
        zipped, held, lines, size, n, listed = ZipWriter(big, many), [], [], 0, 0, []

        def flush():
            nonlocal held, lines, size, n
            for name, data in ((f"archive/data-{n}.warc.gz", b"".join(held)), (f"indexes/index-{n}.cdxj", "".join(sorted(lines)).encode())):
                listed.append({"name": name.split("/")[1], "path": name, "hash": "sha256:" + hashlib.sha256(data).hexdigest(), "bytes": len(data)})
                yield blob(zipped.member(name, data))
            held, lines, size, n = [], [], 0, n + 1

        for batch in batches:
            for page_id, url, html, total, sha1, kind, head in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                uri = quote(url, safe=":/?#[]@!$&'()*+,;=%-._~") if url else page_uri(page_id)
                raw = record(kind, page_uri(page_id), uri, sha1, total, html.encode(), None if head is None else page_uri(head))
                packed = zlib.compress(raw, 1, 31)
                told = {"url": uri, "digest": "sha1:" + base64.b32encode(sha1).decode(), "offset": size, "length": len(packed), "filename": f"data-{n}.warc.gz"}
                lines.append(f"{_surt(uri)} {DATE.translate({45: None, 58: None, 84: None, 90: None})} {json.dumps(told)}\n")
                held.append(packed)
                size += len(packed)
                if size >= member_bytes:
                    yield from flush()
        if held:
            yield from flush()
        if n:
            yield blob(zipped.member("datapackage.json", json.dumps({"profile": "data-package", "resources": listed}).encode()))
            yield blob(zipped.end())

    write_blobs(typed.mapInArrow(run, "blob binary"), path)


def record_ranges(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """path, start, length and cuts of byte ranges that hold whole records: neighbours in one
    archive member are read at once up to ``range_bytes``."""

    def run(batches):
        for batch in batches:
            rows = []
            for address in batch.column(0).to_pylist():
                file = Ranges(address)
                entries = {x["name"]: x for x in zip_directory(file)}
                for name, x in entries.items():
                    if not name.startswith("indexes/"):
                        continue
                    text = file.read(member_start(file, x), x["size"])
                    if zlib.crc32(text) != x["crc"]:
                        raise ValueError(f"{address}: {name} is damaged")
                    told = sorted((y["filename"], int(y["offset"]), int(y["length"])) for y in (json.loads(line.split(b" ", 2)[2]) for line in text.splitlines()))
                    begin: dict[str, int] = {}
                    open_at, cuts, last = None, [], None
                    for archive, off, n in told:
                        if archive not in begin:
                            begin[archive] = member_start(file, entries["archive/" + archive])
                        at = begin[archive] + off
                        if open_at is not None and (last != (archive, at) or at + n - open_at > range_bytes):
                            rows.append((address, open_at, cuts))
                            open_at, cuts = None, []
                        open_at = at if open_at is None else open_at
                        cuts.append(n)
                        last = (archive, at + n)
                    if open_at is not None:
                        rows.append((address, open_at, cuts))
                file.close()
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], names=["path", "start", "cuts"])

    return files.select("path").mapInArrow(run, "path string, start long, cuts array<long>")


FIELDS = "record_type string, record_id string, url string, refers_to string, payload binary, payload_bytes long, payload_digest string"


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    """The records of all packages under path; payload is null for a revisit, while
    payload_bytes and payload_digest are of the full payload."""
    files = list_blobs(spark, path)
    n, total = files.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).collect()[0]
    ranges = record_ranges(files.repartitionByRange(max(1, n), "part"))

    def run(batches):
        schema = pa.schema([("record_type", pa.string()), ("record_id", pa.string()), ("url", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])
        for batch in batches:
            for address, start, cuts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                file = Ranges(address)
                raw, at, rows = file.read(start, sum(cuts)), 0, []
                file.close()
                for n in cuts:
                    rows.append(parse_record(zlib.decompress(raw[at : at + n], 31)))
                    at += n
                yield pa.RecordBatch.from_pylist(rows, schema)

    # a range's row is small, so the number of tasks comes from what the ranges hold
    return ranges.repartition(max(1, -(-total // TASK_BYTES))).mapInArrow(run, FIELDS)


def round_trip(pages: DataFrame, path: str) -> DataFrame:
    """Write a record a page under path and read the packages back: page_id, payload_bytes,
    payload_digest, record_type and refers_to of each page.

    A null html is an empty payload; a null url is replaced by the page's name; null and
    repeated page_ids each have records. An empty table gives no package and no rows.
    """
    write_packages(with_types(pages), path)
    d = read_packages(pages.sparkSession, path)
    number = lambda c: F.regexp_extract(c, r"^urn:x-page:(-?\d+)$", 1).try_cast("long")
    return d.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
