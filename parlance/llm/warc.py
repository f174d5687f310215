"""WARC records in ZIP packages (operator 7): writing, and reading by ranges without extraction.

A package is a ZIP file whose members are stored, not compressed: archive/data.warc.gz holds WARC records, each a gzip
member of its own, and indexes/index.cdxj has a line for each with its offset and length. The reader looks for the end
record at the file's tail, follows it (or its ZIP64 form) to the central directory, takes the members' places from
there, and then reads one range for the index and one for each record. Files are reached through pyarrow's file
systems by URI, in the folder that all executors share.
"""

from __future__ import annotations

import hashlib
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
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import save, shared_dir, ship

DATA, INDEX, BIG, SMALL = "archive/data.warc.gz", "indexes/index.cdxj", 0xFFFFFFFF, 0xFFFF
READ = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"


# ---------------------------------------------------------------- ZIP


@dataclass
class Member:
    name: str
    method: int
    at: int  # of the local header
    size: int
    packed: int


def members(f, size: int) -> list[Member]:
    """The central directory of the ZIP file f (with read_at), of either format."""
    tail = min(size, 22 + 65_535 + 20)
    buf = bytes(f.read_at(tail, size - tail))
    at = buf.rfind(b"PK\x05\x06")
    # The same four bytes may stand in the archive's comment: only the record whose comment ends with the file counts.
    while at >= 0 and (at + 22 > tail or at + 22 + struct.unpack_from("<H", buf, at + 20)[0] != tail):
        at = buf.rfind(b"PK\x05\x06", 0, at)
    if at < 0:
        raise ValueError("not a ZIP file")
    count, length, start = struct.unpack_from("<HII", buf, at + 10)
    if at >= 20 and buf[at - 20 : at - 16] == b"PK\x06\x07":
        end = struct.unpack_from("<Q", buf, at - 12)[0]
        big = bytes(f.read_at(56, end))
        if big[:4] != b"PK\x06\x06":
            raise ValueError("the ZIP64 end record is missing")
        count, length, start = struct.unpack_from("<QQQ", big, 32)
    elif SMALL == count or BIG in (length, start):
        raise ValueError("the ZIP64 locator is missing")
    d, p, out = bytes(f.read_at(length, start)), 0, []
    for _ in range(count):
        if d[p : p + 4] != b"PK\x01\x02":
            raise ValueError("the central directory is damaged")
        method = struct.unpack_from("<H", d, p + 10)[0]
        packed, full, n, m, k = struct.unpack_from("<IIHHH", d, p + 20)
        where = struct.unpack_from("<I", d, p + 42)[0]
        name = d[p + 46 : p + 46 + n].decode()
        x, stop = p + 46 + n, p + 46 + n + m
        while x + 4 <= stop:
            tag, len_ = struct.unpack_from("<HH", d, x)
            if tag == 1:  # only the values that didn't fit, in this order
                y = x + 4
                if full == BIG:
                    full, y = struct.unpack_from("<Q", d, y)[0], y + 8
                if packed == BIG:
                    packed, y = struct.unpack_from("<Q", d, y)[0], y + 8
                if where == BIG:
                    where = struct.unpack_from("<Q", d, y)[0]
            x += 4 + len_
        out.append(Member(name, method, where, full, packed))
        p = stop + k
    return out


def begin(f, m: Member) -> int:
    """Where a stored member's bytes begin; its local header may have other extra fields than the directory."""
    if m.method:
        raise ValueError(f"{m.name} is compressed; only stored members can be read by ranges")
    head = bytes(f.read_at(30, m.at))
    if head[:4] != b"PK\x03\x04":
        raise ValueError("the local header is missing")
    n, k = struct.unpack_from("<HH", head, 26)
    return m.at + 30 + n + k


# ---------------------------------------------------------------- WARC


def record(page_id, url: str | None, payload: bytes, kind: str, digest: str, size: int, refers_to, date: str) -> bytes:
    one = lambda k: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page {k}')}>"
    heads = [("WARC-Type", kind), ("WARC-Record-ID", one(page_id)), ("WARC-Date", date), ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", size), ("X-Page-ID", "" if page_id is None else page_id)]
    if url is not None:
        heads.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if kind == "revisit":
        heads += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", one(refers_to)), ("X-Refers-To-Page", refers_to)]
    heads += [("Content-Type", "text/html"), ("Content-Length", len(payload))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in heads).encode() + b"\r\n" + payload + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    heads = dict(x.split(": ", 1) for x in lines)
    n = int(heads["Content-Length"])
    if len(rest) < n:
        raise ValueError("the record is cut off")
    return heads, rest[:n]


def gz(raw: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


# ---------------------------------------------------------------- Spark


def planned(pages: DataFrame, least: int = 100) -> DataFrame:
    """page_id, url, payload, digest, size, first: `first` is the record that an equal payload of at least `least` bytes refers to."""
    p = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload").cast("long"))
    first = p.filter(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    # Written first: a join whose sides are both plain exchanges can be split where one payload is most of the table.
    return p.join(save(first.filter("n > 1").select("digest", "first"), "first"), "digest", "left")


def write(pages: DataFrame, *, least: int = 100, date: str = "1970-01-01T00:00:00Z", folder: str | None = None) -> DataFrame:
    """Writes pages (page_id, url, html) as packages, one for each partition, and returns their list: archive, records.

    A null html is an empty payload. The record of the smallest page_id is the response, and so are further rows of that
    same page_id and rows without one; all others of the group revisit it. A task that runs again writes a new file;
    the list names only the files of tasks that counted. An empty table gives an empty list. Other columns are ignored.
    """
    spark = pages.sparkSession
    ship(spark)
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex[:12]}"
    rows = planned(pages, least).select("page_id", "url", "payload", "digest", "size", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        while first is not None and not first.num_rows:
            first = next(batches, None)
        if first is None:
            return
        store, top = fs.FileSystem.from_uri(folder)
        store.create_dir(top, recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:8]}.wacz"
        index, at = [], 0
        with store.open_output_stream(f"{top}/{name}") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            with z.open(zipfile.ZipInfo(DATA), "w", force_zip64=True) as data:
                b = first
                while b is not None:
                    for page_id, url, payload, digest, size, to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                        kind = "revisit" if to is not None and page_id is not None and page_id != to else "response"
                        raw = gz(record(page_id, url, b"" if kind == "revisit" else payload, kind, digest, size, to, date))
                        data.write(raw)
                        index.append(json.dumps({"page": page_id, "offset": at, "length": len(raw)}))
                        at += len(raw)
                    b = next(batches, None)
            with z.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as idx:
                idx.write("\n".join(index).encode())
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(index)], pa.int64())], ["archive", "records"])

    return save(rows.mapInArrow(run, "archive string, records long"), "packages")


def read(packages: DataFrame, tasks: int | None = None) -> DataFrame:
    """READ's columns of each record in the packages that `archive` names. A response's digest and size are of the bytes read; a difference from its header is an error."""
    spark = packages.sparkSession
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = READ.replace(",", "").split()[::2]
        types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        for path in (x for b in batches for x in b.column(0).to_pylist()):
            store, at = fs.FileSystem.from_uri(path)
            with store.open_input_file(at) as f:
                found = {m.name: m for m in members(f, f.size())}
                base, idx = begin(f, found[DATA]), found[INDEX]
                lines = bytes(f.read_at(idx.size, begin(f, idx))).decode().splitlines()
                for i in range(0, len(lines), 500):
                    rows = []
                    for line in map(json.loads, lines[i : i + 500]):
                        heads, body = parsed(zlib.decompress(f.read_at(line["length"], base + line["offset"]), 31))
                        kind, digest, size = heads["WARC-Type"], heads["WARC-Payload-Digest"].removeprefix("sha256:"), int(heads["X-Payload-Length"])
                        if kind == "response" and (hashlib.sha256(body).hexdigest() != digest or len(body) != size):
                            raise ValueError(f"{path}: page {heads['X-Page-ID']} differs from its digest")
                        page, to = heads["X-Page-ID"], heads.get("X-Refers-To-Page")
                        rows.append((int(page) if page else None, heads.get("WARC-Target-URI"), kind, digest, size, int(to) if to else None, body if kind == "response" else None))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    tasks = tasks or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return packages.select("archive").repartition(tasks, "archive").mapInArrow(run, READ)
