"""WARC records in ZIP-packaged archives: ``archive/data.warc.gz`` and ``indexes/index.cdxj`` as stored members.

Every record is a gzip member of its own, so a reader parses the central directory (with ZIP64 fields), finds the
stored members, reads the index and then ranges of records, without extracting anything.

Defined results: a null payload is empty; null or odd urls are written percent-encoded; repeated ids are records of
their own; an empty table makes no archive.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, file_system, text_bytes, views

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
MIN_REVISIT = 1000
#: An archive is closed beyond so many bytes.
ROLL_OVER = 256 << 20
#: Neighbouring records are read in ranges of about so many bytes.
READ_RANGE = 4 << 20
SALTS = 8
_DATE = "2024-01-01T00:00:00Z"


def record_types(pages: DataFrame, min_bytes: int = MIN_REVISIT, salts: int = SALTS) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, refers_to (null for responses).

    Of equal payloads of at least ``min_bytes``, the one with the largest id is the response. Payloads are shuffled
    once; the groups' winners are few and small, and each is copied ``salts`` times, so that a large group is spread.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_bytes("html").alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")})
    groups = rows.filter(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.max("page_id").alias("winner"), F.count("*").alias("n"))
    winners = cut(groups.filter("n > 1").select("payload_digest", "winner"))
    spread = winners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(salts)).cast("int"))
    joined = salted.join(spread, ["payload_digest", "salt"], "left").drop("salt")
    other = F.col("winner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("winner"))
    return joined.withColumn("refers_to", F.when(other, F.col("winner"))).drop("winner")


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One uncompressed WARC/1.1 record; a revisit has the HTTP header of its payload, but no payload."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = "none" if page_id is None else str(page_id)
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}", f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Fields of an uncompressed record: type, page_id, refers_to, payload_bytes, payload_digest, payload (None for revisits)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length"))
    number = lambda x: None if x in (None, "none") else int(x)
    urn = lambda k: number(fields[k].strip("<>").rsplit(":", 1)[1]) if k in fields else None
    out = {"record_type": fields["WARC-Type"], "page_id": urn("WARC-Record-ID"), "refers_to": urn("WARC-Refers-To"), "url": fields["WARC-Target-URI"], "payload": None}
    if out["record_type"] == "revisit":
        return out | {"payload_bytes": length, "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:")}
    return out | {"payload": payload, "payload_bytes": len(payload), "payload_digest": hashlib.sha1(payload).hexdigest()}


class ArchiveWriter:
    """One archive, written front to back under a name of its own and then moved to its place."""

    def __init__(self, folder: str):
        self.fs, base = file_system(folder)
        self.path = f"{base}/archive-{TaskContext.get().partitionId() if TaskContext.get() else 0:06d}-{uuid.uuid4().hex}.zip"
        self.out = self.fs.open_output_stream(self.path + ".part")
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.index: list[str] = []
        self.at = 0

    def add(self, page_id, raw: bytes) -> None:
        packed = gzip.compress(raw, 5, mtime=0)
        self.data.write(packed)
        self.index.append(json.dumps({"id": page_id, "offset": self.at, "length": len(packed)}))
        self.at += len(packed)

    def close(self) -> tuple[str, int, int]:
        self.data.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "\n".join(self.index))
        self.zip.close()
        self.out.close()
        self.fs.move(self.path + ".part", self.path)
        return self.path, len(self.index), self.at


MANIFEST = "path string, records long, data_bytes long"


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, done = None, []
        for batch in batches:
            plain = [batch.column(n).to_pylist() for n in ("page_id", "url", "payload_digest", "refers_to")]
            for page, url, digest, refers, payload in zip(*plain, views(batch.column("payload")), strict=True):  # a page's bytes at a time
                writer = writer or ArchiveWriter(folder)
                writer.add(page, warc_record(page, url, bytes(payload), digest, refers))
                if writer.at > ROLL_OVER:
                    done.append(writer.close())
                    writer = None
        if writer:
            done.append(writer.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["path", "records", "data_bytes"])

    return run


def write_archives(records: DataFrame, folder: str) -> list[tuple[str, int, int]]:
    """Write the rows of record_types; the manifest (one row per archive) comes back to the driver."""
    fs, path = file_system(folder)
    fs.create_dir(path, recursive=True)
    return [tuple(r) for r in records.select("page_id", "url", "payload", "payload_digest", "refers_to").mapInArrow(_write(folder), MANIFEST).collect()]


def members(source, size: int) -> dict[str, tuple[int, int]]:
    """Offset and length of the stored members' bytes, from the central directory. ``source``: has read_at(n, offset)."""
    tail_at = max(0, size - 65_557)
    tail = source.read_at(size - tail_at, tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack("<HII", tail[end + 10 : end + 20])
    if count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF or tail[end - 20 : end - 16] == b"PK\x06\x07":
        where = struct.unpack("<Q", tail[end - 12 : end - 4])[0]
        record = source.read_at(56, where)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        count, length, start = struct.unpack("<QQQ", record[32:56])
    directory, at, out = source.read_at(length, start), 0, {}
    for _ in range(count):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("bad central directory")
        method, packed, plain, n_name, n_extra, n_note, local = struct.unpack("<10xH8xIIHHH8xI", directory[at : at + 46])
        name, extra = directory[at + 46 : at + 46 + n_name].decode(), directory[at + 46 + n_name : at + 46 + n_name + n_extra]
        while len(extra) >= 4:
            kind, n = struct.unpack("<HH", extra[:4])
            if kind == 1:  # ZIP64: the fields that don't fit above, in this order
                wide = list(struct.unpack(f"<{n // 8}Q", extra[4 : 4 + n // 8 * 8]))
                plain = wide.pop(0) if plain == 0xFFFFFFFF else plain
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                local = wide.pop(0) if local == 0xFFFFFFFF else local
            extra = extra[4 + n :]
        if method == 0:
            head = source.read_at(30, local)
            a, b = struct.unpack("<HH", head[26:30])
            out[name] = (local + 30 + a + b, packed)
        at += 46 + n_name + n_extra + n_note
    return out


def read_archive(path: str, read_range: int = READ_RANGE) -> Iterator[dict]:
    """All records, by the index and in ranges."""
    fs, plain = file_system(path) if "://" in path or path.startswith("file:") else file_system(f"file://{path}")
    size = fs.get_file_info(plain).size
    with fs.open_input_file(plain) as source:
        at = members(source, size)
        base, _ = at[DATA]
        entries = [json.loads(x) for x in source.read_at(at[INDEX][1], at[INDEX][0]).decode().split("\n") if x]
        k = 0
        while k < len(entries):
            first, last = k, k
            while last + 1 < len(entries) and entries[last + 1]["offset"] + entries[last + 1]["length"] - entries[first]["offset"] <= read_range:
                last += 1
            lo = entries[first]["offset"]
            data = source.read_at(entries[last]["offset"] + entries[last]["length"] - lo, base + lo)
            for e in entries[first : last + 1]:
                yield parse_record(zlib.decompress(data[e["offset"] - lo : e["offset"] - lo + e["length"]], 31))
            k = last + 1


RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _read(with_payload: bool):
    kinds = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    kinds += [("url", pa.string()), ("payload", pa.binary())] if with_payload else []
    schema = pa.schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, size = [], 0
                for r in read_archive(path):
                    rows.append({k: r[k] for k in schema.names})
                    size += 100 + (r["payload_bytes"] if with_payload else 0)
                    if size > 4_000_000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def read_archives(spark: SparkSession, manifest: list[tuple[str, int, int]], with_payload: bool = False) -> DataFrame:
    """The records of the archives of a manifest, an archive to a task."""
    kind = RECORDS + (", url string, payload binary" if with_payload else "")
    if not manifest:
        return spark.createDataFrame([], kind)
    paths = spark.createDataFrame([(p,) for p, _, _ in manifest], "path string").repartition(len(manifest))
    return paths.mapInArrow(_read(with_payload), kind)
