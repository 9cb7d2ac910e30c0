"""Media columns: Netpbm and BMP images to and from numpy arrays, area resizing by integral images, NPY tiles, difference hashes.

Defined results: a null text counts as empty, and makes one row of zero bytes; rows that repeat an id are images of their
own; equal neighbours count as not darker in the hash; an empty table gives no rows; extra columns are ignored; bytes that
are no image of a known kind raise ValueError in the decoders.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, scratch, text_bytes, views

WIDTH = 64
TILE = 16
HASH = 8
BATCH_BYTES = 4_000_000
#: Rows of an image that the integral image covers at a time.
BAND = 4096


def encode_pgm(image: np.ndarray) -> bytes:
    """P5 for two dimensions, P6 for three with three channels."""
    h, w = image.shape[:2]
    return b"P%d\n%d %d\n255\n" % (6 if image.ndim == 3 else 5, w, h) + np.ascontiguousarray(image, dtype=np.uint8).tobytes()


_HEAD = re.compile(rb"P([2356])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)\s")


def decode_netpbm(data: bytes) -> np.ndarray:
    """P2, P3, P5 or P6 of 8 or 16 bits."""
    m = _HEAD.match(data)
    if not m:
        raise ValueError("not a Netpbm image")
    kind, w, h, top = (int(x) for x in m.groups())
    shape = (h, w, 3) if kind in (3, 6) else (h, w)
    n = int(np.prod(shape))
    if kind in (2, 3):
        flat = np.array(data[m.end() :].split()[:n], dtype=np.uint16 if top > 255 else np.uint8)
    else:
        flat = np.frombuffer(data, dtype=">u2" if top > 255 else np.uint8, count=n, offset=m.end())
    return flat.reshape(shape)


def encode_bmp(image: np.ndarray) -> bytes:
    """8-bit grey with a palette, or 24-bit colour; rows bottom up, padded to four bytes."""
    h, w = image.shape[:2]
    colour = image.ndim == 3
    rows = image[::-1, :, ::-1].reshape(h, w * 3) if colour else image[::-1]
    stride = -(-rows.shape[1] // 4) * 4
    body = np.zeros((h, stride), dtype=np.uint8)
    body[:, : rows.shape[1]] = rows
    palette = b"" if colour else np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, axis=1).tobytes()
    start = 54 + len(palette)
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", start + body.size, 0, 0, start, 40, w, h, 1, 24 if colour else 8, 0, body.size, 2835, 2835, 0 if colour else 256, 0) + palette + body.tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed 8-bit (by its palette; grey if that is grey) or 24-bit."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP image")
    start, head, w, h = struct.unpack("<I", data[10:14])[0], *struct.unpack("<Iii", data[14:26])
    bits, how = struct.unpack("<HI", data[28:34])
    if how or bits not in (8, 24):
        raise ValueError(f"BMP of {bits} bits, compression {how}")
    stride = -(-w * bits // 32) * 4
    rows = np.frombuffer(data, np.uint8, count=stride * abs(h), offset=start).reshape(abs(h), stride)
    rows = rows if h < 0 else rows[::-1]
    if bits == 24:
        return rows[:, : w * 3].reshape(abs(h), w, 3)[:, :, ::-1]
    palette = np.frombuffer(data, np.uint8, count=start - 14 - head, offset=14 + head).reshape(-1, 4)[:, 2::-1]
    image = palette[rows[:, :w]]
    return image[:, :, 0] if (palette[:, 0] == palette[:, 1]).all() and (palette[:, 0] == palette[:, 2]).all() else image


def decode_image(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else (image.astype(np.uint32) @ np.array([299, 587, 114], dtype=np.uint32) // 1000).astype(np.uint8)


def area_resize(image: np.ndarray, h: int, w: int) -> np.ndarray:
    """Mean over each output cell's area (fractions of pixels count in part), by integral images over bands of rows."""
    H, W = image.shape
    xs, ys = np.arange(w + 1) * (W / w), np.arange(h + 1) * (H / h)

    def at(columns: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Interpolated values of running sums (axis 1) at fractional edges."""
        lo = np.minimum(edges.astype(np.int64), columns.shape[1] - 1)
        hi = np.minimum(lo + 1, columns.shape[1] - 1)
        part = edges - lo
        return columns[:, lo] * (1 - part) + columns[:, hi] * part

    total, before, k = np.zeros((h + 1, w)), np.zeros(w), 0
    for top in range(0, H, BAND):
        band = image[top : top + BAND]
        sums = np.zeros((len(band) + 1, W + 1))
        np.cumsum(np.cumsum(band, axis=0, dtype=np.float64), axis=1, out=sums[1:, 1:])
        cells = np.diff(at(sums, xs), axis=1)  # running down the band, by output column
        while k <= h and (ys[k] < top + len(band) or top + len(band) == H):
            total[k] = before + at(cells.T, np.array([ys[k] - top]))[:, 0]
            k += 1
        before = before + cells[-1]
    return np.diff(total, axis=0) / ((H / h) * (W / w))


def difference_hash(image: np.ndarray, size: int = HASH) -> str:
    """Whether each cell of a ``size`` by ``size + 1`` thumbnail is darker than its right neighbour, as hexadecimal."""
    small = np.round(area_resize(grey(image), size, size + 1), 6)  # the last digits depend on the order of the sums
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def npy_tile(image: np.ndarray, size: int = TILE) -> bytes:
    """A ``size`` by ``size`` thumbnail as the bytes of an NPY file."""
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(np.round(area_resize(grey(image), size, size), 6)), 0, 255).astype(np.uint8))
    return out.getvalue()


def payload_of(text: bytes, unit: int = 64) -> bytes:
    return text + bytes(max(unit, -(-len(text) // unit) * unit) - len(text))


def _chunks(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, list[bytes]]]:
    part, size, first = [], 0, 0
    for v in views(batch.column(column)):
        part.append(bytes(v))
        size += len(v)
        if size > BATCH_BYTES:
            yield first, part
            first, part, size = first + len(part), [], 0
    if part:
        yield first, part


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("doc_id")
        for first, part in _chunks(batch, "body"):
            media = [encode_pgm(np.frombuffer(payload_of(t), np.uint8).reshape(-1, WIDTH)) for t in part]
            yield pa.RecordBatch.from_pydict({"doc_id": ids.slice(first, len(part)), "n_bytes": pa.array([len(t) for t in part], pa.int64()), "media": pa.array(media, pa.binary())})


def write_media(docs: DataFrame, path: str) -> None:
    """Each text as a grey P5 image of WIDTH columns, in a Parquet table: doc_id, n_bytes, media."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("body"))
    rows.mapInArrow(_store, "doc_id long, n_bytes long, media binary").write.option("compression", "zstd").parquet(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, part in _chunks(batch, "media"):
            rows: dict[str, list] = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile")}
            for data in part:
                image = decode_image(data)
                payload = image.tobytes()
                for k, v in zip(rows, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), difference_hash(image), npy_tile(image)), strict=True):
                    rows[k].append(v)
            out = {n: batch.column(n).slice(first, len(part)) for n in ("doc_id", "n_bytes")} | rows
            yield pa.RecordBatch.from_pydict(out)


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile binary"


def read_media(table: DataFrame) -> DataFrame:
    """Checksums of what is read back, with the difference hash (feature) and the NPY tile of each image."""
    return table.select("doc_id", "n_bytes", "media").mapInArrow(_read, FEATURES)


def media_round_trip(docs: DataFrame) -> DataFrame:
    """``read_media`` of the texts written as images, its tiles written as NPY bytes and read back: tile_sha256 is of those."""
    spark = docs.sparkSession
    path, tiles = scratch(spark, "media"), scratch(spark, "tiles")
    write_media(docs, path)
    read_media(spark.read.schema("doc_id long, n_bytes long, media binary").parquet(path)).write.option("compression", "zstd").parquet(tiles)
    discard(path)
    return spark.read.schema(FEATURES).parquet(tiles).withColumn("tile_sha256", F.sha2("tile", 256))
