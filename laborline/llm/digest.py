"""Quartile bucket digest of a text, in the manner of locality-sensitive digests with bucket quartiles.

Every window of four bytes gives three triplets (1st, 2nd and 3rd; 1st, 2nd and 4th; 1st, 3rd and 4th byte), each hashed
to one of 128 buckets and counted. A digest holds two bits per bucket (which quartile its count lies in), the
logarithmic length and the ratios of the quartiles. Two digests are compared by a difference score with an upper bound.

Defined results: a null text counts as empty; texts under four bytes have empty buckets, and differ by length only;
quartiles of tied counts are equal; rows that repeat an id are documents of their own, next to one another in the order of
a hash of their texts; null ids come last; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets_for, text_bytes, views, with_buckets

BUCKETS = 128
#: Difference at and beyond which two digests count as unlike.
BOUND = 256
STEP = 1 << 20
_MUL = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], dtype=np.uint32)
_TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3))


def bucket_counts(texts: list[bytes]) -> np.ndarray:
    """Triplet counts, a row of BUCKETS for each text. Works in steps of STEP bytes, so that memory stays bounded."""
    lens = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(lens)
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    out = np.zeros((len(texts), BUCKETS), dtype=np.int64)
    for lo in range(0, max(0, len(data) - 3), STEP):
        hi = min(lo + STEP, len(data) - 3)
        first, last = np.searchsorted(ends, lo, side="right"), np.searchsorted(ends, hi - 1, side="right")
        edge = np.concatenate(([lo], ends[first:last], [hi]))
        row = np.repeat(np.arange(last - first + 1), np.diff(edge))
        good = np.arange(lo, hi) + 3 < ends[first : last + 1][row]
        piece = data[lo : hi + 3].astype(np.uint32)
        row = row[good] * BUCKETS
        for k, t in enumerate(_TRIPLETS):
            h = sum((piece[j : j + hi - lo] * _MUL[i] for i, j in enumerate(t)), np.uint32(0x27D4EB2F * (k + 1) & 0xFFFFFFFF))
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            idx = row + (h >> np.uint32(25)).astype(np.int64)[good]
            out[first : last + 1] += np.bincount(idx, minlength=(last - first + 1) * BUCKETS).reshape(-1, BUCKETS)
    return out


def digests(texts: list[bytes]) -> list[str]:
    """Hexadecimal: length (2), quartile ratios (2), bucket quartiles (64)."""
    if not texts:
        return []
    counts = bucket_counts(texts)
    q = np.sort(counts, axis=1)[:, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, BUCKETS * 3 // 4 - 1]]
    code = (counts[:, :, None] > q[:, None, :]).sum(axis=2).astype(np.uint8)
    packed = code[:, 0::4] << 6 | code[:, 1::4] << 4 | code[:, 2::4] << 2 | code[:, 3::4]
    top = np.maximum(q[:, 2], 1)
    ratio = (q[:, 0] * 15 // top) << 4 | (q[:, 1] * 15 // top)
    return [f"{min(255, int(12 * math.log2(1 + len(t)))):02x}{int(r):02x}{p.tobytes().hex()}" for t, r, p in zip(texts, ratio, packed, strict=True)]


_PAIR = np.array([[sum((0, 1, 2, 6)[abs((a >> s & 3) - (b >> s & 3))] for s in (0, 2, 4, 6)) for b in range(256)] for a in range(256)], dtype=np.int32)


def difference(a: str, b: str) -> int:
    """0 for equal digests, at most BOUND: buckets a quartile apart cost 1, two 2, three 6; lengths and ratios cost up to 24 and 12."""
    x, y = bytes.fromhex(a), bytes.fromhex(b)
    body = int(_PAIR[np.frombuffer(x, np.uint8, offset=2), np.frombuffer(y, np.uint8, offset=2)].sum())
    ratio = min(12, abs((x[1] >> 4) - (y[1] >> 4)) + abs((x[1] & 15) - (y[1] & 15)))
    return min(BOUND, body + min(24, abs(x[0] - y[0])) + ratio)


def likeness(a: str, b: str) -> float:
    return 1.0 - difference(a, b) / BOUND


OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
CHUNK_CHARS = 4_000_000


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a bucket in descending order, then a copy of the row that follows the bucket's last. One row is held back."""
    held: tuple | None = None  # bucket, copy, doc_id, text
    for batch in batches:
        rows = zip(batch.column("bucket_no").to_pylist(), batch.column("copy").to_pylist(), batch.column("doc_id").to_pylist(), (bytes(v) for v in views(batch.column("body"))), strict=True)
        chunk, size = [held] if held else [], 0
        for row in rows:
            chunk.append(row)
            size += len(row[3])
            if size > CHUNK_CHARS:
                yield _pairs(chunk)
                chunk, size = [chunk[-1]], 0
        if len(chunk) > 1:
            yield _pairs(chunk)
        held = chunk[-1] if chunk else None


def _pairs(rows: list[tuple]) -> pa.RecordBatch:
    """Each row but the last with the one after it."""
    texts = [r[3].decode("utf-8", "replace") for r in rows]
    prints = digests([r[3] for r in rows])
    pairs = [(i, i + 1) for i in range(len(rows) - 1) if not rows[i][1] and rows[i][0] == rows[i + 1][0]]
    edited = []
    for i, j in pairs:
        half = len(texts[i]) // 2
        edited.append((texts[i][: len(texts[i]) - half] + texts[j][:half]).encode())
    ed = digests(edited)
    return pa.RecordBatch.from_pydict(
        {
            "doc_id": [rows[i][2] for i, _ in pairs], "n_chars": [len(texts[i]) for i, _ in pairs], "edited_sha256": [hashlib.sha256(e).hexdigest() for e in edited],
            "fingerprint": [prints[i] for i, _ in pairs], "edited_fingerprint": ed,
            "near_edited": [likeness(prints[i], e) for (i, _), e in zip(pairs, ed, strict=True)], "near_next": [likeness(prints[i], prints[j]) for i, j in pairs],
        }, schema=OUT,
    )


def fingerprint_udf():
    """An Arrow UDF from a binary column to its digest."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("string")
    def digest(column: pa.Array) -> pa.Array:
        out, part, size = [], [], 0
        for v in views(column):
            part.append(bytes(v))
            size += len(v)
            if size > CHUNK_CHARS:
                out += digests(part)
                part, size = [], 0
        return pa.array(out + digests(part), pa.string())

    return digest


def with_next(docs: DataFrame, n: int | None = None) -> DataFrame:
    """Digests of each text, of its edited text and of the next text, by descending doc_id (nulls last; after the last the first).

    Texts are shuffled once, into range buckets; of each bucket the first row (by ids only, at most ``n`` of them) also
    goes to the bucket before it. Rows of one id are ordered by a hash of the text.
    """
    spark = docs.sparkSession
    n = n or buckets_for(docs)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("body"))
    rows = with_buckets(base, "doc_id", n)
    heads = rows.groupBy("bucket_no").agg(F.max("doc_id").alias("doc_id")).orderBy(F.desc("bucket_no")).collect()
    if not heads:
        return spark.createDataFrame([], "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    order = [h["bucket_no"] for h in heads]
    to = {h["doc_id"]: order[k - 1] for k, h in enumerate(heads)}  # the first follows the last
    small = spark.createDataFrame([(i, b) for i, b in to.items()], "head long, to_bucket int")
    tagged = rows.join(F.broadcast(small), F.col("doc_id").eqNullSafe(F.col("head")), "left")
    own = F.struct(F.col("bucket_no"), F.lit(0).alias("copy"))
    both = F.when(F.col("to_bucket").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("to_bucket").alias("bucket_no"), F.lit(1).alias("copy"))))
    dealt = tagged.select("doc_id", "body", F.explode(both).alias("at")).select("at.bucket_no", "at.copy", "doc_id", "body")
    ordered = dealt.repartitionById(n + 1, F.col("bucket_no") + 1).sortWithinPartitions("bucket_no", "copy", F.desc_nulls_last("doc_id"), F.xxhash64("body"))
    return ordered.mapInArrow(_compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
