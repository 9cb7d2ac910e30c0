"""Byte-level BPE encoding and decoding over Arrow batches.

Texts become ids by the tokenizers library with the ranks of a vocabulary file; ids become bytes by the reversed byte
table, so characters that are split between tokens come back whole. Offsets in bytes and characters follow from the
tokens' lengths.

Defined results: a null or empty text has no ids; texts that contain the strings of special tokens are ordinary text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_bytes, views
from .tokens import byte_encoder, token_bytes

BATCH_BYTES = 2_000_000


def encode_chunks(path: str, pattern: str, batch: pa.RecordBatch) -> Iterator[tuple[list, list[bytes], list[bytes]]]:
    """doc_ids, texts and little-endian 32-bit ids, some MB of text at a time."""
    encoder, part, ids, size = byte_encoder(path, pattern), [], [], 0
    names = batch.column("doc_id").to_pylist()
    for k, v in enumerate(views(batch.column("body"))):
        part.append(bytes(v))
        ids.append(names[k])
        size += len(v)
        if size > BATCH_BYTES:
            yield ids, part, encoder.encode([p.decode("utf-8", "replace") for p in part])
            part, ids, size = [], [], 0
    if part:
        yield ids, part, encoder.encode([p.decode("utf-8", "replace") for p in part])


def decode(ids: bytes, table: list[bytes]) -> bytes:
    return b"".join(map(table.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def offsets(ids: bytes, table: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Where each token starts: in bytes, and in characters (that of a split character's first byte for its later parts)."""
    lens = np.array([len(table[i]) for i in np.frombuffer(ids, dtype="<u4").tolist()], dtype=np.int64)
    starts = np.cumsum(lens) - lens
    data = np.frombuffer(decode(ids, table), dtype=np.uint8)
    number = np.cumsum((data & 0xC0) != 0x80) - 1  # of the character that each byte belongs to
    return starts, number[starts] if len(starts) else starts


def encode_documents(docs: DataFrame, path: str, pattern: str, with_offsets: bool = False) -> DataFrame:
    """doc_id, ids array<int>, and on request byte_starts and char_starts array<long>."""
    kind = "doc_id long, ids array<int>" + (", byte_starts array<long>, char_starts array<long>" if with_offsets else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(path)
        for batch in batches:
            for names, _, coded in encode_chunks(path, pattern, batch):
                columns = {"doc_id": pa.array(names, pa.int64()), "ids": pa.array([np.frombuffer(c, "<u4").astype(np.int32) for c in coded], pa.list_(pa.int32()))}
                if with_offsets:
                    both = [offsets(c, table) for c in coded]
                    columns |= {n: pa.array([b[k] for b in both], pa.list_(pa.int64())) for k, n in enumerate(("byte_starts", "char_starts"))}
                yield pa.RecordBatch.from_pydict(columns)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("body")).mapInArrow(run, kind)


def decode_documents(coded: DataFrame, path: str) -> DataFrame:
    """doc_id and the text of an ids column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(path)
        for batch in batches:
            texts = [b"".join(map(table.__getitem__, ids or [])).decode("utf-8", "replace") for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").cast(pa.int64()), "text": pa.array(texts, pa.string())})

    return coded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def digest_round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each text encoded, and its ids decoded, in the same pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(path)
        for batch in batches:
            for names, _, coded in encode_chunks(path, pattern, batch):
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(names, pa.int64()), "n_tokens": pa.array([len(c) // 4 for c in coded], pa.int64()),
                        "ids_sha256": [hashlib.sha256(c).hexdigest() for c in coded], "decoded_sha256": [hashlib.sha256(decode(c, table)).hexdigest() for c in coded],
                    }
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("body")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
