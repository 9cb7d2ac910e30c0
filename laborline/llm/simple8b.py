"""Token id files in Simple-8b words.

A word holds a selector in its top four bits and as many ids of one width as fit in the other 60. Values of more than
60 bits leave an escape word, whose 60 bits number a side table. Ids are coded in blocks of BLOCK, each of which starts a
new word; the number of words of every block is kept, so that any block can be found by its offset. A group of blocks is
coded at once, and decoded at once, selector by selector in numpy.

File: magic; groups (escapes as u64, words as u64); footer (doc_id i64; a validity byte for each; ids per document u64;
per group: first word's byte, words, escapes, ids, blocks, all u64; words per block u32); footer's byte, documents and
groups (u64); magic.

Defined results: a null text counts as empty, and has the end id only; null doc_ids come first; repeated rows are
documents of their own; an empty table makes no file.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytebpe import encode_chunks
from .common import buckets_for, file_system, text_bytes, with_buckets
from .tokens import END_ID

MAGIC = b"S8BIDS01"
#: Ids of a block, and blocks of a group.
BLOCK, GROUP = 1 << 10, 1 << 8
#: ids per word and bits per id of selectors 1 to 15; selector 0 is an escape.
SELECTORS = ((120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
_U = np.uint64
_LIMITS = np.array([1 << b for _, b in SELECTORS], dtype=np.uint64)


_END, _ESCAPE = 255, 254
_WIDTHS = np.searchsorted(_LIMITS, np.arange(1 << 16, dtype=np.uint64), side="right").astype(np.uint8)


def _widths(v: np.ndarray) -> np.ndarray:
    """How many selectors are too narrow for each value: those that come before the first that fits."""
    if v.max() < len(_WIDTHS):
        return _WIDTHS[v]
    return np.searchsorted(_LIMITS, v.astype(np.uint64), side="right").astype(np.uint8)


def _all_of(ok: np.ndarray, count: int) -> np.ndarray:
    """Where ``count`` entries in a row are true, by doubling."""
    have = 1
    while have * 2 <= count:
        ok, have = ok[:-have] & ok[have:], have * 2
    return ok if have == count else ok[: len(ok) - (count - have)] & ok[count - have :]


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, escapes, words of each block) of an array of unsigned integers. Words never hold less than their count."""
    n, lanes = len(values), -(-len(values) // BLOCK)
    if n == 0:
        return np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.uint32)
    # One row for each block, with a mark after its last id.
    v = np.zeros(lanes * BLOCK, np.uint64)
    v[:n] = values
    widths = _widths(v)
    widths[v >= _U(1 << 60)] = _ESCAPE
    widths[n:] = _END
    width = np.full((lanes, BLOCK + 1), _END, np.uint8)
    width[:, :BLOCK] = widths.reshape(-1, BLOCK)
    width = width.ravel()
    take, chosen = np.ones(len(width), np.uint8), np.full(len(width), len(SELECTORS), np.uint8)
    chosen[width == _ESCAPE] = 0
    there = np.bincount(widths, minlength=len(SELECTORS)).cumsum()
    for k in range(len(SELECTORS) - 2, -1, -1):  # from wide to narrow: a narrower one that fits takes more ids
        count = SELECTORS[k][0]
        if there[k] >= count:
            fits = _all_of(width <= k, count)
            np.putmask(take[: len(fits)], fits, count)
            np.putmask(chosen[: len(fits)], fits, k + 1)
    at, steps = np.arange(lanes) * (BLOCK + 1), []
    while len(at):  # one word of every block that isn't done yet
        steps.append(at)
        at = at + take[at]
        at = at[width[at] != _END]
    start = np.sort(np.concatenate(steps))
    sel, lane = chosen[start], start // (BLOCK + 1)
    first = start - lane  # in v, which has no marks
    words = sel.astype(np.uint64) << _U(60)
    out = np.flatnonzero(sel == 0)
    words[out] |= np.arange(len(out), dtype=np.uint64)
    for k, (count, bits) in enumerate(SELECTORS, 1):
        m = np.flatnonzero(sel == k)
        if bits and len(m):
            begin, packed = first[m], words[m]
            for j in range(count):
                packed |= v[begin + j] << _U(j * bits)
            words[m] = packed
    return words, v[first[out]], np.bincount(lane, minlength=lanes).astype(np.uint32)


def decode(words: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` values of whole blocks."""
    counts = np.array([1, *(c for c, _ in SELECTORS)], dtype=np.int64)
    sel = (words >> _U(60)).astype(np.uint8)
    ends = np.cumsum(counts[sel])
    at = ends - counts[sel]
    out = np.zeros(n, np.uint64)
    m = np.flatnonzero(sel == 0)
    if len(m):
        out[at[m]] = escapes[(words[m] & _U((1 << 60) - 1)).astype(np.int64)]
    for k, (count, bits) in enumerate(SELECTORS, 1):
        m = np.flatnonzero(sel == k)
        if bits and len(m):
            w, a, mask = words[m], at[m], _U((1 << bits) - 1)
            for j in range(count):
                out[a + j] = (w >> _U(j * bits)) & mask
    return out


class IdFileWriter:
    """Documents of one range, block by block."""

    def __init__(self, folder: str, name: str):
        self.fs, base = file_system(folder)
        self.path = f"{base}/{name}-{uuid.uuid4().hex}.s8b"
        self.out = self.fs.open_output_stream(self.path + ".part")
        self.out.write(MAGIC)
        self.at, self.waiting, self.n_waiting = len(MAGIC), [], 0
        self.docs, self.counts, self.groups, self.block_words = [], [], [], []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.counts.append(len(ids))
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= GROUP * BLOCK:
            self._flush(last=False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.empty(0, np.uint32)
        end = len(ids) if last else len(ids) // BLOCK * BLOCK
        for lo in range(0, end, GROUP * BLOCK):
            part = ids[lo : min(lo + GROUP * BLOCK, end)]
            words, escapes, block_words = encode(part)
            self.out.write(escapes.astype("<u8").tobytes() + words.astype("<u8").tobytes())
            self.groups.append((self.at + 8 * len(escapes), len(words), len(escapes), len(part), len(block_words)))
            self.block_words.append(block_words)
            self.at += 8 * (len(words) + len(escapes))
        self.waiting, self.n_waiting = [ids[end:]], len(ids) - end

    def close(self) -> tuple[str, int, int, int]:
        self._flush(last=True)
        known = np.array([d is not None for d in self.docs], np.uint8)
        names = np.array([d or 0 for d in self.docs], "<i8")
        foot = names.tobytes() + known.tobytes() + np.array(self.counts, "<u8").tobytes() + np.array(self.groups, "<u8").tobytes()
        foot += b"".join(w.astype("<u4").tobytes() for w in self.block_words)
        self.out.write(foot + struct.pack("<QQQ", self.at, len(self.docs), len(self.groups)) + MAGIC)
        self.out.close()
        self.fs.move(self.path + ".part", self.path)
        return self.path, len(self.docs), sum(self.counts), self.at


class IdFile:
    """An id file's footer, and its blocks by their offsets."""

    def __init__(self, path: str):
        fs, plain = file_system(path if "://" in path or path.startswith("file:") else f"file://{path}")
        size = fs.get_file_info(plain).size
        self.source = fs.open_input_file(plain)
        tail = self.source.read_at(32, size - 32)
        foot_at, n_docs, n_groups = struct.unpack("<QQQ", tail[:24])
        if tail[24:] != MAGIC:
            raise ValueError(f"{path}: not an id file")
        foot = self.source.read_at(size - 32 - foot_at, foot_at)
        self.names, self.known = np.frombuffer(foot, "<i8", n_docs), np.frombuffer(foot, np.uint8, n_docs, 8 * n_docs)
        self.counts = np.frombuffer(foot, "<u8", n_docs, 9 * n_docs).astype(np.int64)
        self.groups = np.frombuffer(foot, "<u8", 5 * n_groups, 17 * n_docs).reshape(-1, 5).astype(np.int64)
        self.block_words = np.frombuffer(foot, "<u4", offset=17 * n_docs + 40 * n_groups).astype(np.int64)

    def __enter__(self) -> IdFile:
        return self

    def __exit__(self, *_) -> None:
        self.source.close()

    def group(self, k: int) -> np.ndarray:
        """All ids of a group, read at once."""
        at, n_words, n_escapes, n_ids, _ = self.groups[k].tolist()
        data = np.frombuffer(self.source.read_at(8 * (n_words + n_escapes), at - 8 * n_escapes), "<u8")
        return decode(data[n_escapes:], data[:n_escapes], n_ids)

    def block(self, k: int) -> np.ndarray:
        """The ids of one block: only its words are read, and its group's escapes if it has any."""
        first = np.concatenate(([0], np.cumsum(self.groups[:, 4])))
        g = int(np.searchsorted(first, k, side="right")) - 1
        at, _, n_escapes, n_ids, n_blocks = self.groups[g].tolist()
        inside = k - int(first[g])
        before = int(self.block_words[first[g] : k].sum())
        words = np.frombuffer(self.source.read_at(8 * int(self.block_words[k]), at + 8 * before), "<u8")
        n = n_ids - BLOCK * (n_blocks - 1) if inside == n_blocks - 1 else BLOCK
        escapes = np.empty(0, np.uint64)
        if (words >> _U(60) == 0).any():
            escapes = np.frombuffer(self.source.read_at(8 * n_escapes, at - 8 * n_escapes), "<u8")
        return decode(words, escapes, n)

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document, by the blocks that hold them."""
        start = int(self.counts[:i].sum())
        end = start + int(self.counts[i])
        starts = np.concatenate(([0], np.cumsum(self.groups[:, 3])))
        first = np.concatenate(([0], np.cumsum(self.groups[:, 4])))
        out = []
        while start < end:
            g = int(np.searchsorted(starts, start, side="right")) - 1
            k = (start - int(starts[g])) // BLOCK
            ids = self.block(int(first[g]) + k)
            lo = start - int(starts[g]) - k * BLOCK
            out.append(ids[lo : lo + end - start])
            start += len(out[-1])
        return np.concatenate(out) if out else np.empty(0, np.uint64)


def read_id_file(path: str) -> Iterator[tuple[int | None, int, int]]:
    """(doc_id, number of ids, crc32 of its ids as little-endian 32-bit integers) in the file's order, a group at a time.

    The last document is also found by its blocks' offsets, which must give the same ids.
    """
    last = None
    for doc, parts in read_documents(path):
        n, crc = 0, 0
        for ids in parts:
            n, crc = n + len(ids), zlib.crc32(ids.astype("<u4").tobytes(), crc)
        last = n, crc
        yield doc, n, crc
    if last:
        with IdFile(path) as f:
            ids = f.document(len(f.counts) - 1)
        if (len(ids), zlib.crc32(ids.astype("<u4").tobytes())) != last:
            raise ValueError(f"{path}: the offsets of its blocks are wrong")


def read_documents(path: str) -> Iterator[tuple[int | None, Iterator[np.ndarray]]]:
    """Each document's id with the parts of its ids; the parts must be used before the next document is asked for."""
    with IdFile(path) as f:
        group = iter(range(len(f.groups)))
        have, used = np.empty(0, np.uint64), 0

        def parts(n: int) -> Iterator[np.ndarray]:
            nonlocal have, used
            while n:
                if used == len(have):
                    have, used = f.group(next(group)), 0
                piece = have[used : used + n]
                used, n = used + len(piece), n - len(piece)
                yield piece

        for name, there, n in zip(f.names.tolist(), f.known.tolist(), f.counts.tolist(), strict=True):
            yield (name if there else None), parts(n)


MANIFEST = "bucket_no int, path string, docs long, tokens long, data_bytes long"


def _write(folder: str, path: str, pattern: str, end_id: int):
    end = np.array([end_id], np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, bucket, done = None, None, []
        for batch in batches:
            buckets = iter(batch.column("bucket_no").to_pylist())
            for names, _, coded in encode_chunks(path, pattern, batch):
                for doc, ids in zip(names, coded, strict=True):
                    if (b := next(buckets)) != bucket:
                        if writer:
                            done.append((bucket, *writer.close()))
                        writer, bucket = IdFileWriter(folder, f"ids-{b + 1:06d}-{TaskContext.get().partitionId():06d}"), b
                    writer.add(doc, np.concatenate((np.frombuffer(ids, "<u4"), end)))
        if writer:
            done.append((bucket, *writer.close()))
        if done:
            kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=["bucket_no", "path", "docs", "tokens", "data_bytes"])

    return run


def write_ids(docs: DataFrame, folder: str, path: str, pattern: str, n: int | None = None, end_id: int = END_ID["byte"]) -> list[tuple]:
    """Files of ascending doc_id ranges; the manifest (a row per file, in that order) comes back to the driver."""
    n = n or buckets_for(docs)
    fs, at = file_system(folder)
    fs.create_dir(at, recursive=True)
    rows = with_buckets(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("body")), "doc_id", n)
    dealt = rows.repartitionById(n + 1, F.col("bucket_no") + 1).sortWithinPartitions("bucket_no", "doc_id", F.xxhash64("body"))
    return sorted(tuple(r) for r in dealt.mapInArrow(_write(folder, path, pattern, end_id), MANIFEST).collect())


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
            rows, at = [], base
            for doc, n, crc in read_id_file(path):
                rows.append((doc, at, n, crc))
                at += n
            kinds = [pa.int64()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_ids(spark: SparkSession, manifest: list[tuple]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files, a file to a task."""
    kind = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not manifest:
        return spark.createDataFrame([], kind)
    base, files = 0, []
    for _, path, _, tokens, _ in manifest:
        files.append((path, base))
        base += tokens
    return spark.createDataFrame(files, "path string, base long").repartition(len(files)).mapInArrow(_read, kind)
