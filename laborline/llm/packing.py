"""Hierarchical residual packing of token sequences.

Every partition packs its pieces best-fit (longest first), keeps the nearly full bins, and hands the others on as single
items. Rounds merge the items of several partitions into one until one partition is left. A bin is also done if the
emptiest bin of the round doesn't fit into it: no round can add to it. A partition hands on its emptiest bins, as many as
make PER_TASK items where partitions meet; after best-fit at most one of its bins is half empty or more, so the others
could only take such ones.

The partitions follow the number of pieces, so the sequences depend on it a little: each partition leaves at most a few
bins that are not full.

Defined results: a null text counts as empty, and is a document of the end id alone; repeated rows are packed each for
itself; ties of length and of room go by the order of the pieces; an empty table gives no rows; extra columns of the pieces
stay. Pieces need not be unique by id.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, text_bytes, views
from .tokens import END_ID, word_encoder

CAPACITY = 4096
#: A bin that is at least so full isn't packed further.
FULL = 0.999
#: Partitions that meet in one in the next round.
FAN_IN = 8
#: Pieces that a first-round partition gets on average.
PER_TASK = 50_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
BATCH_BYTES = 2_000_000


def cut_pieces(path: str, capacity: int, end_id: int, as_bytes: bool = True):
    """A mapInArrow function from (doc_id, body) to pieces with offsets and checksums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(path)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            part, size = [], 0
            ids = batch.column("doc_id").to_pylist()
            for k, v in enumerate(views(batch.column("body"))):
                part.append((ids[k], bytes(v)))
                size += len(v)
                if size > BATCH_BYTES:
                    yield rows(encoder, part, end)
                    part, size = [], 0
            if part:
                yield rows(encoder, part, end)

    def rows(encoder, part, end) -> pa.RecordBatch:
        out: tuple[list, ...] = ([], [], [], [], [])
        step = 4 * capacity
        for (doc, _), ids in zip(part, encoder.encode([t for _, t in part]), strict=True):
            ids += end
            for k, at in enumerate(range(0, len(ids), step)):
                piece = ids[at : at + step]
                for column, value in zip(out, (doc, k, at // 4, len(piece) // 4, zlib.crc32(piece)), strict=True):
                    column.append(value)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID["word"]) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("body")).mapInArrow(cut_pieces(path, capacity, end_id), PIECES)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Longest first, each item into the fullest bin that has room: bin and offset of each item, and the bins' fills."""
    bin_of, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    fills: list[int] = []
    free: dict[int, list[int]] = {}  # room -> open bins
    rooms: list[int] = []  # ascending keys of free
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        at = bisect.bisect_left(rooms, n)
        if at < len(rooms):
            room = rooms[at]
            b = free[room].pop()
            if not free[room]:
                del free[room], rooms[at]
        else:
            room, b = capacity, len(fills)
            fills.append(0)
        bin_of[i], offset[i] = b, fills[b]
        fills[b] += n
        if left := room - n:
            if left not in free:
                free[left] = []
                bisect.insort(rooms, left)
            free[left].append(b)
    return bin_of, offset, fills


def _pack(level: int, capacity: int, most_open: int):
    """A mapInArrow function: items (item, length) of the partition to (item, bin, offset, fill, is_open). The ``most_open`` emptiest bins are open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, lengths = [], []
        for batch in batches:
            items.append(batch.column("item").to_numpy(zero_copy_only=False))
            lengths.append(batch.column("length").to_numpy(zero_copy_only=False))
        if not items:
            return
        item, length = np.concatenate(items), np.concatenate(lengths)
        bin_of, offset, fills = best_fit(length, capacity)
        base = (level << 58) | (TaskContext.get().partitionId() << 34)
        fills = np.array(fills, np.int64)
        is_open = np.ones(len(fills), bool)
        is_open[np.argsort(fills, kind="stable")[most_open:]] = False
        fill, is_open = fills[bin_of], is_open[bin_of]
        for lo in range(0, len(item), 100_000):
            s = slice(lo, lo + 100_000)
            yield pa.RecordBatch.from_pydict({"item": item[s], "bin": base + bin_of[s], "place": offset[s], "fill": fill[s], "is_open": is_open[s]})

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, full: float = FULL, fan_in: int = FAN_IN, per_task: int = PER_TASK) -> DataFrame:
    """``pieces`` (any columns, with length from 1 to capacity) with sequence_id and offset."""
    numbered = cut(pieces.withColumn("_item", F.monotonically_increasing_id()))
    whole = numbered.filter(F.col("length") >= capacity).withColumn("sequence_id", -1 - F.col("_item")).withColumn("offset", F.lit(0).cast("long"))
    items = numbered.filter(F.col("length") < capacity).select(F.col("_item").alias("item"), "length")
    n = max(1, -(-items.count() // per_task))
    kind = "item long, bin long, place long, fill long, is_open boolean"

    def round_of(items: DataFrame, n: int, level: int) -> DataFrame:
        dealt = items.repartition(n, "item").sortWithinPartitions("item")
        return cut(dealt.mapInArrow(_pack(level, capacity, max(1, per_task // fan_in)), kind))

    first = round_of(items, n, 0)
    packed, moves, level = first, None, 0
    while n > 1:
        n, level = -(-n // fan_in), level + 1
        left = packed.filter((F.col("fill") < int(full * capacity)) & F.col("is_open"))
        least = left.agg(F.min("fill")).first()[0]
        if least is None:
            break
        open_bins = left.filter(F.col("fill") <= capacity - least).groupBy(F.col("bin").alias("item")).agg(F.first("fill").alias("length"))
        packed = round_of(open_bins, n, level)
        step = packed.select(F.col("item").alias("bin"), F.col("bin").alias("to"), F.col("place").alias("by"))
        if moves is None:
            moves = step
        else:
            later = step.select(F.col("bin").alias("to"), F.col("to").alias("then"), F.col("by").alias("more"))
            moves = moves.join(later, "to", "left").select("bin", F.coalesce("then", "to").alias("to"), (F.col("by") + F.coalesce("more", F.lit(0))).alias("by"))
    placed = first.select(F.col("item").alias("_item"), "bin", "place")
    if moves is None:
        placed = placed.select("_item", F.col("bin").alias("sequence_id"), F.col("place").alias("offset"))
    else:
        placed = placed.join(moves, "bin", "left").select("_item", F.coalesce("to", "bin").alias("sequence_id"), (F.col("place") + F.coalesce("by", F.lit(0))).alias("offset"))
    short = numbered.filter(F.col("length") < capacity).join(placed, "_item")
    return whole.unionByName(short).drop("_item")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    return pack(token_pieces(docs, path, capacity), capacity)
