"""SimHash near-duplicates by a segment-popcount embedding.

The 64 bits of a fingerprint are 32 segments of two bits; a point is the vector of their bit counts. The Manhattan
distance of two points never exceeds the Hamming distance of the fingerprints. With the segments in seven groups, two
points at distance 4 or less agree in at least three groups, so every such pair meets in a cell of one of the 35 grids
over three groups. In a cell, pairs are met in the order of their total count (differing by at most 4), are held against
the Manhattan bound, then verified on the fingerprints. Only links that join two parts of a cell leave it: as many as
its members at most, whatever the size of a group of near copies.

Equal texts share a fingerprint and are one node, so a group of copies costs one row. Components come from alternating
star contraction, with checkpoints.

Defined results: a null or wordless text has fingerprint zero; fewer words than a shingle make one shingle; repeated ids
are rows of their own; null ids stay rows, and count as larger than any other id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_hot, text_bytes, views

SHINGLE = 4
SEED = 42
RADIUS = 4
GROUPS = 7
#: Shingles that are hashed at a time.
STEP = 1 << 16
_PAIRS = np.uint64(0x5555555555555555)
_FOURS = np.uint64(0x3333333333333333)
_BYTES = np.uint64(0x0F0F0F0F0F0F0F0F)
NO_ID = (1 << 63) - 1


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Unsigned: a bit is set if more than half of the shingles' XXH64 values have it."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # bytes: A-Z and the six ASCII white space characters only
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    starts = ends - lens
    n = max(1, len(words) - shingle + 1)
    first, last = starts[:n], ends[min(shingle, len(words)) - 1 :]
    set_bits = np.zeros(64, np.int64)
    for lo in range(0, n, STEP):
        pairs = zip(first[lo : lo + STEP].tolist(), last[lo : lo + STEP].tolist(), strict=True)
        h = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in pairs], dtype=">u8")
        set_bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(set_bits * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.array([fingerprint(bytes(v), shingle) for v in views(batch.column("body"))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("body")).mapInArrow(run, "doc_id long, fp long")


def embedding(fp: np.ndarray) -> np.ndarray:
    """32 two-bit counts, packed in 64 bits."""
    return (fp & _PAIRS) + ((fp >> np.uint64(1)) & _PAIRS)


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of packed embeddings: the counts' differences, by turns of every other segment in four bits."""
    total = 0
    for shift in (np.uint64(0), np.uint64(2)):
        x, y = (a >> shift) & _FOURS, (b >> shift) & _FOURS
        d = (x | np.uint64(0x8888888888888888)) - y  # 8 + difference in each four bits, 6 to 10
        up = (d >> np.uint64(3)) & np.uint64(0x1111111111111111)  # 1 where the difference isn't negative
        down = up ^ np.uint64(0x1111111111111111)
        size = (d & (up * np.uint64(7))) + ((~d & (down * np.uint64(7))) + down)
        size = (size & _BYTES) + ((size >> np.uint64(4)) & _BYTES)
        total = total + (size * np.uint64(0x0101010101010101) >> np.uint64(56)).astype(np.int64)
    return total


def group_masks(groups: int = GROUPS, keep: int = GROUPS - RADIUS) -> list[int]:
    """For each choice of ``keep`` groups, the bits of their segments in a packed embedding, signed."""
    edges = [round(i * 32 / groups) for i in range(groups + 1)]
    one = [sum(3 << (2 * s) for s in range(edges[g], edges[g + 1])) for g in range(groups)]
    return [m - (1 << 64) if m >> 63 else m for m in (sum(one[g] for g in pick) for pick in combinations(range(groups), keep))]


def packed_counts(fp: Column) -> Column:
    """``embedding`` as a column, by half adders: sums of longs would overflow."""
    low = F.lit(0x5555555555555555)
    a, b = fp.bitwiseAND(low), F.shiftrightunsigned(fp, 1).bitwiseAND(low)
    return a.bitwiseXOR(b).bitwiseOR(F.shiftleft(a.bitwiseAND(b), 1))


def cell_links(fp: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links of a spanning forest of one cell's different fingerprints, in blocks of candidates."""
    n = len(fp)
    weight = popcount(fp)
    order = np.argsort(weight, kind="stable")
    fp, weight = fp[order], weight[order].astype(np.int64)
    vec = embedding(fp)
    root = np.arange(n)
    out = []
    reach = np.searchsorted(weight, weight + radius, side="right")
    for i in range(n - 1):
        s = slice(i + 1, reach[i])
        if s.start >= s.stop:
            continue
        near = np.flatnonzero(popcount(fp[s] ^ fp[i]) <= radius) if s.stop - s.start < 32 else _near(fp, vec, i, s, radius)
        for j in (near + i + 1).tolist():
            a, b = _find(root, i), _find(root, j)
            if a != b:
                root[b] = a
                out.append((int(fp[i]), int(fp[j])))
    return out


def _near(fp: np.ndarray, vec: np.ndarray, i: int, s: slice, radius: int) -> np.ndarray:
    bounded = np.flatnonzero(manhattan(vec[s], vec[i]) <= radius)
    return bounded[popcount(fp[s][bounded] ^ fp[i]) <= radius]


def _find(root: np.ndarray, x: int) -> int:
    while root[x] != x:
        root[x] = root[root[x]]
        x = root[x]
    return x


def _cells(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by grid and cell. A cell that goes on in the next batch is held back: eight bytes a member."""
        at, held = None, []
        links: list[tuple[int, int]] = []

        def close() -> None:
            if held and sum(map(len, held)) > 1:
                links.extend(cell_links(np.unique(np.concatenate(held)), radius))
            held.clear()

        for batch in batches:
            grid = batch.column("grid").to_numpy(zero_copy_only=False)
            cell = batch.column("cell").to_numpy(zero_copy_only=False)
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(fp):
                continue
            edges = np.flatnonzero((np.diff(cell) != 0) | (np.diff(grid) != 0)) + 1
            starts = np.concatenate(([0], edges))
            ends = np.concatenate((edges, [len(fp)]))
            several = np.flatnonzero(ends - starts > 1)
            for k in sorted({0, len(starts) - 1, *several.tolist()}):
                name = (int(grid[starts[k]]), int(cell[starts[k]]))
                if name != at:
                    close()
                    at = name
                held.append(fp[starts[k] : ends[k]])
            if len(links) > 50_000:
                yield _links(links)
                links = []
        close()
        if links:
            yield _links(links)

    return run


def _links(links: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(links, dtype=np.uint64).view(np.int64)
    return pa.RecordBatch.from_pydict({"a": both[:, 0].copy(), "b": both[:, 1].copy()})


def links(nodes: DataFrame, radius: int = RADIUS, groups: int = GROUPS) -> DataFrame:
    """(a, b): different fingerprints at most ``radius`` bits apart, enough of them to connect all that are so linked.

    nodes: a column fp of different fingerprints. Each goes to one cell of each grid.
    """
    masks = group_masks(groups, groups - radius)
    cells = nodes.select("fp", packed_counts(F.col("fp")).alias("v")).select("fp", F.posexplode(F.array(*[F.col("v").bitwiseAND(F.lit(m)) for m in masks])).alias("grid", "cell"))
    ordered = cells.repartition("grid", "cell").sortWithinPartitions("grid", "cell", "fp")
    return ordered.mapInArrow(_cells(radius), "a long, b long").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the edges (a, b): alternating large-star and small-star until nothing changes.

    The root is a node's smallest. A star's centre is found by an aggregate and joined back, so no node's neighbours
    need to be in one task.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct())
    before = None
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        now = cut(small.filter("u > v").distinct())
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, groups: int = GROUPS) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id that links lead to."""
    prints = cut(fingerprints(docs, shingle))
    nodes = cut(prints.groupBy("fp").agg(F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("least_id")))
    roots = components(links(nodes.select("fp"), radius, groups)).withColumnRenamed("node", "fp")
    linked = roots.join(nodes, "fp")
    lowest = linked.groupBy("root").agg(F.min("least_id").alias("lowest"))
    label = nodes.join(linked.join(lowest, "root").select("fp", "lowest"), "fp", "left").select("fp", F.coalesce("lowest", "least_id").alias("component_id"))
    out = join_hot(prints, label, "fp")
    return out.select("doc_id", "fp", F.when(F.col("component_id") != NO_ID, F.col("component_id")).alias("component_id"))


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
