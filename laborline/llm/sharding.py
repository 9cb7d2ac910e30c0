"""Fixed virtual slots: rows hash into thousands of slots, and a versioned table maps slots to shards.

Only per-slot sums (a fixed number of rows, whatever the input) reach the driver. Rebalancing edits the map: it adds a
version in which as few slots as possible have moved.

Defined results: a null text has no bytes; a null id hashes like any other value, so the texts of rows without ids spread
them over the slots; rows of one id and one text share a slot, in any order; slots of equal weight go by number; an empty
table has a map with empty slots; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

N_SLOTS = 4096
ROW_OVERHEAD = 8
MAP_SCHEMA = "version int, slot int, shard int, bytes long, rows long, first_row long"


def virtual_slot(*keys: Column, n_slots: int = N_SLOTS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(n_slots)).cast("int")


def slot_sums(rows: DataFrame, slot: str = "virtual_slot", size: str = "size") -> dict[int, tuple[int, int]]:
    """Bytes and rows of each used slot; at most one row per slot comes to the driver."""
    return {r[0]: (r[1], r[2]) for r in rows.groupBy(slot).agg(F.sum(size), F.count("*")).collect()}


def build_map(sums: dict[int, tuple[int, int]], n_shards: int, n_slots: int = N_SLOTS) -> list[int]:
    """The shard of each slot: heaviest slots first, each to the lightest shard."""
    heap = [(0, 0, s) for s in range(n_shards)]
    out = [0] * n_slots
    for slot in sorted(range(n_slots), key=lambda s: (-sums.get(s, (0, 0))[0], s)):
        load, count, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (load + sums.get(slot, (0, 0))[0], count + 1, shard))
    return out


def rebalance(old: list[int], sums: dict[int, tuple[int, int]], n_shards: int, slack: float = 0.02) -> list[int]:
    """An edited map for ``n_shards``: slots leave shards that are gone or above the mean, for the lightest shard."""
    weight = [sums.get(s, (0, 0))[0] for s in range(len(old))]
    mean = sum(weight) / n_shards
    out, loads = list(old), [0] * n_shards
    homeless = [s for s, shard in enumerate(old) if shard >= n_shards]
    for s, shard in enumerate(old):
        if shard < n_shards:
            loads[shard] += weight[s]
    by_shard: dict[int, list[int]] = {}
    for s in sorted(range(len(old)), key=lambda s: (weight[s], s)):
        if old[s] < n_shards:
            by_shard.setdefault(old[s], []).append(s)
    for shard, slots in by_shard.items():
        for s in reversed(slots):  # heavy slots first, as long as that leaves the shard its mean
            if loads[shard] > mean and loads[shard] - weight[s] >= mean * (1 - slack):
                loads[shard] -= weight[s]
                homeless.append(s)
    heap = [(load, shard) for shard, load in enumerate(loads)]
    heapq.heapify(heap)
    for s in sorted(homeless, key=lambda s: (-weight[s], s)):
        load, shard = heapq.heappop(heap)
        out[s] = shard
        heapq.heappush(heap, (load + weight[s], shard))
    return levelled(out, weight, n_shards)


def levelled(shards: list[int], weight: list[int], n_shards: int) -> list[int]:
    """``shards`` after moves of a slot from the fullest to the emptiest shard, or exchanges of one for a lighter one, each the
    one that levels the two most, as long as one does.

    A slot holds more bytes the larger the input is, so moves alone leave shards a slot apart; exchanges go by the
    differences of slots, of which two shards have thousands.
    """
    out, loads, held = list(shards), [0] * n_shards, [[] for _ in range(n_shards)]
    for s, shard in enumerate(out):
        loads[shard] += weight[s]
        insort(held[shard], (weight[s], s))
    for _ in range(len(out)):
        high, low = max(range(n_shards), key=loads.__getitem__), min(range(n_shards), key=loads.__getitem__)
        gap = loads[high] - loads[low]
        there = [(0, -1), *held[low]]  # nothing comes back for a slot that only moves
        best = None
        for w, s in held[high]:
            at = bisect_left(there, (w - gap // 2, -1))
            for back, t in there[max(0, at - 1) : at + 1]:
                if 0 < w - back < gap:
                    found = (abs(2 * (w - back) - gap), t >= 0, s, t)
                    best = found if best is None else min(best, found)
        if best is None:
            break
        for s, source, target in ((best[2], high, low), (best[3], low, high)):
            if s >= 0:
                held[source].remove((weight[s], s))
                insort(held[target], (weight[s], s))
                loads[source], loads[target], out[s] = loads[source] - weight[s], loads[target] + weight[s], target
    return out


def map_rows(shards: list[int], sums: dict[int, tuple[int, int]], version: int) -> list[tuple]:
    """Rows of MAP_SCHEMA; first_row: rows of the same shard in slots before this one."""
    seen: dict[int, int] = {}
    out = []
    for slot, shard in enumerate(shards):
        size, rows = sums.get(slot, (0, 0))
        out.append((version, slot, shard, size, rows, seen.get(shard, 0)))
        seen[shard] = seen.get(shard, 0) + rows
    return out


def write_map(spark: SparkSession, path: str, rows: list[tuple]) -> None:
    """Append a version to the map's table; earlier versions stay readable."""
    spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    table = spark.read.schema(MAP_SCHEMA).parquet(path)
    if version is None:
        version = table.agg(F.max("version")).first()[0]
    return table.filter(F.col("version") == version)


def assign(rows: DataFrame, slot_map: DataFrame, order: list[str], slot: str = "virtual_slot") -> DataFrame:
    """``rows`` with shard and gapless position in it.

    The map has a fixed number of rows, so it is broadcast. Positions count within a slot, whose rows are a fixed
    small share of the input, on top of the map's running row counts.
    """
    placed = rows.withColumn("_in_slot", F.row_number().over(Window.partitionBy(slot).orderBy(*order)) - 1)
    small = F.broadcast(slot_map.select(F.col("slot").alias(slot), "shard", "first_row", F.col("version").alias("map_version")))
    return placed.join(small, slot).withColumn("slot", (F.col("first_row") + F.col("_in_slot")).cast("long")).drop("_in_slot", "first_row")
