"""Periodic runs of words by harmonic grid probing, and texts with the repeats of each run collapsed.

A run is a stretch of words with smallest period p (words p apart are equal) of at least max(least_words, least_periods * p)
words that no neighbouring word extends. For each p the words at jp and (j+1)p are compared, over all texts of a block at
once; the grid points over all p are a harmonic sum, n log n for n words. A run of four periods holds four grid points, so
three equal neighbours in the grid are a candidate: it is extended to both sides by comparing slices of growing size.
Grid points whose three steps lie in a run found before (of a period that is no larger) are skipped: by the theorem of Fine
and Wilf the run they could belong to is that run. A stretch found again by steps across its end, or by a multiple of its
period, is known by its ends.

Each text is worked on alone, so nothing is shuffled and rows of a hot source cost no more than others. Memory of a task is
a block of BLOCK_WORDS words, or one text where it is longer.

Defined results: null, empty and blank texts have no words, no runs and an empty collapsed text; rows that repeat an id are
results each; a null id stays null; an empty table gives no rows; extra columns stay, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_bytes, views

LEAST_WORDS, LEAST_PERIODS = 6, 4
BLOCK_WORDS = 500_000
#: Up to so many texts are probed one by one, by slices.
FEW = 3

_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


class _Numbers(dict):
    """Numbers for words as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _extent(w: np.ndarray, i: int, p: int, lo: int, hi: int) -> tuple[int, int]:
    """The largest [s, e) around place ``i`` in w[lo:hi] in which words ``p`` apart are equal."""
    right, step = i, 64
    while right < hi - p:
        stop = min(right + step, hi - p)
        odd = np.flatnonzero(w[right:stop] != w[right + p : stop + p])
        if odd.size:
            right += int(odd[0])
            break
        right, step = stop, min(step * 2, 1 << 16)
    left, step = i, 64
    while left > lo:
        stop = max(left - step, lo)
        odd = np.flatnonzero(w[stop:left] != w[stop + p : left + p])
        if odd.size:
            left = stop + int(odd[-1]) + 1
            break
        left, step = stop, min(step * 2, 1 << 16)
    return left, right + p


def runs_of(w: np.ndarray, lengths: np.ndarray, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each text, by start and period; ``w`` holds the texts' word numbers end to end."""
    if least_periods < 4:
        raise ValueError("three steps of the grid need runs of four periods")
    starts = np.cumsum(lengths) - lengths
    found: list[list[tuple[int, int, int]]] = [[] for _ in lengths]
    by_length = np.argsort(-lengths, kind="stable")
    s_len, s_start = lengths[by_length], starts[by_length]
    covered = np.zeros(len(w), np.int64)  # the furthest end of a found run that holds the place
    known: set[tuple[int, int]] = set()  # a stretch belongs to the smallest of its periods
    p = 0
    while True:
        p += 1
        k = int(np.searchsorted(-s_len, -max(least_words, least_periods * p), side="right"))
        if not k:
            break
        steps = (s_len[:k] - 1) // p
        if k <= FEW:
            hits = []
            for t in range(k):
                lo, n = int(s_start[t]), int(s_len[t])
                same = w[lo : lo + n - p : p] == w[lo + p : lo + n : p]
                hits += [(lo + int(j) * p, t) for j in np.flatnonzero(same[:-2] & same[1:-1] & same[2:])]
        else:
            ends = np.cumsum(steps)
            first = ends - steps
            places = (np.arange(ends[-1]) - np.repeat(first, steps)) * p + np.repeat(s_start[:k], steps)
            same = w[places] == w[places + p]
            js = np.flatnonzero(same[:-2] & same[1:-1] & same[2:])
            texts = np.searchsorted(ends, js, side="right")
            inside = js + 2 < ends[texts]
            hits = list(zip(places[js[inside]].tolist(), texts[inside].tolist(), strict=True))
        for i, t in hits:
            if covered[i] > i + 3 * p:
                continue
            lo = int(s_start[t])
            s, e = _extent(w, i, p, lo, lo + int(s_len[t]))
            if e - s >= max(least_words, least_periods * p) and (s, e) not in known:
                known.add((s, e))
                found[by_length[t]].append((s - lo, e - s, p))
                covered[s:e] = np.maximum(covered[s:e], e)
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in found]


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray | None:
    """Which of ``n`` words no run holds after its first period; None for all."""
    if not runs:
        return None
    keep = np.ones(n, bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return keep


def with_runs(df: DataFrame, text: str = "text", runs: str = "runs", collapsed: str = "collapsed", least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> DataFrame:
    """``df`` with the runs of its texts (start, length, period in words, by start and period), and the collapsed texts.

    In a collapsed text the words that stay are joined by one space; every run is down to its first period.
    """
    keep = [f"_keep_{k}" for k in range(len(df.columns))]
    plain = df.toDF(*keep).withColumn("_body", text_bytes(keep[df.columns.index(text)]))

    def block(bodies: list[memoryview]) -> tuple[list, list]:
        numbers, split = _Numbers(), [bytes(b).split() for b in bodies]
        lengths = np.array([len(x) for x in split], np.int64)
        w = np.fromiter((numbers[x] for words in split for x in words), np.int32, int(lengths.sum()))
        found = runs_of(w, lengths, least_words, least_periods)
        texts = []
        for words, own in zip(split, found, strict=True):
            mask = kept_words(len(words), own)
            texts.append(b" ".join(words if mask is None else [x for x, k in zip(words, mask.tolist(), strict=True) if k]).decode("utf-8", "replace"))
        return found, texts

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo, size, bodies = 0, 0, []
            for k, v in enumerate(views(batch.column("_body")), 1):
                bodies.append(v)
                size += len(v)
                if size >= 6 * BLOCK_WORDS or k == batch.num_rows:
                    found, texts = block(bodies)
                    structs = [[{"start": s, "length": n, "period": p} for s, n, p in own] for own in found]
                    part = batch.slice(lo, k - lo)
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(structs, _RUNS), pa.array(texts, pa.string())], names=[*keep, "_runs", "_collapsed"])
                    lo, size, bodies = k, 0, []

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields[:-1])
    out = plain.mapInArrow(work, f"{kinds}, _runs array<struct<start: bigint, length: bigint, period: bigint>>, _collapsed string")
    return out.select(*[F.col(k).alias(n) for k, n in zip(keep, df.columns, strict=True)], F.col("_runs").alias(runs), F.col("_collapsed").alias(collapsed))


def longest(runs: str = "runs") -> Column:
    """The run of most words (of the smallest start, then period, among these); null without a run."""
    ranked = F.transform(runs, lambda r: F.struct((-r["length"]).alias("_n"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))
    return F.array_min(ranked)


def repeat_from(text: str = "text", key: str = "doc_id") -> Column:
    """The text with a periodic end that a hash of the key decides: for a tenth of the keys, words from some place on repeat.

    With h = crc32 of the decimal key, g = h // 10 and n words: where h % 10 = 0, word i >= a becomes word a + (i - a) % p,
    with a = g % n and p = 1 + (n - a) // (3 + g % 8). A null key repeats nothing. Words come back joined by one space.
    """
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("string")
    def repeated(body: pa.Array, h: pa.Array) -> pa.Array:
        out = []
        for v, crc in zip(views(body), h.to_pylist(), strict=True):
            words, g = bytes(v).split(), crc // 10
            n = len(words)
            if n:
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                words = words[:a] + [words[a + i % p] for i in range(n - a)]
            out.append(b" ".join(words).decode("utf-8", "replace"))
        return pa.array(out, pa.string())

    h = F.crc32(F.col(key).cast("string").cast("binary"))
    return F.when(F.coalesce(h % 10, F.lit(1)) == 0, repeated(text_bytes(text), F.coalesce(h, F.lit(1)))).otherwise(F.col(text).cast("string"))
