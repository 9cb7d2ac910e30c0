"""Collocations by hashed n-gram counting: bucket counts a length ahead, Apriori pruning, then exact counts.

Pass m over the texts counts the phrases of m words exactly, and in the same pass hashes all phrases of m + 1 words into
bucket counters (PCY for pairs, direct hashing and pruning beyond them). A phrase of m words is counted only if its bucket
reached the least count in the pass before, and if both its parts of m - 1 words are among the frequent ones. What a pass
needs from the one before are two bitmaps, of buckets and of frequent phrases. They have a bit for each BYTES_A_BUCKET bytes
of text, and 2 ** MOST_BITS bits or 8 MB at most whatever the corpus, so they are broadcast. Both only prune: a frequent
phrase is always in them, and what passes by chance is counted exactly and then falls under the least count. In texts far
above a gigabyte buckets fill up and prune less, at the same memory. Counters stop at the least count, which decides no bit
differently.

Counts leave a task summed by block; bucket counters leave it as SLICES slices of bytes, which are added in two steps, first
by slice and salt, so that no task adds up a slice for all tasks of a large input. Joins of a phrase's parts with their
counts broadcast those parts that many phrases share (``join_hot``). The best of a language are taken by salted parts first,
so the last step reads at most SALTS times the limit.

Defined results: a null language counts as ``und``; null and empty texts have no words; rows that repeat an id are texts
each; equal scores go by count, then by the phrase's bytes; an empty table gives no rows; other columns, whatever their
names, are not read. Very long texts are counted in blocks of BLOCK_BYTES, with the words before a block carried over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, discard, join_hot, partitions, scratch, text_bytes, views

LEAST, MOST_WORDS, LIMIT = 10, 3, 2000
#: A longer candidate with this share of the shorter one's occurrences, in hundredths, takes its place.
ABSORB = 50
LEAST_BITS, MOST_BITS, BYTES_A_BUCKET = 20, 26, 16
SLICES, SALTS = 256, 16
BLOCK_BYTES = 4 << 20
#: Scores are in millionths.
SCALE = 1_000_000

_UPPER = bytes(range(65, 91))
_BREAK = b"\xff"  # no byte of UTF-8 text
_FOLD = bytes.maketrans(_UPPER + b".,;:!?\x0b\x0c\r", _UPPER.lower() + b"\n" * 9)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


class _Words(dict):
    """Numbers for words as they come; number 0 is the break between pieces."""

    def __init__(self) -> None:
        self[_BREAK] = 0

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _blocks(text: memoryview) -> Iterator[tuple[int, list[bytes]]]:
    """The words of a text, with breaks between its pieces, in blocks with their sizes."""
    folded = bytes(text).translate(_FOLD).replace(b"\n", b" \xff ")
    lo = 0
    while lo < len(folded):
        hi = folded.find(b" ", lo + BLOCK_BYTES)
        hi = len(folded) if hi < 0 else hi
        yield hi - lo, folded[lo:hi].split()
        lo = hi


def _word_hashes(words: list[bytes], lang: str) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def _phrase_buckets(hashes: np.ndarray, ids: np.ndarray, m: int, bits: int) -> np.ndarray:
    """The bucket of each ``m`` ids in a row: of ids[0:m], ids[1:m+1], ..."""
    n = len(ids) - m + 1
    total = np.zeros(n, np.uint64)
    for k in range(m):
        total = (total ^ hashes[ids[k : n + k]]) * _ODD[k % 4]
        total ^= total >> np.uint64(29)
    return (total >> np.uint64(64 - bits)).astype(np.int64)


def _has(packed: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """Whether the bits of the buckets are set."""
    return ((packed[buckets >> 3] >> (7 - (buckets & 7)).astype(np.uint8)) & 1).view(bool)


def _pack(counters: np.ndarray) -> bytes:
    """A slice of counters: as it is, or where most are zero the others as place << 8 | counter in four bytes."""
    if counters.dtype == np.uint8:
        some = np.flatnonzero(counters)
        if 4 * len(some) < len(counters):
            return (some.astype(np.uint32) << np.uint32(8) | counters[some]).tobytes()
    return counters.tobytes()


def _add(sums: np.ndarray, packed: bytes, most: int) -> None:
    """Add a packed slice to ``sums``, to ``most`` at most."""
    if len(packed) == sums.nbytes:
        own = np.frombuffer(packed, sums.dtype)
        np.copyto(sums, np.minimum(sums.astype(np.int64) + own, most).astype(sums.dtype))
    else:
        own = np.frombuffer(packed, np.uint32)
        at = own >> np.uint32(8)
        sums[at] = np.minimum(sums[at].astype(np.int64) + (own & np.uint32(255)), most)


_COUNTED = "lang string, phrase string, n long, slice int, salt int, counters binary"


def _counts_batch(lang: str, phrases: list[str], counts: list[int]) -> pa.RecordBatch:
    n = len(phrases)
    arrays = [pa.array([lang] * n, pa.string()), pa.array(phrases, pa.string()), pa.array(counts, pa.int64())]
    return pa.RecordBatch.from_arrays([*arrays, *(pa.nulls(n, t) for t in (pa.int32(), pa.int32(), pa.binary()))], names=["lang", "phrase", "n", "slice", "salt", "counters"])


def _slices_batches(counters: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The slices of a task's counters that aren't empty."""
    parts = counters.reshape(SLICES, -1)
    some = np.flatnonzero(parts.any(axis=1)).tolist()
    salt = TaskContext.get().partitionId() % SALTS
    for lo in range(0, len(some), 16):
        yield _slices_batch(some[lo : lo + 16], salt, [_pack(parts[k]) for k in some[lo : lo + 16]])


def _slices_batch(some: list[int], salt: int, packed: list[bytes]) -> pa.RecordBatch:
    n = len(some)
    arrays = [pa.array(some, pa.int32()), pa.array([salt] * n, pa.int32()), pa.array(packed, pa.binary())]
    return pa.RecordBatch.from_arrays([*(pa.nulls(n, t) for t in (pa.string(), pa.string(), pa.int64())), *arrays], names=["lang", "phrase", "n", "slice", "salt", "counters"])


class _Counter:
    """Counts of a task: exact ones of phrases of ``m`` words a block, bucket counters of the next length for the whole task."""

    def __init__(self, m: int, ahead: bool, least: int, bits: int, frequent: bytes | None, buckets: bytes | None) -> None:
        self.m, self.least, self.bits = m, least, bits
        self.frequent, self.buckets = (x if x is None else np.frombuffer(x, np.uint8) for x in (frequent, buckets))
        self.counters = np.zeros(1 << bits, _kind(least)) if ahead else None

    def block(self, lang: str, words: _Words, ids: np.ndarray, fresh: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Count the phrases that end with a fresh word and span no break."""
        m, names = self.m, list(words)
        hashes = _word_hashes(names, lang)
        inside = ids != 0
        if self.counters is not None and (at := self._places(inside, fresh, m + 1)).size:
            hit, times = np.unique(_phrase_buckets(hashes, ids, m + 1, self.bits)[at], return_counts=True)
            self.counters[hit] = np.minimum(self.counters[hit] + times, self.least)
        at = self._places(inside, fresh, m)
        if self.buckets is not None and at.size:
            at = at[_has(self.buckets, _phrase_buckets(hashes, ids, m, self.bits)[at])]
        if self.frequent is not None and at.size:
            part = _has(self.frequent, _phrase_buckets(hashes, ids, m - 1, self.bits))
            at = at[part[at] & part[at + 1]]
        if not at.size:
            return
        keys = ids[at].astype(np.int64)
        for k in range(1, m):
            if int(keys.max() + 1) * len(names) >= 1 << 62:
                keys = np.unique(keys, return_inverse=True)[1]
            keys = keys * len(names) + ids[at + k]
        _, first, counts = np.unique(keys, return_index=True, return_counts=True)
        rows = ids[at[first][:, None] + np.arange(m)]
        for lo in range(0, len(rows), 50_000):
            phrases = [b" ".join([names[i] for i in r]).decode("utf-8", "replace") for r in rows[lo : lo + 50_000].tolist()]
            yield _counts_batch(lang, phrases, counts[lo : lo + 50_000].tolist())

    @staticmethod
    def _places(inside: np.ndarray, fresh: np.ndarray, length: int) -> np.ndarray:
        n = len(inside) - length + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        whole = fresh[length - 1 :].copy()
        for k in range(length):
            whole &= inside[k : n + k]
        return np.flatnonzero(whole)


def _kind(least: int) -> type:
    return np.uint8 if least < 256 else np.int64


def _count_pass(texts: DataFrame, m: int, ahead: bool, least: int, bits: int, frequent: bytes | None = None, buckets: bytes | None = None) -> DataFrame:
    """Pass ``m`` over (lang, body): counts of phrases a block, and slices of bucket counters if there is a pass after it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, carry = _Counter(m, ahead, least, bits, frequent, buckets), m if ahead else m - 1
        held: dict[str, tuple[_Words, list[np.ndarray], list[np.ndarray], int]] = {}
        for batch in batches:
            for v, lang in zip(views(batch.column("body")), batch.column("lang").to_pylist(), strict=True):
                before: list[bytes] = []  # of a long text's block, so that phrases across blocks count
                for size, block in _blocks(v):
                    words, ids, fresh, held_size = held.pop(lang, None) or (_Words(), [], [], 0)
                    run = [_BREAK, *before, *block]
                    ids.append(np.fromiter(map(words.__getitem__, run), np.int32, len(run)))
                    fresh.append(np.arange(len(run)) > len(before))
                    before = run[1:][-carry:] if carry else []
                    if held_size + size >= BLOCK_BYTES:
                        yield from counter.block(lang, words, np.concatenate(ids), np.concatenate(fresh))
                    else:
                        held[lang] = (words, ids, fresh, held_size + size)
                if sum(x[3] for x in held.values()) >= 4 * BLOCK_BYTES:  # many languages
                    for lang_, (words, ids, fresh, _) in held.items():
                        yield from counter.block(lang_, words, np.concatenate(ids), np.concatenate(fresh))
                    held.clear()
        for lang, (words, ids, fresh, _) in held.items():
            yield from counter.block(lang, words, np.concatenate(ids), np.concatenate(fresh))
        if ahead:
            yield from _slices_batches(counter.counters)

    return texts.mapInArrow(work, _COUNTED)


def _bitmap(slices: DataFrame, least: int, bits: int) -> bytes:
    """One bit a bucket: whether its counters add up to ``least``. The driver gets the bits."""
    kind, size = _kind(least), (1 << bits) // SLICES

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for k, salt, c in zip(*(batch.column(x).to_pylist() for x in ("slice", "salt", "counters")), strict=True):
                _add(sums.setdefault((k, salt), np.zeros(size, kind)), c, least)
        for (k, salt), own in sums.items():
            yield pa.RecordBatch.from_pydict({"slice": pa.array([k], pa.int32()), "salt": pa.array([salt], pa.int32()), "counters": pa.array([_pack(own)], pa.binary())})

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, c in zip(*(batch.column(x).to_pylist() for x in ("slice", "counters")), strict=True):
                _add(sums.setdefault(k, np.zeros(size, kind)), c, least)
        yield pa.RecordBatch.from_pydict({"slice": pa.array(list(sums), pa.int32()), "bits": pa.array([np.packbits(x >= least).tobytes() for x in sums.values()], pa.binary())})

    n = partitions(slices.sparkSession)
    once = slices.select("slice", "salt", "counters").repartition(n, "slice", "salt").mapInArrow(add, "slice int, salt int, counters binary")
    whole = once.repartition(min(n, SLICES), "slice").mapInArrow(pack, "slice int, bits binary")
    out, width = bytearray((1 << bits) // 8), size // 8
    for r in whole.collect():
        out[r["slice"] * width : (r["slice"] + 1) * width] = r["bits"]
    return bytes(out)


def _frequent_bitmap(found: DataFrame, m: int, bits: int) -> bytes:
    """The bits of the buckets of (lang, phrase), phrases of ``m`` words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(1 << bits, np.uint8)
        for batch in batches:
            by_lang: dict[str, list[bytes]] = {}
            for lang, phrase in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist(), strict=True):
                by_lang.setdefault(lang, []).extend(phrase.encode().split(b" "))
            for lang, words in by_lang.items():
                ids = np.arange(len(words), dtype=np.int32)
                counters[_phrase_buckets(_word_hashes(words, lang), ids, m, bits)[::m]] = 1
        yield from _slices_batches(counters)

    return _bitmap(found.select("lang", "phrase").mapInArrow(work, _COUNTED), 1, bits)


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, most_words: int = MOST_WORDS) -> tuple[DataFrame, DataFrame]:
    """The phrases of 1 to ``most_words`` words with ``least`` or more occurrences: lang, phrase, words, n; and the words of each lang: lang, total."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), text_bytes(text).alias("body"))
    size = texts.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    bits = max(LEAST_BITS, min(MOST_BITS, (size // BYTES_A_BUCKET).bit_length()))
    frequent = buckets = None
    found, totals = [], None
    for m in range(1, most_words + 1):
        path = scratch(spark, f"phrases-{m}")
        _count_pass(texts, m, m < most_words, least, bits, frequent, buckets).write.parquet(path)
        rows = spark.read.schema(_COUNTED).parquet(path)
        counted = rows.filter(F.col("slice").isNull()).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
        if m == 1:
            totals = cut(rows.filter(F.col("slice").isNull()).groupBy("lang").agg(F.sum("n").alias("total")))
        found.append(cut(counted.filter(F.col("n") >= least).withColumn("words", F.lit(m))))
        if m < most_words:
            buckets = _bitmap(rows.filter(F.col("slice").isNotNull()), least, bits)
            frequent = _frequent_bitmap(found[-1], m, bits)
        discard(path)
    together = found[0]
    for more in found[1:]:
        together = together.unionByName(more)
    return together.select("lang", "phrase", "words", "n"), totals


def _key(phrase: Column) -> Column:
    return F.concat(F.length("lang").cast("string"), F.lit(":"), F.col("lang"), phrase)


def with_cuts(counts: DataFrame) -> DataFrame:
    """Each phrase of two words or more with its lowest-scoring cut: lang, phrase, words, a, l, r, k, score.

    A cut after k words has l = count of the first part, r = count of the rest and the score SCALE * a * a // (l * r), in
    decimals of 38 digits: exact up to 10 ** 15 occurrences. Of equal scores the smallest k counts.
    """
    words = F.split("phrase", " ")
    longer = counts.filter(F.col("words") > 1).withColumn("_w", words)
    cuts = longer.select("lang", "phrase", "words", F.col("n").alias("a"), "_w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    first, rest = F.array_join(F.slice("_w", F.lit(1), F.col("k")), " "), F.array_join(F.slice("_w", F.col("k") + 1, F.col("words") - F.col("k")), " ")
    rows = cut(cuts.select("lang", "phrase", "words", "a", "k", _key(first).alias("first"), _key(rest).alias("rest")))
    table = counts.select(_key(F.col("phrase")).alias("key"), "n")
    left = cut(join_hot(rows, table.withColumnsRenamed({"key": "first", "n": "l"}), "first").drop("first"))
    both = join_hot(left, table.withColumnsRenamed({"key": "rest", "n": "r"}), "rest")
    score = F.expr(f"(cast({SCALE} as decimal(8,0)) * (cast(a as decimal(15,0)) * cast(a as decimal(15,0)))) div (cast(l as decimal(15,0)) * cast(r as decimal(15,0)))")
    best = both.withColumn("score", score).groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("_best"))
    return best.select("lang", "phrase", "words", "a", "_best.l", "_best.r", "_best.k", "_best.score")


def not_absorbed(scored: DataFrame, absorb: int = ABSORB) -> DataFrame:
    """The phrases that lie in no longer one of at least ``absorb`` hundredths of their occurrences."""
    longer = scored.filter(F.col("words") > 2).withColumn("_w", F.split("phrase", " "))
    lengths = longer.select("lang", "_w", "words", "a", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("_n"))
    parts = lengths.select("lang", "a", F.explode(F.transform(F.sequence(F.lit(1), F.col("words") - F.col("_n") + 1), lambda i: F.array_join(F.slice("_w", i, F.col("_n")), " "))).alias("phrase"))
    most = parts.groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    joined = scored.join(most, ["lang", "phrase"], "left")
    return joined.filter(F.col("_longer").isNull() | (100 * F.col("_longer") < absorb * F.col("a"))).drop("_longer")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, most_words: int = MOST_WORDS, limit: int = LIMIT, absorb: int = ABSORB) -> DataFrame:
    """The ``limit`` best collocations of each language: lang, rank, phrase, a, l, r, n, score."""
    counts, totals = phrase_counts(docs, text, lang, least, most_words)
    kept = not_absorbed(cut(with_cuts(counts)), absorb).withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    some = kept.withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).filter(F.col("_r") <= limit)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= limit)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
