"""Log-likelihood of whole documents under a gated recurrent language model with a class-factored output.

The outcomes are the words of the training texts, the end of a text, and one outcome for any other word: as many as in the
add-one unigram model that stands beside it (``base_score``). Their classes are: runs of CLASS_WORDS of the HEAD commonest
words, by language; the other words by language and by a bin of their count; the unknown; the end. The network says the
probability of a class, and in the classes of common words that of the member; inside a bin a word has its share of the
bin's counts. What training reads is each word's class when that one occurrence is left out of the counts (its own if no word is in that class), so a word that
occurs once is read as unknown, and the model learns how often new words come.

Counts are exact and over all training texts. Texts are tokenised once into chunks, each with the list of its own words;
the lists are counted by a shuffle and looked up by a join, so no task and no driver holds the vocabulary. The network has a
fixed size. One task trains it on WARM_TEXTS texts first. Then every task trains a copy over all its training texts; the
copies are averaged by tokens, in ROUNDS rounds, each over its share of the texts, so that every training text is read.
Sums of copies go by two steps of bounded rows.

Defined results: a null text counts as empty, its one token is the end; a null id counts as empty text in the choice of
training texts; rows that repeat an id are texts each; words of equal counts go by their bytes; without training texts the
model knows no word, and all mass is on the unknown and the end by halves; an empty table gives no rows; extra columns are
not read. Very long texts are read from an empty state to their end; one text is the work of one task. A word's language is
the one that most of its occurrences have, null being ``und``; languages beyond the GROUPS largest share their classes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, partitions, scratch, text_bytes
from .gru import Network, flat, initial, unflat

HEAD, CLASS_WORDS, GROUPS, ROUNDS = 1024, 64, 6, 2
#: About as many texts, by chance, are those of the first round, which one task trains on, so that the copies of the later rounds start from the same features.
WARM_TEXTS, WARM_RATE, RATE = 512, 0.01, 0.003
#: The first count of each bin.
BINS = (1, 2, 4, 16, 64)
CHUNK_TOKENS = 2_000_000
#: Of a batch about as many bytes of text are split at once.
PIECE_BYTES = 4 << 20
#: Words with at least this share of all tokens are looked up by a broadcast, as they are in nearly every chunk: there are
#: MOST_COMMON of them at most. The HEAD words are the commonest of those with a HEAD_SHARE-th of the tokens.
MOST_COMMON, HEAD_SHARE = 10_000, 100_000

def held_out(key: str = "doc_id", parts: int = 7, part: int = 2) -> Column:
    """True for the ids whose crc32 as text leaves the remainder ``part`` by ``parts``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % parts == part


def _split(body: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, A-Z in lower case, and how many each text has. The texts are taken as they are, valid UTF-8 or not."""
    wide = pa.types.is_large_binary(body.type)
    split = pc.ascii_split_whitespace(pc.ascii_lower(body.view(pa.large_string() if wide else pa.string())))
    words, owner = split.flatten(), pc.list_parent_indices(split).to_numpy()
    some = pc.greater(pc.binary_length(words), 0)  # what white space at either end leaves is none
    return words.filter(some), np.bincount(owner[some.to_numpy(zero_copy_only=False)], minlength=len(body))


_ENCODED = "chunk long, doc_id long, held_out boolean, ids binary, lang string, words array<string>, counts array<int>"


def _encode(docs: DataFrame) -> DataFrame:
    """Of (doc_id, held_out, lang, body): per text the numbers of its words in its chunk's list, per chunk that list and the training counts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, base = 0, TaskContext.get().partitionId() << 32
        held: dict[str, list[tuple]] = {}
        sizes: dict[str, int] = {}

        def flush(lang: str) -> pa.RecordBatch:
            nonlocal seq
            parts = held.pop(lang)
            sizes.pop(lang)
            chunk, seq = base + seq, seq + 1
            ids, out, lengths = (pa.concat_arrays([x[0] for x in parts]), *(np.concatenate([x[k] for x in parts]) for k in (1, 2)))
            coded, n = pa.concat_arrays([x[3] for x in parts]).dictionary_encode(), len(ids)
            numbers, words = coded.indices.to_numpy(), [w.decode("utf-8", "replace") for w in coded.dictionary.cast(pa.binary()).to_pylist()]
            counts = np.bincount(numbers[np.repeat(~out, lengths)], minlength=len(words))
            bounds = np.concatenate([[0], np.cumsum(lengths) * 4]).astype(np.int32)
            own = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(numbers, np.int32))])
            arrays = [
                pa.array([chunk] * (n + 1), pa.int64()), pa.concat_arrays([ids, pa.nulls(1, pa.int64())]), pa.array([*out.tolist(), None], pa.bool_()),
                pa.concat_arrays([own, pa.nulls(1, pa.binary())]), pa.array([lang] * (n + 1), pa.string()),
                pa.array([*[None] * n, words], pa.list_(pa.string())), pa.array([*[None] * n, counts.astype(np.int32)], pa.list_(pa.int32())),
            ]
            return pa.RecordBatch.from_arrays(arrays, names=["chunk", "doc_id", "held_out", "ids", "lang", "words", "counts"])

        for batch in batches:
            body = batch.column("body")
            read = np.cumsum(pc.binary_length(body).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
            for rows in np.split(np.arange(len(body)), np.flatnonzero(np.diff(read // PIECE_BYTES)) + 1):
                by_lang: dict[str, list[int]] = {}
                for k, lang in zip(rows.tolist(), batch.column("lang").take(rows).to_pylist(), strict=True):
                    by_lang.setdefault(lang, []).append(k)
                for lang, places in by_lang.items():
                    words, lengths = _split(body.take(places))
                    out = batch.column("held_out").take(places).to_numpy(zero_copy_only=False).astype(bool)
                    held.setdefault(lang, []).append((batch.column("doc_id").take(places), out, lengths, words))
                    sizes[lang] = sizes.get(lang, 0) + len(words) + len(places) + words.nbytes // 64
                    if sizes[lang] >= CHUNK_TOKENS:
                        yield flush(lang)
                if sum(sizes.values()) >= 2 * CHUNK_TOKENS:
                    for name in list(held):
                        yield flush(name)
        for name in list(held):
            yield flush(name)

    return docs.mapInArrow(work, _ENCODED)


@dataclass
class Layout:
    """What the driver keeps of the vocabulary: bounded tables of classes and common words."""

    firsts: np.ndarray  # the first symbol of each class
    class_counts: np.ndarray
    symbol_counts: np.ndarray
    unknown: int
    end: int
    bin_firsts: int  # the symbol of group 0, bin 0
    bin_totals: np.ndarray  # (group, bin): the counts of its words
    groups: list[str]
    head: list[tuple[str, int]]  # word, symbol
    tokens: int  # N
    words: int  # V
    ends: int


def _layout(counts: DataFrame, ends: int) -> Layout:
    by_lang = counts.groupBy("lang").agg(F.sum("c").alias("n"))
    groups = [r["lang"] for r in by_lang.orderBy(F.desc("n"), "lang").limit(GROUPS).collect()]
    sums = counts.agg(F.sum("c"), F.count("*")).first()
    often = counts.filter(F.col("c") >= max(BINS[-1], (sums[0] or 0) / HEAD_SHARE))
    head = [tuple(r) for r in often.orderBy(F.desc("c"), "word").limit(HEAD).select("word", "lang", "c").collect()]
    index = {g: k for k, g in enumerate(groups)}
    n_groups = len(groups) + 1
    head.sort(key=lambda r: (index.get(r[1], len(groups)), -r[2], r[0]))
    firsts, symbol_counts = [], []
    for k, (_, lang, c) in enumerate(head):
        here = index.get(lang, len(groups))
        if k == 0 or here != before or k - firsts[-1] >= CLASS_WORDS:
            firsts.append(k)
        before = here
        symbol_counts.append(c)
    bin_firsts = len(head)
    totals, ones = np.zeros((n_groups, len(BINS))), np.zeros((n_groups, len(BINS)))
    common = F.broadcast(counts.sparkSession.createDataFrame([(w,) for w, _, _ in head], "word string"))
    rest = counts.join(common, "word", "left_anti")
    group = _group(groups)
    cells = rest.groupBy(group.alias("g"), _bin("c").alias("b"), _bin(F.col("c") - 1).alias("less")).agg(F.sum("c").alias("n")).collect()
    for r in cells:
        totals[r["g"], r["b"]] += r["n"]
    for r in cells:
        if r["less"] >= 0:
            ones[r["g"], r["less"] if totals[r["g"], r["less"]] else r["b"]] += r["n"]
    singles = totals[:, 0].sum()
    firsts += list(range(bin_firsts, bin_firsts + totals.size + 3))
    unknown, end = bin_firsts + totals.size, bin_firsts + totals.size + 1
    symbol_counts = np.array([*symbol_counts, *ones.ravel(), singles, ends], np.float64)
    bounds = np.array(firsts)
    class_counts = np.add.reduceat(symbol_counts, bounds[:-1])
    class_counts[-2 - totals.size : -2][totals.ravel() == 0] = -0.5  # no word is in it
    return Layout(bounds, class_counts, symbol_counts, unknown, end, bin_firsts, totals, groups, [(w, k) for k, (w, _, _) in enumerate(head)], int(sums[0] or 0) + ends, int(sums[1]) + (ends > 0), ends)


def _bin(c: Column | str) -> Column:
    """The bin of a count; -1 for none."""
    c = F.col(c) if isinstance(c, str) else c
    out = F.lit(-1)
    for k, least in enumerate(BINS):
        out = F.when(c >= least, F.lit(k)).otherwise(out)
    return out


def _group(groups: list[str]) -> Column:
    out = F.lit(len(groups))
    for k, g in enumerate(groups):
        out = F.when(F.col("lang") == g, F.lit(k)).otherwise(out)
    return out


_READ = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, inner double, symbols binary, reads binary"


def _looked_up(encoded: DataFrame, counts: DataFrame, layout: Layout) -> DataFrame:
    """Per text its symbols, as they are scored and as training reads them, and the sums that don't depend on the network."""
    spark = encoded.sparkSession
    entries = encoded.filter(F.col("words").isNotNull()).select("chunk", F.posexplode("words").alias("pos", "word"))
    head = spark.createDataFrame(layout.head, "word string, head int")
    known = counts.join(F.broadcast(head), "word", "left").select("word", "c", "head", (_group(layout.groups) * len(BINS)).alias("g"), _bin("c").alias("b"), _bin(F.col("c") - 1).alias("less"))
    filled = F.array(*[F.lit(bool(n)) for n in layout.bin_totals.ravel()])
    less = F.when(F.col("less") < 0, F.lit(layout.unknown)).when(filled[F.greatest(F.col("g") + F.col("less"), F.lit(0))], layout.bin_firsts + F.col("g") + F.col("less")).otherwise(layout.bin_firsts + F.col("g") + F.col("b"))
    known = cut(known.select("word", "c", F.coalesce("head", layout.bin_firsts + F.col("g") + F.col("b")).alias("symbol"), F.coalesce("head", less).alias("read")))
    common = F.broadcast(known.filter(F.col("c") >= layout.tokens / MOST_COMMON))
    first = entries.join(common, "word", "left")
    easy = first.filter(F.col("c").isNotNull()).select("chunk", "pos", "c", "symbol", "read")
    hard = first.filter(F.col("c").isNull()).select("word", "chunk", "pos").join(known, "word", "left").select("chunk", "pos", "c", "symbol", "read")
    looked = easy.unionByName(hard).groupBy("chunk").agg(F.collect_list(F.struct("pos", F.coalesce("c", F.lit(0)).alias("c"), F.coalesce("symbol", F.lit(layout.unknown)).alias("symbol"), F.coalesce("read", F.lit(layout.unknown)).alias("read"))).alias("entries"))
    texts = encoded.filter(F.col("words").isNull()).select(F.col("chunk").alias("own_chunk"), "doc_id", "held_out", "ids")
    bin_firsts, unknown, end, ends = layout.bin_firsts, layout.unknown, layout.end, layout.ends
    totals = np.log10(np.maximum(layout.bin_totals.ravel(), 1))

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        n = 0
        if right.num_rows:
            parts = [right.column("entries").chunk(k).flatten() for k in range(right.column("entries").num_chunks)]
            pos, c, symbol, read = (np.concatenate([p.field(name).to_numpy(zero_copy_only=False) for p in parts]) for name in ("pos", "c", "symbol", "read"))
            n = len(pos)
        order = np.argsort(pos) if n else np.zeros(0, np.int64)
        c, symbol, read = (x[order] if n else np.zeros(0, np.int64) for x in ((c, symbol, read) if n else (None, None, None)))
        base = np.log10(c + 1.0)
        inner = np.zeros(n)
        tail = (symbol >= bin_firsts) & (symbol < unknown)
        inner[tail] = np.log10(c[tail]) - totals[symbol[tail] - bin_firsts]
        rows: dict[str, list] = {k: [] for k in ("n_tokens", "n_known", "base", "inner", "symbols", "reads")}
        for v, out in zip(left.column("ids").to_pylist(), left.column("held_out").to_pylist(), strict=True):
            ids = np.frombuffer(v, np.int32)
            rows["n_tokens"].append(len(ids) + 1)
            rows["n_known"].append(int((c[ids] > 0).sum()) + (ends > 0))
            rows["base"].append(float(base[ids].sum()) + float(np.log10(ends + 1.0)))
            rows["inner"].append(float(inner[ids].sum()))
            rows["symbols"].append(np.append(symbol[ids], end).astype(np.uint16).tobytes())
            rows["reads"].append(None if out else np.append(read[ids], end).astype(np.uint16).tobytes())
        kinds = {"n_tokens": pa.int64(), "n_known": pa.int64(), "base": pa.float64(), "inner": pa.float64(), "symbols": pa.binary(), "reads": pa.binary()}
        return pa.table([left.column("doc_id"), left.column("held_out"), *(pa.array(rows[k], t) for k, t in kinds.items())], names=["doc_id", "held_out", *kinds])

    return texts.groupBy("own_chunk").cogroup(looked.groupBy("chunk")).applyInArrow(work, _READ)


def _train(texts: DataFrame, start: np.ndarray, layout: Layout, rate: float) -> np.ndarray | None:
    """The mean over tasks, by tokens, of the weights that each has trained on its texts; None without texts."""
    like, firsts, end = initial(layout.class_counts, layout.symbol_counts, layout.firsts), layout.firsts, layout.end

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, seen, sums = Network(unflat(start, like), firsts), 0, np.zeros(len(start))
        held: list[np.ndarray] = []

        def learn() -> None:
            nonlocal seen, sums
            n, _ = net.train(held, end, rate)
            seen, sums = seen + n, sums + n * flat(net.p).astype(np.float64)
            held.clear()

        size = 0
        for batch in batches:
            for v in batch.column("reads").to_pylist():
                held.append(np.frombuffer(v, np.uint16))
                size += len(held[-1])
                if size >= 2 * CHUNK_TOKENS:
                    learn()
                    size = 0
        if held:
            learn()
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([seen], pa.int64()), pa.array([sums.tobytes()], pa.binary())], names=["part", "n", "weights"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, sums = 0, np.zeros(len(start))
        for batch in batches:
            for n, w in zip(batch.column("n").to_pylist(), batch.column("weights").to_pylist(), strict=True):
                seen, sums = seen + n, sums + np.frombuffer(w)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([seen], pa.int64()), pa.array([sums.tobytes()], pa.binary())], names=["part", "n", "weights"])

    schema = "part long, n long, weights binary"
    copies = texts.select("reads").mapInArrow(work, schema)
    some = copies.repartition(max(1, int(partitions(texts.sparkSession) ** 0.5)), "part").mapInArrow(add, schema)
    rows = some.coalesce(1).mapInArrow(add, schema).collect()  # one row
    return np.frombuffer(rows[0]["weights"]) / rows[0]["n"] if rows else None


def scored(docs: DataFrame, text: str = "text", key: str = "doc_id", lang: str | None = "lang", held: Column | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of each text.

    ``held`` marks the texts that aren't learned from; ``lang`` None puts all words in one group.
    """
    spark = docs.sparkSession
    language = F.coalesce(F.col(lang).cast("string"), F.lit("und")) if lang else F.lit("und")
    plain = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(held_out(key) if held is None else held, F.lit(False)).alias("held_out"), language.alias("lang"), text_bytes(text).alias("body"))
    path, read_path = scratch(spark, "lm-words"), scratch(spark, "lm-symbols")
    _encode(plain).write.parquet(path)
    encoded = spark.read.schema(_ENCODED).parquet(path)
    pairs = encoded.filter(F.col("words").isNotNull()).select("lang", F.explode(F.arrays_zip("words", "counts")).alias("e")).filter(F.col("e.counts") > 0)
    by_lang = pairs.groupBy(F.col("e.words").alias("word"), "lang").agg(F.sum(F.col("e.counts").cast("long")).alias("n"))
    counts = cut(by_lang.groupBy("word").agg(F.sum("n").alias("c"), F.max(F.struct("n", "lang"))["lang"].alias("lang")))
    ends = encoded.filter(F.col("words").isNull() & ~F.col("held_out")).count()
    layout = _layout(counts, ends)
    _looked_up(encoded, counts, layout).write.parquet(read_path)
    discard(path)
    texts = spark.read.schema(_READ).parquet(read_path)
    like = initial(layout.class_counts, layout.symbol_counts, layout.firsts)
    weights = flat(like)
    learned = texts.filter(F.col("reads").isNotNull()).select("reads", F.xxhash64(F.monotonically_increasing_id()).alias("chance"))
    warm = learned.filter(F.pmod("chance", F.lit(max(1, ends))) < WARM_TEXTS).repartition(1).sortWithinPartitions("chance")
    rounds = [(warm, WARM_RATE), *((learned.filter(F.pmod("chance", F.lit(ROUNDS)) == k), RATE) for k in range(ROUNDS))]
    for share, rate in rounds:
        found = _train(share, weights, layout, rate)
        weights = weights if found is None else found
    firsts, end, total = layout.firsts, layout.end, float(np.log10(layout.tokens + layout.words + 1))
    weights = weights.astype(np.float32)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(unflat(weights, like), firsts)
        for batch in batches:
            found = net.log_probabilities([np.frombuffer(v, np.uint16) for v in batch.column("symbols").to_pylist()], end)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "held_out", "n_tokens", "n_known", "base", "inner")), pa.array(found)], names=["doc_id", "held_out", "n_tokens", "n_known", "base", "inner", "net"])

    kept = texts.select("doc_id", "held_out", "n_tokens", "n_known", "base", "inner", "symbols")
    out = kept.mapInArrow(work, "doc_id long, held_out boolean, n_tokens long, n_known long, base double, inner double, net double")
    # Digits that depend on how texts share a matrix product are cut off.
    score = F.round(F.col("net") / float(np.log(10)) + F.col("inner"), 3)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(layout.tokens).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * total).alias("base_score"), score.alias("score"))
