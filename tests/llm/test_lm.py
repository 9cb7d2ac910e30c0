"""The language model: counts by a plain loop, gradients by differences, probabilities that add up to one."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from laborline.llm import gru, lm, queries

from .fixtures import documents, write
from .test_operators import SF

COLUMNS = "doc_id held_out n_tokens n_known train_tokens base_score score".split()


def small(seed=3):
    firsts = np.array([0, 5, 9, 10, 11, 12])
    chance = np.random.default_rng(seed)
    counts = chance.integers(1, 50, 12).astype(float)
    p = gru.initial(np.add.reduceat(counts, firsts[:-1]), counts, firsts, seed)
    p = {k: (v + chance.normal(0, 0.3, v.shape)).astype(np.float64) for k, v in p.items()}
    return gru.Network(p, firsts), chance


def slow(net, text, start):
    """The log probability of a text, a step at a time in plain float64."""
    p, H, h, total, before = net.p, gru.HIDDEN, np.zeros(gru.HIDDEN), 0.0, start
    soft = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    for symbol in text:
        x, a = p["embedding"][before] @ p["w_in"] + p["b_in"], h @ p["w_state"]
        r, z = 1 / (1 + np.exp(-(x[:H] + a[:H]))), 1 / (1 + np.exp(-(x[H : 2 * H] + a[H : 2 * H])))
        h = (1 - z) * np.tanh(x[2 * H :] + r * a[2 * H :]) + z * h
        c = net.classes[symbol]
        lo, hi = net.firsts[c], net.firsts[c + 1]
        total += math.log(soft(h @ p["w_class"] + p["b_class"])[c]) + math.log(soft(p["w_out"][lo:hi] @ h + p["b_out"][lo:hi])[symbol - lo])
        before = symbol
    return total


def test_state_is_carried_through_whole_texts():
    net, chance = small()
    texts = [chance.integers(0, 12, n).astype(np.uint16) for n in (1, 3, 200, 31, 32, 33, 64, 65, 700, 1)]
    got = net.log_probabilities(texts, 11)
    assert np.allclose(got, [slow(net, t, 11) for t in texts], rtol=1e-5)


def test_outcomes_add_up_to_one():
    net, _ = small()
    for before in ([], [3], [3, 11, 0, 8] * 20):
        each = net.log_probabilities([np.array([*before, s], np.uint16) for s in range(12)], 11)
        own = net.log_probabilities([np.array(before, np.uint16)], 11)[0] if before else 0.0
        assert abs(np.exp(each - own).sum() - 1) < 1e-4


def test_gradients_are_differences():
    net, chance = small()
    shape = (7, 4)
    before, target = chance.integers(0, 12, shape), chance.integers(0, 12, shape)
    keep, live, h = (chance.random(shape) > 0.2).astype(float), chance.random(shape) > 0.1, chance.normal(0, 0.5, (4, gru.HIDDEN))

    def loss():
        return net.gradients(before, target, keep, live, h)[2] / live.sum()

    g = net.gradients(before, target, keep, live, h)[0]
    for name, v in net.p.items():
        for at in {tuple(chance.integers(0, n) for n in v.shape) for _ in range(8)}:
            old, step = v[at], 1e-2
            v[at] = old + step
            up = loss()
            v[at] = old - step
            down = loss()
            v[at] = old
            assert abs((up - down) / (2 * step) - g[name][at]) < 3e-3 * max(1.0, abs(g[name][at])), (name, at)


def test_training_reads_every_token_and_learns():
    net, chance = small()
    texts = [np.array([k % 2 * 5 + (j % 3) for j in range(chance.integers(5, 60))] + [11], np.uint16) for k in range(300)]
    net.p = {k: v.astype(np.float32) for k, v in net.p.items()}
    was = net.log_probabilities(texts, 11).sum()
    n, _ = net.train(texts, 11)
    assert n == sum(map(len, texts)) and net.log_probabilities(texts, 11).sum() > was * 0.8


def plain(rows):
    split = [(i, [*(t or "").encode().lower().split(), None]) for i, t in rows]
    out = [zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2 for i, _ in split]
    c = Counter(w for (_, words), held in zip(split, out) if not held for w in words)
    total, kinds = sum(c.values()), len(c)
    return [(i, held, len(w), sum(c[x] > 0 for x in w), total, sum(math.log10((c[x] + 1) / (total + kinds + 1)) for x in w)) for (i, w), held in zip(split, out)]


def same(got, want):
    order = lambda r: repr((r[0], r[2], r[3], round(r[5], 4)))
    got, want = sorted(map(tuple, got), key=order), sorted(want, key=order)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert all(abs(a[5] - b[5]) <= 1e-9 * max(1, abs(b[5])) for a, b in zip(got, want))
    assert all(-1e9 < a[6] < 0 for a in got)


def test_counts_and_base_of_odd_rows(spark, tmp_path):
    odd = [(20, "x y x y " * 50, None), (20, "x y x y " * 50, "de"), (None, "no id", "en"), (None, None, None), (21, "a\x1cb É é É", "fr"), (22, "w%d " * 10, "")]
    odd += [(30 + k, " ".join(f"w{(k * j) % 97}" for j in range(k)), f"l{k % 9}") for k in range(60)]
    docs = documents(spark).select("doc_id", "text", "lang").unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string")).selectExpr("*", "1 as word", "2 as words", "3 as held_out", "4 as chunk", "5 as c")
    got = queries.op11_gru(spark, write(spark, tmp_path, docs))
    assert got.columns == COLUMNS
    rows = got.collect()
    same(rows, plain([(r["doc_id"], r["text"]) for r in docs.collect()]))
    assert len({r["score"] for r in rows if r["doc_id"] == 20}) == 1


def test_small_chunks_give_the_same_counts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK_TOKENS", 40)
    monkeypatch.setattr(lm, "MOST_COMMON", 3)
    docs = documents(spark)
    same(lm.scored(docs).collect(), plain([(r["doc_id"], r["text"]) for r in docs.collect()]))


@pytest.mark.parametrize("held", [True, None])
def test_without_training_texts_or_rows(spark, held):
    docs = documents(spark) if held else documents(spark).limit(0)
    rows = lm.scored(docs, held=F.lit(held)).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r["train_tokens"] == 0 and r["n_known"] == 0 and abs(r["score"] - r["n_tokens"] * math.log10(0.5)) < 0.01 * r["n_tokens"]


def test_held_out_texts_are_likelier_than_under_the_base(spark):
    rows = queries.op11_gru(spark, SF).collect()
    same(rows, plain([(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]))
    held = [r for r in rows if r["held_out"]]
    tokens = sum(r["n_tokens"] for r in held)
    assert sum(r["score"] - r["base_score"] for r in held) / tokens > 0.8
    assert sum(r["score"] > r["base_score"] for r in held) > 0.95 * len(held)


def test_words_are_those_of_bytes_split():
    import pyarrow as pa

    chance = np.random.default_rng(4)
    odd = [b"", b" ", b"\n\n", b" a", b"a ", b"A\x1cb \x0b\x0c\r\tC", "É é İ ſ".encode(), b"\xff\xfe X\xc3 \xe2\x82", b"\x00 \x00A", bytes(range(256))]
    odd += [bytes(chance.integers(0, 256, n, np.uint8)) for n in range(200)]
    for kind in (pa.binary(), pa.large_binary()):
        words, lengths = lm._split(pa.array([b"cut off", *odd], kind)[1:])
        want = [b.lower().split() for b in odd]
        assert words.cast(pa.binary()).to_pylist() == [w for x in want for w in x] and lengths.tolist() == [len(x) for x in want]


def test_cost_of_a_text_does_not_follow_its_chunks_vocabulary(spark):
    """100,000 words in as many texts take about as long as in twenty; they took a pass over all of them for each text."""
    import time

    took = []
    for texts in (20, 20, 100_000):
        docs = spark.range(0, texts, 1, 1).select(F.col("id").alias("doc_id"), F.lit(False).alias("held_out"), F.lit("en").alias("lang"))
        words = F.transform(F.sequence(F.lit(1), F.lit(100_000 // texts)), lambda k: F.concat(F.lit("w"), F.col("doc_id").cast("string"), F.lit("x"), k.cast("string")))
        began = time.perf_counter()
        rows = lm._encode(docs.withColumn("body", F.array_join(words, " ").cast("binary"))).agg(F.count("doc_id"), F.max(F.size("words")), F.sum(F.octet_length("ids"))).first()
        took.append(time.perf_counter() - began)
        assert tuple(rows) == (texts, 100_000, 400_000)
    assert took[2] < 3 * took[1] + 1


def test_gradients_are_of_windows_that_carry_their_state():
    """Two windows, the second from the first's last states, lose as much as one of both."""
    net, chance = small()
    before, target, keep = chance.integers(0, 12, (8, 5)), chance.integers(0, 12, (8, 5)), (chance.random((8, 5)) > 0.2).astype(float)
    live, h = chance.random((8, 5)) > 0.1, chance.normal(0, 0.5, (5, gru.HIDDEN))
    _, end, whole = net.gradients(before, target, keep, live, h)
    _, mid, first = net.gradients(before[:3], target[:3], keep[:3], live[:3], h)
    _, last, second = net.gradients(before[3:], target[3:], keep[3:], live[3:], mid)
    assert end.shape == h.shape and np.allclose(end, last) and abs(first + second - whole) < 1e-9 * whole
