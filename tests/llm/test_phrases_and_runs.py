"""Collocations and periodic runs against plain loops and SQL."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from laborline.llm import collocations, periodic, queries

from .fixtures import documents, write
from .test_operators import SF


def plain_runs(w, least_words=6, least_periods=4):
    """Every run by its definition: for each period all stretches, kept where no smaller period has the stretch."""
    found, n = {}, len(w)
    for p in range(1, n // least_periods + 1):
        i = 0
        while i < n - p:
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j < n - p and w[j] == w[j + p]:
                j += 1
            if j + p - i >= max(least_words, least_periods * p) and (i, j + p) not in found:
                found[i, j + p] = p
            i = j
    return sorted((s, e - s, p) for (s, e), p in found.items())


def runs_alone(w):
    numbers = {x: k for k, x in enumerate(dict.fromkeys(w))}
    return periodic.runs_of(np.array([numbers[x] for x in w], np.int32), np.array([len(w)], np.int64))[0]


def test_runs_are_those_of_a_plain_loop():
    chance = random.Random(5)
    texts = []
    for _ in range(600):
        w = [chance.randrange(chance.choice([1, 2, 3, 9])) for _ in range(chance.randrange(60))]
        for _ in range(chance.randrange(3)):
            unit = [chance.randrange(3) for _ in range(chance.randrange(1, 9))]
            at = chance.randrange(len(w) + 1)
            w[at:at] = (unit * 9)[: chance.randrange(1, 9 * len(unit) + 1)]
        texts.append(w)
    want = [plain_runs(w) for w in texts]
    assert [runs_alone(w) for w in texts] == want and sum(map(len, want)) > 300
    lengths = np.array([len(w) for w in texts], np.int64)
    assert periodic.runs_of(np.array([x for w in texts for x in w], np.int32), lengths) == want


def test_runs_of_long_texts():
    w = ["a"] * 60_000 + ["b"]
    assert runs_alone(w) == [(0, 60_000, 1)]
    assert runs_alone(list(range(50_000)) * 4) == [(0, 200_000, 50_000)] and runs_alone((list(range(50_000)) * 4)[1:]) == []
    assert runs_alone([0, 0, 0, 0, 0]) == [] and runs_alone([0] * 6) == [(0, 6, 1)] and runs_alone([]) == []


def planted(doc_id, text):
    w = [x.decode() for x in (text or "").encode().split()]
    h, n = zlib.crc32(str(doc_id).encode()), len((text or "").encode().split())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def run_row(doc_id, text):
    w = planted(doc_id, text)
    runs = plain_runs(w)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    best = min(((-n, s, p) for s, n, p in runs), default=None)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        doc_id, len(runs), best and best[1], best and -best[0], best and best[2], best and 1000 * -best[0] // best[2],
        digest("".join(f"{s},{n},{p}\n" for s, n, p in runs)), digest(" ".join(x for i, x in enumerate(w) if i not in gone)),
    )


COLUMNS = "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()


def test_op13_by_a_plain_loop(spark, tmp_path):
    odd = [(100, "la " * 9 + "x", "en"), (101, "a b c d a\x1cb " * 5, "en"), (102, "é É é É é É é É x", None), (103, "x " * 3 + "y " * 6, "en"), (None, "q r " * 6, "en"), (104, "p p p p p p", "en"), (104, "p p p p p p", "en")]
    docs = documents(spark).select("doc_id", "text", "lang").unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string")).selectExpr("*", "1 as runs", "2 as collapsed", "3 as _longest")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = queries.op13_runs(spark, write(spark, tmp_path, docs))
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((run_row(*r) for r in rows), key=repr)
    assert queries.op13_runs(spark, write(spark, tmp_path / "none", docs.limit(0))).count() == 0


def test_op13_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    some = {r["doc_id"]: r["text"] for r in docs.collect() if len((r["text"] or "").split()) < 900}
    got = {r["doc_id"]: tuple(r) for r in queries.op13_runs(spark, SF).collect()}
    assert len(got) == docs.count()
    planted_ids = [i for i in some if zlib.crc32(str(i).encode()) % 10 == 0]
    for i in {*list(some)[:150], *planted_ids[:25]}:
        assert got[i] == run_row(i, some[i]), i
    assert sum(got[i][1] > 0 for i in planted_ids) > len(planted_ids) // 2


def test_extra_columns_of_runs_stay(spark):
    df = spark.createDataFrame([(1, "a a a a a a b", [1], None)], "runs int, text string, `odd name` array<int>, _body string")
    r = periodic.with_runs(df, runs="found").first()
    assert r["runs"] == 1 and r["odd name"] == [1] and r["_body"] is None and tuple(r["found"][0]) == (0, 6, 1) and r["collapsed"] == "a b"


def pieces(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in ".,;:!?\x0b\x0c\r":
        low = low.replace(c, "\n")
    return [[w for w in p.replace("\t", " ").split(" ") if w] for p in low.split("\n")]


def plain_collocations(rows, least=10, most=3, limit=2000, absorb=50):
    f, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for w in pieces(text):
            total[lang] += len(w)
            for n in range(1, most + 1):
                for i in range(len(w) - n + 1):
                    f[lang][tuple(w[i : i + n])] += 1
    out = []
    for lang, counts in f.items():
        candidates = {x: c for x, c in counts.items() if len(x) > 1 and c >= least}
        longer = Counter()
        for x, c in candidates.items():
            for n in range(2, len(x)):
                for i in range(len(x) - n + 1):
                    longer[x[i : i + n]] = max(longer[x[i : i + n]], c)
        best = []
        for x, a in candidates.items():
            score, _, l, r = min((1_000_000 * a * a // (counts[x[:k]] * counts[x[k:]]), k, counts[x[:k]], counts[x[k:]]) for k in range(1, len(x)))
            if not longer[x] or 100 * longer[x] < absorb * a:
                best.append((-score, -a, " ".join(x).encode(), l, r))
        out += [(lang, k, p.decode(), -a, l, r, total[lang], -s) for k, (s, a, p, l, r) in enumerate(sorted(best)[:limit], 1)]
    return out


@pytest.fixture(scope="module")
def prose(spark):
    chance = random.Random(3)
    word = lambda: chance.choice(["New", "new", "york", "the", "city", "of", "ÉTÉ", "été", "a b", "\x00", "x" * 50]) + chance.choice(["", "", "", ".", ",", "\n", "\t", "\r\n", "!?"])
    rows = [(k % 7, chance.choice(["en", "en", "de", None, "und", ""]), " ".join(word() for _ in range(chance.randrange(120)))) for k in range(200)]
    rows += [(None, "en", None), (1, None, None), (1, "fr", ""), (2, "x", "one two three " * 12), (3, "1:a", "b c " * 12), (3, "1", "a b c, " * 12)]
    return spark.createDataFrame(rows, "doc_id long, lang string, text string").selectExpr("*", "1 as phrase", "2 as n", "3 as words", "4 as body")


@pytest.mark.parametrize("least,most,limit,absorb", [(10, 3, 2000, 50), (10, 2, 20, 50), (3, 5, 2000, 80), (300, 3, 2000, 50), (1, 4, 100, 1)])
def test_collocations_by_a_plain_loop(spark, prose, least, most, limit, absorb):
    want = plain_collocations([(r["lang"], r["text"]) for r in prose.collect()], least, most, limit, absorb)
    got = collocations.collocations(prose, least=least, most_words=most, limit=limit, absorb=absorb)
    assert got.columns == "lang rank phrase a l r n score".split()
    assert sorted(map(tuple, got.collect())) == sorted(want) and (want or least == 300)


def test_collocations_in_small_blocks(spark, prose, monkeypatch):
    """Phrases across the blocks of long texts count once."""
    want = plain_collocations([(r["lang"], r["text"]) for r in prose.collect()])
    for size in (1, 17, 300):
        monkeypatch.setattr(collocations, "BLOCK_BYTES", size)
        counter = Counter()
        for m in (1, 2, 3):
            rows = collocations._count_pass(prose.selectExpr("coalesce(lang, 'und') as lang", "cast(coalesce(text, '') as binary) as body"), m, m < 3, 10, 20).collect()
            for r in rows:
                if r["slice"] is None:
                    counter[r["lang"], r["phrase"]] += r["n"]
        for lang, _, phrase, a, *_ in want:
            assert counter[lang, phrase] == a, (size, phrase)


def test_slices_add_up():
    chance = np.random.default_rng(2)
    for kind, most in ((np.uint8, 10), (np.int64, 300)):
        rows = [np.minimum(chance.integers(0, 400, 1024) * (chance.random(1024) < share), most).astype(kind) for share in (0.01, 0.2, 1, 0)]
        sums = np.zeros(1024, kind)
        for r in rows:
            collocations._add(sums, collocations._pack(r), most)
        assert (sums == np.minimum(np.sum([r.astype(int) for r in rows], axis=0), most)).all()


def test_scores_past_64_bits(spark):
    big = 3_000_000_000_000
    counts = spark.createDataFrame([("en", "a", 1, big), ("en", "b", 1, big + 7), ("en", "a b", 2, big - 5)], "lang string, phrase string, words int, n long")
    r = collocations.with_cuts(counts).first()
    assert r["score"] == 1_000_000 * (big - 5) ** 2 // (big * (big + 7)) and (r["l"], r["r"]) == (big, big + 7)


def test_collocations_match_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    got = queries.op12_collocations(spark, SF)
    want = con.sql(queries.OP12_SQL)
    assert want.columns == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_collocations_of_no_rows(spark, prose):
    assert collocations.collocations(prose.limit(0)).count() == 0
