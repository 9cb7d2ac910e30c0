"""The operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from laborline.llm import bytebpe, digest, media, packing, queries, quality, sharding, simhash, simple8b, tokens, toxicity, zipwarc

from ..conftest import DATA
from .fixtures import TEXTS, documents, text, write

WORD, BYTE, RANKS = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("small"), documents(spark))


@pytest.fixture(scope="module")
def none(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("none"), documents(spark).limit(0), pages=spark.createDataFrame([], "page_id long, url string, html string"), labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"))


def all_texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", ["op1_slots", "op2_digests", "op3_packing", "op4_archives", "op5_byte_bpe", "op6_media", "op7_id_files", "op8_simhash", "op9_toxicity", "op10_quality"])
def test_empty_tables(spark, none, name):
    assert queries.QUERIES[name](spark, none).count() == 0


@pytest.mark.parametrize("where", ["small", "data"])
def test_slots(spark, small, where):
    rows = queries.op1_slots(spark, small if where == "small" else DATA).collect()
    texts = TEXTS if where == "small" else all_texts(spark)
    place, load = defaultdict(list), Counter()
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 8, zlib.crc32(raw))
        place[r["shard"]].append(r["slot"])
        load[r["shard"]] += r["size"]
    assert len(rows) == len(texts) and all(sorted(p) == list(range(len(p))) for p in place.values())
    largest = max(len((t or "").encode()) + 8 for t in texts.values())
    assert max(load.values()) - min(load.get(s, 0) for s in range(24)) <= largest


def test_map_edits_move_little(spark, tmp_path):
    sums = {s: (100 + s % 7, 1) for s in range(sharding.N_SLOTS)}
    one = sharding.build_map(sums, 24)
    grown = sharding.rebalance(one, sums, 25)
    moved = [s for s in range(len(one)) if one[s] != grown[s]]
    assert 0.9 * len(one) / 25 < len(moved) < 1.5 * len(one) / 25
    load = Counter()
    for s, shard in enumerate(grown):
        load[shard] += sums[s][0]
    assert max(load.values()) / min(load.values()) < 1.1
    for v, m in ((1, one), (2, grown)):
        sharding.write_map(spark, str(tmp_path), sharding.map_rows(m, sums, v))
    assert sharding.read_map(spark, str(tmp_path)).first()["version"] == 2 and sharding.read_map(spark, str(tmp_path), 1).count() == sharding.N_SLOTS
    assert set(sharding.rebalance(grown, sums, 20)) == set(range(20))


def test_shards_of_heavy_slots_are_level():
    chance = np.random.default_rng(3)
    sums = {s: (int(n), 100) for s, n in enumerate(chance.integers(200_000, 300_000, sharding.N_SLOTS))}
    shards = sharding.rebalance([s % 24 for s in range(sharding.N_SLOTS)], sums, 24, slack=0.0)
    load = Counter()
    for s, shard in enumerate(shards):
        load[shard] += sums[s][0]
    assert len(load) == 24 and max(load.values()) - min(load.values()) < 1000


def check_digests(rows, texts):
    order = sorted(texts, reverse=True)
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(texts)
    for k, i in enumerate(order):
        own, after = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        half = len(own) // 2
        edited = own[: len(own) - half] + after[:half]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(own), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == tuple(digest.digests([own.encode()]) + digest.digests([edited.encode()]))
        assert r["near_edited"] == digest.likeness(r["fingerprint"], r["edited_fingerprint"]) and 0 <= r["near_next"] <= 1
        assert r["near_next"] == digest.likeness(r["fingerprint"], got[order[(k + 1) % len(order)]]["fingerprint"])


def test_digests(spark, small):
    check_digests(queries.op2_digests(spark, small).collect(), TEXTS)
    texts = all_texts(spark)
    rows = queries.op2_digests(spark, DATA).collect()
    check_digests(rows, texts)
    assert np.mean([r["near_edited"] > r["near_next"] for r in rows if r["n_chars"] > 200]) > 0.95


def plain_digest(raw: bytes) -> str:
    """The digest by a loop over byte windows."""
    counts = [0] * 128
    for w in zip(raw, raw[1:], raw[2:], raw[3:]):
        for k, picks in enumerate(((0, 1, 2), (0, 1, 3), (0, 2, 3))):
            h = 0x27D4EB2F * (k + 1)
            for factor, j in zip((0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35), picks):
                h += w[j] * factor
            h &= 0xFFFFFFFF
            h ^= h >> 15
            counts[(h * 0x2C1B3C6D & 0xFFFFFFFF) >> 25] += 1
    low, mid, high = (sorted(counts)[k] for k in (31, 63, 95))
    bits = "".join(f"{(c > low) + (c > mid) + (c > high):02b}" for c in counts)
    top = max(high, 1)
    return f"{min(255, int(12 * np.log2(1 + len(raw)))):02x}{low * 15 // top:x}{mid * 15 // top:x}" + f"{int(bits, 2):064x}"


def plain_likeness(a: str, b: str) -> float:
    quartiles = lambda x: [int(x[4:], 16) >> 2 * k & 3 for k in range(128)]
    total = sum((0, 1, 2, 6)[abs(p - q)] for p, q in zip(quartiles(a), quartiles(b)))
    total += min(24, abs(int(a[:2], 16) - int(b[:2], 16))) + min(12, abs(int(a[2], 16) - int(b[2], 16)) + abs(int(a[3], 16) - int(b[3], 16)))
    return 1 - min(256, total) / 256


def test_digests_by_a_plain_loop():
    texts = [(TEXTS[k] or "").encode() for k in TEXTS] + [text(k, 90).encode() for k in range(30)]
    prints = digest.digests(texts)
    assert prints == [plain_digest(t) for t in texts]
    assert all(digest.likeness(a, b) == plain_likeness(a, b) for a in prints for b in prints)


def test_digest_of_one_document(spark, tmp_path):
    docs = spark.createDataFrame([(7, "abcdef")], "doc_id long, text string")
    r = queries.op2_digests(spark, write(spark, tmp_path, docs)).collect()
    assert len(r) == 1 and r[0]["near_next"] == 1.0 and r[0]["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest()


def test_digest_steps_dont_show(monkeypatch):
    texts = [text(k, 50).encode() for k in range(20)] + [b"", b"ab", b"abcd"]
    whole = digest.bucket_counts(texts)
    monkeypatch.setattr(digest, "STEP", 97)
    assert (digest.bucket_counts(texts) == whole).all()


def test_packing(spark, small):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORD)
    tok.encode_special_tokens = True
    for where, texts in ((small, TEXTS), (DATA, all_texts(spark))):
        rows = queries.op3_packing(spark, where).collect()
        bins, pieces = defaultdict(list), defaultdict(dict)
        for r in rows:
            bins[r["sequence_id"]].append(r)
            pieces[r["doc_id"]][r["piece"]] = r
        for b in bins.values():
            at = 0
            for r in sorted(b, key=lambda r: r["offset"]):
                assert r["offset"] == at
                at += r["length"]
            assert at <= 4096
        assert set(pieces) == set(texts)
        for i, t in texts.items():
            ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
            want = {k: (4096 * k, len(p), zlib.crc32(p.tobytes())) for k, p in enumerate(np.split(ids, range(4096, len(ids), 4096)))}
            assert {k: (r["start"], r["length"], r["ids_crc32"]) for k, r in pieces[i].items()} == want
        total = sum(r["length"] for r in rows)
        assert len(bins) <= -(-total // 4096) * 1.02 + 1


def test_packing_without_partners(spark):
    """Where every document is over half the capacity no bin takes two: all are done in the first round, and none is lost."""
    from pyspark.sql import functions as F

    pieces = spark.range(2000).select(F.col("id").alias("doc_id"), (F.pmod(F.xxhash64("id"), F.lit(400)) + 501).alias("length"))
    rows = packing.pack(pieces, capacity=1000, per_task=100, fan_in=4).collect()
    assert len(rows) == len({r["sequence_id"] for r in rows}) == 2000 and all(r["offset"] == 0 for r in rows)
    mixed = pieces.unionByName(spark.range(2000, 2100).select(F.col("id").alias("doc_id"), F.lit(90).cast("long").alias("length")))
    bins = Counter()
    for r in packing.pack(mixed, capacity=1000, per_task=100, fan_in=4).collect():
        bins[r["sequence_id"]] += r["length"]
    assert sum(bins.values()) == sum(r["length"] for r in mixed.collect()) and max(bins.values()) <= 1000 and len(bins) <= 2015


def test_packing_rounds(spark):
    """Several partitions and rounds give as few bins as one; partitions of a hundred pieces, which fill some forty bins each, nearly so."""
    from pyspark.sql import functions as F

    pieces = spark.range(3000).select(F.col("id").alias("doc_id"), (F.pmod(F.xxhash64("id"), F.lit(900)) + 1).alias("length"))
    for n, most in ((100, 1.05), (700, 1.02), (10_000, 1.02)):
        rows = packing.pack(pieces, capacity=1000, per_task=n, fan_in=2).collect()
        bins = defaultdict(list)
        for r in rows:
            bins[r["sequence_id"]].append((r["offset"], r["length"]))
        assert len(rows) == 3000
        for b in bins.values():
            b.sort()
            assert b[0][0] == 0 and all(x[0] + x[1] == y[0] for x, y in zip(b, b[1:])) and sum(b[-1]) <= 1000
        assert len(bins) <= most * sum(r["length"] for r in rows) / 1000 + 2


def test_archives(spark, tmp_path):
    from .fixtures import write as put

    big, other = "x" * 1500, "é" * 600
    pages = [(1, "http://a/ ü", big, "c"), (2, None, big, "c"), (3, "u", None, "c"), (4, "u", "", "c"), (5, "u", "small", "c"), (6, "u", "small", "c"), (7, "u", other, "c"), (8, "u", other, "c"), (9, "u", big, "c")]
    where = put(spark, tmp_path, documents(spark), pages=spark.createDataFrame(pages, "page_id long, url string, html string, payload string"))
    got = {r["page_id"]: r for r in queries.op4_archives(spark, where).collect()}
    assert {k: r["refers_to"] for k, r in got.items() if r["record_type"] == "revisit"} == {1: 9, 2: 9, 7: 8}
    for k, _, html, _ in pages:
        raw = (html or "").encode()
        assert (got[k]["payload_bytes"], got[k]["payload_digest"]) == (len(raw), hashlib.sha1(raw).hexdigest())


def test_archive_members_match_zipfile(tmp_path):
    import zipfile

    w = zipwarc.ArchiveWriter(f"file://{tmp_path}")
    for k in range(50):
        payload = text(k).encode()
        w.add(k, zipwarc.warc_record(k, "http://h/", payload, hashlib.sha1(payload).hexdigest(), None))
    path, n, _ = w.close()
    with zipfile.ZipFile(path) as z:
        assert z.namelist() == [zipwarc.DATA, zipwarc.INDEX] and z.testzip() is None
        assert all(i.compress_type == zipfile.ZIP_STORED for i in z.infolist())
    back = list(zipwarc.read_archive(path, read_range=500))
    assert n == 50 and [r["page_id"] for r in back] == list(range(50)) and [r["payload"] for r in back] == [text(k).encode() for k in range(50)]


class _Bytes:
    def __init__(self, data):
        self.data = data

    def read_at(self, n, offset):
        return self.data[offset : offset + n]


def test_zip64_directory():
    """Sizes, offsets and counts that only the ZIP64 fields hold."""
    import struct

    body, name = b"payload", b"m"
    local = struct.pack("<4s5H3I2H", b"PK\x03\x04", 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 1, 20) + name + struct.pack("<HHQQ", 1, 16, len(body), len(body)) + body
    extra = struct.pack("<HHQQQ", 1, 24, len(body), len(body), 0)
    central = struct.pack("<4s6H3I5H2I", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 1, len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra
    at = len(local) + len(central)
    end = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, len(central), len(local)) + struct.pack("<4sIQI", b"PK\x06\x07", 0, at, 1) + struct.pack("<4s4H2IH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    data = local + central + end
    where, n = zipwarc.members(_Bytes(data), len(data))["m"]
    assert data[where : where + n] == body


def test_byte_bpe(spark, small):
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tokens.load_ranks(RANKS), special_tokens={})
    for where, texts in ((small, TEXTS), (DATA, all_texts(spark))):
        rows = queries.op5_byte_bpe(spark, where).collect()
        assert len(rows) == len(texts)
        for r in rows:
            ids = np.array(own.encode_ordinary(texts[r["doc_id"]] or ""), dtype="<u4")
            want = (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest())
            assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == want


def test_byte_bpe_offsets_and_round_trip(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    coded = bytebpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN, with_offsets=True)
    table = tokens.token_bytes(RANKS)
    for r in coded.collect():
        raw = (TEXTS[r["doc_id"]] or "").encode()
        for i, b, c in zip(r["ids"], r["byte_starts"], r["char_starts"], strict=True):
            assert raw[b : b + len(table[i])] == table[i]
            before = raw[:b].decode("utf-8", "ignore")
            assert c == len(before)
    assert {r["doc_id"]: r["text"] for r in bytebpe.decode_documents(coded, RANKS).collect()} == {k: t or "" for k, t in TEXTS.items()}


def test_encoders_match_the_library_on_odd_texts():
    import random

    import tiktoken

    rnd = random.Random(4)
    parts = ["a", "the", " ", "  ", "\n", "\t", "é", "ß", "中", "!", "'s", "'", "1", "😀", "\x00", "\x1c", "\x85", "Σ", "<|endoftext|>", "\r\n", "W̊", "İ", "²", "ª", "\xa0", " "]
    odd = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(3000)] + ["a" * k for k in range(60)] + [" " * k + "x" for k in range(30)]
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tokens.load_ranks(RANKS), special_tokens={})
    pack = lambda ids: np.array(ids, dtype="<u4").tobytes()
    assert tokens.byte_encoder(RANKS, public_tokenizers.PATTERN).encode(odd) == [pack(own.encode_ordinary(t)) for t in odd]
    plain = [pack(e.ids) for e in tokens.tokenizer_from_json(BYTE).encode_batch(odd, add_special_tokens=False)]
    assert tokens.byte_encoder(BYTE, public_tokenizers.PATTERN).encode(odd) == plain
    words = [pack(e.ids) for e in tokens.tokenizer_from_json(WORD).encode_batch(odd, add_special_tokens=False)]
    assert tokens.word_encoder(WORD).encode([t.encode() for t in odd]) == words


def plain_resize(image, h, w):
    """Means over areas by weights of whole and part pixels."""

    def weights(n, k):
        at = np.arange(k + 1) * (n / k)
        return np.clip(np.minimum(at[1:, None], np.arange(1, n + 1)) - np.maximum(at[:-1, None], np.arange(n)), 0, None)

    return weights(image.shape[0], h) @ image.astype(float) @ weights(image.shape[1], w).T / (image.shape[0] / h * image.shape[1] / w)


def plain_hash(image) -> str:
    small = np.round(plain_resize(image, 8, 9), 6)
    return f"{int(''.join(str(int(a < b)) for row in small for a, b in zip(row, row[1:])), 2):016x}"


def plain_tile(image) -> bytes:
    import io

    out = io.BytesIO()
    np.save(out, np.clip(np.rint(np.round(plain_resize(image, 16, 16), 6)), 0, 255).astype(np.uint8))
    return out.getvalue()


def test_media(spark, small):
    for where, texts in ((small, TEXTS), (DATA, all_texts(spark))):
        rows = queries.op6_media(spark, where).collect()
        assert len(rows) == len(texts)
        for r in rows:
            raw = (texts[r["doc_id"]] or "").encode()
            data = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
            assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
            stored = b"P5\n64 %d\n255\n" % (len(data) // 64) + data
            assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
            image = np.frombuffer(data, np.uint8).reshape(-1, 64)
            assert r["feature"] == plain_hash(image)
            tile = plain_tile(image)
            assert r["tile_sha256"] == hashlib.sha256(tile).hexdigest()


def test_images():
    import io

    rng = np.random.default_rng(0)
    for image in (rng.integers(0, 256, (37, 53), dtype=np.uint8), rng.integers(0, 256, (5, 7, 3), dtype=np.uint8)):
        assert (media.decode_image(media.encode_pgm(image)) == image).all() and (media.decode_image(media.encode_bmp(image)) == image).all()
    assert media.decode_netpbm(b"P2\n# note\n2 2\n255\n1 2\n3 4\n").tolist() == [[1, 2], [3, 4]]
    image = rng.integers(0, 256, (48, 64), dtype=np.uint8)
    assert np.allclose(media.area_resize(image, 12, 16), image.reshape(12, 4, 16, 4).mean(axis=(1, 3)))
    brute = np.kron(image, np.ones((3, 5))).reshape(9, 16, 10, 32).mean(axis=(1, 3))
    assert np.allclose(media.area_resize(image, 9, 10), brute)
    tall = rng.integers(0, 256, (9000, 64), dtype=np.uint8)
    assert np.allclose(media.area_resize(tall, 9, 8), tall.reshape(9, 1000, 8, 8).mean(axis=(1, 3)))
    assert np.load(io.BytesIO(media.npy_tile(image))).shape == (16, 16) and len(media.difference_hash(image)) == 16


def test_id_files(spark, small):
    tok = tokens.tokenizer_from_json(BYTE)
    for where, texts in ((small, TEXTS), (DATA, all_texts(spark))):
        got, at = {r["doc_id"]: r for r in queries.op7_id_files(spark, where).collect()}, 0
        assert len(got) == len(texts)
        for i in sorted(texts):
            ids = np.array([*tok.encode(texts[i] or "", add_special_tokens=False).ids, 0], dtype="<u4")
            assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
            at += len(ids)


def test_simple8b():
    import random

    rnd = random.Random(3)
    for trial in range(400):
        n, v = rnd.choice([0, 1, 2, 119, 240, 1023, 1024, 1025, 3000]), []
        while len(v) < n:
            bits = rnd.choice([0, 1, 2, 3, 5, 8, 10, 12, 16, 20, 31, 59, 60, 61, 64])
            v += [rnd.getrandbits(bits) if bits else 0] * rnd.choice([1, 2, 5, 30, 130])
        values = np.array(v[:n], dtype=np.uint64) & np.uint64(0xFFFF if trial % 3 == 0 else (1 << 64) - 1)
        words, escapes, per_block = simple8b.encode(values)
        assert (simple8b.decode(words, escapes, n) == values).all() and per_block.sum() == len(words)


def test_id_file_of_many_groups(tmp_path, monkeypatch):
    """Documents in order, and each document and block by the stored offsets."""
    monkeypatch.setattr(simple8b, "GROUP", 2)
    w, docs = simple8b.IdFileWriter(f"file://{tmp_path}", "x"), [np.arange(n, dtype=np.uint32) % 50_000 for n in (0, 1, 5000, 1024, 30_000, 7)]
    for k, ids in enumerate(docs):
        w.add(k or None, ids)
    path = w.close()[0]
    assert list(simple8b.read_id_file(path)) == [(k or None, len(d), zlib.crc32(d.astype("<u4").tobytes())) for k, d in enumerate(docs)]
    w = simple8b.IdFileWriter(f"file://{tmp_path}", "wide")
    wide = [*docs, np.array([5, 1 << 62, 7, (1 << 63) + 1], np.uint64), np.arange(3000, dtype=np.uint64) << np.uint64(51)]
    for k, ids in enumerate(wide):
        w.add(k, ids.astype(np.uint64))
    with simple8b.IdFile(w.close()[0]) as f:
        whole = np.concatenate([d.astype(np.uint64) for d in wide])
        assert all((f.document(k) == d).all() and len(f.document(k)) == len(d) for k, d in enumerate(wide))
        assert all((f.block(k) == whole[k * simple8b.BLOCK : (k + 1) * simple8b.BLOCK]).all() for k in range(len(f.block_words)))


def brute_fingerprint(raw: bytes) -> int:
    import xxhash

    words = [w for w in raw.lower().replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\r", b" ").replace(b"\x0b", b" ").replace(b"\x0c", b" ").split(b" ") if w]
    shingles = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(prints: dict[int, int]) -> dict[int, int]:
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_simhash(spark, small):
    for where, texts in ((small, TEXTS), (DATA, all_texts(spark))):
        rows = queries.op8_simhash(spark, where).collect()
        prints = {i: brute_fingerprint((t or "").encode()) for i, t in texts.items()}
        assert {r["doc_id"]: r["fingerprint"] for r in rows} == {i: f"{p:016x}" for i, p in prints.items()}
        assert {r["doc_id"]: r["component_id"] for r in rows} == brute_components(prints)


def test_simhash_links_lose_nothing(spark):
    """Random fingerprints with planted neighbours at every distance up to six, and a dense ball."""
    import random

    rnd = random.Random(9)
    prints = [rnd.getrandbits(64) for _ in range(300)]
    for base in prints[:60]:
        for d in range(1, 7):
            x = base
            for b in rnd.sample(range(64), d):
                x ^= 1 << b
            prints.append(x)
    centre = rnd.getrandbits(64)
    prints += [centre ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(a)]
    prints = list(dict.fromkeys(prints))
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    got = simhash.components(simhash.links(spark.createDataFrame(signed, "fp long"))).collect()
    want = brute_components(dict(enumerate(prints)))
    groups = defaultdict(set)
    for i, c in want.items():
        groups[c].add(signed[i][0])
    expected = {frozenset(g) for g in groups.values() if len(g) > 1}
    found = defaultdict(set)
    for r in got:
        found[r["root"]].add(r["node"])
    assert {frozenset(g) for g in found.values()} == expected


def test_manhattan_is_a_lower_bound():
    rng = np.random.default_rng(5)
    a, b = (rng.integers(0, 1 << 63, 2000, dtype=np.uint64) for _ in range(2))
    x, y = simhash.embedding(a), simhash.embedding(b)
    counts = lambda v: np.array([[int(e) >> 2 * k & 3 for k in range(32)] for e in v])
    assert (simhash.manhattan(x, y) == np.abs(counts(x) - counts(y)).sum(axis=1)).all()
    assert (simhash.manhattan(x, y) <= np.bitwise_count(a ^ b)).all()


SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name,label,at", [("op9_toxicity", "toxic", 0.5), ("op10_quality", "quality", 0.3)])
def test_held_out_accuracy(spark, name, label, at):
    rows = queries.QUERIES[name](spark, SF).collect()
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= at)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in held]) >= 0.95


def test_classifiers_without_both_labels(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for labels in ([], [(5, 1, 1), (6, 1, 1)], [(None, 0, 1), (7, None, None)]):
        table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        for module, column in ((toxicity, "toxicity_score"), (quality, "quality_score")):
            out = module.fit(docs, table).scored(docs)
            assert out.columns == [*docs.columns, column] and all(0 <= r[column] <= 1 for r in out.collect())


def test_classifier_on_odd_texts(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.createDataFrame([(k, k % 2, (k + 1) % 2) for k in TEXTS], "doc_id long, quality int, toxic int")
    for module, column in ((toxicity, "toxicity_score"), (quality, "quality_score")):
        out = module.fit(docs, labels).scored(docs).collect()
        assert len(out) == len(TEXTS) and all(0 <= r[column] <= 1 for r in out)
        assert {r["doc_id"]: r["text"] for r in out} == TEXTS
