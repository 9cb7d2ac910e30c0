"""Repeated rows, null ids, empty tables and clashing columns in every operator and stage; held-out figures; compiled rules."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from laborline.llm import features, quality, queries, toxicity

from .fixtures import documents, text, write
from .test_operators import SF


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Ids that repeat with equal and other texts, ids that are null, ties, columns whose names operators use themselves."""
    rows = [(1, "same text here for all", 1), (1, "same text here for all", 2), (1, "another text", 3), (2, None, 4), (2, "", 5), (None, "no id but words", 6), (None, None, 7), (None, "no id but words", 8), (3, text(3, 300), 9), (4, text(4, 9000), 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int").selectExpr("*", "'en' as lang", "'s' as source", "0L as n_chars", "0 as shard", "0 as slot", "0 as node", "0 as root", "0 as id", "0 as body", "0 as item", "0 as score", "0 as _b", "0 as label")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, None, 1), (None, 1, 1), (3, 1, 0), (4, 0, 1)], "doc_id long, quality int, toxic int")
    return write(spark, tmp_path_factory.mktemp("odd"), docs, labels=labels), rows


TWELVE = [n for n in sorted(queries.QUERIES) if n not in ("op4_archives", "op3_packing", "op1_slots", "shard_loads", "op12_collocations")]


@pytest.mark.parametrize("name", TWELVE)
def test_each_row_has_a_result(spark, odd, name):
    got = queries.QUERIES[name](spark, odd[0]).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _, _ in odd[1])


def test_places_of_repeated_rows(spark, odd):
    rows, place = queries.op1_slots(spark, odd[0]).collect(), defaultdict(list)
    assert Counter((r["doc_id"], r["text_crc32"]) for r in rows) == Counter((i, zlib.crc32((t or "").encode())) for i, t, _ in odd[1])
    for r in rows:
        place[r["shard"]].append(r["slot"])
    assert all(sorted(p) == list(range(len(p))) for p in place.values())
    packed, bins = queries.op3_packing(spark, odd[0]).collect(), defaultdict(list)
    for r in packed:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == Counter(i for i, _, _ in odd[1])
    for b in bins.values():
        b.sort()
        assert b[0][0] == 0 and all(x[0] + x[1] == y[0] for x, y in zip(b, b[1:])) and sum(b[-1]) <= 4096


def test_repeated_rows_of_id_files_and_fingerprints(spark, odd):
    got = sorted((r["start"], r["n_tokens"]) for r in queries.op7_id_files(spark, odd[0]).collect())
    assert got[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(got, got[1:]))
    prints = defaultdict(set)
    for r in queries.op8_simhash(spark, odd[0]).collect():
        prints[r["fingerprint"]].add(r["component_id"])
    assert all(len(c) == 1 for c in prints.values())


def test_stages_on_odd_rows(spark, odd, tmp_path):
    docs = spark.read.parquet(f"{odd[0]}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, odd[0])
        assert out.columns == docs.columns and out.count() <= docs.count(), name
        assert stage(spark, docs.limit(0), odd[0]).count() == 0
    kept = corpus_pipeline.drop_near_copies(spark, docs, odd[0]).collect()
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in kept) == sorted([("1", "same text here for all"), ("1", "another text"), ("2", ""), ("3", text(3, 300)), ("4", text(4, 9000)), ("None", "no id but words")])
    packed = corpus_pipeline.pack_sequences(spark, docs, odd[0])
    assert packed.filter("piece = 0").count() == len(odd[1])


def test_pipeline_on_an_empty_table(spark, tmp_path):
    where = write(spark, tmp_path, documents(spark).limit(0), labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert corpus_pipeline.run(spark, where).count() == 0


def area(scores: list[float], labels: list[int]) -> float:
    """The chance that a one is scored above a zero, half for ties."""
    ones, zeros = ([s for s, y in zip(scores, labels) if y == k] for k in (1, 0))
    return float(np.mean([(a > b) + (a == b) / 2 for a in ones for b in zeros]))


@pytest.mark.parametrize("name,label,at,recall,precision,auc", [("op9_toxicity", "toxic", 0.5, 0.9, 0.95, 0.97), ("op10_quality", "quality", 0.3, 0.97, 0.95, 0.97)])
def test_held_out_figures(spark, name, label, at, recall, precision, auc):
    where = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{where}/labels.parquet").collect() if r[label] is not None}
    held = [r for r in queries.QUERIES[name](spark, where).collect() if r["held_out"] and r["doc_id"] in labels]
    got, want = [r["predicted"] for r in held], [labels[r["doc_id"]] for r in held]
    both = sum(a and b for a, b in zip(got, want))
    assert both / sum(want) >= recall and both / sum(got) >= precision and area([r["score"] for r in held], want) >= auc


def test_compiled_rules_are_the_rules(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs, labels)
    assert model.rules
    for r in model.scored(docs).collect():
        stats = features.quality_features((r["text"] or "").encode())
        total = model.intercept + sum(w for rule, w in model.rules if all(stats[k] <= b if m else stats[k] > b for k, m, b in rule))
        assert abs(r["quality_score"] - 1 / (1 + np.exp(-total))) < 1e-9


def test_calibration_is_the_pooled_one(spark):
    """Scores rise with the margin, and each level is the mean label of the calibration rows in it (pool adjacent violators)."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(docs, labels)
    x, y = np.array(model.calibration.boundaries.toArray()), np.array(model.calibration.predictions.toArray())
    assert (np.diff(x) >= 0).all() and (np.diff(y) >= 0).all() and 0 <= y.min() and y.max() <= 1


def test_toxic_features_by_a_plain_loop():
    lexicon = frozenset({"bad", "awfu*"})
    raw = "You BAD thing!! awfully b@d, dich? nice. BAD you"
    got = dict(zip(features.TOXIC_FEATURES, features.toxic_features(raw.encode(), lexicon, {}), strict=True))
    words = ["you", "bad", "thing", "awfully", "b@d", "dich", "nice", "bad", "you"]
    hits = [k for k, w in enumerate(words) if w == "bad" or w.startswith("awfu")]
    you = [k for k, w in enumerate(words) if w in features.SECOND_PERSON]
    assert got["hit_density"] == len(hits) / 9 and got["you_density"] == len(you) / 9
    assert got["near_you"] == sum(any(abs(a - b) <= features.NEAR for b in you) for a in hits) / 9
    assert got["exclamations"] == raw.count("!") / len(raw) + raw.count("?") / len(raw) and got["odd_words"] == 1 / 9 and got["odd_hits"] == 1
    assert got["upper"] == sum(c.isupper() for c in raw) / len(raw) and got["caps_words"] == 2 / 9 and got["first_hit"] == 2 / 9
