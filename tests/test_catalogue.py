"""Every query with SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from laborline.queries import QUERIES, SQL

from .conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return round(float(v), 6) if type(v).__name__ == "Decimal" else str(v) if type(v).__name__ == "date" else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    want = duck.sql(SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    got_rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got_rows == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


def test_every_query_has_sql_or_says_why():
    assert set(QUERIES) - set(SQL) == {"sequence_ratio"}


def test_sequence_ratio_is_difflibs(spark):
    from difflib import SequenceMatcher

    rows = QUERIES["sequence_ratio"](spark, DATA).collect()
    assert rows
    for r in rows:
        assert r["ratio"] == round(SequenceMatcher(None, r["id_1"].lower(), r["id_2"].lower()).ratio(), 4)


def test_sequence_ratio_has_all_names(spark):
    names = {r["p_name"] for r in spark.read.parquet(f"{DATA}/part.parquet").select("p_name").collect()}
    keys = {n: {*n.split(" "), f"prefix3 {n[:3]}"} for n in names if n is not None}
    want = {(a, b) for a in keys for b in keys if a < b and keys[a] & keys[b]}
    assert {(r["id_1"], r["id_2"]) for r in QUERIES["sequence_ratio"](spark, DATA).collect()} == want


def test_every_fiftieth_vector_is_asked(spark):
    asked = {r["vec_id"] for r in spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id").collect() if r["vec_id"] % 50 == 0}
    assert {r["query"] for r in QUERIES["cosine_topk_many"](spark, DATA).collect()} == asked


def test_many_searches_are_products_of_blocks(spark):
    """Not an expression for each pair, at which 50,000 vectors took minutes."""
    df = QUERIES["cosine_topk_many"](spark, DATA)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


@pytest.mark.parametrize("blocks, k, kind", [((32_768, 16_384), 20, "float"), ((7, 5), 3, "double"), ((64, 9), 1, "float"), ((400, 3), 500, "float")])
def test_many_searches_are_exact_on_odd_vectors(spark, monkeypatch, blocks, k, kind):
    """Copies, nulls, no length, other lengths, not-a-number, tiny and huge ones: as by the score of every pair."""
    import random

    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from laborline.functions.similarity import cosine
    from laborline.operators import vector

    monkeypatch.setattr(vector, "BLOCK_ROWS", blocks[0], raising=False)
    monkeypatch.setattr(vector, "BLOCK_QUERIES", blocks[1], raising=False)
    chance = random.Random(5)
    near = [1.0, 2.0, -1.0, 0.5]
    rows = [(i, [chance.gauss(0, 1) for _ in range(4)]) for i in range(200)] + [(200 + i, near) for i in range(60)] + [(260 + i, [x * (1 + i * 1e-7) + i * 1e-9 for x in near]) for i in range(60)]
    big = 1e200 if kind == "double" else 1e38
    for v in (None, [], [0.0] * 4, [1.0, None, 2.0, 3.0], [1.0, 2.0], [float("nan"), 1.0, 1.0, 1.0], [float("inf"), 1.0, 0.0, 1.0], [big] * 4, [1 / big] * 4, [-0.0, 0.0, 0.0, 0.0], [-1.0, -2.0, 1.0, -0.5]):
        rows += [(len(rows), v), (len(rows) + 1, v)]
    rows += [(None, near), (7, near)]
    docs = spark.createDataFrame(rows, f"id long, e array<{kind}>")
    asked = docs.filter("id % 3 = 0 or id >= 320 or id is null").select(F.col("id").alias("query"), F.col("e").alias("q"))
    pairs = docs.crossJoin(asked).select("query", "id", cosine(F.col("e"), F.col("q")).alias("score"))
    want = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc("id")))).filter(F.col("rank") <= k)
    got = vector.top_k_many(docs, asked, k, "id", "e")
    assert got.schema.simpleString() == want.schema.simpleString()
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_many_searches_without_rows_or_queries(spark):
    from laborline.operators import vector

    docs = spark.createDataFrame([(1, [1.0, 2.0])], "id long, e array<float>")
    asked = docs.selectExpr("id as query", "e as q")
    assert vector.top_k_many(docs.limit(0), asked, 2, "id", "e").count() == 0 and vector.top_k_many(docs, asked.limit(0), 2, "id", "e").count() == 0
