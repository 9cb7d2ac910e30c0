"""Vector search, keyword chunk search and keyword extraction."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StructField, StructType

from ..functions.nearest import nearest
from ..functions.parse import embedding_tokens
from ..functions.similarity import DIMENSION, cosine, token_slot

#: Rows and queries of a block, on average. A row goes to as many tasks as there are blocks of queries, a query to as many as there are of rows.
BLOCK_ROWS, BLOCK_QUERIES = 32_768, 16_384


def hashed(df: DataFrame, id_col: str, body: str, dimension: int = DIMENSION) -> DataFrame:
    """id, slot, x: the entries of each text's hashed vector, of unit length; no rows for texts without tokens."""
    slots = df.select(id_col, F.explode(embedding_tokens(F.col(body))).alias("_t")).select(id_col, token_slot(F.col("_t"), dimension).alias("_s"))
    sums = slots.groupBy(id_col, F.col("_s.slot").alias("slot")).agg(F.sum("_s.sign").alias("x")).filter("x != 0")
    norms = sums.groupBy(id_col).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("_l"))
    return sums.join(norms, id_col).select(id_col, "slot", (F.col("x") / F.col("_l")).alias("x"))


def embed(df: DataFrame, id_col: str, body: str, out: str = "embedding", dimension: int = DIMENSION) -> DataFrame:
    """``df`` with an array of ``dimension`` entries; zeros for texts without tokens."""
    entries = hashed(df, id_col, body, dimension).groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("slot", "x"))).alias("_m"))
    spread = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(dimension - 1).cast("long")), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0.0)))
    return df.join(entries, id_col, "left").withColumn(out, spread).drop("_m")


def top_k(docs: DataFrame, query: list[float], k: int, id_col: str, vector: str = "embedding", least: float | None = None) -> DataFrame:
    """The ``k`` nearest by cosine, ties by id; those under ``least`` are taken out afterwards. The query is a literal."""
    q = F.array(*[F.lit(float(x)) for x in query])
    best = docs.withColumn("score", cosine(F.col(vector), q)).orderBy(F.desc("score"), F.asc(id_col)).limit(k)
    return best if least is None else best.filter(F.col("score") >= least)


def top_k_many(docs: DataFrame, queries: DataFrame, k: int, id_col: str, vector: str = "embedding") -> DataFrame:
    """query, id, score, rank: the queries (query, q) against all rows, exact, ties by id.

    Rows and queries are dealt to blocks, and every pair of blocks is a group of its own, which a task multiplies as matrices;
    of each query it hands on its ``k`` best, so work is that of all pairs, and memory that of a block.
    """
    plain = isinstance(docs.schema[vector].dataType.elementType, FloatType) and docs.schema[vector].dataType == queries.schema["q"].dataType
    kind = "array<float>" if plain else "array<double>"
    n_rows, n_queries = (max(1, -(-df.count() // size)) for df, size in ((docs, BLOCK_ROWS), (queries, BLOCK_QUERIES)))
    own = lambda n, *of: F.pmod(F.xxhash64(*of), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = docs.select(own(n_rows, id_col, vector).alias("_r"), every(n_queries).alias("_s"), F.col(id_col).alias("id"), F.col(vector).cast(kind).alias("v"))
    asked = queries.select(own(n_queries, "query", "q").alias("_s"), every(n_rows).alias("_r"), "query", F.col("q").cast(kind).alias("v"))

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.take(pc.sort_indices(left.column("id"), null_placement="at_start"))
        q, r, score = nearest(left.column("v"), right.column("v"), k)
        return pa.table([right.column("query").take(q), left.column("id").take(r), pa.array(score)], names=["query", "id", "score"])

    schema = StructType([StructField("query", queries.schema["query"].dataType), StructField("id", docs.schema[id_col].dataType), StructField("score", DoubleType())])
    best = rows.groupBy("_r", "_s").cogroup(asked.groupBy("_r", "_s")).applyInArrow(work, schema)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc("id")))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).withColumnRenamed("id", id_col)


def question_keywords(question: Column, most: int = 20) -> Column:
    """Latin words and Chinese runs of two letters or more, in order, each once."""
    low = F.lower(question)
    return F.slice(F.array_distinct(F.regexp_extract_all(low, F.lit(r"([a-z0-9+#.]{2,}|[\x{4e00}-\x{9fff}]{2,})"), F.lit(1))), 1, most)


def chunk_score(body: Column, keywords: list[str]) -> Column:
    """Two for each keyword of three letters or more that is there, one for a shorter one."""
    low, total = F.lower(body), F.lit(0)
    for k in keywords:
        total = total + F.when(F.contains(low, F.lit(k.lower())), 2 if len(k) >= 3 else 1).otherwise(0)
    return total


def chunk_top_k(chunks: DataFrame, body: str, keywords: list[str], order: list[Column], k: int = 6, forced: Column | None = None) -> DataFrame:
    """The best ``k`` chunks with any hit; chunks of ``forced`` sources come first, hit or not."""
    scored = chunks.withColumn("score", chunk_score(F.col(body), keywords)).withColumn("_f", forced.cast("int") if forced is not None else F.lit(0))
    return scored.filter((F.col("score") > 0) | (F.col("_f") == 1)).orderBy(F.desc("_f"), F.desc("score"), *order).limit(k).drop("_f")


def recent_history(turns: DataFrame, conversation: str, turn: str, role: str, body: str, k: int = 12) -> DataFrame:
    """The last ``k`` turns of users and assistants with text, of every conversation."""
    said = turns.filter(F.col(role).isin("user", "assistant") & (F.trim(F.col(body)) != ""))
    return said.withColumn("_n", F.row_number().over(Window.partitionBy(conversation).orderBy(F.desc(turn), F.desc(role)))).filter(F.col("_n") <= k).drop("_n")
