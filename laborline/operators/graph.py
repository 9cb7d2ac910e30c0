"""The job graph: vertices, edges, neighbours, curated views, representative paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parse, text, vocab
from ..session import checkpointed


def vertices(values: DataFrame, name: str, label: str, prefix: str) -> DataFrame:
    """id, name, label of every different value."""
    return values.select(F.col(name).alias("name")).filter("name is not null and name != ''").distinct().select(text.stable_id(F.col("name"), 16, prefix).alias("id"), "name", F.lit(label).alias("label"))


def edges(df: DataFrame, source: Column, targets: Column, source_prefix: str, target_prefix: str, kind: str) -> DataFrame:
    """start, end, kind with the number of rows behind each, from a source and an array of targets in each row."""
    rows = df.select(source.alias("s"), F.explode(F.array_distinct(targets)).alias("t")).filter("s is not null and t is not null and t != ''")
    counted = rows.groupBy("s", "t").agg(F.count("*").alias("weight"))  # ids are hashed once an edge, not once a row
    return counted.select(text.stable_id(F.col("s"), 16, source_prefix).alias("start"), text.stable_id(F.col("t"), 16, target_prefix).alias("end"), "weight", F.lit(kind).alias("kind"))


def path_edges(df: DataFrame, job: str, path_text: str, kind: str, chained: bool = True) -> DataFrame:
    """Promotion or transfer edges out of written paths. Every step after the job is a direct target, or only the last."""
    return edges(df, F.col(job), parse.path_targets(F.col(job), F.col(path_text), chained), "job_", "job_", kind)


def resolved(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges with the names of both ends, in a fixed order."""
    ends = vertices.select("id", "name")
    a = ends.select(F.col("id").alias("start"), F.col("name").alias("source_job"))
    b = ends.select(F.col("id").alias("end"), F.col("name").alias("target_job"))
    return edges.join(a, "start").join(b, "end").orderBy("source_job", "kind", "target_job")


def normalized(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each edge once, without loops; the vertices that have an edge."""
    once = edges.filter(F.col("start") != F.col("end")).dropDuplicates(["start", "end", "kind"])
    ends = once.select(F.col("start").alias("id")).union(once.select(F.col("end").alias("id"))).distinct()
    return vertices.join(ends, "id", "left_semi"), once


def is_curated(name: Column, members: list[str] | None = None) -> Column:
    keep = text.any_of(name, vocab.CURATED_INCLUDE)
    if members:
        keep = keep | name.isin(*members)
    return keep & ~text.any_of(name, vocab.CURATED_EXCLUDE) & ~name.isin(*vocab.CURATED_EXCLUDE_EXACT)


def display_name(name: Column) -> Column:
    return F.coalesce(*[F.when(name == k, F.lit(v)) for k, v in vocab.DISPLAY_ALIASES.items()], name)


def curated(named_edges: DataFrame, members: list[str] | None = None) -> DataFrame:
    """Edges between curated jobs under their display names; aliases are merged, loops dropped."""
    shown = named_edges.withColumns({"source_job": display_name(F.col("source_job")), "target_job": display_name(F.col("target_job"))})
    kept = shown.filter(is_curated(F.col("source_job"), members) & is_curated(F.col("target_job"), members) & (F.col("source_job") != F.col("target_job")))
    return kept.groupBy("source_job", "target_job", "kind").agg(F.sum("weight").alias("weight"))


def neighbours(nodes: DataFrame, key: str, related: DataFrame, name: str, out: str, most: int) -> DataFrame:
    """Nodes with up to ``most`` related names in order; an empty array for nodes without any."""
    from .stats import first_k

    ranked = first_k(related.select(key, name).filter(F.col(name).isNotNull()).distinct(), [key], [F.asc(name)], most)
    lists = ranked.groupBy(key).agg(F.array_sort(F.collect_list(name)).alias(out))
    return nodes.join(lists, key, "left").withColumn(out, F.coalesce(out, F.array().cast("array<string>")))


def representative_paths(named_edges: DataFrame, kind: str = "PROMOTE_TO", n: int = 3) -> DataFrame:
    """Jobs with most different targets: targets sorted, count; at least three rows."""
    found = named_edges.filter((F.col("kind") == kind) & (F.col("source_job") != F.col("target_job"))).groupBy("source_job").agg(F.array_sort(F.collect_set("target_job")).alias("targets"), F.count_distinct("target_job").alias("edge_count"))
    return found.orderBy(F.desc("edge_count"), "source_job").limit(max(3, n))


def search(named_edges: DataFrame, keywords: list[str], per_keyword: int = 10, most: int = 8) -> DataFrame:
    """Edges that mention a keyword, scored by hits with two more for promotions."""
    hit = lambda k: (F.lower("source_job").contains(k.lower()) | F.lower("target_job").contains(k.lower())).cast("int")
    order = ["source_job", "target_job", "kind"]
    rows = None
    for k in keywords:
        part = named_edges.filter(hit(k) == 1).orderBy(*order).limit(per_keyword).select(*order, F.lit(1).alias("_hit"))
        rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        return named_edges.select(*order).limit(0).withColumn("score", F.lit(0))
    scored = rows.groupBy(*order).agg(F.sum("_hit").alias("_hits")).withColumn("score", F.col("_hits") + F.when(F.col("kind") == "PROMOTE_TO", 2).otherwise(0))
    return scored.drop("_hits").orderBy(F.desc("score"), *order).limit(most)


def statistics(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    return edges.groupBy("kind").agg(F.count("*").alias("n")).unionByName(vertices.groupBy(F.col("label").alias("kind")).agg(F.count("*").alias("n")))


MOST_HOPS = 8


def reachable(edges: DataFrame, start: list[str], hops: int) -> DataFrame:
    """(id, hops): the fewest steps from the start vertices, MOST_HOPS at most; each step is a join, and a checkpoint ends its plan."""
    if not 0 <= hops <= MOST_HOPS:
        raise ValueError(f"hops must be 0 to {MOST_HOPS}")
    seen = edges.sparkSession.createDataFrame([(s, 0) for s in dict.fromkeys(start)], "id string, hops int")
    edges = checkpointed(edges.select("start", "end").distinct())
    for h in range(1, hops + 1):
        step = seen.filter(F.col("hops") == h - 1).join(edges, F.col("id") == F.col("start")).select(F.col("end").alias("id")).distinct()
        seen = checkpointed(seen.unionByName(step.join(seen.select("id"), "id", "left_anti").withColumn("hops", F.lit(h))))
    return seen
