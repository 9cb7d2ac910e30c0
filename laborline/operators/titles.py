"""Job title standardization: profiles, blocked candidate pairs, rule decisions, components, canonical names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parse, text
from ..functions.similarity import sequence_ratio
from ..session import checkpointed
from .stats import ordered_distinct

MAX_BLOCK = 200


def title_profiles(df: DataFrame, title: str = "job_title", company: str = "company_name", city: str = "city", description: str = "job_description", order: str = "record_id") -> DataFrame:
    """One row per raw title: normalized name, family, tokens, count, first five companies and cities, first description."""
    rows = df.select(F.col(title).alias("raw_job_name"), F.col(company).alias("company"), F.col(city).alias("city"), F.col(description).alias("description"), F.col(order).alias("_order")).filter("raw_job_name is not null")
    base = rows.groupBy("raw_job_name").agg(F.count("*").alias("occurrence_count"), F.min_by("description", F.when(F.col("description").isNotNull(), F.col("_order"))).alias("sample_description"))
    companies = ordered_distinct(rows, ["raw_job_name"], "company", F.col("_order"), "sample_companies", 5)
    cities = ordered_distinct(rows, ["raw_job_name"], "city", F.col("_order"), "sample_cities", 5)
    empty = F.array().cast("array<string>")
    joined = base.join(companies, "raw_job_name", "left").join(cities, "raw_job_name", "left")
    named = joined.withColumns({"sample_companies": F.coalesce("sample_companies", empty), "sample_cities": F.coalesce("sample_cities", empty), "normalized_job_name": text.job_title(F.col("raw_job_name"))})
    return named.withColumns(
        {"title_id": text.stable_id(F.col("raw_job_name")), "job_family": text.job_family(F.col("normalized_job_name")), "title_tokens": parse.title_tokens(F.col("normalized_job_name"))}
    ).withColumn("primary_tokens", parse.primary_tokens(F.col("title_tokens")))


def block_keys(family: Column, name: Column, tokens: Column) -> Column:
    """array<struct(kind, key)>: family, the first two and three letters, and the chief tokens."""
    pair = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    fixed = F.array(pair("family", family), pair("prefix2", F.left(name, F.lit(2))), pair("prefix3", F.left(name, F.lit(3))))
    return F.filter(F.array_distinct(F.concat(fixed, F.transform(tokens, lambda t: pair("token", t)))), lambda p: p["key"].isNotNull() & (p["key"] != ""))


def blocked_pairs(df: DataFrame, id_col: str, keys: Column, max_block: int = MAX_BLOCK) -> DataFrame:
    """(id_1, id_2), id_1 < id_2, for ids that share a key; keys that too many share are skipped by rule.

    Block sizes come from an aggregate, so an oversize block is dropped before any of its rows meet.
    """
    rows = df.select(F.col(id_col).alias("id"), F.explode(keys).alias("k")).select("id", F.col("k.kind").alias("kind"), F.col("k.key").alias("key")).distinct()
    usable = rows.groupBy("kind", "key").agg(F.count("*").alias("n")).filter((F.col("n") > 1) & (F.col("n") <= max_block)).select("kind", "key")
    small = rows.join(usable, ["kind", "key"])
    left, right = small.withColumnRenamed("id", "id_1"), small.withColumnRenamed("id", "id_2")
    return left.join(right, ["kind", "key"]).filter("id_1 < id_2").select("id_1", "id_2").distinct()


def pair_features(pairs: DataFrame, profiles: DataFrame, edit: Column | None = None) -> DataFrame:
    """Pairs with features and the recall score. ``edit`` replaces difflib's ratio (columns normalized_job_name_1 and _2)."""
    cols = ["title_id", "raw_job_name", "normalized_job_name", "job_family", "title_tokens", "sample_companies", "sample_cities"]
    side = lambda k: profiles.select(*[F.col(c).alias("id_" + k if c == "title_id" else f"{c}_{k}") for c in cols])
    df = pairs.join(side("1"), "id_1").join(side("2"), "id_2")
    a, b = F.coalesce("normalized_job_name_1", F.lit("")), F.coalesce("normalized_job_name_2", F.lit(""))
    both = lambda c: F.array_intersect(F.col(f"{c}_1"), F.col(f"{c}_2"))
    union = F.size(F.array_union("title_tokens_1", "title_tokens_2"))
    df = df.withColumns(
        {
            "edit_raw": edit if edit is not None else sequence_ratio(a, b), "token_overlap_terms": F.array_sort(both("title_tokens")),
            "jaccard_raw": F.coalesce(F.try_divide(F.size(both("title_tokens")), union), F.lit(0.0)),
            "same_family": F.col("job_family_1") == F.col("job_family_2"), "same_normalized": (a == b) & (a != ""),
            "contains_relation": (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a)),
            "company_overlap_count": F.size(both("sample_companies")), "city_overlap_count": F.size(both("sample_cities")),
        }
    )
    yes = lambda c, w: F.when(c, w).otherwise(0.0)
    score = yes(F.col("same_normalized"), 0.45) + yes(F.col("same_family"), 0.15) + yes(F.col("contains_relation"), 0.15) + 0.15 * F.col("edit_raw") + 0.20 * F.col("jaccard_raw")
    score = score + yes(F.col("company_overlap_count") > 0, 0.08) + yes(F.col("city_overlap_count") > 0, 0.05)
    return df.withColumns(
        {"edit_similarity": F.round("edit_raw", 4), "token_jaccard": F.round("jaccard_raw", 4), "token_overlap_count": F.size("token_overlap_terms"), "rule_recall_score": F.least(F.lit(1.0), F.round(score, 4))}
    ).drop("edit_raw", "jaccard_raw")


def is_recalled() -> Column:
    c = F.col
    return (
        c("same_normalized") | (c("rule_recall_score") >= 0.45) | (c("same_family") & (c("edit_similarity") >= 0.70)) | (c("contains_relation") & c("same_family"))
        | ((c("token_jaccard") >= 0.34) & c("same_family")) | ((c("company_overlap_count") > 0) & (c("token_overlap_count") > 0))
        | ((c("city_overlap_count") > 0) & (c("edit_similarity") >= 0.72))
    )


def decided(features: DataFrame) -> DataFrame:
    """is_same_standard_job and confidence by rules alone."""
    score = F.col("rule_recall_score")
    same = (F.col("same_normalized") & (score >= 0.80)) | (F.col("contains_relation") & F.col("same_family") & (score >= 0.72))
    return features.withColumns({"is_same_standard_job": same, "confidence": F.when(same, F.greatest(score, F.lit(0.75))).otherwise(F.least(score, F.lit(0.49))), "merge_reason": F.when(same, "rule_same").otherwise("rule_different")})


def components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(id, cluster): the smallest id reachable over undirected edges (a, b). Each round every node takes the least label
    of its neighbours and then of its label's own node; rounds end in a checkpoint."""
    both = checkpointed(edges.select("a", "b").union(edges.select("b", "a")).filter("a != b").distinct())
    labels = checkpointed(nodes.select("id", F.col("id").alias("cluster")).distinct())
    for _ in range(max_rounds):
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("cluster").alias("near"))
        stepped = labels.join(near, labels.id == near.a, "left").select("id", F.least("cluster", F.coalesce("near", "cluster")).alias("next"), "cluster")
        jump = stepped.select(F.col("id").alias("j"), F.col("next").alias("jumped"))
        moved = checkpointed(stepped.join(jump, stepped.next == jump.j, "left").select("id", F.least("next", F.coalesce("jumped", "next")).alias("next"), "cluster"))
        changed = moved.filter("next != cluster").limit(1).count()
        labels = moved.select("id", F.col("next").alias("cluster"))
        if not changed:
            return labels
    raise RuntimeError("components did not settle")


def name_bonus(name: Column) -> Column:
    has = lambda *w: text.any_of(name, list(w))
    return F.when(has("工程师"), 3).otherwise(0) + F.when(has("开发"), 2).otherwise(0) + F.when(has("经理", "分析师", "架构师"), 2).otherwise(0)


def canonical_names(clustered: DataFrame) -> DataFrame:
    """(cluster, standard_job_name): the heaviest name; ties by length, then by name, larger first."""
    count = F.greatest(F.lit(1), F.col("occurrence_count"))
    normal = clustered.select("cluster", F.col("normalized_job_name").alias("name"), (count + 0.2 * F.char_length("normalized_job_name")).alias("w"))
    raw = clustered.select("cluster", F.col("raw_job_name").alias("name"), (0.5 * count).alias("w"))
    summed = normal.unionByName(raw).filter("name is not null").groupBy("cluster", "name").agg(F.sum("w").alias("w"))
    rank = F.struct(F.round(F.col("w") + name_bonus(F.col("name")), 6), F.char_length("name"), F.col("name"))
    return summed.groupBy("cluster").agg(F.max_by("name", rank).alias("standard_job_name"))


def title_mapping(profiles: DataFrame, pairs: DataFrame, least_confidence: float = 0.60) -> DataFrame:
    """title_id, raw and normalized name, standard name, confidence, reason, count, family, cluster size."""
    good = pairs.filter(F.col("is_same_standard_job") & (F.col("confidence") >= least_confidence))
    clusters = components(profiles.select(F.col("title_id").alias("id")), good.select(F.col("id_1").alias("a"), F.col("id_2").alias("b")))
    clustered = profiles.join(clusters.withColumnRenamed("id", "title_id"), "title_id")
    sizes = clustered.groupBy("cluster").agg(F.count("*").alias("cluster_size"))
    touched = good.select(F.explode(F.array("id_1", "id_2")).alias("title_id"), "confidence", "merge_reason").groupBy("title_id").agg(F.max("confidence").alias("_c"), F.array_join(F.array_sort(F.collect_set("merge_reason")), "|").alias("_r"))
    out = clustered.join(canonical_names(clustered), "cluster").join(sizes, "cluster").join(touched, "title_id", "left")
    return out.select(
        "title_id", "raw_job_name", "normalized_job_name", "standard_job_name", (F.col("cluster_size") > 1).alias("is_same_standard_job"),
        F.round(F.greatest(F.lit(0.80), F.coalesce("_c", F.lit(0.80))), 4).alias("confidence"), F.coalesce("_r", F.lit("self_standardized")).alias("merge_reason"),
        "occurrence_count", "job_family", "cluster_size",
    )


def standardize(df: DataFrame, title: str = "job_title", order: str = "record_id") -> tuple[DataFrame, DataFrame]:
    """(df with standard_job_name, mapping): the whole chain. The mapping joins on the raw title."""
    profiles = checkpointed(title_profiles(df, title=title, order=order))
    pairs = blocked_pairs(profiles, "title_id", block_keys(F.col("job_family"), F.col("normalized_job_name"), F.col("primary_tokens")))
    judged = checkpointed(decided(pair_features(pairs, profiles).filter(is_recalled())))
    mapping = checkpointed(title_mapping(profiles, judged))
    names = mapping.select(F.col("raw_job_name").alias(title), "standard_job_name")
    return df.join(names, title, "left"), mapping


def backfilled(df: DataFrame, column: str, lookups: list[tuple[DataFrame, str]]) -> DataFrame:
    """Fills NULLs of ``column`` from (table with key and ``column``, key) in order; a key's least value is used."""
    out = df
    for k, (table, key) in enumerate(lookups):
        values = table.filter(F.col(key).isNotNull() & F.col(column).isNotNull()).groupBy(key).agg(F.min(column).alias(f"_v{k}"))
        out = out.join(values, key, "left").withColumn(column, F.coalesce(column, f"_v{k}")).drop(f"_v{k}")
    return out


def with_group_size(df: DataFrame, group: str, out: str = "cluster_size") -> DataFrame:
    """``df`` with the number of rows of each row's group; the null group counts as one. Groups are counted before the shuffle."""
    sizes = df.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias(out))
    return df.join(sizes, F.col(group).eqNullSafe(F.col("_g")), "left").drop("_g")


def with_extractions(df: DataFrame, extracted: DataFrame, key: str) -> DataFrame:
    """``df`` with the columns of an extraction a row (by ``key``); rows without one keep NULLs, columns of both keep ``df``'s."""
    return df.join(extracted.drop(*[c for c in extracted.columns if c in df.columns and c != key]), key, "left")
