"""Postings of a job rolled up to one node of the graph, and to one document of the knowledge base.

``order`` is a column that no two rows share: what stands first by it decides ties, and which row is the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

#: Of each field of a node, the columns that its values come from.
NODE_MODES = {
    "job_category": ("job_category", "job_family", "job_family_extracted"), "job_level": ("job_level",), "degree_requirement": ("degree_requirement", "education_requirement"), "major_requirement": ("major_requirement",),
    "experience_requirement": ("experience_requirement",),
}
NODE_SUMMARY = ("raw_requirement_summary", "job_summary", "job_desc", "job_description_clean", "job_description")
ALIASES = ("job_name", "job_title", "job_title_norm", "normalized_job_title", "standard_job_name")
FIRST = ("job_category", "job_level", "degree_requirement", "major_requirement", "practice_requirement", "experience_requirement", "raw_requirement_summary")
LISTS = ("certificate_requirement", "hard_skills", "tools_or_tech_stack", "soft_skills", "vertical_paths", "transfer_paths")
LEAST_CONFIDENCE = 0.6


def _clean(c: str) -> Column:
    return text.clean_text(F.col(c), entities=False)


def modes(df: DataFrame, key: str, fields: dict[str, tuple[str, ...]], order: str) -> DataFrame:
    """key and, of each field, the commonest value of its columns together; of ties the one that stands first, column by column.

    One pass: every row gives its values as (field, value) rows, which are counted before they are shuffled, so a job with a
    third of all rows sends its different values only. A job without a value for a field has null there.
    """
    have = {f: [c for c in columns if c in df.columns] for f, columns in fields.items()}
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(k).alias("column"), _clean(c).alias("value")) for f, columns in have.items() for k, c in enumerate(columns)])
    long = df.select(key, F.col(order).alias("_o"), F.explode(cells).alias("_c")).filter("_c.value is not null")
    counted = long.groupBy(key, "_c.field", "_c.value").agg(F.count("*").alias("n"), F.min(F.struct("_c.column", "_o")).alias("_at"))
    best = counted.groupBy(key, "field").agg(F.min(F.struct((-F.col("n")).alias("n"), "_at", "value")).alias("_b"))
    return best.groupBy(key).agg(*[F.max(F.when(F.col("field") == f, F.col("_b.value"))).alias(f) for f in fields])


def first_of(df: DataFrame, columns: tuple[str, ...], order: str) -> Column:
    """An aggregate: the first value of the first column that has any."""
    have = [c for c in columns if c in df.columns]
    return F.coalesce(*[F.min(F.when(_clean(c).isNotNull(), F.struct(F.col(order).alias("_o"), _clean(c).alias("v"))))["v"] for c in have], F.lit(""))


def job_nodes(postings: DataFrame, order: str, names: tuple[str, ...] = ("standard_job_name", "job_name", "normalized_job_name", "job_title_norm", "job_title"), mentioned: DataFrame | None = None) -> DataFrame:
    """id, name, the fields of NODE_MODES, raw_requirement_summary, occurrence_count: a row for each job that a posting names.

    ``mentioned`` has a column name: jobs that only paths name, which get a node with nothing else.
    """
    named = postings.withColumn("_name", F.coalesce(*[_clean(c) for c in names if c in postings.columns])).filter("_name is not null")
    whole = named.groupBy("_name").agg(first_of(named, NODE_SUMMARY, order).alias("raw_requirement_summary"), F.count("*").alias("occurrence_count"))
    joined = whole.join(modes(named, "_name", NODE_MODES, order), "_name", "left")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    nodes = joined.select(F.col("_name").alias("name"), *[blank(c) for c in NODE_MODES], "raw_requirement_summary", "occurrence_count")
    if mentioned is not None:
        more = mentioned.select(_clean("name").alias("name")).filter("name is not null").distinct().join(nodes.select("name"), "name", "left_anti")
        nodes = nodes.unionByName(more.select("name", *[F.lit("").alias(c) for c in (*NODE_MODES, "raw_requirement_summary")], F.lit(0).cast("long").alias("occurrence_count")))
    return nodes.select(text.stable_id(F.col("name"), 16, "job_").alias("id"), "*")


def aliases(df: DataFrame, key: str, order: str, columns: tuple[str, ...] = ALIASES) -> DataFrame:
    """key, aliases: the different names of a job, column by column, as they stand first."""
    have = [c for c in columns if c in df.columns]
    cells = F.array(*[F.struct(F.lit(k).alias("column"), _clean(c).alias("value")) for k, c in enumerate(have)])
    long = df.select(key, F.col(order).alias("_o"), F.explode(cells).alias("_c")).filter("_c.value is not null")
    once = long.groupBy(key, "_c.value").agg(F.min(F.struct("_c.column", "_o")).alias("_at"))
    return once.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "value"))), lambda x: x["value"]).alias("aliases"))


def document_text(d: dict[str, Column]) -> Column:
    """The sentences of a document, of the fields that it has."""
    said = lambda c: F.nullif(d[c], F.lit(""))
    first = lambda c, n, sign="、": F.nullif(F.array_join(F.slice(d[c], 1, n), sign), F.lit(""))
    parts = [
        F.concat(said("standard_job_name"), F.lit("属于"), F.coalesce(said("job_category"), F.lit("未明确分类")), F.lit("岗位，岗位层级为"), F.coalesce(said("job_level"), F.lit("未明确层级")), F.lit("。")),
        F.when(said("degree_requirement").isNotNull() | said("major_requirement").isNotNull(), F.concat(F.lit("常见学历要求为"), F.coalesce(said("degree_requirement"), F.lit("未明确")), F.lit("，专业要求为"), F.coalesce(said("major_requirement"), F.lit("未明确")), F.lit("。"))),
        F.concat(F.lit("经验要求："), said("experience_requirement"), F.lit("。")), F.concat(F.lit("核心硬技能包括："), first("hard_skills", 10), F.lit("。")), F.concat(F.lit("常见工具或技术栈包括："), first("tools_or_tech_stack", 10), F.lit("。")),
        F.concat(F.lit("软技能要求包括："), first("soft_skills", 8), F.lit("。")), F.concat(F.lit("证书要求包括："), first("certificate_requirement", 8), F.lit("。")), F.concat(F.lit("实践要求："), said("practice_requirement"), F.lit("。")),
        F.concat(F.lit("岗位摘要："), said("raw_requirement_summary")), F.concat(F.lit("常见纵向发展路径："), first("vertical_paths", 5, "；"), F.lit("。")), F.concat(F.lit("常见横向转岗路径："), first("transfer_paths", 5, "；"), F.lit("。")),
    ]
    return F.concat_ws(" ", *parts)


def knowledge_records(extracted: DataFrame, order: str, key: str = "standard_job_name") -> DataFrame:
    """doc_id, standard_job_name, aliases, the fields of the job's first posting, source_count, confidence, doc_text: a row a job.

    Confidence is the share of postings whose extraction succeeded (1 without such a column), .6 at least.
    """
    rows = extracted.withColumn("_job", _clean(key)).filter("_job is not null")
    fields = [c for c in (*FIRST, *LISTS) if c in rows.columns]
    first = F.min_by(F.struct(*fields), F.col(order))
    success = F.avg(F.coalesce(F.col("extract_success").cast("boolean"), F.lit(False)).cast("int")) if "extract_success" in rows.columns else F.lit(1.0)
    whole = rows.groupBy("_job").agg(first.alias("_f"), F.count("*").alias("source_count"), F.round(F.greatest(F.lit(LEAST_CONFIDENCE), success), 2).alias("confidence"))
    joined = whole.join(aliases(rows, "_job", order), "_job", "left")
    empty = F.array().cast("array<string>")
    listed = lambda c: text.list_like(F.col(f"_f.{c}").cast("string")) if dict(rows.dtypes)[c] == "string" else F.coalesce(F.col(f"_f.{c}").cast("array<string>"), empty)
    columns = {"standard_job_name": F.col("_job")}
    columns |= {c: F.coalesce(text.clean_text(F.col(f"_f.{c}"), entities=False), F.lit("")) if c in fields else F.lit("") for c in FIRST}
    columns |= {c: listed(c) if c in fields else empty for c in LISTS}
    base = joined.select(text.stable_id(F.col("_job"), 12, "job_").alias("doc_id"), F.coalesce("aliases", empty).alias("aliases"), *[c.alias(n) for n, c in columns.items()], "source_count", "confidence")
    return base.withColumn("doc_text", document_text({c: F.col(c) for c in columns}))
