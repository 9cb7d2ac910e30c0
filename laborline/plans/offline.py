"""The offline job: postings to clean, filtered, standardized tables, statistics, knowledge documents and graph."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import ability, clean, graph, relevance, stats, titles, vector
from ..session import checkpointed


@dataclass
class Outputs:
    detail: DataFrame
    audit: DataFrame
    mapping: DataFrame
    requirements: DataFrame
    degree_stats: DataFrame
    skill_stats: DataFrame
    salary_stats: DataFrame
    ability_scores: DataFrame
    documents: DataFrame
    vertices: DataFrame
    edges: DataFrame


def run(raw: DataFrame, today: str, relations: DataFrame | None = None, judged: DataFrame | None = None, ordinal: str | None = None) -> Outputs:
    """The stages in turn: cleaned, audited, standardized postings and their requirements are checkpoints, as several results read each.

    relations: job, path and kind, written promotion and transfer paths; judged: decisions for undecided postings.
    """
    postings = clean.drop_duplicates(checkpointed(clean.clean_postings(raw, today, ordinal)))
    audit = checkpointed(relevance.audited(postings, judged))
    detail, mapping = titles.standardize(relevance.kept(audit))
    detail = checkpointed(detail)
    job = "standard_job_name"
    req = checkpointed(ability.sample_requirements(detail, job, "record_id", "job_description"))
    degrees = stats.distribution(req, [job], F.col("degree"), unknown="未明确")
    skills = stats.multi_distribution(req, [job], F.col("hard_skills"), unknown="未明确", top=100)
    salary = stats.salary_stats(detail, [job], F.col("salary_month_min"), F.col("salary_month_max"))
    totals = detail.groupBy(job).agg(F.count("*").alias("samples"))
    found = ability.evidence(detail, job, "record_id", "job_description")
    scores = ability.keyword_scores(found, job, "record_id", totals)
    docs = knowledge_documents(detail, degrees, skills, salary)
    v, e = graph_tables(detail, req, relations)
    return Outputs(detail, audit, mapping, req, degrees, skills, salary, scores, docs, v, e)


def knowledge_documents(detail: DataFrame, degrees: DataFrame, skills: DataFrame, salary: DataFrame) -> DataFrame:
    """One document per standard job with its statistics and a text, and the text's vector; postings without a title have none."""
    job = "standard_job_name"
    base = detail.filter(F.col(job).isNotNull()).groupBy(job).agg(F.count("*").alias("sample_count"), F.min_by("job_description", "record_id").alias("summary"), F.array_sort(F.collect_set("job_title")).alias("titles"))
    rich = base.join(stats.nested(degrees, [job], "degrees"), job, "left").join(stats.nested(skills, [job], "skills"), job, "left").join(salary.select(job, "mid_mean", "valid_count"), job, "left")
    names = lambda c: F.array_join(F.transform(F.col(c), lambda x: x["name"]), ", ")
    body = F.concat_ws("\n", F.col(job), F.concat(F.lit("degrees: "), names("degrees")), F.concat(F.lit("skills: "), names("skills")), F.left("summary", F.lit(800)))
    return vector.embed(rich.withColumns({"doc_id": text.stable_id(F.col(job), 16, "doc_"), "doc_text": body}), "doc_id", "doc_text")


def graph_tables(detail: DataFrame, req: DataFrame, relations: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    job = "standard_job_name"
    skills = req.select(F.explode("hard_skills").alias("name"))
    majors = req.select(F.explode("majors").alias("name"))
    v = graph.vertices(detail, job, "Job", "job_")
    for values, name, label, prefix in ((skills, "name", "Skill", "skill_"), (majors, "name", "Major", "major_"), (req.filter("degree_rank >= 0"), "degree", "Degree", "degree_"), (detail, "industry", "Industry", "industry_")):
        v = v.unionByName(graph.vertices(values, name, label, prefix))
    e = graph.edges(req, F.col(job), F.col("hard_skills"), "job_", "skill_", "REQUIRES_SKILL")
    e = e.unionByName(graph.edges(req, F.col(job), F.col("majors"), "job_", "major_", "PREFERS_MAJOR"))
    e = e.unionByName(graph.edges(req.filter("degree_rank >= 0"), F.col(job), F.array("degree"), "job_", "degree_", "REQUIRES_DEGREE"))
    e = e.unionByName(graph.edges(detail, F.col(job), F.array("industry"), "job_", "industry_", "BELONGS_TO_INDUSTRY"))
    if relations is not None:
        nodes = relations.select(F.explode(F.array_union(F.array("job"), text_nodes())).alias("name"))
        v = v.unionByName(graph.vertices(nodes, "name", "Job", "job_")).dropDuplicates(["id"])
        for kind in ("PROMOTE_TO", "TRANSFER_TO"):
            e = e.unionByName(graph.path_edges(relations.filter(F.col("kind") == kind), "job", "path", kind))
    return v, e


def text_nodes():
    from ..functions.parse import path_nodes

    return path_nodes(F.col("path"))
