"""Seven ability dimensions per job, from evidence sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parse, text, vocab


def clamp(score: Column, high: float = 100.0) -> Column:
    return F.round(F.least(F.lit(high), F.greatest(F.lit(0.0), score))).cast("int")


def evidence(df: DataFrame, job: str, row_id: str, body: str) -> DataFrame:
    """A row for each posting and dimension with a keyword: the keywords found and the first sentence with one."""
    low = F.lower(F.col(body))
    found = []
    for key, label, words in vocab.ABILITY_DIMENSIONS:
        hits = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(w.lower())), F.lit(w)) for w in words]))
        found.append(F.struct(F.lit(key).alias("dimension"), F.lit(label).alias("label"), hits.alias("keywords"), text.evidence(F.col(body), words).alias("sentence")))
    rows = df.select(job, row_id, F.explode(F.array(*found)).alias("e")).select(job, row_id, "e.*")
    return rows.filter(F.size("keywords") > 0)


def keyword_scores(found: DataFrame, job: str, row_id: str, totals: DataFrame) -> DataFrame:
    """68 of the evidence share, up to 16 for different keywords, up to 5 for the sample; 92 at most. totals: job and samples."""
    words = found.select(job, "dimension", F.explode("keywords").alias("w")).groupBy(job, "dimension").agg(F.count_distinct("w").alias("diversity"))
    rows = found.groupBy(job, "dimension").agg(F.count_distinct(row_id).alias("evidence_count"))
    raw = F.col("evidence_count") / F.col("samples") * 68.0 + F.least(F.col("diversity") * 2.5, F.lit(16.0)) + F.least(F.log1p("samples"), F.lit(5.0))
    joined = rows.join(words, [job, "dimension"]).join(totals, job)
    return joined.select(job, "dimension", "evidence_count", "diversity", "samples", F.round(F.col("evidence_count") / F.col("samples"), 4).alias("evidence_ratio"), clamp(raw, 92.0).alias("score"))


def professional_score(ratio: Column, required: Column, preferred: Column, samples: Column) -> Column:
    return clamp(ratio * 70.0 + F.least(1.8 * required + 0.8 * preferred, F.lit(24.0)) + F.least(F.log1p(samples) * 2.5, F.lit(10.0)))


def certificate_score(evidence_share: Column, no_certificate: Column, must: Column, preferred: Column) -> Column:
    return clamp(F.greatest(evidence_share, 1.0 - no_certificate) * 70.0 + F.least(10.0 * must + 4.0 * preferred, F.lit(24.0)))


def source_quality(samples: Column, hard: Column, soft: Column, practice: Column) -> Column:
    return F.round(0.35 * F.least(samples / 50.0, F.lit(1.0)) + 0.25 * hard + 0.25 * soft + 0.15 * practice, 4)


def level(score: Column) -> Column:
    return text.banded(score, [(75, "high"), (55, "medium_high"), (35, "medium")], "low")


def skill_knowledge(skills: DataFrame, knowledge: dict[str, tuple[list[str], list[str]]], skill: str = "skill") -> DataFrame:
    """Skills with the required and preferred knowledge points of every map entry that contains the skill or is contained in it.

    The map is a small constant, so it becomes an expression rather than a join.
    """
    token = text.compact(F.col(skill))
    entries = []
    for name, (required, preferred) in knowledge.items():
        key = text._plain(name)
        hit = (token == key) | F.contains(token, F.lit(key)) | ((F.char_length(token) > 1) & F.contains(F.lit(key), token))
        entries.append(F.when(hit, F.struct(F.array(*[F.lit(x) for x in required]).cast("array<string>").alias("required"), F.array(*[F.lit(x) for x in preferred]).cast("array<string>").alias("preferred"))))
    got = F.array_compact(F.array(*entries))
    flat = lambda f: F.array_distinct(F.flatten(F.transform(got, lambda e: e[f])))
    return skills.withColumns({"required_points": flat("required"), "preferred_points": F.array_except(flat("preferred"), flat("required"))})


def sample_requirements(df: DataFrame, job: str, row_id: str, body: str, profile_degree: Column | None = None) -> DataFrame:
    """Per posting: degree, majors, certificates with force, skills, experience, practice, soft skills and extraction confidence."""
    t = F.coalesce(F.col(body), F.lit(""))
    degree = parse.degree_requirement(t, profile_degree)
    out = df.withColumns({"_degree": degree, "majors": parse.majors(t), "certificates": parse.certificates(t), "hard_skills": parse.skills(t), "experience": parse.experience(t), "practice": parse.practice(t), "soft_skills": parse.soft_skills(t)})
    by = lambda c: F.when(F.size(c) > 0, "text").otherwise("none")
    return out.select(
        job, row_id, F.col("_degree.degree").alias("degree"), F.col("_degree.rank").alias("degree_rank"), "majors", "certificates", "hard_skills", "experience", "practice", "soft_skills",
        parse.extraction_confidence(F.col("_degree.method"), by(F.col("majors")), by(F.col("certificates"))).alias("extraction_confidence"),
    )

