"""Student-job matching as expressions over one row per pair."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import registry, text, vocab
from ..functions.similarity import tags_score, token_similarity

WEIGHTS = {"basic": 0.30, "skill": 0.40, "quality": 0.20, "potential": 0.10}


def ladder(value: Column, steps: list[tuple[float, float]], otherwise: float) -> Column:
    """The result of the first bound that the value reaches."""
    out = F.when(value >= steps[0][0], steps[0][1])
    for bound, result in steps[1:]:
        out = out.when(value >= bound, result)
    return out.otherwise(otherwise)


def clamped(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def degree_score(student: Column, required: Column) -> Column:
    """By rank: no gate 100, unknown 0, reached 100, one below 60, further below 20."""
    return F.when(required <= 0, 100.0).when(student <= 0, 0.0).when(student >= required, 100.0).when(student == required - 1, 60.0).otherwise(20.0)


def major_score(student: Column, wanted: Column) -> Column:
    best = F.array_max(F.transform(wanted, lambda w: token_similarity(student, w)))
    return F.when(F.size(wanted) == 0, 100.0).when(F.coalesce(F.trim(student), F.lit("")) == "", 0.0).otherwise(ladder(best, [(0.75, 100.0), (0.5, 75.0), (0.3, 45.0)], 20.0))


def basic_score(degree: Column, major: Column, certificate: Column) -> Column:
    return F.round(0.45 * degree + 0.35 * major + 0.20 * certificate, 2)


def skill_score(hard: Column, tools: Column) -> Column:
    return F.round(0.70 * hard + 0.30 * tools, 2)


def quality_score(practice: Column, soft: Column) -> Column:
    return F.round(0.60 * practice + 0.40 * soft, 2)


def practice_matched(wanted: Column, tags: Column, projects: Column, internships: Column, soft: Column) -> Column:
    """Whether a practice requirement is met: open ones always; project, internship, travel and teamwork ones by counts, tags
    and soft skills; others by an experience tag of similarity .65."""
    tagged = lambda *w: F.exists(tags, lambda t: text.any_of(F.coalesce(text.tag_token(t), F.lit("")), list(w)))

    def rules(token: Column) -> Column:
        has = lambda *w: text.any_of(token, list(w))
        return (
            F.when(token == "", False).when(has("经验不限", "应届可投", "可实习"), True).when(has("项目"), (projects > 0) | tagged("项目"))
            .when(has("实习", "实践"), (internships > 0) | tagged("实习")).when(has("出差", "驻场"), tagged("出差", "驻场"))
            .when(has("跨部门", "协作", "沟通"), F.arrays_overlap(soft, F.array(F.lit("沟通协作"), F.lit("团队合作")))).otherwise(F.exists(tags, lambda t: token_similarity(wanted, t) >= 0.65))
        )

    return text.let(F.coalesce(text.tag_token(wanted), F.lit("")), rules)


def practice_score(wanted: Column, tags: Column, projects: Column, internships: Column, soft: Column) -> Column:
    """Share of the requirements that are met, in percent; 100 without any."""
    once = F.filter(F.array_distinct(wanted), lambda w: F.trim(w) != "")
    met = F.filter(once, lambda w: practice_matched(w, tags, projects, internships, soft))
    return F.when(F.size(once) == 0, 100.0).otherwise(F.round(F.size(met) / F.size(once) * 100, 2))


def level_score(student: Column, job: Column) -> Column:
    """At the job's level or above 100, one below 70, else 40."""
    return F.when(job <= 0, 100.0).when(student >= job, 100.0).when(student == job - 1, 70.0).otherwise(40.0)


def potential_score(direction: Column, completeness: Column, competitiveness: Column, level: Column) -> Column:
    return F.round(clamped(0.45 * direction + 0.35 * (0.35 * completeness + 0.65 * competitiveness) + 0.20 * level), 2)


def overall(parts: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """Weighted mean; given weights are scaled to one."""
    w = weights or WEIGHTS
    total = sum(w[k] for k in parts)
    return F.round(reduce(lambda a, b: a + b, [c * (w[k] / total) for k, c in parts.items()]), 2)


#: Jobs that are broadcast to all students; more of them are shuffled in blocks.
MOST_JOBS = 5_000


def with_jobs(students: DataFrame, jobs: DataFrame, blocks: int = 64) -> DataFrame:
    """Every student with every job, as is asked for: each student is scored against all standard jobs.

    Jobs are few (a few dozen) and broadcast after a count; beyond MOST_JOBS both sides are dealt to blocks, and each
    student's row goes to all of them.
    """
    if jobs.count() <= MOST_JOBS:
        return students.withColumn("_b", F.lit(0)).join(F.broadcast(jobs.withColumn("_b", F.lit(0))), "_b").drop("_b")
    dealt = jobs.withColumn("_b", F.pmod(F.xxhash64(*jobs.columns), F.lit(blocks)).cast("int"))
    return students.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(dealt, "_b").drop("_b")


def scored(students: DataFrame, jobs: DataFrame, on: str | None = "target_job") -> DataFrame:
    """Pairs with four sub-scores and the overall score.

    With ``on`` students meet the job they name; with None all jobs, which are a few dozen standard ones.
    """
    pairs = students.join(jobs, on) if on else with_jobs(students, jobs)
    empty = F.array().cast("array<string>")
    tags = lambda c: F.coalesce(F.col(c), empty)
    basic = basic_score(degree_score(F.col("degree_rank"), F.col("required_degree_rank")), major_score(F.col("major"), tags("required_majors")), tags_score(tags("certificates"), tags("required_certificates"), 0.8))
    skill = skill_score(tags_score(tags("skills"), tags("required_skills"), 0.75), tags_score(tags("tools"), tags("required_tools"), 0.8))
    count = lambda word: F.size(F.filter(tags("practice"), lambda t: F.contains(t, F.lit(word))))
    practice = practice_score(tags("required_practice"), tags("practice"), count("项目"), count("实习"), tags("soft_skills"))
    quality = quality_score(practice, tags_score(tags("soft_skills"), tags("required_soft_skills"), 0.7))
    potential = potential_score(tags_score(tags("occupation_hints"), F.array(F.col("job_name")), 0.55), F.col("completeness"), F.col("competitiveness"), level_score(F.col("level_rank"), F.col("required_level_rank")))
    out = pairs.withColumns({"basic": basic, "skill": skill, "quality": quality, "potential": potential})
    return out.withColumn("overall", overall({k: F.col(k) for k in WEIGHTS}))


def compared_degree_rank(label: Column) -> Column:
    """The rank of a degree's standard label; 0 for others and none."""
    return F.coalesce(*[F.when(label == k, v) for k, v in vocab.COMPARED_DEGREE_RANK.items()], F.lit(0))


def _messaged(kind: str, level: Column) -> Column:
    return F.coalesce(*[F.when(level == k, v) for k, v in vocab.HARD_INFO_MESSAGES[kind].items()])


def _share(distribution: Column, of) -> Column:
    """The sum of ratios of the entries for which ``of`` holds."""
    return F.aggregate(F.filter(distribution, of), F.lit(0.0), lambda s, x: s + F.coalesce(x["ratio"], F.lit(0.0)))


def degree_info(degree: Column, distribution: Column, gate: Column) -> Column:
    """struct(pass, risk_level, qualified_ratio, higher_requirement_ratio, message) of a degree under a ranked distribution.

    The gate decides whether it passes, the shares of jobs that ask for no more, and for more, decide the risk.
    """
    rank, gate_rank = compared_degree_rank(degree), compared_degree_rank(gate)
    enough = lambda x: (compared_degree_rank(x["name"]) <= 0) | (compared_degree_rank(x["name"]) <= rank)

    def judged(s: Column) -> Column:
        passed = (gate_rank <= 0) | ((rank > 0) & (rank >= gate_rank))
        level = F.when(passed & (s["more"] <= 0.2), "high_match").when(s["enough"] > 0, "risk").otherwise("no_match")
        return F.struct(passed.alias("pass"), level.alias("risk_level"), F.round(F.least(s["enough"], F.lit(1.0)), 4).alias("qualified_ratio"), F.round(F.least(s["more"], F.lit(1.0)), 4).alias("higher_requirement_ratio"), _messaged("degree", level).alias("message"))

    return text.let(F.struct(_share(distribution, enough).alias("enough"), _share(distribution, lambda x: ~enough(x)).alias("more")), judged)


def best_similarity(value: Column, items: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(items, lambda x: token_similarity(value, x))), F.lit(0.0))


def major_info(major: Column, distribution: Column, gate_set: Column, mainstream: Column | None = None) -> Column:
    """struct(pass, risk_level, matched_ratio, message): a major passes if it resembles one of the gate set (similarity .75); the
    share of jobs whose major it resembles decides the risk."""
    majors = gate_set if mainstream is None else F.when(F.size(gate_set) > 0, gate_set).otherwise(mainstream)
    like = lambda x: (F.trim(x["name"]) != "") & (x["name"] != vocab.UNKNOWN) & (token_similarity(major, x["name"]) >= 0.75)

    def judged(s: Column) -> Column:
        free = F.size(gate_set) == 0
        passed = free | ((F.coalesce(F.trim(major), F.lit("")) != "") & (s["best"] >= 0.75))
        level = F.when(passed & ((s["share"] >= 0.3) | free), "high_match").when((s["share"] > 0) | (s["best"] >= 0.5), "risk").otherwise("no_match")
        return F.struct(passed.alias("pass"), level.alias("risk_level"), F.round(F.least(s["share"], F.lit(1.0)), 4).alias("matched_ratio"), _messaged("major", level).alias("message"))

    return text.let(F.struct(_share(distribution, like).alias("share"), best_similarity(major, majors).alias("best")), judged)


def certificate_info(have: Column, must: Column, preferred: Column, none_ratio: Column) -> Column:
    """struct(pass, risk_level, matched_ratio, message): all must-have certificates pass; the share of all that are asked for, or
    of jobs that ask for none, decides the risk."""
    met = lambda wanted: F.size(F.filter(wanted, lambda w: F.exists(have, lambda h: token_similarity(h, w) >= 0.75)))

    def judged(s: Column) -> Column:
        total = F.size(must) + F.size(preferred)
        ratio = F.when(total <= 0, 1.0).otherwise(F.try_divide(s["must"] + s["preferred"], total))
        passed = s["must"] == F.size(must)
        level = F.when(passed & ((ratio >= 0.6) | (none_ratio >= 0.5)), "high_match").when(passed, "risk").otherwise("no_match")
        return F.struct(passed.alias("pass"), level.alias("risk_level"), F.round(ratio, 4).alias("matched_ratio"), _messaged("certificate", level).alias("message"))

    return text.let(F.struct(met(must).alias("must"), met(preferred).alias("preferred")), judged)


def knowledge_coverage(known: Column, required: Column, least: float = 0.72) -> Column:
    """struct(accuracy, passed, requirement_known): share of required points that a known term resembles; all without any."""
    hit = F.filter(required, lambda r: F.exists(known, lambda t: token_similarity(t, r) >= least))
    accuracy = F.when(F.size(required) == 0, 1.0).otherwise(F.round(F.size(hit) / F.size(required), 4))
    return F.struct(accuracy.alias("accuracy"), (accuracy >= 0.8).alias("passed"), (F.size(required) > 0).alias("requirement_known"))


def gap_status(gap: Column) -> Column:
    return F.when(gap >= -10, "match").when(gap >= -25, "risk").otherwise("no_match")


def ability_gaps(students: DataFrame, jobs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, weighted score, worst status: long tables (…, dimension, score) of students and jobs, joined by dimension.

    There are few dimensions, so the jobs' rows are broadcast: a shuffle by dimension would put all students in a few tasks.
    """
    weight = F.coalesce(*[F.when(F.col("dimension") == k, w) for k, w in vocab.ABILITY_WEIGHTS.items()], F.lit(0.0))
    joined = students.withColumnRenamed("score", "have").join(F.broadcast(jobs.withColumnRenamed("score", "need")), "dimension")
    gap = F.col("have") - F.col("need")
    part = ladder(gap, [(-10.0, 1.0), (-25.0, 0.5)], 0.0)
    summed = joined.withColumns({"_w": weight, "_p": part, "_s": gap_status(gap)}).groupBy(*keys).agg(
        F.round(F.try_divide(F.sum(F.col("_w") * F.col("_p")), F.sum("_w")) * 100, 2).alias("ability_score"), F.count_if(F.col("_s") == "no_match").alias("gaps"), F.count_if(F.col("_s") == "risk").alias("_risks"),
    )
    worst = F.when(F.col("gaps") > 0, "no_match").when(F.col("_risks") > 0, "risk").otherwise("match")
    return summed.select(*keys, "ability_score", worst.alias("ability_status"), "gaps")


def asset_score(passes: Column, accuracy: Column, samples: Column, fails: Column) -> Column:
    """45 for hard passes of three, 45 for accuracy, 10 for samples; 8 off for each failure, and 8 under .4 accuracy."""
    return F.round(clamped(45.0 * passes / 3 + 45.0 * accuracy + 10.0 * F.least(samples / 100.0, F.lit(1.0)) - 8.0 * fails - F.when(accuracy < 0.4, 8.0).otherwise(0.0)), 2)


def risk_level(statuses: Column) -> Column:
    """unknown before no_match before risk before match."""
    has = lambda s: F.array_contains(statuses, s)
    return F.when(has("unknown"), "unknown").when(has("no_match"), "no_match").when(has("risk"), "risk").otherwise("match")


def explanations(risk_level: Column, missing: Column, matched: Column, knowledge_pass: Column, accuracy: Column, hard_info: list[Column], all_pass: Column, reason: Column, score: Column, most: int = 6) -> Column:
    """struct(risks, advantages) of a match, ``most`` texts of each, each once.

    Risks: the level unless it is a match, missing points, coverage under the bound, what is said of degree, major and
    certificates at risk, and that not all is passed if nothing else is said. Advantages: the gates, points that are there, the
    reason given, the score. ``hard_info`` holds the structs of degree, major and certificate; null knowledge_pass means no
    comparison of knowledge.
    """
    first = lambda c: F.array_join(F.slice(F.array_distinct(F.filter(c, lambda x: F.trim(x) != "")), 1, 6), "、")
    said = lambda prefix, body: F.when(body != "", F.concat(F.lit(prefix), body))
    level = F.coalesce(F.trim(risk_level), F.lit(""))
    risks = [
        F.when(~level.isin("", "high_match", "match"), F.concat(F.lit("风险等级为"), level)), said("缺失知识点：", first(missing)),
        F.when(~knowledge_pass, F.concat(F.lit("知识点覆盖率为"), F.bround(accuracy * 100, 0).cast("int").cast("string"), F.lit("%，尚未达到80%"))),
        *[F.when(h["risk_level"].isin("risk", "no_match"), h["message"]) for h in hard_info],
    ]
    listed = F.array_distinct(F.array_compact(F.array(*risks)))
    risks_or = F.when((F.size(listed) == 0) & ~all_pass, F.array(F.lit("赛题综合评测尚未完全通过"))).otherwise(listed)
    gates = hard_info[0]["pass"]
    for h in hard_info[1:]:
        gates = gates & h["pass"]
    advantages = F.array_compact(F.array(F.when(gates, "学历、专业、证书硬门槛通过"), said("已命中知识点：", first(matched)), F.nullif(F.trim(reason), F.lit("")), F.when(score > 0, F.concat(F.lit("主展示分为"), F.format_string("%.2f", score)))))
    return F.struct(F.slice(risks_or, 1, most).alias("risks"), F.slice(F.array_distinct(advantages), 1, most).alias("advantages"))


def first_known(distribution: Column, unknown: str = vocab.UNKNOWN) -> Column:
    """The first name of a ranked distribution (array of structs with name) that isn't the unknown one."""
    return F.get(F.filter(distribution, lambda x: (F.trim(x["name"]) != "") & (x["name"] != unknown)), F.lit(0))["name"]


def comparable(pairs: DataFrame) -> DataFrame:
    """Pairs of a student and a job with one struct for each dimension that is compared. A job's missing degree comes from its
    distribution of degrees, missing skills are the first 15 of its skill frequencies."""
    empty = F.array().cast("array<string>")
    tags = lambda c: F.array_distinct(F.filter(F.coalesce(c, empty), lambda x: F.trim(x) != ""))
    own = tags(F.col("required_skills"))
    frequent = F.array_distinct(F.filter(F.transform(F.slice(F.coalesce("skill_frequency", F.array().cast("array<struct<name:string>>")), 1, 15), lambda x: F.trim(x["name"])), lambda x: x != ""))
    degree = F.coalesce(F.nullif(F.trim("required_degree"), F.lit("")), first_known(F.col("degree_distribution")), F.lit(""))
    both = lambda s, j: F.struct(s.alias("student"), j.alias("job"))
    return pairs.withColumns(
        {
            "education": both(F.coalesce("degree", F.lit("")), degree), "hard_skills": both(tags(F.col("skills")), F.when(F.size(own) > 0, own).otherwise(frequent)),
            "tool_skills": both(tags(F.col("tools")), tags(F.col("required_tools"))), "soft": both(tags(F.col("soft_skills")), tags(F.col("required_soft_skills"))),
        }
    )


#: What is said of a pair that lacks what a match needs. Fixed values.
MATCH_WARNINGS = [
    ("student_profile_result 缺少学历字段", ("degree",)), ("student_profile_result 缺少专业字段", ("major",)), ("student_profile_result 缺少可用于匹配的技能/工具标签", ("hard_skills", "tool_skills")),
    ("student_profile_result 缺少职业方向或领域标签", ("occupation_hints", "domain_tags")), ("job_profile_result 缺少 standard_job_name", ("standard_job_name",)), ("job_profile_result 缺少学历要求字段", ("degree_requirement",)),
    ("job_profile_result 缺少岗位技能/工具要求", ("job_hard_skills", "job_tool_skills")), ("job_profile_result 缺少专业要求标签", ("major_requirement",)),
]
_STUDENT_LISTS = ("hard_skills", "tool_skills", "soft_skills", "certificates", "experience_tags", "occupation_hints", "domain_tags")
_JOB_LISTS = ("major_requirement", "job_hard_skills", "job_tool_skills", "job_soft_skills", "certificate_requirement", "experience_requirement", "practice_requirement")


def comparable_schema(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, the eight compared dimensions as structs (education with ranks, major, hard_skills, tool_skills, soft_skills,
    certificates, practice_experience with counts, career_direction), and warnings: what either side lacks.

    Lists may be arrays or texts with separators; each item counts once. Columns: degree, major, standard_job_name, job_category,
    degree_requirement, project_count, internship_count, and the lists of both sides (a job's skills as job_hard_skills, …).
    """
    kinds = dict(pairs.dtypes)
    said = lambda c: F.coalesce(text.clean_text(F.col(c), entities=False), F.lit(""))
    listed = {c: registry.items(F.col(c), "match") if kinds[c] == "string" else registry.items(F.array_join(F.col(c), "\n"), "match") for c in (*_STUDENT_LISTS, *_JOB_LISTS)}
    rows = pairs.select(*keys, *[said(c).alias(c) for c in ("degree", "major", "standard_job_name", "job_category", "degree_requirement")], *[F.coalesce(F.col(c).cast("int"), F.lit(0)).alias(c) for c in ("project_count", "internship_count")], *[v.alias(c) for c, v in listed.items()])
    empty = lambda c: F.size(c) == 0 if c in listed else F.col(c) == ""
    lacks = lambda names: reduce(lambda a, b: a & b, [empty(c) for c in names])
    side = lambda **columns: F.struct(*[(c if isinstance(c, Column) else F.col(c)).alias(n) for n, c in columns.items()])
    return rows.select(
        *keys,
        side(student="degree", student_rank=compared_degree_rank(F.col("degree")), job="degree_requirement", job_rank=compared_degree_rank(F.col("degree_requirement"))).alias("education"), side(student="major", job="major_requirement").alias("major"),
        side(student="hard_skills", job="job_hard_skills").alias("hard_skills"), side(student="tool_skills", job="job_tool_skills").alias("tool_skills"), side(student="soft_skills", job="job_soft_skills").alias("soft_skills"),
        side(student="certificates", job="certificate_requirement").alias("certificates"),
        side(student="experience_tags", projects="project_count", internships="internship_count", job="experience_requirement", job_practice="practice_requirement").alias("practice_experience"),
        side(student="occupation_hints", domains="domain_tags", job="standard_job_name", category="job_category").alias("career_direction"),
        F.array_compact(F.array(*[F.when(lacks(names), F.lit(warning)) for warning, names in MATCH_WARNINGS])).alias("warnings"),
    )
