"""Student profiles: completeness, competitiveness, bands, missing dimensions, abilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, vocab


def filled(fields: list[Column]) -> Column:
    """How many of the fields hold text."""
    total = F.lit(0)
    for f in fields:
        total = total + F.when(F.trim(f.cast("string")) != "", 1).otherwise(0)
    return total


def share(fields: list[Column]) -> Column:
    return filled(fields) / len(fields)


def _steps(count: Column, steps: list[tuple[int, float]]) -> Column:
    out = F.when(count >= steps[0][0], steps[0][1])
    for least, points in steps[1:]:
        out = out.when(count >= least, points)
    return out.otherwise(0.0)


def completeness(basic: Column, education: Column, skills: Column, projects: Column, internships: Column, awards: Column, target: Column, hints: Column) -> Column:
    """Of 100: basic fields (a share of 20), education fields (of 15), different skills and tools (20), projects (15),
    internships (15), awards (10), an intention (5). The counts are numbers, target and hints say whether there are any."""
    parts = [
        F.round(20.0 * basic, 2), F.round(15.0 * education, 2), _steps(skills, [(8, 20.0), (5, 16.0), (3, 12.0), (1, 8.0)]), _steps(projects, [(2, 15.0), (1, 12.0)]),
        _steps(internships, [(2, 15.0), (1, 12.0)]), _steps(awards, [(1, 10.0)]), F.when(target & hints, 5.0).when(target | hints, 3.0).otherwise(0.0),
    ]
    return _clipped(parts)


def _clipped(parts: list[Column], most: float = 100.0) -> Column:
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(most), total)), 2)


def competitiveness(degree: Column, major: Column, skills: Column, tools: Column, projects: Column, internships: Column, certificates: Column, awards: Column, target: Column, hints: Column, domains: Column, tags: Column) -> Column:
    """Of 100: degree and a standard major (20 at most), skills (4 each, 25), tools (2.5 each, 10), projects (8 each and 2
    for each of two tags, 15), internships (10 each and 2 for a tag, 20), certificates and awards (4 and 3 each, 10), focus
    (5), domains (2 each, 10)."""
    named = F.coalesce(*[F.when(F.contains(degree, F.lit(k)), F.lit(v)) for k, v in vocab.DEGREE_POINTS], F.lit(0.0))
    top = lambda most, points: F.least(F.lit(most), points)
    tagged = lambda t: F.when(F.coalesce(F.array_contains(tags, t), F.lit(False)), 2.0).otherwise(0.0)
    parts = [
        top(20.0, named + F.when(F.trim(major) != "", 2.0).otherwise(0.0)), top(25.0, skills * 4.0), top(10.0, tools * 2.5),
        top(15.0, top(15.0, projects * 8.0) + tagged("项目:建模算法") + tagged("项目:工程开发")), top(20.0, top(20.0, internships * 10.0) + tagged("实习:业务协作")),
        top(10.0, certificates * 4.0 + awards * 3.0), F.when(target & hints, 5.0).when(hints, 3.0).otherwise(0.0), top(10.0, domains * 2.0),
    ]
    return _clipped(parts)


def band(score: Column) -> Column:
    return text.banded(score, [(85, "A"), (70, "B"), (55, "C")], "D")


def level(score: Column) -> Column:
    return text.banded(score, [(75, "high"), (55, "medium_high"), (35, "medium")], "low")


def missing_dimensions(weakness: Column, rules: list[tuple[str, list[str]]], have: dict[str, Column]) -> Column:
    """Dimensions that the weaknesses name by keyword, without those that the counts contradict."""
    named = F.array_compact(F.array(*[F.when(text.any_of(weakness, words), F.lit(name)) for name, words in rules]))
    shown = F.array_compact(F.array(*[F.when(c > 0, F.lit(n)) for n, c in have.items()]))
    return F.array_except(named, shown)


def ability_fallback(skills: Column, tools: Column, certificates: Column, internships: Column, projects: Column, traits: Column) -> Column:
    """map of dimension to score, 100 at most, for a student without a profile of abilities. traits: soft skills and experience tags in one text."""
    top = lambda c: F.round(F.least(F.lit(100.0), c.cast("double")), 2)
    said = lambda points, *words: F.when(text.any_of(F.lower(F.coalesce(traits, F.lit(""))), list(words)), points).otherwise(0.0)
    pairs = {
        "professional_skill": skills * 8.0 + tools * 6.0, "certificate": certificates * 30.0, "innovation": projects * 18.0 + said(18.0, "创新", "算法", "建模", "研发"),
        "learning": 35.0 + skills * 4.0 + tools * 3.0 + said(12.0, "学习"), "pressure_resistance": internships * 22.0 + projects * 14.0 + said(16.0, "抗压", "压力", "责任心"),
        "communication": internships * 24.0 + projects * 10.0 + said(18.0, "沟通", "协作", "表达"), "internship_practice": internships * 40.0 + projects * 10.0,
    }
    return F.create_map(*[x for k, c in pairs.items() for x in (F.lit(k), top(c))])


def _clean_list(values: Column, aliases: dict[str, list[str]] | None = None) -> Column:
    """Cleaned values, by their standard names if there are aliases, each once in order."""
    one = (lambda x: text.alias_normalized(x, aliases)) if aliases else text.clean_text
    return F.array_distinct(F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: one(x)), lambda x: x.isNotNull()))


def skill_lists(skills: Column, tools: Column) -> Column:
    """struct(hard_skills, tool_skills): standard names; skills that are tools go to the tools, before those that are given."""
    known = F.array(*[F.lit(t) for t in vocab.STUDENT_TOOLS])

    def split(x: Column) -> Column:
        all_tools = F.array_distinct(F.concat(F.filter(x["s"], lambda v: F.array_contains(known, v)), x["t"]))
        return F.struct(F.array_except(x["s"], all_tools).alias("hard_skills"), all_tools.alias("tool_skills"))

    return text.let(F.struct(_clean_list(skills, vocab.STUDENT_SKILLS).alias("s"), _clean_list(tools, vocab.STUDENT_SKILLS).alias("t")), split)


def qualification_tags(degree: Column, school: Column, major: Column, certificates: Column, school_level: Column) -> Column:
    """Degree, school, its level, standard major and standard certificates as tags, each once; blank ones are left out."""
    named = [("学历", text.clean_text(degree)), ("学校", text.clean_text(school)), ("学校层次", text.clean_text(school_level)), ("专业", text.alias_normalized(major, vocab.STUDENT_MAJORS))]
    single = F.array_compact(F.array(*[F.concat(F.lit(f"{n}:"), c) for n, c in named]))
    return F.array_distinct(F.concat(single, F.transform(_clean_list(certificates, vocab.STUDENT_CERTIFICATES), lambda c: F.concat(F.lit("证书:"), c))))


def experience_tags(projects: Column, internships: Column, awards: Column, counts: list[Column]) -> Column:
    """Tags of what the texts of projects, internships and awards speak of, then which of them there are (counts in that order)."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    said = [F.when(text.any_of(low(c), words), F.lit(f"{kind}:{tag}")) for tag, words in vocab.EXPERIENCE_WORDS.items() for kind, c in (("项目", projects), ("实习", internships), ("奖项", awards))]
    there = [F.when(n > 0, F.lit(name)) for name, n in zip(("有项目经历", "有实习经历", "有竞赛/获奖经历"), counts, strict=True)]
    return F.array_compact(F.array(*said, *there))


def occupation_hints(target: Column, skills: Column, experience: Column, evaluation: Column) -> Column:
    """The standard direction of the intention (or its own words), then every direction that intention, skills, experience or evaluation name."""
    blank = lambda c: F.coalesce(text.clean_text(c), F.lit(""))
    merged = F.lower(F.concat_ws(" ", blank(target), F.array_join(F.coalesce(skills, F.array().cast("array<string>")), " "), blank(experience), blank(evaluation)))
    named = lambda m: F.array_compact(F.array(*[F.when(text.any_of(m, [w.lower() for w in words]), F.lit(d)) for d, words in vocab.STUDENT_DIRECTIONS.items()]))
    own = F.array_compact(F.array(text.alias_normalized(target, vocab.STUDENT_DIRECTIONS)))
    return F.array_distinct(F.concat(own, text.let(merged, named)))


def missing_in_reasons(weaknesses: Column, suggestions: Column) -> Column:
    """Dimensions that the reasons of a score speak of, in a fixed order."""
    said = F.array_join(F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in (weaknesses, suggestions)]), " ")
    return text.let(said, lambda t: F.array_compact(F.array(*[F.when(text.any_of(t, words), F.lit(name)) for name, words in vocab.MISSING_DIMENSIONS])))


_ENTRY = {"projects": ("project_name", "role", "description"), "internships": ("company_name", "position", "description")}


def entry_text(entries: Column, kind: str) -> Column:
    """The texts of entries (projects or internships) in one, blank fields left out."""
    each = F.transform(entries, lambda x: F.concat_ws(" ", *[text.clean_text(x[f], entities=False) for f in _ENTRY[kind]]))
    return F.coalesce(F.array_join(F.filter(each, lambda t: t != ""), " "), F.lit(""))


def domain_tags(major: Column, hard_skills: Column, tools: Column, hints: Column, experience: Column) -> Column:
    """Domains whose words skills, tools, directions, major or experience hold, then the domain of the standard major."""
    signals = F.lower(F.concat_ws(" ", F.array_join(F.array_union(F.array_union(hard_skills, tools), hints), " "), major, experience))
    named = lambda t: [F.when(text.any_of(t, [w.lower() for w in words]), F.lit(name)) for name, words in vocab.STUDENT_DOMAINS.items()]
    of_major = [F.when(major.isin(*majors), F.lit(name)) for name, majors in vocab.MAJOR_DOMAINS]
    return text.let(signals, lambda t: F.array_distinct(F.array_compact(F.array(*named(t), *of_major))))


def profile(df: DataFrame, key: str) -> DataFrame:
    """key, major_std, hard_skills, tool_skills, qualification_tags, experience_tags, occupation_hints, domain_tags and the practice
    profile (counts, flags and tags): one row a student, an expression over its own columns.

    Columns: major, degree, school, school_level, target_job_intention, self_evaluation; the arrays skills, tools, certificates,
    awards; the arrays of structs projects and internships (as the resume's entries have them).
    """
    empty = F.array().cast("array<string>")
    listed = lambda c: F.coalesce(F.col(c), empty)
    there = df.withColumns({"_p": entry_text(F.col("projects"), "projects"), "_i": entry_text(F.col("internships"), "internships"), "_a": _clean_list(F.col("awards")), "_m": text.alias_normalized(F.col("major"), vocab.STUDENT_MAJORS)})
    counts = [F.coalesce(F.size("projects"), F.lit(0)), F.coalesce(F.size("internships"), F.lit(0)), F.size("_a")]
    counts = [F.greatest(c, F.lit(0)) for c in counts]
    there = there.withColumn("_s", skill_lists(listed("skills"), listed("tools")))
    there = there.withColumn("occupation_hints", occupation_hints(F.col("target_job_intention"), F.concat("_s.hard_skills", "_s.tool_skills"), F.concat_ws(" ", "_p", "_i"), F.col("self_evaluation")))
    tags = experience_tags(F.col("_p"), F.col("_i"), F.array_join("_a", " "), counts)
    target = F.coalesce(text.clean_text(F.col("target_job_intention"), entities=False).isNotNull(), F.lit(False))
    there = there.withColumn("experience_tags", tags)
    practice = F.struct(
        *[c.alias(n) for n, c in zip(("project_count", "internship_count", "award_count"), counts, strict=True)], *[(c > 0).alias(n) for n, c in zip(("has_project_experience", "has_internship_experience", "has_competition_or_award"), counts, strict=True)],
        target.alias("has_target_job_intention"), (counts[0] + counts[1] + counts[2]).alias("total_practice_items"), F.col("experience_tags").alias("practice_tags"),
    )
    return there.select(
        key, F.coalesce("_m", F.lit("")).alias("major_std"), "_s.hard_skills", "_s.tool_skills", qualification_tags(F.col("degree"), F.col("school"), F.col("major"), F.col("certificates"), F.col("school_level")).alias("qualification_tags"),
        "experience_tags", "occupation_hints", domain_tags(F.col("_m"), F.col("_s.hard_skills"), F.col("_s.tool_skills"), F.col("occupation_hints"), F.concat_ws(" ", "_p", "_i")).alias("domain_tags"), practice.alias("practice_profile"),
    )
