"""Two results of one shape, by rules and by a judge, made one by a policy for each field.

A policy is a dict from field names to one of: ``judged`` and ``ruled`` (text: that side's, the other's where it is blank),
``ruled_only``, ``union`` and ``union_judged`` (lists: in order, the rules' or the judge's first, each item once), a
``Clamped`` number, ``Rows`` (lists of structs, matched by key fields), or a dict (a struct, field by field). Null structs
count as blank, null lists as empty.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text


@dataclass(frozen=True)
class Clamped:
    """The judge's number if it has one, else the rules', held between ``low`` and ``high``."""

    low: float = 0.0
    high: float = 100.0


@dataclass(frozen=True)
class Rows:
    """The rules' rows with blanks filled from the judge's row of equal keys, its ``judged`` fields first, then the judge's other rows."""

    keys: tuple[str, ...]
    fields: tuple[str, ...]
    judged: tuple[str, ...] = ("description",)


Policy = str | Clamped | Rows | dict


def merged(rules: Column, judge: Column, policy: dict[str, Policy]) -> Column:
    """The struct of the policy's fields from two structs that have them."""
    return F.struct(*[_field(rules[k], judge[k], p).alias(k) for k, p in policy.items()])


def _field(rules: Column, judge: Column, policy: Policy) -> Column:
    if isinstance(policy, dict):
        return merged(rules, judge, policy)
    if isinstance(policy, Clamped):
        return F.greatest(F.lit(policy.low), F.least(F.lit(policy.high), F.coalesce(judge.cast("double"), rules.cast("double"), F.lit(policy.low))))
    if isinstance(policy, Rows):
        return _rows(rules, judge, policy)
    if policy == "ruled_only":
        return rules
    if policy in ("union", "union_judged"):
        return united(rules, judge) if policy == "union" else united(judge, rules)
    a, b = (judge, rules) if policy == "judged" else (rules, judge)
    return F.coalesce(_said(a), _said(b), F.lit(""))


def _said(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def united(*lists: Column) -> Column:
    """The texts of the lists in order, cleaned, each once."""
    some = F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists])
    return F.array_distinct(F.filter(F.transform(some, lambda x: text.clean_text(x)), lambda x: x.isNotNull()))


def once(rows: Column, keys: tuple[str, ...]) -> Column:
    """Rows whose keys, or description where these are blank, no row before them has; rows with neither are left out."""

    def name(r: Column) -> Column:
        blank = F.concat(*[r[k] for k in keys]) == ""
        return F.struct(*[r[k].alias(k) for k in keys], F.when(blank, r["description"]).otherwise("").alias("_d"))

    empty = lambda r: F.concat(*[r[k] for k in keys], r["description"]) == ""
    some = F.filter(rows, lambda r: ~empty(r))
    return text.let(F.transform(some, lambda r: F.struct(name(r).alias("name"), r.alias("row"))), lambda named: F.transform(F.filter(named, lambda n, i: F.array_position(F.transform(named, lambda m: m["name"]), n["name"]) == i + 1), lambda n: n["row"]))


def _rows(rules: Column, judge: Column, policy: Rows) -> Column:
    trimmed = lambda rows: F.transform(rows, lambda r: F.struct(*[F.trim(F.coalesce(r[f].cast("string"), F.lit(""))).alias(f) for f in policy.fields]))
    key = lambda r: F.struct(*[r[k].alias(k) for k in policy.keys])

    def both(s: Column) -> Column:
        def filled(r: Column) -> Column:
            other = F.get(F.filter(s["judge"], lambda j: key(j) == key(r)), F.lit(0))
            pick = lambda f: F.coalesce(*[F.nullif(x[f], F.lit("")) for x in ((other, r) if f in policy.judged else (r, other))], F.lit(""))
            return F.struct(*[pick(f).alias(f) for f in policy.fields])

        rest = F.filter(s["judge"], lambda j: ~F.exists(s["rules"], lambda r: key(r) == key(j)))
        return once(F.concat(F.transform(s["rules"], filled), rest), policy.keys)

    kind = f"array<struct<{','.join(f + ':string' for f in policy.fields)}>>"
    none = F.array().cast(kind)
    return text.let(F.struct(trimmed(F.coalesce(rules.cast(kind), none)).alias("rules"), trimmed(F.coalesce(judge.cast(kind), none)).alias("judge")), both)


_DATED = ("start_date", "end_date")
#: How a resume read by rules and one read by a judge become one.
RESUME: dict[str, Policy] = {
    "basic_info": {"name": "judged", "gender": "judged", "phone": "ruled", "email": "ruled", "school": "judged", "major": "judged", "degree": "judged", "graduation_year": "judged"},
    "education_experience": Rows(("school", "major", *_DATED), ("school", "school_level", "major", "degree", *_DATED, "description")),
    "internship_experience": Rows(("company_name", "position", *_DATED), ("company_name", "position", *_DATED, "description")),
    "project_experience": Rows(("project_name", *_DATED), ("project_name", "role", *_DATED, "description")),
    "skills": "union", "certificates": "union", "awards": "union", "self_evaluation": "judged", "target_job_intention": "ruled", "parse_warnings": "union_judged",
}
#: How scores by rules and a judge's supplement become a match: scores, items and details stay the rules', texts are the judge's.
MATCH: dict[str, Policy] = {
    "basic_requirement_score": "ruled_only", "vocational_skill_score": "ruled_only", "professional_quality_score": "ruled_only", "development_potential_score": "ruled_only", "overall_match_score": Clamped(),
    "strengths": "union_judged", "weaknesses": "union_judged", "improvement_suggestions": "union_judged", "recommendation": "judged", "analysis_summary": "judged", "build_warnings": "union",
}


def match_level(score: Column) -> Column:
    """The name of a match's level, by 90, 80, 70 and 60."""
    return text.banded(score, [(90.0, "A-高度匹配"), (80.0, "B-较高匹配"), (70.0, "C-中等匹配"), (60.0, "D-勉强匹配")], "E-匹配度较低")
