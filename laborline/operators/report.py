"""Report sections as text columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import report_texts as texts
from ..functions import text, vocab


def salary_text(low: Column, high: Column) -> Column:
    return F.when(low.isNull() & high.isNull(), "n/a").otherwise(F.concat(F.format_string("%.0f", F.coalesce(low, high)), F.lit("-"), F.format_string("%.0f", F.coalesce(high, low))))


def percent_text(ratio: Column) -> Column:
    return F.concat(F.format_string("%.1f", ratio * 100), F.lit("%"))


def markdown(df: DataFrame, sections: dict[str, Column], out: str = "report") -> DataFrame:
    """One document a row: a heading and a body for every section that has one, in the fixed order."""
    parts = [F.when(sections[k].isNotNull(), F.concat(F.lit(f"## {k}\n\n"), sections[k])) for k in vocab.REPORT_SECTIONS if k in sections]
    return df.withColumn(out, F.concat_ws("\n\n", *parts))


def missing_sections(report: Column) -> Column:
    """Section names whose heading is not in the report."""
    return F.array_compact(F.array(*[F.when(~F.contains(report, F.lit(f"## {k}\n")), F.lit(k)) for k in vocab.REPORT_SECTIONS]))


class Payload:
    """Templates of text compiled against a DataFrame of one struct a snapshot; a field that the schema hasn't got is null."""

    def __init__(self, df: DataFrame) -> None:
        self.schema = df.schema

    def column(self, path: str) -> Column | None:
        kind = self.schema
        for name in path.split("."):
            if not isinstance(kind, StructType) or name not in kind.fieldNames():
                return None
            kind = kind[name].dataType
        return F.col(path)

    def value(self, path: str) -> Column:
        """The field's text without blanks around it; null where it says nothing."""
        c = self.column(path)
        return F.lit(None).cast("string") if c is None else text.clean_text(c, entities=False)

    def texts(self, path: str) -> Column:
        c = self.column(path)
        empty = F.array().cast("array<string>")
        cleaned = lambda a: F.array_distinct(F.filter(F.transform(a, lambda x: text.clean_text(x, entities=False)), lambda x: x.isNotNull()))
        return empty if c is None else F.coalesce(cleaned(c.cast("array<string>")), empty)

    def field(self, kind: str, paths: list[str], otherwise: str) -> Column:
        if kind.startswith("list"):
            most = int(kind[4:] or 1_000_000)
            first = F.coalesce(*[F.when(F.size(t) > 0, t) for t in map(self.texts, paths)])
            return F.coalesce(F.array_join(F.slice(first, 1, most), "、"), F.lit(otherwise or texts.NONE))
        c = self.column(paths[0])
        if kind == "number":
            return F.format_string("%.2f", F.coalesce(F.lit(None).cast("double") if c is None else c.cast("double"), F.lit(0.0)))
        if kind:
            return F.lit(otherwise or texts.NONE) if c is None else F.coalesce(KINDS[kind](c), F.lit(otherwise or texts.NONE))
        return F.coalesce(*map(self.value, paths), F.lit(otherwise))

    def line(self, template: str) -> Column:
        """A line with its fields filled; null if it depends on a blank field."""
        asked = re.match(r"\?([\w.]+)\?", template)
        parts = []
        for k, part in enumerate(re.split(r"\{([^{}]*)\}", template[asked.end() :] if asked else template)):
            if k % 2 == 0:
                parts += [F.lit(part)] if part else []
                continue
            said, _, otherwise = part.partition("|")
            kind, _, paths = said.rpartition(":")
            parts.append(self.field(kind, paths.split(" or "), otherwise))
        whole = F.concat(*parts)
        return F.when(self.value(asked[1]).isNotNull(), whole) if asked else whole

    def lines(self, templates: list[str]) -> Column:
        return F.array(*[self.line(t) for t in templates])


def _whole(share: Column) -> Column:
    """A ratio of up to 1, or a number of hundredths, as whole hundredths."""
    return F.concat(F.bround(F.when(share <= 1, share * 100).otherwise(share), 0).cast("long").cast("string"), F.lit("%"))


def _joined(rows: Column, row, sign: str, most: int = 1_000_000) -> Column:
    """The texts of the first ``most`` rows, those that have one; null for none."""
    return F.nullif(F.array_join(F.filter(F.transform(F.slice(F.array_distinct(rows), 1, most), row), lambda x: x.isNotNull() & (x != "")), sign), F.lit(""))


def _share(x: Column) -> Column:
    name = F.nullif(F.trim(x["name"]), F.lit(""))
    counted = F.when(x["ratio"].isNotNull(), F.concat(F.lit("（"), _whole(x["ratio"]), F.coalesce(F.concat(F.lit("，样本"), x["count"].cast("string")), F.lit("")), F.lit("）")))
    return F.concat(name, F.coalesce(counted, F.lit("")))


def _experience(head: Column, x: Column) -> Column:
    said = F.nullif(F.trim(x["description"]), F.lit(""))
    return F.concat(head, F.coalesce(F.concat(F.lit("："), said), F.lit("")))


def _internship(x: Column) -> Column:
    position = F.nullif(F.trim(x["position"]), F.lit(""))
    return _experience(F.concat(F.coalesce(F.nullif(F.trim(x["company_name"]), F.lit("")), F.lit("未注明公司")), F.coalesce(F.concat(F.lit("-"), position), F.lit(""))), x)


def ability_actions(abilities: Column, most: int = 4) -> Column:
    """What to do about the abilities at risk, ``most`` texts, each once."""
    keywords = lambda x: F.coalesce(F.nullif(F.array_join(F.slice(x["keywords"], 1, 4), "、"), F.lit("")), F.lit(texts.NONE))
    one = lambda x: F.coalesce(*[F.when(x["label"] == k, v) for k, v in texts.ABILITY_ACTIONS.items()], F.when(x["label"] == "专业技能", F.concat(F.lit("围绕岗位高频技能继续补强："), keywords(x), F.lit("。"))), F.concat(F.lit("围绕"), x["label"], F.lit("补充可量化经历证据。")))
    at_risk = F.filter(F.coalesce(abilities, F.array()), lambda x: x["risk_level"].isin("risk", "no_match"))
    return F.slice(F.array_distinct(F.transform(at_risk, one)), 1, most)


def _points(c: Column) -> Column:
    return F.concat(F.bround(F.coalesce(c.cast("double"), F.lit(0.0)), 0).cast("long").cast("string"), F.lit("分"))


KINDS = {
    "bool": lambda c: F.when(c, "通过").when(~c, "未通过"),
    "percent": lambda c: _whole(c.cast("double")),
    "shares": lambda c: _joined(c, _share, "、", 5),
    "named": lambda c: _joined(c, lambda x: F.concat(F.nullif(F.trim(x["name"]), F.lit("")), F.coalesce(F.concat(F.lit("（占比"), x["ratio"].cast("string"), F.lit("，样本"), x["count"].cast("string"), F.lit("）")), F.lit(""))), "、", 5),
    "projects": lambda c: _joined(c, lambda x: _experience(F.coalesce(F.nullif(F.trim(x["project_name"]), F.lit("")), F.lit("未命名项目")), x), "；", 5),
    "internships": lambda c: _joined(c, _internship, "；", 5),
    "abilities": lambda c: _joined(c, lambda x: F.concat(x["label"], _points(x["score"]), F.lit("（"), F.coalesce(F.nullif(F.trim(x["level"]), F.lit("")), F.lit("未明确")), F.coalesce(F.concat(F.lit("，样本证据占比"), _whole(x["evidence_ratio"])), F.lit("")), F.coalesce(F.concat(F.lit("，关键词："), F.nullif(F.array_join(F.slice(x["keywords"], 1, 4), "、"), F.lit(""))), F.lit("")), F.lit("）")), "；"),
    "gaps": lambda c: _joined(c, lambda x: F.concat(x["label"], F.lit("：学生"), _points(x["student_score"]), F.lit("，岗位要求"), _points(x["job_score"]), F.lit("，差距"), _points(x["gap"]), F.lit("，风险="), F.coalesce(F.nullif(F.trim(x["risk_level"]), F.lit("")), F.lit("未明确")), F.lit("，"), F.coalesce(F.nullif(F.trim(x["message"]), F.lit("")), F.lit("暂无说明"))), "；"),
    "actions": lambda c: F.nullif(F.array_join(ability_actions(c), "、"), F.lit("")),
}


def _numbered(items: Column, otherwise: str) -> Column:
    numbered = F.transform(items, lambda x, k: F.concat((k + 1).cast("string"), F.lit(". "), x))
    return F.when(F.size(items) > 0, numbered).otherwise(F.array(F.lit(otherwise)))


def section_texts(df: DataFrame) -> dict[str, Column]:
    """The text of each section of a report, by its title, in order, from rows of the structs student, job, match, target and plan.

    Every struct and every field of it may be absent. Without paths of the goal no path is written: the plans are filled from
    what is missing instead, and what speaks of paths is left out of them.
    """
    p = Payload(df)
    no_paths = F.coalesce((p.value("plan.path_status") == "missing") | (p.value("plan.path_strategy") == "no_target_path_data"), p.value("plan.path_status") == "missing", p.value("plan.path_strategy") == "no_target_path_data", F.lit(False))
    main = F.coalesce(p.value("plan.primary_plan_job"), p.value("plan.primary_target_job"))
    other = F.coalesce(p.value("plan.user_target_job") != main, F.lit(False))
    empty = F.array().cast("array<string>")
    has = lambda path: F.coalesce(p.column(path).cast("boolean"), F.lit(False)) if p.column(path) is not None else F.lit(False)
    named = F.coalesce(p.value("job.resolved_job_name"), p.value("job.requested_job_name"), p.value("job.standard_job_name"), F.lit(""))
    status = F.when(has("job.asset_found"), F.concat(F.lit(texts.ASSET_FOUND[0]), named, F.lit(texts.ASSET_FOUND[1]))).otherwise(texts.ASSET_MISSING)
    paid = F.coalesce(p.value("job.salary_min"), p.value("job.salary_max"), p.value("job.salary_mid")).isNotNull()
    salary = F.when(paid, p.line(re.sub(r"\}", "|None}", texts.SALARY))).otherwise("暂无明确薪资统计")
    job = F.concat(p.lines(texts.JOB[:1]), F.array(F.concat(p.line(texts.JOB[1].replace("{job.asset_status}", "")), status)), p.lines(texts.JOB[2:12]), F.array(F.concat(F.lit("薪资概况："), salary, F.lit("。"))), p.lines(texts.JOB[13:]))
    matched = F.concat(p.lines(texts.MATCH), F.array(F.when(~has("target.asset_found"), texts.NO_ASSETS), p.line(texts.EXPLAINED)))
    goal = F.concat(p.lines(texts.GOAL), F.when(no_paths, p.lines(texts.NO_PATHS)).otherwise(p.lines(texts.PATHS)))
    abilities = p.column("target.abilities")
    actions = empty if abilities is None else ability_actions(abilities)
    short, mid = p.texts("plan.short_term_plan"), p.texts("plan.mid_term_plan")
    rest = F.filter(mid, lambda x: ~text.any_of(x, texts.PATH_WORDS))
    short = F.when(no_paths, F.array_distinct(F.concat(short, p.lines(texts.SHORT_WITHOUT_PATHS), actions))).otherwise(short)
    mid_lines = [p.line(t) for t in texts.MID_WITHOUT_PATHS]
    mid = F.when(no_paths, F.array_distinct(F.array_compact(F.concat(rest, F.array(mid_lines[0], F.when(other, mid_lines[1]), mid_lines[2]))))).otherwise(mid)
    plan = F.concat(F.array(F.lit(texts.SHORT)), _numbered(short, texts.NO_SHORT), F.array(F.lit(texts.MID)), _numbered(mid, texts.NO_MID))
    conclusion = F.when(~no_paths, p.line(texts.CONCLUDED)).when(other, p.line(texts.CONCLUDED_OTHER)).otherwise(p.line(texts.CONCLUDED_SAME))
    advice = F.when(other, p.line(texts.ADVICE_OTHER)).otherwise(p.line(texts.ADVICE))
    summary = F.concat(F.array(F.concat(F.lit("综合结论："), conclusion)), p.lines(texts.SUMMARY), F.array(F.concat(F.lit("核心建议："), advice), p.line(texts.ADDRESSED)))
    bodies = [p.lines(texts.STUDENT), job, matched, goal, plan, p.lines(texts.RISK), summary]
    return {title: F.array_join(F.array_compact(body), "\n") for title, body in zip(texts.TITLES, bodies, strict=True)}


def sections(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, place, title, content: the seven sections of each report, a row each."""
    each = F.array(*[F.struct(F.lit(title).alias("title"), body.alias("content")) for title, body in section_texts(df).items()])
    return df.select(*keys, F.posexplode(each).alias("place", "_s")).select(*keys, (F.col("place") + 1).alias("place"), "_s.title", "_s.content")


def completeness(sections: DataFrame, keys: list[str]) -> DataFrame:
    """keys, missing: the titles of the seven sections that a report has no text for, in order."""
    have = sections.filter(F.trim("content") != "").groupBy(*keys).agg(F.collect_set("title").alias("_have"))
    return have.select(*keys, F.array_except(F.array(*[F.lit(t) for t in texts.TITLES]), F.col("_have")).alias("missing"))
