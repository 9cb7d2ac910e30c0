"""Entries of resumes: education, internships and projects, each a row with its dates and its description.

The lines of a section are read in order. A line that opens an entry is one with a range of dates or, in projects, one that
looks like a title; the lines up to the next opening belong to it. What opens is decided by windows over the lines of a
document, so a document is the unit of work, and all documents of a table are worked on at once by one shuffle on their key.

Defined results: null and blank texts have no entries; lines before the first opening belong to none; entries equal in their
naming fields count once, the first stays; an entry without these and without a description is left out.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, vocab
from . import resume

#: What a range of dates, a link, a label in a line and a hint at a period look like.
DATES = r"(\d{4}[./-]\d{1,2})\s*(?:~|-|—|–|至|到)\s*(\d{4}[./-]\d{1,2}|\d{1,2}[./-]\d{1,2}|至今|现在)"
LINK = r"(?i)https?://\S+"
LABELLED = r"(?:开发环境|项目描述|项目介绍|责任描述|职责描述|技术栈)[:：]"
PERIOD = r"(?:~|至今|现在|20\d{2}|\d{4}[./-]\d{1,2})"
TITLE_WORDS = r"(?:~|至今|现在|20\d{2}|项目|平台|系统|智能体|小程序|App|APP)"
ROLE = r"(?:角色|岗位|担任)[:：]\s*([^\n，,；;。]{2,30})"
ROLE_ENDS = r"^.{2,24}(?:工程师|实习生|助理|专员|经理)$"
NOT_A_MAJOR = r"(?i)(?:全日制|在校期间|奖学金|CET|英语|通过|获得|学院$)"
AFTER_MAJOR = r"(?:毕业设计|项目经历|工作经历|实习经历|技能证书|语言能力|计算机能力|其他能力|奖学金|获奖|优秀等级)"
LEVEL_FIRST = r"^[（(\[]?\s*(?:985|211|双一流|一本|二本)\s*[）)\]]?"


def _strip(c: Column, signs: str) -> Column:
    return F.regexp_replace(c, f"^[{signs}\\s]+|[{signs}\\s]+$", "")


def _first_of(c: Column, words: list[str]) -> Column:
    """The first word of the list that the text has; null for none."""
    return F.coalesce(*[F.when(F.contains(c, F.lit(w)), F.lit(w)) for w in words])


def _before(c: Column, word: Column, with_word: bool) -> Column:
    return F.left(c, F.instr(c, word) - 1 + (F.char_length(word) if with_word else 0))


def _after(c: Column, word: Column) -> Column:
    return F.substring(c, F.instr(c, word) + F.char_length(word), F.char_length(c))


def plain_description(c: Column) -> Column:
    """One space between words, before labels and after ends of sentences; no signs at the ends."""
    t = F.regexp_replace(F.trim(c), r"[\s\x{a0}\x{3000}]+", " ")
    t = F.regexp_replace(t, rf"(?<!^)\s*({'|'.join(map(re.escape, vocab.RESUME_LABELS))})", " $1")
    t = F.regexp_replace(F.regexp_replace(t, r"([；;。])(?=\S)", "$1 "), r"\s+", " ")
    return _strip(t, "，,；;")


def described(first: Column, lines: Column) -> Column:
    """The description that grows by each line whose text it doesn't have yet."""

    def grown(done: Column, line: Column) -> Column:
        return text.let(plain_description(line), lambda x: F.when((x == "") | F.contains(done, x), done).otherwise(plain_description(F.concat_ws(" ", done, x))))

    return F.aggregate(lines, plain_description(first), grown)


def distinct_nearby(lines: Column) -> Column:
    return resume.distinct_lines(F.array_join(lines, "\n"))


def by_dates(lines: Column) -> Column:
    """The lines, with those that hold several ranges of dates cut before each of them (what stands before the first is left out)."""
    signs = " ，,；;"

    def cut(line: Column) -> Column:
        parts = F.split(F.regexp_replace(line, DATES, "\u0001$0"), "\u0001")
        chunks = F.filter(F.transform(F.slice(parts, 2, 1_000_000), lambda p: _strip(p, signs)), lambda p: p != "")
        return F.when(F.size(parts) > 2, chunks).otherwise(F.array(F.trim(line)))

    return distinct_nearby(F.flatten(F.transform(lines, cut)))


def section_lines(df: DataFrame, key: str, body: str) -> DataFrame:
    """key, section, lines: the lines under each heading, in order, near repeats left out; a heading's own rest of the line is one.

    ``key`` names a document. Lines above all headings are the section ``header``.
    """
    lines = df.select(key, F.posexplode(F.split(resume.cleaned(F.col(body)), "\n")).alias("_n", "_line")).withColumn("_line", F.trim("_line")).filter("_line <> ''")
    compact = resume.compare_key(F.col("_line"))

    def heads(word: str) -> Column:
        own = resume.compare_key(F.lit(word))
        return (compact == own) | (compact == F.repeat(own, F.lit(2))) | (F.startswith(compact, own) & (F.char_length(compact) <= 3 * F.char_length(own)))

    words = [(name, w) for name, own in vocab.RESUME_HEADINGS.items() for w in own]
    alone = F.coalesce(*[F.when(heads(w), F.lit(name)) for name, w in words])
    inline = F.coalesce(*[F.when(F.startswith("_line", F.lit(w)), F.struct(F.lit(name).alias("name"), F.trim(F.regexp_extract("_line", rf"^{w}\s*[:：]?\s*(.*)$", 1)).alias("rest"))) for name, w in words])
    marked = lines.withColumn("_alone", alone).withColumn("_inline", F.when(F.col("_alone").isNull(), inline))
    head = F.coalesce("_alone", "_inline.name")
    w = Window.partitionBy(key).orderBy("_n")
    placed = marked.withColumn("section", F.coalesce(F.last(head, ignorenulls=True).over(w), F.lit("header")))
    said = placed.withColumn("_text", F.when(head.isNull(), F.col("_line")).otherwise(F.nullif("_inline.rest", F.lit("")))).filter("_text is not null")
    return said.groupBy(key, "section").agg(F.array_sort(F.collect_list(F.struct("_n", "_text"))).alias("_l")).select(key, "section", distinct_nearby(F.transform("_l", lambda x: x["_text"])).alias("lines"))


def _numbered(sections: DataFrame, key: str, section: str) -> DataFrame:
    """key, n, line, start_date, end_date, rest: the lines of a section, a range of dates to each at most."""
    rows = sections.filter(F.col("section") == section).select(key, F.posexplode(by_dates(F.col("lines"))).alias("n", "line"))
    start, end = F.regexp_extract("line", DATES, 1), F.regexp_extract("line", DATES, 2)
    whole = F.when(F.rlike(end, F.lit(r"^\d{1,2}[./-]\d{1,2}$")), F.concat(F.left(start, F.lit(4)), F.lit("."), end)).otherwise(end)
    point = lambda c: F.replace(c, F.lit("-"), F.lit("."))
    return rows.select(key, "n", "line", point(start).alias("start_date"), point(whole).alias("end_date"), _strip(F.regexp_replace("line", DATES, ""), " ：:，,；;").alias("rest"))


def _once(entries: DataFrame, key: str, naming: list[str]) -> DataFrame:
    """Entries with any naming field or a description, the first of those equal in these, numbered anew from 1."""
    blank = F.concat(*naming) == ""
    same = F.struct(*naming, F.when(blank, F.col("description")).alias("_d"))
    some = entries.filter(~(blank & (F.col("description") == ""))).withColumn("_same", same)
    first = some.withColumn("_k", F.row_number().over(Window.partitionBy(key, "_same").orderBy("entry"))).filter("_k = 1").drop("_k", "_same")
    return first.withColumn("entry", F.row_number().over(Window.partitionBy(key).orderBy("entry")))


def company_and_position(c: Column) -> Column:
    """struct(company_name, position, rest): a company up to the word that ends its name, a position up to the word that names
    it; without such a word the first word is the company, and all is the position where there is one word only."""
    signs = " ：:，,；;"

    def parts(body: Column) -> Column:
        end = _first_of(body, vocab.RESUME_COMPANY_ENDS)
        left = _strip(_after(body, end), signs)
        job = _first_of(left, vocab.RESUME_POSITIONS)
        words = F.split(body, r"\s+")
        named = F.struct(F.trim(_before(body, end, True)).alias("company_name"), F.when(job.isNull(), left).otherwise(_strip(_before(left, job, True), signs)).alias("position"), F.when(job.isNull(), "").otherwise(_strip(_after(left, job), signs)).alias("rest"))
        two = F.struct(words[0].alias("company_name"), F.array_join(F.slice(words, 2, 1_000_000), " ").alias("position"), F.lit("").alias("rest"))
        one = F.struct(F.lit("").alias("company_name"), body.alias("position"), F.lit("").alias("rest"))
        return F.when(end.isNotNull(), named).when(F.size(words) >= 2, two).otherwise(one)

    return text.let(F.trim(c), parts)


def internships(sections: DataFrame, key: str) -> DataFrame:
    """key, entry, company_name, position, start_date, end_date, description: entries that a range of dates opens."""
    rows = _numbered(sections, key, "internship").withColumn("_opens", F.col("start_date") != "")
    rows = rows.withColumn("entry", F.sum(F.col("_opens").cast("int")).over(Window.partitionBy(key).orderBy("n"))).filter("entry > 0")
    opened = F.max(F.when(F.col("_opens"), F.struct("start_date", "end_date", "rest")))
    lines = F.array_sort(F.collect_list(F.when(~F.col("_opens"), F.struct("n", "line"))))
    found = rows.groupBy(key, "entry").agg(opened.alias("_o"), lines.alias("_l")).withColumn("_c", company_and_position(F.col("_o.rest")))
    out = found.select(key, "entry", "_c.company_name", "_c.position", "_o.start_date", "_o.end_date", described(F.col("_c.rest"), F.transform("_l", lambda x: x["line"])).alias("description"))
    return _once(out.filter((F.col("company_name") != "") | (F.col("position") != "") | (F.col("description") != "")), key, ["company_name", "position", "start_date", "end_date"])


def project_name(c: Column) -> Column:
    name = F.regexp_replace(F.trim(F.regexp_replace(plain_description(c), LINK, "")), rf"{LABELLED}.*$", "")
    return _strip(F.regexp_replace(F.regexp_replace(name, r"[-—–~]+", " "), r"\s+", " "), " ：:，,；;。")


def project_role(line: Column) -> Column:
    """What follows a label of roles; else a line that names a position; else nothing."""
    labelled = F.trim(F.regexp_extract(line, ROLE, 1))
    plain = F.trim(F.regexp_replace(plain_description(line), LINK, ""))
    return F.when(labelled != "", labelled).when(text.any_of(plain, vocab.RESUME_POSITIONS) | F.rlike(plain, F.lit(ROLE_ENDS)), plain).otherwise("")


def looks_like_title(line: Column) -> Column:
    """A short line without ends of clauses that has a word of projects or a period, and is no label, link, heading or position."""

    def judged(t: Column) -> Column:
        label = F.rlike(t, F.lit(LABELLED)) | F.rlike(t, F.lit("^(?:项目描述|项目介绍|职责描述|责任描述|技术栈|开发环境)"))
        position = text.any_of(t, vocab.RESUME_POSITIONS) & (F.contains(F.lower(t), F.lit("http")) | F.rlike(t, F.lit(ROLE_ENDS)))
        right = F.rlike(t, F.lit(TITLE_WORDS)) & ~t.isin(*vocab.RESUME_PROJECT_HEADINGS) & (F.char_length(t) <= 48) & ~F.rlike(t, F.lit("[，,。;；]"))
        return right & ~label & ~F.rlike(t, F.lit(r"(?i)^(?:https?://|www\.)")) & ~position

    return text.let(plain_description(line), judged)


def projects(sections: DataFrame, key: str) -> DataFrame:
    """key, entry, project_name, role, start_date, end_date, description.

    A range of dates opens an entry, and so does a line like a title if it is the first of all or hints at a period. The first
    line of an entry that names a role gives it; what else the line says goes to the description.
    """
    rows = _numbered(sections, key, "project").withColumn("_dated", F.col("start_date") != "")
    rows = rows.withColumn("_name", F.when(F.col("_dated"), project_name(F.col("rest"))).when(looks_like_title(F.col("line")), project_name(F.col("line"))).otherwise(""))
    w = Window.partitionBy(key).orderBy("n")
    could = F.col("_dated") | (F.col("_name") != "")
    before = F.coalesce(F.max(could).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    rows = rows.withColumn("_opens", F.col("_dated") | ((F.col("_name") != "") & (~before | F.rlike("line", F.lit(PERIOD)))))
    rows = rows.withColumn("entry", F.sum(F.col("_opens").cast("int")).over(w)).filter("entry > 0").withColumn("_role", F.when(F.col("_opens"), "").otherwise(project_role(F.col("line"))))
    said = F.when(F.col("_dated"), _strip(F.regexp_extract("rest", rf"({LABELLED}.*)$", 1), " ：:，,；;")).otherwise("")
    opened = F.max(F.when(F.col("_opens"), F.struct("start_date", "end_date", "_name", said.alias("said"))))
    lines = F.array_sort(F.collect_list(F.when(~F.col("_opens"), F.struct("n", "line"))))
    found = rows.groupBy(key, "entry").agg(opened.alias("_o"), lines.alias("_l"), F.min(F.when(F.col("_role") != "", F.struct("n", "_role"))).alias("_r"))
    rest = lambda x: plain_description(F.regexp_replace(x, LINK, ""))
    body = F.transform("_l", lambda x: F.when(F.coalesce(x["n"] == F.col("_r.n"), F.lit(False)), F.when(rest(x["line"]) == F.col("_r._role"), "").otherwise(rest(x["line"]))).otherwise(x["line"]))
    out = found.select(key, "entry", F.col("_o._name").alias("project_name"), F.coalesce("_r._role", F.lit("")).alias("role"), "_o.start_date", "_o.end_date", described(F.col("_o.said"), body).alias("description"))
    return _once(out.filter((F.col("project_name") != "") | (F.col("description") != "")), key, ["project_name", "start_date", "end_date"])


def degree_in(c: Column) -> Column:
    """The highest degree that a text says, by name or by year of study; empty for none."""
    rules = [("(?:博士|博[一二三四]|博士后)", "博士"), ("(?:硕士|研究生|研[一二三])", "硕士"), ("(?:本科|学士|大[一二三四五])", "本科"), ("(?:专科|大专)", "专科")]
    return F.coalesce(*[F.when(F.rlike(c, F.lit(p)), F.lit(name)) for p, name in rules], F.lit(""))


def school_parts(c: Column) -> Column:
    """struct(school, school_level, major, degree, rest) of a line of education without its dates."""

    def parts(body: Column) -> Column:
        levels = F.array_join(F.array_compact(F.array(*[F.when(F.rlike(body, F.lit(p)), F.lit(name)) for name, p in vocab.RESUME_SCHOOL_LEVELS])), " / ")
        school = F.trim(F.regexp_extract(body, r"^(.+?(?:大学|学院|学校))", 1))
        left = F.trim(F.regexp_replace(F.trim(F.regexp_replace(body, r"^(.+?(?:大学|学院|学校))", "")), LEVEL_FIRST, ""))

        def majored(rest: Column) -> Column:
            word = _first_of(rest, vocab.RESUME_DEGREES)
            degree = F.coalesce(word, degree_in(F.concat_ws(" ", body, rest)))
            after = F.when(word.isNull(), "").otherwise(F.regexp_replace(_after(rest, word), "^学位", ""))
            spaced = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "[，,；;。]+", " "), r"\s+", " "))
            named = spaced(F.when(word.isNull(), rest).otherwise(_before(rest, word, False)))
            said = F.regexp_extract(named, rf"({AFTER_MAJOR}.*)$", 1)
            major = F.trim(F.regexp_replace(F.regexp_replace(named, rf"{AFTER_MAJOR}.*$", ""), LEVEL_FIRST, ""))
            major = F.trim(F.regexp_replace(F.trim(F.regexp_replace(major, r"(?:本科|硕士|博士)?在读$", "")), r"(?:大[一二三四五六七八九十]|研[一二三]|博[一二三四])$", ""))
            return F.struct(school.alias("school"), levels.alias("school_level"), _strip(major, " ，,；;。").alias("major"), degree.alias("degree"), F.trim(F.concat_ws(" ", said, spaced(after))).alias("rest"))

        return text.let(left, majored)

    return text.let(F.trim(c), parts)


_EDUCATION = ["school", "school_level", "major", "degree", "start_date", "end_date", "description"]


def schools(sections: DataFrame, key: str) -> DataFrame:
    """key, entry, school, school_level, major, degree, start_date, end_date, description.

    The first line that names a school opens an entry, dated or not; after it a dated line with a school or a degree does. Other
    dated lines fill what is missing; of the others one may say the degree, one the major, the rest is the description.
    """
    rows = _numbered(sections, key, "education")
    w = Window.partitionBy(key).orderBy("n")
    school = F.rlike("line", F.lit("大学|学院|学校"))
    named = school | text.any_of(F.col("line"), vocab.RESUME_DEGREES)
    dated = F.col("start_date") != ""
    could = school | (dated & named)
    before = F.coalesce(F.max(could).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    rows = rows.withColumn("_opens", could & (~before | (dated & named)))
    rows = rows.withColumn("entry", F.sum(F.col("_opens").cast("int")).over(w)).filter("entry > 0").withColumn("_p", school_parts(F.col("rest")))
    each = F.struct("n", "line", "rest", "_opens", "start_date", "end_date", F.col("_p.school").alias("school"), F.col("_p.school_level").alias("school_level"), F.col("_p.major").alias("major"), F.col("_p.degree").alias("degree"), F.col("_p.rest").alias("said"))
    found = rows.groupBy(key, "entry").agg(F.array_sort(F.collect_list(each)).alias("_l"))
    state = lambda values: F.struct(*[v.alias(k) for k, v in zip(_EDUCATION, values, strict=True)])
    first = F.col("_l")[0]
    start = state([first[k] for k in ("school", "school_level", "major", "degree", "start_date", "end_date")] + [plain_description(first["said"])])
    fill = lambda a, b: F.when(a == "", b).otherwise(a)

    def step(s: Column, x: Column) -> Column:
        more = lambda c: described(s["description"], F.array(c))
        filled = [fill(s[k], x[k]) for k in ("school", "school_level", "major", "degree", "start_date", "end_date")]
        with_dates = state([*filled, more(x["said"])])
        degree = degree_in(x["line"])
        kept = [s[k] for k in _EDUCATION]
        as_degree = state([*kept[:3], degree, *kept[4:]])
        as_major = state([*kept[:2], F.trim(x["line"]), *kept[3:]])
        as_text = state([*kept[:6], more(x["line"])])
        dates_only = state([*kept[:4], fill(s["start_date"], x["start_date"]), fill(s["end_date"], x["end_date"]), s["description"]])
        return (
            F.when((x["start_date"] != "") & (x["rest"] != ""), with_dates).when(x["start_date"] != "", dates_only).when((degree != "") & (s["degree"] == ""), as_degree)
            .when((s["major"] == "") & ~F.rlike(x["line"], F.lit(NOT_A_MAJOR)), as_major).otherwise(as_text)
        )

    out = found.withColumn("_e", F.aggregate(F.slice("_l", 2, 1_000_000), start, step)).select(key, "entry", "_e.*")
    return _once(out, key, ["school", "major", "start_date", "end_date"])
