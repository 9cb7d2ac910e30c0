"""Resume text: sections by headings, contacts by scored candidates, entities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import parse, text, vocab
from ..functions.similarity import nfkc

HEADINGS = [("education", "教育|education"), ("internship", "实习|internship"), ("project", "项目|project"), ("skill", "技能|skill"), ("certificate", "证书|certificate"), ("award", "获奖|荣誉|award"), ("evaluation", "自我评价|summary")]
EMAIL = r"([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)"
PHONE = r"(?<!\d)((?:\+?86[-\s]*)?1[3-9]\d[-\s]*\d{4}[-\s]*\d{4})"
LANDLINE = r"(?<!\d)(0\d{2,3}[-\s]?\d{7,8})(?!\d)"


def cleaned(body: Column) -> Column:
    """One form of each letter, plain spaces and line ends, no tags, no runs of blank lines; lines trimmed."""
    t = F.regexp_replace(F.regexp_replace(nfkc(body), r"[\x00]", ""), r"[\x01-\x08\x0b\x0c\x0e-\x1f\x7f]", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"\r\n?", "\n"), r"<[^>]+>", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t\f\x0b\x{a0}\x{3000}]+", " "), r"\n{3,}", "\n\n")
    return F.trim(F.regexp_replace(t, r" ?\n ?", "\n"))


def compare_key(line: Column) -> Column:
    """A line without white space, punctuation and case."""
    return F.lower(F.regexp_replace(line, r"[\s：:，,；;。、“”\"'·\-_~—–|/\\()（）\[\]【】]+", ""))


def distinct_lines(body: Column, back: int = 4) -> Column:
    """Lines with text that none of the ``back`` kept lines before them equals, punctuation and case aside."""
    lines = F.transform(F.split(body, r"\n"), lambda x: F.struct(compare_key(x).alias("key"), F.trim(x).alias("line")))
    kind = "array<struct<key:string,line:string>>"
    step = lambda kept, x: F.when((x["key"] == "") | F.exists(F.slice(kept, -F.least(F.size(kept), F.lit(back)), F.lit(back)), lambda k: k["key"] == x["key"]), kept).otherwise(F.concat(kept, F.array(x)))
    guarded = lambda kept, x: F.when((F.size(kept) == 0) & (x["key"] != ""), F.array(x)).when(F.size(kept) == 0, kept).otherwise(step(kept, x))
    return F.transform(F.aggregate(lines, F.array().cast(kind), guarded), lambda x: x["line"])


def sections(df: DataFrame, key: str, body: str) -> DataFrame:
    """key, line_no, line, section: the last heading at or above each line of the cleaned text, near repeats of lines left out."""
    lines = df.select(key, cleaned(F.col(body)).alias("_b")).select(key, F.posexplode(distinct_lines(F.col("_b"))).alias("line_no", "line"))
    short = F.char_length("line") <= 12
    head = F.coalesce(*[F.when(short & F.rlike(F.lower("line"), F.lit(p)), F.lit(n)) for n, p in HEADINGS])
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("_head", head).withColumn("section", F.coalesce(F.last("_head", ignorenulls=True).over(w), F.lit("header"))).filter("_head is null").drop("_head")


DATES = r"((?:19|20)\d{2}[./-]\d{1,2})\s*(?:-|–|—|~|至|到)+\s*((?:19|20)\d{2}[./-]\d{1,2}|至今|今)"


def dated_entries(lines: DataFrame, key: str, section: str) -> DataFrame:
    """key, entry, start_date, end_date, head, description: the entries of a section, each from a line with a range of dates to the next."""
    mine = lines.filter(F.col("section") == section).withColumn("_dated", F.rlike("line", F.lit(DATES)))
    mine = mine.withColumn("entry", F.sum(F.col("_dated").cast("int")).over(Window.partitionBy(key).orderBy("line_no"))).filter("entry > 0")
    date = lambda k: F.replace(F.regexp_extract("line", DATES, k), F.lit("-"), F.lit("."))
    first = lambda c: F.max(F.when(F.col("_dated"), c))
    rest = F.array_sort(F.collect_list(F.when(~F.col("_dated"), F.struct("line_no", "line"))))
    found = mine.groupBy(key, "entry").agg(first(date(1)).alias("start_date"), first(date(2)).alias("end_date"), first(F.trim(F.regexp_replace("line", DATES, ""))).alias("head"), rest.alias("_r"))
    return found.select(key, "entry", "start_date", "end_date", "head", F.array_join(F.transform("_r", lambda x: x["line"]), "\n").alias("description"))


def education(entries: DataFrame) -> DataFrame:
    """Entries with school (the word that names one), degree and major (what the head has besides)."""
    school = F.regexp_extract("head", r"(\S*(?:大学|学院|学校))", 1)
    degree = F.coalesce(*[F.when(F.contains("head", F.lit(d)), F.lit(d)) for d in vocab.RESUME_DEGREES], F.lit(""))
    with_parts = entries.withColumns({"school": school, "degree": degree})
    major = F.trim(F.regexp_replace(F.replace(F.replace(F.col("head"), F.col("school"), F.lit("")), F.when(F.col("degree") != "", F.col("degree")).otherwise(F.lit("\0")), F.lit("")), r"[\s,，;；|/()（）]+", " "))
    return with_parts.withColumn("major", major)


def entities(lines: DataFrame, key: str) -> DataFrame:
    """key, skills, certificates, awards of sectioned lines: each from its own section, or from the whole text if that has none."""
    of = lambda name: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("section") == name, F.struct("line_no", "line")))), lambda x: x["line"]), "\n")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    texts = lines.groupBy(key).agg(of("skill").alias("_s"), of("certificate").alias("_c"), of("award").alias("_a"), whole.alias("_w"))
    own = lambda c: F.when(F.col(c) != "", F.col(c)).otherwise(F.col("_w"))
    return texts.select(key, parse.resume_skills(F.col("_s"), F.col("_w")).alias("skills"), parse.resume_certificates(own("_c")).alias("certificates"), parse.resume_awards(own("_a")).alias("awards"))


def _context(body: Column, at: Column) -> Column:
    """The line that the place (from 1) is in; 160 letters from the place on if no line ends after it."""
    before = F.element_at(F.split(F.substring(body, F.lit(1), at - 1), "\n"), -1)
    rest = F.substring(body, at, F.char_length(body))
    return F.trim(F.concat(before, F.when(F.contains(rest, F.lit("\n")), F.substring_index(rest, "\n", 1)).otherwise(F.left(rest, F.lit(160)))))


def _early(at: Column) -> Column:
    return F.when(at <= 800, 18).when(at <= 2000, 8).otherwise(0)


def _ranked(body: Column, found: Column, score) -> Column:
    """array<struct(score, neg, value)>, best first, ties by place."""
    placed = F.transform(found, lambda v: F.struct(F.instr(body, v).alias("at"), v.alias("value")))
    scored = F.transform(placed, lambda p: F.struct(score(p["value"], p["at"], _context(body, p["at"])).alias("score"), (-p["at"]).alias("neg"), p["value"].alias("value")))
    return F.sort_array(scored, asc=False)


def emails(body: Column) -> Column:
    """100, 30 for a word of contact in the line, 18 or 8 for an early place, 8 for a known domain, 5 for a short one, 12 off for runs of signs."""

    def score(v: Column, at: Column, line: Column) -> Column:
        domain = F.lower(F.substring_index(v, "@", -1))
        known = domain.isin(*vocab.EMAIL_DOMAINS) | reduce(lambda a, b: a | b, [F.endswith(domain, F.lit(f".{d}")) for d in vocab.EMAIL_DOMAINS])
        points = 100 + F.when(text.any_of(line, vocab.EMAIL_CONTEXT), 30).otherwise(0) + _early(at) + F.when(known, 8).otherwise(0)
        return points + F.when(F.char_length(v) <= 40, 5).otherwise(0) - F.when(F.rlike(v, F.lit("[-+%]{2,}")), 12).otherwise(0)

    return text.let(body, lambda b: _ranked(b, F.array_distinct(F.regexp_extract_all(b, F.lit(EMAIL), F.lit(1))), score))


def phones(body: Column) -> Column:
    """Mobile numbers 110 and 8, landlines 72; 28 for a word of contact in the line, 18 or 8 for an early place, 40 off beside other numbers' names."""

    def score(base: int):
        def points(v: Column, at: Column, line: Column) -> Column:
            return base + F.when(text.any_of(line, vocab.PHONE_CONTEXT), 28).otherwise(0) + _early(at) - F.when(F.rlike(line, F.lit(vocab.NOT_A_PHONE)), 40).otherwise(0)

        return points

    def found(b: Column) -> Column:
        some = lambda pattern, base: _ranked(b, F.array_distinct(F.regexp_extract_all(b, F.lit(pattern), F.lit(1))), score(base))
        return F.sort_array(F.concat(some(PHONE, 118), some(LANDLINE, 72)), asc=False)

    def plain(v: Column) -> Column:
        digits = F.regexp_replace(v, r"\D", "")
        mobile = F.regexp_extract(digits, r"(1[3-9]\d{9})$", 1)
        return F.when(mobile != "", mobile).otherwise(digits)

    return F.transform(text.let(body, found), lambda c: F.struct(c["score"].alias("score"), c["neg"].alias("neg"), plain(c["value"]).alias("value")))


def best_email(body: Column) -> Column:
    return F.get(emails(body), F.lit(0))["value"]


def best_phone(body: Column) -> Column:
    return F.get(phones(body), F.lit(0))["value"]


def merged_fields(rule: DataFrame, judged: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The rules' fields, filled from the judged table where they are blank."""
    j = judged.select(key, *[F.col(c).alias(f"_j_{c}") for c in columns])
    return rule.join(j, key, "left").withColumns({c: F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), F.col(f"_j_{c}")) for c in columns}).drop(*[f"_j_{c}" for c in columns])


def warnings(columns: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.lit(f"missing_{n}")) for n, c in columns.items()]))
