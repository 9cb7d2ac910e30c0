"""Facts about a student and the recommended job, each from the first of several sources that has it, with that source's name."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text
from .sqlapi import city_in_question

#: Words of lines that tell where someone lives, and where they want to work; what is said of no value. Fixed values.
HOME_WORDS = ["现居", "居住", "所在地", "住址", "地址", "location"]
WISH_WORDS = ["意向城市", "期望城市", "期望地点", "工作地点", "就业意愿", "求职意向", "求职地点"]
NOT_GIVEN, NO_JOB, NO_PLACE, NO_SALARY = "未提供", "未提供推荐岗位", "暂无地点信息", "暂无薪资信息"
MOST_CITIES, MOST_POINTS = 5, 8


def cascade(sources: Iterable[tuple[str, Column]], otherwise: str) -> Column:
    """struct(value, source): the first value that isn't blank and the name of its source; ``otherwise`` and null for none."""
    kind = "struct<value:string,source:string>"
    said = [F.when(F.trim(c) != "", F.struct(F.trim(c).alias("value"), F.lit(name).alias("source"))) for name, c in sources]
    return F.coalesce(*said, F.struct(F.lit(otherwise), F.lit(None).cast("string")).cast(kind))


def first_list(sources: Iterable[tuple[str, Column]], most: int) -> Column:
    """struct(value, source) of the first list with an item: its different items, ``most`` of them; an empty list for none."""
    kind = "struct<value:array<string>,source:string>"
    tidy = lambda c: F.slice(F.array_distinct(F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))), 1, most)

    def said(name: str, c: Column) -> Column:
        return text.let(tidy(c), lambda v: F.when(F.size(v) > 0, F.struct(v.alias("value"), F.lit(name).alias("source"))))

    return F.coalesce(*[said(name, c) for name, c in sources], F.struct(F.array().cast("array<string>"), F.lit(None).cast("string")).cast(kind))


def place_in_lines(body: Column, words: list[str]) -> Column:
    """What the first telling line says: of the lines with one of the words, the city behind the colon (or in the line), or what
    stands there if it has 20 letters at most; NULL for none."""
    lines = F.filter(F.transform(F.split(F.coalesce(body, F.lit("")), r"[\r\n]+"), lambda x: F.trim(x)), lambda x: text.any_of(x, words))

    def told(line: Column) -> Column:
        said = F.trim(F.regexp_replace(F.when(F.rlike(line, F.lit("[:：]")), F.regexp_extract(line, r"(?s)^[^:：]*[:：](.*)$", 1)).otherwise(line), r"^\s+|\s+$", ""))
        return text.let(said, lambda s: F.coalesce(city_in_question(s), F.when((s != "") & (F.char_length(s) <= 20), s)))

    return F.get(F.array_compact(F.transform(lines, told)), F.lit(0))


def user_location(addresses: list[tuple[str, Column]], wishes: list[tuple[str, Column]], targets: list[tuple[str, Column]], resume: Column) -> Column:
    """struct(user_address, employment_intention_address, target_job_intention), each a value with its source: the fields in turn,
    then the resume's lines, and of wishes at last a city in the job that is wanted."""
    target = cascade(targets, NOT_GIVEN)
    wanted = F.when(target["source"].isNotNull(), city_in_question(target["value"]))
    return F.struct(
        cascade([*addresses, ("resume_lines", place_in_lines(resume, HOME_WORDS))], NOT_GIVEN).alias("user_address"),
        cascade([*wishes, ("resume_lines", place_in_lines(resume, WISH_WORDS)), ("target_job_intention", wanted)], NOT_GIVEN).alias("employment_intention_address"),
        target.alias("target_job_intention"),
    )


def salary_said(low: Column, high: Column, middle: Column) -> Column:
    """The middle of a salary if it is known, else its bounds; NULL without any."""
    t = lambda c: F.nullif(F.trim(c.cast("string")), F.lit(""))
    bounds = F.when(t(low).isNotNull() | t(high).isNotNull(), F.concat(F.coalesce(t(low), F.lit("?")), F.lit(" - "), F.coalesce(t(high), F.lit("?")), F.lit(" / 月")))
    return F.coalesce(F.concat(F.lit("月均约 "), t(middle)), bounds)


def recommended_market(jobs: list[tuple[str, Column]], cities: list[tuple[str, Column]], salaries: list[tuple[str, Column]], market: tuple[str, Column, Column, Column] | None = None) -> Column:
    """struct(recommended_job, recommended_job_location, recommended_job_salary), each a value with its source.

    ``market`` is what the market's own tables say: a name, the job, its cities, its salary. Where it says anything it goes first.
    """
    name, job, places, pay = market or ("", *[F.lit(None).cast(t) for t in ("string", "array<string>", "string")])
    found = first_list([(name, places), *cities], MOST_CITIES)
    where = F.struct(F.when(F.size(found["value"]) > 0, F.array_join(found["value"], "、")).otherwise(NO_PLACE).alias("value"), found["source"].alias("source"))
    return F.struct(cascade([(name, job), *jobs], NO_JOB).alias("recommended_job"), where.alias("recommended_job_location"), cascade([(name, pay), *salaries], NO_SALARY).alias("recommended_job_salary"))
