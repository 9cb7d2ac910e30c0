"""Read-only SQL over one view, question filters and result summaries."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text, vocab

MAX_ROWS = 15
FORBIDDEN = ("insert", "update", "delete", "drop", "alter", "create", "replace", "truncate", "merge", "grant", "revoke", "set", "cache", "refresh", "use", "add", "describe", "explain", "load", "call", "execute", "transform", "map", "reduce")
#: What may stand before a parenthesis: words of the grammar, and functions that read nothing but their arguments.
GRAMMAR = frozenset("and or not in exists any all some between like ilike rlike case when then else end as on using over filter where having by from join with select distinct values union except intersect within group interval limit".split())
FUNCTIONS = frozenset(
    "abs avg bround cast ceil ceiling char_length coalesce collect_list collect_set concat concat_ws contains corr count count_if date_add date_format date_sub date_trunc datediff day "
    "dense_rank endswith exp extract first_value floor greatest if ifnull instr isnotnull isnull lag last_value lead least left len length ln log log10 lower lpad ltrim max max_by mean median "
    "min min_by month nullif nvl percent_rank percentile percentile_approx power quarter rank regexp_extract regexp_like regexp_replace replace reverse right round row_number rpad rtrim sign "
    "split split_part sqrt startswith std stddev string_agg substr substring sum to_date to_timestamp translate trim try_cast try_divide upper variance year".split()
)
_QUOTED = re.compile(r"'[^']*'|\"[^\"]*\"")
_STARTS = re.compile(r"(?:select|with)\b")


class UnsafeQuery(ValueError):
    """A statement that is not one plain SELECT over the permitted views."""


def relations(spark: SparkSession, sql: str) -> tuple[set[str], bool]:
    """Every table that a statement names, by Spark's own parser: comma joins, common tables and subqueries included; and whether
    it reads a function as a table."""
    parsed = spark.sql(f"EXPLAIN EXTENDED {sql}").first()[0].split("== Analyzed Logical Plan ==")[0]
    return {m.lower() for m in re.findall(r"UnresolvedRelation \[([^\]]+)\]", parsed)}, "UnresolvedTableValuedFunction" in parsed


def guarded(spark: SparkSession, sql: str, views: set[str] = frozenset({"jobs"}), most: int = MAX_ROWS) -> DataFrame:
    """The rows of one read-only statement over ``views``, at most ``most``.

    Only functions of a list may be called. A common table may not have the name of a table, view or function that there is,
    so a name that isn't permitted can't hide behind one, at whatever depth; only the heads of common tables themselves are
    no calls. Functions that give tables are refused by the parsed plan.
    """
    plain = sql.strip().rstrip(";").strip()
    code = _QUOTED.sub("''", plain)
    low = code.lower()
    if any(sign in code for sign in (";", "--", "/*", "\\")) or "\\" in plain:
        raise UnsafeQuery("one statement without comments and backslashes is allowed")
    if low.count("`") % 2 or not all(re.fullmatch(r"[\w ]+", name) for name in low.split("`")[1::2]):
        raise UnsafeQuery("names hold letters, digits and spaces")  # a path in backticks would be read as a file
    if not _STARTS.match(low):
        raise UnsafeQuery("only SELECT is allowed")
    if bad := [w for w in FORBIDDEN if re.search(rf"(?<![\w.]){w}\s", low)]:
        raise UnsafeQuery(f"not allowed: {', '.join(bad)}")
    heads = re.compile(r"(\bwith|,)\s*`?(\w+)`?\s*(?:\(\s*`?\w+`?(?:\s*,\s*`?\w+`?)*\s*\)\s*)?as\s*\(")
    ctes = {m[2] for m in heads.finditer(low)}
    if taken := {c for c in ctes if c in {v.lower() for v in views} or spark.catalog.tableExists(c) or spark.catalog.functionExists(c)}:
        raise UnsafeQuery(f"names of tables or functions: {', '.join(sorted(taken))}")
    calls = set(re.findall(r"(\w+)`?\s*\(", heads.sub(r"\1 head as (", low)))
    if bad := calls - GRAMMAR - FUNCTIONS - {"head"}:
        raise UnsafeQuery(f"not allowed: {', '.join(sorted(bad))}")
    try:
        named, functions = relations(spark, plain)
    except AnalysisException as e:
        raise UnsafeQuery(f"not a query: {str(e)[:200]}") from e
    if functions:
        raise UnsafeQuery("functions that give tables aren't allowed")
    if other := named - {v.lower() for v in views} - ctes:
        raise UnsafeQuery(f"unknown tables: {', '.join(sorted(other))}")
    limit = re.search(r"\blimit\s+(\d+)\s*$", low)
    return spark.sql(plain).limit(max(1, min(int(limit[1]) if limit else most, most)))


def real(c: Column) -> Column:
    return F.nullif(F.trim(c.cast("string")), F.lit("")).try_cast("double")


def market_view(detail: DataFrame, profile: DataFrame, key: str = "record_id") -> DataFrame:
    """Details with what the profile adds, numbers as numbers."""
    extra = [c for c in profile.columns if c not in detail.columns]
    joined = detail.join(profile.select(key, *extra), key, "left")
    numeric = [c for c in joined.columns if re.search(r"salary_(month_)?(min|max)$", c)]
    return joined.withColumns({c: real(F.col(c)) for c in numeric})


def rule_filter(company: str | None = None, city: str | None = None, keyword: str | None = None, columns: tuple[str, ...] = ("job_title", "standard_job_name", "industry"), salary_floor: float | None = None) -> Column:
    """Case-insensitive LIKE tests; the floor is held against the best salary bound that is known."""
    out = F.lit(True)
    if company:
        out = out & F.col("company_name").ilike(f"%{company}%")
    if city:
        out = out & F.col("city").ilike(f"%{city}%")
    if keyword:
        hit = F.lit(False)
        for c in columns:
            hit = hit | F.coalesce(F.col(c).ilike(f"%{keyword}%"), F.lit(False))
        out = out & hit
    if salary_floor is not None:
        out = out & (F.coalesce("salary_month_max", "salary_max", F.lit(0.0)) >= salary_floor)
    return out


def exact_then_like(df: DataFrame, column: str, wanted: str, order: list[Column]) -> DataFrame:
    """Rows whose value equals ``wanted``; where there are none, those that contain it, shortest first."""
    marked = df.withColumn("_exact", F.lower(column) == wanted.lower()).filter(F.col(column).ilike(f"%{wanted}%"))
    some = F.max(F.col("_exact").cast("int"))
    flag = marked.agg(some.alias("_any"))
    return marked.join(F.broadcast(flag), (F.coalesce("_any", F.lit(0)) == 0) | F.col("_exact")).orderBy(F.char_length(column), column, *order).drop("_exact", "_any")


def salary_in_question(question: Column) -> Column:
    """The salary floor that a question names: the low end of a range, what follows a word of bounds, else a number with a unit.

    k stands for thousands, w and 万 for ten thousands, and the unit of a range stands behind its high end. NULL without a word
    of salaries or a unit in the question.
    """
    number = r"(\d+(?:\.\d+)?)"
    spans = [
        (rf"{number}\s*[-~到至]\s*\d+(?:\.\d+)?\s*(k|K|w|W|万)?", 2), (rf"(?:不低于|不少于|至少|大于等于|>=|以上|达到|目标|期望|薪资|工资|月薪)\s*{number}\s*(k|K|w|W|万)?", 2), (rf"{number}\s*(k|K|w|W|万)", 2),
    ]
    unit = lambda u: F.when(u == "k", 1000.0).when(u.isin("w", "万"), 10000.0).otherwise(1.0)
    found = [F.nullif(F.regexp_extract(question, p, 1), F.lit("")).try_cast("double") * unit(F.lower(F.regexp_extract(question, p, k))) for p, k in spans]
    return F.when(text.any_of(question, vocab.SALARY_WORDS), F.coalesce(*found))


def city_in_question(question: Column) -> Column:
    """A name that ends like a place, else the first of the known cities that the question has; NULL for none."""
    named = F.nullif(F.regexp_extract(question, vocab.CITY_NAME, 1), F.lit(""))
    return F.coalesce(named, *[F.when(F.contains(question, F.lit(c)), F.lit(c)) for c in vocab.CITIES])


def job_in_question(question: Column) -> Column:
    """The first of the known words of jobs, whatever its case, else a name that ends like a job; NULL for none."""
    low = F.lower(question)
    return F.coalesce(*[F.when(F.contains(low, F.lit(w)), F.lit(w)) for w in vocab.JOB_WORDS], F.nullif(F.regexp_extract(question, vocab.JOB_NAME, 1), F.lit("")))


def slots(question: Column) -> Column:
    """struct(city, job, salary_floor) of a question."""
    t = F.coalesce(F.trim(question), F.lit(""))
    return text.let(t, lambda q: F.struct(city_in_question(q).alias("city"), job_in_question(q).alias("job"), salary_in_question(q).alias("salary_floor")))


def intent(question: Column) -> Column:
    """struct(intent, confidence, query_domain, should_use_sql, should_use_path_graph, should_use_semantic) by the first rule whose
    words the question has; a city counts only beside a word of markets."""
    kind = "struct<intent:string,confidence:double,query_domain:string,should_use_sql:boolean,should_use_path_graph:boolean,should_use_semantic:boolean>"
    row = lambda name, sure, domain, use: F.struct(F.lit(name), F.lit(sure), F.lit(domain), *[F.lit(use == x) for x in ("sql", "path", "semantic")]).cast(kind)

    def judged(q: Column) -> Column:
        low = F.lower(q)
        rules = [F.when(text.any_of(q, words) | (text.any_of(low, words) if use == "path" else F.lit(False)), row(name, sure, domain, use)) for name, sure, domain, use, words in vocab.INTENTS]
        city = F.when(text.any_of(q, vocab.CITY_QUESTION) & text.any_of(q, vocab.MARKET_WORDS), row("city_market_search", 0.84, "sql_market", "sql"))
        return F.coalesce(*rules, city, row("general_advice", 0.55, "local_context", ""))

    return text.let(F.coalesce(F.trim(question), F.lit("")), judged)


#: The columns that an answer from the market shows, and those that a job's word is looked for in.
SHOWN = ("company_name", "city", "standard_job_name", "job_title", "salary_month_min", "salary_month_max", "industry", "company_size", "company_type")


def for_questions(questions: DataFrame, jobs: DataFrame, key: str, most: int = MAX_ROWS) -> DataFrame:
    """key, place and the columns SHOWN: for each question (key, question) the postings that its slots ask for, best paid first.

    A posting must name its company and hold each slot that the question has: its city in its own, its job in a title, its
    floor under the best bound. ``questions`` is a bounded set asked against all postings: it is broadcast, and of each
    question only ``most`` rows leave a task.
    """
    asked = F.broadcast(questions.select(key, slots(F.col("question")).alias("_q")))
    upper = F.coalesce("salary_month_max", "salary_max", F.lit(0.0))
    like = lambda c, word: F.coalesce(F.contains(F.lower(c), F.lower(word)), F.lit(False))
    city = F.col("_q.city").isNull() | like("city", F.col("_q.city"))
    job = F.col("_q.job").isNull() | like("job_title", F.col("_q.job")) | like("job_title_norm", F.col("_q.job")) | like("standard_job_name", F.col("_q.job"))
    floor = F.col("_q.salary_floor").isNull() | (upper >= F.col("_q.salary_floor"))
    found = jobs.filter(F.trim("company_name") != "").join(asked, city & job & floor)
    w = Window.partitionBy(key).orderBy(upper.desc(), F.coalesce("salary_month_min", "salary_min", F.lit(0.0)).desc(), "record_id")
    return found.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most).select(key, "place", *SHOWN)


def summary(df: DataFrame, order: str, company: str = "company_name", city: str = "city", industry: str = "industry", bounds: tuple[str, ...] = ("salary_month_min", "salary_month_max", "salary_min", "salary_max")) -> DataFrame:
    """One row: company_count, job_count, top_city, salary_min and salary_max over all bounds above zero, top_industries (five).

    Ties of counts go to what stands first by ``order``. An industry may be a list, of which five count.
    """
    positive = [F.when(F.col(c).try_cast("double") > 0, F.col(c).try_cast("double")) for c in bounds]
    named = F.nullif(F.trim(company), F.lit(""))
    whole = df.agg(F.count_distinct(named).alias("company_count"), F.count("*").alias("job_count"), F.min(F.array_min(F.array_compact(F.array(*positive)))).alias("salary_min"), F.max(F.array_max(F.array_compact(F.array(*positive)))).alias("salary_max"))
    parts = F.filter(F.transform(F.split(text.clean_text(F.col(industry)), "[,，、/；;]+"), lambda x: text.clean_text(x)), lambda x: x.isNotNull())
    listed = df.select(F.col(order).alias("_o"), F.posexplode(F.slice(F.array_distinct(parts), 1, 5)).alias("_p", "name"))
    counted = listed.groupBy("name").agg(F.count("*").alias("count"), F.min(F.struct("_o", "_p")).alias("_at"))
    five = counted.orderBy(F.desc("count"), "_at").limit(5).agg(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("n"), "_at", "name"))).alias("_l"))
    cities = df.select(F.nullif(F.trim(city), F.lit("")).alias("name"), F.col(order).alias("_o")).filter("name is not null").groupBy("name").agg(F.count("*").alias("n"), F.min("_o").alias("_at"))
    first = cities.orderBy(F.desc("n"), "_at").limit(1).agg(F.first("name").alias("top_city"))
    one = whole.join(F.broadcast(first)).join(F.broadcast(five))  # one row each
    return one.withColumn("top_industries", F.transform("_l", lambda x: F.struct(x["name"].alias("name"), (-x["n"]).alias("count")))).drop("_l")


def cards(df: DataFrame, key: Column, order: list[Column], most: int = 8) -> DataFrame:
    """The first row of each key in the result's order, ``most`` keys."""
    first = df.withColumn("_k", F.lower(key)).withColumn("_n", F.row_number().over(Window.partitionBy("_k").orderBy(*order))).filter("_n = 1")
    return first.orderBy(*order).limit(most).drop("_k", "_n")


def table_score(rows: int, preferred_rank: int | None, semantic_fields: int) -> float:
    """How well a table suits a question: 100 if it has rows, 80 less 8 a place for preferred names, 8 a known field, up to 30 for size."""
    return (100 if rows else 0) + (80 - 8 * preferred_rank if preferred_rank is not None else 0) + 8 * semantic_fields + min(rows / 100, 30)


def best_table(spark: SparkSession, preferred: list[str], fields: set[str], least: float = 120) -> str | None:
    """The table with the best score. Sizes count up to 3,000 rows, beyond which they add nothing."""
    best = (least, None)
    for t in spark.catalog.listTables():
        columns = {c.name for c in spark.catalog.listColumns(t.name)}
        score = table_score(spark.table(t.name).limit(3000).count(), preferred.index(t.name) if t.name in preferred else None, len(columns & fields))
        if score >= best[0]:
            best = (score, t.name)
    return best[1]


def profile_rows(detail: DataFrame, name: str, columns: dict[str, str], order: list[Column], most: int = 80) -> DataFrame:
    """The fields that a job's profile needs, under the names that it uses, of at most ``most`` postings of a standard job."""
    return detail.filter(F.col("standard_job_name") == name).orderBy(*order).limit(most).select(*[F.col(c).alias(a) for a, c in columns.items()])
