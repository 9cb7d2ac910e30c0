"""Queries over results of uncertain shape: coerced to a schema, merged by policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.coerce import coerced
from ..operators import merge
from .tables import load

QUERIES = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


_SHAPE = {"name": "unnamed", "score": 0.5, "count": 3, "ok": True, "tags": [], "info": {"level": 1, "more": {"note": "-"}}, "rows": [{"k": "?", "v": 0}]}


@query("""
WITH x AS (SELECT event_id, event_id % 6 AS f, user_id AS u FROM events)
SELECT event_id, CASE f WHEN 0 THEN 'u' || u WHEN 1 THEN 'True' WHEN 2 THEN '' || event_id ELSE 'unnamed' END AS name, CASE f WHEN 0 THEN u / 4.0 WHEN 4 THEN CAST(u AS DOUBLE) ELSE 0.5 END AS score, CASE f WHEN 0 THEN u WHEN 1 THEN 1 WHEN 2 THEN event_id ELSE 3 END AS count,
  CASE f WHEN 1 THEN false WHEN 4 THEN u % 2 = 0 ELSE true END AS ok, CASE f WHEN 0 THEN 'a' || u || '|b|c d' WHEN 1 THEN 't|' || u || '|false' WHEN 2 THEN '' || u WHEN 4 THEN 'p, q|' || u ELSE '' END AS tags,
  CASE f WHEN 0 THEN u % 7 ELSE 1 END AS level, CASE f WHEN 0 THEN '' || u WHEN 2 THEN '-' ELSE '-' END AS note, CASE f WHEN 0 THEN 'x=' || u || '|?=2|?=0' WHEN 1 THEN 'one=2' ELSE '' END AS rows FROM x
""")
def schema_coercion(spark: SparkSession, d: str) -> DataFrame:
    """JSON with every kind of mismatch, from events: casts, defaults, scalars for lists and lists in texts, nested structs, no JSON at all."""
    u, k = F.col("user_id").cast("string"), F.col("event_id").cast("string")
    forms = [
        F.concat(F.lit('{"name":" u'), u, F.lit(' ","score":"'), (F.col("user_id") / 4).cast("string"), F.lit('","count":" '), u, F.lit('","ok":" YES","tags":"a'), u, F.lit('、b；; c d |","info":{"level":"'), (F.col("user_id") % 7).cast("string"), F.lit('","more":{"note":'), u, F.lit('}},"rows":[{"k":"x","v":'), u, F.lit('},{"v":"2"},7]}')),
        F.concat(F.lit('{"name":true,"score":null,"count":true,"ok":0,"tags":["t",'), u, F.lit(',null,false],"info":4,"rows":{"k":" one","v":2.7}}')),
        F.concat(F.lit('{"name":'), k, F.lit(',"score":[1],"count":'), k, F.lit('.9,"ok":[0],"tags":'), u, F.lit(',"info":{"level":"x","more":[]},"rows":"none"}')),
        F.concat(F.lit("no JSON: "), k),
        F.concat(F.lit('{"name":null,"tags":"[\\"p, q\\", '), u, F.lit(']","ok":"'), F.when(F.col("user_id") % 2 == 0, "y").otherwise("no"), F.lit('","score":'), u, F.lit(',"count":"1.5"}')),
    ]
    body = F.coalesce(*[F.when(F.col("event_id") % 6 == n, form) for n, form in enumerate(forms)])
    got = load(spark, d, "events").select("event_id", coerced(body, _SHAPE).alias("r"))
    rows = F.array_join(F.transform("r.rows", lambda x: F.concat(x["k"], F.lit("="), x["v"].cast("string"))), "|")
    tags = F.regexp_replace(F.array_join("r.tags", "|"), "False", "false")
    return got.select("event_id", "r.name", "r.score", "r.count", "r.ok", tags.alias("tags"), F.col("r.info.level").alias("level"), F.col("r.info.more.note").alias("note"), rows.alias("rows"))


def _listed(cond: Column, value: Column) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct(F.col("o_orderkey").alias("k"), value.alias("v"))))), lambda x: x["v"])


@query("""
WITH o AS (SELECT o_custkey AS c, o_orderkey AS k, o_orderkey % 5 AS f, 'C' || o_orderkey % 4 AS company, o_orderpriority AS position FROM orders),
r AS (SELECT *, CASE WHEN k % 2 = 0 THEN 'r' || k ELSE '' END AS said, row_number() OVER (PARTITION BY c, company, position ORDER BY k) AS n FROM o WHERE f <= 2),
j AS (SELECT *, CASE WHEN k % 3 = 0 THEN 'j' || k ELSE '' END AS said, row_number() OVER (PARTITION BY c, company, position ORDER BY k) AS n FROM o WHERE f IN (1, 2, 3)),
m AS (
  SELECT r.c, 1 AS side, r.k, r.company, r.position, coalesce(nullif(j.said, ''), r.said) AS said FROM r LEFT JOIN j ON j.c = r.c AND j.company = r.company AND j.position = r.position AND j.n = 1 WHERE r.n = 1
  UNION ALL SELECT j.c, 2, j.k, j.company, j.position, j.said FROM j WHERE j.n = 1 AND NOT EXISTS (SELECT 1 FROM r WHERE r.c = j.c AND r.company = j.company AND r.position = j.position)),
rows AS (SELECT c, string_agg(company || '/' || position || '/' || said, '|' ORDER BY side, k) AS internships FROM m GROUP BY c),
s AS (SELECT c, position, min(CASE WHEN f <= 2 THEN 1 ELSE 2 END * 1000000000000 + k) AS at_ FROM o WHERE f <> 4 GROUP BY c, position),
skills AS (SELECT c, string_agg(position, '|' ORDER BY at_) AS skills FROM s GROUP BY c)
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE 'J' || c_custkey END AS name, CASE WHEN c_custkey % 2 = 0 THEN '1' || c_custkey ELSE '2' || c_custkey END AS phone, CASE WHEN c_custkey % 4 = 0 THEN 'goal' ELSE c_mktsegment END AS target, coalesce(internships, '') AS internships, coalesce(skills, '') AS skills
FROM customer LEFT JOIN rows ON rows.c = c_custkey LEFT JOIN skills ON skills.c = c_custkey
""")
def resume_merge(spark: SparkSession, d: str) -> DataFrame:
    """Resumes read twice: texts by their sides, lists united, entries matched by company, position and dates; all customers."""
    k, f = F.col("o_orderkey"), F.col("o_orderkey") % 5
    base = [F.concat(F.lit("C"), (k % 4).cast("string")).alias("company_name"), F.col("o_orderpriority").alias("position"), F.lit("").alias("start_date"), F.lit(None).cast("string").alias("end_date")]
    row = lambda letter, n: F.struct(*base, F.when(k % n == 0, F.concat(F.lit(letter), k.cast("string"))).otherwise(" ").alias("description"))
    lists = load(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        _listed(f <= 2, row("r", 2)).alias("ri"), _listed(f.isin(1, 2, 3), row("j", 3)).alias("ji"), _listed(f <= 2, F.col("o_orderpriority")).alias("rs"), _listed(f.isin(1, 2, 3), F.concat(F.lit(" "), F.col("o_orderpriority"))).alias("js"),
    )
    c, key = load(spark, d, "customer").join(lists, "c_custkey", "left"), F.col("c_custkey")
    number = lambda digit: F.concat(F.lit(digit), key.cast("string"))
    policy = {"basic_info": {"name": "judged", "phone": "ruled"}, "internship_experience": merge.RESUME["internship_experience"], "skills": merge.RESUME["skills"], "target_job_intention": merge.RESUME["target_job_intention"]}
    rules = F.struct(F.struct(F.col("c_name").alias("name"), F.when(key % 2 == 0, number("1")).otherwise("").alias("phone")).alias("basic_info"), F.col("ri").alias("internship_experience"), F.col("rs").alias("skills"), F.when(key % 4 == 0, "goal").alias("target_job_intention"))
    judge = F.struct(F.struct(F.when(key % 3 != 0, number("J")).otherwise(" ").alias("name"), number("2").alias("phone")).alias("basic_info"), F.col("ji").alias("internship_experience"), F.col("js").alias("skills"), F.col("c_mktsegment").alias("target_job_intention"))
    got = c.select("c_custkey", merge.merged(rules, judge, policy).alias("m"))
    entries = F.array_join(F.transform("m.internship_experience", lambda x: F.concat_ws("/", x["company_name"], x["position"], x["description"])), "|")
    return got.select("c_custkey", "m.basic_info.*", F.col("m.target_job_intention").alias("target"), entries.alias("internships"), F.array_join("m.skills", "|").alias("skills"))


@query("""
WITH x AS (SELECT c_custkey, c_custkey % 97 AS rule, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 151 - 20 END AS judge, c_custkey % 4 AS a, c_nationkey % 3 AS b FROM customer),
s AS (SELECT *, CAST(greatest(0, least(100, coalesce(judge, rule))) AS DOUBLE) AS score FROM x)
SELECT c_custkey, score, CASE WHEN score >= 90 THEN 'A-高度匹配' WHEN score >= 80 THEN 'B-较高匹配' WHEN score >= 70 THEN 'C-中等匹配' WHEN score >= 60 THEN 'D-勉强匹配' ELSE 'E-匹配度较低' END AS level, CAST(rule AS DOUBLE) AS skill_score,
  CASE WHEN a = 0 THEN 'rule ' || c_custkey ELSE 'judge' END AS summary, concat_ws('|', CASE WHEN b > 0 THEN 'j' || b END, 'r' || a, CASE WHEN a <> 1 THEN 'r1' END) AS strengths, concat_ws('|', 'w' || a, CASE WHEN a <> b THEN 'w' || b END) AS warnings FROM s
""")
def match_merge(spark: SparkSession, d: str) -> DataFrame:
    """Scores of rules with a judge's supplement: scores kept or clamped, texts the judge's, lists united, the level by bounds."""
    key, a, b = F.col("c_custkey"), F.col("c_custkey") % 4, F.col("c_nationkey") % 3
    word = lambda letter, n: F.concat(F.lit(letter), n.cast("string"))
    policy = {k: merge.MATCH[k] for k in ("overall_match_score", "vocational_skill_score", "analysis_summary", "strengths", "build_warnings")}
    rules = F.struct((key % 97).alias("overall_match_score"), (key % 97).cast("double").alias("vocational_skill_score"), F.concat(F.lit("rule "), key.cast("string")).alias("analysis_summary"), F.array(word("r", a), F.lit("r1")).alias("strengths"), F.array(word("w", a), F.lit("none")).alias("build_warnings"))
    judge = F.struct(F.when(key % 3 != 0, key % 151 - 20).alias("overall_match_score"), F.lit(1.0).alias("vocational_skill_score"), F.when(a != 0, " judge ").alias("analysis_summary"), F.when(b > 0, F.array(word(" j", b), F.lit(""))).alias("strengths"), F.array(word("w", b)).alias("build_warnings"))
    got = load(spark, d, "customer").select("c_custkey", merge.merged(rules, judge, policy).alias("m"))
    score = F.col("m.overall_match_score")
    return got.select("c_custkey", score.alias("score"), merge.match_level(score).alias("level"), F.col("m.vocational_skill_score").alias("skill_score"), F.col("m.analysis_summary").alias("summary"), F.array_join("m.strengths", "|").alias("strengths"), F.array_join("m.build_warnings", "|").alias("warnings"))
