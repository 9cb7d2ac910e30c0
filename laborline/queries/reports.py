"""The report of every customer, from orders as evidence; its SQL fills the same lines of text by expressions of its own."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import report_texts as texts
from ..operators import report, stats
from .tables import load

QUERIES = {}
SQL: dict[str, str] = {}

#: What SQL writes for the fields that the query's rows have; each is NULL where the field says nothing.
_FIELDS = {
    "student.name": "c_name", "student.school": "CASE WHEN c % 3 > 0 THEN '学校' || c % 3 END", "list:student.hard_skills": "skills", "number:student.profile_completeness_score": "printf('%.2f', c_acctbal)",
    "internships:student.internship_experience": "interns", "job.requested_job_name or job.standard_job_name": "c_mktsegment", "job.resolved_job_name": "CASE WHEN c % 2 = 0 THEN 'J' || c_mktsegment END",
    "shares:job.degree_distribution": "shares", "named:job.city_distribution": "named", "match.target_job_name": "c_mktsegment", "number:match.overall_match_score": "printf('%.2f', CAST(c % 100 AS DOUBLE))",
    "list:match.strengths": "CASE WHEN c % 4 > 0 THEN array_to_string(list_transform(range(c % 4), lambda i: 's' || i), '、') END", "target.degree.message": "CASE WHEN c % 2 = 1 THEN '学历' || c END", "target.degree.message or target.degree.reason": "CASE WHEN c % 2 = 1 THEN '学历' || c ELSE '理由' END",
    "bool:target.degree.pass": "CASE c % 3 WHEN 0 THEN '通过' WHEN 1 THEN '未通过' END", "list:target.missing_knowledge_points": "skills", "list8:target.missing_knowledge_points": "skills", "percent:target.knowledge_point_accuracy": "CASE WHEN c % 5 > 0 THEN c % 5 * 20 || '%' END",
    "plan.primary_plan_job or plan.primary_target_job": "c_mktsegment", "plan.primary_plan_job or plan.primary_target_job or match.target_job_name": "c_mktsegment", "plan.user_target_job": "goal", "plan.user_target_job or plan.primary_target_job": "goal",
    "plan.path_status": "status", "list:plan.direct_path": "CASE WHEN c % 2 = 0 THEN 'A→B' END", "actions:target.abilities": "actions", "gaps:target.abilities": "gaps",
}


def _line(template: str) -> str:
    parts = []
    for k, part in enumerate(re.split(r"\{([^{}]*)\}", template)):
        said, _, otherwise = part.partition("|")
        empty = "0.00" if said.startswith("number:") else otherwise or (texts.NONE if ":" in said else "")
        parts.append("'" + part + "'" if k % 2 == 0 else f"coalesce({_FIELDS[said]}, '{empty}')" if said in _FIELDS else f"'{empty}'")
    return "(" + " || ".join(parts) + ")"


def _lines(templates: list[str]) -> str:
    return ", ".join(map(_line, templates))


def _numbered(items: str, otherwise: str) -> str:
    return f"CASE WHEN len({items}) = 0 THEN ['{otherwise}'] ELSE list_transform({items}, lambda x, i: i || '. ' || x) END"


_SHORT = f"CASE WHEN status = 'missing' THEN list_concat(short, [{_lines(texts.SHORT_WITHOUT_PATHS)}], CASE WHEN c % 2 = 0 THEN ['{texts.ABILITY_ACTIONS['沟通能力']}', '围绕岗位高频技能继续补强：k。'] ELSE ['{texts.ABILITY_ACTIONS['沟通能力']}'] END) ELSE short END"
_MID = f"CASE WHEN status = 'missing' THEN list_filter(list_concat(CASE WHEN c % 2 = 1 THEN ['练习'] ELSE [] END, [{_line(texts.MID_WITHOUT_PATHS[0])}, CASE WHEN goal <> c_mktsegment THEN {_line(texts.MID_WITHOUT_PATHS[1])} END, {_line(texts.MID_WITHOUT_PATHS[2])}]), lambda x: x IS NOT NULL) WHEN c % 2 = 1 THEN ['沿晋升路径走', '练习'] ELSE [] END"
_JOB = [*texts.JOB[:1], *texts.JOB[2:12], *texts.JOB[13:]]
_STATUS = f"{_line(texts.JOB[1].replace('{job.asset_status}', ''))} || CASE WHEN c % 2 = 0 THEN '{texts.ASSET_FOUND[0]}J' || c_mktsegment || '{texts.ASSET_FOUND[1]}' ELSE '{texts.ASSET_MISSING}' END"
_PAY = "'薪资概况：' || CASE WHEN c % 3 = 0 THEN '月薪下界均值' || c % 7 || '，上界均值None，中位参考None' ELSE '暂无明确薪资统计' END || '。'"

SQL["report_sections"] = f"""
WITH o AS (SELECT o_custkey AS c, o_orderkey AS k, o_orderpriority AS p, o_orderstatus AS s FROM orders),
sk AS (SELECT c, string_agg(p, '、' ORDER BY at_) AS skills FROM (SELECT c, p, min(k) AS at_ FROM o GROUP BY c, p) GROUP BY c),
i AS (SELECT c, string_agg(CASE WHEN k % 2 = 0 THEN 'C' || k ELSE '未注明公司' END || CASE WHEN k % 3 = 0 THEN '-' || p ELSE '' END || '：' || s || k, '；' ORDER BY k) AS interns FROM (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY c ORDER BY k) <= 5) GROUP BY c),
d AS (SELECT c, p, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY c) AS ratio, row_number() OVER (PARTITION BY c ORDER BY count(*) DESC, p) AS rank FROM o GROUP BY c, p),
ds AS (SELECT c, string_agg(p || '（' || CAST(round_even(round(ratio, 4) * 100, 0) AS BIGINT) || '%，样本' || n || '）', '、' ORDER BY rank) AS shares, string_agg(p || '（占比' || CAST(round(ratio, 4) AS DOUBLE) || '，样本' || n || '）', '、' ORDER BY rank) AS named FROM d WHERE rank <= 5 GROUP BY c),
x AS (
  SELECT c_custkey AS c, c_name, c_mktsegment, c_acctbal, skills, interns, shares, named, CASE WHEN c_custkey % 4 = 0 THEN 'G' || c_custkey WHEN c_custkey % 4 = 1 THEN c_mktsegment END AS goal, CASE WHEN c_custkey % 3 = 0 THEN 'missing' WHEN c_custkey % 3 = 1 THEN 'available' END AS status,
    CASE WHEN c_custkey % 5 = 0 THEN [] ELSE ['第一步', '第' || c_custkey || '步'] END AS short, '{texts.ABILITY_ACTIONS['沟通能力']}' || CASE WHEN c_custkey % 2 = 0 THEN '、围绕岗位高频技能继续补强：k。' ELSE '' END AS actions,
    '沟通能力：学生' || c_custkey % 50 || '分，岗位要求60分，差距' || c_custkey % 50 - 60 || '分，风险=risk，暂无说明；专业技能：学生' || c_custkey % 50 || '分，岗位要求40分，差距' || c_custkey % 50 - 40 || '分，风险=' || CASE WHEN c_custkey % 2 = 0 THEN 'no_match' ELSE 'match' END || '，说明' AS gaps
  FROM customer LEFT JOIN sk ON sk.c = c_custkey LEFT JOIN i ON i.c = c_custkey LEFT JOIN ds ON ds.c = c_custkey),
t AS (
  SELECT c, [
    array_to_string([{_lines(texts.STUDENT)}], chr(10)), array_to_string([{_line(_JOB[0])}, {_STATUS}, {_lines(_JOB[1:11])}, {_PAY}, {_lines(_JOB[11:])}], chr(10)),
    array_to_string(list_concat([{_lines(texts.MATCH)}], CASE WHEN c % 2 = 0 THEN [] ELSE ['{texts.NO_ASSETS}'] END, CASE WHEN c % 3 = 2 THEN ['分数解释：E' || c] ELSE [] END), chr(10)),
    array_to_string(list_concat([{_lines(texts.GOAL)}], CASE WHEN status = 'missing' THEN [{_lines(texts.NO_PATHS)}] ELSE [{_lines(texts.PATHS)}] END), chr(10)),
    array_to_string(list_concat(['{texts.SHORT}'], {_numbered(f"({_SHORT})", texts.NO_SHORT)}, ['{texts.MID}'], {_numbered(f"({_MID})", texts.NO_MID)}), chr(10)),
    array_to_string([{_lines(texts.RISK)}], chr(10)),
    array_to_string([{_line("综合结论：")} || CASE WHEN coalesce(status, '') <> 'missing' THEN {_line(texts.CONCLUDED)} WHEN goal <> c_mktsegment THEN {_line(texts.CONCLUDED_OTHER)} ELSE {_line(texts.CONCLUDED_SAME)} END, {_lines(texts.SUMMARY)}, '核心建议：' || CASE WHEN goal <> c_mktsegment THEN {_line(texts.ADVICE_OTHER)} ELSE {_line(texts.ADVICE)} END, {_line(texts.ADDRESSED)}], chr(10))] AS bodies FROM x)
SELECT c AS c_custkey, CAST(i AS INTEGER) AS place, {texts.TITLES!r}[i] AS title, md5(bodies[i]) AS digest, length(bodies[i]) AS letters FROM t, (SELECT unnest(range(1, 8)) AS i)
"""


def report_sections(spark: SparkSession, d: str) -> DataFrame:
    """Seven sections a customer: lists, numbers, shares, entries and plans filled in or said to be missing; digests of the texts."""
    orders, k = load(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey"), F.col("c_custkey")
    key, text_of = F.col("o_orderkey"), lambda c: c.cast("string")
    entry = F.struct(key.alias("k"), F.col("o_orderpriority").alias("skill"), F.when(key % 2 == 0, F.concat(F.lit("C"), text_of(key))).alias("company_name"), F.when(key % 3 == 0, F.col("o_orderpriority")).otherwise("").alias("position"), F.concat("o_orderstatus", text_of(key)).alias("description"))
    evidence = orders.groupBy("c_custkey").agg(F.array_sort(F.collect_list(entry)).alias("_e"))
    shares = stats.nested(stats.distribution(orders, ["c_custkey"], F.col("o_orderpriority")), ["c_custkey"], "shares")
    rows = load(spark, d, "customer").join(evidence, "c_custkey", "left").join(shares, "c_custkey", "left")
    skills, word = F.transform("_e", lambda x: x["skill"]), lambda s: F.concat(F.lit(s), text_of(k))
    missing, own = k % 3 == 0, (k % 50).cast("double")
    ability = lambda label, need, risk, said: F.struct(F.lit(label).alias("label"), own.alias("student_score"), F.lit(need).alias("job_score"), (own - need).alias("gap"), risk.alias("risk_level"), F.lit(said).alias("message"), F.array(F.lit("k")).alias("keywords"))
    payload = rows.select(
        "c_custkey",
        F.struct(F.col("c_name").alias("name"), F.when(k % 3 > 0, F.concat(F.lit("学校"), text_of(k % 3))).otherwise("nan").alias("school"), skills.alias("hard_skills"), F.col("c_acctbal").alias("profile_completeness_score"), F.col("_e").alias("internship_experience")).alias("student"),
        F.struct(F.col("c_mktsegment").alias("standard_job_name"), (k % 2 == 0).alias("asset_found"), F.when(k % 2 == 0, F.concat(F.lit("J"), "c_mktsegment")).alias("resolved_job_name"), F.col("shares").alias("degree_distribution"), F.col("shares").alias("city_distribution"), F.when(k % 3 == 0, k % 7).alias("salary_min")).alias("job"),
        F.struct(F.col("c_mktsegment").alias("target_job_name"), (k % 100).alias("overall_match_score"), F.transform(F.filter(F.sequence(F.lit(0), F.lit(3)), lambda i: i < k % 4), lambda i: F.concat(F.lit("s"), text_of(i))).alias("strengths")).alias("match"),
        F.struct(
            F.struct(F.when(k % 2 == 1, word("学历")).alias("message"), F.lit("理由").alias("reason"), F.when(k % 3 < 2, k % 3 == 0).alias("pass")).alias("degree"), skills.alias("missing_knowledge_points"), F.when(k % 5 > 0, k % 5 / 5).alias("knowledge_point_accuracy"), (k % 2 == 0).alias("asset_found"),
            F.when(k % 3 == 2, word("E")).alias("score_explanation"), F.array(ability("沟通能力", 60.0, F.lit("risk"), ""), ability("专业技能", 40.0, F.when(k % 2 == 0, "no_match").otherwise("match"), "说明")).alias("abilities"),
        ).alias("target"),
        F.struct(
            F.col("c_mktsegment").alias("primary_plan_job"), F.when(k % 4 == 0, word("G")).when(k % 4 == 1, F.col("c_mktsegment")).alias("user_target_job"), F.when(missing, "missing").when(k % 3 == 1, "available").alias("path_status"), F.when(k % 2 == 0, F.array(F.lit("A→B"))).alias("direct_path"),
            F.when(k % 5 > 0, F.array(F.lit("第一步"), F.concat(F.lit("第"), text_of(k), F.lit("步")))).alias("short_term_plan"), F.when(k % 2 == 1, F.array(F.lit("沿晋升路径走"), F.lit("练习"))).alias("mid_term_plan"),
        ).alias("plan"),
    )
    got = report.sections(payload, ["c_custkey"])
    return got.select("c_custkey", "place", "title", F.md5("content").alias("digest"), F.char_length("content").alias("letters"))


QUERIES["report_sections"] = report_sections
