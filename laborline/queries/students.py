"""Queries over students' profiles: one row a student, from what customers' keys and orders give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import student
from .tables import load

QUERIES = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


@query("""
WITH o AS (SELECT o_custkey AS c, o_orderkey AS k FROM orders),
p AS (SELECT c, count(*) FILTER (k % 3 = 0) AS pc, count(*) FILTER (k % 3 = 1) AS ic, bool_or(k % 3 = 0 AND k % 2 = 0) AS clean, bool_or(k % 3 = 0 AND k % 2 = 1) AS model, bool_or(k % 3 = 1 AND k % 4 = 0) AS spark FROM o GROUP BY c),
x AS (
  SELECT c_custkey AS c, coalesce(pc, 0) AS pc, coalesce(ic, 0) AS ic, coalesce(clean, false) AS clean, coalesce(model, false) AS model, coalesce(spark, false) AS spark, c_custkey % 4 AS m, c_custkey % 5 AS s, c_custkey % 3 AS a, c_custkey % 6 AS t FROM customer LEFT JOIN p ON p.c = c_custkey),
y AS (SELECT *, ['软件工程', '统计学', '哲学', ''][m + 1] AS major, CASE s WHEN 0 THEN 'Python' WHEN 1 THEN 'Java' WHEN 2 THEN '围棋' ELSE '' END AS hard, CASE s WHEN 0 THEN 'Git|Excel' WHEN 1 THEN 'Excel' WHEN 2 THEN 'Excel' WHEN 3 THEN 'Docker|Excel' ELSE 'Excel' END AS tools FROM x)
SELECT c AS c_custkey, CASE major WHEN '软件工程' THEN '计算机科学与技术' ELSE major END AS major_std, hard, tools, concat_ws('|', CASE WHEN clean THEN '项目:数据处理' END, CASE WHEN model THEN '项目:建模算法' END, CASE WHEN pc > 0 THEN '有项目经历' END, CASE WHEN ic > 0 THEN '有实习经历' END, CASE WHEN a > 0 THEN '有竞赛/获奖经历' END) AS experience,
  concat_ws('|', CASE WHEN spark THEN '数据智能' END, CASE WHEN s IN (0, 1, 3) THEN '软件研发' END, '商业分析', CASE WHEN s = 0 THEN '人工智能' END, CASE WHEN spark OR s = 3 THEN '云计算/大数据' END, CASE m WHEN 0 THEN '信息技术' WHEN 1 THEN '数理分析' END) AS domains,
  CAST(pc AS INTEGER) AS project_count, CAST(ic AS INTEGER) AS internship_count, CAST(CASE a WHEN 0 THEN 0 ELSE a END AS INTEGER) AS award_count, t > 0 AS has_target, CAST(pc + ic + a AS INTEGER) AS total FROM y
""")
def student_profile(spark: SparkSession, d: str) -> DataFrame:
    """Major, skills, experience, domains and practice of all customers, with orders as projects and internships."""
    o, k = F.col("o_orderkey"), F.col("c_custkey")
    listed = lambda cond, value: F.array_compact(F.collect_list(F.when(cond, value)))
    project = F.struct(F.lit(" ").alias("project_name"), F.lit(None).cast("string").alias("role"), F.when(o % 2 == 0, "清洗数据清洗").otherwise("做预测").alias("description"))
    internship = F.struct(F.lit("公司").alias("company_name"), F.lit("nan").alias("position"), F.when(o % 4 == 0, "用spark").otherwise("值班").alias("description"))
    found = load(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(listed(o % 3 == 0, project).alias("projects"), listed(o % 3 == 1, internship).alias("internships"))
    pick = lambda at, *values: F.get(F.array(*[F.lit(v) for v in values]), at.cast("int"))
    rows = load(spark, d, "customer").join(found, "c_custkey", "left").select(
        "c_custkey", "projects", "internships", pick(k % 4, "软件工程", "统计学", "哲学", "").alias("major"), F.split(pick(k % 5, "python3,github", "jdk", "围棋", "容器化", ""), ",").alias("skills"), F.array(F.lit("vlookup"), F.lit("")).alias("tools"),
        F.lit(None).cast("array<string>").alias("certificates"), F.when(k % 3 == 1, F.array(F.lit("奖"), F.lit("奖"))).when(k % 3 == 2, F.array(F.lit("奖"), F.lit("杯"), F.lit("none"))).alias("awards"), F.lit("本科").alias("degree"), F.lit("").alias("school"), F.lit("").alias("school_level"),
        F.when(k % 6 > 0, "围棋手").otherwise(" ").alias("target_job_intention"), F.lit("").alias("self_evaluation"),
    )
    got = student.profile(rows, "c_custkey")
    text_of = lambda c, name: F.array_join(c, "|").alias(name)
    practice = {"project_count": "project_count", "internship_count": "internship_count", "award_count": "award_count", "has_target_job_intention": "has_target", "total_practice_items": "total"}
    return got.select("c_custkey", "major_std", text_of("hard_skills", "hard"), text_of("tool_skills", "tools"), text_of("experience_tags", "experience"), text_of("domain_tags", "domains"), *[F.col(f"practice_profile.{c}").alias(n) for c, n in practice.items()])


@query("""
WITH w AS (SELECT c_custkey, ['工具栈偏弱', '缺少项目', '求职意向不清', '', '证书少'][c_custkey % 5 + 1] AS a, ['补充实习', '完善教育信息', '学习技能', '参加获奖竞赛', '专业对口', ''][c_nationkey % 6 + 1] AS b FROM customer), t AS (SELECT c_custkey, a || ' ' || b AS t FROM w)
SELECT c_custkey, concat_ws('|', CASE WHEN regexp_matches(t, '技能|工具') THEN '核心技能/工具栈' END, CASE WHEN contains(t, '项目') THEN '项目经历' END, CASE WHEN contains(t, '实习') THEN '实习经历' END, CASE WHEN regexp_matches(t, '证书|获奖') THEN '证书/竞赛背书' END,
  CASE WHEN regexp_matches(t, '求职意向|职业方向') THEN '求职方向明确度' END, CASE WHEN regexp_matches(t, '教育|学历|专业') THEN '教育背景完整度' END) AS missing FROM t
""")
def missing_by_reasons(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda at, *values: F.get(F.array(*[F.lit(v) for v in values]), at.cast("int"))
    weak = pick(F.col("c_custkey") % 5, "工具栈偏弱", "缺少项目", "求职意向不清", "", "证书少")
    advice = pick(F.col("c_nationkey") % 6, "补充实习", "完善教育信息", "学习技能", "参加获奖竞赛", "专业对口", "")
    return load(spark, d, "customer").select("c_custkey", F.array_join(student.missing_in_reasons(F.array(weak), F.array(advice)), "|").alias("missing"))


@query("""
WITH x AS (
  SELECT s_suppkey AS k, CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE 'U' || s_suppkey % 5 END AS u, CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE 'T' || s_suppkey % 3 END AS t, CASE WHEN s_suppkey % 11 = 0 THEN '' WHEN s_suppkey % 9 = 0 THEN 'T' || s_suppkey % 3 ELSE 'R' || s_suppkey END AS r,
    CAST(s_suppkey * 7 % 60 AS DOUBLE) AS ts, CAST(s_suppkey * 13 % 90 AS DOUBLE) AS os, s_suppkey % 10 / 10.0 AS ta, s_suppkey % 13 * 8 / 100.0 AS oa, s_suppkey % 6 > 0 AS tf, s_suppkey % 8 > 0 AS rf, s_suppkey % 3 > 0 AS hp, s_suppkey % 5 = 1 AS tok, s_suppkey % 2 = 0 AS rok FROM supplier),
y AS (SELECT *, os - ts AS ds, oa - ta AS da, r = '' OR r = t OR NOT rf AS stays FROM x),
z AS (SELECT *, CASE WHEN stays THEN 'a' WHEN NOT tf THEN 'b' WHEN tok AND NOT (hp AND ds >= 20 AND da >= 0.25) THEN 'c' WHEN hp AND ds >= 10 AND da > 0 THEN 'd' ELSE 'e' END AS rule FROM y),
p AS (SELECT *, CASE WHEN rule IN ('b', 'd') THEN r ELSE coalesce(nullif(u, ''), nullif(t, ''), CASE WHEN rule = 'a' THEN r ELSE '' END) END AS plan FROM z)
SELECT k AS s_suppkey, plan, CASE WHEN rule IN ('b', 'd') THEN 'stretch_goal' ELSE 'original_goal' END AS target_role, CASE WHEN rule = 'a' THEN 'reference_only' WHEN rule IN ('c', 'e') THEN 'secondary_goal' WHEN rok THEN 'primary_goal' ELSE 'primary_goal_candidate' END AS recommended_role,
  CASE WHEN rule = 'a' AND NOT rf THEN 'fallback_user_target' WHEN rule IN ('b', 'd') THEN 'match_asset_score' ELSE 'respect_user_target' END AS source, CASE rule WHEN 'a' THEN CASE WHEN tf THEN 'medium' ELSE 'low' END WHEN 'b' THEN 'medium_high' WHEN 'c' THEN 'high' WHEN 'd' THEN CASE WHEN ds >= 20 OR rok THEN 'medium_high' ELSE 'medium' END ELSE 'medium' END AS confidence,
  concat_ws('|', CASE rule WHEN 'a' THEN CASE WHEN rf THEN '系统推荐岗位与用户目标岗位一致或差异不足，主目标保留用户原始目标岗位。' ELSE '系统推荐岗位缺少有效后处理资产，主目标保留用户原始目标岗位。' END WHEN 'b' THEN '用户目标岗位未命中完整评测资产，系统优先采用资产完整的推荐岗位作为短期主路径。' WHEN 'c' THEN '用户目标岗位已通过赛题综合评测，除非推荐岗位优势特别明显，否则优先尊重用户原目标。'
      WHEN 'd' THEN r || '主展示分' || printf('%.2f', os) || '，高于' || coalesce(nullif(t, ''), u) || printf('%.2f', ts) || '，优势为' || printf('%.2f', ds) || '分。|' || r || '知识点覆盖率' || k % 13 * 8 || '%，高于目标岗位' || k % 10 * 10 || '%。|' || r || CASE WHEN rok THEN '已通过赛题综合评测，更适合作为当前主路径。' ELSE '虽未完全通过赛题综合评测，但更接近达标，适合作为短期主路径候选。' END
      ELSE '系统推荐岗位优势未达到切换阈值，主目标继续保留用户原始目标岗位。' END, CASE WHEN u <> '' AND plan <> '' AND u <> plan THEN '用户原始目标' || u || '不被否定，建议作为中期补强后的冲刺目标或备选目标保留。' END) AS reasons FROM p
""")
def primary_goal(spark: SparkSession, d: str) -> DataFrame:
    """Which job to plan for, with roles, source, confidence and reasons, from all suppliers' keys."""
    from ..operators import path

    k = F.col("s_suppkey")
    word = lambda letter, n: F.concat(F.lit(letter), n.cast("string"))
    user, job = F.when(k % 4 == 0, " ").otherwise(word("U", k % 5)), F.when(k % 7 > 0, word("T", k % 3))
    other = F.when(k % 11 == 0, F.lit(None)).when(k % 9 == 0, word("T", k % 3)).otherwise(word("R", k))
    target = {"score": (k * 7 % 60).cast("double"), "accuracy": k % 10 / 10, "asset_found": k % 6 > 0, "hard_pass": k % 2 == 0, "success": k % 5 == 1}
    best = {"score": (k * 13 % 90).cast("double"), "accuracy": F.when(k % 13 * 8 > 1, (k % 13 * 8).cast("double")).otherwise(0.0), "asset_found": k % 8 > 0, "hard_pass": k % 3 > 0, "success": k % 2 == 0}
    got = load(spark, d, "supplier").select("s_suppkey", path.primary_goal(user, job, other, target, best).alias("g"))
    return got.select("s_suppkey", F.col("g.primary_plan_job").alias("plan"), F.col("g.target_job_role").alias("target_role"), F.col("g.recommended_job_role").alias("recommended_role"), "g.source", "g.confidence", F.array_join("g.reasons", "|").alias("reasons"))


@query("""
WITH o AS (SELECT o_custkey AS c, o_orderpriority AS p, min(o_orderkey) AS k FROM orders GROUP BY 1, 2), l AS (SELECT c, string_agg(p, '|' ORDER BY k) AS skills FROM o GROUP BY c),
x AS (SELECT c_custkey AS c, coalesce(skills, '') AS skills, ['本科', '', '研究生', '高中', '学历不限', '其他'][c_custkey % 6 + 1] AS degree, ['大专', '硕士', '', '博士'][c_custkey % 4 + 1] AS need, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_mktsegment END AS job, c_custkey % 3 AS f FROM customer LEFT JOIN l ON l.c = c_custkey)
SELECT c AS c_custkey, degree, CASE degree WHEN '本科' THEN 3 WHEN '研究生' THEN 4 WHEN '高中' THEN 1 ELSE 0 END AS student_rank, CASE need WHEN '大专' THEN 2 WHEN '硕士' THEN 4 WHEN '博士' THEN 5 ELSE 0 END AS job_rank, skills, CASE f WHEN 0 THEN 'a|b' WHEN 1 THEN 'c' ELSE '' END AS job_skills, CASE f WHEN 0 THEN '统计|数学' ELSE '' END AS majors, CAST(c % 3 AS INTEGER) AS projects, job,
  concat_ws('|', CASE WHEN degree = '' THEN 'student_profile_result 缺少学历字段' END, CASE WHEN f = 2 THEN 'student_profile_result 缺少专业字段' END, CASE WHEN skills = '' AND f <> 1 THEN 'student_profile_result 缺少可用于匹配的技能/工具标签' END, CASE WHEN f > 0 THEN 'student_profile_result 缺少职业方向或领域标签' END,
    CASE WHEN job = '' THEN 'job_profile_result 缺少 standard_job_name' END, CASE WHEN need = '' THEN 'job_profile_result 缺少学历要求字段' END, CASE WHEN f = 2 THEN 'job_profile_result 缺少岗位技能/工具要求' END, CASE WHEN f <> 0 THEN 'job_profile_result 缺少专业要求标签' END) AS warnings FROM x
""")
def comparable_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Eight compared dimensions of all customers and a job each, and what either side lacks."""
    from ..operators import match

    k, f = F.col("c_custkey"), F.col("c_custkey") % 3
    pick = lambda at, *values: F.get(F.array(*[F.lit(v) for v in values]), at.cast("int"))
    skills = load(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))), lambda x: x["o_orderpriority"]).alias("hard_skills"))
    none = F.lit(None).cast("string")
    rows = load(spark, d, "customer").join(skills, "c_custkey", "left").select(
        "c_custkey", "hard_skills", pick(k % 6, "本科", " none", "研究生", "高中", "学历不限", "其他").alias("degree"), F.when(f < 2, "统计").alias("major"), F.when(f == 1, F.array(F.lit("git"), F.lit(""))).alias("tool_skills"), none.alias("soft_skills"), none.alias("certificates"), none.alias("experience_tags"),
        F.when(f == 0, "数据、运维").alias("occupation_hints"), none.alias("domain_tags"), f.alias("project_count"), none.alias("internship_count"), F.when(k % 5 > 0, F.col("c_mktsegment")).alias("standard_job_name"), none.alias("job_category"), pick(k % 4, "大专", "硕士", "", "博士").alias("degree_requirement"),
        F.when(f == 0, "统计；数学;统计").alias("major_requirement"), F.when(f == 0, '["a", "b", "a"]').when(f == 1, " ").alias("job_hard_skills"), F.when(f == 1, "c").alias("job_tool_skills"), *[none.alias(c) for c in ("job_soft_skills", "certificate_requirement", "experience_requirement", "practice_requirement")],
    )
    got = match.comparable_schema(rows, ["c_custkey"])
    both = F.concat("hard_skills.job", "tool_skills.job")
    return got.select(
        "c_custkey", F.col("education.student").alias("degree"), "education.student_rank", "education.job_rank", F.array_join("hard_skills.student", "|").alias("skills"), F.array_join(both, "|").alias("job_skills"), F.array_join("major.job", "|").alias("majors"), F.col("practice_experience.projects").alias("projects"),
        F.col("career_direction.job").alias("job"), F.array_join("warnings", "|").alias("warnings"),
    )
