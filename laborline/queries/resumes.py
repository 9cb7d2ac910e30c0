"""Queries over resumes that are written from the rows of orders and customers: each entry comes back as the row that it was written from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import entries
from .tables import load

QUERIES = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _written(spark: SparkSession, d: str, heading: str, odd: int, line: Column) -> DataFrame:
    """c_custkey, body: of each customer a heading and a line for each of its orders with odd (or even) keys, by key."""
    orders = load(spark, d, "orders").filter(F.col("o_orderkey") % 2 == odd)
    lines = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("line")))).alias("_l"))
    body = F.concat_ws("\n", F.col("c_name"), F.lit(heading), F.array_join(F.transform("_l", lambda x: x["line"]), "\n"))
    return load(spark, d, "customer").join(lines, "c_custkey", "left").select("c_custkey", body.alias("body"))


def _form() -> Column:
    return F.floor(F.col("o_orderkey") / 2) % 4


def _pick(*forms: Column) -> Column:
    return F.coalesce(*[F.when(_form() == k, F.concat(*parts)) for k, parts in enumerate(forms)])


@query("""
WITH o AS (SELECT o_custkey AS c_custkey, o_orderkey AS k, o_orderkey // 2 % 4 AS form, o_orderdate AS t, o_orderpriority AS p, o_orderstatus AS s FROM orders WHERE o_orderkey % 2 = 0),
x AS (SELECT *, sum(CASE WHEN form < 2 THEN 1 ELSE 0 END) OVER (PARTITION BY c_custkey ORDER BY k) AS e FROM o),
y AS (
  SELECT c_custkey, e, max(CASE form WHEN 0 THEN '第' || c_custkey || '有限公司' WHEN 1 THEN s || '部门' END) AS company_name, max(CASE form WHEN 0 THEN 'Java开发工程师' WHEN 1 THEN '数据分析' || k END) AS position,
    max(CASE WHEN form < 2 THEN strftime(t, '%Y.%m') END) AS start_date, max(CASE form WHEN 0 THEN strftime(t + INTERVAL 3 MONTH, '%Y.%m') WHEN 1 THEN '至今' END) AS end_date,
    coalesce(string_agg(CASE form WHEN 0 THEN '负责' || k || '号; ' || p WHEN 2 THEN '完成' || k || '号任务,获' || p || '。' WHEN 3 THEN k || '号订单; ' || s END, ' ' ORDER BY k), '') AS description
  FROM x WHERE e > 0 GROUP BY c_custkey, e),
z AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY c_custkey, company_name, position, start_date, end_date ORDER BY e) = 1)
SELECT c_custkey, row_number() OVER (PARTITION BY c_custkey ORDER BY e) AS entry, company_name, position, start_date, end_date, description FROM z
""")
def resume_internships(spark: SparkSession, d: str) -> DataFrame:
    """Dated lines with a company's ending and without one, and undated lines of their descriptions; all customers."""
    key, t = F.col("o_orderkey").cast("string"), F.col("o_orderdate")
    line = _pick(
        [F.date_format(t, "yyyy.MM"), F.lit(" - "), F.date_format(F.add_months(t, 3), "yyyy.MM"), F.lit(" 第"), F.col("o_custkey").cast("string"), F.lit("有限公司 Java开发工程师：负责"), key, F.lit("号；"), F.col("o_orderpriority")],
        [F.date_format(t, "yyyy-MM"), F.lit("~至今 "), F.col("o_orderstatus"), F.lit("部门  数据分析"), key],
        [F.lit("完成"), key, F.lit("号任务，获"), F.col("o_orderpriority"), F.lit("。")],
        [key, F.lit("号订单；"), F.col("o_orderstatus")],
    )
    sections = entries.section_lines(_written(spark, d, "实习经历", 0, line), "c_custkey", "body")
    return entries.internships(sections, "c_custkey")


@query(r"""
WITH o AS (SELECT o_custkey AS c_custkey, o_orderkey AS k, o_orderkey // 2 % 4 AS form, o_orderdate AS t, o_orderpriority AS p FROM orders WHERE o_orderkey % 2 = 1),
b AS (SELECT *, coalesce(bool_or(form < 2) OVER (PARTITION BY c_custkey ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS earlier FROM o),
c AS (SELECT *, form = 0 OR (form = 1 AND (NOT earlier OR regexp_matches(CAST(k AS VARCHAR), '20\d{2}'))) AS opens FROM b),
x AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY c_custkey ORDER BY k) AS entry FROM c)
SELECT c_custkey, CAST(entry AS BIGINT) AS entry, max(CASE WHEN opens THEN CASE form WHEN 0 THEN '订单' || k || '分析平台' ELSE k || '号系统' END END) AS project_name, coalesce(min_by('后端' || k, k) FILTER (form = 2), '') AS role,
  max(CASE WHEN opens THEN CASE form WHEN 0 THEN strftime(t, '%Y/%m') ELSE '' END END) AS start_date, max(CASE WHEN opens THEN CASE form WHEN 0 THEN strftime(t + INTERVAL 5 MONTH, '%Y/%m') ELSE '' END END) AS end_date,
  coalesce(string_agg(CASE form WHEN 0 THEN '项目描述:处理' || p WHEN 1 THEN CASE WHEN NOT opens THEN k || '号系统' END WHEN 2 THEN '担任:后端' || k || ',负责' || p ELSE '使用' || p || ',框架' || k END, ' ' ORDER BY k), '') AS description
FROM x WHERE entry > 0 GROUP BY c_custkey, entry
""")
def resume_projects(spark: SparkSession, d: str) -> DataFrame:
    """Projects with dates, undated ones that a title opens, roles, titles that open nothing; all customers."""
    key, t, p = F.col("o_orderkey").cast("string"), F.col("o_orderdate"), F.col("o_orderpriority")
    line = _pick(
        [F.date_format(t, "yyyy/MM"), F.lit("-"), F.date_format(F.add_months(t, 5), "yyyy/MM"), F.lit(" 订单"), key, F.lit("分析平台 项目描述：处理"), p],
        [key, F.lit("号系统")], [F.lit("担任：后端"), key, F.lit("，负责"), p], [F.lit("使用"), p, F.lit("，框架"), key],
    )
    sections = entries.section_lines(_written(spark, d, "项目经验", 1, line), "c_custkey", "body")
    return entries.projects(sections, "c_custkey")


@query(r"""
WITH c AS (SELECT c_custkey, c_custkey % 4 AS v, CAST(c_custkey AS VARCHAR) AS k FROM customer),
e AS (
  SELECT c_custkey, 1 AS entry, '第' || k || '大学' AS school, '' AS more, '软件工程' AS major, '本科' AS degree, '2018.09' AS start_date, '2022.06' AS end_date, '绩点' || k AS description, k FROM c WHERE v = 0
  UNION ALL SELECT c_custkey, 1, '第' || k || '学院', '211', '计算机', '硕士', '2019/9', '至今', '获得奖学金' || k, k FROM c WHERE v = 1
  UNION ALL SELECT c_custkey, 1, '第' || k || '学校', '', '', '大专', '2015.09', '2019.06', '优秀', k FROM c WHERE v = 3
  UNION ALL SELECT c_custkey, 2, '本科 第' || k || '大学', '', '统计', '本科', '2019.09', '2019.6.30', '', k FROM c WHERE v = 3)
SELECT c_custkey, CAST(entry AS BIGINT) AS entry, school, concat_ws(' / ', CASE WHEN k = '985' THEN '985' END, CASE WHEN more = '211' OR k = '211' THEN '211' END) AS school_level, major, degree, start_date, end_date, description FROM e
""")
def resume_schools(spark: SparkSession, d: str) -> DataFrame:
    """Schools with dates in their line and after it, degrees and majors in lines of their own, a section that names no school; all customers."""
    k, v = F.col("c_custkey").cast("string"), F.col("c_custkey") % 4
    forms = [
        ["2018.09-2022.06 第#大学 软件工程 本科", "绩点#"], ["第#学院（211）", "2019/9~至今", "硕士", "计算机", "获得奖学金#"],
        ["主修课程#", "2016.09-2020.06 班长"], ["2015.09-2019.06 第#学校 大专学位 优秀", "2019.09-6.30 本科 第#大学 统计在读"],
    ]
    lines = F.coalesce(*[F.when(v == n, F.lit("\n".join(form))) for n, form in enumerate(forms)])
    body = F.concat(F.col("c_name"), F.lit("\n教育背景\n"), F.replace(lines, F.lit("#"), k), F.lit("\n自我评价\n毕业于某大学"))
    sections = entries.section_lines(load(spark, d, "customer").select("c_custkey", body.alias("body")), "c_custkey", "body")
    return entries.schools(sections, "c_custkey")
