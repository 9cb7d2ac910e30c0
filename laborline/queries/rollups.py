"""Queries of rollups and cascades: nodes and documents of jobs, facts with their sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import facts, rollups
from .tables import load

QUERIES = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


_POSTINGS = """
p AS (
  SELECT o_orderkey AS k, CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE 'J' || o_custkey % 97 END AS standard, 'T' || o_custkey % 5 AS title, CASE o_orderkey % 4 WHEN 0 THEN o_orderpriority WHEN 1 THEN 'nan' END AS category, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE o_orderstatus END AS family,
    o_orderstatus AS level, CASE WHEN o_custkey % 97 > 5 AND o_orderkey % 2 = 0 THEN o_orderpriority END AS degree, CASE WHEN o_orderkey % 50 = 1 THEN 'S' || o_orderkey END AS summary, o_orderstatus || o_orderkey AS described, o_orderkey % 3 > 0 AS success FROM orders)
"""


def _postings(spark: SparkSession, d: str) -> DataFrame:
    k, c, p, s = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderpriority"), F.col("o_orderstatus")
    word = lambda letter, n: F.concat(F.lit(letter), n.cast("string"))
    return load(spark, d, "orders").select(
        k.alias("k"), F.when(c % 11 == 0, " none ").otherwise(word("J", c % 97)).alias("standard_job_name"), word("T", c % 5).alias("job_title"), F.when(k % 4 == 0, p).when(k % 4 == 1, "nan").alias("job_category"), F.when(k % 3 == 0, p).otherwise(s).alias("job_family"), s.alias("job_level"),
        F.when((c % 97 > 5) & (k % 2 == 0), p).alias("degree_requirement"), F.when(k % 50 == 1, word("S", k)).alias("raw_requirement_summary"), F.concat(s, k.cast("string")).alias("job_description"), (k % 3 > 0).alias("extract_success"),
        F.concat(p, F.lit("、"), s, F.lit("、"), p).alias("hard_skills"), F.array(p, word("T", k % 7)).alias("vertical_paths"),
    )


@query(f"""
WITH {_POSTINGS},
n AS (SELECT *, coalesce(standard, title) AS name FROM p),
v AS (SELECT name, 'category' AS field, category AS value, k, 0 AS col FROM n WHERE category <> 'nan' UNION ALL SELECT name, 'category', family, k, 1 FROM n UNION ALL SELECT name, 'level', level, k, 0 FROM n UNION ALL SELECT name, 'degree', degree, k, 0 FROM n WHERE degree IS NOT NULL),
g AS (SELECT name, field, value, count(*) AS m, min(col * 1000000000000 + k) AS at_ FROM v GROUP BY name, field, value),
b AS (SELECT name, field, value FROM g QUALIFY row_number() OVER (PARTITION BY name, field ORDER BY m DESC, at_) = 1)
SELECT 'job_' || left(md5(n.name), 16) AS id, n.name, coalesce((SELECT value FROM b WHERE b.name = n.name AND field = 'category'), '') AS job_category, coalesce((SELECT value FROM b WHERE b.name = n.name AND field = 'level'), '') AS job_level, coalesce((SELECT value FROM b WHERE b.name = n.name AND field = 'degree'), '') AS degree_requirement,
  coalesce(min_by(summary, k) FILTER (summary IS NOT NULL), min_by(described, k)) AS summary, count(*) AS occurrence_count FROM n GROUP BY n.name
UNION ALL SELECT 'job_' || left(md5('only' || r_regionkey), 16), 'only' || r_regionkey, '', '', '', '', 0 FROM region
""")
def job_node_rollup(spark: SparkSession, d: str) -> DataFrame:
    mentioned = load(spark, d, "region").select(F.explode(F.array(F.concat(F.lit("only"), F.col("r_regionkey").cast("string")), F.lit("J1"), F.lit(" "))).alias("name"))
    got = rollups.job_nodes(_postings(spark, d), "k", mentioned=mentioned)
    return got.select("id", "name", "job_category", "job_level", "degree_requirement", F.col("raw_requirement_summary").alias("summary"), "occurrence_count")


@query(f"""
WITH {_POSTINGS},
f AS (SELECT p.*, o_orderpriority AS pr, o_orderstatus AS st FROM p JOIN orders ON o_orderkey = k WHERE standard IS NOT NULL QUALIFY row_number() OVER (PARTITION BY standard ORDER BY k) = 1),
a AS (SELECT standard, title, min(k) AS at_ FROM p WHERE standard IS NOT NULL GROUP BY standard, title), al AS (SELECT standard, string_agg(title, '|' ORDER BY at_) || '|' || standard AS aliases FROM a GROUP BY standard),
c AS (SELECT standard, count(*) AS source_count, round(greatest(0.6, avg(CASE WHEN success THEN 1 ELSE 0 END)), 2) AS confidence FROM p WHERE standard IS NOT NULL GROUP BY standard)
SELECT 'job_' || left(md5(c.standard), 12) AS doc_id, c.standard AS standard_job_name, aliases, source_count, confidence, pr || '|' || st AS hard_skills,
  concat_ws(' ', c.standard || '属于' || coalesce(nullif(category, 'nan'), '未明确分类') || '岗位，岗位层级为' || level || '。', '常见学历要求为' || degree || '，专业要求为未明确。', '核心硬技能包括：' || pr || '、' || st || '。', '岗位摘要：' || summary, '常见纵向发展路径：' || pr || '；T' || f.k % 7 || '。') AS doc_text
FROM c JOIN f ON f.standard = c.standard JOIN al ON al.standard = c.standard
""")
def knowledge_rollup(spark: SparkSession, d: str) -> DataFrame:
    got = rollups.knowledge_records(_postings(spark, d), "k")
    return got.select("doc_id", "standard_job_name", F.array_join("aliases", "|").alias("aliases"), "source_count", "confidence", F.array_join("hard_skills", "|").alias("hard_skills"), "doc_text")


@query("""
WITH c AS (SELECT c_custkey AS k, c_mktsegment AS m, CASE WHEN c_custkey % 7 = 0 THEN '现居：杭州市西湖区' WHEN c_custkey % 7 = 1 THEN '地址 在北京' WHEN c_custkey % 7 = 2 THEN '住址：' ELSE '' END AS home, CASE WHEN c_custkey % 5 = 0 THEN '期望城市：Paris' WHEN c_custkey % 5 = 1 THEN '求职意向：' || repeat('很长', 11) ELSE '' END AS wish FROM customer),
x AS (
  SELECT k, m, CASE WHEN k % 3 = 0 THEN '地' || k END AS a1, CASE WHEN k % 4 = 0 THEN 'b' || k END AS a2, CASE k % 7 WHEN 0 THEN '杭州市西湖区' WHEN 1 THEN '北京' END AS a3, CASE WHEN k % 6 = 0 THEN 'w' || k END AS w1, CASE k % 5 WHEN 0 THEN 'Paris' END AS w2, CASE WHEN k % 8 = 0 THEN '上海' || m WHEN k % 2 = 0 THEN m END AS t FROM c)
SELECT k AS c_custkey, coalesce(a1, a2, a3, '未提供') AS address, CASE WHEN a1 IS NOT NULL THEN 'resume' WHEN a2 IS NOT NULL THEN 'profile' WHEN a3 IS NOT NULL THEN 'resume_lines' END AS address_source,
  coalesce(w1, w2, CASE WHEN k % 8 = 0 THEN '上海' END, '未提供') AS wish, CASE WHEN w1 IS NOT NULL THEN 'resume' WHEN w2 IS NOT NULL THEN 'resume_lines' WHEN k % 8 = 0 THEN 'target_job_intention' END AS wish_source, coalesce(t, '未提供') AS target,
  CASE WHEN k % 10 = 0 THEN 'S' || k WHEN k % 3 = 1 THEN 'P' || k WHEN k % 2 = 0 THEN m ELSE '未提供推荐岗位' END AS job, CASE WHEN k % 10 = 0 THEN 'market' WHEN k % 3 = 1 THEN 'career_path' WHEN k % 2 = 0 THEN 'job_match' END AS job_source,
  CASE WHEN k % 10 = 0 THEN '甲、乙' WHEN k % 9 < 3 THEN array_to_string(list_transform(range(least(k % 9 + 3, 5)), lambda i: 'c' || i), '、') WHEN k % 9 = 3 THEN 'd' ELSE '暂无地点信息' END AS place, CASE WHEN k % 10 = 0 THEN 'market' WHEN k % 9 < 3 THEN 'snapshot' WHEN k % 9 = 3 THEN 'profile' END AS place_source,
  CASE WHEN k % 20 = 0 THEN '月均约 ' || k WHEN k % 4 = 1 THEN k || ' - ? / 月' WHEN k % 4 = 2 THEN '月均约 ' || k % 13 ELSE '暂无薪资信息' END AS salary, CASE WHEN k % 20 = 0 THEN 'market' WHEN k % 4 = 1 THEN 'snapshot' WHEN k % 4 = 2 THEN 'profile' END AS salary_source FROM x
""")
def fact_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Addresses, wishes and what the market says of a recommended job, from profile, resume lines, match and path, with sources."""
    k, m = F.col("c_custkey"), F.col("c_mktsegment")
    word = lambda letter, n=k: F.concat(F.lit(letter), n.cast("string"))
    body = F.concat_ws(
        "\n", F.lit("张三"), F.when(k % 7 == 0, "现居：杭州市西湖区").when(k % 7 == 1, "地址 在北京").when(k % 7 == 2, "住址："), F.when(k % 5 == 0, "期望城市： Paris ").when(k % 5 == 1, F.concat(F.lit("求职意向："), F.repeat(F.lit("很长"), F.lit(11)))), F.lit("爱好：上海菜")
    )
    target = F.when(k % 8 == 0, F.concat(F.lit("上海"), m)).when(k % 2 == 0, m)
    own = facts.user_location([("resume", F.when(k % 3 == 0, word("地"))), ("profile", F.when(k % 4 == 0, word(" b")).otherwise(" "))], [("resume", F.when(k % 6 == 0, word("w")))], [("resume", target)], body)
    none, cities = F.lit(None).cast("string"), F.transform(F.sequence(F.lit(0), k % 9 + 2), lambda i: F.concat(F.lit("c"), i.cast("string")))
    market = facts.recommended_market(
        [("career_path", F.when(k % 3 == 1, word("P"))), ("job_match", F.when(k % 2 == 0, m))], [("snapshot", F.when(k % 9 < 3, cities)), ("profile", F.when(k % 9 == 3, F.array(F.lit(""), F.lit("d"), F.lit("d"))))],
        [("snapshot", F.when(k % 4 == 1, facts.salary_said(k, none, none))), ("profile", F.when(k % 4 == 2, facts.salary_said(none, none, k % 13)))],
        ("market", F.when(k % 10 == 0, word("S")), F.when(k % 10 == 0, F.array(F.lit("甲"), F.lit("乙"), F.lit("甲"))), F.when(k % 20 == 0, facts.salary_said(none, none, k))),
    )
    got = load(spark, d, "customer").select("c_custkey", own.alias("u"), market.alias("r"))
    pair = lambda path, name: [F.col(f"{path}.value").alias(name), F.col(f"{path}.source").alias(f"{name}_source")]
    return got.select(
        "c_custkey", *pair("u.user_address", "address"), *pair("u.employment_intention_address", "wish"), F.col("u.target_job_intention.value").alias("target"), *pair("r.recommended_job", "job"), *pair("r.recommended_job_location", "place"), *pair("r.recommended_job_salary", "salary"),
    )
