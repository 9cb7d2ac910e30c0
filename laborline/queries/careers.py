"""Queries over students, resumes, questions and asset rules: scores, gates, routing, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import ability, match, path, resolve, resume, sqlapi, student
from .tables import load

QUERIES = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_HARD = """
lab AS (SELECT p_brand, ['学历不限', '大专', '本科', '硕士', '博士'][p_size % 5 + 1] AS degree, CASE WHEN p_size % 11 = 0 THEN '未明确' ELSE p_type END AS major FROM part),
d AS (SELECT p_brand, degree, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY p_brand) AS ratio FROM lab GROUP BY p_brand, degree),
m AS (SELECT p_brand, major, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY p_brand) AS ratio, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, major) AS rank FROM lab GROUP BY p_brand, major),
dr AS (SELECT *, round(ratio, 4) AS r, CASE degree WHEN '学历不限' THEN 0 WHEN '大专' THEN 2 WHEN '本科' THEN 3 WHEN '硕士' THEN 4 ELSE 5 END AS level FROM d),
g AS (SELECT p_brand, max_by(degree, n * 10 + level) AS gate, max_by(level, n * 10 + level) AS gate_level FROM dr GROUP BY 1),
mg AS (SELECT p_brand, major, round(ratio, 4) AS r, rank, p_brand NOT IN ('Brand#3', 'Brand#7') AND rank <= 2 AND major <> '未明确' AS in_gate FROM m),
s AS (
  SELECT c_custkey, 'Brand#' || c_custkey % 25 + 1 AS p_brand, ['', '大专', '本科', '硕士', '博士', '其他'][c_custkey % 6 + 1] AS degree, [0, 2, 3, 4, 5, 0][c_custkey % 6 + 1] AS level,
    ['ECONOMY', 'PROMO', '专业：large', '', '哲学', 'SMALL.', 'MED'][c_custkey % 7 + 1] AS major, ['economy', 'promo', 'large', '', '哲学', 'small', 'med'][c_custkey % 7 + 1] AS token FROM customer),
deg AS (
  SELECT s.c_custkey, any_value(gate_level) <= 0 OR (s.level > 0 AND s.level >= any_value(gate_level)) AS pass, sum(CASE WHEN dr.level <= 0 OR s.level >= dr.level THEN r ELSE 0 END) AS enough, sum(CASE WHEN dr.level > 0 AND s.level < dr.level THEN r ELSE 0 END) AS more
  FROM s JOIN dr USING (p_brand) JOIN g USING (p_brand) GROUP BY s.c_custkey, s.level),
sim AS (
  SELECT s.c_custkey, s.major AS own, mg.major, r, in_gate, CASE WHEN token = '' THEN 0.0 WHEN token = lower(mg.major) THEN 1.0 WHEN contains(token, lower(mg.major)) OR contains(lower(mg.major), token) THEN 0.9
    ELSE round(2.0 * len(list_intersect(string_split(token, ''), string_split(lower(mg.major), ''))) / (len(list_distinct(string_split(token, ''))) + len(list_distinct(string_split(lower(mg.major), '')))), 4) END AS like_it
  FROM s JOIN mg USING (p_brand)),
maj AS (
  SELECT c_custkey, own, bool_or(in_gate) AS gated, coalesce(max(like_it) FILTER (in_gate), 0.0) AS best, coalesce(sum(r) FILTER (major <> '未明确' AND like_it >= 0.75), 0.0) AS share FROM sim GROUP BY c_custkey, own),
cert AS (SELECT c_custkey, c_custkey % 3 AS musts, c_custkey % 2 AS options, least(c_custkey % 3, c_custkey % 4) AS met, CASE WHEN c_custkey % 4 = 3 THEN c_custkey % 2 ELSE 0 END AS liked, c_custkey % 10 / 10.0 AS none FROM customer),
hard AS (
  SELECT c_custkey, deg.pass AS degree_pass, CASE WHEN deg.pass AND more <= 0.2 THEN 'high_match' WHEN enough > 0 THEN 'risk' ELSE 'no_match' END AS degree_risk, round(least(enough, 1), 4) AS qualified, round(least(more, 1), 4) AS higher,
    NOT gated OR (own <> '' AND best >= 0.75) AS major_pass, CASE WHEN (NOT gated OR (own <> '' AND best >= 0.75)) AND (share >= 0.3 OR NOT gated) THEN 'high_match' WHEN share > 0 OR best >= 0.5 THEN 'risk' ELSE 'no_match' END AS major_risk, round(share, 4) AS matched,
    met = musts AS certificate_pass, CASE WHEN met <> musts THEN 'no_match' WHEN musts + options = 0 OR (met + liked) / (musts + options) >= 0.6 OR none >= 0.5 THEN 'high_match' ELSE 'risk' END AS certificate_risk,
    round(CASE WHEN musts + options = 0 THEN 1 ELSE (met + liked) / (musts + options) END, 4) AS certificates
  FROM deg JOIN maj USING (c_custkey) JOIN cert USING (c_custkey))
"""


def _hard_info(spark: SparkSession, d: str) -> DataFrame:
    """c_custkey, degree, major, certificate: each customer against the distributions of the parts of one brand."""
    from ..operators import stats

    part, k = load(spark, d, "part"), F.col("c_custkey")
    level = F.get(F.array(*[F.lit(x) for x in ("学历不限", "大专", "本科", "硕士", "博士")]), (F.col("p_size") % 5).cast("int"))
    degrees = stats.distribution(part, ["p_brand"], level)
    majors = stats.distribution(part, ["p_brand"], F.when(F.col("p_size") % 11 == 0, "未明确").otherwise(F.col("p_type")))
    gate = stats.ordered_gate(degrees, ["p_brand"], match.compared_degree_rank(F.col("name"))).select("p_brand", "gate")
    jobs = stats.nested(degrees, ["p_brand"], "degrees").join(stats.nested(majors, ["p_brand"], "majors"), "p_brand").join(gate, "p_brand")
    gated = F.when(F.col("p_brand").isin("Brand#3", "Brand#7"), F.array().cast("array<string>")).otherwise(F.transform(F.filter("majors", lambda x: (x["rank"] <= 2) & (x["name"] != "未明确")), lambda x: x["name"]))
    pick = lambda *v: F.get(F.array(*[F.lit(x) for x in v]), (k % len(v)).cast("int"))
    students = load(spark, d, "customer").select("c_custkey", F.concat(F.lit("Brand#"), (k % 25 + 1).cast("string")).alias("p_brand"), pick("", "大专", "本科", "硕士", "博士", "其他").alias("own_degree"), pick("ECONOMY", "PROMO", "专业：large", "", "哲学", "SMALL.", "MED").alias("own_major"))
    names = lambda n, word: F.transform(F.filter(F.sequence(F.lit(0), F.lit(2)), lambda i: i < n), lambda i: F.concat(F.lit(word), F.element_at(F.array(F.lit("甲"), F.lit("乙"), F.lit("丙")), i + 1)))
    certificate = match.certificate_info(F.concat(names(k % 4, "证书："), F.when(k % 4 == 3, F.array(F.lit("Optional"))).otherwise(F.array().cast("array<string>"))), names(k % 3, ""), F.when(k % 2 == 1, F.array(F.lit("optional"))).otherwise(F.array().cast("array<string>")), k % 10 / 10)
    return students.join(jobs, "p_brand").select("c_custkey", match.degree_info(F.col("own_degree"), F.col("degrees"), F.col("gate")).alias("degree"), match.major_info(F.col("own_major"), F.col("majors"), gated).alias("major"), certificate.alias("certificate"))


@query(f"""
WITH {_HARD}
SELECT * FROM hard
""")
def hard_gates(spark: SparkSession, d: str) -> DataFrame:
    got = _hard_info(spark, d)
    return got.select(
        "c_custkey", F.col("degree.pass").alias("degree_pass"), F.col("degree.risk_level").alias("degree_risk"), F.col("degree.qualified_ratio").alias("qualified"), F.col("degree.higher_requirement_ratio").alias("higher"),
        F.col("major.pass").alias("major_pass"), F.col("major.risk_level").alias("major_risk"), F.col("major.matched_ratio").alias("matched"), F.col("certificate.pass").alias("certificate_pass"), F.col("certificate.risk_level").alias("certificate_risk"), F.col("certificate.matched_ratio").alias("certificates"),
    )


@query(f"""
WITH {_HARD},
x AS (
  SELECT *, ['high_match', 'match', 'risk', 'no_match', ''][c_custkey % 5 + 1] AS level, c_custkey % 4 AS miss, c_custkey % 9 AS hit, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 2 = 0 END AS known, (c_custkey % 100) / 100.0 AS acc, degree_pass AND major_pass AND certificate_pass AS gates FROM hard),
r AS (
  SELECT c_custkey, gates, hit, list_filter(list_distinct_ordered, lambda v: v IS NOT NULL) AS risks FROM (
    SELECT *, [CASE WHEN level NOT IN ('', 'high_match', 'match') THEN '风险等级为' || level END, CASE WHEN miss > 0 THEN '缺失知识点：' || array_to_string(list_transform(range(miss), lambda i: 'p' || i), '、') END,
      CASE WHEN known = false THEN '知识点覆盖率为' || c_custkey % 100 || '%，尚未达到80%' END,
      CASE degree_risk WHEN 'risk' THEN '学历可满足部分企业要求，但仍存在更高学历样本，建议用项目和技能增强竞争力。' WHEN 'no_match' THEN '学历暂未覆盖岗位样本中的主流要求，存在明显风险。' END,
      CASE major_risk WHEN 'risk' THEN '专业与岗位存在一定相关性，但不是最主流要求，建议用项目经历强化方向证明。' WHEN 'no_match' THEN '专业与岗位主流要求重合较弱，存在明显专业匹配风险。' END,
      CASE certificate_risk WHEN 'risk' THEN '没有触发强制证书风险，但建议补充岗位高频偏好证书提升竞争力。' WHEN 'no_match' THEN '缺少岗位高频强制证书，证书项存在明显风险。' END] AS list_distinct_ordered FROM x))
SELECT c_custkey, CASE WHEN len(risks) = 0 AND c_custkey % 3 <> 0 THEN '赛题综合评测尚未完全通过' ELSE array_to_string(risks[1:6], '|') END AS risks,
  concat_ws('|', CASE WHEN gates THEN '学历、专业、证书硬门槛通过' END, CASE WHEN hit > 0 THEN '已命中知识点：' || array_to_string(list_transform(range(least(hit, 6)), lambda i: 'q' || i), '、') END, CASE WHEN c_custkey % 2 = 0 THEN '推荐' || c_custkey END, CASE WHEN c_custkey % 50 > 0 THEN '主展示分为' || printf('%.2f', c_custkey % 50 * 1.5) END) AS strengths
FROM r
""")
def score_explanations(spark: SparkSession, d: str) -> DataFrame:
    """Risks and advantages from levels, knowledge points and what is said of degree, major and certificates."""
    k = F.col("c_custkey")
    level = F.get(F.array(*[F.lit(x) for x in ("high_match", "match", "risk", "no_match", "")]), (k % 5).cast("int"))
    points = lambda n, letter: F.transform(F.filter(F.sequence(F.lit(0), F.lit(8)), lambda i: i < n), lambda i: F.concat(F.lit(letter), i.cast("string")))
    got = match.explanations(
        level, points(k % 4, "p"), points(k % 9, "q"), F.when(k % 7 != 0, k % 2 == 0), (k % 100) / 100, [F.col(c) for c in ("degree", "major", "certificate")], k % 3 == 0,
        F.when(k % 2 == 0, F.concat(F.lit("推荐"), k.cast("string"))).otherwise(" "), k % 50 * 1.5,
    )
    rows = _hard_info(spark, d).withColumn("e", got)
    return rows.select("c_custkey", F.array_join("e.risks", "|").alias("risks"), F.array_join("e.advantages", "|").alias("strengths"))


@query("""
WITH o AS (SELECT o_custkey AS c_custkey, o_orderkey AS k, o_orderkey % 7 AS f, o_orderpriority || '-' || o_orderkey % 2 AS it FROM orders),
score AS (SELECT c_custkey, c_custkey % 50 + 50 AS score FROM customer),
missing AS (
  SELECT c_custkey, min(k) AS pl, type, item, status FROM (
    SELECT c_custkey, k, CASE k % 5 WHEN 0 THEN 'hard_skills' WHEN 1 THEN 'tool_skills' WHEN 2 THEN 'education' WHEN 3 THEN 'soft_skills' ELSE 'general' END AS type, CASE WHEN k % 6 = 5 THEN '' ELSE it END AS item, CASE WHEN k % 2 = 0 THEN 'r' || k % 4 ELSE 'x' || k % 3 END AS status FROM o WHERE f = 0) GROUP BY ALL),
had AS (SELECT c_custkey, it, CASE WHEN k % 2 = 0 THEN 'hard_skills' ELSE 'tool_skills' END AS type FROM o WHERE f = 1 UNION ALL SELECT c_custkey, it, 'hard_skills' FROM o WHERE f = 2 UNION ALL SELECT c_custkey, it, 'tool_skills' FROM o WHERE f = 3
  UNION ALL SELECT c_custkey, item, type FROM missing),
wanted AS (SELECT c_custkey, 'hard_skills' AS type, it, min(k) AS pl FROM o WHERE f IN (4, 5) GROUP BY ALL UNION ALL SELECT c_custkey, 'tool_skills', it, min(k) FROM o WHERE f IN (5, 6) GROUP BY ALL),
g AS (
  SELECT c_custkey, 1 AS src, pl, type, item, status, 'job_match.missing_items' AS source FROM missing
  UNION ALL SELECT c_custkey, CASE type WHEN 'hard_skills' THEN 2 ELSE 3 END, pl, type, it, CASE type WHEN 'hard_skills' THEN '学生侧尚未形成稳定技能证据' ELSE '学生侧尚未形成稳定工具使用证据' END, CASE type WHEN 'hard_skills' THEN 'job_profile.hard_skills' ELSE 'job_profile.tools_or_tech_stack' END
    FROM wanted w WHERE NOT EXISTS (SELECT 1 FROM had h WHERE h.c_custkey = w.c_custkey AND h.type = w.type AND h.it = w.it)
  UNION ALL SELECT c_custkey, 4, min(k), 'student_weakness', 'w' || k % 4, 'w' || k % 4, 'student_profile.weaknesses' FROM o WHERE f = 3 GROUP BY c_custkey, k % 4
  UNION ALL SELECT c_custkey, 5, min(k), 'missing_dimension', 'd' || k % 3, '学生画像仍缺少d' || k % 3 || '相关证据', 'student_profile.missing_dimensions' FROM o WHERE f = 4 GROUP BY c_custkey, k % 3),
said AS (SELECT DISTINCT c_custkey, it FROM o WHERE f = 6)
SELECT g.c_custkey, row_number() OVER (PARTITION BY g.c_custkey ORDER BY src, pl) AS place, type AS gap_type, item AS gap_item, status AS current_status,
  CASE WHEN src = 4 THEN '将该短板拆成可执行训练任务，并补充可量化成果或项目证明。' WHEN src = 5 THEN '优先补充该维度的信息、经历或作品材料，以便提升后续匹配和报告质量。' WHEN said.it IS NOT NULL THEN '补' || item
    WHEN type = 'hard_skills' THEN '围绕 ' || coalesce(nullif(item, ''), '岗位核心硬技能') || ' 补充系统学习和项目实践，并在简历中补充应用场景与成果。' WHEN type = 'tool_skills' THEN '补充 ' || coalesce(nullif(item, ''), '岗位工具栈') || ' 的实操案例，例如分析看板、数据处理脚本或作品集。'
    WHEN type = 'soft_skills' THEN '在项目和实习经历中补充 ' || coalesce(nullif(item, ''), '关键软技能') || ' 的行为证据与协作成果。' WHEN type = 'education' THEN '若学历/专业背景不完全匹配，建议通过相关课程、项目、证书或竞赛提升岗位方向背书。' ELSE '结合岗位要求补充可量化的学习成果、项目经验和简历表达证据。' END AS action_hint,
  CASE WHEN src > 3 THEN 'medium' WHEN type IN ('hard_skills', 'tool_skills') THEN 'high' WHEN type = 'education' THEN CASE WHEN score < 75 THEN 'high' ELSE 'medium' END WHEN type = 'soft_skills' THEN 'medium' ELSE 'low' END AS priority, source
FROM g JOIN score ON score.c_custkey = g.c_custkey LEFT JOIN said ON said.c_custkey = g.c_custkey AND said.it = g.item
""")
def gap_priorities(spark: SparkSession, d: str) -> DataFrame:
    """Gaps of all customers that have orders, from five sources that their orders are dealt to."""
    k, f = F.col("o_orderkey"), F.col("o_orderkey") % 7
    it = F.concat("o_orderpriority", F.lit("-"), (k % 2).cast("string"))
    kinds = F.get(F.array(*[F.lit(x) for x in ("hard_skills", " tool_skills", "education", "soft_skills", " NaN ")]), (k % 5).cast("int"))
    item = F.struct(kinds.alias("dimension"), F.when(k % 6 == 5, "none").otherwise(it).alias("required_item"), F.when(k % 2 == 1, F.concat(F.lit("x"), (k % 3).cast("string"))).otherwise("").alias("student_item"), F.concat(F.lit("r"), (k % 4).cast("string")).alias("reason"))
    found = F.struct(F.when(k % 2 == 0, "hard_skills").otherwise("tool_skills").alias("dimension"), it.alias("required_item"))
    listed = lambda cond, value: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct(k.alias("k"), value.alias("v"))))), lambda x: x["v"])
    word = lambda letter, n: F.concat(F.lit(letter), (k % n).cast("string"))
    pairs = load(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        listed(f == 0, item).alias("missing_items"), listed(f == 1, found).alias("matched_items"), listed(f == 2, it).alias("hard_skills"), listed(f == 3, it).alias("tool_skills"), listed(f.isin(4, 5), it).alias("required_skills"), listed(f.isin(5, 6), it).alias("required_tools"),
        listed(f == 3, word("w", 4)).alias("weaknesses"), listed(f == 4, word("d", 3)).alias("missing_dimensions"), listed(f == 6, F.concat(F.lit("补"), it)).alias("improvement_suggestions"),
    )
    return path.gap_analysis(pairs.withColumn("overall_match_score", F.col("c_custkey") % 50 + 50), ["c_custkey"])


@query("""
SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders WHERE o_orderstatus <> 'P') WHERE n = 1
""")
def best_without_fallback(spark: SparkSession, d: str) -> DataFrame:
    options = load(spark, d, "orders").withColumn("source", F.when(F.col("o_orderstatus") == "P", "fallback").otherwise("graph"))
    return path.best_options(path.without_fallback(options), "o_custkey", "o_totalprice", "o_orderkey").select("o_custkey", "o_orderkey")


#: Parts of questions; a row's keys choose one of each.
_QUESTIONS = [
    ["", "我想问", "上海", "南山区", "在北京市", "Suzhou "], ["Java", "前端", "数据挖掘工程师", "会计", "大模型算法", "PYTHON ", "护理"], ["薪资15-25k", "月薪不低于2万", "工资8000以上", "高薪", "20 w", "", "10~15", "期望 9.5K"],
    ["有哪些岗位", "的公司", "的晋升路径", "需要什么证书", "写一份总结报告", "为什么推荐", "的行业分布", "我的技能如何", "", "你好", "Promote_To", "筛选成都"],
]
_PARTS = " || ".join(f"{words!r}[{at} % {len(words)} + 1]" for words, at in zip(_QUESTIONS, ("c_custkey", "c_nationkey", "c_custkey // 5", "c_custkey // 11"), strict=True))
_HAN = "[\\x{4e00}-\\x{9fff}"


def _question() -> Column:
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    places = (k, n, F.floor(k / 5), F.floor(k / 11))
    return F.concat(*[F.get(F.array(*[F.lit(w) for w in words]), (at % len(words)).cast("int")) for words, at in zip(_QUESTIONS, places, strict=True)])


_SLOTS = f"""
q AS (SELECT c_custkey, trim({_PARTS}) AS t FROM customer),
s AS (
  SELECT c_custkey, t, coalesce(nullif(regexp_extract(t, '({_HAN}]{{2,12}}(?:市|省|自治区|特别行政区|自治州|地区|盟|县|区))', 1), ''), CASE WHEN contains(t, '上海') THEN '上海' WHEN contains(t, '成都') THEN '成都' END) AS city,
    CASE WHEN contains(lower(t), 'java') THEN 'java' WHEN contains(lower(t), 'python') THEN 'python' WHEN contains(t, '前端') THEN '前端' WHEN contains(t, '算法') THEN '算法' WHEN contains(t, '数据') THEN '数据' ELSE nullif(regexp_extract(t, '({_HAN}A-Za-z0-9+#/]{{2,20}}(?:开发|测试|工程师|运维|算法|产品))', 1), '') END AS job,
    CASE WHEN regexp_matches(t, '薪资|工资|收入|月薪|k|K|w|W|万') THEN CASE WHEN contains(t, '15-25k') THEN 15000.0 WHEN contains(t, '10~15') THEN 10.0 WHEN contains(t, '低于2万') THEN 20000.0 WHEN contains(t, '工资8000') THEN 8000.0 WHEN contains(t, '20 w') THEN 200000.0 WHEN contains(t, '9.5K') THEN 9500.0 END END::DOUBLE AS salary FROM q)
"""


@query(f"""
WITH {_SLOTS},
i AS (
  SELECT *, CASE WHEN regexp_matches(lower(t), '路径图谱|岗位路径|职业路径|晋升|转岗|promote_to|transfer_to|图谱关系') THEN 'career_path_question' WHEN regexp_matches(t, '报告|总结|行动计划|职业建议|结论|规划建议') THEN 'report_question'
    WHEN regexp_matches(t, '为什么推荐|为什么不匹配|匹配|风险|覆盖率|赛题评测|硬门槛|最推荐') THEN 'match_explanation' WHEN regexp_matches(t, '我的学历|我的专业|我的技能|我的证书|我的项目|我的实习|学生画像|个人画像|我会什么') THEN 'student_profile_question'
    WHEN regexp_matches(t, '岗位要求|学历|专业|证书|技能要求|知识点|需要什么|要求是什么') THEN 'job_requirement_question' WHEN regexp_matches(t, '公司|企业|厂|投递清单') THEN 'company_search' WHEN regexp_matches(t, '薪资|工资|收入|月薪|待遇|k|K|万|高薪') THEN 'salary_search'
    WHEN regexp_matches(t, '行业|领域|产业') THEN 'industry_search' WHEN regexp_matches(t, '城市|地区|地点|北京|上海|广州|深圳|杭州|成都|南京|苏州|武汉') AND regexp_matches(t, '有哪些|哪些|查询|筛选|多少|分布|样本|机会|岗位') THEN 'city_market_search' ELSE 'general_advice' END AS intent FROM s)
SELECT c_custkey, intent, CASE intent WHEN 'career_path_question' THEN 0.92 WHEN 'report_question' THEN 0.86 WHEN 'match_explanation' THEN 0.88 WHEN 'student_profile_question' THEN 0.86 WHEN 'job_requirement_question' THEN 0.84 WHEN 'company_search' THEN 0.9 WHEN 'salary_search' THEN 0.88 WHEN 'industry_search' THEN 0.82 WHEN 'city_market_search' THEN 0.84 ELSE 0.55 END::DOUBLE AS confidence,
  contains(intent, '_search') AS should_use_sql, city, job, salary FROM i
""")
def question_routing(spark: SparkSession, d: str) -> DataFrame:
    """The class and the slots of a question a customer, from all combinations of parts that their keys give."""
    rows = load(spark, d, "customer").select("c_custkey", sqlapi.intent(_question()).alias("i"), sqlapi.slots(_question()).alias("s"))
    return rows.select("c_custkey", "i.intent", "i.confidence", "i.should_use_sql", "s.city", "s.job", F.col("s.salary_floor").alias("salary"))


@query("""
WITH a AS (SELECT unnest(['上海Java月薪不低于12万', '前端有哪些', '薪资15-25w 数据', '成都的公司', '你好']) AS question, unnest(range(5)) AS q, unnest(['上海', NULL, NULL, '成都', NULL]) AS city, unnest(['java', '前端', '数据', NULL, NULL]) AS job, unnest([120000.0, NULL, 150000.0, NULL, NULL]) AS floor),
j AS (
  SELECT o_orderkey AS record_id, CASE WHEN o_custkey % 7 = 0 THEN ' ' ELSE 'C' || o_custkey END AS company_name, ['上海市', '成都', '北京'][o_custkey % 3 + 1] AS city, ['JAVA开发', 'Web前端', '数据分析师', '会计'][o_orderkey % 4 + 1] AS job_title, o_orderstatus AS standard_job_name,
    CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice END AS high, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice / 2 END AS low, o_totalprice / 3 AS other FROM orders),
m AS (SELECT q, j.*, coalesce(high, other, 0) AS best, coalesce(low, 0) AS least FROM a JOIN j ON (a.city IS NULL OR contains(j.city, a.city)) AND (a.job IS NULL OR contains(lower(job_title), a.job)) AND (floor IS NULL OR coalesce(high, other, 0) >= floor) WHERE company_name <> ' ')
SELECT q, row_number() OVER (PARTITION BY q ORDER BY best DESC, least DESC, record_id) AS place, company_name, city, job_title, standard_job_name FROM m QUALIFY place <= 15
""")
def questions_answered(spark: SparkSession, d: str) -> DataFrame:
    """Five questions against all orders as postings: filters by city, job and floor, the 15 best paid of each."""
    k, c, price = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice")
    pick = lambda at, *words: F.get(F.array(*[F.lit(w) for w in words]), (at % len(words)).cast("int"))
    jobs = load(spark, d, "orders").select(
        k.alias("record_id"), F.when(c % 7 == 0, " ").otherwise(F.concat(F.lit("C"), c.cast("string"))).alias("company_name"), pick(c, "上海市", "成都", "北京").alias("city"), pick(k, "JAVA开发", "Web前端", "数据分析师", "会计").alias("job_title"), F.lit(None).cast("string").alias("job_title_norm"),
        F.col("o_orderstatus").alias("standard_job_name"), F.when(k % 5 > 0, price).alias("salary_month_max"), (price / 3).alias("salary_max"), F.when(k % 2 == 0, price / 2).alias("salary_month_min"), F.lit(None).cast("double").alias("salary_min"), *[F.lit("").alias(x) for x in ("industry", "company_size", "company_type")],
    )
    asked = spark.createDataFrame(list(enumerate(["上海Java月薪不低于12万", "前端有哪些", "薪资15-25w 数据", "成都的公司", "你好"])), "q int, question string")
    return sqlapi.for_questions(asked, jobs, "q").select("q", "place", "company_name", "city", "job_title", "standard_job_name")


@query("""
WITH g AS (SELECT p_brand, count(*) AS n, avg(CASE WHEN p_size > 25 THEN 1 ELSE 0 END) AS a, avg(CASE WHEN p_size > 10 THEN 1 ELSE 0 END) AS b, avg(CASE WHEN p_retailprice > 1000 THEN 1 ELSE 0 END) AS c FROM part GROUP BY 1)
SELECT p_brand, round(0.35 * least(n / 50.0, 1) + 0.25 * a + 0.25 * b + 0.15 * c, 4) AS quality, round(greatest(0, least(100, a * 70 + least(1.8 * (n % 9) + 0.8 * (n % 5), 24) + least(ln(1 + n) * 2.5, 10))))::INTEGER AS professional,
 round(greatest(0, least(100, greatest(a, 1 - b) * 70 + least(10.0 * (n % 3) + 4.0 * (n % 4), 24))))::INTEGER AS certificate FROM g
""")
def asset_quality(spark: SparkSession, d: str) -> DataFrame:
    share = lambda c: F.avg(F.when(c, 1).otherwise(0))
    g = load(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"), share(F.col("p_size") > 25).alias("a"), share(F.col("p_size") > 10).alias("b"), share(F.col("p_retailprice") > 1000).alias("c"))
    n, a, b, c = (F.col(x) for x in "nabc")
    return g.select("p_brand", ability.source_quality(n, a, b, c).alias("quality"), ability.professional_score(a, n % 9, n % 5, n).alias("professional"), ability.certificate_score(a, b, n % 3, n % 4).alias("certificate"))


@query("""
WITH x AS (SELECT s_suppkey, (s_suppkey % 11) / 10.0 AS name, (s_suppkey % 7) / 10.0 AS skill, (s_suppkey % 5) / 5.0 AS q, s_suppkey * 3 AS samples, s_suppkey % 2 = 0 AS core FROM supplier),
r AS (SELECT s_suppkey, s_suppkey % 4 AS k, round(0.35 * name + 0.35 * skill + 0.20 * q + 0.10 * (0.7 * least(samples / 300.0, 1.0) + 0.3 * CAST(core AS INTEGER)), 4) AS score FROM x)
SELECT s_suppkey, score::DOUBLE AS score, CASE WHEN k = 0 THEN 'saved' WHEN k = 1 THEN 'known' END AS name, k <> 0 AND k <> 1 AS needs_confirmation FROM r
""")
def candidate_confirmation(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    score = resolve.candidate_score((k % 11) / 10, (k % 7) / 10, (k % 5) / 5, k * 3, k % 2 == 0)
    rows = load(spark, d, "supplier").select("s_suppkey", score.alias("score"), F.concat(F.when(k % 4 == 2, "Broad").otherwise("r"), k.cast("string")).alias("request"), F.when(k % 4 == 3, "ambiguous").otherwise("resolved").alias("status"), F.when(k % 4 == 1, "known").alias("name"))
    rows = rows.withColumn("request", F.when(F.col("s_suppkey") % 4 == 2, "BROAD").otherwise(F.col("request")))
    saved = rows.filter("s_suppkey % 4 = 0").select("request", F.lit("saved").alias("choice"))
    return resolve.confirmed(rows, saved, ["broad"]).select("s_suppkey", "score", "name", "needs_confirmation")


@query("""
WITH r AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS name, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS job FROM customer),
j AS (SELECT c_custkey, 'J' || c_custkey AS name, CASE WHEN c_custkey % 8 <> 0 THEN c_mktsegment || '!' END AS job FROM customer WHERE c_custkey % 5 <> 0),
m AS (SELECT r.c_custkey, coalesce(nullif(trim(r.name), ''), j.name) AS name, coalesce(nullif(trim(r.job), ''), j.job) AS job FROM r LEFT JOIN j USING (c_custkey))
SELECT *, concat_ws(',', CASE WHEN coalesce(trim(name), '') = '' THEN 'missing_name' END, CASE WHEN coalesce(trim(job), '') = '' THEN 'missing_job' END) AS warnings FROM m
""")
def merged_resume_fields(spark: SparkSession, d: str) -> DataFrame:
    c, k = load(spark, d, "customer"), F.col("c_custkey")
    rules = c.select("c_custkey", F.when(k % 3 == 0, "").otherwise(F.col("c_name")).alias("name"), F.when(k % 4 != 0, F.col("c_mktsegment")).alias("job"))
    judged = c.filter(k % 5 != 0).select("c_custkey", F.concat(F.lit("J"), k.cast("string")).alias("name"), F.when(k % 8 != 0, F.concat("c_mktsegment", F.lit("!"))).alias("job"))
    out = resume.merged_fields(rules, judged, "c_custkey", ["name", "job"])
    return out.select("c_custkey", "name", "job", F.array_join(resume.warnings({"name": F.col("name"), "job": F.col("job")}), ",").alias("warnings"))


@query("""
WITH x AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '项目实践不足' WHEN c_custkey % 3 = 1 THEN '实习经验不足，技能偏弱' ELSE '' END AS w, c_custkey % 2 AS projects, c_nationkey % 2 AS internships FROM customer)
SELECT c_custkey, concat_ws(',', CASE WHEN contains(w, '项目') AND projects = 0 THEN 'project' END, CASE WHEN contains(w, '实习') AND internships = 0 THEN 'internship' END, CASE WHEN contains(w, '技能') THEN 'skill' END) AS missing FROM x
""")
def missing_dimensions(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey") % 3
    w = F.when(k == 0, "项目实践不足").when(k == 1, "实习经验不足，技能偏弱").otherwise("")
    got = student.missing_dimensions(w, [("project", ["项目"]), ("internship", ["实习"]), ("skill", ["技能"])], {"project": F.col("c_custkey") % 2, "internship": F.col("c_nationkey") % 2})
    return load(spark, d, "customer").select("c_custkey", F.array_join(got, ",").alias("missing"))


@query("""
SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events
""")
def tolerant_json(spark: SparkSession, d: str) -> DataFrame:
    """Plain, fenced and embedded JSON, and none."""
    k, p = F.col("event_id") % 4, F.col("props")
    t = F.when(k == 0, p).when(k == 1, F.concat(F.lit("Here:\n```json\n"), p, F.lit("\n```"))).when(k == 2, F.concat(F.lit("It is "), p, F.lit(" as asked"))).otherwise("no object")
    return load(spark, d, "events").select("event_id", text.tolerant_json(t, "k long").alias("j")).select("event_id", F.col("j.k").alias("k"))


_KNOWLEDGE = {"RED": (["a", "b"], ["c"]), "dark red": (["b", "d"], ["a", "e"]), "blue": (["f"], [])}


@query("""
WITH x AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS skill FROM part)
SELECT skill, CASE WHEN lower(skill) LIKE '%red%' OR (length(skill) > 1 AND contains('red', lower(skill))) THEN 'a|b|d' WHEN length(skill) > 1 AND contains('darkred', lower(skill)) THEN 'b|d' WHEN lower(skill) LIKE '%blue%' OR (length(skill) > 1 AND contains('blue', lower(skill))) THEN 'f' ELSE '' END AS required,
 CASE WHEN lower(skill) LIKE '%red%' OR (length(skill) > 1 AND contains('red', lower(skill))) THEN 'c|e' WHEN length(skill) > 1 AND contains('darkred', lower(skill)) THEN 'a|e' ELSE '' END AS preferred FROM x
""")
def skill_knowledge(spark: SparkSession, d: str) -> DataFrame:
    skills = load(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("skill")).distinct()
    got = ability.skill_knowledge(skills, _KNOWLEDGE)
    return got.select("skill", F.array_join("required_points", "|").alias("required"), F.array_join("preferred_points", "|").alias("preferred"))


@query("""
WITH c AS (SELECT c_custkey, c_custkey % 7 AS p, c_custkey % 4 AS a FROM customer)
SELECT c_custkey, concat_ws('|', CASE WHEN a = 0 THEN 'C++' END, CASE WHEN p % 2 = 0 THEN 'Java' END, CASE WHEN p % 3 = 0 THEN 'SQL' END, CASE WHEN a = 0 THEN 'C' END) AS skills, CASE WHEN p < 3 THEN '大学英语六级' ELSE '' END AS certificates, CASE a WHEN 1 THEN '获国家奖学金' WHEN 2 THEN '数学建模一等奖|校优秀学生' ELSE '' END AS awards FROM c
""")
def resume_entities(spark: SparkSession, d: str) -> DataFrame:
    """Resumes of a header, a skill section, certificates and awards, built from each row; repeated lines are left out."""
    p, a = F.col("c_custkey") % 7, F.col("c_custkey") % 4
    skills = F.concat_ws("，", F.when(p % 2 == 0, "java"), F.when(p % 3 == 0, "熟悉 SQL 查询"), F.when(a == 0, "Ｃ++"))
    body = F.concat_ws("\n", F.lit("张三"), F.lit("专业技能"), skills, skills, F.lit("技能证书"), F.when(p < 3, "CET-6").otherwise("无"), F.lit("获奖情况"), F.when(a == 1, "获国家奖学金。").when(a == 2, "数学建模一等奖；校优秀学生").otherwise("无"))
    rows = load(spark, d, "customer").select("c_custkey", body.alias("body"))
    got = resume.entities(resume.sections(rows, "c_custkey", "body"), "c_custkey")
    return got.select("c_custkey", *[F.array_join(c, "|").alias(c) for c in ("skills", "certificates", "awards")])


@query("""
WITH c AS (SELECT c_custkey, ['本科', '硕士', '大专'][c_custkey % 3 + 1] AS degree FROM customer)
SELECT c_custkey, CAST(e AS BIGINT) AS entry, CASE e WHEN 1 THEN '2019.09' ELSE '2015.9' END AS start_date, CASE e WHEN 1 THEN '至今' ELSE '2019.06' END AS end_date, CASE e WHEN 1 THEN '某大学' ELSE '某市中学学校' END AS school, CASE e WHEN 1 THEN degree ELSE '' END AS degree,
 CASE e WHEN 1 THEN '软件工程' ELSE '' END AS major, CASE e WHEN 1 THEN '绩点 ' || c_custkey || chr(10) || '学生会' ELSE '' END AS description FROM c, (SELECT unnest([1, 2]) AS e)
""")
def resume_education(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    degree = F.get(F.array(F.lit("本科"), F.lit("硕士"), F.lit("大专")), (k % 3).cast("int"))
    body = F.concat(F.lit("李四\n教育经历\n2019.09 - 至今 某大学 软件工程 "), degree, F.lit("\n绩点 "), k.cast("string"), F.lit("\n学生会\n2015.9-2019-06 某市中学学校\n技能\n2018.01-2019.01 没有学校"))
    lines = resume.sections(load(spark, d, "customer").select("c_custkey", body.alias("body")), "c_custkey", "body")
    got = resume.education(resume.dated_entries(lines, "c_custkey", "education"))
    return got.select("c_custkey", "entry", "start_date", "end_date", "school", "degree", "major", "description")


_FIELDS = """
SELECT c_custkey, c_custkey % 6 AS k, c_nationkey % 5 AS n FROM customer
"""


@query(f"""
WITH x AS ({_FIELDS})
SELECT c_custkey, ['Python|SQL', '机器学习', 'Java|C++', '围棋', 'SQL', ''][k + 1] AS hard, ['Git', 'Docker|Excel', 'Linux', 'Excel', 'Kubernetes|Git', ''][k + 1] AS tools,
 concat_ws('|', '学历:本科', '学校:X大学', CASE WHEN n = 0 THEN '学校层次:211' END, CASE k WHEN 0 THEN '专业:计算机科学与技术' WHEN 1 THEN '专业:统计学' WHEN 2 THEN '专业:哲学' END, CASE WHEN n = 1 THEN '证书:CET-6' WHEN n = 2 THEN '证书:CPA|证书:驾照' END) AS tags,
 concat_ws('|', CASE WHEN k = 0 THEN '项目:数据处理' END, CASE WHEN n = 1 THEN '奖项:建模算法' END, CASE WHEN k = 1 THEN '项目:工程开发' END, CASE WHEN n = 2 THEN '实习:业务协作' END, CASE WHEN k < 2 THEN '有项目经历' END, CASE WHEN n = 2 THEN '有实习经历' END, CASE WHEN n = 1 THEN '有竞赛/获奖经历' END) AS experience,
 ['前端开发|后端开发', '会计|数据分析', '', '测试开发', '后端开发', '数据分析'][k + 1] AS hints FROM x
""")
def student_normalization(spark: SparkSession, d: str) -> DataFrame:
    """Skills and tools, qualifications, experience and directions of students, by their aliases."""
    k, n = (F.col("c_custkey") % 6).cast("int"), F.col("c_nationkey") % 5
    pick = lambda *values: F.get(F.array(*[F.lit(v) for v in values]), k)
    listed = lambda *values: F.split(pick(*values), ",")
    skills, tools = listed("python3,mysql,github", "sklearn,容器化", "jdk,cpp,shell", "围棋", "sql,k8s", ""), listed("gitlab", "vlookup", "bash", "数据透视表", "git", "")
    certificates = F.when(n == 1, F.array(F.lit("英语六级"), F.lit("cet6"))).when(n == 2, F.array(F.lit("注册会计师"), F.lit("驾照")))
    projects, internships, awards = F.when(k == 0, "用SQL做报表").when(k == 1, "写接口"), F.when(n == 2, "负责需求"), F.when(n == 1, "销量预测奖")
    got = student.skill_lists(skills, tools)
    tags = student.qualification_tags(F.lit("本科"), F.lit(" X大学 "), pick("软件工程", "应用统计", "哲学", "", "n/a", ""), certificates, F.when(n == 0, "211"))
    experience = student.experience_tags(projects, internships, awards, [F.when(k < 2, 1).otherwise(0), F.when(n == 2, 1).otherwise(0), F.when(n == 1, 1).otherwise(0)])
    hints = student.occupation_hints(pick("web前端", "会计", "", "", "", ""), F.when(k == 4, F.array(F.lit("Java开发"))), F.when(k == 0, "Go后端").when(k == 3, "软件测试"), F.when(k.isin(1, 5), "喜欢商业分析"))
    rows = load(spark, d, "customer").select("c_custkey", got.alias("s"), tags.alias("tags"), experience.alias("experience"), hints.alias("hints"))
    return rows.select("c_custkey", F.array_join("s.hard_skills", "|").alias("hard"), F.array_join("s.tool_skills", "|").alias("tools"), *[F.array_join(c, "|").alias(c) for c in ("tags", "experience", "hints")])


@query("""
WITH t AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) AS rank FROM t)
SELECT p_brand, CASE WHEN length(p_brand) % 2 = 0 THEN 'given' ELSE (SELECT p_type FROM r WHERE r.p_brand = b.p_brand AND p_type <> 'ECONOMY' ORDER BY rank LIMIT 1) END AS degree,
 CASE WHEN length(p_brand) % 2 = 0 THEN 'a|b' ELSE (SELECT string_agg(p_type, '|' ORDER BY rank) FROM r WHERE r.p_brand = b.p_brand AND rank <= 15) END AS skills FROM (SELECT DISTINCT p_brand FROM part) b
""")
def comparable_dimensions(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import stats

    dist = stats.nested(stats.distribution(load(spark, d, "part"), ["p_brand"], F.col("p_type")), ["p_brand"], "skill_frequency")
    shown = F.transform("skill_frequency", lambda x: F.struct(F.when(x["name"] == "ECONOMY", "未明确").otherwise(x["name"]).alias("name")))
    given, empty = F.length("p_brand") % 2 == 0, F.array().cast("array<string>")
    pairs = dist.withColumns(
        {
            "degree_distribution": shown, "required_degree": F.when(given, "given").otherwise(" "), "required_skills": F.when(given, F.array(F.lit("a"), F.lit(""), F.lit("b"), F.lit("a"))), "degree": F.lit("本科"),
            **{c: empty for c in ("skills", "tools", "required_tools", "soft_skills", "required_soft_skills")},
        }
    ).withColumn("skill_frequency", F.transform("skill_frequency", lambda x: F.struct(x["name"].alias("name"))))
    return match.comparable(pairs).select("p_brand", F.col("education.job").alias("degree"), F.array_join("hard_skills.job", "|").alias("skills"))


@query("SELECT o_orderkey AS record, o_totalprice AS salary_max_month FROM orders WHERE o_orderpriority = (SELECT min(o_orderpriority) FROM orders) ORDER BY o_totalprice DESC, o_orderkey LIMIT 80")
def profile_rows(spark: SparkSession, d: str) -> DataFrame:
    orders = load(spark, d, "orders").withColumnRenamed("o_orderpriority", "standard_job_name")
    first = orders.agg(F.min("standard_job_name")).first()[0]
    return sqlapi.profile_rows(orders, first, {"record": "o_orderkey", "salary_max_month": "o_totalprice"}, [F.desc("o_totalprice"), F.asc("o_orderkey")])


@query("SELECT c_custkey, c_name, s_name FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey")
def extraction_merge(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import titles

    found = load(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), "s_name", F.lit("other").alias("c_name"))
    return titles.with_extractions(load(spark, d, "customer").select("c_custkey", "c_name"), found, "c_custkey")
