"""Standard names by the dictionaries of several modules; their SQL joins the dictionaries as tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import registry
from ..operators import candidates, resolve
from .tables import load

QUERIES = {}
SQL: dict[str, str] = {}

#: Texts on which the dictionaries agree, and some on which they don't; a customer's key picks three.
_WORDS = [
    "Py", "sklearn", " Tableau", "mysql 8", "powerbi看板", "Spring Cloud", "C++", "c", "可视化大屏", "Shell脚本", "JVM调优", "none", "X-ray", "特征工程", "torchvision", "K8S", "软件工程", "应用统计学", "管理", "cet6", "英语六级证书", "教资",
    "软件设计师", "驾照", "Power-BI", "LLM", "数据", "-", "Hive SQL", "AB 测试", "机器学习", "统计",
]
_PAIRS = [("skill", "aggregator"), ("skill", "job_profile"), ("skill", "student"), ("tool", "job_profile"), ("certificate", "job_profile"), ("certificate", "assets"), ("major", "job_profile"), ("major", "assets"), ("major", "student")]


def _table(pairs: list[tuple[str, str]]) -> str:
    rows = []
    for domain, module in pairs:
        for k, (name, words) in enumerate(registry.entry(domain, module).aliases.items()):
            rows += [f"('{domain} {module}', {k}, '{name}', '{w.lower()}', 0)" for w in words]
            rows += [f"('{domain} {module}', {k}, '{name}', '{name.lower()}', 2)"] if name.lower() not in map(str.lower, words) else []
    return ", ".join(rows)


_SIGNS = r"[()（）\[\]【】\-_/|｜·,，;；:+.#\s]"

SQL["standard_names"] = f"""
WITH a(source, ord, name, alias, kind) AS (VALUES {_table(_PAIRS)}),
al AS (SELECT DISTINCT source, ord, name, regexp_replace(lower(alias), '{_SIGNS}', '', 'g') AS form, bool_or(kind = 2) OVER (PARTITION BY source, ord, alias) AS only_name, regexp_replace(lower(name), '{_SIGNS}', '', 'g') AS own FROM a),
w AS (SELECT DISTINCT trim(x) AS plain, regexp_replace(lower(trim(x)), '{_SIGNS}', '', 'g') AS token FROM (SELECT unnest({_WORDS!r}) AS x) WHERE trim(x) NOT IN ('none', '-')),
s AS (SELECT DISTINCT source FROM al),
hit AS (
  SELECT w.plain, al.source, min_by(al.name, al.ord) AS name FROM w, al
  WHERE w.plain = al.name OR token = own OR (NOT only_name AND form <> '' AND (token = form OR (length(form) >= 2 AND contains(token, form)) OR (length(token) >= 2 AND contains(form, token)))) GROUP BY ALL),
t AS (SELECT w.plain, s.source, coalesce(hit.name, w.plain) AS name FROM w CROSS JOIN s LEFT JOIN hit ON hit.plain = w.plain AND hit.source = s.source),
c AS (SELECT c_custkey, unnest([1, 2, 3]) AS place, trim(unnest([{_WORDS!r}[c_custkey % 32 + 1], {_WORDS!r}[c_nationkey % 32 + 1], {_WORDS!r}[c_custkey // 32 % 32 + 1]])) AS plain FROM customer),
n AS (SELECT c_custkey, source, name, min(place) AS place FROM c JOIN t ON t.plain = c.plain GROUP BY ALL)
SELECT c_custkey, source, string_agg(name, '|' ORDER BY place) AS names FROM n GROUP BY c_custkey, source
"""


def standard_names(spark: SparkSession, d: str) -> DataFrame:
    """Lists of three texts a customer, under nine dictionaries; customers without a text have no row."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    word = lambda at: F.get(F.array(*[F.lit(w) for w in _WORDS]), (at % len(_WORDS)).cast("int"))
    listed = F.concat_ws("；", word(k), word(n), word(F.floor(k / len(_WORDS))))
    rows = load(spark, d, "customer").select("c_custkey", listed.alias("listed"))
    named = resolve.with_standard_names(rows, "listed", _PAIRS)
    return named.select("c_custkey", F.explode("named").alias("e")).select("c_custkey", "e.source", F.array_join("e.names", "|").alias("names")).filter("names <> ''")


QUERIES["standard_names"] = standard_names

SQL["list_items"] = """
WITH x AS (SELECT o_orderkey AS k, o_orderpriority AS p, o_orderstatus AS s FROM orders)
SELECT k AS o_orderkey, CASE k % 5 WHEN 0 THEN p || '#' || s WHEN 1 THEN p || '｜' || s || '#b' WHEN 2 THEN 'a#' || p WHEN 3 THEN p || ' ' || s ELSE '' END AS extraction, CASE k % 5 WHEN 0 THEN p || '#' || s WHEN 1 THEN p || '#' || s || '#b' WHEN 2 THEN 'a#' || p WHEN 3 THEN p || '#' || s ELSE '' END AS job_profile,
  CASE k % 5 WHEN 0 THEN p || '#' || s WHEN 1 THEN p || '｜' || s || '#b' WHEN 2 THEN 'a#' || p WHEN 3 THEN p || '#' || s ELSE '' END AS resume FROM x
"""


def list_items(spark: SparkSession, d: str) -> DataFrame:
    """Lists with separators on which modules differ, JSON arrays, repeats and blanks, from all orders."""
    p, s, form = F.col("o_orderpriority"), F.col("o_orderstatus"), F.col("o_orderkey") % 5
    forms = [F.concat(p, F.lit("、"), s, F.lit(" ,nan;"), p), F.concat(p, F.lit("｜"), s, F.lit("/b")), F.concat(F.lit('["a", "'), p, F.lit('", "a", " "]')), F.concat(p, F.lit("\n"), s)]
    listed = reduce(lambda rest, k: F.when(form == k, forms[k]).otherwise(rest), range(len(forms)), F.lit(None).cast("string"))
    rows = load(spark, d, "orders").select("o_orderkey", listed.alias("listed"))
    return rows.select("o_orderkey", *[F.array_join(registry.items(F.col("listed"), m), "#").alias(m) for m in ("extraction", "job_profile", "resume")])


QUERIES["list_items"] = list_items


#: Role words that share no letter with one another, by type of part.
_ROLES = {"ECONOMY": "运维", "LARGE": "测试", "STANDARD": "算法", "SMALL": "产品", "PROMO": "数据", "MEDIUM": "销售"}
_ROLE_LIST = list(_ROLES.values())

SQL["candidate_jobs"] = f"""
WITH p AS (SELECT p_type, CAST(regexp_extract(p_brand, '\\d+') AS BIGINT) AS b, count(*) AS n FROM part GROUP BY ALL),
a AS (SELECT map_extract({{{", ".join(f"'{k}': '{v}'" for k, v in _ROLES.items())}}}::MAP(VARCHAR, VARCHAR), p_type)[1] AS word, CAST(b AS VARCHAR) AS d, lower(p_type) AS term, b, n, round(b % 4 / 4.0 * 0.8, 4) AS quality FROM p),
names AS (SELECT *, word || 'b' || d AS name, row_number() OVER (ORDER BY b, term) AS at_ FROM a),
r AS (
  SELECT c_custkey AS id, c_custkey % 5 AS form, {_ROLE_LIST!r}[c_custkey % 6 + 1] AS w, {_ROLE_LIST!r}[c_custkey // 6 % 6 + 1] AS w2, CAST(c_custkey % 25 + 1 AS VARCHAR) AS d, CASE c_custkey % 3 WHEN 0 THEN [] WHEN 1 THEN ['economy'] ELSE ['promo', '没有'] END AS own FROM customer),
m AS (
  SELECT r.*, names.*, CASE WHEN form IN (0, 1) THEN CASE WHEN w = word THEN 1.0 ELSE 0.0 END WHEN form = 2 THEN greatest(CASE WHEN w = word OR w2 = word THEN 2.0 * 2 / ((CASE WHEN w = w2 THEN 2 ELSE 4 END) + 3 + length(names.d)) ELSE 0.0 END, CASE WHEN w = w2 THEN CASE WHEN w = word THEN 1.0 ELSE 0.0 END ELSE CASE WHEN word IN (w, w2) THEN 0.5 ELSE 0.0 END END)
    WHEN form = 3 THEN greatest(CASE WHEN starts_with(names.d, r.d) THEN 1.0 ELSE 0.0 END, 2.0 * (CASE WHEN w = word THEN 2 ELSE 0 END + 1 + CASE WHEN r.d = names.d THEN length(r.d) WHEN len(list_intersect(string_split(r.d, ''), string_split(names.d, ''))) > 0 THEN 1 ELSE 0 END) / (3 + length(r.d) + 3 + length(names.d))) ELSE 0.0 END AS s FROM r, names),
k AS (SELECT *, round(s, 4) AS sim FROM m WHERE round(s, 4) >= 0.45 QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(s, 4) DESC, at_) <= 12),
c AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, at_) AS nth, round(CASE WHEN len(own) = 0 THEN 0 ELSE len(list_filter(own, lambda t: t = term)) / len(own) END, 4) AS skill FROM k),
z AS (SELECT *, round(0.35 * sim + 0.35 * skill + 0.20 * quality + 0.10 * (0.7 * least(n / 300.0, 1.0) + 0.3 * CASE WHEN b % 5 = 0 THEN 1 ELSE 0 END), 4) AS score FROM c),
best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, nth) AS place FROM z WHERE score >= 0.16)
SELECT id AS request_id, place, name, score AS candidate_score, sim AS name_score, skill AS skill_score FROM best WHERE place <= 5
"""


def candidate_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Requests of all customers, by a word, a word with blanks, two words, a whole name or nothing, with and without terms."""
    k = F.col("c_custkey")
    number = F.regexp_extract("p_brand", r"\d+", 0).cast("long")
    word_of = F.coalesce(*[F.when(F.col("p_type") == t, F.lit(w)) for t, w in _ROLES.items()])
    grouped = load(spark, d, "part").groupBy("p_type", number.alias("b")).agg(F.count("*").alias("sample_count"))
    assets = grouped.select(
        F.concat(word_of, F.lit("b"), F.col("b").cast("string")).alias("name"), F.struct("b", F.lower("p_type").alias("t")).alias("place"), F.array("p_type").alias("terms"), F.round(F.col("b") % 4 / 4.0 * 0.8, 4).alias("quality"), "sample_count", (F.col("b") % 5 == 0).alias("is_core"), (F.col("b") % 3).alias("required_points"),
    )
    role = lambda at: F.get(F.array(*[F.lit(w) for w in _ROLE_LIST]), (at % 6).cast("int"))
    w, w2, form = role(k), role(F.floor(k / 6)), k % 5
    request = F.when(form == 0, w).when(form == 1, F.concat(F.lit(" "), w, F.lit("岗位 "))).when(form == 2, F.when(w == w2, w).otherwise(F.concat_ws("/", w, w2))).when(form == 3, F.concat(w, F.lit("B"), (k % 25 + 1).cast("string"))).otherwise(" ")
    own = F.when(k % 3 == 0, F.array().cast("array<string>")).when(k % 3 == 1, F.array(F.lit("Economy"), F.lit("岗位"))).otherwise(F.array(F.lit("promo"), F.lit("没有")))
    requests = load(spark, d, "customer").select(k.alias("request_id"), request.alias("request"), own.alias("terms"))
    return candidates.candidate_jobs(requests, assets).drop("reason")


QUERIES["candidate_jobs"] = candidate_jobs
