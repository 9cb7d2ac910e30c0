"""Queries over documents, pages, conversations and vectors: cleaning, relevance, extraction, similarity, search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parse, similarity, text, vocab
from ..operators import clean, relevance, resolve, resume, titles, vector
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


@query(r"""
WITH u AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(html, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&') AS h FROM pages),
c AS (SELECT page_id, trim(regexp_replace(h, '[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\v]+', ' ', 'g')) AS h FROM u),
b AS (SELECT page_id, regexp_replace(CASE WHEN lower(h) IN ('', 'nan', 'none', 'null', 'n/a', 'na', '-') THEN NULL ELSE h END, '(?i)<br\s*/?>|</p>|</li>', chr(10), 'g') AS h FROM c),
t AS (SELECT page_id, regexp_replace(h, '<[^>]+>', ' ', 'g') AS h FROM b),
e AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(h, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&') AS h FROM t),
x AS (SELECT page_id, regexp_replace(regexp_replace(h, '[ \t\r\x{3000}]+', ' ', 'g'), '\n+', chr(10), 'g') AS h FROM e)
SELECT page_id, md5(regexp_replace(h, '^[ \n]+|[ \n]+$', '', 'g')) AS text_md5, length(regexp_replace(h, '^[ \n]+|[ \n]+$', '', 'g')) AS chars FROM x
""")
def clean_html(spark: SparkSession, d: str) -> DataFrame:
    t = text.strip_html(F.col("html"))
    return load(spark, d, "pages").select("page_id", t.alias("t")).select("page_id", F.md5("t").alias("text_md5"), F.char_length("t").cast("long").alias("chars"))


#: Job titles that documents are given by their id, so that all branches of the decision occur.
_JOB_TITLES = ["Java开发工程师", "会计", "技术支持", "销售经理", "产品经理", "实施工程师", "运营专员", "测试", "项目经理", "x"]


def _weights_sql(column: str, weights: dict[str, float]) -> str:
    return "(" + " + ".join(f"CASE WHEN contains({column}, '{k}') THEN {float(w)} ELSE 0.0 END" for k, w in weights.items()) + ")::DOUBLE"


def _side_sql(lists: tuple) -> str:
    return "round(1.2 * round({}, 4) + round({}, 4) + round({}, 4), 4)".format(*[_weights_sql(c, w) for c, w in zip("tdi", lists, strict=True)])


_AMBIGUOUS_SQL = " OR ".join(f"contains(t, '{w}')" for w in vocab.AMBIGUOUS_TITLES)
_SCORES = f"""
WITH x AS (SELECT doc_id, lower({_JOB_TITLES!r}[doc_id % 10 + 1]) AS t, left(lower(CASE WHEN doc_id % 4 = 0 THEN '负责软件开发 java ' WHEN doc_id % 4 = 1 THEN '会计核算 ' ELSE '' END || coalesce(text, '')), {relevance.DESCRIPTION_CHARS}) AS d, CASE WHEN doc_id % 3 = 0 THEN '互联网' WHEN doc_id % 3 = 1 THEN '制造' ELSE '' END AS i FROM documents),
s AS (SELECT doc_id, {_side_sql((vocab.CS_TITLE, vocab.CS_DESCRIPTION, vocab.CS_INDUSTRY))} AS cs, {_side_sql((vocab.NON_CS_TITLE, vocab.NON_CS_DESCRIPTION, vocab.NON_CS_INDUSTRY))} AS non, {_AMBIGUOUS_SQL} AS amb FROM x),
d AS (SELECT *, non >= 3 AND non - cs >= 1.5 AS dr, cs >= 3 AND cs - non >= 1 AND NOT (amb AND non > 0) AS kp, amb AND cs >= 2.4 AND non <= 1.2 AS sf FROM s)
"""


def _audited(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    title = F.get(F.array(*[F.lit(t) for t in _JOB_TITLES]), (k % 10).cast("int"))
    description = F.concat(F.when(k % 4 == 0, "负责软件开发 java ").when(k % 4 == 1, "会计核算 ").otherwise(""), F.coalesce("text", F.lit("")))
    industry = F.when(k % 3 == 0, "互联网").when(k % 3 == 1, "制造").otherwise("")
    return relevance.audited(load(spark, d, "documents").select("doc_id", title.alias("job_title"), description.alias("job_description"), industry.alias("industry")))


@query(
    _SCORES
    + """SELECT doc_id, cs, non, CASE WHEN dr THEN 'drop' WHEN kp OR sf THEN 'keep' WHEN cs >= non THEN 'keep' ELSE 'drop' END AS decision,
 round(CASE WHEN dr THEN least(0.99, 0.65 + 0.06 * non) WHEN kp THEN least(0.99, 0.62 + 0.05 * cs) WHEN sf THEN 0.72 ELSE 0.51 END::DOUBLE, 4) AS confidence,
 CASE WHEN dr OR kp OR sf THEN 'rule' ELSE 'fallback' END AS source FROM d"""
)
def three_way_decision(spark: SparkSession, d: str) -> DataFrame:
    """The real dictionaries, over whole documents as descriptions (the rule reads 1,400 characters of one)."""
    a = _audited(spark, d)
    return a.select("doc_id", F.col("cs_score").alias("cs"), F.col("non_cs_score").alias("non"), F.when(F.col("is_cs_related"), "keep").otherwise("drop").alias("decision"), F.col("cs_filter_confidence").alias("confidence"), F.col("cs_filter_source").alias("source"))


@query(
    _SCORES
    + """SELECT CASE WHEN dr OR kp OR sf THEN 'rule' ELSE 'fallback' END AS cs_filter_source, CASE WHEN dr THEN false WHEN kp OR sf THEN true ELSE cs >= non END AS is_cs_related, count(*) AS n FROM d GROUP BY 1, 2"""
)
def source_audit(spark: SparkSession, d: str) -> DataFrame:
    return relevance.source_counts(_audited(spark, d))


@query("""
WITH b AS (SELECT doc_id, n_chars, source, md5(text) AS k1, CASE WHEN doc_id % 3 <> 0 THEN md5(lower(regexp_replace(text, '[ \t\r\n]+', ' ', 'g'))) END AS k2, lang || source || CAST(n_chars AS VARCHAR) AS k3 FROM documents),
r1 AS (SELECT *, row_number() OVER (PARTITION BY k1 ORDER BY n_chars DESC, doc_id) AS n1 FROM b),
r2 AS (SELECT *, CASE WHEN k2 IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY k2 ORDER BY n_chars DESC, doc_id) END AS n2 FROM r1 WHERE n1 = 1),
r3 AS (SELECT *, row_number() OVER (PARTITION BY k3 ORDER BY n_chars DESC, doc_id) AS n3 FROM r2 WHERE n2 = 1)
SELECT doc_id, CAST(NULL AS VARCHAR) AS duplicate_rule FROM r3 WHERE n3 = 1 UNION ALL SELECT doc_id, 'text' FROM r1 WHERE n1 > 1 UNION ALL SELECT doc_id, 'normal_text' FROM r2 WHERE n2 > 1 UNION ALL SELECT doc_id, 'shape' FROM r3 WHERE n3 > 1
""")
def layered_dedup(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").select("doc_id", "n_chars", F.md5("text").alias("k1"), F.when(F.col("doc_id") % 3 != 0, F.md5(F.lower(F.regexp_replace("text", "[ \\t\\r\\n]+", " ")))).alias("k2"), F.concat("lang", "source", F.col("n_chars").cast("string")).alias("k3"))
    keys = [("text", F.col("k1")), ("normal_text", F.col("k2")), ("shape", F.col("k3"))]
    return clean.layered_dedup(docs, keys, [F.desc("n_chars"), F.asc("doc_id")], audit=True).select("doc_id", "duplicate_rule")


@query(r"""
WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[。！？!?；;\n]+'), lambda x: trim(x)), lambda x: length(x) >= 2 AND length(x) <= 240 AND (contains(lower(x), 'the') OR contains(lower(x), 'der'))) AS f FROM documents)
SELECT doc_id, substr(f[1], 1, 220) AS sentence FROM s
""")
def evidence_sentence(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", text.evidence(F.col("text"), ["the", "der"]).alias("sentence"))


_DOMAINS_SQL = " OR ".join(f"domain = '{x}' OR domain LIKE '%.{x}'" for x in vocab.EMAIL_DOMAINS)
_NEAR_SQL = " OR ".join(f"contains(line, '{w}')" for w in vocab.EMAIL_CONTEXT)


@query(rf"""
WITH m AS (SELECT doc_id, list_distinct(regexp_extract_all(text, '([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)', 1)) AS v, text FROM documents),
e AS (SELECT doc_id, text, unnest(v) AS value FROM m),
p AS (SELECT *, strpos(text, value) AS pos, lower(split_part(value, '@', 2)) AS domain FROM e),
q AS (SELECT *, trim(string_split(substr(text, 1, pos - 1), chr(10))[-1] || CASE WHEN contains(substr(text, pos), chr(10)) THEN split_part(substr(text, pos), chr(10), 1) ELSE substr(text, pos, 160) END) AS line FROM p),
s AS (SELECT *, 100 + CASE WHEN {_NEAR_SQL} THEN 30 ELSE 0 END + CASE WHEN pos <= 800 THEN 18 WHEN pos <= 2000 THEN 8 ELSE 0 END + CASE WHEN {_DOMAINS_SQL} THEN 8 ELSE 0 END + CASE WHEN length(value) <= 40 THEN 5 ELSE 0 END - CASE WHEN regexp_matches(value, '[-+%]{{2,}}') THEN 12 ELSE 0 END AS score FROM q),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos, value DESC) AS n, count(*) OVER (PARTITION BY doc_id) AS emails FROM s)
SELECT doc_id, emails, score, value AS best_email FROM r WHERE n = 1
""")
def contact_candidates(spark: SparkSession, d: str) -> DataFrame:
    got = load(spark, d, "documents").select("doc_id", resume.emails(F.col("text")).alias("c"))
    return got.filter(F.size("c") > 0).select("doc_id", F.size("c").cast("long").alias("emails"), F.col("c")[0]["score"].alias("score"), F.col("c")[0]["value"].alias("best_email"))


@query("""
SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC) AS n FROM conversations WHERE role IN ('user', 'assistant') AND trim(text) <> '') WHERE n <= 12
""")
def recent_history(spark: SparkSession, d: str) -> DataFrame:
    return vector.recent_history(load(spark, d, "conversations"), "conv_id", "turn", "role", "text").select("conv_id", "turn", "role", "text")


@query("""
SELECT conv_id, turn, score FROM (SELECT conv_id, turn, CASE WHEN contains(lower(text), 'the') THEN 2 ELSE 0 END + CASE WHEN contains(lower(text), 'an') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'ing') THEN 2 ELSE 0 END AS score FROM conversations)
WHERE score > 0 ORDER BY score DESC, conv_id, turn LIMIT 6
""")
def chunk_keyword_topk(spark: SparkSession, d: str) -> DataFrame:
    return vector.chunk_top_k(load(spark, d, "conversations"), "text", ["the", "an", "ing"], [F.asc("conv_id"), F.asc("turn")]).select("conv_id", "turn", "score")


@query("""
WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0),
s AS (SELECT vec_id, list_dot_product(CAST(embedding AS DOUBLE[]), CAST(q.e AS DOUBLE[])) / (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(q.e AS DOUBLE[])))) AS score FROM embeddings, q)
SELECT vec_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, vec_id LIMIT 20
""")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    vectors = load(spark, d, "embeddings")
    wanted = vectors.filter("vec_id = 0").first()
    if wanted is None:
        return vectors.select("vec_id", F.lit(0.0).alias("score")).limit(0)
    return vector.top_k(vectors, wanted["embedding"], 20, "vec_id").select("vec_id", F.round("score", 6).alias("score"))


@query("""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query, v.vec_id, list_dot_product(v.e, q.e) / (sqrt(list_dot_product(v.e, v.e)) * sqrt(list_dot_product(q.e, q.e))) AS score FROM v, v q WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query, vec_id, round(score, 6) AS score, rank FROM r WHERE rank <= 20
""")
def cosine_topk_many(spark: SparkSession, d: str) -> DataFrame:
    vectors = load(spark, d, "embeddings")
    asked = vectors.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
    return vector.top_k_many(vectors, asked, 20, "vec_id").select("query", "vec_id", F.round("score", 6).alias("score"), "rank")


@query("""
WITH t AS (SELECT item_id, unnest(list_transform(regexp_extract_all(text, '([A-Za-z0-9_]{2,})', 1), lambda x: lower(x))) AS tok FROM benchmark),
s AS (SELECT item_id, CAST(('0x' || substr(md5(tok), 1, 8)) AS BIGINT) % 384 AS slot, CASE WHEN CAST(('0x' || substr(md5(tok), 9, 2)) AS BIGINT) % 2 = 0 THEN 1.0 ELSE -1.0 END AS sgn FROM t),
v AS (SELECT item_id, slot, sum(sgn) AS x FROM s GROUP BY ALL), n AS (SELECT item_id, sqrt(sum(x * x)) AS l FROM v GROUP BY 1)
SELECT item_id, slot, round(x / l, 6) AS x FROM v JOIN n USING (item_id) WHERE x <> 0
""")
def hash_embedding(spark: SparkSession, d: str) -> DataFrame:
    return vector.hashed(load(spark, d, "benchmark"), "item_id", "text").select("item_id", "slot", F.round("x", 6).alias("x"))


_PROFILE = """
WITH d AS (SELECT DISTINCT p_name FROM part WHERE p_name IS NOT NULL),
w AS (SELECT p_name AS id, unnest(list_distinct(string_split(p_name, ' '))) AS tok FROM d),
b AS (SELECT id, 'token' AS kind, tok AS key FROM w UNION SELECT p_name, 'prefix3', substr(p_name, 1, 3) FROM d),
u AS (SELECT kind, key FROM b GROUP BY ALL HAVING count(*) BETWEEN 2 AND 200),
p AS (SELECT DISTINCT x.id AS id_1, y.id AS id_2 FROM b x JOIN b y ON x.kind = y.kind AND x.key = y.key AND x.id < y.id JOIN u ON u.kind = x.kind AND u.key = x.key)
"""


def _names(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    names = load(spark, d, "part").filter("p_name is not null").select(F.col("p_name").alias("id")).distinct()
    pair = lambda k, c: F.struct(F.lit(k).alias("kind"), c.alias("key"))
    keys = F.concat(F.transform(F.array_distinct(F.split("id", " ")), lambda t: pair("token", t)), F.array(pair("prefix3", F.left("id", F.lit(3)))))
    return names, titles.blocked_pairs(names, "id", keys)


@query(_PROFILE + "SELECT id_1, id_2 FROM p")
def pair_blocking(spark: SparkSession, d: str) -> DataFrame:
    """By the rule of the blocks, keys that over 200 share make no pairs."""
    return _names(spark, d)[1]


@query(
    _PROFILE
    + """, c AS (SELECT id_1, id_2, regexp_replace(id_1, '[\\s]', '', 'g') AS a, regexp_replace(id_2, '[\\s]', '', 'g') AS b FROM p),
s AS (SELECT *, list_distinct(string_split(a, '')) AS x, list_distinct(string_split(b, '')) AS y FROM c)
SELECT id_1, id_2, CASE WHEN a = b THEN 1.0 WHEN contains(a, b) OR contains(b, a) THEN 0.9 ELSE round(2.0 * len(list_intersect(x, y)) / (len(x) + len(y)), 4) END AS similarity FROM s"""
)
def pair_similarity(spark: SparkSession, d: str) -> DataFrame:
    return _names(spark, d)[1].select("id_1", "id_2", similarity.token_similarity(F.col("id_1"), F.col("id_2")).alias("similarity"))


@query()
def sequence_ratio(spark: SparkSession, d: str) -> DataFrame:
    """difflib's ratio has no SQL form."""
    return _names(spark, d)[1].select("id_1", "id_2", F.round(similarity.sequence_ratio(F.col("id_1"), F.col("id_2")), 4).alias("ratio"))


def _least_neighbours(rounds: int) -> str:
    """Labels that take the least one of their neighbours, again and again: exact if the last round changes nothing."""
    step = "l{b} AS (SELECT l.id, least(l.c, min(n.c)) AS c FROM l{a} l JOIN e ON e.a = l.id JOIN l{a} n ON n.id = e.b GROUP BY l.id, l.c)"
    return ", ".join(step.format(a=k, b=k + 1) for k in range(rounds))


@query(f"""
WITH d AS (SELECT DISTINCT l_suppkey AS a, 100000000 + l_partkey AS b FROM lineitem), e AS (SELECT a, b FROM d UNION ALL SELECT b, a FROM d), l0 AS (SELECT DISTINCT a AS id, a AS c FROM e), {_least_neighbours(12)}
SELECT id, c AS cluster FROM l12
""")
def components(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers and parts by all lines. Two of them are few steps apart, so twelve rounds settle the labels of the SQL."""
    e = load(spark, d, "lineitem").select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") + 100000000).alias("b")).distinct()
    nodes = e.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    return titles.components(nodes, e)


@query("""
WITH s AS (SELECT c_custkey, list_filter(['java' , 'spark', 'excel', 'sql'], lambda x: (c_custkey + length(x)) % 3 <> 0) AS st FROM customer), j AS (SELECT ['java', 'javascript', 'sql'] AS jt)
SELECT c_custkey, len(st) AS n_tags, CAST(list_contains(st, 'java') AS INTEGER) + CAST(list_contains(st, 'sql') AS INTEGER) AS matched, round((CAST(list_contains(st, 'java') AS INTEGER) + CAST(list_contains(st, 'sql') AS INTEGER)) / 3 * 100, 2) AS score FROM s, j
""")
def greedy_tag_match(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    tags = F.array_compact(F.array(*[F.when((k + len(t)) % 3 != 0, F.lit(t)) for t in ("java", "spark", "excel", "sql")]))
    job = F.array(*[F.lit(t) for t in ("java", "javascript", "sql")])
    got = load(spark, d, "customer").select("c_custkey", tags.alias("st"))
    pairs = similarity.one_to_one(F.col("st"), job, 0.75)
    return got.select("c_custkey", F.size("st").cast("long").alias("n_tags"), F.size(pairs).alias("matched"), similarity.tags_score(F.col("st"), job, 0.75).alias("score"))


@query("""
SELECT conv_id, turn, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '([a-z0-9+#.]{2,}|[\\x{4e00}-\\x{9fff}]{2,})', 1))), ',') AS keywords FROM conversations
""")
def question_keywords(spark: SparkSession, d: str) -> DataFrame:
    words = vector.question_keywords(F.col("text"), most=1_000_000)
    return load(spark, d, "conversations").select("conv_id", "turn", F.array_join(F.array_sort(words), ",").alias("keywords"))


@query("""
WITH x AS (SELECT doc_id, doc_id % 5 AS g, doc_id % 7 AS c, doc_id % 3 AS e FROM documents)
SELECT doc_id, ['本科', '学历不限', '硕士', '大专', '未明确'][g + 1] AS degree, [3, 0, 4, 2, -1][g + 1] AS rank,
 CASE c WHEN 0 THEN 'PMP:must' WHEN 1 THEN 'PMP:preferred' WHEN 2 THEN 'CET-6:mentioned' WHEN 3 THEN 'CET-6:preferred' WHEN 4 THEN 'PMP:mentioned' ELSE '' END AS certificates, CASE e WHEN 0 THEN '3-5年经验' ELSE '' END AS experience FROM x
""")
def requirement_extraction(spark: SparkSession, d: str) -> DataFrame:
    """Degree, certificate and experience sentences in every combination. Words of force count in the certificate's own
    sentence, however far apart, and not in another one."""
    pick = lambda n, *words: F.get(F.array(*[F.lit(w) for w in words]), (F.col("doc_id") % n).cast("int"))
    degree = pick(5, "本科及以上学历", "学历不限", "硕士或博士", "大专学历", "无")
    certificate = pick(7, "候选人入职之前必须已经拿到并且能够出示有效的PMP", "有PMP者在同等条件之下将会被我们优先考虑", "CET-6", "英语CET-6加分", "PMP。其他优先", "无", "擅长写作")
    years = pick(3, "3年以上", "无", "态度好")
    rows = load(spark, d, "documents").select("doc_id", F.concat_ws("。", degree, certificate, years).alias("t"))
    got = rows.select("doc_id", parse.degree_requirement(F.col("t")).alias("g"), parse.certificates(F.col("t")).alias("c"), parse.experience(F.col("t")).alias("e"))
    named = F.array_join(F.transform("c", lambda x: F.concat(x["name"], F.lit(":"), x["force"])), ",")
    return got.select("doc_id", F.col("g.degree").alias("degree"), F.col("g.rank").alias("rank"), named.alias("certificates"), F.array_join("e", ",").alias("experience"))


@query("""
WITH n AS (SELECT DISTINCT 'Brand' || lpad(split_part(p_brand, '#', 2), 3, '0') AS name, 8 AS l FROM part), k AS (SELECT unnest(range(6)) AS stage_no)
SELECT CASE stage_no WHEN 0 THEN name WHEN 1 THEN lower(name) || ' (岗位)' WHEN 2 THEN '俗称' || name WHEN 3 THEN '招 ' || name || ' 人' WHEN 4 THEN 'x' || name ELSE '无此名' || substr(name, 7) END AS request,
 CASE WHEN stage_no < 5 THEN 'resolved' ELSE 'unresolved' END AS status, ['exact', 'normalized', 'alias', 'tokens', 'similarity', NULL][stage_no + 1] AS stage, CASE WHEN stage_no < 5 THEN name END AS name,
 CASE stage_no WHEN 0 THEN 1.0 WHEN 1 THEN 0.96 WHEN 2 THEN 0.98 WHEN 3 THEN 0.9 WHEN 4 THEN round(2.0 * l / (2 * l + 1), 4) END::DOUBLE AS confidence FROM n, k
""")
def name_resolution(spark: SparkSession, d: str) -> DataFrame:
    """All five stages and a miss for every brand. A letter before a name leaves no other within .08 of its similarity."""
    number = F.lpad(F.split_part("p_brand", F.lit("#"), F.lit(2)), 3, "0")
    names = load(spark, d, "part").select(F.concat(F.lit("Brand"), number).alias("name")).distinct()
    name = F.col("name")
    forms = F.array(name, F.concat(F.lower(name), F.lit(" (岗位)")), F.concat(F.lit("俗称"), name), F.concat(F.lit("招 "), name, F.lit(" 人")), F.concat(F.lit("x"), name), F.concat(F.lit("无此名"), F.substring(name, F.lit(7), F.char_length(name))))
    aliases = names.select(F.concat(F.lit("俗称"), name).alias("alias"), "name")
    return resolve.resolve(names.select(F.explode(forms).alias("request")), names, aliases).select("request", "status", "stage", "name", "confidence")
