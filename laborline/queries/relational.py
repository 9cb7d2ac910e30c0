"""Queries over the star-schema tables: distributions, gates, statistics, windows, joins and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parse, text
from ..operators import clean, graph, match, path, sqlapi, stats, student, titles
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


@query("""
WITH c AS (SELECT p_brand, p_type AS name, count(*) AS count FROM part GROUP BY ALL),
t AS (SELECT *, sum(count) OVER (PARTITION BY p_brand) AS total, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY count DESC, name) AS INTEGER) AS rank FROM c)
SELECT p_brand, rank, name, count, round(count / total, 4) AS ratio FROM t WHERE rank <= 3
""")
def ranked_distribution(spark: SparkSession, d: str) -> DataFrame:
    return stats.distribution(load(spark, d, "part"), ["p_brand"], F.col("p_type"), top=3)


@query("""
WITH p AS (SELECT p_brand, p_partkey, list_distinct(list_filter(string_split(p_name, ' '), lambda x: x <> '')) AS v FROM part),
e AS (SELECT p_brand, unnest(CASE WHEN len(v) > 0 THEN v ELSE ['unknown'] END) AS name FROM p),
c AS (SELECT p_brand, name, count(*) AS count FROM e GROUP BY ALL),
n AS (SELECT p_brand, count(*) AS total FROM part GROUP BY ALL),
r AS (SELECT c.*, n.total, CAST(row_number() OVER (PARTITION BY c.p_brand ORDER BY count DESC, name) AS INTEGER) AS rank FROM c JOIN n USING (p_brand))
SELECT p_brand, rank, name, count, round(count / total, 4) AS ratio FROM r WHERE rank <= 10
""")
def multi_valued_distribution(spark: SparkSession, d: str) -> DataFrame:
    return stats.multi_distribution(load(spark, d, "part"), ["p_brand"], F.split("p_name", " "), unknown="unknown", top=10)


@query("""
WITH b AS (SELECT c_nationkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS name FROM customer),
c AS (SELECT c_nationkey, name, count(*) AS count FROM b WHERE name IS NOT NULL GROUP BY ALL),
t AS (SELECT *, sum(count) OVER (PARTITION BY c_nationkey) AS total, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY count DESC, name) AS INTEGER) AS rank FROM c)
SELECT c_nationkey, rank, name, count, round(count / total, 4) AS ratio FROM t
""")
def column_distribution_nonblank(spark: SparkSession, d: str) -> DataFrame:
    segment = F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment"))
    return stats.distribution(load(spark, d, "customer"), ["c_nationkey"], segment, nonblank_ratio=True)


@query("""
SELECT o_orderpriority, round(avg(lo), 4) AS min_mean, round(quantile_cont(lo, 0.5), 4) AS min_median, round(quantile_cont(lo, 0.25), 4) AS min_p25, round(quantile_cont(lo, 0.75), 4) AS min_p75,
 round(avg(hi), 4) AS max_mean, round(quantile_cont(hi, 0.5), 4) AS max_median, round(quantile_cont(hi, 0.25), 4) AS max_p25, round(quantile_cont(hi, 0.75), 4) AS max_p75,
 round(avg(mid), 4) AS mid_mean, round(quantile_cont(mid, 0.5), 4) AS mid_median, round(quantile_cont(mid, 0.25), 4) AS mid_p25, round(quantile_cont(mid, 0.75), 4) AS mid_p75,
 greatest(count(lo), count(hi), count(mid)) AS valid_count
FROM (SELECT o_orderpriority, lo, hi, coalesce((lo + hi) / 2, lo, hi) AS mid FROM (
  SELECT o_orderpriority, o_totalprice AS lo, CASE WHEN o_custkey % 5 <> 0 THEN o_totalprice + o_custkey END AS hi FROM orders)) GROUP BY ALL
""")
def price_stats(spark: SparkSession, d: str) -> DataFrame:
    high = F.when(F.col("o_custkey") % 5 != 0, F.col("o_totalprice") + F.col("o_custkey"))
    return stats.salary_stats(load(spark, d, "orders"), ["o_orderpriority"], F.col("o_totalprice"), high, digits=4)


@query("""
WITH c AS (SELECT l_suppkey, l_returnflag || l_linestatus AS status, count(*) AS count FROM lineitem GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY count DESC, status) AS INTEGER) AS rank FROM c)
SELECT l_suppkey, rank, status, count FROM r WHERE rank <= 2
""")
def mode_and_top2(spark: SparkSession, d: str) -> DataFrame:
    lines = load(spark, d, "lineitem").withColumn("status", F.concat("l_returnflag", "l_linestatus"))
    return stats.modes(lines, ["l_suppkey"], "status", k=2)


@query("""
WITH c AS (SELECT o_custkey, o_orderpriority AS name, count(*) AS count, 6 - CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS lvl FROM orders GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY count DESC, lvl DESC) AS n FROM c)
SELECT o_custkey, name AS gate, lvl AS gate_rank FROM b WHERE n = 1
""")
def degree_gate(spark: SparkSession, d: str) -> DataFrame:
    dist = stats.distribution(load(spark, d, "orders"), ["o_custkey"], F.col("o_orderpriority"))
    return stats.ordered_gate(dist, ["o_custkey"], 6 - F.substring("name", 1, 1).cast("int"))


@query("""
WITH c AS (SELECT p_brand, p_type AS name, count(*) AS count FROM part GROUP BY ALL),
t AS (SELECT *, round(count / sum(count) OVER (PARTITION BY p_brand), 4) AS ratio, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY count DESC, name) AS INTEGER) AS rank FROM c),
h AS (SELECT *, max(CASE WHEN ratio >= 0.1 THEN 1 ELSE 0 END) OVER (PARTITION BY p_brand) AS has FROM t)
SELECT p_brand, rank, name, count, ratio FROM h WHERE CASE WHEN has = 1 THEN ratio >= 0.1 AND rank <= 5 ELSE rank <= 3 END
""")
def gate_set_with_fallback(spark: SparkSession, d: str) -> DataFrame:
    return stats.gate_set(stats.distribution(load(spark, d, "part"), ["p_brand"], F.col("p_type")), ["p_brand"])


@query("""
WITH n AS (SELECT user_id % 10 AS grp, count(*) AS total FROM events GROUP BY ALL),
s AS (SELECT user_id % 10 AS grp, event_type, count(*) AS mentions, count(*) FILTER (WHERE value >= 50) AS musts FROM events GROUP BY ALL)
SELECT grp, event_type, mentions, round(mentions / total, 4) AS ratio, round(musts / mentions, 4) AS must_share,
 CASE WHEN mentions / total >= 0.35 AND musts / mentions >= 0.5 THEN 'must' WHEN mentions / total >= 0.05 THEN 'preferred' ELSE 'rare' END AS class
FROM s JOIN n USING (grp)
""")
def must_preferred_split(spark: SparkSession, d: str) -> DataFrame:
    events = load(spark, d, "events").withColumn("grp", F.col("user_id") % 10)
    totals = events.groupBy("grp").agg(F.count("*").alias("_total"))
    return stats.must_or_preferred(events, ["grp"], "event_type", F.col("value") >= 50, totals)


@query("""
SELECT p_brand, count(*) AS rows, round(avg(CASE WHEN p_size > 10 THEN 0.5 ELSE 0 END) + avg(CASE WHEN p_type LIKE '%STANDARD%' THEN 0.3 ELSE 0 END) + avg(CASE WHEN p_retailprice > 1000 THEN 0.2 ELSE 0 END), 4) AS completeness
FROM part GROUP BY p_brand
""")
def weighted_completeness(spark: SparkSession, d: str) -> DataFrame:
    parts = [(F.col("p_size") > 10, 0.5), (F.col("p_type").contains("STANDARD"), 0.3), (F.col("p_retailprice") > 1000, 0.2)]
    return stats.weighted_presence(load(spark, d, "part"), ["p_brand"], parts)


@query("""
WITH w AS (SELECT p_partkey, p_brand, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS n FROM part),
f AS (SELECT *, CASE WHEN n > 3 THEN 1 ELSE 0 END AS late FROM w WHERE n <= 100),
r AS (SELECT *, CAST(row_number() OVER (ORDER BY late, p_retailprice DESC, p_partkey) AS INTEGER) AS display_order FROM f)
SELECT p_partkey, p_brand, p_retailprice, display_order FROM r WHERE display_order <= 100
""")
def core_selection_capped(spark: SparkSession, d: str) -> DataFrame:
    part = load(spark, d, "part").select("p_partkey", "p_brand", "p_retailprice")
    return stats.capped_selection(part, "p_brand", [F.desc("p_retailprice"), F.asc("p_partkey")], cap=3, n=100)


@query("""
WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS INTEGER) AS position FROM orders)
SELECT o_custkey, o_orderkey, o_totalprice, position FROM r WHERE position <= 3
""")
def first_k_per_group(spark: SparkSession, d: str) -> DataFrame:
    return stats.first_k(load(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.asc("o_orderkey")], 3).select("o_custkey", "o_orderkey", "o_totalprice", "position")


@query("""
WITH f AS (SELECT o_custkey, o_orderpriority AS v, min(o_orderkey) AS k FROM orders GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY k, v) AS n FROM f)
SELECT o_custkey, string_agg(v, '|' ORDER BY n) AS priorities FROM r WHERE n <= 3 GROUP BY o_custkey
""")
def ordered_distinct_values(spark: SparkSession, d: str) -> DataFrame:
    got = stats.ordered_distinct(load(spark, d, "orders"), ["o_custkey"], "o_orderpriority", F.col("o_orderkey"), "priorities", 3)
    return got.select("o_custkey", F.array_join("priorities", "|").alias("priorities"))


@query("""
SELECT s_suppkey, md5(s_name || '||' || CAST(s_nationkey AS VARCHAR)) AS full_hash, substr(md5(s_name || '||' || CAST(s_nationkey AS VARCHAR)), 1, 24) AS record_id,
 'supp_' || substr(md5(s_name), 1, 16) AS node_id, substr(sha1(s_name), 1, 12) AS short_id, sha256(s_name) AS cache_key FROM supplier
""")
def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    key = text.key_of(F.col("s_name"), F.col("s_nationkey"))
    return load(spark, d, "supplier").select(
        "s_suppkey", F.md5(key).alias("full_hash"), text.stable_id(key).alias("record_id"), text.stable_id(F.col("s_name"), 16, "supp_").alias("node_id"), F.substring(F.sha1("s_name"), 1, 12).alias("short_id"), F.sha2("s_name", 256).alias("cache_key")
    )


@query("""
WITH t AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '面议' WHEN 1 THEN p_size || '-' || (p_size + 5) || '千·13薪' WHEN 2 THEN (p_size * 10) || '元/天' WHEN 3 THEN p_size || '.5-' || (p_size + 2) || '万/年' WHEN 4 THEN p_size || 'K' ELSE '' END AS s FROM part)
SELECT p_partkey,
 CASE p_partkey % 6 WHEN 1 THEN (SELECT 1000.0) * p.p_size WHEN 2 THEN p.p_size * 10.0 WHEN 3 THEN (p.p_size + 0.5) * 10000 WHEN 4 THEN CAST(p.p_size AS DOUBLE) END AS low,
 CASE p_partkey % 6 WHEN 1 THEN 1000.0 * (p.p_size + 5) WHEN 2 THEN p.p_size * 10.0 WHEN 3 THEN (p.p_size + 2) * 10000.0 WHEN 4 THEN CAST(p.p_size AS DOUBLE) END AS high,
 CASE p_partkey % 6 WHEN 0 THEN 'negotiable' WHEN 1 THEN 'month' WHEN 2 THEN 'day' WHEN 3 THEN 'year' WHEN 4 THEN 'month' ELSE 'unknown' END AS unit,
 CASE p_partkey % 6 WHEN 1 THEN 13 ELSE 12 END AS months,
 CASE p_partkey % 6 WHEN 1 THEN 1000.0 * p.p_size WHEN 2 THEN round(p.p_size * 10.0 * 21.75, 2) WHEN 3 THEN round((p.p_size + 0.5) * 10000 / 12, 2) WHEN 4 THEN CAST(p.p_size AS DOUBLE) END AS month_low,
 CASE p_partkey % 6 WHEN 1 THEN 1000.0 * (p.p_size + 5) WHEN 2 THEN round(p.p_size * 10.0 * 21.75, 2) WHEN 3 THEN round((p.p_size + 2) * 10000.0 / 12, 2) WHEN 4 THEN CAST(p.p_size AS DOUBLE) END AS month_high,
 p_partkey % 6 = 0 AS negotiable
FROM part p JOIN t USING (p_partkey)
""")
def salary_parse(spark: SparkSession, d: str) -> DataFrame:
    n, k = F.col("p_size"), F.col("p_partkey") % 6
    s = (
        F.when(k == 0, "面议").when(k == 1, F.concat(n.cast("string"), F.lit("-"), (n + 5).cast("string"), F.lit("千·13薪"))).when(k == 2, F.concat((n * 10).cast("string"), F.lit("元/天")))
        .when(k == 3, F.concat(n.cast("string"), F.lit(".5-"), (n + 2).cast("string"), F.lit("万/年"))).when(k == 4, F.concat(n.cast("string"), F.lit("K"))).otherwise("")
    )
    return load(spark, d, "part").select("p_partkey", parse.salary(s).alias("s")).select("p_partkey", "s.*")


@query("""
SELECT p_partkey,
 CASE p_partkey % 5 WHEN 0 THEN p_size || '-' || (p_size + 50) || '人' WHEN 1 THEN p_size || '人以上' WHEN 2 THEN '少于' || p_size || '人' WHEN 3 THEN p_size || '人以下' ELSE '保密' END AS label,
 CASE p_partkey % 5 WHEN 0 THEN p_size WHEN 1 THEN p_size END AS low, CASE p_partkey % 5 WHEN 0 THEN p_size + 50 WHEN 2 THEN p_size WHEN 3 THEN p_size END AS high FROM part
""")
def company_size_parse(spark: SparkSession, d: str) -> DataFrame:
    n, k = F.col("p_size").cast("string"), F.col("p_partkey") % 5
    s = F.when(k == 0, F.concat(n, F.lit(" - "), (F.col("p_size") + 50).cast("string"), F.lit(" 人"))).when(k == 1, F.concat(n, F.lit("人以上"))).when(k == 2, F.concat(F.lit("少于 "), n, F.lit("人"))).when(k == 3, F.concat(n, F.lit("人以下"))).otherwise("保密")
    return load(spark, d, "part").select("p_partkey", parse.company_size(s).alias("s")).select("p_partkey", "s.*")


@query("""
SELECT o_orderkey, CASE o_orderkey % 4
  WHEN 2 THEN CASE WHEN make_date(2024, month(o_orderdate), least(day(o_orderdate), day(last_day(make_date(2024, month(o_orderdate), 1))))) > DATE '2024-06-15' + 30
      THEN make_date(2023, month(o_orderdate), least(day(o_orderdate), day(last_day(make_date(2023, month(o_orderdate), 1)))))
      ELSE make_date(2024, month(o_orderdate), least(day(o_orderdate), day(last_day(make_date(2024, month(o_orderdate), 1))))) END
  WHEN 3 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS posted FROM orders
""")
def date_standardize(spark: SparkSession, d: str) -> DataFrame:
    k, day = F.col("o_orderkey") % 4, F.col("o_orderdate")
    s = F.when(k == 0, F.date_format(day, "yyyy/M/d")).when(k == 1, F.date_format(day, "yyyy年M月d日")).when(k == 2, F.date_format(day, "M月d日")).otherwise("n/a")
    return load(spark, d, "orders").select("o_orderkey", parse.posted_date(s, "2024-06-15").alias("posted"))


@query("""
SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END, CASE WHEN o_custkey % 2 = 0 THEN b.p END, c.p) AS filled
FROM orders LEFT JOIN (SELECT o_custkey AS k, min(o_orderpriority) AS p FROM orders GROUP BY 1) b ON b.k = o_custkey AND o_custkey % 2 = 0
LEFT JOIN (SELECT o_orderstatus AS s, min(o_orderpriority) AS p FROM orders GROUP BY 1) c ON c.s = o_orderstatus
""")
def backfill_keys(spark: SparkSession, d: str) -> DataFrame:
    orders = load(spark, d, "orders")
    known = orders.select("o_custkey", "o_orderstatus", F.col("o_orderpriority").alias("filled"))
    blank = orders.withColumn("filled", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")))
    return titles.backfilled(blank, "filled", [(known.filter("o_custkey % 2 = 0"), "o_custkey"), (known, "o_orderstatus")]).select("o_orderkey", "filled")


@query("""
SELECT DISTINCT p_brand, p_type FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)
EXCEPT SELECT p_brand, p_type FROM part WHERE p_size > 45
""")
def semi_anti_gap(spark: SparkSession, d: str) -> DataFrame:
    part, big = load(spark, d, "part"), load(spark, d, "lineitem").filter("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return path.gaps(part.join(big, "p_partkey", "left_anti"), part.filter("p_size > 45"), ["p_brand"], "p_type")


@query("""
SELECT o.o_orderkey, c.c_name, n.n_name AS city, o.o_totalprice AS salary_max FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey
WHERE n.n_name ILIKE '%nation_1%' AND o.o_totalprice >= 200000 ORDER BY o.o_totalprice DESC, o.o_orderkey LIMIT 15
""")
def market_view_filter(spark: SparkSession, d: str) -> DataFrame:
    orders, customer, nation = (load(spark, d, t) for t in ("orders", "customer", "nation"))
    people = customer.join(nation, F.col("n_nationkey") == F.col("c_nationkey"), "left").select(F.col("c_custkey").alias("o_custkey"), "c_name", F.col("n_name").alias("city"))
    detail = orders.select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("string").alias("salary_max"), F.lit(None).cast("string").alias("salary_month_max"))
    view = sqlapi.market_view(detail, people, key="o_custkey").filter("c_name is not null")
    found = view.filter(sqlapi.rule_filter(city="nation_1", salary_floor=200000))
    return found.orderBy(F.desc("salary_max"), "o_orderkey").limit(sqlapi.MAX_ROWS).select("o_orderkey", "c_name", "city", "salary_max")


@query("SELECT p_brand, count(*) AS n, round(avg(p_retailprice), 2) AS mean_price FROM part WHERE p_type ILIKE '%standard%' GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 15")
def guarded_sql(spark: SparkSession, d: str) -> DataFrame:
    load(spark, d, "part").createOrReplaceTempView("jobs")
    return sqlapi.guarded(spark, "SELECT p_brand, count(*) AS n, round(avg(p_retailprice), 2) AS mean_price FROM jobs WHERE p_type ILIKE '%standard%' GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 50")


@query("""
SELECT p_partkey, p_name FROM part WHERE CASE WHEN EXISTS (SELECT 1 FROM part WHERE lower(p_name) = 'blue') THEN lower(p_name) = 'blue' ELSE p_name ILIKE '%blue%' END
""")
def exact_then_like(spark: SparkSession, d: str) -> DataFrame:
    return sqlapi.exact_then_like(load(spark, d, "part").select("p_partkey", "p_name"), "p_name", "blue", [F.asc("p_partkey")])


@query("""
WITH x AS (SELECT o_orderkey AS k, CASE WHEN o_custkey % 5 = 0 THEN ' ' ELSE 'C' || o_custkey END AS company, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderpriority END AS city, CASE o_orderkey % 4 WHEN 0 THEN o_orderstatus || '、' || o_orderpriority WHEN 1 THEN '["' || o_orderstatus || '"]' WHEN 2 THEN o_orderstatus || '/' || o_orderstatus ELSE '' END AS industry,
  CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS a, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice + 1 END AS b, CASE WHEN o_orderkey % 5 = 0 THEN -o_totalprice END AS c, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice / 2 END AS d FROM orders),
p AS (SELECT unnest([a, b, c, d]) AS v FROM x), l AS (SELECT k, unnest(CASE k % 4 WHEN 0 THEN [s, y] WHEN 1 THEN ['["' || s || '"]'] WHEN 3 THEN [] ELSE [s] END) AS name, generate_subscripts(CASE k % 4 WHEN 0 THEN [s, y] WHEN 3 THEN [] ELSE [s] END, 1) AS i FROM (SELECT o_orderkey AS k, o_orderstatus AS s, o_orderpriority AS y FROM orders)),
t AS (SELECT name, count(*) AS n, min(k * 2 + i) AS at_ FROM l GROUP BY 1 ORDER BY 2 DESC, 3 LIMIT 5)
SELECT (SELECT count(DISTINCT company) FROM x WHERE company <> ' ') AS company_count, (SELECT count(*) FROM x) AS job_count, (SELECT city FROM x WHERE city IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, min(k) LIMIT 1) AS top_city,
  (SELECT min(v) FROM p WHERE v > 0) AS salary_min, (SELECT max(v) FROM p WHERE v > 0) AS salary_max, (SELECT string_agg(name || '=' || n, '|' ORDER BY n DESC, at_) FROM t) AS industries
""")
def result_summary(spark: SparkSession, d: str) -> DataFrame:
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    form = k % 4
    industry = F.when(form == 0, F.concat_ws("、", "o_orderstatus", "o_orderpriority")).when(form == 1, F.concat(F.lit('["'), "o_orderstatus", F.lit('"]'))).when(form == 2, F.concat_ws("/", "o_orderstatus", "o_orderstatus")).otherwise("")
    rows = load(spark, d, "orders").select(
        k.alias("k"), F.when(F.col("o_custkey") % 5 == 0, " ").otherwise(F.concat(F.lit("C"), F.col("o_custkey").cast("string"))).alias("company_name"), F.when(k % 9 != 0, F.col("o_orderpriority")).alias("city"), industry.alias("industry"),
        F.when(k % 2 == 0, price).alias("salary_month_min"), F.when(k % 3 == 0, price + 1).alias("salary_month_max"), F.when(k % 5 == 0, -price).alias("salary_min"), F.when(k % 7 == 0, price / 2).cast("string").alias("salary_max"),
    )
    listed = F.array_join(F.transform("top_industries", lambda x: F.concat_ws("=", x["name"], x["count"].cast("string"))), "|")
    return sqlapi.summary(rows, "k").withColumn("industries", listed).drop("top_industries")


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY lower(c_mktsegment || CAST(c_nationkey % 4 AS VARCHAR)) ORDER BY c_acctbal DESC, c_custkey) AS n FROM customer)
SELECT c_custkey, c_mktsegment, c_acctbal FROM r WHERE n = 1 ORDER BY c_acctbal DESC, c_custkey LIMIT 8
""")
def company_cards(spark: SparkSession, d: str) -> DataFrame:
    key = F.concat("c_mktsegment", (F.col("c_nationkey") % 4).cast("string"))
    return sqlapi.cards(load(spark, d, "customer"), key, [F.desc("c_acctbal"), F.asc("c_custkey")]).select("c_custkey", "c_mktsegment", "c_acctbal")


def _supplier_edges(spark: SparkSession, d: str) -> DataFrame:
    part = load(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return load(spark, d, "lineitem").select("l_suppkey", "l_partkey").join(part, "l_partkey").select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("supplier"), "p_brand")


@query("""
SELECT 'job_' || substr(md5('S' || l_suppkey), 1, 16) AS start, 'brand_' || substr(md5(p_brand), 1, 16) AS "end", count(*) AS weight, 'SUPPLIES' AS kind
FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2
""")
def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.edges(_supplier_edges(spark, d), F.col("supplier"), F.array("p_brand"), "job_", "brand_", "SUPPLIES")


@query("""
SELECT 'S' || l_suppkey AS source_job, string_agg(DISTINCT p_type, '|' ORDER BY p_type) AS targets, count(DISTINCT p_type) AS edge_count
FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1 ORDER BY edge_count DESC, source_job LIMIT 10
""")
def representative_paths(spark: SparkSession, d: str) -> DataFrame:
    part = load(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("target_job"))
    named = load(spark, d, "lineitem").join(part, "l_partkey").select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("source_job"), "target_job", F.lit("PROMOTE_TO").alias("kind"))
    return graph.representative_paths(named, n=10).withColumn("targets", F.array_join("targets", "|"))


@query("""
WITH o AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS n FROM o)
SELECT c_custkey, coalesce(string_agg(o_orderpriority, '|' ORDER BY o_orderpriority) FILTER (WHERE n <= 3), '') AS related FROM customer LEFT JOIN r ON o_custkey = c_custkey GROUP BY c_custkey
""")
def optional_neighbours(spark: SparkSession, d: str) -> DataFrame:
    orders = load(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority")
    got = graph.neighbours(load(spark, d, "customer").select("c_custkey"), "c_custkey", orders, "o_orderpriority", "related", 3)
    return got.select("c_custkey", F.array_join("related", "|").alias("related"))


@query("""
WITH e AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS t FROM lineitem), k AS (SELECT * FROM e WHERE s <> t)
SELECT CAST(n AS VARCHAR) AS name, count(*) AS degree FROM (SELECT s AS n FROM k UNION ALL SELECT t FROM k) GROUP BY n
""")
def connected_graph(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers and parts under one set of ids, with loops, repeated edges and names without any edge; all lines."""
    name = lambda c: F.col(c).cast("string")
    rows = load(spark, d, "lineitem").select(name("l_suppkey").alias("start"), name("l_partkey").alias("end"), F.lit("LINK").alias("kind"))
    names = load(spark, d, "part").select(name("p_partkey").alias("id")).union(load(spark, d, "customer").select(name("c_custkey"))).union(rows.select("start")).distinct()
    v, e = graph.normalized(names, rows)
    ends = e.select(F.explode(F.array("start", "end")).alias("id"))
    return v.join(ends.groupBy("id").agg(F.count("*").alias("degree")), "id").select(F.col("id").alias("name"), "degree")


_NAMED = """
e AS (SELECT DISTINCT l_suppkey AS s, l_partkey % 7 AS m, l_linenumber AS n FROM lineitem),
j AS (SELECT DISTINCT ['Java开发', 'Web前端', '销售经理', 'java', '数据分析师', '测试工程师', '储备经理人'][s % 7 + 1] || CASE WHEN s % 3 = 0 THEN '' ELSE CAST(s % 3 AS VARCHAR) END AS source_job, ['产品经理', 'java', '算法工程师', '运维工程师', '客服', 'VP', 'Java开发'][m + 1] AS target_job, CASE WHEN n % 2 = 0 THEN 'PROMOTE_TO' ELSE 'TRANSFER_TO' END AS kind FROM e)
"""


def _named_edges(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda at, *words: F.get(F.array(*[F.lit(w) for w in words]), at.cast("int"))
    s, n = F.col("l_suppkey"), F.col("l_linenumber")
    source = F.concat(pick(s % 7, "Java开发", "Web前端", "销售经理", "java", "数据分析师", "测试工程师", "储备经理人"), F.when(s % 3 == 0, "").otherwise((s % 3).cast("string")))
    target = pick(F.col("l_partkey") % 7, "产品经理", "java", "算法工程师", "运维工程师", "客服", "VP", "Java开发")
    return load(spark, d, "lineitem").select(source.alias("source_job"), target.alias("target_job"), F.when(n % 2 == 0, "PROMOTE_TO").otherwise("TRANSFER_TO").alias("kind")).distinct()


@query(f"""
WITH {_NAMED},
w AS (SELECT unnest(['JAVA', '经理', '工程']) AS k),
h AS (SELECT k, j.*, row_number() OVER (PARTITION BY k ORDER BY source_job, target_job, kind) AS r FROM w, j WHERE contains(lower(source_job), lower(k)) OR contains(lower(target_job), lower(k)))
SELECT source_job, target_job, kind, count(*) + CASE WHEN kind = 'PROMOTE_TO' THEN 2 ELSE 0 END AS score FROM h WHERE r <= 10 GROUP BY source_job, target_job, kind ORDER BY score DESC, source_job, target_job, kind LIMIT 8
""")
def edge_search(spark: SparkSession, d: str) -> DataFrame:
    return graph.search(_named_edges(spark, d), ["JAVA", "经理", "工程"]).withColumn("score", F.col("score").cast("long"))


@query(f"""
WITH {_NAMED},
v AS (SELECT source_job AS name FROM j UNION SELECT target_job FROM j), d AS (SELECT name, CASE name WHEN 'java' THEN 'Java开发工程师' WHEN 'JAVA' THEN 'Java开发工程师' WHEN 'Java' THEN 'Java开发工程师' ELSE name END AS shown FROM v)
SELECT a.name AS source_name, b.name AS target_name, j.kind FROM j JOIN d a ON a.name = j.source_job JOIN d b ON b.name = j.target_job WHERE a.name <> '客服' AND b.name <> '客服'
""")
def edge_endpoints(spark: SparkSession, d: str) -> DataFrame:
    """Edges by ids joined with the names of both ends; those whose end has no vertex are left out."""
    named = _named_edges(spark, d)
    key = lambda c: F.md5(F.col(c))
    names = named.select(F.col("source_job").alias("name")).union(named.select("target_job")).distinct().filter("name <> '客服'")
    edges = named.select(key("source_job").alias("start"), key("target_job").alias("end"), "kind")
    return graph.resolved(edges, names.select(key("name").alias("id"), "name")).select(F.col("source_job").alias("source_name"), F.col("target_job").alias("target_name"), "kind")


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS s, CAST(l_partkey AS VARCHAR) AS t FROM lineitem),
r AS (SELECT '1' AS id, 0 AS hops UNION SELECT t, hops + 1 FROM r JOIN e ON e.s = r.id WHERE hops < 3)
SELECT id, min(hops) AS hops FROM r GROUP BY id
""")
def reachable_hops(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("start"), F.col("l_partkey").cast("string").alias("end")).distinct()
    return graph.reachable(e, ["1"], 3)


@query("""
WITH s AS (SELECT c_custkey, c_nationkey % 6 AS have, c_mktsegment AS major FROM customer),
j AS (SELECT p_type AS job, count(*) AS n, CAST(max(p_size) % 6 AS INTEGER) AS need FROM part GROUP BY p_type),
x AS (SELECT c_custkey, job, CASE WHEN need <= 0 THEN 100.0 WHEN have <= 0 THEN 0.0 WHEN have >= need THEN 100.0 WHEN have = need - 1 THEN 60.0 ELSE 20.0 END::DOUBLE AS degree, n FROM s CROSS JOIN j),
y AS (SELECT c_custkey, job, degree, round(greatest(0, least(100, 45.0 * (degree / 100.0) / 3 + 45.0 * 0.5 + 10.0 * least(n / 100.0, 1.0))), 2) AS score FROM x),
z AS (SELECT *, CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY score DESC, job) AS INTEGER) AS rank FROM y)
SELECT c_custkey, job, degree, score, rank FROM z WHERE rank <= 5
""")
def student_job_ranking(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    students = load(spark, d, "customer").select("c_custkey", (F.col("c_nationkey") % 6).alias("have"))
    jobs = load(spark, d, "part").groupBy(F.col("p_type").alias("job")).agg(F.count("*").alias("n"), (F.max("p_size") % 6).alias("need"))
    pairs = match.with_jobs(students, jobs)
    degree = match.degree_score(F.col("have"), F.col("need"))
    scored = pairs.withColumn("degree", degree).withColumn("score", match.asset_score(F.col("degree") / 100, F.lit(0.5), F.col("n"), F.lit(0)))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("c_custkey").orderBy(F.desc("score"), "job"))).filter("rank <= 5").select("c_custkey", "job", "degree", "score", "rank")


@query("""
WITH dims(dimension, w) AS (VALUES ('professional_skill', 0.25), ('certificate', 0.10), ('innovation', 0.10), ('learning', 0.15), ('pressure_resistance', 0.10), ('communication', 0.15), ('internship_practice', 0.15)),
x AS (SELECT c_custkey, dimension, w, (c_custkey * 7 + c_nationkey * 3 + length(dimension) * 13) % 100 - length(dimension) * 17 % 60 AS gap FROM customer CROSS JOIN dims),
y AS (SELECT *, CASE WHEN gap >= -10 THEN 1.0 WHEN gap >= -25 THEN 0.5 ELSE 0.0 END AS p FROM x)
SELECT c_custkey, round(sum(w * p) / sum(w) * 100, 2) AS ability_score, CASE WHEN min(p) = 0 THEN 'no_match' WHEN min(p) = 0.5 THEN 'risk' ELSE 'match' END AS ability_status, count(*) FILTER (WHERE p = 0) AS gaps FROM y GROUP BY c_custkey
""")
def ability_gap(spark: SparkSession, d: str) -> DataFrame:
    from ..functions import vocab

    dims = F.explode(F.array(*[F.lit(k) for k, _, _ in vocab.ABILITY_DIMENSIONS])).alias("dimension")
    base = load(spark, d, "customer").select("c_custkey", "c_nationkey", dims)
    have = (F.col("c_custkey") * 7 + F.col("c_nationkey") * 3 + F.length("dimension") * 13) % 100
    need = spark.createDataFrame([(k, len(k) * 17 % 60) for k, _, _ in vocab.ABILITY_DIMENSIONS], "dimension string, score int")
    return match.ability_gaps(base.select("c_custkey", "dimension", have.alias("score")), need, ["c_custkey"])


_STUDENT = """
SELECT c_custkey, c_custkey % 8 AS basic, c_custkey % 5 AS edu, c_custkey % 11 AS hard, c_custkey % 6 AS tools, c_custkey % 3 AS projects, c_nationkey % 3 AS internships, c_nationkey % 5 AS certs, c_custkey % 4 AS awards,
 c_nationkey % 2 = 0 AS target, c_custkey % 3 = 0 AS hints, c_nationkey % 7 AS domains, ['博士', '硕士研究生', '本科', '大专', '专科', '高中', ''][c_nationkey % 7 + 1] AS degree, c_custkey % 9 <> 0 AS major,
 c_custkey % 13 = 0 AS modelling, c_custkey % 17 = 0 AS engineering, c_custkey % 19 = 0 AS business FROM customer
"""


@query(f"""
WITH x AS ({_STUDENT}),
y AS (SELECT c_custkey, round(least(100, greatest(0, round(20.0 * least(basic, 7) / 7, 2) + round(15.0 * least(edu, 4) / 4, 2) + CASE WHEN hard + tools >= 8 THEN 20 WHEN hard + tools >= 5 THEN 16 WHEN hard + tools >= 3 THEN 12 WHEN hard + tools >= 1 THEN 8 ELSE 0 END
  + CASE WHEN projects >= 2 THEN 15 WHEN projects = 1 THEN 12 ELSE 0 END + CASE WHEN internships >= 2 THEN 15 WHEN internships = 1 THEN 12 ELSE 0 END + CASE WHEN awards >= 1 THEN 10 ELSE 0 END + CASE WHEN target AND hints THEN 5 WHEN target OR hints THEN 3 ELSE 0 END))::DOUBLE, 2) AS completeness,
 round(least(100, least(20.0, CASE degree WHEN '博士' THEN 18 WHEN '硕士研究生' THEN 16 WHEN '本科' THEN 13 WHEN '大专' THEN 10 WHEN '专科' THEN 10 WHEN '高中' THEN 6 ELSE 0 END + CASE WHEN major THEN 2 ELSE 0 END)
  + least(25.0, hard * 4.0) + least(10.0, tools * 2.5) + least(15.0, least(15.0, projects * 8.0) + CASE WHEN modelling THEN 2 ELSE 0 END + CASE WHEN engineering THEN 2 ELSE 0 END)
  + least(20.0, least(20.0, internships * 10.0) + CASE WHEN business THEN 2 ELSE 0 END) + least(10.0, certs * 4.0 + awards * 3.0) + CASE WHEN target AND hints THEN 5 WHEN hints THEN 3 ELSE 0 END + least(10.0, domains * 2.0))::DOUBLE, 2) AS competitiveness FROM x)
SELECT *, CASE WHEN competitiveness >= 85 THEN 'A' WHEN competitiveness >= 70 THEN 'B' WHEN competitiveness >= 55 THEN 'C' ELSE 'D' END AS band,
 CASE WHEN competitiveness >= 75 THEN 'high' WHEN competitiveness >= 55 THEN 'medium_high' WHEN competitiveness >= 35 THEN 'medium' ELSE 'low' END AS level FROM y
""")
def profile_scores(spark: SparkSession, d: str) -> DataFrame:
    x = _students(load(spark, d, "customer"))
    c = F.col
    full = student.completeness(F.least(c("basic"), F.lit(7)) / 7, F.least(c("edu"), F.lit(4)) / 4, c("hard") + c("tools"), c("projects"), c("internships"), c("awards"), c("target"), c("hints"))
    strong = student.competitiveness(c("degree"), c("major"), *[c(n) for n in ("hard", "tools", "projects", "internships", "certs", "awards", "target", "hints", "domains", "tags")])
    return x.select("c_custkey", full.alias("completeness"), strong.alias("competitiveness")).withColumns({"band": student.band(F.col("competitiveness")), "level": student.level(F.col("competitiveness"))})


def _students(customer: DataFrame) -> DataFrame:
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    degrees = F.array(*[F.lit(x) for x in ("博士", "硕士研究生", "本科", "大专", "专科", "高中", "")])
    tags = F.array_compact(F.array(F.when(k % 13 == 0, "项目:建模算法"), F.when(k % 17 == 0, "项目:工程开发"), F.when(k % 19 == 0, "实习:业务协作")))
    return customer.select(
        "c_custkey", (k % 8).alias("basic"), (k % 5).alias("edu"), (k % 11).alias("hard"), (k % 6).alias("tools"), (k % 3).alias("projects"), (n % 3).alias("internships"), (n % 5).alias("certs"), (k % 4).alias("awards"),
        (n % 2 == 0).alias("target"), (k % 3 == 0).alias("hints"), (n % 7).alias("domains"), F.get(degrees, n % 7).alias("degree"), F.when(k % 9 != 0, "x").otherwise("").alias("major"), tags.alias("tags"),
    )


@query(f"""
WITH x AS (SELECT *, CASE c_custkey % 4 WHEN 0 THEN '学习与创新' WHEN 1 THEN '抗压 沟通' WHEN 2 THEN '表达' ELSE '' END AS t FROM ({_STUDENT})),
s AS (SELECT c_custkey, hard * 8.0 + tools * 6.0 AS professional_skill, certs * 30.0 AS certificate, projects * 18.0 + CASE WHEN contains(t, '创新') THEN 18 ELSE 0 END AS innovation, 35.0 + hard * 4.0 + tools * 3.0 + CASE WHEN contains(t, '学习') THEN 12 ELSE 0 END AS learning,
 internships * 22.0 + projects * 14.0 + CASE WHEN contains(t, '抗压') THEN 16 ELSE 0 END AS pressure_resistance, internships * 24.0 + projects * 10.0 + CASE WHEN contains(t, '沟通') OR contains(t, '表达') THEN 18 ELSE 0 END AS communication, internships * 40.0 + projects * 10.0 AS internship_practice FROM x),
l AS (UNPIVOT s ON COLUMNS(* EXCLUDE c_custkey) INTO NAME dimension VALUE score)
SELECT c_custkey, dimension, least(100.0, score)::DOUBLE AS score FROM l
""")
def ability_without_profile(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey") % 4
    traits = F.when(k == 0, "学习与创新").when(k == 1, "抗压 沟通").when(k == 2, "表达").otherwise("")
    scores = student.ability_fallback(*[F.col(c) for c in ("hard", "tools", "certs", "internships", "projects")], traits)
    return _students(load(spark, d, "customer")).select("c_custkey", F.explode(scores).alias("dimension", "score"))


@query("""
WITH x AS (SELECT c_custkey, ['项目经验', '可实习', '能出差', '沟通能力强', '客户拜访', '实习3个月以上', '客户接待'][c_custkey % 7 + 1] AS a, ['跨部门协作', '', '驻场', '项目经验'][c_custkey % 4 + 1] AS b, c_custkey % 3 AS projects, c_custkey % 2 AS internships, c_nationkey % 2 = 0 AS travels, c_nationkey % 3 = 0 AS talks FROM customer),
y AS (SELECT *, list_filter(list_distinct([a, b]), lambda v: v <> '') AS w FROM x),
z AS (SELECT *, list_filter(w, lambda r: CASE WHEN contains(r, '可实习') THEN true WHEN contains(r, '项目') THEN projects > 0 WHEN contains(r, '实习') THEN internships > 0 WHEN contains(r, '出差') OR contains(r, '驻场') THEN travels WHEN contains(r, '协作') OR contains(r, '沟通') THEN talks ELSE r = '客户拜访' END) AS met FROM y)
SELECT c_custkey, len(w) AS wanted, CASE WHEN len(w) = 0 THEN 100.0 ELSE round(len(met) / len(w) * 100, 2) END::DOUBLE AS score FROM z
""")
def practice_score(spark: SparkSession, d: str) -> DataFrame:
    """Of the two requirements without a rule one equals an experience tag; the other shares half of its letters: .5 of the .65 asked for."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    words = lambda *w: F.array(*[F.lit(x) for x in w])
    a = F.get(words("项目经验", "可实习", "能出差", "沟通能力强", "客户拜访", "实习3个月以上", "客户接待"), (k % 7).cast("int"))
    b = F.get(words("跨部门协作", "", "驻场", "项目经验"), (k % 4).cast("int"))
    tags = F.array_compact(F.array(F.lit("客户拜访"), F.when(n % 2 == 0, "愿意出差")))
    tags = F.when(n % 2 == 0, F.array_union(tags, words("驻场半年"))).otherwise(tags)
    soft = F.when(n % 3 == 0, words("团队合作")).otherwise(words("学习能力"))
    wanted = F.array(a, b)
    score = match.practice_score(wanted, tags, k % 3, k % 2, soft)
    size = F.size(F.filter(F.array_distinct(wanted), lambda w: w != "")).cast("long")
    return load(spark, d, "customer").select("c_custkey", size.alias("wanted"), score.alias("score"))


@query("""
WITH x AS (SELECT s_suppkey, CASE WHEN s_suppkey % 10 <> 0 THEN s_acctbal / 100 END AS ts, CASE WHEN s_suppkey % 7 <> 0 THEN s_acctbal / 100 + s_nationkey * 2 - 15 END AS os,
 (s_suppkey % 11) / 10.0 AS ta, (s_suppkey % 13) / 10.0 AS oa, s_suppkey % 3 = 0 AS tp, s_suppkey % 2 = 0 AS op FROM supplier)
SELECT s_suppkey, CASE WHEN ts IS NULL AND os IS NULL THEN 'none' WHEN ts IS NULL THEN 'switch' WHEN os IS NULL THEN 'keep_target'
 WHEN NOT tp AND op AND os - ts >= 10 AND oa - ta > 0 THEN 'switch' WHEN tp AND op AND os - ts >= 20 AND oa - ta >= 0.25 THEN 'switch' ELSE 'keep_target' END AS decision FROM x
""")
def goal_decision(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    ts = F.when(k % 10 != 0, F.col("s_acctbal") / 100)
    os = F.when(k % 7 != 0, F.col("s_acctbal") / 100 + F.col("s_nationkey") * 2 - 15)
    return load(spark, d, "supplier").select("s_suppkey", path.goal_decision(ts, os, (k % 11) / 10, (k % 13) / 10, k % 3 == 0, k % 2 == 0).alias("decision"))


@query("""
WITH x AS (SELECT o_custkey, o_orderkey, o_orderkey % 60 + CASE o_orderstatus WHEN 'F' THEN 10 WHEN 'O' THEN 4 ELSE -12 END + CASE WHEN o_orderpriority LIKE '1%' THEN 5 ELSE 0 END + CASE WHEN o_orderkey % 2 = 0 THEN 6 ELSE 0 END + CASE o_orderkey % 3 WHEN 0 THEN 4 WHEN 1 THEN 2 ELSE 0 END AS score FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, o_orderkey) AS n FROM x)
SELECT o_custkey, o_orderkey, score, CASE WHEN score >= 80 THEN 'direct' WHEN score >= 70 THEN 'steady' ELSE 'bridge' END AS strategy FROM r WHERE n = 1
""")
def path_choice(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    source = F.when(F.col("o_orderstatus") == "F", "graph").when(F.col("o_orderstatus") == "O", "offline").otherwise("fallback")
    kind = F.when(k % 3 == 0, "direct").when(k % 3 == 1, "transfer").otherwise("other")
    score = path.option_score(k % 60, source, F.when(F.col("o_orderpriority").startswith("1"), "high").otherwise("low"), k % 2 == 0, kind)
    best = path.best_options(load(spark, d, "orders").withColumn("score", score), "o_custkey", "score", "o_orderkey")
    return best.select("o_custkey", "o_orderkey", "score", path.strategy(F.col("score")).alias("strategy"))


@query("""
WITH x AS (SELECT p_partkey, p_size, ['graph', 'offline', 'fallback', NULL][p_partkey % 4 + 1] AS direct, ['graph', 'offline', 'fallback', NULL][p_partkey % 5 + 1] AS transition, p_partkey % 2 = 0 AS tgt, p_partkey % 9 = 0 AS hint, p_partkey % 3 = 0 AS growing FROM part)
SELECT p_partkey, round(least(100.0, 50 + CASE WHEN tgt THEN 0.45 ELSE 0.20 END * p_size + CASE direct WHEN 'graph' THEN 14 WHEN 'offline' THEN 10 WHEN 'fallback' THEN 4 ELSE 0 END + CASE transition WHEN 'graph' THEN 10 WHEN 'offline' THEN 7 WHEN 'fallback' THEN 2 ELSE 0 END
 + CASE WHEN hint THEN 10 ELSE 0 END + CASE WHEN growing AND tgt THEN 5 ELSE 0 END)::DOUBLE, 2) AS goal_score FROM x
""")
def candidate_goal_score(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    tier = lambda n: F.get(F.array(F.lit("graph"), F.lit("offline"), F.lit("fallback"), F.lit(None)), (k % n).cast("int"))
    return load(spark, d, "part").select("p_partkey", path.goal_score(F.col("p_size"), k % 2 == 0, tier(4), tier(5), k % 9 == 0, k % 3 == 0).alias("goal_score"))


@query("""
WITH x AS (SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_name END AS nm, c_acctbal FROM customer)
SELECT c_custkey, CAST((CASE WHEN trim(nm) <> '' THEN 1 ELSE 0 END) + 1 + 1 AS INTEGER) AS completeness,
 concat_ws(',', CASE WHEN nm = '' THEN 'missing_name' END, CASE WHEN c_acctbal < 0 THEN 'negative_balance' END, CASE WHEN length(c_mktsegment) < 9 THEN 'short_segment' END) AS reasons FROM x
""")
def completeness_and_anomalies(spark: SparkSession, d: str) -> DataFrame:
    x = load(spark, d, "customer").withColumn("nm", F.when(F.col("c_custkey") % 4 == 0, "").otherwise(F.col("c_name")))
    flags = [("missing_name", F.col("nm") == ""), ("negative_balance", F.col("c_acctbal") < 0), ("short_segment", F.length("c_mktsegment") < 9)]
    return x.select("c_custkey", clean.completeness([F.col("nm"), F.col("c_mktsegment"), F.col("c_acctbal")]).alias("completeness"), clean.anomalies(flags).alias("reasons"))


@query("""
WITH a AS (SELECT p_partkey, lower(replace(p_name, ' ', '')) AS t, p_name FROM part)
SELECT p_partkey, CASE WHEN t LIKE '%red%' THEN 'warm' WHEN t LIKE '%blue%' OR t LIKE '%green%' THEN 'cool' ELSE p_name END AS family FROM a
""")
def alias_normalize(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "part").select("p_partkey", text.alias_normalized(F.col("p_name"), {"warm": ["red"], "cool": ["blue", "green"]}).alias("family"))


@query("SELECT p_brand, count(*) AS cluster_size, p_partkey FROM part JOIN (SELECT p_brand, p_partkey AS k FROM part) x USING (p_brand) GROUP BY p_brand, p_partkey")
def group_size_on_rows(spark: SparkSession, d: str) -> DataFrame:
    return titles.with_group_size(load(spark, d, "part"), "p_brand").select("p_brand", "cluster_size", "p_partkey")


@query("""
SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events WHERE value >= 10 GROUP BY ALL
""")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    from ..streaming.filters import windowed_counts

    return windowed_counts(load(spark, d, "events").filter("value >= 10"), "ts", "event_type", "value").withColumn("total", F.round("total", 2))


@query("""
WITH n AS (SELECT o_custkey AS k, o_orderkey, o_totalprice AS p FROM orders), o AS (SELECT * FROM n WHERE o_orderkey % 2 = 0), w AS (SELECT k, o_orderkey, p * 2 AS p FROM n WHERE o_orderkey % 3 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY o_orderkey) AS i FROM w), u AS (SELECT k, o_orderkey, p FROM r WHERE i = 1)
SELECT k, o_orderkey, p FROM o WHERE k NOT IN (SELECT k FROM u) UNION ALL SELECT * FROM u
""")
def keyed_upsert(spark: SparkSession, d: str) -> DataFrame:
    from ..sources import writers

    n = load(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", F.col("o_totalprice").alias("p"))
    new = writers.keyed(n.filter("o_orderkey % 3 = 0").withColumn("p", F.col("p") * 2), "k", [F.asc("o_orderkey")])
    return writers.upserted(n.filter("o_orderkey % 2 = 0"), new, "k")


@query("""
SELECT doc_id, source, quality IS NOT NULL AS labelled FROM documents LEFT JOIN labels USING (doc_id)
""")
def asset_left_join(spark: SparkSession, d: str) -> DataFrame:
    labels = load(spark, d, "labels")
    return load(spark, d, "documents").select("doc_id", "source").join(labels.select("doc_id", "quality"), "doc_id", "left").select("doc_id", "source", F.col("quality").isNotNull().alias("labelled"))


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n, CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice END AS lo, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice + 100 END AS hi FROM orders)
SELECT o_custkey, round(coalesce(avg(lo), 0), 4) AS min_avg, round(coalesce(avg(hi), 0), 4) AS max_avg, round(coalesce(avg((lo + hi) / 2), 0), 4) AS mid_avg, count(*) AS samples FROM r WHERE n <= 5 GROUP BY o_custkey
""")
def compact_salary(spark: SparkSession, d: str) -> DataFrame:
    low, high = F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice")), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice") + 100)
    return stats.compact_salary(load(spark, d, "orders"), ["o_custkey"], low, high, [F.desc("o_orderdate"), F.asc("o_orderkey")], digits=4)


@query("SELECT p_name, count(*) AS count FROM part WHERE trim(p_name) <> '' GROUP BY p_name ORDER BY count DESC, p_name LIMIT 20")
def top_names(spark: SparkSession, d: str) -> DataFrame:
    return stats.top_names(load(spark, d, "part"), "p_name")


@query("SELECT p_partkey, p_brand, p_type FROM part WHERE CASE WHEN EXISTS (SELECT 1 FROM part WHERE trim(p_brand) = 'ECONOMY') THEN trim(p_brand) = 'ECONOMY' ELSE trim(split_part(p_type, ' ', 1)) = 'ECONOMY' END")
def group_with_fallback(spark: SparkSession, d: str) -> DataFrame:
    part = load(spark, d, "part").withColumn("kind", F.split_part("p_type", F.lit(" "), F.lit(1)))
    return stats.group_rows(part, "ECONOMY", "p_brand", "kind").select("p_partkey", "p_brand", "p_type")


@query("""
WITH r AS (SELECT source, doc_id, length(coalesce(text, '')) AS chars, CAST(row_number() OVER (PARTITION BY source ORDER BY length(coalesce(text, '')) DESC, doc_id) AS INTEGER) AS position FROM documents)
SELECT source, doc_id, chars, position FROM r WHERE position <= 5
""")
def longest_samples(spark: SparkSession, d: str) -> DataFrame:
    found = stats.longest(load(spark, d, "documents"), ["source"], "text", [F.asc("doc_id")])
    return found.select("source", "doc_id", F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("chars"), "position")


@query("""
WITH x AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'job_' || c_custkey WHEN 1 THEN substr(md5(c_name), 1, 12) WHEN 2 THEN CAST(c_custkey AS VARCHAR) WHEN 3 THEN c_name ELSE ' n/a ' END AS name FROM customer)
SELECT c_custkey, c_custkey % 5 = 3 AS valid FROM x
""")
def valid_job_name(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    name = F.when(k % 5 == 0, F.concat(F.lit("job_"), k.cast("string"))).when(k % 5 == 1, F.substring(F.md5("c_name"), 1, 12)).when(k % 5 == 2, k.cast("string")).when(k % 5 == 3, F.col("c_name")).otherwise(" n/a ")
    return load(spark, d, "customer").select("c_custkey", parse.is_job_name(name).alias("valid"))


@query("""
WITH x AS (SELECT p_partkey, lower(p_name || ' ' || array_to_string(list_filter([CASE WHEN p_size % 3 = 0 THEN 'Spark' END, CASE WHEN p_size % 5 = 0 THEN 'Excel' END, CASE WHEN p_size % 7 = 0 THEN 'Python' END], lambda v: v IS NOT NULL), ' ') || ' ' || CASE WHEN p_size % 4 = 0 THEN '沟通协作' ELSE '' END) AS t FROM part)
SELECT p_partkey, array_to_string(list_filter([CASE WHEN t SIMILAR TO '(?s).*(数据分析|sql|excel|tableau|power bi|a/b测试).*' THEN '数据分析' END, CASE WHEN t SIMILAR TO '(?s).*(机器学习|深度学习|nlp|推荐系统|python|pytorch|tensorflow).*' THEN '人工智能' END,
 CASE WHEN t SIMILAR TO '(?s).*(spark|hadoop|hive|flink|kafka|sql).*' THEN '大数据工程' END, CASE WHEN t SIMILAR TO '(?s).*(java|python|c[+][+]|git|docker|kubernetes|redis).*' THEN '软件开发' END, CASE WHEN t SIMILAR TO '(?s).*(数据分析|a/b测试|excel|power bi|沟通协作).*' THEN '商业分析' END], lambda v: v IS NOT NULL), '|') AS domains FROM x
""")
def domain_tags(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_size")
    skills = F.array_compact(F.array(F.when(n % 3 == 0, "Spark"), F.when(n % 5 == 0, "Excel"), F.when(n % 7 == 0, "Python")))
    soft = F.when(n % 4 == 0, F.array(F.lit("沟通协作"))).otherwise(F.array().cast("array<string>"))
    return load(spark, d, "part").select("p_partkey", F.array_join(parse.domain_tags(F.col("p_name"), skills, soft), "|").alias("domains"))


@query("""
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN array_to_string(list_sort([p_brand, '软件工程']), '|') WHEN 1 THEN '专业不限' WHEN 2 THEN array_to_string(list_sort([p_type, p_brand]), '|') WHEN 3 THEN '' ELSE array_to_string(list_sort([p_brand, p_type]), '|') END AS majors FROM part
""")
def major_list(spark: SparkSession, d: str) -> DataFrame:
    k, brand, kind = F.col("p_partkey") % 5, F.col("p_brand"), F.col("p_type")
    t = (
        F.when(k == 0, F.concat(brand, F.lit("、软件工程，"), brand)).when(k == 1, F.concat(F.lit("专业不限，"), brand)).when(k == 2, F.concat(F.lit('["'), kind, F.lit('", "'), brand, F.lit('"]')))
        .when(k == 3, "").otherwise(F.concat(brand, F.lit("与"), kind, F.lit("等相关专业优先")))
    )
    return load(spark, d, "part").select("p_partkey", F.array_join(parse.major_list(t), "|").alias("majors"))


@query("""
WITH x AS (SELECT s_suppkey, s_name, 'J' || s_nationkey AS a, 'J' || (s_suppkey % 7) AS b FROM supplier),
r AS (SELECT s_suppkey, s_name AS source_job, a AS target_job, 'PROMOTE_TO' AS relation_type FROM x UNION ALL SELECT s_suppkey, b, a, 'TRANSFER_TO' FROM x WHERE a <> b)
SELECT s_suppkey, source_job, target_job, relation_type FROM r
""")
def relation_details(spark: SparkSession, d: str) -> DataFrame:
    """Repeats, loops, unlike names of the same field and unknown relations in one JSON text."""
    a, b = F.concat(F.lit("J"), F.col("s_nationkey").cast("string")), F.concat(F.lit("J"), (F.col("s_suppkey") % 7).cast("string"))
    one = F.concat(F.lit('{"target_job": "'), a, F.lit('", "relation_type": "promote_to"}'))
    other = F.concat(F.lit('{"source_job": "'), b, F.lit('", "to_job": "'), a, F.lit('", "type": "TRANSFER_TO", "reason": "x"}'))
    rows = F.concat(F.lit("["), F.concat_ws(", ", one, one, other, F.lit('{"target_job": "z", "type": "KNOWS"}'), F.lit("null"), F.lit('{"type": "PROMOTE_TO"}')), F.lit("]"))
    got = load(spark, d, "supplier").select("s_suppkey", F.explode(parse.relation_details(rows, F.col("s_name"))).alias("r"))
    return got.select("s_suppkey", "r.source_job", "r.target_job", "r.relation_type")


@query("""
WITH x AS (SELECT o_orderkey, o_custkey, (o_orderkey % 101)::DOUBLE AS m, CASE WHEN o_orderkey % 2 = 0 THEN 'direct_vertical' ELSE 'transfer' END AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'graph' ELSE 'offline' END AS s FROM orders)
SELECT o_orderkey, CASE WHEN k = 'direct_vertical' THEN m + CASE WHEN s = 'graph' THEN 8 ELSE 4 END WHEN s = 'graph' THEN greatest(50, m - 2) + 6 ELSE greatest(50, m - 5) + 3 END::DOUBLE AS path_score_hint,
 CASE WHEN k = 'direct_vertical' AND s = 'graph' THEN 'high' WHEN k = 'direct_vertical' THEN CASE WHEN m >= 75 THEN 'high' ELSE 'medium' END WHEN s = 'graph' THEN CASE WHEN m < 80 THEN 'high' ELSE 'medium' END WHEN m < 75 THEN 'high' ELSE 'medium' END AS priority_hint FROM x
""")
def path_candidates(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = load(spark, d, "orders").select("o_orderkey", (k % 101).cast("double").alias("match_score"), F.when(k % 2 == 0, "direct_vertical").otherwise("transfer").alias("path_type"), F.when(k % 3 == 0, "graph").otherwise("offline").alias("source"))
    return path.candidate_options(rows).select("o_orderkey", "path_score_hint", "priority_hint")


@query("""
WITH a AS (SELECT c_custkey AS student, c_mktsegment AS job, 0 AS k, 0 AS o FROM customer UNION ALL SELECT o_custkey, o_orderpriority, 1, o_orderkey FROM orders UNION ALL SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN c_mktsegment ELSE 'J' || c_nationkey END, 2, 0 FROM customer),
m AS (SELECT student, job, min((k, o)) AS place_of FROM a GROUP BY ALL)
SELECT student, job, CAST(row_number() OVER (PARTITION BY student ORDER BY place_of, job) AS INTEGER) AS place FROM m
""")
def goal_candidates(spark: SparkSession, d: str) -> DataFrame:
    c, o = load(spark, d, "customer"), load(spark, d, "orders")
    own = c.select(F.col("c_custkey").alias("student"), F.col("c_mktsegment").alias("job"), F.lit(0).cast("long").alias("o"))
    ranked = o.select(F.col("o_custkey").alias("student"), F.col("o_orderpriority").alias("job"), F.col("o_orderkey").alias("o"))
    hints = c.select(F.col("c_custkey").alias("student"), F.when(F.col("c_nationkey") % 2 == 0, F.col("c_mktsegment")).otherwise(F.concat(F.lit("J"), F.col("c_nationkey").cast("string"))).alias("job"), F.lit(0).cast("long").alias("o"))
    return path.goal_candidates([(own, "o"), (ranked, "o"), (hints, "o")], "student")


@query("""
WITH g AS (SELECT DISTINCT 'J' || n_regionkey AS job, n_name AS path, 'PROMOTE_TO' AS kind FROM nation),
f AS (SELECT DISTINCT 'J' || (s_suppkey % 5) AS job, n_name AS path, 'PROMOTE_TO' AS kind FROM supplier JOIN nation ON n_nationkey = s_nationkey UNION SELECT 'J' || (s_suppkey % 5), 'S' || s_nationkey, 'TRANSFER_TO' FROM supplier)
SELECT job, path, kind, 'graph' AS source FROM g UNION ALL (SELECT job, path, kind, 'offline' FROM f EXCEPT SELECT job, path, kind, 'offline' FROM g)
""")
def offline_paths(spark: SparkSession, d: str) -> DataFrame:
    nation, supplier = load(spark, d, "nation"), load(spark, d, "supplier")
    known = nation.select(F.concat(F.lit("J"), F.col("n_regionkey").cast("string")).alias("job"), F.col("n_name").alias("path"), F.lit("PROMOTE_TO").alias("kind"))
    rows = supplier.join(nation, F.col("n_nationkey") == F.col("s_nationkey"))
    as_json = lambda c: F.to_json(F.array(c))
    profiles = rows.select(F.concat(F.lit("J"), (F.col("s_suppkey") % 5).cast("string")).alias("job"), as_json(F.col("n_name")).alias("vertical_paths"), as_json(F.concat(F.lit("S"), F.col("s_nationkey").cast("string"))).alias("transfer_paths"))
    return path.with_offline_paths(known, profiles)
