"""Cleaning, filtering, standardization and the offline plan on invented postings."""

import pytest
from pyspark.sql import functions as F

from laborline.functions import parse, similarity, text
from laborline.operators import clean, match, relevance, resume, sqlapi, titles
from laborline.plans import offline
from laborline.plans import student as student_plan
from laborline.sources import readers, writers

HEADERS = ["职位名称", "工作地址", "薪资范围", "公司全称", "所属行业", "人员规模", "公司类型", "职位编码", "职位描述", "公司简介", "更新时间", "岗位链接"]
ROWS = [
    ("Java开发", "广州-天河区", "1-1.5万·13薪", "甲(广州)公司", "软件", "100-499人", "民营", "A1", "负责软件开发，要求本科及以上学历，熟悉Java和MySQL。必须持有PMP。", "x", "2024-05-01", "https://a/1"),
    ("Java开发工程师", "深圳,南山区", "15-25千", "乙公司", "互联网", "1000人以上", "已上市", "A2", "<p>负责后端开发</p><br/>本科，Spring &amp; Linux，计算机相关专业", None, "5月3日", "https://a/2"),
    ("java 开发", "深圳/南山区", "200元/天", "丙公司", "互联网", "少于20人", "天使轮", "A3", "编程，沟通协调，学习能力强，SQL", "x", "2023年2月31日", "a/3"),
    ("会计", "北京", "面议", "丁公司", "制造", "50人以下", "国企", "A4", "会计核算与财税工作，大专以上", "x", "nan", "https://a/4"),
    ("Java开发", "广州-天河区", "1-1.5万", "甲公司", "软件", "nan", "民营", "A1", "负责软件开发", None, "2024-04-01", "https://a/1"),
    (None, None, None, None, None, None, None, None, None, None, None, None),
    ("-", "  ", "abc", "n/a", None, None, None, "", "", None, "13月40日", ""),
]


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame(ROWS, ", ".join(f"`{h}` string" for h in HEADERS))


def test_clean_postings(raw):
    rows = {(r["job_code"], r["updated_at_raw"]): r for r in clean.clean_postings(raw, "2024-06-15").collect()}
    a = rows["A1", "2024-05-01"]
    assert (a["salary_min"], a["salary_max"], a["salary_months"], a["salary_unit"]) == (10000.0, 15000.0, 13, "month")
    assert (a["city"], a["district"], a["company_name_norm"], a["company_size_min"], a["company_size_max"]) == ("广州", "天河区", "甲广州公司", 100, 499)
    assert a["job_title_norm"] == "java开发工程师"
    b = rows["A2", "5月3日"]
    assert str(b["updated_at_std"]) == "2024-05-03" and b["company_type_norm"] == "上市公司" and "\n" in b["job_description"] and "&" in b["job_description"]
    c = rows["A3", "2023年2月31日"]
    assert str(c["updated_at_std"]) == "2023-02-28" and c["salary_month_min"] == 4350.0 and "invalid_job_url" in c["abnormal_reasons"]
    d = rows["A4", "nan"]
    assert d["is_salary_negotiable"] and d["salary_min"] is None and d["updated_at_std"] is None
    blank = rows[None, None]
    assert blank["duplicate_core_key"] is None and blank["completeness_score"] == 0 and blank["is_abnormal"]


def test_layered_dedup_keeps_the_fullest_and_rows_without_keys(raw):
    done = clean.drop_duplicates(clean.clean_postings(raw, "2024-06-15"), audit=True).collect()
    assert [r["updated_at_raw"] for r in done if r["duplicate_rule"] == "job_code"] == ["2024-04-01"]
    assert sum(r["duplicate_rule"] is None for r in done) == 6


def test_relevance(raw):
    audit = {r["job_code"]: r for r in relevance.audited(clean.drop_duplicates(clean.clean_postings(raw, "2024-06-15"))).collect()}
    assert audit["A1"]["is_cs_related"] and audit["A1"]["cs_filter_source"] == "rule"
    assert not audit["A4"]["is_cs_related"] and audit["A4"]["cs_filter_confidence"] > 0.65


def test_offline_plan(spark, raw):
    relations = spark.createDataFrame([("java开发工程师", "java开发工程师 -> 架构师 -> 总监", "PROMOTE_TO")], "job string, path string, kind string")
    out = offline.run(raw, "2024-06-15", relations)
    names = {r["raw_job_name"]: r["standard_job_name"] for r in out.mapping.collect()}
    assert names["Java开发"] == names["Java开发工程师"] == names["java 开发"]
    assert {r["kind"] for r in out.edges.select("kind").distinct().collect()} >= {"REQUIRES_SKILL", "REQUIRES_DEGREE", "PROMOTE_TO"}
    assert out.edges.filter("kind = 'PROMOTE_TO'").count() == 2
    docs = out.documents.collect()
    assert docs and all(len(d["embedding"]) == 384 and abs(sum(x * x for x in d["embedding"]) - 1) < 1e-9 for d in docs)
    assert out.degree_stats.count() and out.ability_scores.filter("score < 0 or score > 92").count() == 0


@pytest.mark.parametrize("s,low,high,unit", [("15-25K", 15.0, 25.0, "month"), ("8千", 8000.0, 8000.0, "month"), ("3万/年", 30000.0, 30000.0, "year"), ("50元/小时", 50.0, 50.0, "hour"), ("25-15千", 25000.0, 15000.0, "month"), (None, None, None, "unknown"), ("", None, None, "unknown"), ("200 300", 200.0, 300.0, "month")])
def test_salary(spark, s, low, high, unit):
    r = spark.createDataFrame([(s,)], "s string").select(parse.salary(F.col("s")).alias("x")).first()["x"]
    assert (r["low"], r["high"], r["unit"]) == (low, high, unit)


def test_salary_strict(spark):
    df = spark.createDataFrame([("15-25K",), ("8千-1.2万",)], "s string").select(parse.salary(F.col("s"), strict=True).alias("x"))
    assert [(r["x"]["low"], r["x"]["high"]) for r in df.collect()] == [(15000.0, 25000.0), (8000.0, 12000.0)]


def test_similarity_and_greedy_match(spark):
    df = spark.createDataFrame([("C#", "C++", ["java", "sql"], ["javascript", "java", "go"])], "a string, b string, st array<string>, jt array<string>")
    r = df.select(similarity.token_similarity(F.col("a"), F.col("b")).alias("s"), similarity.one_to_one(F.col("st"), F.col("jt"), 0.75).alias("m"), similarity.token_similarity(F.lit(None).cast("string"), F.col("b")).alias("n")).first()
    assert r["s"] == 1.0 and r["n"] == 0.0
    assert [(m["job"], m["student"]) for m in r["m"]] == [("java", "java")]


def test_degree_and_certificates(spark):
    df = spark.createDataFrame([("硕士或本科，CET-6优先",), ("学历不限",), ("",), (None,)], "t string")
    got = [r["d"]["degree"] for r in df.select(parse.degree_requirement(F.col("t")).alias("d")).collect()]
    assert got == ["本科", "学历不限", "未明确", "未明确"]


def test_text_helpers(spark):
    df = spark.createDataFrame([(" a 　b&amp;c ", '["x","x","y"]', "b、a，a")], "t string, j string, l string")
    r = df.select(text.clean_text(F.col("t")).alias("t"), text.list_like(F.col("j")).alias("j"), text.list_like(F.col("l"), ordered=False).alias("l"), similarity.html_unescape(F.lit("&eacute;")).alias("h"), similarity.nfkc(F.lit("Ａ")).alias("k")).first()
    assert tuple(r) == ("a b&c", ["x", "y"], ["a", "b"], "é", "A")


def test_path_modes(spark):
    df = spark.createDataFrame([("A", "A→B→C")], "j string, p string")
    r = df.select(parse.path_targets(F.col("j"), F.col("p")).alias("all"), parse.path_targets(F.col("j"), F.col("p"), chained=False).alias("last")).first()
    assert (r["all"], r["last"]) == (["B", "C"], ["C"])


def test_guard(spark):
    spark.range(30).createOrReplaceTempView("jobs")
    spark.range(3).createOrReplaceTempView("secrets")
    assert sqlapi.guarded(spark, "select id from jobs limit 500").count() == 15
    for good in (
        "with a as (select id from jobs), b (x) as (select id from a) select count(*) from b", "select case when (id > 3) then upper('drop (x)') else 'secrets' end from jobs where id in (select max(id) from jobs)",
        "select * from (with a as (select id from jobs) select * from a) x", "select count(*) from jobs where id >= 0 and (id < 9 or id = 12)",
    ):
        assert sqlapi.guarded(spark, good).count() > 0
    wide = ", ".join(f"id as c{k}" for k in range(60))
    for bad in (
        "drop table jobs", "select 1; select 2", "select * from jobs, secrets", "select * from jobs where id in (select id from secrets)", "select 1 -- x",
        "with secrets as (select * from secrets) select * from secrets", "select * from (with secrets as (select * from secrets) select * from secrets) x",
        "with a as (with secrets as (select * from secrets) select * from secrets) select * from a", "with jobs as (select * from secrets) select * from jobs", "with `secrets` as (select * from secrets) select * from `secrets`",
        "select reflect('java.lang.System', 'getProperty', 'user.home') from jobs", "select `reflect` ('java.lang.System', 'getProperty', 'user.home') from jobs", "select java_method('java.lang.System', 'gc') from jobs",
        "select try_reflect('a', 'b') from jobs", "select '\\'', reflect('java.lang.System', 'gc'), '' from jobs", "select * from identifier('secrets')", "select * from parquet.`/etc`", "select * from range(10)",
        "with reflect (a) as (select id from jobs) select reflect('java.lang.System','getProperty','user.home') from jobs limit 1", "with java_method (a) as (select id from jobs) select java_method('java.lang.System','getProperty','java.io.tmpdir') from jobs",
        "with range (a) as (select id from jobs) select * from range(3)", "with `reflect` (`a`) as (select id from jobs) select `reflect`('java.lang.System','getProperty','user.home') from jobs",
        "select * from (with reflect (a) as (select id from jobs) select reflect('java.lang.System','getProperty','user.home') as b from jobs) x", "with a as (with range (b) as (select 1) select * from range(3)) select * from a",
        "select id, reflect(id, id) as (x) from jobs", "with a (b) as (select id from jobs) select a(b) from a", "select * from jobs, lateral explode(array(1))",
        f"select {wide}, (select max(id) from secrets) as s from jobs", "select * from jobs where exists (table secrets)", "with a as (select 1) insert into jobs select * from a", "select secrets.id from jobs join secrets using (id)",
    ):
        with pytest.raises(sqlapi.UnsafeQuery):
            sqlapi.guarded(spark, bad)


def test_components_of_a_long_chain(spark):
    n = 200
    e = spark.createDataFrame([(i, i + 1) for i in range(n) if i != 100], "a long, b long")
    got = {r["id"]: r["cluster"] for r in titles.components(spark.range(n + 1), e).collect()}
    assert set(got.values()) == {0, 101} and got[100] == 0 and got[n] == 101


def test_resume_sections(spark):
    body = "张三\n手机 13800138000 邮箱 a.b@c.com\n教育经历\nX大学 软件工程\n技能\nJava"
    df = spark.createDataFrame([(1, body), (2, None), (3, "")], "id long, body string")
    rows = resume.sections(df, "id", "body").collect()
    assert {r["line"]: r["section"] for r in rows if r["id"] == 1}["Java"] == "skill"
    r = df.filter("id = 1").select(resume.best_email(F.col("body")).alias("e"), resume.best_phone(F.col("body")).alias("p")).first()
    assert (r["e"], r["p"]) == ("a.b@c.com", "13800138000")


STUDENTS = "student_id long, name string, school string, major string, degree string, degree_rank int, skills array<string>, tools array<string>, practice array<string>, soft_skills array<string>, certificates array<string>, occupation_hints array<string>, level_rank int, target_job string"
JOBS = "job_name string, required_degree_rank int, required_majors array<string>, required_certificates array<string>, required_skills array<string>, required_tools array<string>, required_practice array<string>, required_soft_skills array<string>, required_level_rank int"


def test_student_plan(spark):
    students = spark.createDataFrame([(1, "a", "b", "软件工程", "本科", 3, ["Java", "SQL"], ["Git"], ["实习要求"], ["沟通协作"], ["PMP"], ["Java"], 2, "Java开发"), (2, None, None, None, None, -1, None, None, None, None, None, None, 0, None)], STUDENTS)
    jobs = spark.createDataFrame([("Java开发", 3, ["软件工程"], [], ["Java", "SQL"], ["Git"], [], ["沟通协作"], 2), ("测试", 5, ["数学"], ["CPA"], ["C"], [], [], [], 4)], JOBS)
    ranked = {(r["student_id"], r["rank"]): r for r in student_plan.recommendations(students, jobs).collect()}
    assert ranked[1, 1]["job_name"] == "Java开发" and ranked[1, 1]["skill"] == 100.0
    assert all(0 <= r["overall"] <= 100 for r in ranked.values())
    g = {r["student_id"]: r for r in student_plan.reports(student_plan.goals(students, jobs)).collect()}
    assert g[1]["decision"] == "keep_target" and g[1]["goal_job"] == "Java开发" and "phase_plan" in g[1]["missing_sections"]
    assert g[2]["decision"] == "switch"


def test_empty_requirements_score_full(spark):
    df = spark.createDataFrame([([], [])], "s array<string>, j array<string>")
    r = df.select(similarity.tags_score(F.col("s"), F.col("j"), 0.5).alias("t"), match.knowledge_coverage(F.col("s"), F.col("j")).alias("k")).first()
    assert r["t"] == 100.0 and r["k"]["accuracy"] == 1.0 and not r["k"]["requirement_known"]


def test_sources_round_trip(spark, tmp_path, raw):
    writers.csv_table(raw.select("职位名称", "公司全称"), str(tmp_path / "c"))
    back = readers.csv_table(spark, str(tmp_path / "c"))
    assert back.columns == ["职位名称", "公司全称"] and back.count() == len(ROWS)
    writers.documents(raw.select("职位名称"), str(tmp_path / "j"))
    assert readers.json_table(spark, str(tmp_path / "j")).count() == len(ROWS)


def test_stream_equals_batch(spark, tmp_path):
    from laborline.streaming import filters

    folder = tmp_path / "in"
    batch = spark.createDataFrame([(k, f"Java开发{k}", "软件开发") for k in range(5)], "job_code string, job_title string, job_description string")
    batch.write.parquet(str(folder))
    stream = filters.read_stream(spark, str(folder), "job_code string, job_title string, job_description string")
    q = filters.write_stream(filters.postings(stream, "2024-06-15").select("job_code", "job_title_norm", "cs_score"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    want = relevance.kept(relevance.audited(clean.clean_postings(batch, "2024-06-15"))).select("job_code", "job_title_norm", "cs_score")
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, want.collect()))
