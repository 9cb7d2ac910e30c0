"""Coercion, merges, candidates, reports, facts and names on small and odd rows, against plain loops."""

import json
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from laborline.functions import registry
from laborline.functions.coerce import coerced
from laborline.operators import candidates, facts, match, merge, path, report, resolve, rollups, sqlapi, titles

SHAPE = {"s": "d", "n": 7, "f": 0.5, "ok": True, "tags": [], "in": {"a": "", "b": {"c": 1}}, "rows": [{"k": "", "v": 0}], "any": {}}
NOTHING = ("d", 7, 0.5, True, [], ("", (1,)), [], "{}")


def test_coercion_of_every_kind(spark):
    cases = {
        '{"s":" a ","n":"12","f":"1e2","ok":"Yes","tags":"a、b; c","in":{"a":5,"b":{"c":2.9}},"rows":[{"k":1,"v":"3"},{"v":true},5],"any":{"q":[1]}}': ("a", 12, 100.0, True, ["a", "b", "c"], ("5", (2,)), [("1", 3), ("", 1), ("", 0)], '{"q":[1]}'),
        '{"s":true,"n":"1.5","f":3,"ok":0,"tags":["x",1,null],"in":3,"rows":{"k":"one"},"any":[1]}': ("True", 7, 3.0, False, ["x", "1", None], ("", (1,)), [("one", 0)], "{}"),
        '{"s":null,"n":true,"f":"x","ok":[],"tags":"[1, \\"b\\"]","in":{"b":[]},"rows":"no"}': ("d", 1, 0.5, False, ["1", "b"], ("", (1,)), [], "{}"),
        '{"tags":"[oops]","n":-1.5,"ok":[0]}': ("d", -1, 0.5, True, ["[oops]"], ("", (1,)), [], "{}"), "nope": NOTHING, "[1]": NOTHING, "": NOTHING, None: NOTHING, "{": NOTHING, '{"n": "", "s": ""}': ("", *NOTHING[1:]),
    }
    df = spark.createDataFrame([(k, j) for k, j in enumerate(cases)], "k int, j string").select("k", coerced(F.col("j"), SHAPE).alias("r"))
    plain = lambda x: tuple(plain(y) for y in x) if isinstance(x, tuple) else [plain(y) for y in x] if isinstance(x, list) else x
    got = [plain(tuple(r["r"])) for r in df.orderBy("k").collect()]
    assert got == list(cases.values())


def test_merged_rows(spark):
    policy = {"rows": merge.Rows(("a",), ("a", "b", "description")), "list": "union", "n": merge.Clamped(0, 10), "in": {"x": "ruled", "y": "judged"}}
    kind = "struct<rows:array<struct<a:string,b:string,description:string>>,list:array<string>,n:double,`in`:struct<x:string,y:string>>"
    rules = {"rows": [{"a": "p", "b": "", "description": "r"}, {"a": "p", "b": "2", "description": ""}, {"a": " ", "b": "", "description": "only"}, {"a": "", "b": "", "description": ""}], "list": ["x", " y", "nan", None], "in": {"x": " ", "y": "ry"}}
    judge = {"rows": [{"a": "p ", "b": "1", "description": "j"}, {"a": "q", "b": None, "description": None}, {"a": "q", "b": "9", "description": "late"}], "list": ["y", "z"], "n": 99, "in": {"x": "jx"}}
    df = spark.createDataFrame([(json.dumps(rules), json.dumps(judge)), (None, None)], "r string, j string").select(merge.merged(F.from_json("r", kind), F.from_json("j", kind), policy).alias("m"))
    full, empty = (r["m"] for r in df.collect())
    assert [tuple(x) for x in full["rows"]] == [("p", "1", "j"), ("", "", "only"), ("q", "", "")] and full["list"] == ["x", "y", "z"] and full["n"] == 10 and tuple(full["in"]) == ("jx", "ry")
    assert tuple(empty) == ([], [], 0.0, ("", ""))


def test_candidates_by_a_plain_loop(spark):
    """Every pair of letters' similarity, tokens or containment, as all names compared with all requests would give."""
    chance = random.Random(4)
    word = lambda: "".join(chance.choice("abcdr测试数据前端") for _ in range(chance.randrange(1, 9)))
    requests, names = sorted({word() for _ in range(60)}), sorted({word() for _ in range(80)})
    r, n = spark.createDataFrame([(x,) for x in requests] + [(" ",), (None,)], "request string"), spark.createDataFrame([(x,) for x in names], "name string")
    keys = {x["request"]: (x["k"], x["p"], x["t"]) for x in r.unionByName(n.withColumnRenamed("name", "request")).select("request", candidates.name_key(F.col("request")).alias("k"), candidates.name_key(F.col("request"), False).alias("p"), candidates.name_tokens(F.col("request")).alias("t")).collect()}
    want = {}
    for a in requests:
        for b in names:
            (ka, _, tokens), (kb, plain, _) = keys[a], keys[b]
            share = lambda key: sum(t in key for t in tokens) / len(tokens) if tokens and key else 0.0
            similarity = 0.0
            if ka and kb:
                similarity = max(SequenceMatcher(None, ka, kb).ratio(), 0.82 if ka in kb or kb in ka else 0, share(kb))
            found = max(round(similarity, 4), 0.78 if ka and plain and (ka in plain or plain in ka) else 0, share(plain))
            if found >= 0.45:
                want[a, b] = (round(found, 4), round(min(similarity, 1), 4))
    got = {(x["request"], x["name"]): (round(x["found"], 4), x["similarity"]) for x in candidates.similar_names(r, n).collect()}
    assert got == want and len(want) > 200


def test_report_of_nothing_has_all_sections(spark):
    df = spark.sql("select 1 as id, named_struct('name', cast(null as string)) as student")
    rows = report.sections(df, ["id"]).orderBy("place").collect()
    assert [r["title"] for r in rows] == report.texts.TITLES and all(r["content"] for r in rows)
    assert report.completeness(report.sections(df, ["id"]).filter("place <> 5"), ["id"]).first()["missing"] == ["分阶段行动计划"]


def test_places_in_lines(spark):
    lines = {"现居：\n地址 在北京市朝阳": "在北京市", "住址: Lyon": "Lyon", "住址: " + "x" * 21: None, "a\r\nlocation:上海": "上海", "": None, None: None}
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "k int, t string")
    assert [r["p"] for r in df.select("k", facts.place_in_lines(F.col("t"), facts.HOME_WORDS).alias("p")).orderBy("k").collect()] == list(lines.values())


def test_questions(spark):
    cases = {
        "晋升后薪资是多少": "career_path_question", "Java岗位需要什么证书": "job_requirement_question", "写总结": "report_question", "为什么推荐它": "match_explanation", "我会什么": "student_profile_question", "哪些公司": "company_search", "20k": "salary_search",
        "行业": "industry_search", "上海有哪些": "city_market_search", "上海": "general_advice", "": "general_advice", None: "general_advice", "PROMOTE_TO": "career_path_question",
    }
    df = spark.createDataFrame([(k, x) for k, x in enumerate(cases)], "k int, q string")
    assert [r["i"] for r in df.select("k", sqlapi.intent(F.col("q"))["intent"].alias("i")).orderBy("k").collect()] == list(cases.values())


def test_gaps_without_arrays(spark):
    kind = "id int, missing_items array<struct<dimension:string,required_item:string,student_item:string,reason:string>>, matched_items array<struct<dimension:string,required_item:string>>, hard_skills array<string>, tool_skills array<string>, required_skills array<string>, required_tools array<string>, weaknesses array<string>, missing_dimensions array<string>, improvement_suggestions array<string>, overall_match_score double"
    rows = [(1, *[None] * 10), (2, [("hard_skills", "a", None, "why"), None, ("hard_skills", "a", "", "why")], [("hard_skills", " b ")], ["c"], None, ["a", "b", "c", "d", " d", "nan"], ["t"], ["w", "w"], None, ["learn d"], 80.0)]
    got = path.gap_analysis(spark.createDataFrame(rows, kind), ["id"]).orderBy("place").collect()
    assert [(r["gap_type"], r["gap_item"], r["current_status"]) for r in got] == [("hard_skills", "a", "why"), ("hard_skills", "d", "学生侧尚未形成稳定技能证据"), ("tool_skills", "t", "学生侧尚未形成稳定工具使用证据"), ("student_weakness", "w", "w")]
    assert got[1]["action_hint"] == "learn d" and [r["place"] for r in got] == [1, 2, 3, 4]


def test_names_differ_by_module(spark):
    df = spark.createDataFrame([("xgboost",), ("Tableau",), (None,), ("-",)], "t string")
    both = df.select(registry.standard_name(F.col("t"), "skill", "aggregator").alias("a"), registry.standard_name(F.col("t"), "skill", "job_profile").alias("p")).collect()
    assert [tuple(r) for r in both] == [("xgboost", "机器学习"), ("数据可视化", "Tableau"), (None, None), (None, None)]
    with pytest.raises(KeyError):
        registry.entry("skill", "nowhere")


def test_modes_of_ties_and_blanks(spark):
    df = spark.createDataFrame([(1, "j", None, "b"), (2, "j", "b", None), (3, "j", "a", "nan"), (4, "k", " ", ""), (5, None, "x", "y")], "o int, job_name string, job_category string, job_family string")
    got = {r["name"]: (r["job_category"], r["occurrence_count"]) for r in rollups.job_nodes(df, "o").collect()}
    assert got == {"j": ("b", 3), "k": ("", 1)}
    assert rollups.job_nodes(df.limit(0), "o").count() == 0 and rollups.knowledge_records(df.withColumnRenamed("job_name", "standard_job_name"), "o").count() == 2


def test_names_of_lists(spark):
    df = spark.createDataFrame([(1, "xgboost、Tableau,xgboost"), (2, "xgboost、Tableau,xgboost"), (3, None), (4, "-"), (5, "Tableau")], "id int, t string")
    got = {r["id"]: [list(x["names"]) for x in r["named"]] for r in resolve.with_standard_names(df, "t", [("skill", "aggregator"), ("skill", "job_profile")]).collect()}
    both = [["xgboost", "数据可视化"], ["机器学习", "Tableau"]]
    assert got == {1: both, 2: both, 3: [[], []], 4: [[], []], 5: [["数据可视化"], ["Tableau"]]}


def test_components_with_a_hub(spark):
    """A hub of many nodes and a label that all of them get."""
    edges = spark.range(1, 2000).selectExpr("id as a", "0L as b").union(spark.createDataFrame([(5000, 5001), (5001, 5002), (1999, 3000)], "a long, b long"))
    got = dict(titles.components(spark.range(6000), edges).collect())
    assert got == {i: 0 if i < 2000 or i == 3000 else 5000 if 5000 <= i <= 5002 else i for i in range(6000)}


def test_students_are_not_dealt_by_dimension(spark):
    students = spark.range(1000).crossJoin(spark.createDataFrame([("learning",), ("innovation",)], "dimension string")).withColumn("score", F.lit(50))
    needs = spark.createDataFrame([("learning", 70), ("innovation", 40)], "dimension string, score int")
    got = match.ability_gaps(students, needs, ["id"])
    assert "SortMergeJoin" not in got._jdf.queryExecution().sparkPlan().toString()
    assert {tuple(r)[1:] for r in got.collect()} == {(70.0, "risk", 0)} and got.count() == 1000


def test_equal_requests_are_matched_once(spark):
    requests = spark.range(500).select(F.col("id").alias("request_id"), F.lit("数据").alias("request"), F.array(F.lit("a")).alias("terms"))
    assets = spark.createDataFrame([("数据b1", 1, ["a"], 0.5, 10, True, 1), ("数据b2", 2, ["b"], 0.5, 10, False, 0)], "name string, place int, terms array<string>, quality double, sample_count long, is_core boolean, required_points int")
    got = candidates.candidate_jobs(requests, assets)
    assert "request_id" not in "".join(line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window" in line)
    assert sorted({tuple(r)[1:3] for r in got.collect()}) == [(1, "数据b1"), (2, "数据b2")] and got.count() == 1000
