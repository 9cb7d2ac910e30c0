"""Readers and writers against small files, and the helpers that no query reaches."""

import zipfile

import pytest
from pyspark.sql import functions as F

from laborline.functions import similarity, vocab
from laborline.operators import report, resume, sqlapi, vector
from laborline.sources import readers, writers
from laborline.streaming import filters


def workbook(path, rows, shared):
    """A workbook of one sheet: every other cell in the shared strings, the others inline."""
    cells = []
    for r, row in enumerate(rows, 1):
        inner = ""
        for c, v in enumerate(row):
            if v is not None:
                ref = f"{chr(65 + c)}{r}"
                inner += f'<c r="{ref}" t="s"><v>{shared.index(v)}</v></c>' if v in shared else f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>' if not v.isdigit() else f'<c r="{ref}"><v>{v}</v></c>'
        cells.append(f'<row r="{r}">{inner}</row>')
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">' + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{"".join(cells)}</sheetData></worksheet>')


def test_workbooks(spark, tmp_path):
    (tmp_path / "x").mkdir()
    workbook(tmp_path / "x/a.xlsx", [("职位名称", "薪资", "城市"), ("Java", "15", None), ("会计", None, "北京")], ["职位名称", "Java"])
    workbook(tmp_path / "x/b.xlsx", [("职位名称", "城市"), ("测试", "上海")], ["城市"])
    got = readers.excel_table(spark, f"{tmp_path}/x")
    assert set(got.columns) == {"职位名称", "薪资", "城市"}
    assert sorted((r["职位名称"], r["薪资"], r["城市"]) for r in got.collect()) == [("Java", "15", None), ("会计", None, "北京"), ("测试", None, "上海")]
    assert readers.table(spark, f"{tmp_path}/x/b.xlsx").count() == 1


def test_graph_files_and_tables(spark, tmp_path):
    v = spark.createDataFrame([("job_1", "Java", "Job"), ("skill_1", "SQL", "Skill")], "id string, name string, label string")
    e = spark.createDataFrame([("job_1", "skill_1", "REQUIRES_SKILL")], "start string, end string, kind string")
    writers.graph_files(v, e, str(tmp_path / "g"))
    for kind, part, to in (("nodes", "Job", "jobs"), ("nodes", "Skill", "skills"), ("edges", "REQUIRES_SKILL", "rel")):
        spark.read.option("header", True).csv(f"{tmp_path}/g/{kind}/part={part}").coalesce(1).write.option("header", True).csv(f"{tmp_path}/t/{to}.csv")
    nodes, edges = readers.graph_tables(spark, f"{tmp_path}/t", ["jobs", "skills"], ["rel"])
    assert sorted(map(tuple, nodes.collect())) == sorted(map(tuple, v.collect())) and [tuple(r) for r in edges.collect()] == [("job_1", "skill_1", "REQUIRES_SKILL")]


def test_assets_by_exact_and_compact_name(spark):
    asked = spark.createDataFrame([("Java开发",), ("java 开发",), ("x",)], "request string")
    asset = spark.createDataFrame([("Java开发", 1), ("测试", 2)], "name string, n int")
    got = {r["request"]: (r["n"], r["lookup"]) for r in readers.asset_lookup(asked, asset, "name").collect()}
    assert got == {"Java开发": (1, "exact"), "java 开发": (1, "compact"), "x": (None, None)}


def test_resumes(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r/a.txt").write_text("张三")
    (tmp_path / "r/b.pdf").write_bytes(b"%PDF-1.4")
    with zipfile.ZipFile(tmp_path / "r/c.docx", "w") as z:
        z.writestr("word/document.xml", "<w:document><w:p><w:t>李四</w:t></w:p><w:p><w:t>技能</w:t></w:p></w:document>")
    got = {r["path"].rsplit("/", 1)[1]: r["text"] for r in readers.resumes(spark, f"{tmp_path}/r").collect()}
    assert got == {"a.txt": "张三", "b.pdf": None, "c.docx": "李四\n技能"}


def test_vectors_and_manifests(spark, tmp_path):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "id string, embedding array<double>")
    noted = writers.vectors(df, str(tmp_path / "v"), "id").first()
    assert (noted["documents"], noted["dimension"]) == (2, 2) and readers.vector_store(spark, str(tmp_path / "v")).count() == 2
    df.limit(1).write.mode("overwrite").parquet(str(tmp_path / "v"))
    with pytest.raises(ValueError):
        readers.vector_store(spark, str(tmp_path / "v"))
    assert {(r["name"], r["rows"], r["version"]) for r in writers.manifest({"a": df, "b": df.limit(0)}, "1").collect()} == {("a", 2, "1"), ("b", 0, "1")}


def test_typed_and_evolving_tables(spark, tmp_path):
    df = spark.createDataFrame([("a",)], "job_title string")
    wide = writers.with_columns(df, {"job_title": "string", "n": "int"})
    assert wide.dtypes == [("job_title", "string"), ("n", "int")]
    assert [f.name for f in readers.postings_schema()] == list(vocab.COLUMN_ALIASES)
    df.createOrReplaceTempView("asked")
    assert readers.sql_rows(spark, "select * from asked where job_title = :t", t="a' or 'x'='x").count() == 0
    assert readers.sql_rows(spark, "select * from asked where job_title = :t", t="a").count() == 1


def test_best_table(spark):
    for name in [t.name for t in spark.catalog.listTables()]:
        spark.catalog.dropTempView(name)
    spark.createDataFrame([(1, "x")], "id int, city string").createOrReplaceTempView("other")
    spark.createDataFrame([(1, "x", "y")], "id int, city string, salary string").createOrReplaceTempView("market")
    assert sqlapi.best_table(spark, ["market"], {"city", "salary"}) == "market" and sqlapi.best_table(spark, [], set(), least=1000) is None


def test_report_texts(spark):
    r = spark.range(1).select(report.salary_text(F.lit(1000.0), F.lit(None).cast("double")).alias("s"), report.percent_text(F.lit(0.256)).alias("p")).first()
    assert tuple(r) == ("1000-1000", "25.6%")


def test_short_text_vectors_are_the_grouped_ones(spark):
    df = spark.createDataFrame([(1, "java sql java"), (2, "软件测试"), (3, "")], "id int, t string")
    wide = {r["id"]: r["embedding"] for r in vector.embed(df, "id", "t").collect()}
    for r in df.select("id", similarity.hash_embedding(F.col("t")).alias("v")).collect():
        assert all(abs(a - b) < 1e-12 for a, b in zip(r["v"], wide[r["id"]], strict=True))


def test_phones(spark):
    body = "学号 13900139000\n手机：+86 138-0013-8000\n座机 020-12345678"
    got = spark.createDataFrame([(body,)], "b string").select(resume.phones(F.col("b")).alias("p")).first()["p"]
    assert [(r["value"], r["score"]) for r in got] == [("13800138000", 118 + 28 + 18), ("13900139000", 118 + 18 - 40), ("02012345678", 72 + 18)]


def test_near_lines(spark):
    body = "技能\nJava，SQL\njava sql\nA\nB\nC\nD\nJAVA SQL\n\n  \n"
    got = spark.createDataFrame([(body,)], "b string").select(resume.distinct_lines(resume.cleaned(F.col("b"))).alias("x")).first()["x"]
    assert got == ["技能", "Java,SQL", "A", "B", "C", "D", "JAVA SQL"]


def test_first_seen_once(spark, tmp_path):
    from datetime import datetime

    rows = [(k % 3, datetime(2024, 1, 1, 0, k)) for k in range(9)]
    spark.createDataFrame(rows, "key int, at timestamp").write.parquet(str(tmp_path / "in"))
    stream = filters.first_seen(filters.read_stream(spark, str(tmp_path / "in"), "key int, at timestamp"), "key", "at")
    filters.write_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(r["key"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1, 2]


def test_many_jobs_are_dealt_in_blocks(spark, monkeypatch):
    from laborline.operators import match

    students, jobs = spark.range(20).withColumnRenamed("id", "s"), spark.range(30).withColumnRenamed("id", "j")
    monkeypatch.setattr(match, "MOST_JOBS", 5)
    assert match.with_jobs(students, jobs, blocks=4).distinct().count() == 600
