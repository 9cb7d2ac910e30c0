"""Reading postings, assets, graph and resume files; everything comes in as text and is typed by the parsers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import vocab


def postings_schema() -> StructType:
    return StructType([StructField(c, StringType()) for c in vocab.COLUMN_ALIASES])


def csv_table(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """All columns as strings; a byte order mark before the first header is dropped."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8")
    df = reader.schema(schema).csv(path) if schema else reader.csv(path)
    return df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])


def json_table(spark: SparkSession, path: str, lines: bool = True, schema: str | None = None) -> DataFrame:
    """Line-delimited objects, or one array of objects a file."""
    reader = spark.read.option("multiLine", not lines)
    df = reader.schema(schema).json(path) if schema else reader.json(path)
    return df.drop("_corrupt_record") if "_corrupt_record" in df.columns else df


def table(spark: SparkSession, path: str, form: str | None = None) -> DataFrame:
    """By suffix or by name: parquet, orc, csv, json lines, workbooks or text."""
    suffixes = (("csv", (".csv", ".csv.gz")), ("json", (".json", ".jsonl")), ("orc", (".orc",)), ("text", (".txt",)), ("excel", (".xlsx",)))
    form = form or next((f for f, s in suffixes if path.lower().endswith(s)), "parquet")
    if form == "csv":
        return csv_table(spark, path)
    if form == "json":
        return json_table(spark, path)
    return excel_table(spark, path) if form == "excel" else spark.read.format(form).load(path)


def sheet_rows(data: bytes, sheet: int = 1) -> list[dict[int, str]]:
    """Cells of a workbook's sheet by column number, as text. A workbook is a ZIP of XML parts."""
    import io
    import re
    import zipfile
    from xml.etree import ElementTree

    tag = lambda e: e.tag.rsplit("}", 1)[-1]
    text = lambda e: "".join(t.text or "" for t in e.iter() if tag(t) == "t")
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = [text(e) for e in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if tag(e) == "si"] if "xl/sharedStrings.xml" in z.namelist() else []
        rows = []
        for row in (e for e in ElementTree.fromstring(z.read(f"xl/worksheets/sheet{sheet}.xml")).iter() if tag(e) == "row"):
            cells: dict[int, str] = {}
            for c in row:
                letters = re.match("[A-Z]*", c.get("r", "")).group()
                at = sum((ord(x) - 64) * 26**k for k, x in enumerate(reversed(letters))) - 1 if letters else len(cells)
                value = next((e.text or "" for e in c if tag(e) == "v"), "")
                value = text(c) if c.get("t") == "inlineStr" else shared[int(value)] if c.get("t") == "s" else value
                if value:
                    cells[at] = value
            rows.append(cells)
    return rows


def excel_table(spark: SparkSession, path: str, sheet: int = 1) -> DataFrame:
    """Workbooks of one layout as strings, blank cells NULL: a file to a task, never through the driver. The headers of all
    files are gathered first; a column of any of them is one of the result."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def rows(frames):
        for frame in frames:
            for data in frame["content"]:
                head, *body = sheet_rows(bytes(data), sheet) or [{}]
                yield pd.DataFrame({"cells": [{head[k]: v for k, v in r.items() if k in head} for r in body]})

    def headers(frames):
        for frame in frames:
            yield pd.DataFrame([(name, k) for data in frame["content"] for k, name in (sheet_rows(bytes(data), sheet) or [{}])[0].items()], columns=["name", "place"])

    found = files.mapInPandas(headers, "name string, place int").groupBy("name").agg(F.min("place").alias("p")).orderBy("p", "name").limit(16_384).collect()  # a sheet's columns
    cells = files.mapInPandas(rows, "cells map<string,string>")
    return cells.select(*[F.try_element_at("cells", F.lit(r["name"])).alias(r["name"].strip()) for r in found])


def vector_store(spark: SparkSession, path: str) -> DataFrame:
    """Vectors that ``writers.vectors`` wrote, held against their manifest."""
    rows, noted = spark.read.parquet(path), spark.read.json(f"{path}.manifest").first()
    column = next(c for c, kind in rows.dtypes if kind.startswith("array"))
    have = rows.agg(F.count("*").alias("documents"), F.max(F.size(column)).alias("dimension")).first()
    if (have["documents"], have["dimension"]) != (noted["documents"], noted["dimension"]):
        raise ValueError(f"{path}: {have} where its manifest has {noted}")
    return rows


def sql_rows(spark: SparkSession, statement: str, **values) -> DataFrame:
    """A statement with named parameters over registered views."""
    return spark.sql(statement, args=values)


def jdbc_table(spark: SparkSession, url: str, query: str, **options) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def graph_tables(spark: SparkSession, folder: str, nodes: list[str], edges: list[str]) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges from CSV files with graph import headers (``id:ID(...)``, ``:START_ID``, ``:END_ID``, ``:TYPE``)."""
    pick = lambda df, mark: next(c for c in df.columns if mark in c)
    v = e = None
    for name in nodes:
        df = csv_table(spark, f"{folder}/{name}.csv")
        part = df.select(F.col(f"`{pick(df, ':ID')}`").alias("id"), "name", F.col(f"`{pick(df, ':LABEL')}`").alias("label"))
        v = part if v is None else v.unionByName(part)
    for name in edges:
        df = csv_table(spark, f"{folder}/{name}.csv")
        part = df.select(F.col(f"`{pick(df, ':START_ID')}`").alias("start"), F.col(f"`{pick(df, ':END_ID')}`").alias("end"), F.col(f"`{pick(df, ':TYPE')}`").alias("kind"))
        e = part if e is None else e.unionByName(part)
    return v, e


def asset_lookup(requests: DataFrame, asset: DataFrame, name: str, request: str = "request") -> DataFrame:
    """Asset rows by exact name, else by the compacted name; of several the least name."""
    from ..functions.text import compact

    exact = requests.join(asset.withColumn(request, F.col(name)), request, "left").withColumn("lookup", F.when(F.col(name).isNotNull(), "exact"))
    found, missing = exact.filter("lookup is not null"), exact.filter("lookup is null").select(*requests.columns)
    others = [c for c in asset.columns]
    loose = asset.groupBy(compact(F.col(name)).alias("_k")).agg(F.min_by(F.struct(*others), F.col(name)).alias("_row"))
    rest = missing.withColumn("_k", compact(F.col(request))).join(loose, "_k", "left").select(*requests.columns, "_row.*").withColumn("lookup", F.when(F.col(name).isNotNull(), "compact"))
    return found.unionByName(rest)


def resumes(spark: SparkSession, path: str) -> DataFrame:
    """path and text of plain text and docx files; other kinds have NULL text. A docx is a ZIP whose document part is XML."""
    @F.pandas_udf("string")
    def docx_text(content: pd.Series) -> pd.Series:
        import io
        import re
        import zipfile

        def one(data: bytes) -> str | None:
            try:
                xml = zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml").decode("utf-8", "replace")
            except (zipfile.BadZipFile, KeyError):
                return None
            return re.sub(r"<[^>]+>", "", re.sub(r"</w:p>", "\n", xml)).strip()

        return content.map(one)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    plain = files.filter(F.lower("path").endswith(".txt")).select("path", F.col("content").cast("string").alias("text"))
    word = files.filter(F.lower("path").endswith(".docx")).select("path", docx_text("content").alias("text"))
    other = files.filter(~F.lower("path").endswith(".txt") & ~F.lower("path").endswith(".docx")).select("path", F.lit(None).cast("string").alias("text"))
    return plain.unionByName(word).unionByName(other)
