"""Writing tables, keyed upserts, graph files, knowledge documents, vectors and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def csv_table(df: DataFrame, path: str) -> None:
    """Overwrites; NULL goes out as blank, arrays and structs as JSON."""
    flat = [F.to_json(c).alias(c) if k.startswith(("array", "struct", "map")) else F.col(c) for c, k in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).option("nullValue", "").option("escape", '"').csv(path)


def keyed(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row per key, the first by ``order``; rows without a key are left out."""
    return df.filter(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_n = 1").drop("_n")


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows whose key isn't in ``new``, and all new rows; columns of either side, NULL where absent."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def with_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds the columns that are absent, as NULLs of the given type."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})


def graph_files(vertices: DataFrame, edges: DataFrame, folder: str) -> None:
    """A folder of CSV files for every label and kind, with graph import headers."""
    nodes = vertices.select(F.col("id").alias("id:ID"), "name", F.col("label").alias(":LABEL"), F.col("label").alias("part"))
    nodes.write.mode("overwrite").partitionBy("part").option("header", True).csv(f"{folder}/nodes")
    links = edges.select(F.col("start").alias(":START_ID"), F.col("end").alias(":END_ID"), F.col("kind").alias(":TYPE"), F.col("kind").alias("part"))
    links.write.mode("overwrite").partitionBy("part").option("header", True).csv(f"{folder}/edges")


def documents(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def vectors(df: DataFrame, path: str, id_col: str, vector: str = "embedding") -> DataFrame:
    """Parquet of ids and vectors, and beside it a manifest with count and dimension, which comes back."""
    df.select(id_col, vector).write.mode("overwrite").parquet(path)
    back = df.sparkSession.read.parquet(path)
    noted = back.agg(F.count("*").alias("documents"), F.max(F.size(vector)).alias("dimension")).withColumn("path", F.lit(path))
    noted.coalesce(1).write.mode("overwrite").json(f"{path}.manifest")
    return df.sparkSession.read.json(f"{path}.manifest")


def manifest(tables: dict[str, DataFrame], version: str) -> DataFrame:
    """name, rows and version of each table."""
    out = None
    for name, df in tables.items():
        part = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows", F.lit(version).alias("version"))
        out = part if out is None else out.unionByName(part)
    return out
