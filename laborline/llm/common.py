"""Helpers that the training-data operators share: scratch paths, range buckets and Arrow views."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import join_hot  # noqa: F401  (the operators take it from here)

#: Only for a master that is one machine.
LOCAL_SHARED = "file:///tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``, else the one set by setCheckpointDir.

    Without either a local master gets a folder of its own; on a cluster that would be each executor's own disk, so it is
    an error there.
    """
    context = spark.sparkContext
    if base := spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir():
        return base.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    context.setCheckpointDir(LOCAL_SHARED)
    return LOCAL_SHARED


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    base = shared_dir(spark)
    if "://" not in base:
        base = f"file://{base}" if base.startswith("/") else base
    return f"{base}/{name}-{uuid.uuid4().hex}"


def discard(path: str) -> None:
    """Delete a scratch folder that nothing reads any more."""
    fs, plain = file_system(path)
    fs.delete_dir(plain)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` with a reliable checkpoint in the shared folder, so that its lineage ends there.

    Spark deletes it with the DataFrame if spark.cleaner.referenceTracking.cleanCheckpoints is on.
    """
    spark = df.sparkSession
    base = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return df.checkpoint(eager=True)


#: Rows of a few numbers that may be broadcast: some 10 MB.
SMALL_ROWS = 100_000


def small_or_not(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """``df``, which is materialised, marked for broadcast if it has at most ``most`` rows; else Spark shuffles it."""
    return F.broadcast(df) if df.count() <= most else df


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """A pyarrow file system for a URI of any scheme that pyarrow knows, and the path in it."""
    if path.startswith("file:/"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Text of a range bucket, on average.
BUCKET_BYTES = 64 << 20


def buckets_for(docs: DataFrame) -> int:
    """Range buckets for the texts of ``docs``: the shuffle partitions, or as many more as keep a bucket at BUCKET_BYTES on average."""
    size = docs.agg(F.sum(F.octet_length(F.coalesce(F.col("text").cast("string"), F.lit(""))))).first()[0] or 0
    return max(partitions(docs.sparkSession), -(-size // BUCKET_BYTES))


def with_buckets(df: DataFrame, key: str, n: int, out: str = "bucket_no") -> DataFrame:
    """``df`` with an ascending range bucket of the integer ``key`` (nulls: -1), by approximate quantiles.

    Only the key column is read for the quantiles; the driver gets at most ``n`` of them.
    """
    from pyspark.ml.feature import Bucketizer

    wide = df.withColumn("_key_d", F.col(key).cast("double"))
    probs = [i / n for i in range(1, n)]
    cuts = sorted(set(wide.select("_key_d").approxQuantile("_key_d", probs, 0.2 / n))) if n > 1 else []
    if not cuts:
        return df.withColumn(out, F.when(F.col(key).isNull(), F.lit(-1)).otherwise(F.lit(0)))
    splits = [float("-inf"), *cuts, float("inf")]
    put = Bucketizer(splits=splits, inputCol="_key_d", outputCol="_b", handleInvalid="keep").transform(wide)
    return put.withColumn(out, F.when(F.col(key).isNull(), F.lit(-1)).otherwise(F.col("_b").cast("int"))).drop("_b", "_key_d")


def text_bytes(col: str = "text") -> Column:
    """The UTF-8 bytes of a text column, empty for null."""
    return F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")


def ints(col: str = "doc_id") -> Column:
    return F.col(col).cast("long")


def held_out(col: str = "doc_id") -> Column:
    """True for the fifth of ids whose crc32 as text leaves no remainder by 5; a null id counts as empty text."""
    text = F.coalesce(F.col(col).cast("string"), F.lit(""))
    return (F.crc32(text.cast("binary")) % 5) == 0


def views(column: pa.Array) -> Iterator[memoryview]:
    """Each value of a binary or string Arrow array as bytes-like, empty for null, without a copy."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    buf = column.buffers()
    offsets = np.frombuffer(buf[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].tolist()
    data = memoryview(buf[2]) if buf[2] is not None else memoryview(b"")
    valid = None if column.null_count == 0 else column.is_valid().to_pylist()
    for i in range(len(column)):
        yield data[offsets[i] : offsets[i + 1]] if valid is None or valid[i] else memoryview(b"")
