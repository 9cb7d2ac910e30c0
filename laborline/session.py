"""Session settings and reliable checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Only for a master that is one machine.
LOCAL_CHECKPOINTS = "file:///tmp/checkpoints"


def session(name: str = "laborline", **conf: str) -> SparkSession:
    """A session with UTC times; adaptive execution and ANSI mode are Spark's defaults and stay on."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC")
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()


def checkpointed(df: DataFrame) -> DataFrame:
    """A checkpoint in the folder that spark.checkpoint.dir names, or that was set; in a folder of our own only on a local master."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            folder = LOCAL_CHECKPOINTS
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


#: Keys with so many rows at least, and more than their share of MOST_HOT keys, are hot: there are MOST_HOT of them at most.
HOT_ROWS, MOST_HOT = 200, 10_000


def join_hot(rows: DataFrame, table: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` (materialised) joined with ``table``, of which each key is one row, without a task that gets a hot key's rows.

    A key counts as hot from HOT_ROWS rows and a share of 1 / MOST_HOT of all rows on, so there are MOST_HOT hot keys at
    most, whatever the input: their rows of the table are broadcast. The others are shuffled.
    """
    least = max(HOT_ROWS, rows.count() // MOST_HOT)
    hot = checkpointed(rows.groupBy(key).count().filter(F.col("count") >= least).select(key))
    if hot.isEmpty():
        return rows.join(table, key, how)
    few = F.broadcast(hot)
    some = rows.join(few, key, "left_semi").join(F.broadcast(table.join(few, key, "left_semi")), key, how)
    return some.unionByName(rows.join(few, key, "left_anti").join(table.join(few, key, "left_anti"), key, how))
