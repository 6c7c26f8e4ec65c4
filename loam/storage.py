"""Where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the folder of ``spark.checkpoint.dir``, so that a lost executor costs a reread. On a local
    master without one it is kept in memory; on a cluster that is an error."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir():
        return df.checkpoint()
    if not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return df.persist()


def work_dir(spark: SparkSession, tag: str) -> str:
    """A new folder's name in that of ``spark.checkpoint.dir``, which all executors share; on a local master without
    one, in a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(found or 'file://' + tempfile.mkdtemp(prefix='loam-work-')).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once as Parquet into a new work folder and read again: for a step that several others read."""
    path = work_dir(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
