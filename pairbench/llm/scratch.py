"""Tables written to the shared folder that the cluster names, to cut lineage.

`spark.checkpoint.dir` is read from the session; only where it is unset on one machine (as in tests) a
folder of its own takes its place, and on a cluster that is an error. Tables are dropped on request, and the rest when the session ends.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from pairbench.operators.components import shared_folder


def folder(spark: SparkSession) -> str:
    return shared_folder(spark)


def keep(df: DataFrame) -> DataFrame:
    """df, written as Parquet and read again: recomputed by nobody, and safe from lost executors."""
    spark = df.sparkSession
    at = f"{folder(spark)}/scratch-{uuid.uuid4().hex}"
    df.write.parquet(at)
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    out = spark.read.schema(df.schema).parquet(at)
    out._scratch = at
    return out


def drop(*frames: DataFrame | None) -> None:
    """Deletes kept tables that nothing reads any more."""
    for df in frames:
        if df is not None and (at := getattr(df, "_scratch", None)):
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
