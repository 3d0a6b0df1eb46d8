"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, one machine (as in tests) takes a
    folder of its own; on a cluster that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir is not set: name a folder that all executors share")
    return f"file://{tempfile.gettempdir()}/checkpoints"


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def _star(edges: DataFrame, both: bool) -> DataFrame:
    """Links each node's neighbours (larger ones, or with both=False smaller ones and itself) to the
    least of its neighbourhood. The minimum is aggregated first, so a hub is no single task."""
    near = edges.select("u", "v")
    if both:
        near = near.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    linked = near.join(least, "u")
    if both:
        out = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, component): the least id reachable from every id of nodes. edges: (u, v) in any direction."""
    edges = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    mark = None
    while True:
        edges = cut(_star(_star(edges, True), False))
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    found = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return nodes.select("id").distinct().join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
