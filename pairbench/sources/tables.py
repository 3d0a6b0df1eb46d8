"""Scans. A measurement is one (entity, source, site) score; the star-schema tables stand in for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def binarise(score: Column, positive: float = 0.45, negative: float = 0.35) -> Column:
    """1 at or over the upper cutoff, 0 at or under the lower one, -1 (no call) between."""
    return F.when(score >= positive, 1).when(score <= negative, 0).otherwise(-1)


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    lines = table(spark, sf_dir, "lineitem")
    score = F.col("l_quantity") / 50.0 - 0.5
    return lines.join(part, lines.l_partkey == part.p_partkey).select(
        F.col("l_partkey").alias("entity"), F.col("l_suppkey").alias("source"), F.col("p_brand").alias("cluster"), F.col("p_type").alias("family"),
        F.col("l_orderkey").alias("site"), F.col("l_linestatus").alias("replicate"),
        F.col("l_linenumber").alias("slot"), F.col("p_size").alias("n_mut"), score.alias("score"), binarise(score).alias("label"),
    )


MEASUREMENTS_SQL = """m AS (
  SELECT l_partkey AS entity, l_suppkey AS source, p_brand AS cluster, p_type AS family, l_orderkey AS site, l_linestatus AS replicate, l_linenumber AS slot, p_size AS n_mut,
         l_quantity / 50.0 - 0.5 AS score,
         CASE WHEN l_quantity / 50.0 - 0.5 >= 0.45 THEN 1 WHEN l_quantity / 50.0 - 0.5 <= 0.35 THEN 0 ELSE -1 END AS label
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
