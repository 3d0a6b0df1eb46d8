"""Record summaries over a growing folder of measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def measurements(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def summary(stream: DataFrame) -> DataFrame:
    """Running summary of each record; all parts merge by sum and max, so state is a row a record."""
    return stream.groupBy("entity", "source").agg(F.count("*").alias("n_rows"), F.max("score").alias("max_score"), F.count_if(F.col("label") == 1).alias("n_pos"))


def windowed(stream: DataFrame, time: str, group: str, width: str, late: str) -> DataFrame:
    """Counts per group and time window; state older than the watermark is dropped."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), group).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), group, "n")
