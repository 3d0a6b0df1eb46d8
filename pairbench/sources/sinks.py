"""Sinks: compressed Parquet, replacement of a table that is its own input, FASTA with a manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("compression", "zstd").parquet(path)


def replace(df: DataFrame, path: str) -> None:
    """Writes beside path, then swaps; df may read path."""
    jvm = df.sparkSession._jvm
    new, old = jvm.org.apache.hadoop.fs.Path(path + ".new"), jvm.org.apache.hadoop.fs.Path(path)
    parquet(df, path + ".new", "overwrite")
    fs = old.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())
    aside = jvm.org.apache.hadoop.fs.Path(path + ".old")
    fs.delete(aside, True)
    if fs.exists(old):
        fs.rename(old, aside)
    if not fs.rename(new, old):
        raise OSError(f"could not move {new} to {old}")
    fs.delete(aside, True)


def fasta_record(name: Column, seq: Column, width: int = 60) -> Column:
    wrapped = F.rtrim(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"), F.lit("\n"))
    return F.concat(F.lit(">"), name, F.lit("\n"), wrapped)


def fasta(df: DataFrame, name: str, seq: str, path: str) -> None:
    df.select(fasta_record(F.col(name).cast("string"), F.col(seq))).write.text(path)


def manifest(df: DataFrame, name: str, seq: str) -> DataFrame:
    """Name, length and digest of every sequence."""
    return df.select(name, F.length(seq).alias("length"), F.substring(F.sha2(F.col(seq), 256), 1, 8).alias("digest"))


def arrays(df: DataFrame, key: str, place: str, values: list[str], path: str) -> None:
    """Long cells as one row a key, with the places in order and an array of each value."""
    cells = F.array_sort(F.collect_list(F.struct(place, *values)))
    own = df.groupBy(key).agg(cells.alias("c")).select(key, F.col(f"c.{place}").alias(place), *[F.col(f"c.{v}").alias(v) for v in values])
    parquet(own, path)


def append_new(df: DataFrame, path: str, keys: list[str]) -> None:
    """Appends the rows whose keys are not yet there: a run that is resumed adds each once."""
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        df = df.join(spark.read.parquet(path).select(keys), keys, "left_anti")
    parquet(df.dropDuplicates(keys), path, "append")


def build(make, path: str, spark) -> None:
    """Writes make()'s table; if that fails, what stood there goes too, so no stale table is read."""
    try:
        parquet(make(), path, "overwrite")
    except Exception:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        raise


def text(content: str, path: str, spark) -> None:
    """A small report."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(content.encode()))
    out.close()
