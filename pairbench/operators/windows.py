"""Interval and sequence windows: overlap joins by bins, DNA functions, motif scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overlapping(df: DataFrame, group: str, start: str, width: int) -> DataFrame:
    """Rows that overlap a row of another group: equi-join on bins of the width, then the exact test."""
    a = df.select(F.col(group).alias("g"), F.col(start).alias("s")).distinct()
    near = a.select(F.col("g").alias("g2"), F.col("s").alias("s2"), F.explode(F.array(*[F.floor(F.col("s") / width) + d for d in (-1, 0, 1)])).alias("bin"))
    hit = a.withColumn("bin", F.floor(F.col("s") / width)).join(near, "bin").where((F.col("g") != F.col("g2")) & (F.abs(F.col("s") - F.col("s2")) < width))
    return hit.select("g", "s").distinct()


def dna(text: Column) -> Column:
    """All letters of the text as bases."""
    letters = F.regexp_replace(F.lower(text), "[^a-z]", "")
    return F.translate(letters, "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC")


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(seq), "ACGT", "TGCA")


def kmers(df: DataFrame, seq: str, k: int) -> DataFrame:
    """Canonical k-mers (the lesser strand) and how often they occur. A pattern that takes no letters
    gives all k-mers of a sequence in one pass; they are counted before the strands are compared."""
    cut = df.select(F.explode(F.regexp_extract_all(seq, F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1))).alias("w"))
    own = cut.groupBy("w").agg(F.count("*").alias("n")).withColumn("rc", reverse_complement(F.col("w")))
    palindromes = F.coalesce(F.sum(F.when(F.col("w") == F.col("rc"), F.col("n"))), F.lit(0))
    return own.groupBy(F.least("w", "rc").alias("kmer")).agg(F.sum("n").alias("n"), palindromes.alias("n_palindromes"))
