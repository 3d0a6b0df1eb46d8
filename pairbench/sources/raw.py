"""Scans of raw measurement files: zipped tables, record streams, weight-matrix texts; score columns."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairbench.sources import formats


class NoScoreColumn(ValueError):
    """No column, or more than one, can be the score."""


class Truncated(NoScoreColumn):
    """The table has too few rows to tell its columns apart."""


def zipped_lines(spark: SparkSession, path: str) -> DataFrame:
    """(archive, member, line): lines of every member of every zip archive, a member a task at a time."""
    return formats.zipped_lines(spark, path).select("archive", "member", "line")


def cells(lines: DataFrame, header: str = "(?i)^8-mer") -> DataFrame:
    """Lines of tab-separated tables as arrays, without those that match the header pattern."""
    return lines.where(~F.col("line").rlike(header) & (F.trim("line") != "")).withColumn("cells", F.split("line", "\t"))


def score_column(df: DataFrame, names: list[str], pattern: str = "score", least: int = 0) -> str:
    """The score's column among string columns: of those that are numbers in at least 90 % of rows the
    only one whose name matches, else the only one within [-0.5, 0.5] that goes below 0. A table under
    `least` rows that cannot be told is truncated."""
    number = {c: F.expr(f"try_cast(`{c}` AS double)") for c in names}
    got = df.agg(F.count("*").alias("n"), *[f(number[c]).alias(f"{k}{i}") for i, c in enumerate(names) for k, f in (("c", F.count), ("l", F.min), ("h", F.max))]).first()
    numeric = [(i, c) for i, c in enumerate(names) if got["n"] and got[f"c{i}"] >= 0.9 * got["n"]]
    named = [c for _, c in numeric if re.search(pattern, c, re.IGNORECASE)]
    if len(named) == 1:
        return named[0]
    ranged = [c for i, c in numeric if -0.5 <= got[f"l{i}"] < 0 and got[f"h{i}"] <= 0.5]
    if len(ranged) != 1 and got["n"] < least:
        raise Truncated(f"{got['n']} rows of {least}")
    if len(ranged) != 1:
        raise NoScoreColumn(f"{len(ranged)} of {len(names)} columns can be the score")
    return ranged[0]


def records(spark: SparkSession, path: str, start: str, wanted: DataFrame | None = None) -> DataFrame:
    """(id, body) of text files of records, each begun by a line `start` followed by its id, read by byte
    ranges (gzip as a stream); `wanted` (id) keeps some."""
    return formats.records(spark, path, start, wanted).select("id", "body")


def weight_matrices(spark: SparkSession, path: str) -> DataFrame:
    """(name, weights): motifs of `>name` and rows of four numbers, first of a name; weights lie end to end."""
    return formats.weight_matrices(spark, path)


def named_columns(df: DataFrame, names: dict[str, str], key: str, prefix: str = "") -> DataFrame:
    """The named columns of a sheet under new names; missing ones are an error, rows without a key or
    with another prefix go."""
    if lost := [c for c in names if c not in df.columns]:
        raise ValueError(f"missing columns: {lost}")
    out = df.select([F.col(f"`{c}`").alias(n) for c, n in names.items()])
    return out.where(F.col(key).isNotNull() & F.startswith(F.col(key).cast("string"), F.lit(prefix)))


def bed(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, start, stop, summit) of tab-separated intervals; a summit of "." is null."""
    got = spark.read.csv(path, sep="\t", schema="chrom string, start long, stop long, summit string")
    return got.withColumn("summit", F.nullif(F.col("summit"), F.lit(".")).cast("long"))


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, head, seq) of every record; a sequence is in one row, without line ends, as proteins are.
    Chromosomes are read by formats.genome."""
    own = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("value"))
    head = F.split_part("value", F.lit("\n"), F.lit(1))
    seq = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "")
    return own.select(F.split_part(head, F.lit(" "), F.lit(1)).alias("name"), head.alias("head"), seq.alias("seq")).where("name <> ''")


def tiles(genome: DataFrame, width: int, size: int) -> DataFrame:
    """(chrom, tile, seq): sequences in tiles of `size`, each with the `width` - 1 letters that follow, so
    that a window of `width` lies in the tile of its start and no chromosome has to be whole in a task."""
    n = F.floor((F.greatest(F.length("seq"), F.lit(1)) - 1) / size)
    every = genome.select("chrom", "seq", F.explode(F.sequence(F.lit(0).cast("long"), n)).alias("tile"))
    return every.select("chrom", "tile", F.col("seq").substr((F.col("tile") * size + 1).cast("int"), F.lit(size + width - 1)).alias("seq"))


def cut_tiles(spans: DataFrame, tiled: DataFrame, width: int, size: int) -> DataFrame:
    """spans (chrom, start from 0) with their window by an equi-join with tiles; NULL off the end."""
    asked = spans.withColumn("tile", F.floor(F.col("start") / size))
    seq = F.col("seq").substr((F.col("start") - F.col("tile") * size + 1).cast("int"), F.lit(width))
    return asked.join(tiled, ["chrom", "tile"], "left").select("chrom", "start", F.when((F.col("start") >= 0) & (F.length(seq) == width), seq).alias("window"))


def lookup(keys: DataFrame, cache: DataFrame, key: str, value: str) -> DataFrame:
    """keys with a cached value and status: hit, miss (cached as known to be missing) or unknown."""
    own = cache.select(key, F.col(value).alias("_v"), F.lit(True).alias("_known")).dropDuplicates([key])
    got = keys.join(own, key, "left")
    found = F.nullif(F.col("_v"), F.lit(""))
    return got.select(*[keys[c] if c != key else F.col(key) for c in keys.columns], found.alias(value), F.when(found.isNotNull(), "hit").when(F.col("_known"), "miss").otherwise("unknown").alias("status"))


def catalog(spark: SparkSession, root: str, companions: tuple[str, ...] = ()) -> list[str]:
    """The source tables under a root, one folder each, but its companions."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()] if fs.exists(at) else []
    return sorted(n for n in names if n not in companions and not n.startswith(("_", ".")))


def whitelist(spark: SparkSession, path: str) -> DataFrame:
    """(family): the lines of a text without comments and blanks."""
    return spark.read.text(path).select(F.trim(F.split_part("value", F.lit("#"), F.lit(1))).alias("family")).where("family <> ''").distinct()


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def reconcile(df: DataFrame, group: str, replicate: str, site: str, score: str, label: str, reason: str) -> tuple[DataFrame, DataFrame]:
    """Replicates of each group and site as one row (common label or -1, mean score), and the unreadable
    ones (a reason is set) with their reasons. A group without a readable replicate, or whose replicates
    have different sites, is an error."""
    bad = df.where(F.col(reason).isNotNull())
    good = df.where(F.col(reason).isNull())
    none = df.select(group).distinct().join(good, group, "left_anti")
    cells = good.groupBy(group, site).agg(F.count_distinct(replicate).alias("k"), F.when(F.min(label) == F.max(label), F.min(label)).otherwise(-1).alias(label), F.avg(score).alias(score))
    uneven = cells.join(good.groupBy(group).agg(F.count_distinct(replicate).alias("n")), group).where("k <> n")
    if lost := none.limit(5).collect():
        raise ValueError(f"no readable replicate: {[r[0] for r in lost]}")
    if odd := uneven.select(group).distinct().limit(5).collect():
        raise ValueError(f"replicates differ in their sites: {[r[0] for r in odd]}")
    return cells.drop("k"), bad.select(group, replicate, reason).distinct()
