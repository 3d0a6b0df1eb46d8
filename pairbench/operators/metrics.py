"""Ranking and calibration metrics per group; no-call rows are masked, undefined is NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairbench.operators import ordering


def scored(df: DataFrame) -> DataFrame:
    return df.where("label <> -1")


def runs(df: DataFrame, g: str) -> DataFrame:
    """One row per group and score, with hits and rows so far from the top."""
    own = scored(df).groupBy(g, "score").agg(F.sum("label").alias("h"), F.count("*").alias("n"))
    down = Window.partitionBy(g).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(g)
    return own.select(g, "score", "h", "n", F.sum("h").over(down).alias("hits"), F.sum("n").over(down).alias("rows"), F.sum("h").over(every).alias("tot"), F.sum("n").over(every).alias("all"))


def average_precision(df: DataFrame, g: str) -> DataFrame:
    step = F.col("h") / F.nullif(F.col("tot"), F.lit(0)) * F.col("hits") / F.col("rows")
    return runs(df, g).groupBy(g).agg(F.round(F.sum(step), 6).alias("ap"), F.max("tot").alias("n_pos"), F.max("all").alias("n"))


def auroc(df: DataFrame, g: str) -> DataFrame:
    below = F.col("all") - F.col("rows")
    rank = F.sum(F.col("h") * (below + (F.col("n") + 1) / 2.0))
    p, n = F.max("tot"), F.max("all") - F.max("tot")
    return runs(df, g).groupBy(g).agg(F.round((rank - p * (p + 1) / 2.0) / F.nullif(p * n, F.lit(0)), 6).alias("auroc"))


def precision_at(df: DataFrame, g: str, k: int) -> DataFrame:
    before = F.col("rows") - F.col("n")
    take = F.least(F.col("n"), F.greatest(F.lit(k) - before, F.lit(0)))
    return runs(df, g).groupBy(g).agg(F.when(F.max("all") >= k, F.round(F.sum(F.col("h") * take / F.col("n")) / k, 6)).alias("p_at_k"))


def recall_at(df: DataFrame, g: str, least: float) -> DataFrame:
    good = F.when(F.col("hits") / F.col("rows") >= least, F.col("hits") / F.nullif(F.col("tot"), F.lit(0)))
    return runs(df, g).groupBy(g).agg(F.when(F.max("tot") > 0, F.round(F.coalesce(F.max(good), F.lit(0.0)), 6)).alias("recall"))


def average_rank(part: list[str], value: str) -> Column:
    tied = F.count("*").over(Window.partitionBy(*part, value))
    return F.rank().over(Window.partitionBy(*part).orderBy(value)) + (tied - 1) / 2.0


def pearson(x: str, y: str) -> Column:
    """Pearson's r as an aggregate; NULL without variance on either side."""
    a, b, n = F.col(x), F.col(y), F.count(F.col(x) + F.col(y))
    cov = F.sum(a * b) - F.try_divide(F.sum(a) * F.sum(b), n)
    spread = (F.sum(a * a) - F.try_divide(F.sum(a) * F.sum(a), n)) * (F.sum(b * b) - F.try_divide(F.sum(b) * F.sum(b), n))
    return F.when((F.min(a) < F.max(a)) & (F.min(b) < F.max(b)), F.try_divide(cov, F.sqrt(F.greatest(spread, F.lit(0.0)))))


def spearman(df: DataFrame, g: str, x: str, y: str) -> DataFrame:
    ranked = df.select(g, average_rank([g], x).alias("rx"), average_rank([g], y).alias("ry"))
    return ranked.groupBy(g).agg(F.round(pearson("rx", "ry"), 5).alias("rho"))


def macro(df: DataFrame, g: str) -> DataFrame:
    both = average_precision(df, g).join(auroc(df, g), g)
    return both.agg(F.round(F.avg("ap"), 5).alias("ap"), F.count("ap").alias("n_ap"), F.round(F.avg("auroc"), 5).alias("auroc"), F.count("auroc").alias("n_auroc"))


def chance(df: DataFrame, g: str) -> DataFrame:
    rate = scored(df).groupBy(g).agg(F.avg("label").alias("rate")).where("rate > 0")
    return rate.agg(F.round(F.avg("rate"), 6).alias("chance_ap"), F.count("*").alias("n"))


def calls(df: DataFrame, g: str, cut: float) -> DataFrame:
    called, true = F.count_if(F.col("score") >= cut), F.sum("label")
    hit = F.count_if((F.col("score") >= cut) & (F.col("label") == 1))
    none = F.lit(0)
    return scored(df).groupBy(g).agg(
        called.alias("n_called"), true.alias("n_true"), F.round(hit / F.nullif(called, none), 6).alias("precision"), F.round(hit / F.nullif(true, none), 6).alias("recall"),
        F.round(2 * hit / F.nullif(called + true, none), 6).alias("f1"), F.round(hit / F.nullif(called + true - hit, none), 6).alias("jaccard"),
    )


def ece(df: DataFrame, p: Column, bins: int = 15) -> DataFrame:
    """Expected calibration error over bins of equal mass (the first n % bins get one more). Rows are
    grouped by p before the global order; rows that tie share their mean label."""
    rows = scored(df).groupBy(p.alias("p")).agg(F.count("*").alias("n"), F.avg("label").alias("y"))
    own, total = ordering.running(rows, ["p"], "n", before="from")
    own = own.withColumn("to", F.col("from") + F.col("n"))
    q, r = divmod(total, bins)

    def begin(b: Column) -> Column:
        return b * q + F.least(b, F.lit(r))

    def bin_of(at: Column) -> Column:
        return ordering.tile(at, total, bins)

    cut = own.select("*", F.explode(F.sequence(bin_of(F.col("from")), bin_of(F.col("to") - 1))).alias("bin"))
    part = F.least(F.col("to"), begin(F.col("bin") + 1)) - F.greatest(F.col("from"), begin(F.col("bin")))
    per = cut.withColumn("part", part).groupBy("bin").agg(F.sum("part").alias("n"), F.abs(F.sum(F.col("part") * (F.col("p") - F.col("y")))).alias("gap"))
    return per.agg(F.round(F.sum("gap") / F.sum("n"), 6).alias("ece"))
