"""Holdouts over entities and chromosomes, planned windows with negative sets, run plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairbench.operators import splits


def variant_clusters(entities: DataFrame, cluster: str, family: str, is_variant: str, excluded: str) -> DataFrame:
    """All members of the clusters that hold a variant outside the excluded family."""
    ids = entities.where(F.col(is_variant) & (F.col(family) != excluded)).select(cluster).distinct()
    return entities.join(ids, cluster, "left_semi")


def family_holdout(entities: DataFrame, family: str, name: str) -> DataFrame:
    out = entities.where(F.col(family) == name)
    if out.isEmpty():
        raise ValueError(f"family {name} has no entity")
    return out


def chromosome_fold(windows: DataFrame, tf: str, chrom: str, share: float) -> DataFrame:
    """(tf, chrom, role): test for the windows' test chromosomes; of the others, whole chromosomes,
    smallest first, go to validation until `share` of the training windows is reached. windows: split."""
    size = windows.where("split <> 'test'")
    held = splits.smallest_first(size, chrom, share).select(chrom, F.lit("validation").alias("carved"))
    own = windows.select(tf, chrom, "split").distinct().join(held, chrom, "left")
    return own.select(tf, chrom, F.when(F.col("split") == "test", "test").otherwise(F.coalesce("carved", F.lit("train"))).alias("role"))


def two_axis(folds: DataFrame, tf: str, chroms: DataFrame, share: float, seed: str) -> DataFrame:
    """(fold, tf, chrom, role): a fold's own tfs on test chromosomes are its test; of the other tfs a
    share (at least one), by hash of seed and fold, validate on the rest; other cells of training tfs
    train. folds: tf, fold; chroms: chrom, split."""
    every = folds.select("fold").distinct().toDF("f").crossJoin(folds)  # folds x tfs, both few
    side = every.where("f <> fold").select(F.col("f").alias("fold"), tf)
    w = Window.partitionBy("fold")
    drawn = F.row_number().over(w.orderBy(F.sha2(F.concat_ws(":", F.lit(seed), "fold", tf), 256), tf))
    rest = side.withColumn("r", drawn).withColumn("n", F.count("*").over(w)).select("fold", tf, F.when(F.col("r") <= F.greatest(F.lit(1), F.bround(F.col("n") * share)), "validation").otherwise("train").alias("role"))
    tests = folds.select("fold", tf, F.lit("test").alias("role"))
    cells = rest.unionByName(tests).crossJoin(chroms)
    return cells.where((F.col("role") == "test") == (F.col("split") == "test")).select("fold", tf, "chrom", "role")


def plan_windows(df: DataFrame, groups: list[str], key: str, ratio: int, seed: str, whole: str) -> DataFrame:
    """All positives, all of the negative set `whole`, and of each other set at most `ratio` for each
    positive of its group, in hashed order. df: negset ('' for positives)."""
    w = Window.partitionBy(*groups)
    n_pos = F.count_if(F.col("negset") == "").over(w)
    draw = F.sha2(F.concat_ws(":", F.lit(seed), *groups, "negset", key), 256)
    ranked = df.withColumn("_p", n_pos).withColumn("_r", F.row_number().over(Window.partitionBy(*groups, "negset").orderBy(draw, key)))
    return ranked.where(F.col("negset").isin("", whole) | (F.col("_r") <= ratio * F.col("_p"))).drop("_p", "_r")


def realised(plan: DataFrame, groups: list[str], whole: str) -> DataFrame:
    """Per group: windows of each kind, and drawn negatives (of the two drawn sets) per positive and set."""
    n = lambda c: F.count_if(c)
    pos, drawn = n(F.col("negset") == ""), n(~F.col("negset").isin("", whole))
    return plan.groupBy(*groups).agg(pos.alias("n_pos"), n(F.col("negset") == whole).alias("n_whole"), drawn.alias("n_drawn"), F.round(drawn / F.nullif(2 * pos, F.lit(0)), 6).alias("ratio"))


def shared_chromosomes(plan: DataFrame, chrom: str) -> DataFrame:
    """Chromosomes that lie on both sides of a split; none if it is a partition."""
    n = plan.groupBy(chrom).agg(F.count_distinct("split").alias("n_splits"), F.count("*").alias("n"))
    return n.agg(F.count_if(F.col("n_splits") > 1).alias("n_shared"), F.count("*").alias("n_chroms"), F.sum("n").alias("n_windows"))


def select_rows(plan: DataFrame, tfs: list, chroms: list, negset: str) -> DataFrame:
    """Positives and one negative set of some tfs and chromosomes."""
    return plan.where(F.col("tf").isin(tfs) & F.col("chrom").isin(chroms) & F.col("negset").isin("", negset))


def sweep(axes: dict[str, list], done: DataFrame | None = None) -> DataFrame:
    """All combinations of a run plan's settings, without repeats and without those already done."""

    def axis(name: str, values: list) -> DataFrame:
        from pyspark.sql import SparkSession

        return SparkSession.active().createDataFrame([(v,) for v in dict.fromkeys(values)], [name])

    out = reduce(lambda a, b: a.crossJoin(b), [axis(k, v) for k, v in axes.items()])
    return out if done is None else out.join(done.select(*axes), list(axes), "left_anti")


def permuted(df: DataFrame, group: str, key: str, value: str, seed: str) -> DataFrame:
    """df with the values of each group dealt anew among its rows, by hashed order."""
    w = Window.partitionBy(group)
    by = F.row_number().over(w.orderBy(F.sha2(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")), 256), key))
    place = df.withColumn("_r", F.row_number().over(w.orderBy(key)))
    dealt = df.select(group, F.col(value).alias("dealt"), by.alias("_r"))
    return place.join(dealt, [group, "_r"]).drop("_r")


def overlap_shares(windows: DataFrame, hits: DataFrame, group: str, start: str) -> DataFrame:
    """Per group the share of its distinct windows that overlap another group's. hits: (g, s)."""
    own = windows.select(F.col(group).alias("g"), F.col(start).alias("s")).distinct()
    marked = own.join(hits.withColumn("hit", F.lit(1)), ["g", "s"], "left")
    return marked.groupBy("g").agg(F.count("*").alias("n"), F.count("hit").alias("n_hit"), F.round(F.count("hit") / F.count("*"), 6).alias("share"))


def transfer(columns: DataFrame, near: DataFrame) -> DataFrame:
    """(q, item, value): neighbours' standardised scores of every item, weighted by identity (negative
    as 0, alike if all are 0). columns: v, item, z; near: q, v, identity."""
    w = F.greatest("identity", F.lit(0.0))
    mixed = F.coalesce(F.sum(F.col("w") * F.col("z")) / F.nullif(F.sum("w"), F.lit(0.0)), F.avg("z"))
    return near.select("q", "v", w.alias("w")).join(columns, "v").groupBy("q", "item").agg(F.round(mixed, 5).alias("value"))


def admit(df: DataFrame, order: list[Column], group: str, ok: Column, banned: Column) -> DataFrame:
    """df's best row of each group (by `order`) with status: accepted, rejected or dropped (banned)."""
    best = df.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where("_r = 1").drop("_r")
    return best.withColumn("status", F.when(banned, "dropped").when(ok, "accepted").otherwise("rejected"))
