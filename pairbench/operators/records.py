"""Records (entity, source): summaries, verdicts, duplicate resolution, inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairbench.operators import metrics


def summary(m: DataFrame) -> DataFrame:
    return m.groupBy("entity", "source").agg(
        F.min("cluster").alias("cluster"), F.min("family").alias("family"), F.count("*").alias("n_rows"), F.max("score").alias("max_score"),
        F.count_if(F.col("label") == 1).alias("n_pos"), F.count_if(F.col("label") == 0).alias("n_neg"), F.count_if(F.col("label") == -1).alias("n_gray"),
    )


def verdicts(m: DataFrame) -> DataFrame:
    """ok with a positive; dead_variant if only another record of the cluster and source has one."""
    alive = F.max("n_pos").over(Window.partitionBy("cluster", "source")) > 0
    return summary(m).withColumn("verdict", F.when(F.col("n_pos") > 0, "ok").when(alive, "dead_variant").otherwise("no_evidence"))


def resolve(m: DataFrame) -> DataFrame:
    """The best record of every entity: in a series first, then more positives, higher maximum, source."""
    series = F.count("*").over(Window.partitionBy("cluster", "source")) > 1
    best = Window.partitionBy("entity").orderBy(F.desc("in_series"), F.desc("n_pos"), F.desc("max_score"), "source")
    return summary(m).withColumn("in_series", series).withColumn("rank", F.row_number().over(best))


def survivors(m: DataFrame) -> DataFrame:
    return resolve(m).where("rank = 1").select("entity", "source", "cluster", "family", "n_rows", "n_pos", "max_score", "in_series")


def surviving_rows(m: DataFrame) -> DataFrame:
    losers = resolve(m).where("rank > 1").select("entity", "source")
    return m.join(losers, ["entity", "source"], "left_anti")


def source_summary(m: DataFrame) -> DataFrame:
    out = verdicts(m).groupBy("source").agg(
        F.count("*").alias("n_records"), F.median("max_score").alias("median_max"), F.sum("n_pos").alias("n_pos"), F.sum("n_neg").alias("n_neg"), F.count_if(F.col("verdict") != "ok").alias("n_silent")
    )
    return out.withColumn("frac_silent", F.round(F.col("n_silent") / F.col("n_records"), 6))


def inventory(m: DataFrame) -> DataFrame:
    """One row for each cluster; its reference is the entity with the fewest edits, then the least."""
    return m.groupBy("cluster").agg(
        F.min("family").alias("first_family"), F.count_distinct("entity").alias("n_entities"), F.count_distinct("source").alias("n_sources"), F.count("*").alias("n_rows"),
        F.min_by("entity", F.struct("n_mut", "entity")).alias("reference"), F.max("n_mut").alias("max_edits"),
        F.count_distinct(F.when(F.col("n_mut") > 1, F.col("entity"))).alias("n_variants"), F.count_distinct(F.when(F.col("label") == 1, F.col("entity"))).alias("n_positive_entities"),
    )


def dominance(m: DataFrame, most: float = 0.01) -> DataFrame:
    n = m.groupBy("family").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6)).withColumn("dominant", F.col("share") > most)


def replicate_reconcile(m: DataFrame) -> DataFrame:
    """One row per entity, source and site: the common label or -1, and the mean score."""
    same = F.min("label") == F.max("label")
    return m.groupBy("entity", "source", "site").agg(F.when(same, F.min("label")).otherwise(-1).alias("label"), F.round(F.avg("score"), 6).alias("score"), F.count("*").alias("n_replicates"))


def replicate_pairs(m: DataFrame) -> DataFrame:
    """Agreement of each two sources of an entity on the places (slots) that both measured: places in
    common, hard calls on both sides, differing ones, Jaccard of positives, Spearman of scores, and
    flags for Jaccard under 0.2 and rho under 0.3. Only entities with two sources are paired."""
    one = m.groupBy("entity", "source", "slot").agg(F.when(F.min("label") == F.max("label"), F.min("label")).otherwise(-1).alias("label"), F.round(F.avg("score"), 6).alias("score"))
    many = m.groupBy("entity").agg(F.count_distinct("source").alias("n")).where("n > 1").select("entity")
    one = one.join(many, "entity", "left_semi")
    a, b = (one.select("entity", "slot", *[F.col(c).alias(f"{c}_{x}") for c in ("source", "label", "score")]) for x in "ab")
    pairs = a.join(b, ["entity", "slot"]).where("source_a < source_b")
    key = ["entity", "source_a", "source_b"]
    rank = [metrics.average_rank(key, c).alias(r) for c, r in (("score_a", "ra"), ("score_b", "rb"))]
    hard = (F.col("label_a") != -1) & (F.col("label_b") != -1)
    both, some = F.count_if(hard & (F.col("label_a") + F.col("label_b") == 2)), F.count_if(hard & (F.col("label_a") + F.col("label_b") >= 1))
    out = pairs.select("*", *rank).groupBy(key).agg(
        F.count("*").alias("n_common"), F.count_if(hard).alias("n_hard"), F.count_if(hard & (F.col("label_a") != F.col("label_b"))).alias("n_differ"),
        F.round(both / F.nullif(some, F.lit(0)), 6).alias("jaccard"), F.round(metrics.pearson("ra", "rb"), 5).alias("rho"),
    )
    return out.withColumn("low_jaccard", F.col("jaccard") < 0.2).withColumn("low_rho", F.col("rho") < 0.3)


def pair_ids(m: DataFrame) -> DataFrame:
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("entity", "source", "site", "replicate")])
    return m.select(F.substring(F.sha2(text, 256), 1, 24).alias("pair_id")).groupBy("pair_id").agg(F.count("*").alias("n"))


def checks(m: DataFrame) -> DataFrame:
    """Checks on the distinct values of the checked axis, weighted by their rows."""
    axis = m.groupBy("label", "family", "replicate").agg(F.count("*").alias("n"))
    bad = {"label": ~F.col("label").isin(-1, 0, 1), "family_upper": F.col("family") != F.upper("family"), "replicate": ~F.col("replicate").isin("O", "F")}
    wide = axis.agg(*[F.coalesce(F.sum(F.when(b, F.col("n"))), F.lit(0)).alias(k) for k, b in bad.items()])
    return wide.unpivot([], list(bad), "check", "n_rows")
