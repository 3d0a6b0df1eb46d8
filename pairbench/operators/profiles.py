"""Score profiles of entities: suppression, power, expected-count calls, site and audit summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairbench.operators import metrics


def suppression(cells: DataFrame, entity: str, group: str, site: str, value: str, label: str) -> DataFrame:
    """Of the sites that the group's reference (its least entity) binds (label 1), the share that an
    entity ranks strictly lower in its own profile over all sites; NULL without such sites."""
    own = cells.select(F.col(group).alias("g"), F.col(entity).alias("e"), F.col(site).alias("site"), metrics.average_rank([entity], value).alias("rank"), (F.col(label) == 1).alias("bound"))
    refs = own.groupBy("g").agg(F.min("e").alias("ref"))
    ref = own.join(refs, "g").where("e = ref").select("g", "site", F.col("rank").alias("ref_rank"), "bound")
    both = own.drop("bound").join(ref, ["g", "site"])
    share = F.count_if(F.col("bound") & (F.col("rank") < F.col("ref_rank"))) / F.nullif(F.count_if("bound"), F.lit(0))
    return both.groupBy(F.col("e").alias(entity)).agg(F.round(share, 6).alias("suppression"))


def power(m: DataFrame, *keys: str) -> DataFrame:
    """Summed probabilities (scores moved to 0..1)."""
    return m.groupBy(*keys).agg(F.round(F.sum(F.col("score") + 0.5), 6).alias("power"))


def power_ratio(m: DataFrame, inventory: DataFrame) -> DataFrame:
    """Each entity's power over that of its cluster's reference; NULL if that is not positive."""
    p = power(m, "cluster", "entity")
    ref = inventory.select("cluster", F.col("reference").alias("entity")).join(p, ["cluster", "entity"]).select("cluster", F.col("power").alias("ref"))
    return p.join(ref, "cluster").select("cluster", "entity", F.when(F.col("ref") > 0, F.round(F.col("power") / F.col("ref"), 6)).alias("ratio"))


def expected_count(m: DataFrame, g: str) -> DataFrame:
    """The cutoff that calls as many sites as the probabilities' sum, rounded half to even: infinite
    for none, the least probability for all. Scores are grouped before they are ordered."""
    p = m.groupBy(g, (F.col("score") + 0.5).alias("p")).agg(F.count("*").alias("n"))
    down = Window.partitionBy(g).orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
    total = Window.partitionBy(g)
    p = p.withColumn("to", F.sum("n").over(down)).withColumn("k", F.bround(F.round(F.sum(F.col("p") * F.col("n")).over(total), 6)).cast("long"))
    kth = F.max(F.when(F.col("to") >= F.col("k"), F.col("p")))
    return p.groupBy(g, "k").agg(F.when(F.col("k") <= 0, F.lit(float("inf"))).otherwise(F.coalesce(kth, F.min("p"))).alias("cutoff"))


def site_summary(m: DataFrame) -> DataFrame:
    return m.groupBy("site").agg(
        F.count_if(F.col("label") == 1).alias("n_pos"), F.count_if(F.col("label") == 0).alias("n_neg"), F.count_if(F.col("label") == -1).alias("n_nocall"), F.max("score").alias("max_score")
    )


def audit(m: DataFrame) -> DataFrame:
    """Invariants of a source: score bounds, centre, and share of positives."""
    return m.groupBy("source").agg(
        (F.min("score") < -0.5).alias("under"), (F.max("score") > 0.5).alias("over"), (F.min("score") > -0.3).alias("no_low"),
        (F.abs(F.median("score")) > 0.1).alias("off_centre"), (F.avg(F.when(F.col("label") == 1, 1.0).otherwise(0.0)) > 0.05).alias("many_positives"), F.count_distinct("site").alias("n_sites"),
    )


def noise(pairs: DataFrame) -> DataFrame:
    """Noise floor of replicate pairs: medians, pooled agreement on hard calls, flagged pairs."""
    return pairs.agg(
        F.count("*").alias("n_pairs"), F.round(F.median("jaccard"), 6).alias("median_jaccard"), F.round(F.median("rho"), 5).alias("median_rho"),
        F.count_if("low_jaccard").alias("n_low_jaccard"), F.count_if("low_rho").alias("n_low_rho"), F.round(1 - F.sum("n_differ") / F.nullif(F.sum("n_hard"), F.lit(0)), 6).alias("agreement"),
    )


def entity_view(survivors: DataFrame, inventory: DataFrame) -> DataFrame:
    """One row for each entity with its cluster's reference and size."""
    inv = inventory.select("cluster", "reference", "n_entities")
    return survivors.join(inv, "cluster", "left").select("entity", "source", "cluster", (F.col("reference") != F.col("entity")).alias("is_variant"), F.coalesce("n_entities", F.lit(1)).alias("n_entities"))


def reference_rows(survivors: DataFrame, inventory: DataFrame) -> DataFrame:
    """Row of each entity within its cluster and row of the cluster's reference, -1 for itself."""
    rows = survivors.select("cluster", "entity", F.row_number().over(Window.partitionBy("cluster").orderBy("entity")).alias("row"))
    refs = inventory.select("cluster", F.col("reference").alias("entity")).join(rows, ["cluster", "entity"]).select("cluster", F.col("entity").alias("ref"), F.col("row").alias("ref_row"))
    return rows.join(refs, "cluster", "left").select("entity", "row", F.when(F.col("ref") == F.col("entity"), -1).otherwise(F.coalesce("ref_row", F.lit(-1))).alias("reference_row"))


def weighted_profile(neighbours: DataFrame, profiles: DataFrame) -> DataFrame:
    """(q, pos, value): neighbours' profiles averaged by similarity, negative weights as 0, and alike if
    all are 0. neighbours: q, v, cosine; profiles: v, pos, x."""
    w = F.greatest(F.col("cosine"), F.lit(0.0))
    total, flat = F.sum(F.col("w") * F.col("x")) / F.nullif(F.sum("w"), F.lit(0.0)), F.avg("x")
    return neighbours.select("q", "v", w.alias("w")).join(profiles, "v").groupBy("q", "pos").agg(F.round(F.coalesce(total, flat), 5).alias("value"))
