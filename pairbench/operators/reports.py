"""Report tables: coverage audits, per-fold and per-group summaries, verdict lines, small renderers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def coverage(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, status): both, only_a or only_b, for the distinct keys of two tables."""
    x, y = a.select(key).distinct().withColumn("in_a", F.lit(True)), b.select(key).distinct().withColumn("in_b", F.lit(True))
    return x.join(y, key, "full").select(key, F.when(F.col("in_a") & F.col("in_b"), "both").when(F.col("in_a"), "only_a").otherwise("only_b").alias("status"))


def collisions(df: DataFrame, key: str, owner: str) -> DataFrame:
    """Keys that more than one owner uses."""
    return df.groupBy(key).agg(F.count_distinct(owner).alias("n_owners")).where("n_owners > 1")


def starved(df: DataFrame, group: str, bad: Column) -> DataFrame:
    """Groups of which every row is bad."""
    return df.groupBy(group).agg(F.count("*").alias("n"), F.count_if(bad).alias("n_bad")).where("n = n_bad").select(group, "n")


def source_audit(m: DataFrame, rows_per_entity: int) -> DataFrame:
    """A source's structure: entities whose rows are not as many as expected, entities whose places
    differ from the source's, its largest cluster, the median one, and whether the largest is over
    both 12 and six times the median."""
    entity = m.groupBy("source", "entity").agg(F.count("*").alias("n"), F.count_distinct("slot").alias("k"), F.min("cluster").alias("cluster"))
    places = m.groupBy("source").agg(F.count_distinct("slot").alias("places"))
    sizes = entity.groupBy("source", "cluster").agg(F.count("*").alias("size")).groupBy("source").agg(F.max("size").alias("largest"), F.median("size").alias("typical"))
    own = entity.join(places, "source").groupBy("source").agg(F.count_if(F.col("n") != rows_per_entity).alias("n_odd_rows"), F.count_if(F.col("k") != F.col("places")).alias("n_odd_places"))
    return own.join(sizes, "source").withColumn("oversized", F.col("largest") > F.greatest(F.lit(12), 6 * F.col("typical")))


def duplicate_cells(df: DataFrame, entity: str, site: str) -> DataFrame:
    """Cells of a matrix that have more than one row."""
    return df.groupBy(entity, site).agg(F.count("*").alias("n")).where("n > 1")


def missing_keys(wanted: DataFrame, have: DataFrame, key: str) -> DataFrame:
    """Keys asked for that a table lacks; a lookup is valid if there are none."""
    return wanted.select(key).distinct().join(have, key, "left_anti")


def order_mismatches(a: DataFrame, b: DataFrame, row: str, key: str) -> DataFrame:
    """Rows at which two ordered tables disagree (0 if they are aligned)."""
    both = a.select(row, F.col(key).alias("x")).join(b.select(row, F.col(key).alias("y")), row, "full")
    return both.agg(F.count_if(~F.col("x").eqNullSafe(F.col("y"))).alias("n_mismatches"), F.count("*").alias("n_rows"))


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of one table and not the other, with their side."""
    x, y = a.distinct(), b.distinct()
    return x.subtract(y).withColumn("side", F.lit("a")).unionByName(y.subtract(x).withColumn("side", F.lit("b")))


def by_fold(df: DataFrame, keys: list[str], pivot: str, values: list, value: str) -> DataFrame:
    """Mean and median of a value by keys, one pair of columns for each pivot value."""
    cells = [(f(F.when(F.col(pivot) == v, F.col(value))), f"{n}_{v}") for v in values for n, f in (("mean", F.avg), ("median", F.median))]
    return df.groupBy(*keys).agg(*[F.round(c, 6).alias(n) for c, n in cells])


def mean_sd(frames: list[DataFrame], keys: list[str], value: str) -> DataFrame:
    """Several tables by name, as mean, spread (ddof 1) and number by keys."""
    every = frames[0]
    for f in frames[1:]:
        every = every.unionByName(f)
    return every.groupBy(*keys).agg(F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_samp(value), 6).alias("sd"), F.count("*").alias("n"))


def fold_members(df: DataFrame, fold: str, member: str, family: str) -> DataFrame:
    """Per fold: its members and families, in order, as text."""
    text = lambda c: F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), ", ")
    return df.groupBy(fold).agg(F.count_distinct(member).alias("n"), text(family).alias("families"))


def cluster_report(m: DataFrame) -> DataFrame:
    """Per cluster: rows, whether its reference is present, most edits; and the family's share of
    clusters, dominant over 40 %."""
    c = m.groupBy("cluster").agg(F.min("family").alias("family"), F.count("*").alias("n_rows"), F.bool_or(F.col("n_mut") == 1).alias("has_reference"), F.max("n_mut").alias("max_edits"))
    share = F.count("*").over(Window.partitionBy("family")) / F.count("*").over(Window.partitionBy())
    return c.withColumn("share", F.round(share, 6)).withColumn("dominant", F.col("share") > 0.4)


def small_to_other(df: DataFrame, group: str, least: int) -> DataFrame:
    """(group, n): groups under `least` rows are one group, 'other'."""
    n = df.groupBy(group).agg(F.count("*").alias("n"))
    return n.groupBy(F.when(F.col("n") < least, "other").otherwise(F.col(group).cast("string")).alias("group")).agg(F.sum("n").alias("n"), F.count("*").alias("n_groups"))


def tier_names(df: DataFrame, tier: str, order: str, key: str) -> DataFrame:
    """Running names within each tier: the tier and a number of four digits."""
    nth = F.row_number().over(Window.partitionBy(tier).orderBy(F.desc(order), key))
    return df.select(key, F.concat_ws("-", F.col(tier), F.lpad(nth.cast("string"), 4, "0")).alias("name"))


def verdict(m: DataFrame, group: str, arm: str, value: str, control: str) -> DataFrame:
    """A line for each group: the arm with the highest median, and whether it beats the control's."""
    per = m.groupBy(group, arm).agg(F.round(F.median(value), 6).alias("med"))
    own = per.groupBy(group).agg(F.max(F.struct("med", arm)).alias("best"), F.max(F.when(F.col(arm) == control, F.col("med"))).alias("base"))
    text = F.when(F.col("base").isNull(), "no control").when(F.col("best.med") > F.col("base"), F.concat(F.lit("better: "), F.col(f"best.{arm}"))).otherwise("control holds")
    return own.select(group, text.alias("verdict"))


def manifest_check(listed: DataFrame, present: DataFrame, key: str, ancillary: str) -> DataFrame:
    """(key, status) of a manifest against what is there: filed, missing, unfiled or ancillary."""
    both = coverage(listed, present, key)
    return both.select(key, F.when(F.col("status") == "both", "filed").when(F.col("status") == "only_a", "missing").when(F.col(key).rlike(ancillary), "ancillary").otherwise("unfiled").alias("status"))


def markdown(df: DataFrame, most: int = 200) -> str:
    """A small result as a markdown table; over `most` rows is an error, as reports are small."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rows")
    show = lambda v: "" if v is None else f"{v:,}" if isinstance(v, int) and not isinstance(v, bool) else f"{v:.4g}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = [df.columns, ["-"] * len(df.columns), *[[show(v) for v in r] for r in rows]]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines) + "\n"
