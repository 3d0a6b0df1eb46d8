"""The training view of a corpus: usable rows, names and constructs by joins with fallbacks, complete
matrices, positions on canonical windows, report rows that combine two tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairbench.operators import domains, holdouts, ordering

#: Verdicts of records (fixed values).
NO_EVIDENCE, DEAD_VARIANT = "no_evidence", "dead_variant"


def trainable(verdict: Column, keep_dead: bool = True) -> Column:
    """Whether a record may be trained on: without evidence never, dead variants if they are kept."""
    return ~verdict.isin([NO_EVIDENCE] if keep_dead else [NO_EVIDENCE, DEAD_VARIANT])


def usable(rows: DataFrame, verdicts: DataFrame, keys: list[str], keep_dead: bool = True) -> DataFrame:
    """rows of records that may be trained on. A record without a verdict is kept, as one with a null key is."""
    return rows.join(verdicts.where(~trainable(F.col("verdict"), keep_dead)).select(*keys).distinct(), keys, "left_anti")


def with_names(records: DataFrame, names: DataFrame, keys: list[str], name: str, fallback: str, default: str = "(unnamed)") -> DataFrame:
    """records with `name` from a table of names, which may have several a key: its least non-null one. Keys
    meet if both are null too. Without one the record's own `fallback` stands in, and where that is null
    or empty, the default. No record is lost or repeated."""
    best = names.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min(name).alias("_name"))
    on = [records[k].eqNullSafe(best[f"_{k}"]) for k in keys]
    found = F.coalesce(F.nullif(F.coalesce("_name", F.col(fallback)), F.lit("")), F.lit(default))
    return records.join(best, on, "left").select(*records.columns, found.alias(name))


def constructs(experiments: DataFrame, plasmids: DataFrame, inserts: DataFrame, plasmid: str, insert: str, tf: str, seq: str) -> DataFrame:
    """experiments with their plasmid's insert, and the insert's sequence (trimmed, upper case) as made for
    the same tf: the second join has both as its key. Experiments without a sequence go; each (tf,
    plasmid) stays once, with its least insert and sequence."""
    one = plasmids.select(plasmid, insert)
    two = inserts.select(insert, tf, F.upper(F.trim(seq)).alias(seq))
    joined = experiments.select(tf, plasmid).distinct().join(one, plasmid, "left").join(two, [insert, tf], "left").where(F.col(seq).isNotNull())
    best = F.min(F.struct(insert, seq)).alias("b")
    return joined.groupBy(tf, plasmid).agg(best).select(tf, plasmid, f"b.{insert}", f"b.{seq}")


def panel(made: DataFrame, tf: str, plasmid: str, seq: str, full: Column, hits: Column, families: list[str], dropped: str, pad: int = 10) -> DataFrame:
    """One construct a tf (full-length ones first, then the longest, then the least plasmid) with its domain
    call and admission: accepted, dropped (its family is left out), or rejected with the call's status."""
    order = [F.desc("_full"), F.desc(F.length(seq)), F.col(plasmid)]
    own = made.withColumn("_full", full).withColumn("_r", F.row_number().over(Window.partitionBy(tf).orderBy(*order))).where("_r = 1")
    called = domains.call(own.withColumn("_hits", hits), seq, "_hits", families, pad)
    status = F.when(F.col("status") != "ok", F.col("status")).when(F.col("label") == dropped, "dropped").otherwise("accepted")
    return called.select(tf, plasmid, seq, "label", "first", "last", status.alias("admission"))


def common_groups(a: DataFrame, b: DataFrame, key: str, value: str, names: tuple[str, str]) -> DataFrame:
    """(key, both means, delta) of the keys that two result tables share."""
    x, y = (t.groupBy(key).agg(F.round(F.avg(value), 6).alias(n)) for t, n in zip((a, b), names, strict=True))
    return x.join(y, key).withColumn("delta", F.round(F.col(names[0]) - F.col(names[1]), 6))


def annotate(rows: DataFrame, entities: DataFrame, key: str, values: dict[str, Column]) -> DataFrame:
    """rows with columns of their entity; those that the entity table lacks get the given default. The
    table has each key once at most, or it is an error."""
    if twice := [r[0] for r in entities.groupBy(key).count().where("count > 1").orderBy(key).limit(5).collect()]:
        raise ValueError(f"more than one row: {twice}")
    own = entities.select(key, *[F.col(c).alias(f"_{c}") for c in values])
    return rows.join(own, key, "left").select(*rows.columns, *[F.coalesce(F.col(f"_{c}"), d).alias(c) for c, d in values.items()])


def complete_matrix(cells: DataFrame, row: str, col: str, value: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(matrix, rows, columns): the matrix as (row code, values in the order of column codes), and the
    dictionaries of both axes. A cell that occurs twice or is missing is an error, with examples."""
    some = lambda df: [tuple(r) for r in df.orderBy(row, col).limit(5).collect()]
    counted = cells.groupBy(row, col).agg(F.count("*").alias("n"))
    if twice := some(counted.where("n > 1").select(row, col)):
        raise ValueError(f"cells that occur more than once: {twice}")
    rows, cols = ordering.codes(cells, row, "row"), ordering.codes(cells, col, "col")
    n = cols.count()
    coded = cells.join(rows, row).join(cols, col)
    made = coded.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("col", F.col(value).alias("value")))).alias("x"))
    if thin := [r[0] for r in made.where(F.size("x") < n).join(rows, "row").orderBy(row).limit(5).select(row).collect()]:
        raise ValueError(f"rows with missing cells: {thin}")
    return made.select("row", F.transform("x", lambda c: c["value"]).alias("values")), rows, cols


def rebased(positions: Column, offset: Column, size: Column) -> Column:
    """1-based positions of a construct on its window: (kept, lost), those that fall outside are lost."""
    moved = F.transform(positions, lambda p: (p - offset).cast("int"))
    inside = lambda p: (p >= 1) & (p <= size)
    return F.struct(F.filter(moved, inside).alias("kept"), F.filter(moved, lambda p: ~inside(p)).alias("lost"))


def substitutions_only(profiles: DataFrame, ref: str, var: str) -> DataFrame:
    """Edit profiles (alignment.profiles) of alleles without insertions or deletions: their positions can
    be moved by a constant offset. Others are refused, with examples."""
    if bad := [tuple(r) for r in profiles.where("n_ins > 0 OR n_del > 0").select(ref, var, "n_ins", "n_del").orderBy(ref, var).limit(5).collect()]:
        raise ValueError(f"alleles with insertions or deletions: {bad}")
    return profiles


def score_histogram(scores: DataFrame, score: str, low: Column, high: Column, bins: int = 40) -> DataFrame:
    """(bin, edge, n, mark): equal bins from the least score, rounded down to 1/20, to the greatest, rounded
    up; the last bin is closed. mark: '<' where the negative cutoff lies, '>' where the positive one does
    (it wins in a bin of both). Empty bins have n = 0."""
    s = F.col(score)
    ends = scores.agg((F.floor(F.min(s) * 20) / 20).alias("lo"), (F.ceil(F.max(s) * 20) / 20).alias("hi"), F.max(low).alias("neg"), F.max(high).alias("pos")).where("hi > lo")
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.least(F.floor(F.round((s - F.col("lo")) / width, 9)), F.lit(bins - 1))
    counts = scores.crossJoin(F.broadcast(ends)).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
    every = ends.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"))
    at = lambda c: F.floor(F.round((c - F.col("lo")) / width, 9)) == F.col("bin")
    mark = F.when(at(F.col("pos")), ">").when(at(F.col("neg")), "<").otherwise("")
    return every.join(counts, "bin", "left").select("bin", F.round(F.col("lo") + F.col("bin") * width, 6).alias("edge"), F.coalesce("n", F.lit(0)).alias("n"), mark.alias("mark"))


def sequence_medoids(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(group, medoid, distance): each group's sequence with the least sum of distances to the others, ties to
    the longer one, then to the lesser. members: (group, seq), distinct; pairs: (group, a, b, distance),
    each once, those of no distance left out."""
    both = pairs.select("group", F.col("a").alias("seq"), "distance").unionByName(pairs.select("group", F.col("b").alias("seq"), "distance"))
    total = members.join(both.groupBy("group", "seq").agg(F.sum("distance").alias("d")), ["group", "seq"], "left").withColumn("d", F.coalesce("d", F.lit(0)))
    best = F.min(F.struct("d", (-F.length("seq")).alias("l"), "seq")).alias("m")
    return total.groupBy("group").agg(best).select("group", F.col("m.seq").alias("medoid"), F.col("m.d").alias("distance"))


def nulls_first(df: DataFrame, group: str, by: str, tie: str) -> DataFrame:
    """df with its place (from 1) in its group by a column, nulls first, then by another."""
    w = Window.partitionBy(group).orderBy(F.asc_nulls_first(by), tie)
    return df.withColumn("place", F.row_number().over(w))


def genomic_loss(pairs: DataFrame, g: str, weight: float = 0.0) -> DataFrame:
    """One row (bce, nce, loss) of scored windows (group, logit, cosine already scaled, label): the mean
    binary cross-entropy, and `weight` times the mean over groups with both labels of each positive's
    negative log share among itself and all of the group's negatives."""
    from pairbench.operators.evaluation import softplus

    own = pairs.where(F.col("label").isin(0, 1))
    bce = own.agg(F.avg(softplus(F.col("logit")) - F.col("label") * F.col("logit")).alias("bce"))
    negative = F.when(F.col("label") == 0, F.col("cosine"))
    rest = own.groupBy(g).agg(F.max(negative).alias("top"), F.count(negative).alias("n")).where("n > 0")
    near = own.join(rest, g)
    total = near.where("label = 0").groupBy(g).agg((F.max("top") + F.log(F.sum(F.exp(F.col("cosine") - F.col("top"))))).alias("all"))
    # -log(e^s / (e^s + e^all)) = softplus(all - s)
    per = own.where("label = 1").join(total, g).groupBy(g).agg(F.avg(softplus(F.col("all") - F.col("cosine"))).alias("x"))
    both = bce.crossJoin(per.agg(F.coalesce(F.avg("x"), F.lit(0.0)).alias("nce")))
    return both.select(F.round("bce", 5).alias("bce"), F.round("nce", 5).alias("nce"), F.round(F.col("bce") + weight * F.col("nce"), 5).alias("loss"))


def held_out(rows: DataFrame, fold: str, member: str, families: DataFrame, family: str, values: list[str]) -> DataFrame:
    """Per fold: the number of its members, their families (sorted, '?' if unknown), and means of values."""
    joined = rows.join(families.select(member, family), member, "left")
    kinds = F.array_join(F.array_sort(F.collect_set(F.coalesce(F.col(family).cast("string"), F.lit("?")))), ", ")
    means = [F.round(F.avg(v), 6).alias(v) for v in values]
    return joined.groupBy(fold).agg(F.count_distinct(member).alias("n_members"), kinds.alias("families"), *means)


def best_relative(rows: DataFrame, member: str, values: list[str], near: DataFrame) -> DataFrame:
    """Per member: means of values, and its greatest identity to a neighbour. near: (member, identity)."""
    top = near.groupBy(member).agg(F.max("identity").alias("identity"))
    return rows.groupBy(member).agg(*[F.round(F.avg(v), 6).alias(v) for v in values]).join(top, member, "left")


def gathered(keys: DataFrame, vectors: DataFrame, key: str, vector: str, fill: float = 0.0) -> DataFrame:
    """keys with their ragged vectors padded to the widest, and a mask of what is real; a key without a
    vector is an error. The width comes from one aggregate over the keys asked for."""
    joined = keys.join(vectors.select(key, F.col(vector).alias("x")), key, "left")
    width, lost = joined.agg(F.max(F.size("x")), F.count_if(F.col("x").isNull())).first()
    if lost:
        raise KeyError(f"{lost} keys have no vector")
    n = F.lit(width or 0) - F.size("x")
    real, pad = F.transform("x", lambda _: F.lit(True)), F.array_repeat(F.lit(False), n)
    return joined.select(*keys.columns, F.concat(F.transform("x", lambda v: v.cast("double")), F.array_repeat(F.lit(fill), n)).alias("padded"), F.concat(real, pad).alias("mask"))


def stamps(runs: DataFrame, stamp: str, group: str) -> DataFrame:
    """(group, stamps, n): the distinct code stamps behind each group of results; more than one is a mixture."""
    own = runs.where(F.col(stamp).isNotNull()).groupBy(group).agg(F.array_sort(F.collect_set(stamp)).alias("x"))
    return own.select(group, F.array_join("x", ",").alias("stamps"), F.size("x").alias("n"))


def tag(name: Column) -> Column:
    """A file's tag: colons become dashes, and points of numbers become p."""
    return F.regexp_replace(F.regexp_replace(name, ":", "-"), r"(\d)\.(\d)", "$1p$2")


def own_motif(scans: DataFrame, train: Column) -> DataFrame:
    """(tf, choice, ap) for each tf's best motif and kind of score by average precision, from training rows
    only. scans: (tf, motif, best, total, label)."""
    from pairbench.operators import metrics

    long = scans.where(train).select("tf", "label", F.explode(F.array(*[F.struct(F.concat_ws(":", "motif", F.lit(k)).alias("choice"), F.col(k).alias("score")) for k in ("best", "total")])).alias("s"))
    ap = metrics.average_precision(long.select(F.struct("tf", "s.choice").alias("g"), "s.score", "label"), "g")
    w = Window.partitionBy("g.tf").orderBy(F.desc_nulls_last("ap"), "g.choice")
    return ap.withColumn("r", F.row_number().over(w)).where("r = 1").select("g.tf", "g.choice", "ap")


def standardised_transfer(columns: DataFrame, near: DataFrame, k: int) -> DataFrame:
    """(q, item, value): the k nearest neighbours' scores of every item, each neighbour's column brought to
    mean 0 and deviation 1 first, weighted by identity. columns: (v, item, x); near: (q, v, identity, rank)."""
    from pairbench.operators import evaluation

    z = evaluation.standardised(columns.withColumnRenamed("x", "score"), "v", "score")
    return holdouts.transfer(z, near.where(F.col("rank") <= k))
