"""Queries on windows and holdouts. Events stand in for windows: their type is the factor, their user's
number the chromosome, low values and the event number give positives and three negative sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairbench.operators import holdouts, splits, vectors, windows
from pairbench.plans.catalog import BOTH, M, events
from pairbench.sources.tables import measurements, table

W = """w AS (SELECT event_id, event_type AS tf, user_id % 22 AS chrom, CASE WHEN user_id % 22 % 4 = 0 THEN 'test' ELSE 'train' END AS split,
    CASE WHEN value > 120 THEN '' WHEN event_id % 3 = 0 THEN 'shades' WHEN event_id % 3 = 1 THEN 'alien' ELSE 'random' END AS negset FROM events)"""
PLAN = f"""{W}, k AS (SELECT *, count(*) FILTER (negset = '') OVER (PARTITION BY tf, split) AS p,
    row_number() OVER (PARTITION BY tf, split, negset ORDER BY sha256('plan:' || tf || ':' || split || ':' || negset || ':' || event_id::VARCHAR), event_id) AS r FROM w),
  plan AS (SELECT event_id, tf, chrom, split, negset FROM k WHERE negset IN ('', 'shades') OR r <= 2 * p)"""
CARVE = f"""{W}, c AS (SELECT chrom, count(*) AS n FROM w WHERE split <> 'test' GROUP BY chrom),
  h AS (SELECT chrom FROM (SELECT chrom, coalesce(sum(n) OVER (ORDER BY n, chrom ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER () * 0.2 AS target FROM c) WHERE before < target)"""
AXES = f"""{W}, t AS (SELECT DISTINCT tf FROM w), o AS (SELECT tf, ntile(3) OVER (ORDER BY sha256('axes:' || tf), tf) AS fold FROM t), f AS (SELECT DISTINCT fold FROM o),
  s AS (SELECT f.fold, o.tf, row_number() OVER (PARTITION BY f.fold ORDER BY sha256('carve:' || f.fold::VARCHAR || ':' || tf), tf) AS r, count(*) OVER (PARTITION BY f.fold) AS n FROM f JOIN o ON o.fold <> f.fold),
  x AS (SELECT fold, tf, CASE WHEN r <= greatest(1, round_even(n * 0.25, 0)) THEN 'validation' ELSE 'train' END AS role FROM s UNION ALL SELECT fold, tf, 'test' FROM o)"""


def planned(s: SparkSession, d: str) -> DataFrame:
    chrom = F.col("user_id") % 22
    kind = F.when(F.col("value") > 120, "").when(F.col("event_id") % 3 == 0, "shades").when(F.col("event_id") % 3 == 1, "alien").otherwise("random")
    return table(s, d, "events").select("event_id", F.col("event_type").alias("tf"), chrom.alias("chrom"), F.when(chrom % 4 == 0, "test").otherwise("train").alias("split"), kind.alias("negset"))


def _plan(s: SparkSession, d: str) -> DataFrame:
    return holdouts.plan_windows(planned(s, d), ["tf", "split"], "event_id", 2, "plan", "shades")


def _axes(s: SparkSession, d: str) -> DataFrame:
    w = planned(s, d)
    folds = splits.balanced_folds(w, "tf", 3, "axes").select("tf", "fold")
    return holdouts.two_axis(folds, "tf", w.select("chrom", "split").distinct(), 0.25, "carve")


def _variants(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "part").withColumn("is_variant", F.col("p_size") > 45)
    return holdouts.variant_clusters(e, "p_brand", "p_type", "is_variant", "ECONOMY").select("p_partkey", "p_brand", "is_variant")


def _transfer(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings")
    near = vectors.nearest(e, 3).select("q", "v", F.col("cosine").alias("identity"))
    return holdouts.transfer(e.select(F.col("vec_id").alias("v"), F.posexplode("embedding").alias("item", "x")).select("v", "item", F.col("x").cast("double").alias("z")), near)


def _admit(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "part")
    best = [F.desc("p_retailprice"), F.asc("p_partkey")]
    return holdouts.admit(p, best, "p_name", F.col("p_size") % 3 != 0, F.col("p_type") == "ECONOMY").select("p_name", "p_partkey", "status")


def _sweep(s: SparkSession, d: str) -> DataFrame:
    done = table(s, d, "part").select(F.col("p_type").alias("arm"), (F.col("p_size") % 4).alias("fold"), (F.col("p_partkey") % 3).alias("seed")).where("fold < 2").distinct()
    arms = [r[0] for r in table(s, d, "part").select("p_type").distinct().orderBy("p_type").collect()]
    return holdouts.sweep({"arm": arms, "fold": [0, 1, 2, 3, 0], "seed": [0, 1, 2]}, done)


def _shares(s: SparkSession, d: str) -> DataFrame:
    e = events(s, d)
    return holdouts.overlap_shares(e, windows.overlapping(e, "event_type", "start", 301), "event_type", "start")


def _constant(s: SparkSession, d: str) -> DataFrame:
    """Every vector replaced by the mean of all: (pos, mean)."""
    return table(s, d, "embeddings").select(F.posexplode("embedding").alias("pos", "x")).groupBy("pos").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


CATALOG = [
    ("planned_windows", _plan, f"WITH {PLAN} SELECT * FROM plan"),
    ("realised_ratio", lambda s, d: holdouts.realised(_plan(s, d), ["tf", "split"], "shades"), f"""WITH {PLAN} SELECT tf, split, count(*) FILTER (negset = '') AS n_pos, count(*) FILTER (negset = 'shades') AS n_whole,
       count(*) FILTER (negset NOT IN ('', 'shades')) AS n_drawn, round(count(*) FILTER (negset NOT IN ('', 'shades')) / nullif(2 * count(*) FILTER (negset = ''), 0), 6) AS ratio FROM plan GROUP BY ALL"""),
    ("shared_chromosomes", lambda s, d: holdouts.shared_chromosomes(_plan(s, d), "chrom"), f"WITH {PLAN}, c AS (SELECT chrom, count(DISTINCT split) AS k, count(*) AS n FROM plan GROUP BY 1) SELECT count(*) FILTER (k > 1) AS n_shared, count(*) AS n_chroms, sum(n)::BIGINT AS n_windows FROM c"),
    ("window_selector", lambda s, d: holdouts.select_rows(_plan(s, d), ["click", "view"], [1, 2, 3], "random"), f"WITH {PLAN} SELECT * FROM plan WHERE tf IN ('click', 'view') AND chrom IN (1, 2, 3) AND negset IN ('', 'random')"),
    ("window_counts", lambda s, d: planned(s, d).groupBy("tf", "chrom").agg(F.count("*").alias("n")), f"WITH {W} SELECT tf, chrom, count(*) AS n FROM w GROUP BY ALL"),
    ("chromosome_fold", lambda s, d: holdouts.chromosome_fold(planned(s, d), "tf", "chrom", 0.2), f"WITH {CARVE} SELECT DISTINCT tf, chrom, CASE WHEN split = 'test' THEN 'test' WHEN chrom IN (SELECT chrom FROM h) THEN 'validation' ELSE 'train' END AS role FROM w"),
    ("two_axis_holdout", _axes, f"WITH {AXES} SELECT fold, tf, chrom, role FROM x CROSS JOIN (SELECT DISTINCT chrom, split FROM w) WHERE (role = 'test') = (split = 'test')"),
    ("variant_clusters", _variants, "SELECT p_partkey, p_brand, p_size > 45 AS is_variant FROM part WHERE p_brand IN (SELECT p_brand FROM part WHERE p_size > 45 AND p_type <> 'ECONOMY')"),
    ("motif_transfer", _transfer, f"""WITH {BOTH}, k AS (SELECT q, v, greatest(cosine, 0.0) AS w FROM b QUALIFY row_number() OVER (PARTITION BY q ORDER BY cosine DESC, v) <= 3),
       x AS (SELECT vec_id AS v, unnest(range(len(embedding)))::INT AS item, unnest(embedding)::DOUBLE AS z FROM embeddings) SELECT q, item, round(coalesce(sum(w * z) / nullif(sum(w), 0), avg(z)), 5) AS value FROM k JOIN x USING (v) GROUP BY q, item"""),
    ("panel_admission", _admit, """SELECT p_name, p_partkey, CASE WHEN p_type = 'ECONOMY' THEN 'dropped' WHEN p_size % 3 <> 0 THEN 'accepted' ELSE 'rejected' END AS status
       FROM part QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_retailprice DESC, p_partkey) = 1"""),
    ("sweep_resume", _sweep, """SELECT arm, fold, seed FROM (SELECT DISTINCT p_type AS arm FROM part) CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS fold) CROSS JOIN (SELECT unnest([0, 1, 2]) AS seed)
       WHERE (arm, fold, seed) NOT IN (SELECT (p_type, p_size % 4, p_partkey % 3) FROM part WHERE p_size % 4 < 2)"""),
    ("cobinding_shares", _shares, """WITH e AS (SELECT DISTINCT event_type AS g, (epoch_us(ts) // 1000000)::BIGINT AS s FROM events), h AS (SELECT *, EXISTS (SELECT 1 FROM e x WHERE x.g <> e.g AND abs(x.s - e.s) < 301) AS hit FROM e)
       SELECT g, count(*) AS n, count(*) FILTER (hit) AS n_hit, round(count(*) FILTER (hit) / count(*), 6) AS share FROM h GROUP BY g"""),
    ("permutation_null", lambda s, d: holdouts.permuted(table(s, d, "part").select("p_brand", "p_partkey", "p_size"), "p_brand", "p_partkey", "p_size", "null"), """WITH p AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r,
       row_number() OVER (PARTITION BY p_brand ORDER BY sha256('null:' || p_partkey::VARCHAR), p_partkey) AS h FROM part) SELECT a.p_brand, a.p_partkey, a.p_size, b.p_size AS dealt FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.r = b.h"""),
    ("ablate_constant", _constant, "SELECT pos, round(avg(x), 6) AS mean FROM (SELECT unnest(range(len(embedding)))::INT AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY pos"),
    ("control_flags", lambda s, d: measurements(s, d).groupBy("cluster", "source").agg(F.bool_or(F.col("label") == 1).alias("control"), F.count("*").alias("n")), f"WITH {M} SELECT cluster, source, bool_or(label = 1) AS control, count(*) AS n FROM m GROUP BY ALL"),
]
