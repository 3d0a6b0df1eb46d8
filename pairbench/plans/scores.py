"""Queries of the evaluation operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairbench.operators import evaluation, metrics, records
from pairbench.plans.catalog import AP, AUC, RUNS, VERDICTS, M
from pairbench.sources.tables import measurements, table

REPEATS = 10
G = f"g AS (SELECT source, {AP} AS ap, {AUC} AS auroc, max(tot)::BIGINT AS n_pos, max(all_)::BIGINT AS n FROM r GROUP BY source)"
NULL = f"""k AS (SELECT source, sum(label) AS k, count(*) AS n FROM m WHERE label <> -1 GROUP BY source HAVING sum(label) > 0),
  e AS (SELECT source, k, draw, unnest(range(1, n + 1)) AS spot FROM k, range({REPEATS}) t(draw)),
  h AS (SELECT *, row_number() OVER (PARTITION BY draw, source ORDER BY sha256('null:' || draw::VARCHAR || ':' || source::VARCHAR || ':' || spot::VARCHAR)) AS r FROM e),
  q AS (SELECT draw, source, spot, row_number() OVER (PARTITION BY draw, source ORDER BY spot) AS i FROM h WHERE r <= k),
  a AS (SELECT draw, source, avg(i / spot) AS ap FROM q GROUP BY ALL), z AS (SELECT draw, round(avg(ap), 6) AS ap FROM a GROUP BY draw)"""
FRAME = f"""u AS (SELECT entity, score, sum(label) AS h, count(*) AS n FROM m WHERE label <> -1 GROUP BY ALL),
  x AS (SELECT *, sum(h) OVER d AS hits, sum(n) OVER d AS rows_, sum(h) OVER w AS tot, sum(n) OVER w AS all_ FROM u
    WINDOW d AS (PARTITION BY entity ORDER BY score ROWS UNBOUNDED PRECEDING), w AS (PARTITION BY entity)),
  p AS (SELECT entity, {AP} AS ap FROM x GROUP BY entity), b AS (SELECT entity, min(family) AS family, max(verdict) AS verdict FROM v GROUP BY entity),
  f AS (SELECT b.entity, family, verdict, ap, 1 + b.entity % 2 * 4 AS k, CASE WHEN b.entity % 3 = 0 THEN 'f0' ELSE 'all' END AS fold FROM b LEFT JOIN p USING (entity)),
  c AS (SELECT *, CASE WHEN ap IS NULL THEN 'dead' ELSE 'low' END AS reason FROM f WHERE k = 1 AND fold = 'all' AND verdict <> 'no_evidence' AND (ap IS NULL OR ap < 0.25))"""
PAIRED = """e AS (SELECT label, vec_id, embedding::DOUBLE[] AS x FROM embeddings),
  s AS (SELECT a.label, a.vec_id AS q, b.vec_id AS v, round(5 * list_sum(list_transform(list_zip(a.x, b.x), lambda z: z[1] * z[2])) - 1, 6) AS logit
    FROM e a JOIN e b ON a.label = b.label AND a.vec_id % 10 = 0 AND b.vec_id % 10 <> 0)"""


def _m(f):
    return lambda s, d: f(measurements(s, d))


def _samples(m: DataFrame) -> DataFrame:
    return evaluation.null_samples(m, "source", REPEATS, "null")


def _frame(m: DataFrame) -> DataFrame:
    """A held-out frame: AP of rising scores by entity, the entity's verdict, and k and fold by its number."""
    v = records.verdicts(m).groupBy("entity").agg(F.min("family").alias("family"), F.max("verdict").alias("verdict"))
    ap = metrics.average_precision(m.withColumn("score", -F.col("score")), "entity").select("entity", "ap")
    return v.join(ap, "entity", "left").withColumn("k", 1 + F.col("entity") % 2 * 4).withColumn("fold", F.when(F.col("entity") % 3 == 0, "f0").otherwise("all"))


def _hard_summary(m: DataFrame) -> DataFrame:
    frame = _frame(m)
    return evaluation.hard_summary(evaluation.hard_set(frame), frame, "family")


def _pairs(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings")
    q = e.where("vec_id % 10 = 0").select("label", F.col("vec_id").alias("q"), F.col("embedding").alias("x"))
    k = e.where("vec_id % 10 <> 0").select("label", F.col("vec_id").alias("v"), F.col("embedding").alias("y"))
    return evaluation.pair_scores(q, k, "label", 5.0, -1.0)


def _losses(s: SparkSession, d: str) -> DataFrame:
    pairs = _pairs(s, d).drop("label")
    return evaluation.losses(pairs.withColumn("label", F.when(F.col("v") % 3 == 0, 1).when(F.col("v") % 3 == 1, 0).otherwise(-1)), "q")


def _displacement(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings")
    x, y = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("x")), e.select((F.col("vec_id") - 1).alias("id"), F.col("embedding").alias("y"))
    return evaluation.displacement(x.join(y, "id").withColumn("at", (F.col("id") % 64 + 1).cast("int")))


def _ceiling(s: SparkSession, d: str) -> DataFrame:
    cells = measurements(s, d).groupBy(F.col("cluster").alias("entity"), F.col("source").alias("site")).agg(F.max("label").alias("label"))
    return evaluation.rank_ceiling(cells, [1, 4, 16])


def _cos(x: str, y: str) -> str:
    return f"list_sum(list_transform(list_zip({x}, {y}), lambda z: z[1] * z[2])) / sqrt(list_sum(list_transform({x}, lambda z: z * z)) * list_sum(list_transform({y}, lambda z: z * z)))"


_SLICE = "{0}[greatest(spot - 5, 1):least(spot + 5, 64)]"
CATALOG = [
    ("random_null", _m(_samples), f"WITH {M}, {NULL} SELECT draw::INT AS draw, ap FROM z"),
    ("null_band", _m(lambda m: evaluation.null_band(_samples(m))), f"WITH {M}, {NULL} SELECT round(avg(ap), 5) AS random_mean, round(quantile_cont(ap, 0.95), 5) AS random_p95 FROM z"),
    ("at_chance", _m(lambda m: evaluation.at_chance(m, "source", evaluation.null_band(_samples(m)))),
     f"WITH {RUNS.replace(', r AS', ', rr AS')}, {NULL}, y AS (SELECT round(quantile_cont(ap, 0.95), 5) AS p95 FROM z), g AS (SELECT source, {AP} AS ap FROM rr GROUP BY source) SELECT source, ap, ap <= p95 AS at_chance FROM g CROSS JOIN y"),
    ("lift_over_chance", _m(lambda m: evaluation.lift(m, "source")), f"""WITH {RUNS}, {G}, w AS (SELECT *, ap * n / n_pos AS lift FROM g WHERE ap IS NOT NULL AND auroc IS NOT NULL)
       SELECT count(*) AS n_groups, round(avg(ap), 5) AS mean_ap, round(median(ap), 5) AS median_ap, round(min(ap), 5) AS min_ap, round(max(ap), 5) AS max_ap,
       round(avg(auroc), 5) AS mean_auroc, round(median(auroc), 5) AS median_auroc, round(min(auroc), 5) AS min_auroc, round(max(auroc), 5) AS max_auroc, round(avg(lift), 5) AS lift FROM w"""),
    ("training_rate", _m(evaluation.training_rate), f"WITH {M} SELECT round(coalesce(least(greatest(avg(label), 1e-6), 1 - 1e-6), 0.002), 8) AS rate FROM m WHERE label <> -1"),
    ("hard_set", _m(lambda m: evaluation.hard_set(_frame(m)).select("entity", "family", "verdict", "ap", "reason")), f"WITH {VERDICTS}, {FRAME} SELECT entity, family, verdict, ap, reason FROM c"),
    ("hard_set_by_family", _m(_hard_summary), f"""WITH {VERDICTS}, {FRAME} SELECT f.family, count(*) AS n_variants, count(c.entity) AS n_in_set, count(*) FILTER (c.reason = 'dead') AS n_dead, round(count(c.entity) / count(*), 6) AS fraction
       FROM f LEFT JOIN c ON c.entity = f.entity GROUP BY f.family"""),
    ("selection_gain", _m(lambda m: evaluation.selection(m, "replicate", "cluster", "source", "score", "F")), f"""WITH {M}, p AS (SELECT replicate, cluster, avg(score) AS m, stddev_samp(score) AS sd FROM m GROUP BY ALL),
       o AS (SELECT replicate, round(avg(m), 6) AS mean, round(avg(sd), 6) AS spread FROM p GROUP BY 1)
       SELECT o.replicate, o.mean, o.spread, round(o.mean - b.mean, 6) AS gain, o.mean >= b.mean - coalesce(b.spread, 0) AS survives FROM o CROSS JOIN (SELECT * FROM o WHERE replicate = 'F') b"""),
    ("split_auc", _m(lambda m: evaluation.split_auc(m, "source")), f"WITH {RUNS}, {G} SELECT source, auroc, round(sqrt(auroc * (1 - auroc) / nullif(least(n_pos, n - n_pos), 0)), 6) AS error FROM g"),
    ("standardised_rows", _m(lambda m: evaluation.standardised(m, "cluster", "score").groupBy("cluster", "z").agg(F.count("*").alias("n"))), f"""WITH {M}, z AS (SELECT cluster, round((score - avg(score) OVER w) / CASE WHEN stddev_pop(score) OVER w = 0 THEN 1 ELSE stddev_pop(score) OVER w END, 5) AS z
       FROM m WINDOW w AS (PARTITION BY cluster)) SELECT cluster, z, count(*) AS n FROM z GROUP BY ALL"""),
    ("pair_scores", _pairs, f"WITH {PAIRED} SELECT *, round(1 / (1 + exp(-logit)), 6) AS p FROM s"),
    ("pair_losses", _losses, f"""WITH {PAIRED}, t AS (SELECT q, logit, CASE v % 3 WHEN 0 THEN 1 ELSE 0 END AS y, max(logit) OVER (PARTITION BY q) AS top FROM s WHERE v % 3 <> 2),
       l AS (SELECT q, ln(sum(exp(logit - any_top))) - ln(sum(exp(logit - any_top)) FILTER (y = 1)) AS nce, avg(greatest(logit, 0) + ln(1 + exp(-abs(logit))) - y * logit) AS bce FROM (SELECT *, top AS any_top FROM t) GROUP BY q)
       SELECT q, round(nce, 5) AS nce, round(bce, 5) AS bce, round(0.5 * nce + 0.5 * bce, 5) AS hybrid FROM l"""),
    ("displacement", _displacement, f"""WITH p AS (SELECT a.vec_id AS id, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y, a.vec_id % 64 + 1 AS spot FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
       w AS (SELECT *, {_SLICE.format("x")} AS u, {_SLICE.format("y")} AS v FROM p)
       SELECT id, round(abs(x[spot] - y[spot]), 5) AS site, round(1 - {_cos("u", "v")}, 5) AS "window", round(1 - {_cos("x", "y")}, 5) AS pooled FROM w"""),
    ("rank_ceiling", _ceiling, None),
]
