"""Queries of the guarded lookup on vectors: every fifth vector is held out, signs are the calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairbench.operators import lookup, vectors
from pairbench.plans.catalog import BOTH
from pairbench.sources.tables import table

K, GUARD = 5, 0.55

GUARDED = f"""s AS (SELECT a.vec_id AS q, b.vec_id AS v, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (sign(z[1]) = sign(z[2]))::INT)) / len(a.embedding) AS overlap
    FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id % 5 = 0 AND b.vec_id % 5 <> 0),
  g AS (SELECT s.q, s.v, b.cosine, overlap, row_number() OVER (PARTITION BY s.q ORDER BY b.cosine DESC, s.v) AS rank FROM s JOIN b ON b.q = s.q AND b.v = s.v WHERE overlap >= {GUARD}),
  n AS (SELECT * FROM g WHERE rank <= {K}),
  x AS (SELECT vec_id AS v, unnest(range(len(embedding)))::INT AS pos, (unnest(embedding) > 0)::INT::DOUBLE AS x FROM embeddings),
  c AS (SELECT q, pos, round(coalesce(sum(greatest(cosine, 0) * x) / nullif(sum(greatest(cosine, 0)), 0), avg(x)), 6) AS value, false AS fallback FROM n JOIN x USING (v) GROUP BY q, pos),
  f AS (SELECT pos, round(avg(x), 6) AS value FROM x WHERE v % 5 <> 0 GROUP BY pos),
  y AS (SELECT * FROM c UNION ALL SELECT vec_id, pos, value, true FROM embeddings CROSS JOIN f WHERE vec_id % 5 = 0 AND vec_id NOT IN (SELECT q FROM n))"""
SCORES = f"""{GUARDED}, t AS (SELECT q, value AS score, (x.x = 1)::INT AS label FROM y JOIN x ON x.v = y.q AND x.pos = y.pos),
  o AS (SELECT q, score, sum(label) AS h, count(*) AS n FROM t GROUP BY q, score),
  r AS (SELECT *, sum(h) OVER d AS hits, sum(n) OVER d AS rows_, sum(h) OVER w AS tot, sum(n) OVER w AS all_ FROM o
    WINDOW d AS (PARTITION BY q ORDER BY score DESC ROWS UNBOUNDED PRECEDING), w AS (PARTITION BY q))"""


def _held(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").withColumn("held", F.col("vec_id") % 5 == 0)


def _calls(e: DataFrame) -> DataFrame:
    cells = e.select(F.col("vec_id").alias("v"), F.posexplode("embedding").alias("pos", "x"))
    return lookup.binary_calls(cells.withColumn("x", F.when(F.col("x") > 0, 1).otherwise(0)))


def _near(s: SparkSession, d: str) -> DataFrame:
    return lookup.neighbours(_held(s, d), "held", K, GUARD)


def _predict(s: SparkSession, d: str) -> DataFrame:
    e = _held(s, d)
    ids = e.select("held", F.col("vec_id").alias("v"))
    return lookup.predict(lookup.neighbours(e, "held", K, GUARD), _calls(e), ids.where("held").select(F.col("v").alias("q")), ids.where("NOT held").select("v"))


def _score(s: SparkSession, d: str) -> DataFrame:
    truth = _calls(_held(s, d)).select(F.col("v").alias("q"), "pos", F.col("x").cast("int").alias("label"))
    return lookup.score(_predict(s, d), truth).select("q", "ap", "auroc", "n_called", "n_true", "f1")


def _graph(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "embeddings")
    return lookup.joint_graph(vectors.nearest(e, 3), _near(s, d))


CATALOG = [
    ("guarded_neighbours", _near, f"WITH {BOTH}, {GUARDED} SELECT q, v, cosine, overlap, rank FROM n"),
    ("guarded_predict", lambda s, d: _predict(s, d).groupBy("q", "fallback").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")),
     f"WITH {BOTH}, {GUARDED} SELECT q, fallback, count(*) AS n, round(sum(value), 2) AS total FROM y GROUP BY ALL"),
    ("guarded_scores", _score, f"""WITH {BOTH}, {SCORES} SELECT q, round(sum(h / nullif(tot, 0) * hits / rows_), 6) AS ap,
       round((sum(h * (all_ - rows_ + (n + 1) / 2.0)) - max(tot) * (max(tot) + 1) / 2.0) / nullif(max(tot) * (max(all_) - max(tot)), 0), 6) AS auroc,
       coalesce(sum(n) FILTER (score >= 0.5), 0)::BIGINT AS n_called, max(tot)::BIGINT AS n_true,
       round(2 * coalesce(sum(h) FILTER (score >= 0.5), 0) / nullif(coalesce(sum(n) FILTER (score >= 0.5), 0) + max(tot), 0), 6) AS f1 FROM r GROUP BY q"""),
    ("joint_graph", _graph, f"""WITH {BOTH}, {GUARDED}, k AS (SELECT q, v, row_number() OVER (PARTITION BY q ORDER BY cosine DESC, v) AS rank FROM b),
       j AS (SELECT q, v, 'a' AS kind FROM k WHERE rank <= 3 UNION ALL SELECT q, v, 'b' FROM n)
       SELECT least(q, v) AS u, greatest(q, v) AS v, array_to_string(list_sort(list(DISTINCT kind)), '') AS kinds, count(*) AS n FROM j GROUP BY least(q, v), greatest(q, v)"""),
]
