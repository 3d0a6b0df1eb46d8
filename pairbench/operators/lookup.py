"""Guarded k-nearest lookup: neighbours on a training side, their profiles copied, a fallback counted."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairbench.operators import metrics, vectors


def binary_calls(profiles: DataFrame, value: str = "x") -> DataFrame:
    """Profiles as copied: positives 1.0, all else (no-calls too) 0.0."""
    return profiles.withColumn(value, F.when(F.col(value) == 1, 1.0).otherwise(0.0))


def neighbours(e: DataFrame, held: str, k: int, least_overlap: float) -> DataFrame:
    """(q, v, cosine, overlap, rank): for each vec_id with `held`, its k most similar vectors of the
    family without it, ties to the lower id. Guard: the two agree in sign on at least `least_overlap`
    of their places. A vector with fewer than k has as many rows as it has."""
    if e.where(~F.col(held)).isEmpty():
        raise ValueError("empty training pool: there is nothing to copy from")

    def signs(t: pa.Table) -> np.ndarray:
        rows = t.column("embedding").combine_chunks()
        return np.sign(rows.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(rows), -1))

    def run(a: pa.Table, b: pa.Table, c: np.ndarray, same: bool) -> pa.Table:
        sides = [(a, b, c)] + ([] if same else [(b, a, c.T)])
        out: list[list] = [[], [], [], []]
        for x, y, m in sides:
            if not len(x) or not len(y):
                continue
            p, q = signs(x), signs(y)
            share = ((p > 0).astype(np.float32) @ (q > 0).T + (p < 0).astype(np.float32) @ (q < 0).T + (p == 0).astype(np.float32) @ (q == 0).T) / p.shape[1]
            fit = x.column(held).to_numpy()[:, None] & ~y.column(held).to_numpy()[None, :] & (share >= least_overlap)
            m = np.where(fit, m, -np.inf)
            top = np.argsort(-m, axis=1, kind="stable")[:, :k]
            row = np.repeat(np.arange(len(x)), top.shape[1])
            col = top.ravel()
            ok = m[row, col] > -np.inf
            row, col = row[ok], col[ok]
            for into, v in zip(out, (x.column("vec_id").to_numpy()[row], y.column("vec_id").to_numpy()[col], m[row, col], share[row, col].astype(np.float64)), strict=True):
                into.append(v)
        cols = [np.concatenate(o) if o else np.zeros(0) for o in out]
        return pa.table({"q": pa.array(cols[0], pa.int64()), "v": pa.array(cols[1], pa.int64()), "cosine": pa.array(cols[2], pa.float64()), "overlap": pa.array(cols[3], pa.float64())})

    own = e.select("label", "vec_id", "embedding", held)
    got = vectors.products(own, "label", "vec_id", "embedding", run, "q long, v long, cosine double, overlap double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("cosine"), "v"))
    return got.withColumn("rank", rank).where(F.col("rank") <= k)


def predict(near: DataFrame, profiles: DataFrame, queries: DataFrame, train: DataFrame) -> DataFrame:
    """(q, pos, value, fallback): similarity-weighted mean of the neighbours' profiles (negative weights
    as 0, alike if all are 0); queries without a neighbour get the mean training profile. profiles: v,
    pos, x; queries: q; train: v."""
    w = F.greatest(F.col("cosine"), F.lit(0.0))
    mixed = F.coalesce(F.sum(F.col("w") * F.col("x")) / F.nullif(F.sum("w"), F.lit(0.0)), F.avg("x"))
    copied = near.select("q", "v", w.alias("w")).join(profiles, "v").groupBy("q", "pos").agg(F.round(mixed, 6).alias("value"), F.lit(False).alias("fallback"))
    mean = profiles.join(train, "v", "left_semi").groupBy("pos").agg(F.round(F.avg("x"), 6).alias("value"))
    alone = queries.join(near, "q", "left_anti").select("q")
    # One row for each place of a profile, which is a vector's width.
    return copied.unionByName(alone.crossJoin(mean).select("q", "pos", "value", F.lit(True).alias("fallback")))


def score(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Per query: AP, AUROC and call scores of the predicted values against true labels (q, pos, label)."""
    both = predicted.join(truth, ["q", "pos"]).select("q", F.col("value").alias("score"), "label")
    return metrics.average_precision(both, "q").join(metrics.auroc(both, "q"), "q").join(metrics.calls(both, "q", 0.5), "q")


def joint_graph(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union of two neighbour tables (q, v, cosine), each edge once with the kinds it comes from."""
    both = a.select("q", "v", F.lit("a").alias("kind")).unionByName(b.select("q", "v", F.lit("b").alias("kind")))
    return both.groupBy(F.least("q", "v").alias("u"), F.greatest("q", "v").alias("v")).agg(F.array_join(F.array_sort(F.collect_set("kind")), "").alias("kinds"), F.count("*").alias("n"))
