"""Vectors: cosine edges in families, components, medoids, k-nearest lookup, pooling.

Pairs of a family are never a row join: a family is cut into blocks of vectors, and each two blocks
meet in a task of their own as one matrix product, which sends on only what the operator keeps (edges,
sums, or each vector's best). Vectors that are null, or have no length, have no cosine.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1024
Emit = Callable[[pa.Table, pa.Table, np.ndarray, bool], pa.Table]


def matrix(column: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    """A column of vectors; a null component is not a number."""
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.split(x, np.cumsum(pc.list_value_length(rows).to_numpy())[:-1]) if len(rows) else []


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def cosines(a: pa.ChunkedArray, b: pa.ChunkedArray) -> np.ndarray:
    """All cosines of two columns of vectors, rounded to 5 places. Vectors of different widths, and those
    with a component that is not finite, have none: their cosine is minus infinity."""
    x, y = matrix(a), matrix(b)
    out = np.full((len(x), len(y)), -np.inf)

    def good(rows: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
        own = [i for i, r in enumerate(rows) if len(r) == n]
        m = np.stack([rows[i] for i in own])
        keep = np.isfinite(m).all(1) & m.any(1)
        return np.array(own)[keep], m[keep]

    for n in ({len(r) for r in x} & {len(r) for r in y}) - {0}:
        (p, u), (q, v) = good(x, n), good(y, n)
        out[np.ix_(p, q)] = np.round(unit(u) @ unit(v).T, 5) + 0.0
    return out


def products(e: DataFrame, group: str, key: str, vector: str, emit: Emit, schema: str, block: int = BLOCK) -> DataFrame:
    """What `emit` makes of each two blocks of a group. It is given both blocks' rows, their cosines
    (rounded to 5 places) and whether the two are one block."""
    parts = e.groupBy(group).agg(F.floor(F.count("*") / block).alias("_parts"))
    own = e.where(F.exists(vector, lambda x: x != 0)).join(parts, group).withColumn("_own", F.pmod(F.xxhash64(key), F.col("_parts") + 1))
    meet = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_parts")), lambda j: F.struct(F.least("_own", j).alias("i"), F.greatest("_own", j).alias("j")))
    dealt = own.withColumn("_at", F.explode(meet)).withColumn("_i", F.col("_at.i")).withColumn("_j", F.col("_at.j")).drop("_at", "_parts")

    def run(t: pa.Table) -> pa.Table:
        i, j = t.column("_i")[0].as_py(), t.column("_j")[0].as_py()
        side = t.column("_own").to_numpy()
        a = t.filter(pa.array(side == i)).sort_by(key)
        b = a if i == j else t.filter(pa.array(side == j)).sort_by(key)
        return emit(a, b, cosines(a.column(vector), b.column(vector)), i == j)

    return dealt.groupBy(group, "_i", "_j").applyInArrow(run, schema)


def _directed(e: DataFrame, emit: Callable[[np.ndarray, np.ndarray, np.ndarray], dict], schema: str) -> DataFrame:
    """`emit` sees every vector of a family with each block of the others: ids, the others' ids, cosines
    (NaN with itself)."""

    def run(a: pa.Table, b: pa.Table, c: np.ndarray, same: bool) -> pa.Table:
        x, y = a.column("vec_id").to_numpy(), b.column("vec_id").to_numpy()
        if same:
            c = np.where(x[:, None] == y[None, :], np.nan, c)
        got = [emit(x, y, c)] + ([] if same else [emit(y, x, c.T)])
        label = a.column("label")[0].as_py() if len(a) else b.column("label")[0].as_py() if len(b) else None
        cols = {k: np.concatenate([g[k] for g in got]) for k in got[0]}
        return pa.table({"label": pa.array([label] * len(next(iter(cols.values()))), pa.int32()), **cols})

    return products(e.select(F.col("label").cast("int").alias("label"), "vec_id", "embedding"), "label", "vec_id", "embedding", run, schema)


def edges(e: DataFrame, least: float) -> DataFrame:
    """(label, i, j, cosine): pairs i < j of a family with at least this cosine."""

    def emit(x: np.ndarray, y: np.ndarray, c: np.ndarray) -> dict:
        p, q = np.nonzero((c >= least) & (x[:, None] < y[None, :]))
        return {"i": x[p], "j": y[q], "cosine": c[p, q]}

    return _directed(e, emit, "label int, i long, j long, cosine double")


def medoids(e: DataFrame) -> DataFrame:
    """Each family's vector with the least sum of distances, ties to the lower id."""

    def emit(x: np.ndarray, y: np.ndarray, c: np.ndarray) -> dict:
        some = np.isfinite(c)
        return {"v": x, "d": np.where(some, 1 - np.where(some, c, 0), 0).sum(1), "n": some.sum(1)}

    total = _directed(e, emit, "label int, v long, d double, n long").groupBy("label", "v").agg(F.round(F.sum("d"), 4).alias("distance"), F.sum("n").alias("n")).where("n > 0")
    best = F.min(F.struct("distance", "v")).alias("m")
    return total.groupBy("label").agg(best).select("label", F.col("m.v").alias("medoid"), F.col("m.distance").alias("distance"))


def nearest(e: DataFrame, k: int, eligible: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(label, q, v, cosine, rank): each vector's k most similar of its family, ties to the lower id; at
    most k a block leave a task. `eligible` masks pairs by their ids."""

    def emit(x: np.ndarray, y: np.ndarray, c: np.ndarray) -> dict:
        c = np.where(np.isnan(c) | (~eligible(x, y) if eligible else False), -np.inf, c)
        top = np.argsort(-c, axis=1, kind="stable")[:, :k]
        row = np.repeat(np.arange(len(x)), top.shape[1])
        best = c[row, top.ravel()]
        ok = best > -np.inf
        return {"q": x[row[ok]], "v": y[top.ravel()[ok]], "cosine": best[ok]}

    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("cosine"), "v"))
    return _directed(e, emit, "label int, q long, v long, cosine double").withColumn("rank", rank).where(F.col("rank") <= k)


def farther_share(e: DataFrame) -> DataFrame:
    """(q, farther): of a vector's relatives but its family's medoid, the share farther than the medoid.
    Each vector takes its cosine with the medoid into the products, and only two counts of it leave a
    block."""
    own = e.select("label", "vec_id", "embedding")
    centre = medoids(e).select("label", "medoid")
    core = own.join(centre.withColumnRenamed("medoid", "vec_id"), ["label", "vec_id"]).select("label", F.col("vec_id").alias("medoid"), F.col("embedding").alias("centre"))

    def near(batches):
        for t in batches:
            x, y = (matrix(t.column(n)) for n in ("embedding", "centre"))
            c = np.array([np.round(unit(a[None]) @ unit(b[None]).T, 5)[0, 0] if a.any() and len(a) == len(b) else np.nan for a, b in zip(x, y, strict=True)])
            yield pa.RecordBatch.from_arrays([*t.drop_columns(["centre"]).columns, pa.array(c + 0.0)], names)

    names = ["label", "vec_id", "embedding", "medoid", "bound"]
    home = own.where(F.exists("embedding", lambda x: x != 0)).join(core, "label").select(*names[:4], "centre")
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in home.schema][:4]
    bounded = home.mapInArrow(near, ", ".join([*kinds, "bound double"]))

    def run(a: pa.Table, b: pa.Table, c: np.ndarray, same: bool) -> pa.Table:
        def emit(t: pa.Table, u: pa.Table, m: np.ndarray) -> dict:
            x, y, own, bound = t.column("vec_id").to_numpy(), u.column("vec_id").to_numpy(), t.column("medoid").to_numpy(), t.column("bound").to_numpy()
            other = (x[:, None] != y[None, :]) & (y[None, :] != own[:, None]) & np.isfinite(m)
            return {"q": x, "far": (other & (m < bound[:, None])).sum(1), "n": other.sum(1), "medoid": own}

        got = [emit(a, b, c)] + ([] if same else [emit(b, a, c.T)])
        return pa.table({k: np.concatenate([g[k] for g in got]) for k in got[0]})

    counts = products(bounded, "label", "vec_id", "embedding", run, "q long, far long, n long, medoid long")
    total = counts.where("q <> medoid").groupBy("q").agg(F.sum("far").alias("far"), F.sum("n").alias("n"))
    return total.select("q", F.round(F.col("far") / F.nullif("n", F.lit(0)), 6).alias("farther"))


def pool(e: DataFrame) -> DataFrame:
    cells = e.select("label", F.posexplode("embedding").alias("pos", "x"))
    return cells.groupBy("label", "pos").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))
