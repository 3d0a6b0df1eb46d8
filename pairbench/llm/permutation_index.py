"""Approximate nearest neighbours by a permutation index.

A vector is represented by its LENGTH nearest of PIVOTS pivots, in order. Each pivot's inverted file
holds the vectors that have it among theirs, with its place in their order. A query walks the files
of its own pivots and adds up how much each vector's places agree (the truncated footrule distance:
sum of |place differences|, a missing pivot counts as place LENGTH). The nearest `depth` share by that
distance (ties to the smaller id) are reranked by the exact inner product in double precision. Copies of a
vector are one entry of the index: they are counted once for the depth, which is a share of all rows, and
found together.

Pivots are the first PIVOTS distinct vectors in a hashed order of their values: a bounded sample; all vectors
are indexed. Vectors have the width that most of the usable ones have, the smaller one of equals. Queries and vectors meet block by block, each block pair in one task of bounded size, and
the block results merge by a window per query. Vectors that are null or zero, or hold null or
non-finite components, or are of another width, take no part; nor do null ids. Ids can be of any type that orders. Rows that
repeat an id are separate candidates, each returned, but none is a candidate for its own id; a query id
that repeats asks once, with its least vector. An empty table gives an empty result; extra columns are
ignored. Recall of 20 with these settings is in the README; nothing depends on a block's size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PIVOTS, LENGTH, DEPTH = 256, 80, 0.2
BLOCK, QUERY_BLOCK = 16_384, 2_048


def places(x: np.ndarray, pivots: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's nearest pivots in order, and the place of every pivot (length where missing)."""
    near = np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :length]
    place = np.full((len(x), len(pivots)), length, np.int16)
    np.put_along_axis(place, near, np.arange(near.shape[1], dtype=np.int16)[None, :], 1)
    return near, place


def search(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, pivots: np.ndarray, k: int, depth: float, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of each query's best k among x."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    group: dict[bytes, int] = {}
    same = np.array([group.setdefault(v.tobytes(), len(group)) for v in x + 0.0], np.int64)  # by their first ids
    members = np.argsort(same, kind="stable")
    size = np.bincount(same, minlength=len(group))
    begin = np.cumsum(size) - size
    x = x[members[begin]]
    length = min(length, len(pivots))
    _, place = places(x, pivots, length)
    files = []
    for p in range(len(pivots)):
        own = np.flatnonzero(place[:, p] < length)
        files.append((own.astype(np.int32), place[own, p]))
    near, _ = places(queries, pivots, length)
    at, where = np.arange(length)[:, None], np.arange(length)[None, :]
    saving = ((length - at) + (length - where) - np.abs(where - at)).astype(np.int16)  # LENGTH places: at most 2 * LENGTH ** 2 in all
    take = min(len(x), max(k + 1, int(np.ceil(depth * len(ids)))))  # distinct vectors, as many as the share of all rows
    own_rows = dict(zip(*(a.tolist() for a in np.unique(ids, return_counts=True)), strict=True))
    out_q, out_i, out_s = [], [], []
    for qid, q, own in zip(query_ids, queries, near, strict=True):
        # Footrule = a constant less what each shared pivot saves.
        saved = np.zeros(len(x), np.int32)
        for at, p in enumerate(own):
            rows, where = files[p]
            saved[rows] += saving[at, where]
        if take < len(x):
            cut = np.partition(saved, len(x) - take)[len(x) - take]
            above = np.flatnonzero(saved > cut)
            some = np.r_[above, np.flatnonzero(saved == cut)[: take - len(above)]]
        else:
            some = np.arange(len(x))
        score = np.einsum("ij,j->i", x[some].astype(np.float64), q.astype(np.float64))
        # A vector's first rows are enough: none of the best k + all of its own id comes after them.
        best = some[score >= np.partition(score, -most)[-most]] if len(score) > (most := k + own_rows.get(qid, 0)) else some
        score = dict(zip(some.tolist(), score.tolist(), strict=True))
        rows = np.concatenate([members[begin[g] : begin[g] + min(size[g], most)] for g in best])
        value = np.repeat([score[g] for g in best.tolist()], np.minimum(size[best], most))
        rows, value = rows[ids[rows] != qid], value[ids[rows] != qid]
        top = np.lexsort((ids[rows], -value))[:k]
        out_q.append(np.full(len(top), qid))
        out_i.append(ids[rows[top]])
        out_s.append(value[top])
    none = np.zeros(0, np.int64)
    return (np.concatenate(out_q), np.concatenate(out_i), np.concatenate(out_s)) if out_q else (none, none, np.zeros(0))


def _matrix(t: pa.Table) -> np.ndarray:
    return t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(t.num_rows, -1)


def distinct_vectors(rows: DataFrame, n: int) -> list[list[float]]:
    """The first n vectors in the order of their hashes, each once; only hashes are compared for it."""
    h = F.xxhash64("v").alias("h")
    first = [r["h"] for r in rows.select(h).distinct().orderBy("h").limit(n).collect()]
    return [r["v"] for r in rows.select(h, "v").where(F.col("h").isin(first)).groupBy("h").agg(F.min("v").alias("v")).orderBy("h").collect()] if first else []


def nearest(df: DataFrame, query, key: str = "vec_id", vector: str = "embedding", k: int = 20, depth: float = DEPTH) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row for which `query` holds."""
    spark = df.sparkSession
    v = F.col(vector).cast("array<double>")
    kind = df.schema[key].dataType.simpleString()
    schema = f"query_id {kind}, vec_id {kind}, score double"
    rows = df.select(F.col(key).alias("id"), v.alias("v"), query.alias("q")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    rows = rows.where(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0))
    common = rows.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").first()
    if common is None:
        return spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    rows = rows.where(F.size("v") == common["size"])
    pivots = np.array(distinct_vectors(rows, PIVOTS), np.float64)
    pivots = pivots / np.maximum(np.linalg.norm(pivots, axis=1, keepdims=True), 1e-300)
    n = rows.agg(F.count("*").alias("n"), F.count_if("q").alias("q")).first()
    blocks, query_blocks = n["n"] // BLOCK + 1, n["q"] // QUERY_BLOCK + 1
    hashed = lambda m: F.pmod(F.xxhash64("id", F.lit(3)), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = rows.select("id", "v", hashed(blocks).alias("b")).select("*", every(query_blocks).alias("qb"))
    asked = rows.where("q").groupBy("id").agg(F.min("v").alias("v"))
    right = asked.select("id", "v", hashed(query_blocks).alias("qb")).select("*", every(blocks).alias("b"))

    def block(a: pa.Table, b: pa.Table) -> pa.Table:
        # Ids of any type are numbered in their order within the block pair.
        every = pa.chunked_array([*a.column("id").chunks, *b.column("id").chunks], a.schema.field("id").type).unique().sort()
        code = lambda t: pc.index_in(t.column("id"), every).to_numpy(zero_copy_only=False).astype(np.int64)
        if not a.num_rows or not b.num_rows:
            q, i, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        else:
            q, i, s = search(code(a), _matrix(a), code(b), _matrix(b), pivots, k, depth)
        return pa.table({"query_id": every.take(pa.array(q, pa.int64())), "vec_id": every.take(pa.array(i, pa.int64())), "score": pa.array(s, pa.float64())})

    found = left.groupBy("b", "qb").cogroup(right.groupBy("b", "qb")).applyInArrow(block, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
