"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document's features are its words hashed to 2**14 buckets (count over the square root of the
number of words), standardised structure statistics and the text's size. The score is the logistic
of bias + linear terms + all pairwise interactions through rank-`RANK` factors, taken in linear time
as half of (sum of v x) squared minus sum of (v x) squared. Fitted on the driver by mini-batch Adam
on a bounded sample of labelled rows.

Null and empty texts have no words and zero statistics, and get a score like any other text. Labels
that are null or rows without a document take no part. Without labels every score is 0.5. Long texts
count whole. Repeated rows have equal scores; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairbench.llm.textkit import Words, chunks, select_rows, tidy, words

BITS = 14
RANK = 6
N_STATS = 16


def structure(w: Words) -> np.ndarray:
    """docs x N_STATS: logs of sizes, and shares of kinds of bytes, words and lines."""
    size, n = np.diff(w.doc_at).astype(float), w.count.astype(float)
    raw = w.raw
    upper, digit = (raw >= 65) & (raw <= 90), (raw >= 48) & (raw <= 57)
    lower = (raw >= 97) & (raw <= 122)
    high, gap = raw >= 128, raw <= 32
    mark = ~(upper | digit | lower | high | gap)

    def per_doc(x: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
        return (total[w.doc_at[1:]] - total[w.doc_at[:-1]]).astype(float)

    def per_word(x: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
        return (total[w.offset[1:]] - total[w.offset[:-1]]).astype(float)

    length = w.end - w.start
    odd = (raw != 46) & (raw != 44) & mark  # marks other than full stop and comma
    last, first = w.end - 1, w.start
    doc = w.doc
    distinct = np.zeros(w.n_docs)
    if len(doc):
        order = np.lexsort((w.hash, doc))
        d, h = doc[order], w.hash[order]
        new = np.r_[True, (d[1:] != d[:-1]) | (h[1:] != h[:-1])]
        distinct = np.bincount(d[new], minlength=w.n_docs).astype(float)
    b, m = np.maximum(size, 1), np.maximum(n, 1)
    lines = per_doc(raw == 10)
    return np.stack(
        [
            np.log1p(size), np.log1p(n), per_doc(upper) / b, per_doc(digit) / b, per_doc(mark) / b, per_doc(odd) / b, per_doc(gap) / b, per_doc(high) / b,
            size / m / 10, per_word(odd[last]) / m, per_word(mark[last]) / m, per_word(upper[first]) / m, per_word(length == 1) / m, per_word(length > 12) / m, distinct / m, np.log1p(lines) - np.log1p(n),
        ],
        1,
    )


def hashed(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, bucket and value of every distinct bucket of every document."""
    key, count = np.unique((w.doc.astype(np.int64) << BITS) | (w.hash >> np.uint64(64 - BITS)).astype(np.int64), return_counts=True)
    doc = key >> BITS
    return doc, key & ((1 << BITS) - 1), count / np.sqrt(np.maximum(w.count, 1))[doc]


@dataclass(frozen=True)
class Machine:
    bias: float
    linear: np.ndarray  # buckets + stats
    factor: np.ndarray  # (buckets + stats) x RANK
    mean: np.ndarray
    scale: np.ndarray

    def stats(self, w: Words) -> np.ndarray:
        return np.clip((structure(w) - self.mean) / self.scale, -4, 4)

    def logit(self, doc: np.ndarray, bucket: np.ndarray, value: np.ndarray, stats: np.ndarray) -> np.ndarray:
        n, nb = len(stats), 1 << BITS
        vx = self.factor[bucket] * value[:, None]
        once = np.stack([np.bincount(doc, vx[:, r], n) for r in range(RANK)], 1) + stats @ self.factor[nb:]
        twice = np.bincount(doc, (vx * vx).sum(1), n) + (stats**2) @ (self.factor[nb:] ** 2).sum(1)
        return self.bias + np.bincount(doc, self.linear[bucket] * value, n) + stats @ self.linear[nb:] + 0.5 * ((once**2).sum(1) - twice)

    def score(self, w: Words) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(*hashed(w), self.stats(w)), -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]], epochs: int = 12, batch: int = 128, rate: float = 0.02, decay: float = 1e-4, seed: int = 7) -> Machine:
    """rows: (buckets, values, statistics, label) of each labelled document."""
    rng, nb = np.random.default_rng(seed), 1 << BITS
    size = nb + N_STATS
    if not rows:
        return Machine(0.0, np.zeros(size), np.zeros((size, RANK)), np.zeros(N_STATS), np.ones(N_STATS))
    stats = np.stack([r[2] for r in rows])
    y = np.array([r[3] for r in rows], float)
    mean, scale = stats.mean(0), stats.std(0) + 1e-6
    stats = np.clip((stats - mean) / scale, -4, 4)
    share = np.clip(y.mean(), 0.01, 0.99)
    theta = np.zeros((size, 1 + RANK))
    theta[:, 1:] = rng.normal(0, 0.02, (size, RANK))
    bias, m1, m2, b1, b2, step = float(np.log(share / (1 - share))), np.zeros_like(theta), np.zeros_like(theta), 0.0, 0.0, 0
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // batch)):
            step += 1
            doc = np.repeat(np.arange(len(part)), [len(rows[i][0]) for i in part])
            bucket, value = np.concatenate([rows[i][0] for i in part]), np.concatenate([rows[i][1] for i in part])
            machine = Machine(bias, theta[:, 0], theta[:, 1:], mean, scale)
            s = stats[part]
            err = (1 / (1 + np.exp(-np.clip(machine.logit(doc, bucket, value, s), -30, 30))) - y[part]) / len(part)
            vx = theta[bucket, 1:] * value[:, None]
            once = np.stack([np.bincount(doc, vx[:, r], len(part)) for r in range(RANK)], 1) + s @ theta[nb:, 1:]
            used, back = np.unique(bucket, return_inverse=True)
            g = np.zeros((len(used) + N_STATS, 1 + RANK))
            e = err[doc] * value
            g[: len(used), 0] = np.bincount(back, e, len(used))
            inner = e[:, None] * (once[doc] - vx)
            for r in range(RANK):
                g[: len(used), 1 + r] = np.bincount(back, inner[:, r], len(used))
            g[len(used) :, 0] = s.T @ err
            g[len(used) :, 1:] = s.T @ (err[:, None] * once) - ((s**2).T @ err)[:, None] * theta[nb:, 1:]
            at = np.r_[used, np.arange(nb, size)]
            g += decay * theta[at]
            m1[at] = 0.9 * m1[at] + 0.1 * g
            m2[at] = 0.99 * m2[at] + 0.01 * g * g
            theta[at] -= rate * m1[at] / (1 - 0.9**step) / (np.sqrt(m2[at] / (1 - 0.99**step)) + 1e-8)
            gb = err.sum()
            b1, b2 = 0.9 * b1 + 0.1 * gb, 0.99 * b2 + 0.01 * gb * gb
            bias -= rate * b1 / (1 - 0.9**step) / (np.sqrt(b2 / (1 - 0.99**step)) + 1e-8)
    return Machine(bias, theta[:, 0].copy(), theta[:, 1:].copy(), mean, scale)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most: int = 6000, seed: int = 7) -> Machine:
    """A machine fitted on a sample of about `most` labelled rows (all, where there are fewer),
    drawn by a hash of the key. Only the sampled labels are broadcast, and only the features of
    their documents reach the driver: both are bounded by `most`."""
    good = labels.select(F.col(key).alias("_k"), F.col(label).cast("int").alias("_y")).where(F.col("_k").isNotNull() & F.col("_y").isin(0, 1))
    n = good.count()
    if n > most:
        good = good.where(F.pmod(F.xxhash64("_k", F.lit(seed)), F.lit(1 << 40)) < int(most / n * (1 << 40)))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "_text"):
                w = words(part.column("_text"))
                doc, bucket, value = hashed(w)
                cut = np.searchsorted(doc, np.arange(w.n_docs + 1)).astype(np.int32)
                lists = lambda x, kind: pa.ListArray.from_arrays(pa.array(cut), pa.array(x, kind))
                stat = pa.ListArray.from_arrays(pa.array(np.arange(w.n_docs + 1, dtype=np.int32) * N_STATS), pa.array(structure(w).ravel(), pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column("_k"), lists(bucket, pa.int32()), lists(value, pa.float32()), stat, part.column("_y")], ["k", "bucket", "value", "stat", "y"])

    rows = docs.select(F.col(key).alias("_k"), F.col(text).cast("string").alias("_text")).join(F.broadcast(good), "_k").select("_k", "_text", "_y")
    kind = docs.schema[key].dataType.simpleString()
    got = rows.mapInArrow(tidy(features), f"k {kind}, bucket array<int>, value array<float>, stat array<double>, y int").toArrow().sort_by([("k", "ascending")])
    return fit([(np.asarray(b, np.int64), np.asarray(v, float), np.asarray(s), y) for b, v, s, y in zip(*(got.column(c).to_pylist() for c in ("bucket", "value", "stat", "y")), strict=True)], seed=seed)


def score(df: DataFrame, machine: Machine, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score). One narrow stage; the machine (about 1 MB) is broadcast."""
    kind = df.schema[key].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "_text"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shared.value.score(words(part.column("_text"))), pa.float64())], [key, "score"])

    return df.select(F.col(key), F.col(text).cast("string").alias("_text")).mapInArrow(tidy(run), f"`{key}` {kind}, score double")


def good(df: DataFrame, machine: Machine, text: str = "text", least: float = 0.3) -> DataFrame:
    """The rows of df with a score of `least` or more."""
    shared = df.sparkSession.sparkContext.broadcast(machine)
    return select_rows(df, text, lambda texts: shared.value.score(words(texts)) >= least)
