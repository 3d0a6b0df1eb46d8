"""Weight-matrix scans over sequence windows and the cut of windows from a genome table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pairbench.operators import metrics


def window_scores(codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The score of every window of both strands; codes are 0..3 for A, C, G, T, weights width x 4. Any other
    code leaves its windows without a score: minus infinity."""
    codes = np.minimum(codes, 4)
    n = len(codes) - len(weights) + 1
    both = np.zeros((2, n))
    for strand, w in zip(both, (weights, weights[::-1, ::-1]), strict=True):
        for i, place in enumerate(w):
            strand += np.append(place, -np.inf)[codes[i : i + n]]
    return both.ravel()


def scan(df: DataFrame, seq: str, motifs: dict[str, list[float]]) -> DataFrame:
    """For every row and motif, over all offsets and both strands: best and log-sum-exp of the scores.
    Windows with a letter beyond ACGT are left out, and rows without any other window give none.
    A motif is a flat list of four weights (A, C, G, T) a position; motifs are few and go with the task."""
    library = {name: np.asarray(w, float).reshape(-1, 4) for name, w in motifs.items()}
    code = np.full(256, 255, np.uint8)
    code[list(b"ACGT")] = range(4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, name, best, total = [], [], [], []
            for i, text in enumerate(b.column(seq)):
                codes = code[np.frombuffer((text.as_py() or "").encode(), np.uint8)]
                for motif, w in library.items():
                    if len(codes) >= len(w):
                        x = window_scores(codes, w)
                        if x.max() == -np.inf:
                            continue
                        row.append(i)
                        name.append(motif)
                        best.append(float(x.max()))
                        total.append(best[-1] + float(np.log(np.exp(x - best[-1]).sum())))
            kept = b.take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(name, pa.string()), pa.array(best, pa.float64()), pa.array(total, pa.float64())], [*b.schema.names, "motif", "best", "total"])

    kind = StructType([*df.schema.fields, *StructType.fromDDL("motif string, best double, total double").fields])
    return df.mapInArrow(run, kind).select(*df.columns, "motif", F.round("best", 5).alias("best"), F.round("total", 5).alias("total"))


def select(scans: DataFrame) -> DataFrame:
    """The motif and kind of score (best or total) with the highest average precision for label."""
    long = scans.select("label", F.explode(F.array(*[F.struct(F.concat_ws(":", "motif", F.lit(k)).alias("choice"), F.col(k).alias("score")) for k in ("best", "total")])).alias("s"))
    return metrics.average_precision(long.select("label", "s.choice", "s.score"), "choice").orderBy(F.desc_nulls_last("ap"), "choice").limit(1)


def cut(spans: DataFrame, genome: DataFrame, width: int) -> DataFrame:
    """spans (chrom, start from 0) with their sequence; status says why one is unusable. genome: chrom, seq."""
    seq = F.col("seq").substr(F.col("start") + 1, F.lit(width))
    whole = spans.join(genome, "chrom", "left").withColumn("window", seq)
    bad = F.when(F.col("seq").isNull() | (F.col("start") < 0) | (F.length("window") < width), "off_end").when(~F.col("window").rlike("^[ACGT]+$"), "ambiguous").otherwise("ok")
    return whole.select("chrom", "start", bad.alias("status"), F.when(bad == "ok", F.col("window")).alias("window"))


def similarity(a: list[float], b: list[float], overlap: int = 6) -> float:
    """Best cosine of two motifs over all offsets with at least `overlap` shared places and both strands,
    after each place is centred; -1 if none fits. All offsets are one correlation of the padded motifs."""
    x, y = (np.asarray(m, float).reshape(-1, 4) for m in (a, b))
    x, y = x - x.mean(1, keepdims=True), y - y.mean(1, keepdims=True)
    best = -1.0
    for z in (y, y[::-1, ::-1]):
        dots = sum(np.correlate(x[:, c], z[:, c], "full") for c in range(4))
        one = np.ones(len(x)), np.ones(len(z))
        shared = np.correlate(*one, "full")
        size = np.sqrt(np.correlate((x * x).sum(1), one[1], "full").clip(0) * np.correlate(one[0], (z * z).sum(1), "full").clip(0))
        fits = (shared >= overlap) & (size > 1e-12)
        if fits.any():
            best = max(best, float((dots[fits] / size[fits]).max()))
    return best


def best_against(filters: DataFrame, motifs: DataFrame, overlap: int = 6) -> DataFrame:
    """(filter, motif, similarity): each filter's most similar motif, ties to the lesser name. Both
    libraries (name, weights) are small; the pairs are scored in Arrow batches."""

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"filter": b["filter"], "motif": b["motif"], "similarity": [round(similarity(x, y, overlap), 6) for x, y in zip(b["x"], b["y"], strict=True)]})

    scored = filters.toDF("filter", "x").crossJoin(motifs.toDF("motif", "y")).mapInPandas(run, "filter string, motif string, similarity double")
    best = F.min(F.struct((-F.col("similarity")).alias("s"), "motif")).alias("m")
    return scored.groupBy("filter").agg(best).select("filter", F.col("m.motif").alias("motif"), (-F.col("m.s")).alias("similarity"))


def similarities(df: DataFrame, overlap: int = 6) -> DataFrame:
    """(i, j, similarity) for all pairs of motifs (name, weights); motif libraries are small."""

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"i": b["i"], "j": b["j"], "similarity": [round(similarity(x, y, overlap), 6) for x, y in zip(b["x"], b["y"], strict=True)]})

    return df.toDF("i", "x").join(df.toDF("j", "y"), F.col("i") < F.col("j")).mapInPandas(run, "i string, j string, similarity double")
