"""Evaluation beyond the ranking metrics: random null, lift, ceilings, losses, hard sets, seed spreads."""

from __future__ import annotations

import hashlib
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairbench.operators import components, metrics


BLOCK = 1 << 18  # places that are hashed at once
BINS = 52  # bits of a hash's first eight bytes that a histogram's bin leaves out


def _digests(key: str, n: int, block: int, size: int) -> tuple[np.ndarray, bytes]:
    """SHA-256 of key:place for the places of a block: the first eight bytes as numbers, and all bytes."""
    start, sha = f"{key}:".encode(), hashlib.sha256
    raw = b"".join([sha(b"%b%d" % (start, at)).digest() for at in range(block * size + 1, min(block * size + size, n) + 1)])
    return np.frombuffer(raw, ">u8")[::4].astype(np.uint64), raw


def _least(head: np.ndarray, raw: bytes, k: int) -> bytes:
    """The k-th least digest."""
    cut = np.partition(head, k - 1)[k - 1]
    same = sorted(raw[32 * i : 32 * i + 32] for i in np.flatnonzero(head == cut))
    return same[k - 1 - int((head < cut).sum())]


def _to(head: np.ndarray, raw: bytes, last: bytes) -> np.ndarray:
    """Where the digests up to `last` are, in order."""
    cut = np.uint64(int.from_bytes(last[:8], "big"))
    taken = head < cut
    for i in np.flatnonzero(head == cut):
        taken[i] = raw[32 * i : 32 * i + 32] <= last
    return np.flatnonzero(taken)


def null_samples(df: DataFrame, g: str, repeats: int, seed: str, size: int = BLOCK) -> DataFrame:
    """(draw, ap): macro average precision of `repeats` random rankings. A group's positives take the
    places of its n_pos least hashes among its scored places; groups without a positive take no part.

    No place becomes a row. A group and draw is one row a block of `size` places, which hashes its places
    and sends three sums. A group of one block finds its last hash taken by itself. Longer ones find it
    from the sum of their blocks' histograms, by the first 12 bits: of the hashes only those of the bin in
    which it lies are sent and ordered, one in 4,096."""
    counts = metrics.scored(df).groupBy(g).agg(F.sum("label").alias("k"), F.count("*").alias("n")).where("k > 0")
    n = components.cut(counts.select(g, F.least("k", "n").cast("long").alias("k"), "n"))
    tasks = 4 * df.sparkSession.sparkContext.defaultParallelism
    draws = n.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    every = draws.select("draw", F.concat_ws(":", F.lit(seed), "draw", g).alias("key"), "k", "n", F.explode(F.expr(f"sequence(0L, (n - 1) div {size}L)")).alias("block"))
    long = every.where(F.col("n") > size).select("key", "k", "n", "block")

    def count(batches):
        for b in batches:
            for key, k, n, block in zip(*(c.to_pylist() for c in b.columns), strict=True):
                bins, got = np.unique(_digests(key, n, block, size)[0] >> np.uint64(BINS), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(bins)), pa.array([k] * len(bins)), pa.array(bins.astype(np.int64)), pa.array(got)], ["key", "k", "bin", "m"])

    def show(batches):
        for b in batches:
            for key, n, block, chosen, rest in zip(*(c.to_pylist() for c in b.columns), strict=True):
                head, raw = _digests(key, n, block, size)
                own = [raw[32 * i : 32 * i + 32] for i in np.flatnonzero(head >> np.uint64(BINS) == chosen)]
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(own), pa.string()), pa.array([rest] * len(own), pa.int64()), pa.array(own, pa.binary())], ["key", "rest", "last"])

    def place(batches):
        for b in batches:
            out = []
            for draw, key, k, n, block, last in zip(*(c.to_pylist() for c in b.columns), strict=True):
                head, raw = _digests(key, n, block, size)
                at = _to(head, raw, last or _least(head, raw, k))
                spot = at + 1.0 + block * size
                out.append((draw, key, block, len(at), float((1 / spot).sum()), float((np.arange(1, len(at) + 1) / spot).sum())))
            yield pa.RecordBatch.from_pylist([dict(zip(placed.names, x, strict=True)) for x in out], placed)

    placed = pa.schema([("draw", pa.int32()), ("key", pa.string()), ("block", pa.int64()), ("m", pa.int64()), ("inverse", pa.float64()), ("own", pa.float64())])
    bins = long.repartition(tasks, "key", "block").mapInArrow(count, "key string, k long, bin long, m long").groupBy("key", "k", "bin").agg(F.sum("m").alias("m"))
    before = F.sum("m").over(Window.partitionBy("key").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) - F.col("m")
    chosen = bins.withColumn("before", before).where("before < k AND before + m >= k").select("key", F.col("bin").alias("chosen"), (F.col("k") - F.col("before")).alias("rest"))
    shown = long.drop("k").join(chosen, "key").repartition(tasks, "key", "block").select("key", "n", "block", "chosen", "rest").mapInArrow(show, "key string, rest long, last binary")
    last = shown.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("last"))).where("r = rest").select("key", "last")
    names = ["draw", "key", "k", "n", "block", "last"]
    short = every.where(F.col("n") <= size).withColumn("last", F.lit(None).cast("binary"))
    work = short.select(names).union(every.where(F.col("n") > size).join(last, "key").select(names))
    sums = work.repartition(tasks, "key", "block").mapInArrow(place, "draw int, key string, block long, m long, inverse double, own double")
    # A block's i-th place taken is the group's (i + those of the blocks before)-th.
    ahead = F.sum("m").over(Window.partitionBy("draw", "key").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("m")
    per = sums.withColumn("hits", F.col("own") + F.coalesce(ahead, F.lit(0)) * F.col("inverse")).groupBy("draw", "key").agg((F.sum("hits") / F.sum("m")).alias("ap"))
    return per.groupBy("draw").agg(F.round(F.avg("ap"), 6).alias("ap"))


def expected_null(df: DataFrame, g: str) -> DataFrame:
    """(n_groups, expected_ap): the exact mean of the macro average precision of random rankings.
    With k positives in n places it is (H + (k - 1) / (n - 1) (n - H)) / n, H being the n-th harmonic
    number (its series over 64 terms)."""
    n = metrics.scored(df).groupBy(g).agg(F.sum("label").alias("k"), F.count("*").alias("n")).where("k > 0")
    m = F.col("n").cast("double")
    few = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(64)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / i)
    h = F.when(F.col("n") <= 64, few).otherwise(F.log(m) + 0.5772156649015329 + 1 / (2 * m) - 1 / (12 * m * m) + 1 / (120 * m * m * m * m))
    rest = F.coalesce(F.try_divide((F.col("k") - 1) * (m - h), m - 1), F.lit(0.0))
    return n.agg(F.count("*").alias("n_groups"), F.round(F.avg((h + rest) / m), 6).alias("expected_ap"))


def sampled_null(df: DataFrame, g: str, draws: int = 200, seed: int = 0) -> DataFrame:
    """(draw, ap): macro average precision of random rankings, as null_samples, but each group is one row
    with its numbers of places and positives, and a draw takes the positives' places from a generator
    that is keyed by (seed, group, draw): time and memory grow with the positives, and no place becomes
    a row. The same draws come out on every cluster."""
    n = metrics.scored(df).groupBy(g).agg(F.sum("label").alias("k"), F.count("*").alias("n")).where("k > 0")
    dealt = n.select(F.xxhash64(g).alias("key"), "k", "n", F.explode(F.sequence(F.lit(0), F.lit((draws - 1) // 25))).alias("part")).repartition("key", "part")

    def run(batches):
        for b in batches:
            out = []
            for key, k, size, part in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for draw in range(part * 25, min(part * 25 + 25, draws)):
                    rng = np.random.Generator(np.random.Philox(key=[key & (1 << 64) - 1, seed << 32 | draw]))
                    at = np.sort(rng.choice(size, k, replace=False, shuffle=False)) + 1
                    out.append((draw, float(np.mean(np.arange(1, k + 1) / at))))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int32(), pa.float64()))], ["draw", "ap"])

    per = dealt.select("key", "k", "n", "part").mapInArrow(run, "draw int, ap double")
    return per.groupBy("draw").agg(F.round(F.avg("ap"), 6).alias("ap"))


def null_band(samples: DataFrame) -> DataFrame:
    return samples.agg(F.round(F.avg("ap"), 5).alias("random_mean"), F.round(F.percentile("ap", 0.95), 5).alias("random_p95"))


def at_chance(df: DataFrame, g: str, band: DataFrame) -> DataFrame:
    """(group, ap, at_chance): whether a group's average precision is within the null's 95th percentile.
    band: one row with random_p95."""
    return metrics.average_precision(df, g).crossJoin(F.broadcast(band.select("random_p95"))).select(g, "ap", (F.col("ap") <= F.col("random_p95")).alias("at_chance"))


def lift(df: DataFrame, g: str) -> DataFrame:
    """One row over all groups with both classes: mean, median, least and largest AP and AUROC, and the
    mean of AP over the group's positive rate."""
    both = metrics.average_precision(df, g).join(metrics.auroc(df, g), g).where("ap IS NOT NULL AND auroc IS NOT NULL")
    own = both.withColumn("lift", F.col("ap") * F.col("n") / F.col("n_pos"))
    stats = [f(c).alias(f"{name}_{c}") for c in ("ap", "auroc") for name, f in (("mean", F.avg), ("median", F.median), ("min", F.min), ("max", F.max))]
    cells = own.agg(F.count("*").alias("n_groups"), *stats, F.avg("lift").alias("lift"))
    return cells.select("n_groups", *[F.round(c, 5).alias(c) for c in cells.columns[1:]])


def training_rate(df: DataFrame, default: float = 0.002) -> DataFrame:
    """Positives over scored rows, kept within 1e-6 of 0 and 1; the default without scored rows."""
    rate = F.least(F.greatest(F.avg("label"), F.lit(1e-6)), F.lit(1 - 1e-6))
    return metrics.scored(df).agg(F.round(F.coalesce(rate, F.lit(default)), 8).alias("rate"))


def hard_set(frame: DataFrame, most: float = 0.25, keep_silent: bool = False) -> DataFrame:
    """The held-out rows (k = 1, fold 'all') that the lookup fails on: undefined AP ('dead') or AP under
    `most` ('low'); records without evidence only on request. frame: k, fold, ap, verdict and others."""
    own = frame.where("k = 1 AND fold = 'all'")
    own = own if keep_silent else own.where("verdict <> 'no_evidence'")
    return own.where(F.col("ap").isNull() | (F.col("ap") < most)).withColumn("reason", F.when(F.col("ap").isNull(), "dead").otherwise("low"))


def hard_summary(chosen: DataFrame, every: DataFrame, family: str) -> DataFrame:
    total = every.groupBy(family).agg(F.count("*").alias("n_variants"))
    own = chosen.groupBy(family).agg(F.count("*").alias("n_in_set"), F.count_if(F.col("reason") == "dead").alias("n_dead"))
    out = total.join(own, family, "left").na.fill(0, ["n_in_set", "n_dead"])
    return out.withColumn("fraction", F.round(F.col("n_in_set") / F.col("n_variants"), 6))


def selection(runs: DataFrame, setting: str, group: str, seed: str, value: str, control: str) -> DataFrame:
    """(setting, mean, spread, gain, survives): per setting the mean over groups of the mean over seeds,
    the mean of the seeds' spread (ddof 1), the gain over the control setting, and whether the mean
    reaches the control's less its spread."""
    per = runs.groupBy(setting, group).agg(F.avg(value).alias("m"), F.stddev_samp(value).alias("sd"))
    own = per.groupBy(setting).agg(F.round(F.avg("m"), 6).alias("mean"), F.round(F.avg("sd"), 6).alias("spread"))
    base = own.where(F.col(setting) == control).select(F.col("mean").alias("base"), F.col("spread").alias("slack"))
    both = own.crossJoin(F.broadcast(base))
    return both.select(setting, "mean", "spread", F.round(F.col("mean") - F.col("base"), 6).alias("gain"), (F.col("mean") >= F.col("base") - F.coalesce("slack", F.lit(0.0))).alias("survives"))


def split_auc(df: DataFrame, g: str) -> DataFrame:
    """AUROC per group and its error, sqrt(a (1 - a) / the smaller class)."""
    counts = metrics.scored(df).groupBy(g).agg(F.sum("label").alias("p"), F.count("*").alias("n"))
    small = F.least(F.col("p"), F.col("n") - F.col("p"))
    error = F.sqrt(F.col("auroc") * (1 - F.col("auroc")) / F.nullif(small, F.lit(0)))
    return metrics.auroc(df, g).join(counts, g).select(g, "auroc", F.round(error, 6).alias("error"))


def standardised(df: DataFrame, g: str, value: str) -> DataFrame:
    """df with z: the value less its group's mean over its spread (ddof 0; 1 where that is 0)."""
    w = Window.partitionBy(g)
    sd = F.stddev_pop(value).over(w)
    return df.withColumn("z", F.round((F.col(value) - F.avg(value).over(w)) / F.when(sd == 0, 1.0).otherwise(sd), 5))


def pair_scores(queries: DataFrame, keys: DataFrame, on: str, scale: float = 1.0, bias: float = 0.0) -> DataFrame:
    """(on, q, v, logit, p): two-tower score of query and key vectors (q, x; v, y) that share `on`:
    scale times the dot product plus bias, and its sigmoid."""
    dot = F.aggregate(F.zip_with("x", "y", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)
    out = queries.join(keys, on).withColumn("logit", F.round(scale * dot + bias, 6))
    return out.select(on, "q", "v", "logit", F.round(sigmoid(F.col("logit")), 6).alias("p"))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def losses(df: DataFrame, g: str, weight: float = 0.5) -> DataFrame:
    """Per group of scored pairs (logit, label): the multi-positive contrastive loss (log-sum-exp of all
    less that of the positives; NULL without one), the mean binary cross-entropy, and their mixture."""
    own = metrics.scored(df).withColumn("top", F.max("logit").over(Window.partitionBy(g)))
    every = F.log(F.sum(F.exp(F.col("logit") - F.col("top"))))
    hits = F.sum(F.when(F.col("label") == 1, F.exp(F.col("logit") - F.col("top"))))
    out = own.groupBy(g).agg((every - F.log(hits)).alias("nce"), F.avg(softplus(F.col("logit")) - F.col("label") * F.col("logit")).alias("bce"))
    return out.select(g, F.round("nce", 5).alias("nce"), F.round("bce", 5).alias("bce"), F.round(weight * F.col("nce") + (1 - weight) * F.col("bce"), 5).alias("hybrid"))


def _multiplied(cells: DataFrame, vectors: DataFrame, on: str, to: str, names: list[str]) -> DataFrame:
    """(to, names): the matrix cells (x) times a few vectors (on, names), summed with map-side combine."""
    sums = [F.sum(F.col("x") * F.col(n)).alias(n) for n in names]
    return cells.select("entity", "site", "x").join(vectors, on).groupBy(to).agg(*sums)


def _inner(rows: DataFrame, names: list[str]) -> np.ndarray:
    """The products of all pairs of columns, added up over rows: one small matrix a partition, and of
    these one row a cell reaches the driver."""
    size = len(names)

    def run(batches):
        total = np.zeros((size, size))
        for b in batches:
            x = np.stack([b.column(n).to_numpy(zero_copy_only=False) for n in names], 1)
            total += x.T @ x
        yield pa.RecordBatch.from_pydict({"cell": np.arange(size * size), "x": total.ravel()})

    sums = rows.select(names).mapInArrow(run, "cell long, x double").groupBy("cell").agg(F.sum("x").alias("x"))
    out = np.zeros(size * size)
    for r in sums.collect():
        out[r["cell"]] = r["x"]
    return out.reshape(size, size)


def _turned(rows: DataFrame, key: str, names: list[str], by: np.ndarray) -> DataFrame:
    """(key, names): each row's vector times a small matrix."""

    def run(batches):
        for b in batches:
            x = np.stack([b.column(n).to_numpy(zero_copy_only=False) for n in names], 1) @ by
            yield pa.RecordBatch.from_arrays([b.column(key), *(pa.array(np.ascontiguousarray(c)) for c in x.T)], [key, *names])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, *names).mapInArrow(run, ", ".join([f"`{key}` {kind}", *(f"{n} double" for n in names)]))


def rank_ceiling(cells: DataFrame, ranks: list[int], spare: int = 8, rounds: int = 100, close: float = 1e-11) -> DataFrame:
    """(rank, ap, n): macro AP of the best approximations of a binary matrix (entity, site, label) by few
    factors. No-calls take their site's mean, so they are 0 once sites are centred, and the matrix is
    as sparse as its calls.

    Subspace iteration: max(ranks) + spare random columns, drawn from hashes of the entities, are
    multiplied by the matrix and its transpose, as joins and sums, and made orthonormal by the Cholesky
    factor of their small product, until the leading values rest. Entities and sites stay distributed;
    only matrices of the width of the columns reach the driver. Columns beyond the matrix's rank vanish
    and are left out. With equal values at the cut the approximation is one of several best ones."""
    own = cells.select("entity", "site", F.col("label").cast("int").alias("label")).where("label >= 0")
    own = own.withColumn("mean", F.avg("label").over(Window.partitionBy("site"))).withColumn("x", F.col("label") - F.col("mean"))
    own = components.cut(own)
    names = [f"q{i}" for i in range(max(ranks) + spare)]
    bits = [(F.pmod(F.xxhash64("entity", F.lit(i)), F.lit(2**20)) / 2.0**19 - 1).alias(n) for i, n in enumerate(names)]
    q, last = own.select("entity").distinct().select("entity", *bits), None
    for _ in range(rounds):
        gram = _inner(q, names)
        values, turn = np.linalg.eigh(gram)
        keep = values > values.max(initial=0) * 1e-13
        if not keep.any():
            names = []
            break
        q = _turned(q, "entity", names, np.pad(turn[:, keep] / np.sqrt(values[keep]), ((0, 0), (0, (~keep).sum()))))
        names = names[: int(keep.sum())]
        q = components.cut(q.select("entity", *names))
        at = components.cut(_multiplied(own, q, "entity", "site", names))
        # The best combinations of the columns, largest first.
        values, turn = np.linalg.eigh(_inner(at, names))
        turn = np.ascontiguousarray(turn[:, ::-1])
        values = values[::-1][: max(ranks)]
        if last is not None and len(last) == len(values) and np.all(np.abs(values - last) <= close * max(values.max(), 1e-300)):
            break
        last = values
        q_next = _multiplied(own, at, "site", "entity", names)
        q = components.cut(own.select("entity").distinct().join(q_next, "entity"))
    if not names:
        return own.sparkSession.createDataFrame([], "rank int, ap double, n long")
    leading = names[: max(ranks)]
    u = _turned(q, "entity", names, turn).select("entity", *leading)
    at = _turned(at, "site", names, turn).select("site", *[F.col(n).alias(f"s{n}") for n in leading])
    scored = own.join(u, "entity").join(at, "site")
    some = [F.col(n) * F.col(f"s{n}") for n in leading]
    total = F.array(*[F.struct(F.lit(r).alias("rank"), F.round(reduce(add, some[:r], F.col("mean")), 8).alias("score")) for r in ranks])
    out = scored.select("entity", "label", F.explode(total).alias("at")).select(F.struct("at.rank", "entity").alias("g"), "at.score", "label")
    ap = metrics.average_precision(out, "g").select("g.rank", "ap")
    return ap.groupBy("rank").agg(F.round(F.avg("ap"), 6).alias("ap"), F.count("ap").alias("n"))


def displacement(pairs: DataFrame, span: int = 5) -> DataFrame:
    """pairs (id, x, y, at: two vectors of one width and a place from 1) with the cosine of the window
    of `span` on either side of the place, of the whole vectors, and the difference at the place."""
    lo = F.greatest(F.col("at") - span, F.lit(1))
    size = F.least(F.col("at") + span, F.size("x")) - lo + 1

    def cosine(a: Column, b: Column) -> Column:
        dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
        return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))

    x, y = F.slice("x", lo, size), F.slice("y", lo, size)
    site = F.abs(F.element_at("x", F.col("at")).cast("double") - F.element_at("y", F.col("at")).cast("double"))
    return pairs.select("id", F.round(site, 5).alias("site"), F.round(1 - cosine(x, y), 5).alias("window"), F.round(1 - cosine(F.col("x"), F.col("y")), 5).alias("pooled"))
