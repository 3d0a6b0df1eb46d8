"""Operators that must not gather a table: orders, the rank ceiling, the random null, ranks in families."""

import hashlib
import math

import numpy as np
import pytest
from pairbench.operators import evaluation, metrics, ordering, splits, vectors
from pyspark.sql import functions as F


def test_running_sums(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), int(w)) for i, w in zip(rng.permutation(500), rng.integers(0, 9, 500), strict=True)]
    got, total = ordering.running(spark.createDataFrame(rows, "k int, w int").repartition(7), ["k"], "w")
    want = dict(zip(range(500), np.cumsum([0] + [w for _, w in sorted(rows)])[:-1].tolist(), strict=True))
    assert {r["k"]: r["before"] for r in got.collect()} == want and total == sum(w for _, w in rows)
    none, total = ordering.running(spark.createDataFrame([], "k int"), ["k"])
    assert none.count() == 0 and total == 0


@pytest.mark.parametrize(("n", "parts"), [(10, 3), (2, 5), (7, 7), (100, 15)])
def test_tiles(spark, n, parts):
    got = [r[0] for r in spark.range(n).select(ordering.tile(F.col("id"), n, parts)).collect()]
    assert got == [i for i, x in enumerate(np.array_split(np.arange(n), parts)) for _ in x]


def test_dictionary(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3), (None, 4)], "k string, v int")
    book = ordering.codes(df, "k")
    assert dict(book.collect()) == {"a": 0, "b": 1}
    assert {tuple(r) for r in ordering.encode(df, book, "k").select("v", "code").collect()} == {(1, 1), (2, 0), (3, 1), (4, None)}
    with pytest.raises(KeyError, match="'c'"):
        ordering.encode(spark.createDataFrame([("c", 1)], "k string, v int"), book, "k")


def test_no_order_in_one_task(spark):
    """No plan has an exchange to a single partition over rows."""
    df = spark.range(100).select(F.col("id").alias("k"), (F.col("id") % 7).alias("g"), (F.col("id") / 100).alias("score"), (F.col("id") % 2).cast("int").alias("label"))
    for out in (splits.balanced_folds(df, "k", 3, "s"), splits.smallest_first(df, "g", 0.3)):
        assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()


def exact(labels, rank):
    """Macro AP of the best approximation of rank `rank`, by numpy."""
    y = np.where(labels >= 0, labels, np.nan)
    mean = np.nanmean(y, axis=0, keepdims=True)
    x = np.where(np.isnan(y), mean, y) - mean
    values, v = np.linalg.eigh(x @ x.T)
    v = v[:, np.argsort(-values)][:, :rank]
    z = np.round(v @ (v.T @ x) + mean, 8)
    out = []
    for own, score in zip(labels, z, strict=True):
        keep = own >= 0
        own, score = own[keep], score[keep]
        if not own.sum():
            continue
        ap = 0.0
        for s in np.unique(score):
            at = score >= s
            ap += own[score == s].sum() / own.sum() * own[at].sum() / at.sum()
        out.append(ap)
    return round(float(np.mean(out)), 6)


@pytest.mark.parametrize("batch", [50, 10_000])
def test_rank_ceiling_equals_numpy(spark, batch):
    rng = np.random.default_rng(3)
    labels = rng.integers(-1, 2, (30, 60))
    rows = [(f"e{i}", j, int(labels[i, j])) for i in range(30) for j in range(60)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = {r["rank"]: r["ap"] for r in evaluation.rank_ceiling(spark.createDataFrame(rows, "entity string, site int, label int").repartition(5), [1, 3, 10]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == pytest.approx({r: exact(labels, r) for r in (1, 3, 10)}, abs=2e-6)


def test_rank_ceiling_of_little(spark):
    kinds = "entity string, site int, label int"
    assert evaluation.rank_ceiling(spark.createDataFrame([], kinds), [2]).count() == 0
    assert evaluation.rank_ceiling(spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], kinds), [2]).count() == 0


def test_null_is_near_its_expectation(spark):
    rows = [(g, i, int(i < k)) for g, n, k in (("a", 40, 3), ("b", 200, 10), ("c", 9, 9), ("d", 1, 1), ("e", 5, 0)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, i int, label int")
    h = lambda n: sum(1 / i for i in range(1, n + 1))
    want = [(h(n) + (0 if n == 1 else (k - 1) / (n - 1) * (n - h(n)))) / n for n, k in ((40, 3), (200, 10), (9, 9), (1, 1))]
    assert tuple(evaluation.expected_null(df, "g").first()) == (4, pytest.approx(np.mean(want), abs=1e-6))
    draws = evaluation.sampled_null(df, "g", 200)
    ap = [r["ap"] for r in draws.collect()]
    assert len(ap) == 200 and abs(np.mean(ap) - np.mean(want)) < 3 * np.std(ap) / math.sqrt(200)
    assert sorted(ap) == sorted(r["ap"] for r in evaluation.sampled_null(df.repartition(5), "g", 200).collect())
    many = [r["ap"] for r in evaluation.sampled_null(df, "g", 2000, seed=1).collect()]
    p95 = evaluation.null_band(draws).first()["random_p95"]
    assert abs(np.mean([x > p95 for x in many]) - 0.05) < 3 * math.sqrt(0.05 * 0.95 * (1 / 200 + 1 / 2000))


def drawn(groups: dict, repeats: int) -> dict:
    """Every place is hashed and sorted."""
    out = {}
    for draw in range(repeats):
        ap = []
        for g, (n, k) in groups.items():
            best = sorted(range(1, n + 1), key=lambda at: hashlib.sha256(f"s:{draw}:{g}:{at}".encode()).digest())[:k]
            ap.append(np.mean([i / at for i, at in enumerate(sorted(best), 1)]))
        out[draw] = pytest.approx(np.mean(ap), abs=1e-6)
    return out


@pytest.mark.parametrize("size", [1, 7, 50, 1 << 18])
def test_null_by_blocks_equals_sorted_hashes(spark, size):
    groups = {"a": (61, 5), "b": (200, 199), "c": (9, 9), "d": (1, 1), "é:1": (50, 1), "f": (51, 20)}
    rows = [(g, int(i < k)) for g, (n, k) in groups.items() for i in range(n)] + [("e", 0), ("a", -1), ("a", None)]
    df = spark.createDataFrame(rows, "g string, label int").repartition(3)
    got = {r["draw"]: r["ap"] for r in evaluation.null_samples(df, "g", 4, "s", size).collect()}
    assert got == drawn(groups, 4)


def test_null_makes_no_row_of_a_place(spark):
    """No step of the plan has hashes of places as a column."""
    df = spark.range(300_000).select((F.col("id") % 2).alias("g"), (F.col("id") % 31 == 0).cast("int").alias("label"))
    out = evaluation.null_samples(df, "g", 2, "s")
    assert "sha2" not in out._jdf.queryExecution().executedPlan().toString()
    n = 300_000 // 2
    assert {r["draw"]: r["ap"] for r in out.collect()} == drawn({0: (n, sum(i % 31 == 0 for i in range(0, 2 * n, 2))), 1: (n, sum(i % 31 == 0 for i in range(1, 2 * n, 2)))}, 2)
    assert evaluation.null_samples(df.where("label = 0"), "g", 2, "s").count() == 0


def test_null_of_a_long_group_ties_at_the_cut():
    """Equal first eight bytes are told apart by the rest."""
    raw = b"".join(bytes([a] * 8 + [b] * 24) for a, b in [(1, 9), (0, 5), (1, 3), (2, 0), (1, 7)])
    head = np.frombuffer(raw, ">u8")[::4].astype(np.uint64)
    for k, want in ((1, [1]), (2, [1, 2]), (3, [1, 2, 4]), (4, [0, 1, 2, 4]), (5, [0, 1, 2, 3, 4])):
        assert evaluation._to(head, raw, evaluation._least(head, raw, k)).tolist() == want


def test_ranks_in_families_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(vectors.products, "__defaults__", (5,))
    rng = np.random.default_rng(8)
    x = rng.normal(size=(23, 4)).round(2)
    rows = [(0, i, v.tolist()) for i, v in enumerate(x)]
    odd = [(0, 90, [1.0, 2.0]), (0, 91, [float("nan")] * 4), (0, 92, None), (0, 93, [0.0] * 4), (0, 94, [1.0, None, 1.0, 1.0])]
    df = spark.createDataFrame(rows + odd, "label int, vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = np.round(u @ u.T, 5)
    d = 1 - c
    np.fill_diagonal(d, 0)
    centre = int(np.round(d.sum(1), 4).argmin())
    assert vectors.medoids(df).first()["medoid"] == centre
    want = {i: round(float(np.mean([c[i, j] < c[i, centre] for j in range(23) if j not in (i, centre)])), 6) for i in range(23) if i != centre}
    got = {r["q"]: r["farther"] for r in vectors.farther_share(df).collect() if r["q"] < 90}
    assert got == want


def test_calibration_over_partitions(spark):
    rng = np.random.default_rng(2)
    p, y = rng.random(400).round(2), rng.integers(0, 2, 400)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y, strict=True)], "p double, label int").repartition(6)
    assert 0 < metrics.ece(df, F.col("p"), 15).first()["ece"] < 1
