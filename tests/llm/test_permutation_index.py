import numpy as np
import pytest
from pyspark.sql import functions as F


def test_copies_take_one_place_of_the_depth():
    from pairbench.llm import permutation_index as index

    rng = np.random.default_rng(1)
    pivots, q = rng.normal(size=(128, 16)), rng.normal(size=16)
    near = q + 0.05 * rng.normal(size=(10, 16))
    x = np.concatenate([rng.normal(size=(490, 16)), near, np.repeat(q[None, :] / 2, 1500, 0)])
    ids = np.arange(len(x))
    _, got, score = index.search(ids, x, np.array([9999]), q[None, :], pivots, 5, 0.1)
    want = np.lexsort((ids, -(x @ q)))[:5]
    assert got.tolist() == want.tolist() and score.tolist() == pytest.approx((x @ q)[want].tolist())


def test_copies_are_all_found():
    from pairbench.llm import permutation_index as index

    rng = np.random.default_rng(2)
    pivots, some = rng.normal(size=(32, 8)), rng.normal(size=(40, 8))
    x = some[rng.integers(0, 40, 300)]
    ids = rng.permutation(300) // 2  # every id twice
    for k in (1, 7, 400):
        _, got, _ = index.search(ids, x, np.array([3]), x[:1], pivots, k, 1.0)
        order = np.lexsort((ids, -(x @ x[0])))
        assert got.tolist() == ids[order[ids[order] != 3]][:k].tolist()


def test_pivots_are_distinct(spark):
    from pairbench.llm.permutation_index import distinct_vectors

    rows = spark.createDataFrame([([1.0, float(i % 150 if i % 3 else 7)],) for i in range(900)], "v array<double>")
    assert len({tuple(v) for v in distinct_vectors(rows, 64)}) == 64
    assert distinct_vectors(rows.limit(0), 64) == []


def best(rows, k):
    """Brute force over (id, vector): each query id asks once with its least vector."""
    good = [(i, v) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v) and len(v) == 3]
    asks = {}
    for i, v in good:
        if i % 20 == 0:
            asks[i] = min(asks.get(i, v), v)
    out = []
    for q, x in asks.items():
        near = sorted((-float(np.dot(np.array(v), np.array(x))), i) for i, v in good if i != q)[:k]
        out += [(q, r + 1, i, round(-s, 9)) for r, (s, i) in enumerate(near)]
    return sorted(out)


def test_odd_vectors_equal_brute_force(spark):
    """Null, zero and non-finite vectors, null ids, repeated ids, ties, other lengths, clashing columns."""
    from pairbench.llm.permutation_index import nearest

    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.integers(-3, 4, 3)]) for i in range(1, 30)] + [(20, [1.0, 2.0, 3.0])] * 3 + [(0, [1.0, 1.0, 0.0]), (0, [0.5, 1.0, 0.0])]
    rows += [(40, None), (60, [0.0, 0.0, 0.0]), (80, [float("nan"), 1.0, 1.0]), (100, [None, 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (21, [float("inf"), 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], "vec_id long, embedding array<double>, id string, v int, q int")
    got = nearest(df, F.col("vec_id") % 20 == 0, k=20, depth=1.0)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted((r[0], r[1], r[2], round(r[3], 9)) for r in got.collect()) == best(rows, 20)
    assert nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert nearest(df.where("vec_id > 100"), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("n", [500, 2000, 20_000])
def test_recall_of_the_index_alone(n):
    from pairbench.llm import permutation_index as index

    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, hits = np.arange(n), 0
    pivots = x[rng.permutation(n)[: index.PIVOTS]]
    got = np.concatenate([index.search(ids[b], x[b], ids[:40], x[:40], pivots, 20, index.DEPTH)[:2] for b in np.array_split(ids, n // index.BLOCK + 1)], 1)
    for q in range(40):
        s = x @ x[q]
        s[q] = -2
        hits += len(set(np.argsort(-s)[:20].tolist()) & set(got[1][got[0] == q].tolist()))
    assert hits >= 0.9 * 800
