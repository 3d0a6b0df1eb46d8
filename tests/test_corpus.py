"""The training view's errors, nulls and defaults."""

import numpy as np
import pytest
from pairbench.operators import alignment, corpus, domains, motifs
from pyspark.sql import functions as F


def test_matrices_refuse_duplicates_and_gaps(spark):
    cells = spark.createDataFrame([(r, c, 10 * r + c) for r in range(3) for c in "ab" for c in [ord(c)]], "r int, c int, v int")
    matrix, rows, cols = corpus.complete_matrix(cells, "r", "c", "v")
    assert dict(matrix.collect()) == {i: [10 * i + 97, 10 * i + 98] for i in range(3)} and rows.count() == 3 and cols.count() == 2
    with pytest.raises(ValueError, match="more than once"):
        corpus.complete_matrix(cells.union(cells.limit(1)), "r", "c", "v")
    with pytest.raises(ValueError, match=r"missing cells: \[2\]"):
        corpus.complete_matrix(cells.where("NOT (r = 2 AND c = 97)"), "r", "c", "v")


def test_usable_and_names(spark):
    rows = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x"), (None, "x")], "e string, s string")
    verdicts = spark.createDataFrame([("a", "x", "ok"), ("b", "x", "no_evidence"), ("c", "x", "dead_variant")], "e string, s string, verdict string")
    left = lambda keep: sorted(str(r[0]) for r in corpus.usable(rows, verdicts, ["e", "s"], keep).collect())
    assert left(True) == ["None", "a", "c"] and left(False) == ["None", "a"]
    names = spark.createDataFrame([("a", "x", "zeta"), ("a", "x", "beta"), ("b", "x", ""), (None, "x", "none")], "e string, s string, gene string")
    own = rows.withColumn("id", F.when(F.col("e") == "c", "P1"))
    got = {r["e"]: r["gene"] for r in corpus.with_names(own, names, ["e", "s"], "gene", "id").collect()}
    assert got == {"a": "beta", "b": "(unnamed)", "c": "P1", None: "none"}


def test_lookups_that_must_be_complete(spark):
    keys = spark.createDataFrame([(1,), (2,)], "k int")
    vectors = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0])], "k int, x array<double>")
    got = {r["k"]: (r["padded"], r["mask"]) for r in corpus.gathered(keys, vectors, "k", "x").collect()}
    assert got == {1: ([1.0, 2.0], [True, True]), 2: ([3.0, 0.0], [True, False])}
    with pytest.raises(KeyError):
        corpus.gathered(keys, vectors.where("k = 1"), "k", "x")
    assert [r["n"] for r in corpus.annotate(keys, spark.createDataFrame([(1, 5)], "k int, n int"), "k", {"n": F.lit(-1)}).orderBy("k").collect()] == [5, -1]
    with pytest.raises(ValueError, match="more than one"):
        corpus.annotate(keys, keys.union(keys), "k", {"k": F.lit(0)})


def test_indels_are_refused(spark):
    ref = "ACDEFGHIKLMNPQRSTVWY" * 2
    pairs = spark.createDataFrame([(ref, ref[:5] + "A" + ref[6:])], "r string, v string")
    good = alignment.profiles(pairs, "r", "v")
    assert corpus.substitutions_only(good, "r", "v").first()["positions"] == [6]
    with pytest.raises(ValueError, match="insertions or deletions"):
        corpus.substitutions_only(alignment.profiles(spark.createDataFrame([(ref, ref[:20] + ref[21:])], "r string, v string"), "r", "v"), "r", "v")
    at = spark.range(1).select(corpus.rebased(F.array(F.lit(3), F.lit(12), F.lit(40)), F.lit(5), F.lit(20)).alias("x")).first()["x"]
    assert (at["kept"], at["lost"]) == ([7], [-2, 35])


def test_letters_beyond_the_alphabet(spark):
    w = [1.0, 0, 0, 0, 0, 2, 0, 0]
    df = spark.createDataFrame([(1, "NACN"), (2, "ANC"), (3, "acg"), (4, None), (5, "GTAC")], "k int, s string")
    got = {r["k"]: r["best"] for r in motifs.scan(df, "s", {"m": w}).collect()}
    assert got == {1: 3.0, 5: 3.0}


def test_no_domain_has_no_window(spark):
    df = spark.createDataFrame([("A" * 50, [])], f"s string, h array<{domains.HIT}>")
    r = domains.call(df, "s", "h", ["X"]).first()
    assert (r["status"], r["first"], r["last"], r["window"]) == ("no_domain", None, None, None)


def test_loss_of_one_group(spark):
    rows = [("a", 0.5, 2.0, 1), ("a", -0.5, 1.0, 0), ("a", 0.1, 0.5, 0), ("b", 1.0, 1.0, 1), ("b", 1.0, 9.0, -1)]
    r = corpus.genomic_loss(spark.createDataFrame(rows, "g string, logit double, cosine double, label int"), "g", 2.0).first()
    nce = -np.log(np.exp(2) / (np.exp(2) + np.exp(1) + np.exp(0.5)))
    bce = np.mean([np.log1p(np.exp(x)) - y * x for x, y in ((0.5, 1), (-0.5, 0), (0.1, 0), (1.0, 1))])
    assert (r["bce"], r["nce"], r["loss"]) == pytest.approx((bce, nce, bce + 2 * nce), abs=2e-5)
