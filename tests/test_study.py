import os

from pairbench.operators import alignment, components, metrics, profiles, splits
from pairbench.sources import sinks
from pyspark.sql import functions as F

BASE = "ACDEFGHIKLMNPQRSTVWY" * 4


def test_edit_profile():
    e = alignment.edit_profile
    assert e("MKKLLAAA", "MKKLLAAA")[0] == 0
    assert e("MKKLLAAA", "MKKLWAAA") == (1, [5], 8)
    assert e(BASE, BASE[:30] + "W" + BASE[30:])[:2] == (1, [31])
    assert e(BASE, BASE[:30] + BASE[31:])[:2] == (1, [31])
    assert e(BASE, BASE[:30] + BASE[32:])[0] == 2
    assert e(BASE, BASE[3:])[0] == 0
    assert e(BASE, BASE[3:], free_ends=False)[0] == 3
    assert e("M" * 10 + "KKKKKAAAAA", "KKKKKAAAAA") == (0, [], 10)
    assert e("W" * 10 + "KKKKK", "KKKKK" + "Y" * 10) == (0, [], 5)


def test_matrix_is_a_parameter():
    score = alignment.read_matrix("# made up\n  A C\nA 4 -1\nC -1 9\n")
    assert score("A", "C") == -1 and score("C", "C") == 9


def test_clusters_join_first_seed():
    one, back = BASE[:9] + "C" + BASE[10:], BASE[::-1]
    got = alignment.cluster([(BASE, 0), (one, 1), (back, 2), (BASE + "A", 3)], 3, 0.6)
    assert got == [3, 3, 2, 3]


def test_greedy_clusters_stay_in_families(spark):
    df = spark.createDataFrame([("x", 1, BASE), ("x", 2, BASE), ("y", 3, BASE), ("y", 4, None)], "f string, k long, s string")
    got = {tuple(r) for r in alignment.greedy_clusters(df, "f", "k", "s").collect()}
    assert got == {(1, "x", BASE), (2, "x", BASE), (3, "y", BASE)}


def test_components(spark):
    chain = [(i + 1, i) for i in range(1, 30)] + [(50, 40), (40, 60), (70, 70)]
    nodes = spark.createDataFrame([(i,) for i in [*range(1, 31), 40, 50, 60, 70, 80]], "id long")
    got = dict(components.components(spark.createDataFrame(chain, "u long, v long"), nodes).collect())
    assert got == {**{i: 1 for i in range(1, 31)}, 40: 40, 50: 40, 60: 40, 70: 70, 80: 80}


def test_components_without_edges(spark):
    nodes = spark.createDataFrame([(1,), (2,)], "id long")
    assert dict(components.components(spark.createDataFrame([], "u long, v long"), nodes).collect()) == {1: 1, 2: 2}


def test_suppression(spark):
    """F-9: identical 0, negated 1, rescaled 0; without a bound site undefined."""
    ref = [1.0, 2.0, 3.0, 40.0, 50.0]
    rows = [(0, "g", i, x) for i, x in enumerate(ref)] + [(1, "g", i, -x) for i, x in enumerate(ref)] + [(2, "g", i, 3 * x + 7) for i, x in enumerate(ref)]
    cells = spark.createDataFrame(rows, "e int, g string, s int, v double")
    got = dict(profiles.suppression(cells.withColumn("y", (F.col("s") > 2).cast("int")), "e", "g", "s", "v", "y").collect())
    assert got == {0: 0.0, 1: 1.0, 2: 0.0}
    assert set(dict(profiles.suppression(cells.withColumn("y", F.lit(0)), "e", "g", "s", "v", "y").collect()).values()) == {None}


def test_ece(spark):
    def of(labels, ps, bins):
        return metrics.ece(spark.createDataFrame(list(zip(labels, map(float, ps), strict=True)), "label int, p double"), F.col("p"), bins).first()["ece"]

    assert of([1, 1, 0, 0, 0, 0], [1.0, 1, 0, 0, 0, 0], 2) == 0
    assert of([0, 0, 1, 1], [1.0, 1, 0, 0], 2) == 1
    assert of([1, 0], [0.75, 0.25], 15) == 0.25  # fewer rows than bins


def test_expected_count(spark):
    def of(ps):
        df = spark.createDataFrame([("g", p - 0.5) for p in ps], "g string, score double")
        return profiles.expected_count(df, "g").first()["cutoff"]

    assert round(of([0.9, 0.8, 0.2, 0.05, 0.05]), 6) == 0.8
    assert of([0.001, 0.002, 0.001]) == float("inf")


def test_folds_and_carve(spark):
    sizes = {"a": 7, "b": 5, "c": 4, "d": 3, "e": 1}
    df = spark.createDataFrame([(g,) for g, n in sizes.items() for _ in range(n)], "g string")
    folds = {r["g"]: r["fold"] for r in splits.group_folds(df, "g", 2, "s").collect()}
    assert folds == {"a": 0, "b": 1, "c": 1, "d": 0, "e": 1} or folds == {"a": 0, "b": 1, "c": 1, "d": 0, "e": 0}
    taken = sum(r["n"] for r in splits.validation_carve(df, "g", 0.2, "s").collect())
    assert 0 < taken <= 5
    assert splits.overlap(df.where("g = 'a'"), df.where("g <> 'a'"), "g").first()[0] == 0


def test_replace_own_input(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.parquet(spark.range(10), path)
    sinks.replace(spark.read.parquet(path).where("id < 3"), path)
    assert sorted(r[0] for r in spark.read.parquet(path).collect()) == [0, 1, 2]
    assert sorted(os.listdir(tmp_path)) == ["t"] or all(x.startswith(("t", ".t")) for x in os.listdir(tmp_path))


def test_fasta_wraps(spark):
    got = spark.createDataFrame([("x", "A" * 60 + "C")], "n string, s string").select(sinks.fasta_record(F.col("n"), F.col("s"))).first()[0]
    assert got == ">x\n" + "A" * 60 + "\nC"
