import gzip
import zipfile

import pytest
from pairbench.operators import domains, motifs
from pairbench.sources import raw
from pairbench.streaming import summaries

ROWS = "AAAAAAAA\tTTTTTTTT\t.49\nAAAAAAAC\tGTTTTTTT\t-.10\n"


@pytest.mark.parametrize("head", ["", "8-mer\t8-mer\tE-score\n"])
def test_zipped_tables(spark, tmp_path, head):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("X/one.txt", head + ROWS)
    lines = raw.cells(raw.zipped_lines(spark, str(tmp_path / "*.zip")))
    got = lines.selectExpr("cells[0] AS a", "cells[1] AS b", "cells[2] AS c")
    assert got.count() == 2
    assert raw.score_column(got, ["a", "b", "c"]) == "c"


def test_score_column_must_be_one(spark):
    df = spark.createDataFrame([("-.1", ".2", "7"), (".3", "-.4", "8")], "x string, y string, z string")
    with pytest.raises(raw.NoScoreColumn):
        raw.score_column(df, ["x", "y", "z"])
    assert raw.score_column(df.toDF("e_score", "y", "z"), ["e_score", "y", "z"]) == "e_score"


def test_record_stream(spark, tmp_path):
    with gzip.open(tmp_path / "s.gz", "wt") as f:
        f.write("^SAMPLE = A\n1\n2\n^SAMPLE = B\n3\n")
    path = str(tmp_path / "s.gz")
    got = {r["id"]: r["body"].split() for r in raw.records(spark, path, "^SAMPLE = ").collect()}
    assert got == {"A": ["1", "2"], "B": ["3"]}
    assert raw.records(spark, path, "^SAMPLE = ", spark.createDataFrame([("B",)], "id string")).count() == 1


def test_weight_matrices(spark, tmp_path):
    (tmp_path / "m.txt").write_text(">a\n1 0 0 0\n0 1 0 0\n>a\n0 0 0 1\n")
    assert [tuple(r) for r in raw.weight_matrices(spark, str(tmp_path / "m.txt")).collect()] == [("a", [1.0, 0, 0, 0, 0, 1, 0, 0])]
    for bad in (">b\n0 0 1\n", ">b\n0 0 1 x\n", ">b\n", ">b\n0 0\n0 0\n"):
        (tmp_path / "m.txt").write_text(bad)
        with pytest.raises(ValueError, match="'b'"):
            raw.weight_matrices(spark, str(tmp_path / "m.txt"))


def test_domain_calls(spark):
    seq, h = "A" * 100, lambda f, a, b, s=9.0: (s, f, a, b)
    rows = [("one", [h("Hd", 30, 60)]), ("head", [h("Hd", 3, 20)]), ("tail", [h("Hd", 80, 98)]), ("mixed", [h("Hd", 10, 30), h("Pou", 50, 70)]), ("repeat", [h("Hd", 10, 20), h("Hd", 40, 50)]), ("none", []), ("null", None), ("same", [h("Hd", 10, 30), h("Hd", 12, 31, 5.0)])]
    df = spark.createDataFrame([(n, seq, x) for n, x in rows], f"n string, seq string, hits array<{domains.HIT}>")
    got = {r["n"]: (r["status"], r["label"], r["first"], r["last"]) for r in domains.call(df, "seq", "hits", ["Hd", "Pou"]).collect()}
    assert got["one"] == ("ok", "Hd", 20, 70) and got["head"] == ("ok", "Hd", 1, 30) and got["tail"] == ("ok", "Hd", 70, 100)
    assert got["mixed"][:2] == ("mixed", "Hd, Pou") and got["repeat"][0] == "repeat_array" and got["same"][0] == "ok"
    assert got["none"][0] == got["null"][0] == "no_domain"


def test_motif_similarity():
    m = [1.0, 0, 0, 0, 0, 2, 0, 0, 0, 0, 3, 0, 0, 0, 0, 1, 2, 0, 0, 0, 0, 1, 0, 0]
    assert round(motifs.similarity(m, m), 6) == 1
    assert round(motifs.similarity(m, m[::-1]), 6) == 1  # the other strand
    assert motifs.similarity(m, m[:8]) == -1


def test_running_summary(spark, tmp_path):
    folder = str(tmp_path / "in")
    df = spark.createDataFrame([(1, 1, 0.5, 1), (1, 1, 0.1, 0), (2, 1, 0.2, 0)], "entity long, source long, score double, label int")
    df.write.parquet(folder)
    q = summaries.summary(summaries.measurements(spark, folder, df.schema)).writeStream.format("memory").queryName("running").outputMode("complete").start()
    try:
        q.processAllAvailable()
        assert {tuple(r) for r in spark.table("running").collect()} == {(1, 1, 2, 0.5, 1), (2, 1, 1, 0.2, 0)}
    finally:
        q.stop()
