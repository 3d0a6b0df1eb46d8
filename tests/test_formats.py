"""Data sources read in parts give what reading whole files gives."""

import gzip
import random
import zipfile

import pytest
from pairbench.sources import formats, raw


@pytest.mark.parametrize("span", [1, 7, 50, 1 << 20])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_by_ranges(spark, tmp_path, span, end):
    text = f"before{end}^S = A{end}1{end}{end}2{end}^S = B{end}^S = C{end}3"
    (tmp_path / "a.soft").write_bytes(text.encode())
    with gzip.open(tmp_path / "b.soft.gz", "wb") as f:
        f.write(text.encode())
    got = formats.records(spark, f"{tmp_path}/*.soft*", "^S = ", span=span).orderBy("path", "at").collect()
    assert [(r["id"], r["body"]) for r in got] == [("A", "1\n\n2"), ("B", ""), ("C", "3")] * 2
    if span == 7:
        assert formats._read(spark, "marked_text", f"file://{tmp_path}/a.soft", marker="^S = ", span=7).rdd.getNumPartitions() > 3


@pytest.mark.parametrize(("span", "piece"), [(11, 5), (64, 1), (1 << 20, 1 << 16)])
def test_genome_in_tiles(spark, tmp_path, span, piece):
    rng = random.Random(span)
    seqs = {f"chr{i}": "".join(rng.choice("ACGTN") for _ in range(n)) for i, n in enumerate((0, 3, 40, 137))}
    with open(tmp_path / "g.fa", "w") as f:
        for name, s in seqs.items():
            f.write(f">{name} some words\n" + "".join(s[i : i + 10] + "\n" for i in range(0, len(s), 10)))
    with gzip.open(tmp_path / "h.fa.gz", "wt") as f:
        f.write(">other\nACGTACGT\nAC\n")
    width, size = 6, 16
    tiles = formats.genome(spark, f"{tmp_path}/*.fa*", width, size, span, piece)
    seqs["other"] = "ACGTACGTAC"
    want = {(n, k, s[k * size : k * size + size + width - 1]) for n, s in seqs.items() for k in range((len(s) - 1) // size + 1)}
    assert {tuple(r) for r in tiles.collect()} == want
    spans = spark.createDataFrame([(n, a) for n in seqs for a in range(0, 140, 9)], "chrom string, start long")
    got = {(r["chrom"], r["start"]): r["window"] for r in raw.cut_tiles(spans, tiles, width, size).collect()}
    assert all(got[n, a] == (s[a : a + width] if len(s) >= a + width else None) for n, s in seqs.items() for a in range(0, 140, 9))


def test_zip_members(spark, tmp_path):
    for k in range(2):
        with zipfile.ZipFile(tmp_path / f"{k}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            for m in range(3):
                z.writestr(f"d/{m}.txt", "".join(f"{k} {m} {i}\n" for i in range(m)))
    df = formats.zipped_lines(spark, f"{tmp_path}/*.zip")
    assert df.rdd.getNumPartitions() == 6
    assert sorted(r["line"] for r in df.collect()) == sorted(f"{k} {m} {i}" for k in range(2) for m in range(3) for i in range(m))
    with pytest.raises(Exception, match="none"):
        formats.zipped_lines(spark, f"{tmp_path}/none.zip").collect()
