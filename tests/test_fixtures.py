"""The fixtures' hand values for the operators of this package; F-n names the fixture."""

import gzip

import pytest
from pairbench.operators import alignment, canonical, contract, evaluation, holdouts, lookup, motifs, naming, records, reports, vectors, windows
from pairbench.sources import raw, sinks
from pyspark.sql import functions as F

WT = "ACDEFGHIKLMNPQRSTVWY" * 3
MUT = WT[:10] + "A" + WT[11:]


def frame(spark, *edits):
    """F-1: four good rows, then edits as (row, column, value)."""
    names = [f.name for f in contract.FIELDS if f.name not in contract.DERIVED]
    rows = []
    for seq, n, at in ((WT, 0, ""), (MUT, 1, "11")):
        for dna, score, label, why in (("TAATTAGC", 0.49, 1, None), ("GGGGCCCC", 0.11, 0, "assayed_unbound")):
            rows.append(dict(zip(names, [seq, "Homeodomain", "src", "TEST_WT", n, at, None, None, dna, "full", label, score, "pbm_escore", 0.45, 0.35, "PBM", "", why, "S", "f"], strict=True)))
    for i, name, value in edits:
        rows[i][name] = value
    kinds = ", ".join(f"{f.name} {f.kind}" for f in contract.FIELDS if f.name in names)
    return contract.coerce(spark.createDataFrame([tuple(r[n] for n in names) for r in rows], kinds))


def faults(df):
    return {r["check"]: r["n_rows"] for r in contract.validate(df).collect() if r["n_rows"]}


def test_good_frame_has_no_fault(spark):
    df = frame(spark)
    assert faults(df) == {} and df.columns == [f.name for f in contract.FIELDS]
    assert faults(contract.empty(spark)) == {"no_rows": 1}
    assert {r["check"] for r in contract.validate(df).collect()} >= {"pair_id_duplicate", "ragged", "null:label"}


@pytest.mark.parametrize(
    ("edit", "check"),
    [
        ((1, "neg_provenance", None), "provenance_missing"), ((1, "neg_provenance", "guess"), "provenance_unknown"), ((0, "dna_seq", "TAATTAGN"), "dna_alphabet"),
        ((0, "dna_seq", "A" * 21), "dna_too_long"), ((2, "mut_positions", "11,12"), "position_count"), ((2, "mut_positions", "99"), "position_range"),
        ((0, "threshold_pos", 0.2), "thresholds"), ((0, "label", 5), "label"), ((0, "raw_score", 0.7), "score_bounds"), ((0, "dna_context", "half"), "dna_context"),
        ((0, "assay", None), "null:assay"), ((0, "neg_provenance", "synthetic"), "provenance_on_others"), ((1, "dna_seq", "TAATTAGC"), "pair_id_duplicate"),
    ],
)
def test_each_fault_is_found(spark, edit, check):
    assert faults(frame(spark, edit)).get(check) == 1


def test_faults_of_derived_and_constructs(spark):
    df = frame(spark)
    assert faults(df.withColumn("dna_len", F.lit(9))) == {"dna_len": 4}
    assert faults(df.withColumn("pair_id", F.when(F.col("label") == 1, "x").otherwise(F.col("pair_id"))))["pair_id"] == 2
    assert faults(frame(spark, (0, "dbd_seq", WT.lower()), (1, "dbd_seq", WT.lower()))).get("residue_case") == 2
    assert faults(frame(spark, *[(i, "n_mut_from_wt", 1) for i in (0, 1)], *[(i, "mut_positions", "3") for i in (0, 1)])) == {"reference_elsewhere": 1}
    assert faults(frame(spark, (0, "label", -1))) == {}
    with pytest.raises(ValueError, match="unexpected"):
        contract.coerce(df.withColumn("more", F.lit(1)))
    with pytest.raises(ValueError, match="missing"):
        contract.coerce(df.drop("assay"))


def test_replicate_agreement(spark):
    """F-7."""
    rows = [("e", s, i, y, i / 10 if s == "A" else -i / 10) for s, ys in (("A", [1, 0, 0, 0, 0]), ("B", [0, 1, -1, 0, 0])) for i, y in enumerate(ys)]
    m = spark.createDataFrame(rows, "entity string, source string, slot int, label int, score double")
    r = records.replicate_pairs(m).first()
    assert (r["n_common"], r["n_hard"], r["n_differ"], r["jaccard"], r["rho"], r["low_jaccard"], r["low_rho"]) == (5, 4, 2, 0.0, -1.0, True, True)
    same = records.replicate_pairs(m.where("source = 'A'").unionByName(m.where("source = 'A'").withColumn("source", F.lit("C")))).first()
    assert (same["jaccard"], same["rho"], same["low_jaccard"]) == (1.0, 1.0, False)
    assert records.replicate_pairs(m.where("source = 'A'")).count() == 0


def test_hard_set(spark):
    """F-11."""
    rows = [("a", "all", 1, None, "ok"), ("b", "all", 1, 0.1, "ok"), ("c", "all", 1, 0.9, "ok"), ("d", "all", 5, 0.1, "ok"), ("e", "f0", 1, 0.1, "ok"), ("f", "all", 1, 0.1, "no_evidence")]
    df = spark.createDataFrame(rows, "domain string, fold string, k int, ap double, verdict string").withColumn("family", F.lit("x"))
    assert {(r["domain"], r["reason"]) for r in evaluation.hard_set(df).collect()} == {("a", "dead"), ("b", "low")}
    assert evaluation.hard_summary(evaluation.hard_set(df), df, "family").first()[:] == ("x", 6, 2, 1, round(2 / 6, 6))


def test_kinds_of_edits(spark):
    """F-12, with kinds, identity and guard."""
    pairs = spark.createDataFrame([(WT, MUT), (WT, WT[:30] + WT[31:]), (WT, WT[:30] + "W" + WT[30:]), ("W" * 10 + "KKKKK", "KKKKK" + "Y" * 10)], "r string, v string")
    got = {r["v"]: r for r in alignment.profiles(pairs, "r", "v").collect()}
    assert [(got[v]["n_sub"], got[v]["n_ins"], got[v]["n_del"]) for _, v in [tuple(r) for r in pairs.collect()][:3]] == [(1, 0, 0), (0, 0, 1), (0, 1, 0)]
    short = got["KKKKK" + "Y" * 10]
    assert (short["n_edits"], round(short["overlap"], 6), short["comparable"], short["identity"]) == (0, round(5 / 15, 6), False, 1.0)


def test_canonical_windows(spark):
    """F-14: a slice of the construct, the same string by way of a reference, and a flagged short one."""
    full = "".join("ACDEFGHIKLMNPQRSTVWY"[(i * 7 + i // 3) % 20] for i in range(100))
    bare = full[25:80]
    rows = [("whole", full, 21, 70, None), ("bare", bare, 1, 50, full), ("alone", bare, 1, 50, None), ("bad", "W" * 55, 1, 50, full), ("none", None, 1, 50, full)]
    got = {r["id"]: r for r in canonical.windows(spark.createDataFrame(rows, "id string, c string, f int, l int, r string"), "c", "f", "l", "r").collect()}
    assert (got["whole"]["window"], got["whole"]["origin"], got["whole"]["env_first"], got["whole"]["env_last"]) == (full[10:80], "construct", 11, 60)
    assert (got["bare"]["window"], got["bare"]["origin"], got["bare"]["full"]) == (full[15:85], "reference", True)
    assert (got["alone"]["window"], got["alone"]["origin"], got["alone"]["full"]) == (bare, "short", False)
    assert got["bad"]["origin"] == "short" and got["none"]["window"] is None
    groups = spark.createDataFrame([("a", full), ("a", full[5:90]), ("b", full), ("b", full[:50] + "W" + full[51:]), ("c", full)], "g string, c string")
    assert dict(canonical.conflicting(groups, "g", "c").collect()) == {"a": False, "b": True, "c": False}


def test_guarded_lookup(spark):
    """F-16 and F-18: binary calls are copied, ties to the lower row, guard, counted fallback, empty pool."""
    rows = [(0, [1.0, 1.0, 1.0, 1.0], True), (1, [1.0, 1.0, 1.0, 1.0], False), (2, [2.0, 2.0, 2.0, 2.0], False), (3, [-1.0, -1.0, -1.0, 1.0], False), (5, [-1.0, 1.0, -1.0, -1.0], True)]
    e = spark.createDataFrame([(0, i, v, h) for i, v, h in rows], "label int, vec_id long, embedding array<double>, held boolean")
    near = lookup.neighbours(e, "held", 1, 0.6)
    assert [(r["q"], r["v"], r["cosine"], r["overlap"]) for r in near.collect()] == [(0, 1, 1.0, 1.0)]
    cells = e.select(F.col("vec_id").alias("v"), F.posexplode("embedding").alias("pos", "x")).withColumn("x", F.when(F.col("x") > 1, -1).when(F.col("x") > 0, 1).otherwise(0))
    ids = e.select("held", F.col("vec_id").alias("v"))
    got = lookup.predict(near, lookup.binary_calls(cells), ids.where("held").select(F.col("v").alias("q")), ids.where("NOT held").select("v"))
    values = {(r["q"], r["pos"]): (r["value"], r["fallback"]) for r in got.collect()}
    assert values[0, 0] == (1.0, False) and values[5, 0] == (round(1 / 3, 6), True) and values[5, 3] == (round(2 / 3, 6), True)
    with pytest.raises(ValueError, match="empty training pool"):
        lookup.neighbours(e.withColumn("held", F.lit(True)), "held", 1, 0.6)


def test_blocks_of_vectors_equal_brute_force(spark, monkeypatch):
    """F-17, and products over several blocks."""
    monkeypatch.setattr(vectors.products, "__defaults__", (7,))
    import numpy as np

    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 6))
    df = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(x)] + [(0, 99, [0.0] * 6), (0, 98, None)], "label int, vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = u @ u.T
    want = {(i, j) for i in range(40) for j in range(i + 1, 40) if c[i, j] >= 0.3}
    assert {(r["i"], r["j"]) for r in vectors.edges(df, 0.3).collect()} == want
    assert vectors.medoids(df).first()["medoid"] == int((1 - c).sum(1).argmin())
    np.fill_diagonal(c, -2)
    assert {(r["q"], r["v"]) for r in vectors.nearest(df, 3).collect()} == {(i, int(j)) for i in range(40) for j in np.argsort(-c[i])[:3]}


def test_names(spark):
    names = spark.createDataFrame([("Hoxa1_K50A",), ("Hoxa1",), ("Pou_x_y",), ("Zic",)], "n string")
    refs = spark.createDataFrame([("Hoxa1",), ("Pou",), ("Pou_x",)], "r string")
    assert dict(naming.longest_prefix(names, refs, "n", "r").collect()) == {"Hoxa1_K50A": "Hoxa1", "Hoxa1": "Hoxa1", "Pou_x_y": "Pou_x", "Zic": None}
    seqs = spark.createDataFrame([("f", "ABCDEF"), ("f", "BCDE"), ("f", "CD"), ("g", "BCDE"), ("f", "XABCDEFX")], "f string, s string")
    assert {tuple(r) for r in naming.subsumed(seqs, "f", "s").collect()} == {("f", "ABCDEF", "XABCDEFX"), ("f", "BCDE", "XABCDEFX"), ("f", "CD", "XABCDEFX")}
    ids = naming.cluster_ids(spark.createDataFrame([("A", 2), ("C:A", 1), ("B", 3)], "b string, r int"), "b", "r")
    assert {(r["r"], r["cluster_id"]) for r in ids.collect()} == {(1, "C:A"), (2, "C:A#2"), (3, "C:B")}
    kept = spark.createDataFrame([({"x_REF": "A", "x_K5A": "B"},)], "m map<string,string>").select(naming.strip_keys(F.col("m"), "x_").alias("m")).first()["m"]
    assert kept == {"REF": "A", "K5A": "B"}


def test_motifs_without_a_fit_are_minus_one(spark):
    a, b = [1.0, 0.0, 0.0, 0.0] * 6, [0.0, 0.0, 0.0, 1.0] * 6
    assert motifs.similarity(a, a) == pytest.approx(1) and motifs.similarity(a, b) == pytest.approx(1) and motifs.similarity(a, a[:20]) == -1
    library = spark.createDataFrame([("m", a), ("n", [0.0, 1.0, 0.0, 0.0] * 6)], "name string, weights array<double>")
    assert motifs.best_against(library.where("name = 'm'"), library).first()[:] == ("m", "m", 1.0)


def test_windows_and_peaks(spark):
    """F-18."""
    rows = [("p", 1000), ("p", 5000), ("q", 1000), ("q", 1300), ("q", 1301)]
    got = windows.overlapping(spark.createDataFrame(rows, "g string, s long"), "g", "s", 301).collect()
    assert {(r["g"], r["s"]) for r in got} == {("p", 1000), ("q", 1000), ("q", 1300)}
    plan = spark.createDataFrame([(t, c, n) for t in ("TF1", "TF2") for c in ("chr1", "chr2") for n in ("", "shades", "random") for _ in range(5)], "tf string, chrom string, negset string")
    some = holdouts.select_rows(plan, ["TF1"], ["chr2"], "shades").groupBy("negset").count().collect()
    assert {tuple(r) for r in some} == {("", 5), ("shades", 5)}


def test_files(spark, tmp_path):
    (tmp_path / "a.bed").write_text("chr1\t10\t20\t15\nchr2\t5\t9\t.\n")
    assert [tuple(r) for r in raw.bed(spark, str(tmp_path / "a.bed")).collect()] == [("chr1", 10, 20, 15), ("chr2", 5, 9, None)]
    with gzip.open(tmp_path / "g.fa.gz", "wt") as f:
        f.write(">chr1 one\nACGT\nACGG\n>chr2\nTTTTT\n")
    genome = raw.fasta(spark, str(tmp_path / "g.fa.gz"))
    assert {(r["name"], r["seq"]) for r in genome.collect()} == {("chr1", "ACGTACGG"), ("chr2", "TTTTT")}
    tiled = raw.tiles(genome.select(F.col("name").alias("chrom"), "seq"), 3, 4)
    spans = spark.createDataFrame([("chr1", 2), ("chr1", 5), ("chr1", 6), ("chr2", 0), ("chr3", 0)], "chrom string, start long")
    assert {tuple(r) for r in raw.cut_tiles(spans, tiled, 3, 4).collect()} == {("chr1", 2, "GTA"), ("chr1", 5, "CGG"), ("chr1", 6, None), ("chr2", 0, "TTT"), ("chr3", 0, None)}
    (tmp_path / "w.txt").write_text("# all\nHox # one\n\nPou\n")
    assert {r[0] for r in raw.whitelist(spark, str(tmp_path / "w.txt")).collect()} == {"Hox", "Pou"}
    assert raw.digests(spark, str(tmp_path / "w.txt")).first()["length"] == 21
    keys, cache = spark.createDataFrame([("a",), ("b",), ("c",)], "k string"), spark.createDataFrame([("a", "x"), ("b", "")], "k string, v string")
    assert {tuple(r) for r in raw.lookup(keys, cache, "k", "v").collect()} == {("a", "x", "hit"), ("b", None, "miss"), ("c", None, "unknown")}
    with pytest.raises(ValueError, match="missing columns"):
        raw.named_columns(keys, {"z": "z"}, "z")
    with pytest.raises(raw.Truncated):
        raw.score_column(keys, ["k"], least=10)


def test_replicates_with_reasons(spark):
    """F-6."""
    rows = [("e", "1", "A", 0.49, 1, None), ("e", "1", "C", 0.49, 1, None), ("e", "2", "A", 0.48, 1, None), ("e", "2", "C", 0.1, 0, None), ("e", "3", None, None, None, "truncated")]
    df = spark.createDataFrame(rows, "g string, rep string, site string, score double, label int, why string")
    good, bad = raw.reconcile(df, "g", "rep", "site", "score", "label", "why")
    assert {(r["site"], r["label"], round(r["score"], 6)) for r in good.collect()} == {("A", 1, 0.485), ("C", -1, 0.295)}
    assert [tuple(r) for r in bad.collect()] == [("e", "3", "truncated")]
    with pytest.raises(ValueError, match="differ"):
        raw.reconcile(df.where("NOT (rep = '2' AND site = 'C')"), "g", "rep", "site", "score", "label", "why")


def test_sinks(spark, tmp_path):
    at = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, v string")
    sinks.append_new(df, at, ["k"])
    sinks.append_new(spark.createDataFrame([(2, "b"), (3, "c")], "k int, v string"), at, ["k"])
    assert sorted(r["k"] for r in spark.read.parquet(at).collect()) == [1, 2, 3]
    sinks.arrays(spark.createDataFrame([("x", 2, 0.5), ("x", 1, 0.25)], "k string, site int, s double"), "k", "site", ["s"], str(tmp_path / "a"))
    assert spark.read.parquet(str(tmp_path / "a")).first()[:] == ("x", [1, 2], [0.25, 0.5])
    assert raw.catalog(spark, str(tmp_path), ("a",)) == ["t"]
    with pytest.raises(Exception):
        sinks.build(lambda: df.select(F.raise_error(F.lit("no"))), at, spark)
    assert raw.catalog(spark, str(tmp_path)) == ["a"]
    sinks.text(reports.markdown(df.where("k = 2")), str(tmp_path / "r.md"), spark)
    assert (tmp_path / "r.md").read_text() == "| k | v |\n| - | - |\n| 2 | b |\n"


def test_rank_ceiling_and_losses(spark):
    import math

    cells = spark.createDataFrame([(f"e{i}", f"s{j}", int(i == j)) for i in range(4) for j in range(4)], "entity string, site string, label int")
    got = {r["rank"]: r["ap"] for r in evaluation.rank_ceiling(cells, [1, 3]).collect()}
    assert got[3] == 1.0 and got[1] < 1.0
    pairs = spark.createDataFrame([("q", 2.0, 1), ("q", 0.0, 0), ("q", 9.0, -1)], "q string, logit double, label int")
    r = evaluation.losses(pairs, "q").first()
    assert r["nce"] == round(math.log(1 + math.exp(-2)), 5) and r["bce"] == round((math.log(1 + math.exp(-2)) + math.log(2)) / 2, 5)
