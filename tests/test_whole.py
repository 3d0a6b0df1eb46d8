"""Registered queries see whole texts, whole vectors and all types: small tables against brute force."""

import hashlib
import math
import operator
import random
from collections import Counter

import pytest

from pairbench.plans import catalog, study

QUERY = {name: query for name, query, _ in catalog.CATALOG + study.CATALOG}
TEXTS = {1: "The quick brown fox, 12 jumps over the lazy dog! " * 7, 8: "Ab, cd" * 30 + "zyx", 3: "abc", 4: "", 5: None, 6: "gattaca " * 9}


def bases(text):
    return None if text is None else "".join("ACGT"[(ord(c) - 97) % 4] for c in text.lower() if "a" <= c <= "z")


def other(seq):
    return seq[::-1].translate(str.maketrans("ACGT", "TGCA"))


SEQ = {i: bases(t) for i, t in TEXTS.items()}


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("texts"))
    spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, 1), (8, 0), (6, 1)], "doc_id long, quality int").write.parquet(f"{d}/labels.parquet")
    return d


def test_kmers_of_whole_texts(spark, texts):
    n, same = Counter(), Counter()
    for s in SEQ.values():
        for i in range(len(s or "") - 5):
            w = s[i : i + 6]
            n[min(w, other(w))] += 1
            same[min(w, other(w))] += w == other(w)
    got = {r["kmer"]: (r["n"], r["n_palindromes"]) for r in QUERY["kmer_vocabulary"](spark, texts).collect()}
    assert got == {w: (n[w], same[w]) for w in n}


def scanned():
    out = {}
    for i, s in SEQ.items():
        for name, w in study.MOTIFS.items():
            x = [sum(w[4 * j + "ACGT".index(c)] for j, c in enumerate(t[a : a + 6])) for t in (s or "", other(s or "")) for a in range(len(t) - 5)]
            if x:
                out[i, name] = (max(x), math.log(sum(map(math.exp, x))))
    return out


def test_motifs_of_whole_texts(spark, texts):
    got = {(r["doc_id"], r["motif"]): (r["best"], r["total"]) for r in QUERY["pwm_scan"](spark, texts).collect()}
    want = scanned()
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-5) for k in want)
    one = QUERY["pwm_select"](spark, texts).first()
    ap = {}
    for name in study.MOTIFS:
        for at, kind in enumerate(("best", "total")):
            rows = [(round(want[i, name][at], 5), label) for i, label in ((1, 1), (8, 0), (6, 1))]
            ap[f"{name}:{kind}"] = sum(sum(y for s, y in rows if s >= score) / sum(s >= score for s, _ in rows) for score, label in rows if label) / 2
    choice = min(ap, key=lambda c: (-round(ap[c], 6), c))
    assert (one["choice"], one["ap"]) == (choice, pytest.approx(ap[choice], abs=1e-6))


def test_windows_of_whole_texts(spark, texts):
    got = {r["chrom"]: (r["status"], r["window"]) for r in QUERY["window_cut"](spark, texts).collect()}
    want = {}
    for i, s in SEQ.items():
        w = (s or "")[i * 7 % 50 : i * 7 % 50 + 20]
        want[i] = ("ok", w) if len(w) == 20 else ("off_end", None)
    assert got == want and got[6][0] == "ok"


def test_manifest_and_strands_of_whole_texts(spark, texts):
    got = {r["doc_id"]: (r["length"], r["digest"]) for r in QUERY["fasta_manifest"](spark, texts).collect()}
    assert got == {i: (None, None) if s is None else (len(s), hashlib.sha256(s.encode()).hexdigest()[:8]) for i, s in SEQ.items()}
    got = {r["doc_id"]: (r["seq"], r["rc"]) for r in QUERY["revcomp_palindromes"](spark, texts).collect()}
    assert got == {i: (s, None if s is None else other(s)) for i, s in SEQ.items()}


def test_profiles_of_whole_vectors(spark, tmp_path):
    rng = random.Random(8)
    vectors = {i: [rng.gauss(0, 1) for _ in range(9)] for i in range(12)}
    vectors = {i: [x / math.hypot(*v) for x in v] for i, v in vectors.items()}
    spark.createDataFrame([(i, i % 2, v) for i, v in vectors.items()], "vec_id long, label int, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = {}
    for q, v in vectors.items():
        near = sorted((-round(sum(map(operator.mul, v, vectors[j])), 5), j) for j in vectors if j != q and j % 2 == q % 2)[:5]
        w = [max(-c, 0.0) for c, _ in near]
        for pos in range(9):
            x = [vectors[j][pos] for _, j in near]
            want[q, pos] = sum(map(operator.mul, w, x)) / sum(w) if sum(w) else sum(x) / len(x)
    got = {(r["q"], r["pos"]): r["value"] for r in QUERY["knn_predict"](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=2e-5) for k in want)


def test_matrix_of_more_than_1000_types(spark, tmp_path):
    rows = [(i % 3, f"t{i}", float(i)) for i in range(1203)]
    spark.createDataFrame(rows, "user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {(r["user_id"], r["event_type"]): (r["cell"], r["missing"]) for r in QUERY["matrix_completeness"](spark, str(tmp_path)).collect()}
    want = {(u, f"t{i}"): (None, True) for u in range(3) for i in range(1203)} | {(u, t): (x, False) for u, t, x in rows}
    assert got == want
