"""Filtered pairs, greedy clusters in rounds, and places of constructs, against plain versions."""

import random

import pytest
from pairbench.operators import alignment, canonical, similar
from pyspark.sql import functions as F


def family(rng, n, size, letters="ACDEFGHIKLMNPQRSTVWY", edits=8):
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(size // 2, size))) for _ in range(max(2, n // 8))]
    out = []
    for _ in range(n):
        s = list(rng.choice(base))
        for _ in range(rng.randrange(edits)):
            at = rng.randrange(len(s) + 1)
            kind = rng.randrange(3)
            s[at : at + (kind < 2)] = [] if kind == 0 else [rng.choice(letters)]
        out.append("".join(s))
    return out


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize(("most", "letters", "size"), [(1, "AB", 14), (3, "ACDEFGHIKL", 40), (2, "ACGT", 9)])
def test_whole_pairs(spark, most, letters, size):
    rng = random.Random(most)
    seqs = [(rng.choice("xy"), s) for s in family(rng, 50, size, letters, 5) + ["", "A", "AB", None]]
    got = similar.near(spark.createDataFrame(seqs + seqs[:5], "f string, s string"), "f", "s", most, whole=True)
    want = {(f, *sorted((a, b), key=lambda s: (len(s), s)), lev(a, b)) for f, a in seqs for g, b in seqs if f == g and a and b and a < b and lev(a, b) <= most}
    assert {(r["family"], r["a"], r["b"], r["n_edits"]) for r in got.collect()} == want


def test_pairs_and_clusters_of_the_rule(spark):
    """Pairs by edits and overlap, across families too; clusters as one by one; families over many tasks."""
    rng = random.Random(11)
    rows = [(f, i, s) for f in ("x", "y") for i, s in enumerate(family(rng, 40, 60))]
    df = spark.createDataFrame(rows + [("x", 99, None), ("y", 98, "")], "f string, k int, s string").repartition(5)
    seqs = sorted({s for _, _, s in rows}, key=lambda s: (len(s), s))
    pairs = [(a, b) for i, a in enumerate(seqs) for b in seqs[i + 1 :]]
    got = alignment.edit_profiles([(b, a) for a, b in pairs])
    want = {p for p, g in zip(pairs, got, strict=True) if g[0] <= 5 and g[2] >= 0.6 * len(p[0])}
    found = similar.near(df, None, "s")
    assert {(r["a"], r["b"]) for r in found.collect()} == want and len(want) < len(pairs) / 2
    asked = similar.candidates(df.where("s <> ''").select(F.lit("").alias("family"), F.col("s").alias("seq")).distinct(), 5).count()
    assert len(want) <= asked < len(pairs)
    out = {(r["f"], r["k"]): r["seed_seq"] for r in similar.clusters(df, "f", "k", "s").collect()}
    for f in ("x", "y"):
        own = [(s, i) for g, i, s in rows if g == f]
        distinct = sorted(set(s for s, _ in own))
        seeds = alignment.cluster([(s, 0) for s in distinct], 5, 0.6)
        of = {s: distinct[j] for s, j in zip(distinct, seeds, strict=True)}
        assert {i: out[f, i] for _, i in own} == {i: of[s] for s, i in own}


def test_rounds_equal_one_by_one(spark):
    rng = random.Random(4)
    edges = {(a, b) for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(150)) if a < b} | {(i, i + 1) for i in range(20)}
    seed = {}
    for v in range(60):
        seed[v] = min((u for u, w in edges if w == v and seed[u] == u), default=v)
    got = similar.first_seeds(spark.range(60), spark.createDataFrame(sorted(edges), "u long, v long"))
    assert dict(got.collect()) == seed


def plain_place(construct, reference, first, last):
    """The definition, column by column."""
    x, y = alignment.align_all([(reference, construct)], local=True)[0]
    outside, env, used, after = 0, [], 0, None
    for i, j in zip(x.tolist(), y.tolist(), strict=True):
        at = j + 1 if j >= 0 else after
        after = j + 2 if j >= 0 else after
        inside = first <= at <= last
        used += j >= 0
        if i >= 0 and j >= 0 and inside:
            env.append(i)
        if not inside and (i < 0 or j < 0 or reference[i] != construct[j]):
            outside += 1
    return outside, (min(env), max(env)) if env else None, used / len(construct)


def test_placements(spark):
    rng = random.Random(6)
    rows = []
    for _ in range(60):
        ref = "".join(rng.choice("ACDEFGHIKL") for _ in range(rng.randrange(30, 90)))
        a = rng.randrange(len(ref) // 2)
        c = family(random.Random(rng.random()), 2, 4)[0] * (rng.random() < 0.3) + ref[a : a + rng.randrange(12, 50)]
        c = list(c)
        for _ in range(rng.randrange(4)):
            c[rng.randrange(len(c))] = rng.choice("ACDEFGHIKLW")
        if rng.random() < 0.5:
            del c[len(c) // 2]
        first = rng.randrange(1, max(2, len(c) // 2))
        rows.append(("".join(c), ref, first, rng.randrange(first, len(c) + 1)))
    rows.append(("WWWW", "AAAA", 1, 4))
    own = canonical.Placed(rows, alignment.align_all([(r, c) for c, r, _, _ in rows], local=True))
    for i, row in enumerate(rows):
        outside, env, coverage = plain_place(*row)
        assert bool(own.found[i]) == (env is not None) and own.coverage[i] == pytest.approx(coverage)
        if env:
            assert (int(own.outside[i]), (int(own.first[i]), int(own.last[i]))) == (outside, env)


def test_borrowed_flanks(spark):
    """Too few aligned, too many edits, flanks cut short by the reference's end, mutated constructs."""
    rng = random.Random(2)
    ref = "".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(120))
    mutated = ref[30:50] + ("A" if ref[50] != "A" else "C") + ref[51:80]
    rows = [("near", mutated, 1, 50, ref), ("edge", ref[3:60], 1, 50, ref), ("far", "W" * 60 + ref[30:40], 1, 60, ref), ("gap", ref[30:50] + ref[52:90], 1, 58, ref)]
    got = {r["id"]: r for r in canonical.windows(spark.createDataFrame(rows, "id string, c string, f int, l int, r string"), "c", "f", "l", "r").collect()}
    assert (got["near"]["window"], got["near"]["origin"], got["near"]["full"]) == (ref[20:30] + mutated + ref[80:90], "reference", True)
    assert (got["edge"]["window"], got["edge"]["origin"], got["edge"]["full"], got["edge"]["env_first"]) == (ref[:63], "reference", False, 4)
    assert got["far"]["origin"] == "short"
    assert got["gap"]["window"] == ref[20:100]


def test_located(spark):
    rng = random.Random(9)
    protein = "".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(900))
    domain = protein[400:460]
    mutant = domain[:20] + ("W" if domain[20] != "W" else "Y") + domain[21:40] + domain[41:]
    rows = [("construct", protein, protein[390:470], 11, 70), ("domain", protein, "MSSSS" + domain + "GGGG", 6, 65), ("mutant", protein, "MSSSS" + mutant + "GGGG", 6, 64), ("other", protein, "W" * 40, 1, 40), ("empty", "", domain, 1, 60), ("null", None, domain, 1, 60)]
    got = {r["id"]: (r["start"], r["stop"], r["route"]) for r in canonical.located(spark.createDataFrame(rows, "id string, p string, c string, f int, l int"), "p", "c", "f", "l").collect()}
    assert got["construct"] == (401, 460, "construct") and got["domain"] == (401, 460, "domain") and got["mutant"] == (401, 460, "alignment")
    assert got["other"] == got["empty"] == got["null"] == (None, None, None)
    # What is seen around the best diagonal gives the place that the whole protein gives.
    for _ in range(30):
        a = rng.randrange(800)
        d = family(random.Random(rng.random()), 2, 4)[0] + protein[a : a + 50]
        lo, hi = canonical._neighbourhood(d, protein)
        part, whole = (canonical.Placed([(d, t, 1, len(d))], alignment.align_all([(t, d)], local=True)) for t in (protein[lo:hi], protein))
        assert int(part.first[0]) + lo == int(whole.first[0])
