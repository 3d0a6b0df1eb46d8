"""Repeated passages against a dictionary of all strings, and the suffix sorting against a plain sort."""

import hashlib
import random

import numpy as np
import pytest

from pairbench.llm import queries
from pairbench.llm import suffix_dedup as S


def plain(rows):
    first = {}
    rows = [(k, (t or "").encode()) for k, t in rows]
    age = lambda k, i: (k is not None, k or type(k)(), i) if k is not None else (False, 0, i)
    for k, t in rows:
        for i in range(len(t) - S.WIDTH + 1):
            w = t[i : i + S.WIDTH]
            if w not in first or age(k, i) < first[w]:
                first[w] = age(k, i)
    out = []
    for k, t in rows:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - S.WIDTH + 1):
            if first[t[i : i + S.WIDTH]] < age(k, i):
                gone[i : i + S.WIDTH] = True
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        spans = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append(repr((k, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())))
    return sorted(out)


def ran(df):
    assert df.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return sorted(repr(tuple(r)) for r in df.collect())


@pytest.mark.parametrize("letters", [1, 2, 3, 250])
def test_two_stage_sorting(letters):
    rng = np.random.default_rng(letters)
    for n in (1, 2, 30, 700):
        text = rng.integers(0, letters, n).astype(np.uint8)
        wanted = rng.random(n) < 0.7
        got = S.two_stage(text, wanted)
        assert sorted(got.tolist()) == np.flatnonzero(wanted).tolist()
        data = text.tobytes()
        cut = [data[i : i + S.WIDTH] for i in got.tolist()]
        assert cut == sorted(cut)
        same = S.common_prefixes(S.words(text), got)
        for i in range(1, len(got)):
            a, b = (data[j : j + S.WIDTH] + bytes(S.WIDTH) for j in got[i - 1 : i + 1].tolist())
            assert same[i] == next((k for k in range(S.WIDTH) if a[k] != b[k]), S.WIDTH)


def corpus(seed, n=120):
    """Texts from few words, with shared passages, repeated runs, copies and odd ones."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randrange(1, 9)))
    text = lambda m: " ".join(word() for _ in range(m))
    shared = [text(rng.randrange(10, 60)) for _ in range(6)]
    line = "A line of some length that a great many of the texts hold, whatever else there is. "
    rows = []
    for i in range(n):
        kind = rng.randrange(8)
        t = text(rng.randrange(1, 40))
        if kind < 3:
            t += rng.choice(shared)[rng.randrange(20) :] + text(rng.randrange(30))
        elif kind == 3:
            t += line + text(20) + line
        elif kind == 4:
            t = rng.choice(["x" * 400, "ab" * 150, line * 4, "", None, "y" * 99, "z" * 100])
        elif kind == 5 and rows:
            t = rng.choice(rows)[1]
        rows.append((i, t))
    return rows


@pytest.mark.parametrize("crowd", [20_000, 3])
def test_equals_plain(spark, monkeypatch, crowd):
    monkeypatch.setattr(S, "CROWD", crowd)
    monkeypatch.setattr(S, "BLOCK_BYTES", 9000)
    monkeypatch.setattr(S, "BATCH_BYTES", 5000)
    monkeypatch.setattr(S, "PART", 300)
    monkeypatch.setattr(S, "PIECE", 2000)
    rows = corpus(crowd)
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS block", "2 AS key", "3 AS id", "4 AS anchor", "5 AS of").repartition(3)
    assert ran(S.dedup(df)) == plain(rows)


def test_odd_keys(spark):
    """Null, repeated and text keys; rest; empty table."""
    rows = [(None if i % 11 == 0 else i % 40, t) for i, t in corpus(9, 90)]
    assert ran(S.dedup(spark.createDataFrame(rows, "doc_id long, text string"))) == plain(rows)
    named = [(f"d{i}", t) for i, t in corpus(4, 40)]
    assert ran(S.dedup(spark.createDataFrame(named, "doc_id string, text string"))) == plain(named)
    got = {r.doc_id: r for r in S.dedup(spark.createDataFrame([(1, "q" * 150), (2, "q" * 150 + "!")], "doc_id long, text string"), rest=True).collect()}
    assert (bytes(got[1].rest), bytes(got[2].rest)) == (b"q", b"!")
    assert ran(S.dedup(spark.createDataFrame([], "doc_id long, text string"))) == []


def test_query_equals_plain(spark, sf_dir):
    rows = [tuple(r) for r in queries.read(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    assert ran(queries.op13_suffix_dedup(spark, sf_dir)) == plain(rows)
