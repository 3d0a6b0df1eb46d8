"""Operators on odd rows, and the pipeline's stages, against brute force through Spark."""

import math
import random
import re
import shutil
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_operators import ODD, components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
P = pytest.importorskip("public_tokenizers")
FALSE_FRIENDS = {"id": 9, "h": "x", "score": 1, "a": 0, "text_": "y", "n_chars": 3, "_html": "z"}


def friends(df, *but):
    """df with columns of names that the operators use themselves."""
    return df.withColumns({k: F.lit(v) for k, v in FALSE_FRIENDS.items() if k not in but})


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def contaminated_ids(docs, items):
    """(doc, item) by all windows of every item's size."""
    found = set()
    for i, item in items:
        own = WORD.findall(lower(item))
        k = min(5, len(own))
        c = Counter(tuple(own[j : j + k]) for j in range(len(own) - k + 1)) if own else Counter()
        for d, text in docs:
            w = WORD.findall(lower(text))
            n = min(len(own), len(w))
            x = Counter(tuple(w[j : j + k]) for j in range(n - k + 1)) if n >= k else Counter()
            for s in range(len(w) - n + 1):
                if s:
                    x[tuple(w[s - 1 : s - 1 + k])] -= 1
                    x[tuple(w[s + n - k : s + n])] += 1
                both = sum(min(v, x[g]) for g, v in c.items())
                if both and both / (c.total() + sum(x.values()) - both) >= 0.75:
                    found.add((d, i))
                    break
    return found


def test_decontamination_of_odd_rows(spark):
    from pairbench.llm.decontaminate import clean, contaminated

    rng = random.Random(6)
    items = [(i, " ".join(rng.choices("abcdefghijklm", k=rng.randint(6, 40)))) for i in range(8)]
    docs = [(i, f"start words {t.upper()} end of it") for i, t in items[:4]] + [(20, None), (21, ""), (22, "none of it"), (0, items[5][1]), (22, "none of it")]
    df = friends(spark.createDataFrame(docs, "doc_id long, text string"))
    bench = spark.createDataFrame([*items, (90, None), (91, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in contaminated(df, bench, threshold=0.75, k=5).select("doc_id", "item_id").collect()}
    assert got == contaminated_ids(docs, items)
    kept = clean(df, bench, threshold=0.75, k=5)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [20, 21, 22, 22]
    assert contaminated(df.limit(0), bench, threshold=0.75, k=5).count() == 0
    assert clean(df, bench.limit(0), threshold=0.75, k=5).count() == len(docs)


def test_extraction_through_spark(spark):
    from pairbench.llm import html_extract as x

    page = "<html><body><nav>Home</nav><article><h1>Head</h1><p>One &amp; two<br>three<p>Four <b>five</b>.</article><footer>&copy; me</footer>"
    rows = [(1, "u", page), (2, "u", None), (3, "u", ""), (4, "u", "<p>open <div"), (1, "u", page), (5, "u", "<p>long " + "word " * 50_000)]
    df = friends(spark.createDataFrame(rows, "page_id long, url string, html string"))
    crf = x.train(df.where("page_id = 1"))
    got = sorted((r["page_id"], r["text"], r["n_chars"], r["_html"]) for r in x.extract(df, crf).collect())
    want = sorted((i, x.article(crf, h), len(x.article(crf, h)), "z") for i, _, h in rows)
    assert got == want and got[0][1] == "Head One & two three Four five."
    assert x.extract(df.limit(0), x.train(df.limit(0))).count() == 0


def test_reader_is_linear_in_bad_markup():
    from pairbench.llm.html_extract import features, leaves

    assert len(features(leaves("<div>x" * 20_000))) == 20_000
    assert leaves('<a "' * 20_000) and leaves("<" * 20_000)


def test_quality_of_odd_rows(spark):
    from pairbench.llm import quality_fm

    df = friends(spark.createDataFrame(ODD, "doc_id long, text string, lang string"), "score")
    labels = spark.createDataFrame([(1, 1), (6, 0), (2, 1), (99, 0)], "doc_id long, quality int")
    for some in (labels, labels.limit(0)):
        got = quality_fm.score(df, quality_fm.train(df, some)).select("doc_id", "score").collect()
        assert len(got) == len(ODD) and all(r["score"] is not None and 0 <= r["score"] <= 1 for r in got)
    assert quality_fm.score(df.limit(0), quality_fm.train(df, labels)).count() == 0


def test_base_score_equals_brute_force(spark):
    from pairbench.llm import lm_scoring

    rng = random.Random(7)
    docs = [(i, " ".join(rng.choices(["One", "two", "three", "x"], k=rng.randint(0, 12)))) for i in range(40)] + [(50, None), (51, "two\tTWO\nnew")]
    held = {i for i, _ in docs if zlib.crc32(str(i).encode()) % 10 == 0}
    tokens = {i: [*WORD.findall(lower(t)), None] for i, t in docs}
    count = Counter(w for i, own in tokens.items() if i not in held for w in own)
    n, v = count.total(), len(count)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = lm_scoring.scores(df, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, P.path("byte_bpe_50k.tiktoken")).collect()
    assert len(got) == len(docs)
    for r in got:
        own = tokens[r["doc_id"]]
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(own), sum(count[w] > 0 for w in own), n, r["doc_id"] in held)
        assert r["base_score"] == pytest.approx(base, abs=1e-6)


def test_pipeline_stages_equal_brute_force(spark, tmp_path):
    import corpus_pipeline
    import sentencepiece

    src = "/root/testdata/sf0.001"
    for t in ("labels", "benchmark"):
        shutil.copy(f"{src}/{t}.parquet", tmp_path)
    docs = spark.read.parquet(f"{src}/documents.parquet").where("doc_id < 120")
    docs.unionByName(docs.where("doc_id < 3")).write.parquet(str(tmp_path / "documents.parquet"))
    items = [(r[0], r[1]) for r in spark.read.parquet(f"{src}/benchmark.parquet").collect()]
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r["doc_id"], r["text"]) for r in now.collect()]
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / f"s{i}"))
        now = spark.read.parquet(str(tmp_path / f"s{i}"))
        if name == "sentencepiece":
            sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
            assert {r["doc_id"]: list(r["ids"]) for r in now.collect()} == {d: sp.encode(t or "", add_eos=True) for d, t in before}
            continue
        after = sorted(r["doc_id"] for r in now.collect())
        assert now.columns == docs.columns
        if name == "language_id":
            assert after == sorted(d for d, t in before if any(c.isalpha() for c in t or ""))
        elif name == "near_duplicates":
            assert after == sorted(d for d, (_, c) in components(dict(before).items()).items() if d == c)
        elif name == "decontamination":
            assert after == sorted({d for d, _ in before} - {d for d, _ in contaminated_ids(before, items)})
        else:
            assert set(after) <= {d for d, _ in before} and len(after) > 0.5 * len(before)
