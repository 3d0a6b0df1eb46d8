import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
P = pytest.importorskip("public_tokenizers")

ODD = [(1, "The quick brown fox jumps", "en"), (2, None, None), (3, "", "en"), (None, "the quick brown fox jumps", "de"), (1, "The quick brown fox jumps", "en"), (5, "a b \x00 ▁ <|endoftext|> </s>", None), (6, "wort " * 3000, "de"), (7, "12 34 !!", "en")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, lang string").withColumns({"id": F.lit(9), "h": F.lit("x"), "score": F.lit(1), "a": F.lit(0)})


def test_sentencepiece_equals_library():
    import sentencepiece

    from pairbench.llm.sentencepiece_merge import Encoder

    path = P.path("piece_bpe_32k.model")
    sp, ours = sentencepiece.SentencePieceProcessor(model_file=path), Encoder(path)
    rng = random.Random(1)
    parts = ["a", "e", " ", "  ", "▁", "\n", "\t", "é", "漢", "😀", "\x00", "the", "ing", "</s>", "<0x41>", "\r\n"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(2000)]
    got = [x.tolist() for x in ours.encode(texts)]
    assert got == sp.encode(texts, add_eos=True)
    assert [ours.decode(x) for x in got] == [sp.decode(x) for x in got]


def test_token_counts_equal_library_at_every_prefix():
    from tokenizers import Tokenizer

    from pairbench.llm.token_counts import PrefixCounter

    path = P.path("byte_bpe_50k.json")
    lib, ours = Tokenizer.from_file(path), PrefixCounter(path)
    rng = random.Random(2)
    parts = ["a", " ", "  ", "\n", "é", "漢", "the", "ing", "1", "'s", "<|endoftext|>", "th", "er"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(2000)] + ["", "a" * 900, "=-" * 300]
    assert [n for n, _ in ours.counts(texts, 12)] == [len(x.ids) for x in lib.encode_batch(texts, add_special_tokens=False)]
    word = "thingering"
    assert ours.prefix(word).tolist() == [len(lib.encode(word[:i]).ids) for i in range(len(word) + 1)]


def test_shingles_of_short_and_empty_texts():
    from pairbench.llm.textkit import shingles, words

    h, at = shingles(words(pa.array(["A b", "a B", None, "", "a b c d e f", " \n "])))
    assert np.diff(at).tolist() == [1, 1, 0, 0, 2, 0] and h[0] == h[1]


def components(docs):
    sets = {}
    for i, text in docs:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_copies():
    rng = random.Random(3)
    base = [rng.choices("abcdefghij", k=60) for _ in range(6)]
    docs = []
    for i in range(150):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(60)] = "zz"
        docs.append((i, " ".join(w)))
    return docs + [(900, None), (901, ""), (902, "x y"), (903, "X  y")]


@pytest.mark.parametrize(("small", "heavy", "block"), [(1, 10**6, 2000), (16, 10**6, 2000), (1, 20, 5)])
def test_jaccard_join_equals_brute_force(spark, monkeypatch, small, heavy, block):
    """Also with counters dealt by class and lists cut into blocks."""
    from pairbench.llm import ngram_join

    monkeypatch.setattr(ngram_join, "HEAVY", heavy)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    docs = near_copies()
    got = ngram_join.join(spark.createDataFrame(docs, "doc_id long, text string"), small=small).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == components(docs)


def test_bitmaps_never_exceed_the_symmetric_difference():
    from pairbench.llm.ngram_join import bitmaps, differing

    rng = np.random.default_rng(5)
    pairs = []
    for _ in range(300):
        n, m, c = rng.integers(1, 200), rng.integers(1, 200), rng.integers(0, 200)
        both = rng.integers(0, 2**63, c)
        pairs.append((np.unique(np.r_[both, rng.integers(0, 2**63, n)]).astype(np.uint64), np.unique(np.r_[both, rng.integers(0, 2**63, m)]).astype(np.uint64)))
    marks = [bitmaps(np.concatenate(side), np.cumsum([0, *map(len, side)])) for side in zip(*pairs, strict=True)]
    assert (differing(*marks) <= [len(np.setxor1d(x, y)) for x, y in pairs]).all()


def test_one_each_keeps_one_of_every_component_and_other_texts_of_its_keys(spark):
    from pairbench.llm.ngram_join import one_each

    docs = near_copies()
    want = {i for i, (_, c) in components(docs).items() if i == c}
    got = one_each(spark.createDataFrame([(i, t, 7, "x") for i, t in docs], "doc_id long, text string, n long, t string")).collect()
    assert sorted(r.doc_id for r in got) == sorted(want) and set(got[0].asDict()) == {"doc_id", "text", "n", "t"}
    a, b = "one two three four five six seven", "another text that links with none of them"
    rows = [(5, a), (5, b), (5, b), (9, a.upper()), (None, a), (None, a), (7, None), (7, None), (8, "")]
    got = one_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    kept = sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in got)
    assert kept == sorted([(-1, a), (-1, a), (5, a), (5, b), (7, ""), (8, "")])
    assert one_each(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_decontamination_equals_brute_force():
    from collections import Counter

    from pairbench.llm.decontaminate import Benchmark
    from pairbench.llm.textkit import words

    rng = random.Random(4)
    items = [" ".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 40))) for _ in range(20)]
    docs = []
    for _ in range(60):
        w = rng.choice(items).split()
        if rng.random() < 0.5:
            w[rng.choice([0, -1])] = "zzz"
        docs.append(" ".join([*rng.choices("qrstuv", k=rng.randint(0, 20)), *w, *rng.choices("qrstuv", k=5)]))
    want = set()
    for d, text in enumerate(docs):
        w = text.split()
        for i, item in enumerate(items):
            own = item.split()
            k, n = min(5, len(own)), min(len(own), len(w))
            c = Counter(tuple(own[j : j + k]) for j in range(len(own) - k + 1))
            for s in range(len(w) - n + 1):
                x = Counter(tuple(w[s + j : s + j + k]) for j in range(n - k + 1))
                both = sum((c & x).values())
                if both and both / (c.total() + x.total() - both) >= 0.75:
                    want.add((d, i))
    bench, got = Benchmark(list(range(20)), items), set()
    w = words(pa.array(docs))
    for group in bench.by_k.values():
        d, i, *_ = group.search(w, 0.75)
        got |= set(zip(d.tolist(), bench.ids[i].tolist(), strict=True))
    assert got == want


def test_decontamination_finds_windows_that_repeat_a_shingle():
    from pairbench.llm.decontaminate import Benchmark
    from pairbench.llm.textkit import words

    # 168 of 196 shingles of item and window agree (0.75); the window has one other shingle 24 times.
    items = [" ".join(f"w{i}_{j}" for j in range(200)) for i in range(40)]
    docs = [" ".join([*text.split()[:172], *["x"] * 28]) for text in items]
    for inside, outside in ((items, docs), (docs, items)):
        (group,) = Benchmark(list(range(40)), inside).by_k.values()
        d, i, similarity, *_ = group.search(words(pa.array(outside)), 0.75)
        assert d.tolist() == i.tolist() == list(range(40)) and (similarity == 0.75).all()


def test_html_keeps_the_article_only():
    from pairbench.llm import html_extract as x

    page = "<html><head><title>T</title><script>var a='</p>'</script></head><body><nav><ul><li>Home</ul></nav><article><h1>Head</h1><p>One &amp; two<br>three<p>Four <b>five</b>.</article><footer>&copy; me</footer>"
    read = x.leaves(page)
    crf = x.fit([(x.features(read), [x.label(b) for b in read])] * 3)
    assert x.article(crf, page) == "Head One & two three Four five."
    assert x.article(crf, None) == "" and x.article(crf, "") == ""


def test_table_is_even_and_stable():
    from pairbench.llm.sharding import fill

    names = [f"s{i}" for i in range(8)]
    table = fill(names, 1009)
    sizes = np.bincount(table)
    assert sizes.max() - sizes.min() <= 1
    fewer = fill(names[:-1], 1009)
    assert np.mean([a != b for a, b in zip(table, fewer, strict=True) if a != 7]) < 0.15


def test_search_recall(spark, sf_dir):
    from pairbench.llm.permutation_index import nearest

    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    got = nearest(e, F.col("vec_id") % 20 == 0).collect()
    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in e.collect()}
    ids = np.array(sorted(rows))
    x = np.stack([rows[i] for i in ids])
    hit = 0
    for q in ids[ids % 20 == 0]:
        s = x @ rows[q]
        best = [i for i in ids[np.lexsort((ids, -s))] if i != q][:20]
        hit += len(set(best) & {r["vec_id"] for r in got if r["query_id"] == q})
    assert hit / (20 * (ids % 20 == 0).sum()) >= 0.9


def test_odd_rows(spark, odd):
    from pairbench.llm import language_id, lm_scoring, sharding
    from pairbench.llm.ngram_join import join, one_each
    from pairbench.llm.sentencepiece_merge import encode
    from pairbench.llm.token_counts import token_counts

    for df, n in ((odd, len(ODD)), (odd.limit(0), 0)):
        model = language_id.train(df)
        got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(df, model).collect()}
        assert not n or (got[2], got[3], got[7]) == ("und", "und", "und")
        assert token_counts(df, P.path("byte_bpe_50k.json")).count() == n
        assert encode(df, P.path("piece_bpe_32k.model"), digests=True).count() == n
        assert sharding.place(df).count() == n
        assert join(df).count() == n
        assert lm_scoring.scores(df, F.col("doc_id") % 2 == 0, P.path("byte_bpe_50k.tiktoken")).count() == n
        assert one_each(df).columns == df.columns
    kept = one_each(odd).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["1", "2", "3", "5", "6", "7", "None"]


def test_held_out_accuracy(spark):
    from pairbench.llm import queries as q

    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    lang = q.op5_language_id(spark, d).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert lang.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    labels = spark.read.parquet(f"{d}/labels.parquet")
    quality = q.op7_quality_fm(spark, d).where("held_out").join(labels, "doc_id")
    assert quality.agg(F.avg((F.col("quality") == F.col("predicted")).cast("int"))).first()[0] > 0.9


def test_sharding_equals_sql(spark, sf_dir):
    import parity

    from pairbench.llm import queries as q

    assert parity.spark_rows(q.op8_sharding(spark, sf_dir)) == parity.sql_rows(sf_dir, q.oracle_sql()["op8_sharding"])


@pytest.mark.parametrize("finish", [50_000, 0])
def test_components_grow_with_links(spark, monkeypatch, finish):
    from pairbench.llm import ngram_join

    monkeypatch.setattr(ngram_join, "FINISH", finish)
    draw = random.Random(4)
    links = [(draw.randrange(400), draw.randrange(400)) for _ in range(260)]
    want = {x: x for pair in links for x in pair if pair[0] != pair[1]}
    for _ in want:
        for a, b in links:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
    comp = None
    for part in (links[:150], links[150:], []):
        comp = ngram_join.joined(comp, spark.createDataFrame(part, "a long, b long"))
    assert {r["id"]: r["comp"] for r in comp.collect()} == want
    assert comp.count() == len(want)
