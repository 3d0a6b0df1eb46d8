"""Token alignment against a plain version with the libraries' own encoders."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from pairbench.llm import queries
from pairbench.llm import token_alignment as T

A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
ZERO = (0, 0, 0, 0, 0, 0, "")


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def plain(rows, libraries):
    """Rows in order; groups are cut where tokens of both end, links are found by ranges."""
    a, b = libraries
    own = T._byte_names()
    got, count = [], Counter()
    for _, text in rows:
        if not text:
            got.append(None)
            continue
        want = b" " + text.encode()
        ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        xa = [bytes(own[c] for c in a.id_to_token(i)) for i in ia]
        xb = [bytes([int(p[3:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in ib)]
        if b"".join(xa) != want or b"".join(xb) != want:
            got.append(None)
            continue
        ea, eb = np.cumsum([len(x) for x in xa]).tolist(), np.cumsum([len(x) for x in xb]).tolist()
        both = sorted(set(ea) & set(eb))
        cut = lambda ids, ends, lo, hi: ",".join(str(i) for i, e in zip(ids, ends, strict=True) if lo < e <= hi)
        text = ";".join(f"{cut(ia, ea, lo, hi)}|{cut(ib, eb, lo, hi)}" for lo, hi in zip([0, *both], both, strict=False))
        links, j = [], 0
        for i, e in enumerate(ea):
            low = ea[i - 1] if i else 0
            while j and eb[j - 1] > low:
                j -= 1
            while j < len(eb) and (eb[j - 1] if j else 0) < e:
                if eb[j] > low:
                    links.append((ia[i], ib[j]))
                j += 1
        got.append((len(ia), len(ib), len(both), links, hashlib.sha256(text.encode()).hexdigest()))
        count.update(set(links))
    top = defaultdict(int)
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    return sorted(
        repr((key, *(ZERO if g is None else (*g[:3], len(g[3]), sum(count[p] == top[p[0]] for p in g[3]), sum(count[p] for p in g[3]), g[4]))))
        for (key, _), g in zip(rows, got, strict=True)
    )


def ran(df):
    assert df.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted(repr(tuple(r)) for r in df.collect())


def test_query_equals_plain(spark, sf_dir, libraries):
    rows = [tuple(r) for r in queries.read(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    assert ran(queries.op12_token_alignment(spark, sf_dir)) == plain(rows, libraries)


def test_odd_rows(spark, libraries, monkeypatch):
    monkeypatch.setattr(T, "BLOCK_BYTES", 2000)
    texts = [None, "", " ", "  a ", "x▁y", "<|endoftext|> </s> <0x41>", "日本語 ё é 🎉", "\u0000\n\r\t", "a" * 5000, " " * 3000, "don't stop. 123"]
    rows = [(i % 7 if i % 5 else None, t) for i, t in enumerate(texts * 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS block", "2 AS pair", "'x' AS key").repartition(3)
    assert ran(T.align(df, A, B)) == plain(rows, libraries)
    named = spark.createDataFrame([("d1", "one two"), ("d2", None)], "doc_id string, text string")
    assert ran(T.align(named, A, B)) == plain([("d1", "one two"), ("d2", None)], libraries)
    assert ran(T.align(spark.createDataFrame([], "doc_id long, text string"), A, B)) == []


def test_long_texts(libraries):
    """Words and blanks without end."""
    rng = random.Random(3)
    own = T.aligner(A, B)
    for text in (" " * 300_000, "ab" * 100_000, "".join(rng.choice("ab ") for _ in range(200_000))):
        figures, digest, *_ = own.align([text])
        assert figures[0, 3] >= max(figures[0, :2]) and len(digest[0]) == 64
        assert own.a.encode([text])[0] == libraries[0].encode(" " + text, add_special_tokens=False).ids


def test_every_code_point_is_cut_alike(libraries):
    """tiktoken's regular expressions know the same letters, digits and blanks as the library's."""
    code = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    texts = ["".join(f"a{c}1 {c}{c}b  {c}" for c in code[i : i + 200]) for i in range(0, len(code), 200)]
    got = T.aligner(A, B).a.encode(texts)
    assert got == [e.ids for e in libraries[0].encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


def test_union_finds_components():
    rng = np.random.default_rng(1)
    for _ in range(20):
        n = int(rng.integers(2, 60))
        u, v = rng.integers(0, n, 40), rng.integers(0, n, 40)
        least = np.arange(n)
        for _ in range(n):
            for x, y in zip(u, v, strict=True):
                least[x] = least[y] = min(least[x], least[y])
        assert np.array_equal(T.union(n, u, v), least)
