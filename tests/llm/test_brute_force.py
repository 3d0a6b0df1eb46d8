"""Operators against plain versions of their definitions, and cases that were once lost."""

import itertools
import random
import time

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from pairbench.llm import decontaminate, language_id, permutation_index, quality_fm
from pairbench.llm import html_extract as x
from pairbench.llm.textkit import words


def test_other_widths_and_text_ids(spark):
    rng = np.random.default_rng(1)
    rows = [(f"v{i:03}", rng.normal(size=8).tolist()) for i in range(60)] + [("w", [9.0] * 9), ("n", None), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<double>")
    got = permutation_index.nearest(df, df.vec_id.endswith("0"), k=3, depth=1.0).collect()
    m = np.array([v for _, v in rows[:60]])
    for q in range(0, 60, 10):
        s = m @ m[q]
        s[q] = -np.inf
        want = [rows[j][0] for j in np.argsort(-s, kind="stable")[:3]]
        assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == rows[q][0]), key=lambda r: r["rank"])] == want
    assert len(got) == 18


def test_text_items(spark):
    docs = [(1, "a b c d e f g h"), (2, "x " + "one two three four five six seven"), (3, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([("mmlu-1", "a b c d e f g h"), ("2", "one two three four five six seven"), (None, "a b"), ("z", None)], "item_id string, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(df, items).collect()}
    assert got == {(1, "mmlu-1"), (2, "2")}
    assert [r["doc_id"] for r in decontaminate.clean(df, items).collect()] == [3]


@pytest.fixture(scope="module")
def crf():
    """A field fitted as in production, on the pages of the smallest tables."""
    pages = [x.leaves(p) for p in pq.read_table("/root/testdata/sf0.001/pages.parquet").column("html").to_pylist()]
    return x.fit([(x.features(b), [x.label(leaf) for leaf in b]) for b in pages])


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><p>One <a title=Bob's>two</a> three it's four</p><p>five</p></article>", "One two three it's four five"),
        ('<article><p>One <a title="a > b" class=\'c\'>two</a> three</p></article>', "One two three"),
        ("<article><p>a</p><svg/><p>b</p></article>", "a b"),
        ("<article><p>a <svg><text>no</text></svg> b</p><p>c</p></article>", "a b c"),
        ("<article><p>a</p><canvas><p>b</p><object>c</article>", "a b c"),
        ("<article><p>Let <math><mi>x</mi> = <mn>2</mn></math> be &lt;given&gt;.</p></article>", "Let x = 2 be <given>."),
        ("<article><p>a<script>if (x < 1) { y() }</script> b<style>p{}</style></p></article>", "a b"),
        ("<article><p>a</p><script>never closed <p>b</p>", "a"),
        ("<article><p>a</p><select><option>1<p>b</p></article>", "a 1 b"),
    ],
)
def test_markup_read_by_hand(page, text):
    """All blocks of a page, whichever of them the field would choose."""
    assert " ".join(leaf.text for leaf in x.leaves(page)) == text


def test_pages_by_hand(crf):
    body = "<p>One &amp; two<br>three, and <a title=Bob's href=x>four</a> it's five. More of the words.</p><svg/><p>Let <math><mi>x</mi> = <mn>2</mn></math> be given, then. All is said.</p>"
    page = f"<html><head><title>T</title></head><body><nav><ul><li><a href=/>Home</a></li><li><a href=/a>All</a></li></ul></nav><article><h1>Head of it</h1>{body}</article><footer>&copy; me</footer></body></html>"
    assert x.article(crf, page) == "Head of it One & two three, and four it's five. More of the words. Let x = 2 be given, then. All is said."


def test_viterbi_equals_all_sequences():
    rng = np.random.default_rng(4)
    for _ in range(30):
        field = x.Field({f"f{i}": i for i in range(6)}, rng.normal(size=(6, 2)), rng.normal(size=(2, 2)))
        feats = [[f"f{i}" for i in rng.choice(7, 2)] for _ in range(int(rng.integers(1, 9)))]
        s = field.scores(feats)
        value = lambda y: sum(s[i, k] for i, k in enumerate(y)) + sum(field.step[a, b] for a, b in itertools.pairwise(y))  # noqa: B023, E731
        best = max(itertools.product((0, 1), repeat=len(feats)), key=value)
        assert value(field.decode(feats)) == pytest.approx(value(best))


def test_deep_nesting_with_classes_is_linear(crf):
    def took(n):
        page = "".join(f"<div class=c{i}>x" for i in range(n))
        start = time.process_time()
        assert x.article(crf, page) is not None
        return time.process_time() - start

    took(500)
    assert took(8000) < 16 * max(took(1000), 0.02)


def test_language_mixture_equals_plain_em():
    """Proportions after the same rounds of expectation-maximisation over words, in plain Python."""
    rng = random.Random(3)
    table = np.log(np.random.default_rng(2).dirichlet(np.ones(3), 1 << language_id.BITS)).astype(np.float32)
    model = language_id.LanguageModel(("a", "b", "c"), table)
    texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 8))) for _ in range(rng.randrange(1, 40))) for _ in range(12)]
    w = words(pa.array(texts))
    full, own, chosen = model.infer(w)
    score = model.word_scores(w).astype(float)
    for d in range(len(texts)):
        part = score[w.offset[d] : w.offset[d + 1]]

        def em(langs, part=part):
            pi, value = {k: 1 / len(langs) for k in langs}, -np.inf
            for _ in range(12):
                p = [{k: pi[k] * np.exp(row[k] - row.max()) for k in langs} for row in part]
                now = sum(np.log(max(sum(r.values()), 1e-30)) for r in p)
                pi = {k: sum(r[k] / max(sum(r.values()), 1e-30) for r in p) / len(p) for k in langs}
                value, before = now, value
                if now - before <= 1e-3 * len(p):
                    break
            return pi, value

        pi, value = em(range(3))
        assert full[d] == pytest.approx([pi[k] for k in range(3)], abs=2e-3)
        order = sorted(range(3), key=lambda k: -full[d][k])
        best = {order[0]: 1.0}
        least = sum(row[order[0]] - row.max() for row in part)
        cost = 0.5 * np.log(max(len(part), 2))
        for size in (2, 3):
            got, now = em(order[:size])
            if value <= least + cost or now <= least + cost:
                break
            best, least = got, now
        assert own[d] == pytest.approx([best.get(k, 0.0) for k in range(3)], abs=2e-3)


def test_machine_equals_all_pairs_of_features():
    """The linear-time score is the sum over all pairs of features."""
    rng = np.random.default_rng(5)
    texts = ["one two three two", "", "A b. C d! " * 20, "zz " * 50 + "yy"]
    w = words(pa.array(texts))
    doc, bucket, value = quality_fm.hashed(w)
    buckets = 1 << quality_fm.BITS
    n = buckets + quality_fm.N_STATS
    machine = quality_fm.Machine(0.3, rng.normal(0, 0.1, n), rng.normal(0, 0.1, (n, quality_fm.RANK)), rng.normal(size=quality_fm.N_STATS), rng.uniform(1, 2, quality_fm.N_STATS))
    got, stats = machine.score(w), machine.stats(w)
    for d in range(len(texts)):
        own = {int(b): float(v) for b, v in zip(bucket[doc == d], value[doc == d], strict=True)}
        own |= {buckets + i: float(v) for i, v in enumerate(stats[d])}
        z = machine.bias + sum(machine.linear[i] * v for i, v in own.items())
        z += sum(float(machine.factor[i] @ machine.factor[j]) * own[i] * own[j] for i, j in itertools.combinations(sorted(own), 2))
        assert got[d] == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-4, abs=1e-6)
