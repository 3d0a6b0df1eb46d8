import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.tiktoken")


def some_docs(n, seed):
    rng = random.Random(seed)
    names = ["rain", "falls", "on", "the", "old", "roof", "and", "thunderstorms", "sleep", "zyzzyva"]
    return [(i, " ".join(rng.choices(names, range(10, 0, -1), k=rng.randint(1, 60)))) for i in range(n)]


def test_every_occurrence_is_mixed_by_itself(spark, monkeypatch):
    from pairbench.llm import lm_scoring as lm

    models, train = [], lm.train
    monkeypatch.setattr(lm, "train", lambda *a, **k: models.append(train(*a, **k)) or models[-1])
    docs = [*some_docs(120, 5), (120, "qqxx " * 40 + "unheard " * 3), (121, "")]
    got = {r["doc_id"]: r["score"] for r in lm.scores(spark.createDataFrame(docs, "doc_id long, text string"), F.col("doc_id") % 10 == 0, PATH).collect()}
    (m,) = models
    count = Counter(w for i, t in docs if i % 10 for w in t.split())
    ends = sum(i % 10 > 0 for i, _ in docs)
    for i, text in docs:
        log, context, _ = m.score([lm.encode(text, PATH)])
        seen = np.array([*(count[w] for w in text.split()), ends], float)
        share = m.share[context]
        want = np.logaddexp(np.log(np.maximum((1 - share) * seen / (count.total() + ends), 5e-324)), np.log(share) + log).sum() / np.log(10)
        assert got[i] == pytest.approx(want, rel=1e-5)


def test_shares_follow_the_better_part():
    from pairbench.llm import lm_scoring as lm

    where = np.repeat(np.arange(2), 500)
    log = np.log(np.where(where == 0, 0.2, 1e-6))
    share = lm.shares(np.where(where == 0, 1e-6, 0.2), log, where)
    assert share[0] > 0.9 and share[1] < 0.1


def test_rare_products_have_no_floor(spark):
    from pairbench.llm import lm_scoring as lm

    m = lm.Model.__new__(lm.Model)
    m.words, m.share = 10, np.full(lm.SHARES, 0.5)
    assert m.mixed(np.zeros(1), np.array([-5000.0]), np.zeros(1, int))[0] == pytest.approx((-5000 + np.log(0.5)) / np.log(10))


def test_every_id_takes_part_in_the_fit(spark, monkeypatch):
    from pairbench.llm import lm_scoring as lm

    seen, sums = [], lm._sum_arrays
    monkeypatch.setattr(lm, "SAMPLE", 200)
    monkeypatch.setattr(lm, "_sum_arrays", lambda df, size: seen.append(sums(df, size)) or seen[-1])
    docs = some_docs(300, 6)
    tokens = spark.createDataFrame([(lm.encode(t, PATH).tobytes(), i % 10 > 0) for i, t in docs], "ids binary, train boolean")
    model = lm.train(tokens, PATH)
    back = seen[0].sum() - sum(int(x[-1]) for x in seen[2:])
    assert len(seen) == 2 + lm.ROUNDS and 0 <= back <= 0.2 * seen[0].sum()
    assert sum(len(lm.encode(t, PATH)) for i, t in docs if i % 10) == seen[0].sum()
    assert all(np.isfinite(x).all() for x in model.weights.values())


def test_short_documents_and_tails_are_windows():
    from pairbench.llm import lm_scoring as lm

    ids = [np.arange(n) % 50 for n in (1, 5, 24, 60)]
    m = lm.Model.__new__(lm.Model)
    m.end, m.input, m.cls = 50, np.arange(51), np.arange(51)
    rows, lead, target, live = lm.windows_of(m, ids)
    assert live.sum() == sum(map(len, ids)) and len(rows) == 6
    assert target[live].tolist() == np.concatenate(ids).tolist()
    assert lead.tolist() == [8, 8, 8, 8, 0, 0] and rows[1, 8:13].tolist() == [50, 0, 1, 2, 3]


def test_odd_white_space_keeps_the_words_apart(spark, monkeypatch):
    from pairbench.llm import lm_scoring as lm

    models, train = [], lm.train
    monkeypatch.setattr(lm, "train", lambda *a, **k: models.append(train(*a, **k)) or models[-1])
    odd = ["rain      falls", "the     roof and sleep", "　 　", "       "]
    docs = [*((f"d-{i}", t) for i, t in some_docs(120, 5)), *((f"odd-{i}", t) for i, t in enumerate(odd))]
    df = spark.createDataFrame(docs, "doc_id string, text string")
    got = {r["doc_id"]: r for r in lm.scores(df, F.col("doc_id").endswith("7"), PATH).collect()}
    assert len(got) == len(docs) and df.schema["doc_id"].dataType.simpleString() == "string"
    (m,) = models
    enc, end = lm.vocabulary(PATH)
    count = Counter(w for k, t in docs if not k.endswith("7") for w in t.split(" ") if w)
    ends = sum(not k.endswith("7") for k, _ in docs)
    for k, text in docs:
        ids = lm.encode(text, PATH)
        gained, rows = m.each([ids])
        words = [w.encode() for w in text.split(" ") if w]
        last = np.cumsum([len(w) + 1 for w in words])  # where each word ends, after the space before it
        log, before, at = np.zeros(len(words) + 1), [None] * (len(words) + 1), 0
        for j, i in enumerate(ids):
            word = int((last <= at).sum())
            log[word] += gained[j]
            before[: word + 1] = [rows[j] if b is None else b for b in before[: word + 1]]
            at += len(enc.decode_single_token_bytes(int(i))) if i != end else 0
        seen = np.array([*(count[w.decode()] for w in words), ends], float)
        share = m.share[lm.context(np.array(before))]
        want = np.logaddexp(np.log(np.maximum((1 - share) * seen / (count.total() + ends), 5e-324)), np.log(share) + log).sum() / np.log(10)
        assert got[k]["score"] == pytest.approx(want, rel=1e-5) and got[k]["n_tokens"] == len(words) + 1


def small_model(lm, size):
    """Any model over 51 ids, with queries and keys of the given size."""
    rng = np.random.default_rng(4)
    rows, classes = lm.INPUTS + lm.SHARED, lm.ALONE + lm.SHARED
    shapes = {"embed": (rows, lm.WIDTH), "place": (lm.WINDOW, lm.WIDTH), "q": (lm.WIDTH,) * 2, "k": (lm.WIDTH,) * 2, "v": (lm.WIDTH,) * 2, "out": (lm.WIDTH, classes)}
    weights = {k: rng.normal(0, size if k in "qk" else 0.25, s).astype(np.float32) for k, s in shapes.items()}
    after = rng.integers(0, 9, (rows, 52)).astype(np.float32)
    pair, after_class = rng.normal(0, 1, (rows, classes)).astype(np.float32), np.full((rows, classes), 400, np.float32)
    ids = np.arange(51)
    return lm.Model(50, ids == 50, 10, 1, np.full(lm.SHARES, 0.5), ids, ids % classes, np.log(np.full(51, 0.5, np.float32)), pair, ids, after, after_class, weights)


@pytest.mark.parametrize("size", [0.1, 1.0, 30.0])
def test_logits_are_made_few_at_once_and_are_those_of_a_plain_model(monkeypatch, size):
    from pairbench.llm import lm_scoring as lm

    m, made, logits = small_model(lm, size), [], lm.Model.class_logits
    monkeypatch.setattr(lm.Model, "class_logits", lambda self, h, before: made.append(len(h)) or logits(self, h, before))
    docs = [np.r_[np.random.default_rng(i).integers(0, 50, n), 50].astype(np.uint16) for i, n in enumerate((0, 3, 30, 3000))]
    got, inputs = m.each(docs)
    assert max(made) <= 1024 and sum(made) == len(got) == sum(map(len, docs))
    w, want = {k: v.astype(float) for k, v in m.weights.items()}, []
    for d in docs:
        before = np.r_[50, d[:-1]].astype(int)
        for i in range(len(d)):
            begin = i - i % 24 - 8  # of the window
            at = np.arange(max(begin, 0), i + 1)
            x = w["embed"][before[at]] + w["place"][at - begin]
            s = x @ w["k"] @ (x[-1] @ w["q"])
            a = np.exp(s - s.max())
            z = (a / a.sum()) @ (x @ w["v"]) + x[-1]
            z = z @ w["out"] + m.pair[before[i]]
            counted = (m.after[before[i], d[i]] + 5 * 0.5) / 405
            want.append(z[d[i]] - np.log(np.exp(z).sum()) + np.log(counted))
    assert np.isfinite(got).all() and got == pytest.approx(np.array(want), abs=2e-2 if size > 1 else 2e-4)


def test_the_fit_lowers_the_loss_with_few_logits_at_once(monkeypatch):
    from pairbench.llm import lm_scoring as lm

    m, made, logits = small_model(lm, 0.25), [], lm.Model.class_logits
    docs = [np.r_[np.arange(i, i + 200) % 50, 50].astype(np.uint16) for i in range(40)]
    begun = m.each(docs)[0].mean()
    monkeypatch.setattr(lm.Model, "class_logits", lambda self, h, before: made.append(len(h)) or logits(self, h, before))
    lm.fit(m, docs, 10)
    assert max(made) <= 1024
    assert m.each(docs)[0].mean() > begun + 1


def test_a_word_is_encoded_once_and_white_space_that_merges_is_kept(monkeypatch):
    from pairbench.llm import lm_scoring as lm

    wide = "　"
    texts = ["Rain falls", None, "", "rain FALLS\ton the roof", "the roof " * 300, f"rain {wide} {wide} roof", f"falls{wide} {wide}on", "été tombe où"]
    enc, end = lm.vocabulary(PATH)
    asked = []

    class Asked:
        def encode_ordinary(self, text):
            asked.extend(text.split(" ")[1:])
            return enc.encode_ordinary(text)

    want = [lm.encode(t, PATH).tobytes() for t in texts]
    lm.openings(PATH)
    monkeypatch.setattr(lm, "vocabulary", lambda path: (Asked(), end))
    for most in (300_000, 3):  # also where it forgets
        asked.clear()
        known = lm.Encoder(PATH, most)
        plain = [known.documents([t])[0] for t in texts[:5]]
        assert most == 3 or sorted(asked) == ["falls", "on", "rain", "roof", "the"]
        assert [*plain, *known.documents(texts[5:])] == list(zip(want, [False] * 5 + [True] * 2 + [False], strict=True))


def test_words_are_known_by_the_ids_they_have_alone():
    from pairbench.llm import lm_scoring as lm

    wide = "　"
    texts = ["rain falls", f"rain {wide} {wide} roof", "", f"falls{wide} {wide}on", f"{wide} {wide}on roof"]
    docs, odd = [lm.encode(t, PATH) for t in texts], np.array([wide in t for t in texts])
    h, n = lm.word_hashes(docs, odd, PATH)
    words = [w for t in texts for w in t.split(" ") if w]
    assert n.tolist() == [2, 4, 0, 2, 3] and len(set(zip(words, h, strict=True))) == len(set(words)) == len(set(h))


def test_near_exponentials_of_the_fit():
    from pairbench.llm import lm_scoring as lm

    y = np.linspace(-87, 87, 5000).astype(np.float32)
    ratio = lm.near_exp(y * lm._BITS + np.float32(lm._BIAS)) / np.exp(y.astype(float))
    assert 0.999 < ratio.min() and ratio.max() < 1.0625
    far = lm.near_exp(np.array([-1e4, 1e4], np.float32) * lm._BITS + np.float32(lm._BIAS))
    assert (far > 0).all() and np.isfinite(far).all()
