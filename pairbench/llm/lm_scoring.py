"""Language-model scores by a small causal self-attention model over subword ids, in numpy.

Texts are lower-cased (A-Z), cut into words at space and 0x09-0x0D, joined by one space and encoded with
a given byte-pair vocabulary; an end id follows. Over all training documents are counted: words (for
the base score), subword ids, and pairs of ids in reduced numbering. The model is

    P(id | before) = P(class | before) * P(id | class, id before)

where the most frequent ids are classes of their own, the others share classes of equal mass, and
P(id | class, id before) comes from the counts. The class logits are the log of smoothed counts after the id
before, plus a projection of one masked self-attention layer over the window, whose weights are
fitted by Adam on all training documents (its gradients take exponentials within a sixteenth, scores
don't): it begins on the driver on about SAMPLE ids of them, and goes on
in ROUNDS passes over disjoint parts of the documents, each of which starts from the same weights on every
partition and ends with their mean, weighted by ids. Windows that are not full are masked.
A word's probability is the product over its ids, mixed with the word's frequency in all training
documents:

    P(word | before) = (1 - share) * count / words + share * product of P(id | before)

where share depends on how frequent the id before the word is (SHARES steps), and is fitted by expectation
maximisation on training documents (about HELD ids) that are held back: for the fit their words, ids and
pairs are taken out of all counts. Every occurrence is mixed by itself.

Scoring cuts a text into windows of WINDOW ids of which the first CONTEXT were scored by the window
before, so each id is scored once with at least CONTEXT ids before it (or all there are); windows are
batched and masked.

A task encodes each distinct word once, as its ids don't depend on what stands around it; texts with white space
beyond ASCII, which can merge, are encoded whole. Words are known by the ids that they have alone.
Documents are kept in chunks of about CHUNK ids, one row each. The counts of words are added up in fragments:
a chunk sends its distinct words there by hash, once, and gets their counts in the whole corpus back in the
order of the words; then it is scored and mixed as a whole. Neither occurrences nor the model's log products are
sent, and no vocabulary reaches the driver or is broadcast.

A null or empty text has the end only. Rows with a null key count as held in. Repeated rows are separate
documents for the counts and have equal scores. Texts are scored whole; extra columns are ignored. Keys keep their type.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairbench.llm import scratch
from pairbench.llm.textkit import Words, chunks, mix, tidy, words_of

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WINDOW, CONTEXT = 32, 8
WIDTH = 16
ALONE, SHARED = 96, 32  # classes of one id, and of many
INPUTS = 1024  # ids with an input row of their own
COMMON = 4096  # ids counted one by one after each input row
SAMPLE = 300_000  # ids on which the weights begin
ROUNDS, RATE = 4, 1e-3  # of averaging, which together see every training document once
HELD = 100_000
SHARES = 11  # of the mixture, by the input row before a word: 0, 1-2, 3-6, ...
CHUNK = 700_000  # ids in a chunk, about
_STEP = np.uint64(0x9E3779B97F4A7C15)
_STEPS = np.multiply.accumulate(np.r_[np.uint64(1), np.full(63, _STEP)])
_BIAS, _BITS, _LEAST = 127 << 23, np.float32((1 << 23) / np.log(2)), 1 << 23  # for near_exp()
_MIXED = mix(np.arange(1, (1 << 16) + 1))
NEAR, FIT_NEAR = 512, 768  # rows of class logits made at once, which a core keeps at hand
_ONES = np.ones(ALONE + SHARED, np.float32)  # sums of rows are taken as products
_WHITE = re.compile(r"[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")  # beyond ASCII
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


@lru_cache(maxsize=2)
def vocabulary(path: str):
    """The encoder and the end id, which is the number of ids in the file."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    end = len(ranks)
    return tiktoken.Encoding("lm", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={"<end>": end}), end


def encode(text: str | None, path: str) -> np.ndarray:
    enc, end = vocabulary(path)
    own = (text or "").encode().translate(_LOWER).split()
    plain = (b" " + b" ".join(own)).decode() if own else ""  # so that a word's ids don't depend on its place
    return np.array([*enc.encode_ordinary(plain), end], np.uint16)


class Encoder:
    """The ids, as bytes, of words with the space before them, which don't depend on what stands around the
    word, unless white space beyond ASCII meets other white space. It forgets all when it holds most words, or
    32 bytes for each of these."""

    def __init__(self, path: str, most: int = 300_000):
        self.path, self.most = path, most
        self.bytes = 0
        self.known: dict[bytes, bytes] = {}
        self.white: set[bytes] = set()
        self.end = array("H", [vocabulary(path)[1]]).tobytes()

    def encoded(self, words: bytes) -> array:
        return array("H", vocabulary(self.path)[0].encode_ordinary(f" {words.decode()}"))

    def learn(self, words: set[bytes]) -> None:
        """Words are encoded end to end, and cut where an id begins with a space."""
        text = b"".join(words)
        self.bytes += len(text)
        if not text.isascii():
            white = {w for w in words if not w.isascii() and _WHITE.search(w.decode())}
            self.white |= white
            self.known.update((w, self.encoded(w).tobytes()) for w in white)
            words = words - white
        if words:
            words = list(words)
            ids = self.encoded(b" ".join(words))
            at = (2 * np.flatnonzero(openings(self.path).take(ids))).tolist()
            data = ids.tobytes()
            self.known.update(zip(words, map(data.__getitem__, map(slice, at, [*at[1:], len(data)])), strict=True))

    def words(self, split: list[list[bytes]]) -> list[list[bytes]]:
        """The ids of the words of each list."""
        if len(self.known) >= self.most or self.bytes >= 32 * self.most:
            self.bytes = 0
            self.known.clear()
            self.white.clear()
        got = [list(map(self.known.get, words)) for words in split]
        new = [i for i, ids in enumerate(got) if None in ids]
        if new:
            self.learn({w for i in new for w, ids in zip(split[i], got[i], strict=True) if ids is None})
            for i in new:
                got[i] = list(map(self.known.__getitem__, split[i]))
        return got

    def documents(self, texts: list[str | None]) -> list[tuple[bytes, bool]]:
        """The bytes of encode(text), and whether its words' ids can depend on what stands around them."""
        split = [(t or "").encode().translate(_LOWER).split() for t in texts]
        out = []
        for text, words, ids in zip(texts, split, self.words(split), strict=True):
            odd = bool(self.white) and not self.white.isdisjoint(words)
            out.append((encode(text, self.path).tobytes() if odd else b"".join(ids) + self.end, odd))
        return out


@lru_cache(maxsize=2)
def openings(path: str) -> np.ndarray:
    """Whether an id begins a word; the end does."""
    enc, end = vocabulary(path)
    return np.array([enc.decode_single_token_bytes(i)[:1] == b" " for i in range(end)] + [True])


@lru_cache(maxsize=2)
def spelling(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all ids end to end, and where each begins; the end has none."""
    enc, end = vocabulary(path)
    text = [enc.decode_single_token_bytes(i) for i in range(end)] + [b""]
    return np.frombuffer(b"".join(text), np.uint8), np.cumsum([0, *map(len, text)])


def decode(docs: list[np.ndarray], path: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of documents end to end, and their n + 1 positions."""
    data, at = spelling(path)
    ids = np.concatenate(docs).astype(np.int64)
    size = at[ids + 1] - at[ids]
    total = np.concatenate([[0], np.cumsum(size)])
    raw = data[np.repeat(at[ids] - total[:-1], size) + np.arange(total[-1])]
    return raw, total[np.cumsum([0, *map(len, docs)])]


def split(ids: np.ndarray, begin: np.ndarray, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The position at which each word of a run of documents begins, and a hash of the word's ids."""
    first = opens[ids]
    first[begin] = True
    at = np.flatnonzero(first)
    size = np.diff(np.r_[at, len(ids)])
    inside = np.arange(len(ids)) - np.repeat(at, size)
    value = _MIXED.take(ids)
    value *= _STEPS.take(inside & 63)
    if len(size) and size.max() > 64:
        value += (inside >> 6).astype(np.uint64)
    return at, mix(np.add.reduceat(value, at)) if len(at) else np.zeros(0, np.uint64)


@dataclass
class Model:
    end: int
    opens: np.ndarray  # whether an id begins a word
    words: int  # in training documents, with their ends
    ends: int
    share: np.ndarray  # the model's share of a word's probability, by context()
    input: np.ndarray  # id -> input row
    cls: np.ndarray  # id -> class
    within: np.ndarray  # id -> log P(id | class)
    pair: np.ndarray  # input row x class, log of smoothed counts
    common: np.ndarray  # id -> column in `after`, COMMON if none
    after: np.ndarray  # input row x (COMMON + 1), counts
    after_class: np.ndarray  # input row x class, sums of `after`
    weights: dict[str, np.ndarray]

    def projected(self) -> tuple[np.ndarray, np.ndarray]:
        """Each input row and each place end to end with its query, key and value."""
        w = self.weights
        return tuple(np.concatenate([w[name], *(w[name] @ w[x] for x in "qkv")], 1) for name in ("embed", "place"))

    def states(self, rows: np.ndarray, lead: np.ndarray, table: tuple[np.ndarray, np.ndarray] | None = None) -> tuple:
        """rows: windows x WINDOW input rows; lead: how many at the front are padding; table: projected(),
        which saves the products where the weights stay."""
        w = self.weights
        if table:
            x = table[0].take(rows, 0)
            x += table[1]
            x, q, k, v = (x[..., i : i + WIDTH] for i in range(0, 4 * WIDTH, WIDTH))
        else:
            x = w["embed"].take(rows, 0)
            x += w["place"]
            every = x.reshape(-1, WIDTH)
            q, k, v = ((every @ w[name]).reshape(x.shape) for name in "qkv")
        q = q[:, CONTEXT:]
        s = q @ k.transpose(0, 2, 1)
        s += _MASK
        first = np.flatnonzero(lead)
        if len(first):
            s[first] += np.where(np.arange(WINDOW)[None, :] < lead[first, None], np.float32(-1e9), np.float32(0))[:, None, :]
        # Every id sees itself. Within these bounds no row can leave the range of exp.
        if not (s.max() < 80 and s.diagonal(CONTEXT, 1, 2).min() > -60):
            s -= s.max(-1, keepdims=True)
        np.exp(s, out=s)
        s /= (s @ _ONES[:WINDOW])[..., None]
        return x, q, k, v, s, s @ v + x[:, CONTEXT:]

    def class_logits(self, h: np.ndarray, before: np.ndarray) -> np.ndarray:
        out = h @ self.weights["out"]
        out += self.pair.take(before, 0)
        return out

    def mixed(self, count: np.ndarray, log: np.ndarray, context: np.ndarray) -> np.ndarray:
        """log10 of the mixture of count / words and exp(log)."""
        with np.errstate(divide="ignore"):
            own = np.log((1 - self.share[context]) * count / max(self.words, 1))
        return np.logaddexp(own, np.log(self.share[context]) + log) / np.log(10)

    def each(self, docs: list[np.ndarray], batch: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """The log probability of every id of documents, and the input row before it."""
        size = np.array([len(d) for d in docs])
        ids = np.concatenate(docs).astype(np.int64)
        begin = np.cumsum(size) - size
        step = WINDOW - CONTEXT
        n = -(-size // step)
        doc = np.repeat(np.arange(len(docs)), n)
        start = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * step  # first id to score
        inputs = np.empty(len(ids), np.int64)  # the input row before each id
        inputs[1:] = self.input.take(ids[:-1])
        inputs[begin] = self.input[self.end]
        # P(id | class, id before): counts smoothed by P(id | class).
        cls = self.cls.take(ids)
        gained = self.after.take(inputs * self.after.shape[1] + self.common.take(ids))
        gained += (5 * np.exp(self.within)).take(ids)
        gained /= self.after_class.take(inputs * self.after_class.shape[1] + cls) + 5
        np.log(gained, out=gained)
        # Ids are scored in order, as windows lie in it: a window's live ids are a run.
        first, table = begin[doc] + start, self.projected()
        last = np.minimum(first + step, (begin + size)[doc])
        lead = np.where(start == 0, CONTEXT, 0)
        classes, across = self.pair.shape[1], np.arange(-CONTEXT, step)
        for i in range(0, len(doc), batch):
            f, e = first[i : i + batch, None], last[i : i + batch, None]
            at = f + across
            live = at[:, CONTEXT:] < e
            # Padding is masked, and what lies behind a text's end is left out.
            rows = inputs.take(at, mode="clip")
            h = self.states(rows, lead[i : i + batch], table)[-1]
            h = h.reshape(-1, WIDTH) if live.all() else h[live]
            for j in range(0, len(h), NEAR):
                now = slice(f[0, 0] + j, f[0, 0] + min(j + NEAR, len(h)))
                logits = self.class_logits(h[j : j + NEAR], inputs[now])
                own = logits.take(np.arange(0, logits.size, classes) + cls[now])
                np.exp(logits, out=logits)
                own -= np.log(logits @ _ONES)
                gained[now] += own
        return gained, inputs

    def score(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The log of every word's product over its ids, its context, and the documents' numbers of
        words; the end is a document's last word."""
        gained, inputs = self.each(docs)
        size = np.array([len(d) for d in docs])
        begin = np.cumsum(size) - size
        at, _ = split(np.concatenate(docs).astype(np.int64), begin, self.opens)
        return np.add.reduceat(gained.astype(np.float64), at), context(inputs[at]), np.diff(np.r_[np.searchsorted(at, begin), len(at)])


_MASK = np.where(np.arange(WINDOW)[None, :] <= np.arange(CONTEXT, WINDOW)[:, None], np.float32(0), np.float32(-1e9))


def context(row: np.ndarray) -> np.ndarray:
    return np.log2(row + 1).astype(np.uint8)


def numbering(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Input rows, classes and log P(id | class) from the counts of ids."""
    order = np.argsort(-counts, kind="stable")
    n = len(counts)
    cls, inputs = np.empty(n, np.int64), np.empty(n, np.int64)
    rest = order[ALONE:]
    mass = np.cumsum(counts[rest] + 1e-3)
    cls[order[:ALONE]] = np.arange(min(ALONE, n))
    cls[rest] = ALONE + np.minimum((mass - 1e-9) * SHARED // mass[-1], SHARED - 1).astype(np.int64) if len(rest) else 0
    inputs[order[:INPUTS]] = np.arange(min(INPUTS, n))
    inputs[order[INPUTS:]] = INPUTS + cls[order[INPUTS:]] - ALONE
    smooth = counts + 0.1
    within = np.log(smooth / np.bincount(cls, smooth, ALONE + SHARED)[cls])
    return inputs, cls, within.astype(np.float32)


def windows_of(model: Model, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Input rows of all windows of documents, how many at the front are padding, the classes that follow
    the context, and whether they are there."""
    step, size = WINDOW - CONTEXT, np.array([len(d) for d in docs])
    ids = np.concatenate(docs).astype(np.int64)
    begin, n = np.cumsum(size) - size, -(-size // step)
    inputs = np.r_[model.input[model.end], model.input[ids[:-1]]]
    inputs[begin] = model.input[model.end]
    doc = np.repeat(np.arange(len(docs)), n)
    start = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * step
    at = start[:, None] + np.arange(-CONTEXT, step)[None, :]
    inside = (at >= 0) & (at < size[doc][:, None])
    place = begin[doc][:, None] + np.where(inside, at, 0)
    return inputs.astype(np.uint16)[place], np.where(start == 0, CONTEXT, 0), model.cls[ids[place[:, CONTEXT:]]], inside[:, CONTEXT:]


def fit(model: Model, docs: list[np.ndarray], epochs: int = 3, batch: int = 64, rate: float = 3e-3, seed: int = 7) -> None:
    """Fits the attention's weights by Adam on whole documents."""
    rng = np.random.default_rng(seed)
    if not docs:
        return
    rows, lead, target, live = windows_of(model, docs)
    # The weights, their gradients and means lie end to end.
    flat = np.concatenate([v.ravel() for v in model.weights.values()])
    near = replace(model, pair=model.pair * _BITS + np.float32(_BIAS), weights={})
    far = np.abs(model.pair).max()
    spots = np.arange(model.weights["embed"].size).reshape(-1, WIDTH)
    grad, m1, m2 = np.zeros_like(flat), np.zeros_like(flat), np.zeros_like(flat)
    w, g, at = {}, {}, 0
    for name, v in model.weights.items():
        w[name], g[name] = (x[at : at + v.size].reshape(v.shape) for x in (flat, grad))
        at += v.size
    model.weights = w
    t, total = 0, epochs * max(1, len(rows) // batch)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // batch)):
            t += 1
            r, y = rows[part].astype(np.int64), target[part].ravel()
            x, q, k, v, a, h = model.states(r, lead[part])
            own = h.reshape(-1, WIDTH)
            before, weight = r[:, CONTEXT:].ravel(), live[part].ravel() / np.float32(live[part].sum())
            gh = np.empty_like(own)
            grad[:] = 0
            near.weights["out"] = w["out"] * _BITS
            sure = far + max(own.max(), -own.min()) * np.abs(w["out"]).sum(0).max() < 80  # of any logit
            for i in range(0, len(own), FIT_NEAR):
                some = slice(i, i + FIT_NEAR)
                p = near_exp(near.class_logits(own[some], before[some]), sure)
                # p becomes the gradient of the mean loss by the logits over `scale`, in place.
                mass = p @ _ONES
                p.reshape(-1)[np.arange(0, p.size, p.shape[1]) + y[some]] -= mass
                scale = (weight[some] / mass)[:, None]
                g["out"] += (p.T @ (own[some] * scale)).T
                np.multiply(p @ w["out"].T, scale, out=gh[some])
            late = x[:, CONTEXT:]
            mean = own - late.reshape(-1, WIDTH)
            mean *= gh
            mean = (mean @ _ONES[:WIDTH]).reshape(*a.shape[:2], 1)
            gh = gh.reshape(h.shape)
            gs = gh @ v.transpose(0, 2, 1)
            gv = (a.transpose(0, 2, 1) @ gh).reshape(-1, WIDTH)
            gs -= mean
            gs *= a
            gq, gk = (gs @ k).reshape(-1, WIDTH), (gs.transpose(0, 2, 1) @ q).reshape(-1, WIDTH)
            np.matmul(late.reshape(-1, WIDTH).T, gq, out=g["q"])
            seen = x.reshape(-1, WIDTH)
            np.matmul(seen.T, gk, out=g["k"])
            np.matmul(seen.T, gv, out=g["v"])
            gx = gk @ w["k"].T
            gx += gv @ w["v"].T
            gx = gx.reshape(x.shape)
            gx[:, CONTEXT:] += gh + (gq @ w["q"].T).reshape(h.shape)
            gx.sum(0, out=g["place"])
            g["embed"].reshape(-1)[:] = np.bincount(spots.take(r, 0).ravel(), gx.ravel(), spots.size)
            now = rate * min(1.0, 1.5 * (1 - t / (total + 1)))
            m1 *= 0.9
            m1 += 0.1 * grad
            m2 *= 0.99
            m2 += 0.01 * grad * grad
            flat -= now / (1 - 0.9**t) * m1 / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)


def near_exp(x: np.ndarray, sure: bool = False) -> np.ndarray:
    """exp(y) within a sixteenth, never below, for the fit's gradients, where x is y * _BITS + _BIAS. As a
    float's bits, x is 2**y with a straight line between powers of 2. sure: no x is beyond their range."""
    if not sure:
        np.clip(x, _LEAST, 2 * _BIAS - _LEAST, out=x)
    return x.astype(np.int32).view(np.float32)


PARTS = 256  # of a summed array


def _sum_arrays(df: DataFrame, size: int) -> np.ndarray:
    """The sum of arrays of int64 that tasks sent as the cells that are not 0 (part, at, n). Each part is
    added up by a task of its own, and leaves it as whole as the array is."""
    length = [len(x) for x in np.array_split(np.zeros(size, np.int8), PARTS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for p, at, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if p not in total:
                    total[p] = np.zeros(length[p], np.int64)
                total[p][np.frombuffer(at, np.uint32)] += np.frombuffer(n, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["part", "data"])

    out = [np.zeros(n, np.int64) for n in length]
    for r in df.repartition("part").mapInArrow(tidy(run), "part int, data binary").collect():
        out[r["part"]] = np.frombuffer(r["data"], np.int64)
    return np.concatenate(out)


def _array_rows(x: np.ndarray) -> pa.RecordBatch:
    """The cells of an array that are not 0, by part."""
    parts = [(p.astype(np.int64), np.flatnonzero(p).astype(np.uint32)) for p in np.array_split(x, PARTS)]
    some = [i for i, (_, at) in enumerate(parts) if len(at)]
    cells = [pa.array([f(*parts[i]).tobytes() for i in some], pa.binary()) for f in (lambda _, at: at, lambda p, at: p[at])]
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *cells], ["part", "at", "n"])


def shares(counted: np.ndarray, log: np.ndarray, where: np.ndarray, rounds: int = 50) -> np.ndarray:
    """The model's share for each context, from held-back words' frequencies in the other documents and
    log products; a context leans on the share of all by ten words."""
    share = np.full(SHARES, 0.5)
    if not len(log):
        return share
    model, n = np.exp(log), np.bincount(where, minlength=SHARES)
    for _ in range(rounds):
        own = share[where] * model
        part = own / np.maximum(own + (1 - share[where]) * counted, np.finfo(float).tiny)
        share = (np.bincount(where, part, SHARES) + 10 * part.mean()) / (n + 10)
        share = np.clip(share, 1e-3, 1 - 1e-3)
    return share


def fit_all(model: Model, own: DataFrame, seed: int) -> None:
    """Fits the weights further on all documents of own (ids binary), in ROUNDS parts of them."""
    shapes = {k: v.shape for k, v in model.weights.items()}
    edges = np.cumsum([v.size for v in model.weights.values()])
    scale = 1 << 20  # sums of whole numbers don't depend on their order
    for r in range(ROUNDS):
        small = replace(model, within=None, common=None, after=None, after_class=None)

        def learn(batches: Iterator[pa.RecordBatch], small: Model = small) -> Iterator[pa.RecordBatch]:
            mine, docs, n, seen = replace(small, weights={k: v.copy() for k, v in small.weights.items()}), [], 0, 0
            for b in batches:
                for d in b.column(0).to_pylist():
                    docs.append(np.frombuffer(d, np.uint16))
                    n += len(docs[-1])
                    if n >= CHUNK:
                        fit(mine, docs, 1, rate=RATE)
                        docs, n, seen = [], 0, seen + n
            fit(mine, docs, 1, rate=RATE)
            seen += n
            flat = np.concatenate([v.ravel() for v in mine.weights.values()]).astype(float)
            yield _array_rows(np.r_[np.rint(flat * seen * scale), seen])

        part = own.where(F.pmod(F.xxhash64("ids", F.lit(seed + 2)), F.lit(ROUNDS)) == r)
        total = _sum_arrays(part.mapInArrow(tidy(learn), "part int, at binary, n binary"), int(edges[-1]) + 1)
        if total[-1]:
            mean = np.split((total[:-1] / (float(total[-1]) * scale)).astype(np.float32), edges[:-1])
            model.weights = {k: x.reshape(shape) for (k, shape), x in zip(shapes.items(), mean, strict=True)}


def train(tokens: DataFrame, path: str, seed: int = 7) -> Model:
    """A model of the rows of tokens (ids binary) with train set."""
    own = tokens.where("train").select("ids")
    end, opens = vocabulary(path)[1], openings(path)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(end + 1, np.int64)
        for b in batches:
            for i in range(0, b.num_rows, 500):
                total += np.bincount(np.concatenate([np.frombuffer(d, np.uint16) for d in b.column(0).slice(i, 500).to_pylist()]), minlength=end + 1)
        yield _array_rows(total)

    counts = _sum_arrays(own.mapInArrow(tidy(count), "part int, at binary, n binary"), end + 1)
    inputs, cls, within = numbering(counts)
    classes = ALONE + SHARED

    common = np.full(end + 1, COMMON, np.int64)
    top = np.argsort(-counts, kind="stable")[:COMMON]
    common[top] = np.arange(len(top))

    column = np.where(common < COMMON, common, COMMON + cls - ALONE)
    cells = (INPUTS + SHARED) * (COMMON + SHARED)

    def draw(n: int, most: float, salt: int) -> Column:
        share = min(most, n / max(int(counts.sum()), 1))
        return F.pmod(F.xxhash64("ids", F.lit(salt)), F.lit(1 << 24)) <= int(share * (1 << 24))

    def arrays(df: DataFrame) -> list[np.ndarray]:
        return sorted((np.frombuffer(r["ids"], np.uint16) for r in df.collect()), key=lambda d: d.tobytes())

    back = draw(HELD, 0.1, seed + 1)
    held = arrays(own.where(back))

    def hashes(docs: list[np.ndarray]) -> np.ndarray:
        size = np.array([len(d) for d in docs], np.int64)
        return split(np.concatenate([np.zeros(0, np.uint16), *docs]).astype(np.int64), np.cumsum(size) - size, opens)[1]

    words = np.unique(hashes(held))

    def add_pairs(total: np.ndarray, docs: list[np.ndarray]) -> None:
        """Adds the documents' pairs, the other ids by class, and then how often they have the words held back."""
        ids = np.concatenate([np.array([end], np.uint16), *docs]).astype(np.int64)
        np.add.at(total, inputs[ids[:-1]] * (COMMON + SHARED) + column[ids[1:]], 1)
        if len(words):
            h, n = np.unique(hashes(docs), return_counts=True)
            at = np.minimum(np.searchsorted(words, h), len(words) - 1)
            same = words[at] == h
            total[cells + at[same]] += n[same]

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells + len(words), np.int64)
        for b in batches:
            for i in range(0, b.num_rows, 500):
                add_pairs(total, [np.frombuffer(d, np.uint16) for d in b.column(0).slice(i, 500).to_pylist()])
        yield _array_rows(total)

    every = _sum_arrays(own.mapInArrow(tidy(pairs), "part int, at binary, n binary"), cells + len(words))
    out = np.zeros_like(every)
    if held:
        add_pairs(out, held)

    def tables(total: np.ndarray) -> dict[str, np.ndarray]:
        both = total[:cells].reshape(INPUTS + SHARED, -1)
        after = np.zeros((INPUTS + SHARED, COMMON + 1), np.float32)
        after[:, :COMMON] = both[:, :COMMON]
        after_class = np.zeros((INPUTS + SHARED, classes), np.float32)
        np.add.at(after_class.T, cls[top], both[:, : len(top)].T)
        pair = after_class.astype(float)
        pair[:, ALONE:] += both[:, COMMON:]
        share = (pair.sum(0) + 0.5) / (pair.sum() + 0.5 * classes)
        pair = np.log((pair + 20 * share) / (pair.sum(1, keepdims=True) + 20))
        return {"pair": pair.astype(np.float32), "after": after, "after_class": after_class}

    rng = np.random.default_rng(seed)
    shapes = {"embed": (INPUTS + SHARED, WIDTH), "place": (WINDOW, WIDTH), "q": (WIDTH, WIDTH), "k": (WIDTH, WIDTH), "v": (WIDTH, WIDTH)}
    weights = {k: rng.normal(0, 0.25, s).astype(np.float32) for k, s in shapes.items()} | {"out": np.zeros((WIDTH, classes), np.float32)}
    less = counts - np.bincount(np.concatenate([np.zeros(0, np.uint16), *held]), minlength=end + 1)
    smooth = less + 0.1
    own_within = np.log(smooth / np.bincount(cls, smooth, classes)[cls]).astype(np.float32)
    model = Model(end, opens, int(less[opens].sum()), int(less[end]), np.full(SHARES, 0.5), inputs, cls, own_within, common=common, weights=weights, **tables(every - out))
    drawn = arrays(own.where(~back & draw(SAMPLE, 1.0, seed)))
    drawn = [drawn[i] for i in rng.permutation(len(drawn))]
    fit(model, drawn)
    fit_all(model, own.where(~back), seed)
    if held:
        parts = [model.score(held[i : i + 200])[:2] for i in range(0, len(held), 200)]
        log, where = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        model.share = shares((every - out)[cells:][np.searchsorted(words, hashes(held))] / max(model.words, 1), log, where)
    model.words, model.ends, model.within = int(counts[opens].sum()), int(counts[end]), within
    for name, x in tables(every).items():
        setattr(model, name, x)
    return model


def word_logs(m: Model, docs: list[np.ndarray], w: Words, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The log of the product over the ids of every word of w and of every end, and its context; a document's
    end follows its words. An id goes to the word in which, or in the space before which, its first byte lies;
    a word in which no id begins (odd white space can merge) has the product 1."""
    gained, rows = m.each(docs)
    length = np.array([len(d) for d in docs])
    ids = np.concatenate(docs).astype(np.int64)
    at = spelling(path)[1]
    size = at[ids + 1] - at[ids]
    slot = np.searchsorted(w.end, np.cumsum(size) - size, side="right") + np.repeat(np.arange(len(docs)), length)
    slots = len(w.hash) + len(docs)
    return np.bincount(slot, gained, slots), context(rows[np.searchsorted(slot, np.arange(slots))])


def word_hashes(docs: list[np.ndarray], odd: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ids that the documents' words have alone, and each document's number of words. In odd
    documents white space can merge, so their words are encoded one by one."""
    end = vocabulary(path)[1]

    def of(some: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        size = np.array([len(d) for d in some], np.int64)
        ids, begin = np.concatenate([np.zeros(0, np.uint16), *some]).astype(np.int64), np.cumsum(size) - size
        at, h = split(ids, begin, openings(path))
        own = ids[at] != end
        return h[own], np.diff(np.searchsorted(np.flatnonzero(own), np.r_[np.searchsorted(at, begin), len(at)]))

    if not odd.any():
        return of(docs)
    alone = Encoder(path)
    parts = []
    for d, strange in zip(docs, odd, strict=True):
        if strange:
            words = decode([d], path)[0].tobytes().split()
            parts.append((of([np.frombuffer(ids, np.uint16) for ids in alone.words([words])[0]])[0], [len(words)]))
        else:
            parts.append(of([d]))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def scores(df: DataFrame, held_out: Column, path: str, key: str = "doc_id", text: str = "text", fragments: int | None = None) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row."""
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), (~F.coalesce(held_out, F.lit(False))).alias("train"))
    kind = rows.schema["id"].dataType

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row is a chunk of whole documents, and never cut."""
        task, number, n = TaskContext.get().partitionId(), 0, 0
        held: list[tuple] = []

        def row(t: pa.DataType) -> pa.RecordBatch:
            a, b, c, d = zip(*held, strict=True)
            cells = [pa.array([(task << 32) | number], pa.int64()), pa.array([a], pa.list_(t)), *(pa.array([x], pa.list_(pa.bool_())) for x in (b, d)), pa.array([c], pa.list_(pa.binary()))]
            return pa.RecordBatch.from_arrays(cells, ["chunk", "id", "train", "odd", "ids"])

        known = Encoder(path)
        for b in batches:
            t = b.column("id").type
            for part in chunks(b, "text", 1 << 17):
                for i, learn, (ids, odd) in zip(part.column("id").to_pylist(), part.column("train").to_pylist(), known.documents(part.column("text").to_pylist()), strict=True):
                    held.append((i, learn, ids, odd))
                    n += len(ids) // 2
                    if n >= CHUNK:
                        yield row(t)
                        held, number, n = [], number + 1, 0
        if held:
            yield row(t)

    kinds = [("chunk", T.LongType()), ("id", T.ArrayType(kind)), *((c, T.ArrayType(T.BooleanType())) for c in ("train", "odd")), ("ids", T.ArrayType(T.BinaryType()))]
    tokens = scratch.keep(rows.mapInArrow(tidy(tokenise), T.StructType([T.StructField(*k) for k in kinds])))
    each = tokens.select(F.explode(F.arrays_zip("ids", "train")).alias("d")).select("d.ids", "d.train")
    shared = spark.sparkContext.broadcast(train(each, path))
    size = tokens.agg(F.sum(F.size("ids")).alias("n")).first()["n"] or 0
    fragments = fragments or max(2 * spark.sparkContext.defaultParallelism, size // 4000 + 1)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A chunk's distinct words in order, with how often its training documents have them, by fragment."""
        for b in batches:
            for chunk, learn, odd, docs in zip(*(b.column(c) for c in ("chunk", "train", "odd", "ids")), strict=True):
                h, words = word_hashes([np.frombuffer(d, np.uint16) for d in docs.as_py()], np.array(odd.as_py()), path)
                h, back = np.unique(h, return_inverse=True)
                n = np.bincount(back[np.repeat(np.array(learn.as_py(), bool), words)], minlength=len(h)).astype(np.uint32)
                frag = (h >> np.uint64(32)).astype(np.int64) * fragments >> 32
                edge = np.flatnonzero(np.r_[True, frag[1:] != frag[:-1]]) if len(h) else np.zeros(0, np.int64)
                cut = list(zip(edge, np.r_[edge[1:], len(h)], strict=True)) if len(h) else []
                cells = [frag[edge].astype(np.int32), np.full(len(cut), chunk.as_py()), *([x[i:j].tobytes() for i, j in cut] for x in (h, n))]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cells, (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["fragment", "chunk", "words", "n"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each chunk's words' counts in all chunks, in the order of the words; and (v, uses, without
        a chunk) the fragment's numbers of distinct training words and of their occurrences."""
        held: dict[int, list[tuple]] = {}
        names = ["fragment", "chunk", "width", "n", "v", "uses"]
        for b in batches:
            for f, *x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.setdefault(f, []).append(x)
        for f in list(held):
            own = held.pop(f)
            every, back = np.unique(np.concatenate([np.frombuffer(h, np.uint64) for _, h, _ in own]), return_inverse=True)
            total = np.bincount(back, np.concatenate([np.frombuffer(n, np.uint32) for *_, n in own]), len(every)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([f], pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), pa.array([int((total > 0).sum())]), pa.array([int(total.sum())])], names)
            width, at = 4 if total.max() < 1 << 32 else 8, 0
            total = total.astype(f"u{width}")
            for c, h, _ in own:
                n = len(h) // 8
                yield pa.RecordBatch.from_arrays([pa.array([f], pa.int32()), pa.array([c]), pa.array([width], pa.int32()), pa.array([total[back[at : at + n]].tobytes()]), *[pa.nulls(1, pa.int64())] * 2], names)
                at += n

    sent = tokens.mapInArrow(tidy(send), "fragment int, chunk long, words binary, n binary")
    summed = scratch.keep(sent.repartition(fragments, "fragment").mapInArrow(tidy(add_up), "fragment int, chunk long, width int, n binary, v long, uses long"))
    found = summed.agg(F.coalesce(F.sum("v"), F.lit(0)).alias("v"), F.coalesce(F.sum("uses"), F.lit(0)).alias("uses")).first()

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        """The scores of a chunk's documents; its words' counts come in the order of the fragments."""
        m = replace(shared.value, words=found["uses"] + shared.value.ends)
        learn, odd, docs = (left.column(c)[0].as_py() for c in ("train", "odd", "ids"))
        docs, odd = [np.frombuffer(d, np.uint16) for d in docs], np.array(odd)
        h, words = word_hashes(docs, odd, path)
        parts = sorted(zip(*(right.column(c).to_pylist() for c in ("fragment", "width", "n")), strict=True))
        total = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(n, f"u{width}").astype(np.int64) for _, width, n in parts)])
        seen = total[np.unique(h, return_inverse=True)[1]]
        doc = np.repeat(np.arange(len(docs)), words)
        slots = words + 1  # an end follows a document's words
        begin = np.cumsum(slots) - slots
        log, before = np.empty(slots.sum()), np.empty(slots.sum(), np.uint8)
        for strange in (False, True):
            some = np.flatnonzero(odd == strange)
            for i in range(0, len(some), 200):
                now = some[i : i + 200]
                own = [docs[d] for d in now]
                got = word_logs(m, own, words_of(*decode(own, path)), path) if strange else m.score(own)[:2]
                at = np.repeat(begin[now] - (np.cumsum(slots[now]) - slots[now]), slots[now]) + np.arange(slots[now].sum())
                log[at], before[at] = got
        count = np.full(len(log), m.ends)
        count[np.arange(len(doc)) + doc] = seen
        score = np.add.reduceat(m.mixed(count, log, before), begin)
        known, base = (np.bincount(doc, x, len(docs)) for x in (seen > 0, np.log10(seen + 0.1)))
        cells = [left.column("id")[0].values, pa.array(~np.array(learn, bool)), pa.array(slots), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score)]
        return pa.Table.from_arrays(cells, ["id", "held_out", "n_tokens", "n_words_known", "sum", "score"])

    names = [("id", kind), ("held_out", T.BooleanType()), *((c, T.LongType()) for c in ("n_tokens", "n_words_known")), *((c, T.DoubleType()) for c in ("sum", "score"))]
    left = tokens.repartition(fragments, "chunk").groupBy("chunk")
    right = summed.where("chunk is not null").select("fragment", "chunk", "width", "n").repartition(fragments, "chunk").groupBy("chunk")
    docs = left.cogroup(right).applyInArrow(finish, T.StructType([T.StructField(*x) for x in names]))
    docs = scratch.keep(docs)
    learnt = docs.where("not held_out").agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n"), F.count("*").alias("ends")).first()
    n, ends = learnt["n"], learnt["ends"]
    v = found["v"] + (1 if ends else 0)
    below = float(np.log10(n + 0.1 * (v + 1)))
    return docs.select(
        F.col("id").alias(key),
        "held_out",
        "n_tokens",
        (F.col("n_words_known") + (1 if ends else 0)).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("sum") + float(np.log10(ends + 0.1)) - F.col("n_tokens") * below).alias("base_score"),
        "score",
    )
