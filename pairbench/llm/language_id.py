"""Language identification of mixed documents by expectation-maximisation.

Learned: for every language, smoothed log-likelihoods of hashed byte 4-grams of lower-cased text,
counted over labelled rows. For a document, each word has a likelihood under each language (the
product over the 4-grams that end in it); EM estimates the proportions with which the languages mix
to give its words. The language set then starts from the best single language and takes in the next
one in order of proportion as long as the log-likelihood gains more than its penalty (half the log
of the number of words, times `penalty`). The prediction is the language with the largest
proportion in the chosen set, ties to the first in alphabetical order; the score is its proportion
over all languages.

A text that is null or empty or has no letter has prediction `und`, score 0 and an empty set. If no
row is labelled, every text has. Long texts are used whole, in blocks of words that are summed.
Repeated rows have equal results; an empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairbench.llm.textkit import Words, chunks, select_rows, tidy, words

BITS = 16
UNKNOWN = "und"
#: Languages that a model can have: its likelihoods are broadcast.
MOST_LANGS = 1000


def _grams(w: Words) -> np.ndarray:
    """The bucket of the 4-gram that ends at each byte; all white space is one space, and what
    stands before a document is space."""
    b = w.low.copy()
    b[(b == 9) | (b == 10) | (b == 11) | (b == 12) | (b == 13)] = 32
    x = b.astype(np.uint32)
    v = x.copy()
    inside = np.arange(len(x), dtype=np.int64) - np.repeat(w.doc_at[:-1], np.diff(w.doc_at))
    for k in (1, 2, 3):
        y = np.full(len(x), 32, np.uint32)
        y[k:] = x[:-k] if k else x
        y[inside < k] = 32
        v |= y << np.uint32(8 * k)
    return ((v * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64)


@dataclass(frozen=True)
class LanguageModel:
    langs: tuple[str, ...]
    table: np.ndarray  # buckets x languages, float32 log-likelihoods

    def word_scores(self, w: Words) -> np.ndarray:
        """words x languages: summed log-likelihoods of the 4-grams ending in each word."""
        g = self.table[_grams(w)]
        edges = np.stack([w.start, w.end], 1).ravel()
        if edges[-1] == len(g):
            g = np.concatenate([g, np.zeros((1, g.shape[1]), g.dtype)])
        return np.add.reduceat(g, edges, axis=0)[::2]

    def infer(self, w: Words, rounds: int = 12, penalty: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each document: proportions over all languages, and the chosen set with its own
        proportions (zero outside it); a document without words has zeros."""
        n, k = w.n_docs, len(self.langs)
        full, own = np.zeros((n, k)), np.zeros((n, k))
        if not len(w.hash) or not k:
            return full, own, own > 0
        score = self.word_scores(w)
        top = score.max(1)
        like = np.exp(score - top[:, None])
        docs = np.flatnonzero(w.count)
        at = w.offset[docs]
        count = w.count[docs].astype(np.float64)

        def em(pick: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Proportions and log-likelihoods (without `top`) of the documents `pick` of `docs`."""
            pi, value, live = start.copy(), np.full(len(pick), -np.inf), np.arange(len(pick))
            for _ in range(rounds):
                size = count[pick[live]].astype(np.int64)
                begin = np.cumsum(size) - size
                rows = np.repeat(at[pick[live]] - begin, size) + np.arange(size.sum())
                p = like[rows] * np.repeat(pi[live], size, axis=0).astype(np.float32)
                total = np.maximum(p.sum(1), 1e-30)
                p /= total[:, None]
                now = np.add.reduceat(np.log(total), begin)
                pi[live] = np.add.reduceat(p, begin, axis=0) / size[:, None]
                moved = now - value[live] > 1e-3 * size
                value[live] = now
                live = live[moved]
                if not len(live):
                    break
            return pi, value

        everyone = np.arange(len(docs))
        pi, value = em(everyone, np.full((len(docs), k), 1.0 / k))
        full[docs] = pi
        order = np.argsort(-pi, axis=1, kind="stable")
        alone = np.add.reduceat(score - top[:, None], at, axis=0)[everyone, order[:, 0]]
        chosen = np.zeros((len(docs), k))
        chosen[everyone, order[:, 0]] = 1.0
        cost = 0.5 * penalty * np.log(np.maximum(count, 2))
        live, best = np.flatnonzero(value > alone + cost), alone
        for size in range(2, k + 1):
            if not len(live):
                break
            start = np.zeros((len(live), k))
            np.put_along_axis(start, order[live, :size], 1.0 / size, 1)
            mix, got = em(live, start)
            better = got > best[live] + cost[live]
            live, mix, got = live[better], mix[better], got[better]
            chosen[live], best[live] = mix, got
        own[docs] = chosen
        return full, own, own > 0


def train(df: DataFrame, lang: str = "lang", text: str = "text", per_lang: int = 3000, alpha: float = 0.2, seed: int = 7) -> LanguageModel:
    """A model of all distinct non-null languages in df, of which there may be MOST_LANGS. The likelihoods are counted over a sample of
    about `per_lang` rows for each language (all rows, where there are fewer), drawn by a hash of the
    text; counts are added up on the executors, and languages x 2**16 counts reach the driver."""
    known = df.select(F.col(lang).alias("lang"), F.col(text).cast("string").alias("text")).where(F.col("lang").isNotNull())
    if known.select("lang").distinct().limit(MOST_LANGS + 1).count() > MOST_LANGS:
        raise ValueError(f"over {MOST_LANGS} languages: {lang} doesn't name languages")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = tuple(sorted(sizes))
    if not langs:
        return LanguageModel((), np.zeros((1 << BITS, 0), np.float32))
    draw = F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(1 << 40))
    share = F.create_map(*[F.lit(x) for la in langs for x in (la, min(1 << 40, round(per_lang / sizes[la] * (1 << 40))))])
    sample = known.where(draw < share[F.col("lang")])
    place = {la: i for i, la in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(langs) << BITS, np.int64)
        for batch in batches:
            for part in chunks(batch, "text"):
                w = words(part.column("text"))
                if not len(w.raw):
                    continue
                of = np.array([place[x] for x in part.column("lang").to_pylist()], np.int64)
                total += np.bincount((np.repeat(of, np.diff(w.doc_at)) << BITS) | _grams(w), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    got = sample.mapInArrow(tidy(count), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    c = np.zeros(len(langs) << BITS)
    c[got["at"].to_numpy(np.int64)] = got["n"].to_numpy()
    c = c.reshape(len(langs), 1 << BITS) + alpha
    return LanguageModel(langs, np.log(c / c.sum(1, keepdims=True)).T.astype(np.float32).copy())


def identify(df: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text", penalty: float = 1.0) -> DataFrame:
    """(key, lang_pred, score, langs array<string>, shares array<double>). One narrow stage; the
    model (languages x 2**16 floats) is broadcast."""
    kind = df.schema[key].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.langs, UNKNOWN], object)
        for batch in batches:
            for part in chunks(batch, "_text"):
                full, own, chosen = m.infer(words(part.column("_text")), penalty=penalty)
                ok = part.column("_letter").to_numpy(zero_copy_only=False).astype(bool) & chosen.any(1)
                best = np.where(ok, own.argmax(1) if len(m.langs) else 0, len(m.langs))
                score = np.where(ok, np.clip(np.c_[full, np.zeros(len(full))][np.arange(len(full)), best], 0, 1), 0.0)
                order = np.argsort(-own, axis=1, kind="stable")
                langs = [[m.langs[j] for j in order[i] if chosen[i, j]] if ok[i] else [] for i in range(len(ok))]
                shares = [[float(own[i, j]) for j in order[i] if chosen[i, j]] if ok[i] else [] for i in range(len(ok))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(names[best].tolist(), pa.string()), pa.array(score, pa.float64()), pa.array(langs, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))],
                    [key, "lang_pred", "score", "langs", "shares"],
                )

    whole = F.col(text).cast("string")
    cols = df.select(F.col(key), whole.alias("_text"), F.coalesce(whole.rlike(r"\p{L}"), F.lit(False)).alias("_letter"))
    return cols.mapInArrow(tidy(run), f"`{key}` {kind}, lang_pred string, score double, langs array<string>, shares array<double>")


def known(df: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """The rows of df whose text has a predicted language; those with `und` go."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def keep(texts: pa.Array) -> np.ndarray:
        letter = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
        return letter & shared.value.infer(words(texts))[2].any(1)

    return select_rows(df, text, keep)
