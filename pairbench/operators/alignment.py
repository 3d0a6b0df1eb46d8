"""Pairwise alignment of short sequences and greedy clustering by edits.

Alignments run over distinct pairs in Arrow batches; the substitution scores are a parameter
(`read_matrix` takes the usual text form of such tables).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Substitution score of two letters.
Score = Callable[[str, str], int]


def plain(a: str, b: str) -> int:
    return 5 if a == b else -2


def read_matrix(text: str) -> Score:
    """Scores from a table with a header of letters and one row a letter; # begins a comment."""
    lines = [x.split() for x in text.splitlines() if x.strip() and not x.startswith("#")]
    table = {(row[0], c): int(v) for row in lines[1:] for c, v in zip(lines[0], row[1:], strict=True)}
    return lambda a, b: table[a, b]


def _encode(texts: list[str], letters: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(t) for t in texts], np.int64)
    out = np.zeros((len(texts), int(size.max(initial=0)) + 1), np.int64)
    for row, t in zip(out, texts, strict=True):
        row[: len(t)] = [letters[c] for c in t]
    return out, size


def align_all(pairs: list[tuple[str, str]], score: Score = plain, start: int = -11, extend: int = -1, free_ends: bool = True, local: bool = False) -> list[tuple[np.ndarray, np.ndarray]]:
    """Best alignment of every pair as columns (places in a, places in b), -1 in a gap. Three states
    (match, gap in b, gap in a), filled along anti-diagonals for all pairs at once; terminal gaps are
    free unless free_ends is False. Ties prefer a match. `local` aligns the best parts only (of equal
    ones that ending first) and gives no columns if nothing scores over 0."""
    order = sorted(range(len(pairs)), key=lambda x: (len(pairs[x][0]), len(pairs[x][1])))
    out: list = [None] * len(pairs)
    at = 0
    while at < len(order):
        stop = at + 1
        most = (len(pairs[order[at]][0]) + 1) * 4
        while stop < len(order) and (stop - at + 1) * (len(pairs[order[stop]][0]) + 1) * (max(len(pairs[x][1]) for x in (order[at], order[stop])) + 1) <= 1 << 21 and len(pairs[order[stop]][0]) < most:
            stop += 1
        part = order[at:stop]
        for x, got in zip(part, _align_part([pairs[x] for x in part], score, start, extend, free_ends, local), strict=True):
            out[x] = got
        at = stop
    return out


def _align_part(pairs: list[tuple[str, str]], score: Score, start: int, extend: int, free: bool, local: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    letters = {c: i for i, c in enumerate(sorted({c for p in pairs for t in p for c in t}))}
    table = np.array([[score(x, y) for y in letters] for x in letters] or [[0]], np.int32)
    a, n = _encode([p[0] for p in pairs], letters)
    b, m = _encode([p[1] for p in pairs], letters)
    rows, wide, high, low = len(pairs), a.shape[1], b.shape[1], np.int32(-(10**9))
    flip = b[:, ::-1]  # so that an anti-diagonal is a slice of both
    back = np.zeros((wide + high - 1, 3, rows, wide), np.int8)
    older = np.full((3, rows, wide), low, np.int32)
    old = older.copy()
    end = np.zeros((rows, 3), np.int64)  # state, i, j
    top = np.zeros(rows, np.int64) if local else np.full(rows, low)
    ends = free and not local

    def best_of(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = (s[1] > s[0]).astype(np.int8)
        best = np.maximum(s[0], s[1])
        k[s[2] > best] = 2
        return np.maximum(best, s[2]), k

    for d in range(wide + high - 1):
        lo, hi = max(0, d - high + 1), min(wide, d + 1)
        now = np.full((3, rows, wide), low, np.int32)
        if d == 0:
            now[0, :, 0] = 0
        p, q = max(lo, 1), min(hi, d)  # both places over 0
        if p < q:
            base, k = best_of(older[:, :, p - 1 : q - 1])
            if local:
                k[base <= 0] = 3
                base = np.maximum(base, 0)
            # The letter of b at j - 1 = d - i - 1 stands at high - d + i in flip.
            now[0, :, p:q] = base + table[a[:, p - 1 : q - 1], flip[:, high - d + p : high - d + q]]
            back[d, 0, :, p:q] = k
        for state, p, q in ((1, max(lo, 1), hi), (2, lo, min(hi, d))):
            if p >= q:
                continue
            before = old[:, :, p - 1 : q - 1] if state == 1 else old[:, :, p:q]
            cost = np.full((3, 1, 1), start, np.int32)
            cost[state] = extend
            at = before + cost
            if ends:  # terminal gaps: j is 0 or m (state 1), i is 0 or n (state 2)
                place, last = (d, m) if state == 1 else (0, n)
                if p <= place < q:
                    at[:, :, place - p] = before[:, :, place - p]
                own = d - last if state == 1 else last
                hit = np.flatnonzero((own >= p) & (own < q))
                at[:, hit, own[hit] - p] = before[:, hit, own[hit] - p]
            now[state, :, p:q], back[d, state, :, p:q] = best_of(at)
        i = np.arange(lo, hi)
        j = d - i
        if local:
            inside = (i[None, :] <= n[:, None]) & (j[None, :] <= m[:, None])
            best = np.where(inside, now[0, :, lo:hi], low)
            k = best.argmax(1)
            value = best[np.arange(rows), k]
            better = value > top
            top = np.where(better, value, top)
            end[better] = np.stack([np.zeros(rows, np.int64), i[k], j[k]], 1)[better]
        else:
            done = np.flatnonzero(n + m == d)
            if len(done):
                end[done] = np.stack([now[:, done, n[done]].argmax(0), n[done], m[done]], 1)
        older, old = old, now
    state, i, j = end.T.copy()
    live = (top > 0) if local else (i + j > 0)
    steps: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    every = np.arange(rows)
    while live.any():
        w = every[live]
        s, p, q = state[w], i[w], j[w]
        steps.append((w, np.where(s != 2, p - 1, -1), np.where(s != 1, q - 1, -1)))
        k = back[p + q, s, w, p]
        i[w], j[w], state[w] = p - (s != 2), q - (s != 1), k
        live[w] = (k != 3) if local else (i[w] + j[w] > 0)
    if not steps:
        return [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * rows
    w, x, y = (np.concatenate([t[c] for t in steps][::-1]) for c in range(3))
    by = np.argsort(w, kind="stable")
    cut = np.cumsum(np.bincount(w, minlength=rows))[:-1]
    return list(zip(np.split(x[by], cut), np.split(y[by], cut), strict=True))


def align(a: str, b: str, score: Score = plain, start: int = -11, extend: int = -1, free_ends: bool = True) -> list[tuple[int, int]]:
    x, y = align_all([(a, b)], score, start, extend, free_ends)[0]
    return list(zip(x.tolist(), y.tolist(), strict=True))


def _profile(ref: str, var: str, x: np.ndarray, y: np.ndarray, free_ends: bool) -> tuple:
    """(edits, places, aligned, substitutions, insertions, deletions) of an alignment's columns."""
    both = (x >= 0) & (y >= 0)
    if free_ends:
        inner = np.flatnonzero(both)
        keep = slice(inner[0], inner[-1] + 1) if len(inner) else slice(0, 0)
        x, y, both = x[keep], y[keep], both[keep]
    differ = np.zeros(len(x), bool)
    differ[both] = [ref[i] != var[j] for i, j in zip(x[both].tolist(), y[both].tolist(), strict=True)]
    edits = differ | ~both
    place = np.where(x >= 0, x + 1, np.minimum(np.maximum.accumulate(x + 1) + 1, len(ref))) if len(x) else x
    return int(edits.sum()), place[edits].tolist(), int(both.sum()), int(differ.sum()), int((x < 0).sum()), int((y < 0).sum())


def edit_profiles(pairs: list[tuple[str, str]], score: Score = plain, free_ends: bool = True) -> list[tuple]:
    """For each (ref, var): edits, their 1-based places in ref, aligned columns, substitutions,
    insertions, deletions. Terminal gaps are no edits unless free_ends is False; an insertion takes the
    place after it, at most ref's last."""
    unlike = [k for k, (r, v) in enumerate(pairs) if r != v]
    out = [(0, [], len(r), 0, 0, 0) for r, _ in pairs]
    for k, (x, y) in zip(unlike, align_all([pairs[k] for k in unlike], score, free_ends=free_ends), strict=True):
        out[k] = _profile(*pairs[k], x, y, free_ends)
    return out


def edit_profile(ref: str, var: str, score: Score = plain, free_ends: bool = True) -> tuple[int, list[int], int]:
    """(edits, their 1-based places in ref, aligned columns) of one pair."""
    return edit_profiles([(ref, var)], score, free_ends)[0][:3]


def profiles(pairs: DataFrame, ref: str, var: str, score: Score = plain, least_overlap: float = 0.6) -> DataFrame:
    """Edits and their kinds, places, aligned columns, overlap, identity (NULL if nothing aligns) and
    whether the overlap makes the two comparable, for the distinct pairs of two string columns."""
    names = ["n_edits", "positions", "n_aligned", "n_sub", "n_ins", "n_del"]

    def run(batches):
        for batch in batches:
            got = edit_profiles(list(zip(batch[ref], batch[var], strict=True)), score)
            yield batch.reset_index(drop=True).join(pd.DataFrame(got, columns=names))

    own = pairs.select(ref, var).where(F.col(ref).isNotNull() & F.col(var).isNotNull()).distinct()
    kinds = "n_edits long, positions array<long>, n_aligned long, n_sub long, n_ins long, n_del long"
    out = own.mapInPandas(run, f"`{ref}` string, `{var}` string, {kinds}")
    short = F.greatest(F.least(F.length(ref), F.length(var)), F.lit(1))
    out = out.withColumn("overlap", F.col("n_aligned") / short)
    identity = 1 - F.col("n_edits") / F.nullif(F.col("n_aligned"), F.lit(0))
    return out.withColumn("identity", F.round(identity, 6)).withColumn("comparable", F.col("overlap") >= least_overlap)


def cluster(rows: list[tuple], most: int, least: float, score: Score = plain) -> list[int]:
    """The seed's place for each (sequence, key): longest first, each joins the first seed within
    `most` edits and at least `least` overlap, or becomes a seed."""
    order = sorted(range(len(rows)), key=lambda i: (-len(rows[i][0]), rows[i][0], rows[i][1]))
    seeds: list[int] = []
    out = [0] * len(rows)
    for i in order:
        home = None
        for at in range(0, len(seeds), 64):
            part = seeds[at : at + 64]
            got = edit_profiles([(rows[s][0], rows[i][0]) for s in part], score)
            fits = [s for s, g in zip(part, got, strict=True) if g[0] <= most and g[2] >= least * max(min(len(rows[s][0]), len(rows[i][0])), 1)]
            if fits:
                home = fits[0]
                break
        if home is None:
            seeds.append(i)
        out[i] = i if home is None else home
    return out


def greedy_clusters(df: DataFrame, family: str, key: str, seq: str, most: int = 5, least: float = 0.6, score: Score = plain) -> DataFrame:
    """(key, family, seed_seq): clusters of distinct sequences, in sequence within each family, as the
    definition asks; families are independent tasks."""
    distinct = df.where(F.col(seq).isNotNull()).groupBy(family, seq).agg(F.min(key).alias("k"))

    def run(own: pd.DataFrame) -> pd.DataFrame:
        seeds = cluster(list(zip(own[seq], own["k"], strict=True)), most, least, score)
        return pd.DataFrame({family: own[family], seq: own[seq], "seed_seq": own[seq].to_numpy()[seeds]})

    found = distinct.groupBy(family).applyInPandas(run, f"`{family}` string, `{seq}` string, seed_seq string")
    return df.join(found, [family, seq]).select(key, family, "seed_seq")
