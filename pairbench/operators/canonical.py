"""Canonical windows of constructs: cut from the construct, filled from a reference, or short."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairbench.operators.alignment import Score, align_all, plain

PAD, MOST_EDITS, LEAST_COVERAGE = 10, 5, 0.95


def covers(construct: Column, first: Column, last: Column, pad: int = PAD) -> Column:
    """Whether the construct itself holds the padded envelope (1-based, inclusive)."""
    return (first - pad >= 1) & (last + pad <= F.length(construct))


class Placed:
    """Many constructs, each put on its reference by a local alignment. All columns of all alignments lie
    end to end in arrays: the pair, the place in the reference and in the construct (-1 in a gap)."""

    def __init__(self, rows: list[tuple[str, str, int, int]], columns: list[tuple[np.ndarray, np.ndarray]]):
        """rows: (construct, reference, first, last); the envelope is 1-based in the construct."""
        n = np.array([len(x) for x, _ in columns], np.int64)
        self.pair = np.repeat(np.arange(len(rows)), n)
        self.x, self.y = (np.concatenate([c[i] for c in columns] or [np.zeros(0, np.int64)]).astype(np.int64) for i in (0, 1))
        c, r = ([row[i] for row in rows] for i in (0, 1))
        self.letters, self.starts = zip(*(_letters(texts) for texts in (c, r)), strict=True)
        size = np.array([len(t) for t in c], np.int64)
        first, last = (np.array([row[i] for row in rows], np.int64) for i in (2, 3))
        # The residue that a column holds, or before which its gap stands, decides whether it is inside.
        seen = np.maximum.accumulate(np.where(self.y >= 0, self.y + 1 + self.pair * (1 << 40), 0)) - self.pair * (1 << 40) if len(self.y) else self.y
        at = np.where(self.y >= 0, self.y + 1, np.maximum(seen, 0) + 1)
        inside = (first[self.pair] <= at) & (at <= last[self.pair])
        self.both = (self.x >= 0) & (self.y >= 0)
        equal = np.zeros(len(self.x), bool)
        p = self.pair[self.both]
        equal[self.both] = self.letters[0][self.starts[0][p] + self.y[self.both]] == self.letters[1][self.starts[1][p] + self.x[self.both]]
        count = lambda mask: np.bincount(self.pair[mask], minlength=len(rows))
        self.outside, self.inside = count(~equal & ~inside), count(self.both & ~equal & inside)
        self.coverage = count(self.y >= 0) / np.maximum(size, 1)
        # The envelope on the reference: from the first to the last residue of it that is aligned.
        core = np.flatnonzero(self.both & inside)
        self.first, self.last = np.full(len(rows), 1 << 60), np.full(len(rows), -1)
        np.minimum.at(self.first, self.pair[core], self.x[core])
        np.maximum.at(self.last, self.pair[core], self.x[core])
        self.found = self.last >= 0

    def good(self) -> np.ndarray:
        return self.found & (self.outside <= MOST_EDITS) & (self.coverage >= LEAST_COVERAGE)

    def borrowed(self, lo: np.ndarray, hi: np.ndarray, keep: np.ndarray) -> list[str]:
        """For the kept pairs the reference from lo to hi, with the construct's residues where they align."""
        n = np.where(keep, hi - lo + 1, 0)
        begin = np.cumsum(n) - n
        own = np.repeat(np.arange(len(n)), n)
        text = self.letters[1][self.starts[1][own] + lo[own] + np.arange(n.sum()) - begin[own]]
        put = np.flatnonzero(self.both & keep[self.pair])
        put = put[(self.x[put] >= lo[self.pair[put]]) & (self.x[put] <= hi[self.pair[put]])]
        p = self.pair[put]
        text[begin[p] + self.x[put] - lo[p]] = self.letters[0][self.starts[0][p] + self.y[put]]
        joined = text.tobytes().decode("utf-32-le")
        return [joined[a : a + k] for a, k in zip(begin.tolist(), n.tolist(), strict=True)]


def _letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of texts end to end, and where each begins."""
    size = np.array([len(t) for t in texts], np.int64)
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).copy(), np.cumsum(size) - size


def windows(df: DataFrame, construct: str, first: str, last: str, reference: str, pad: int = PAD, score: Score = plain) -> DataFrame:
    """df with window, origin (construct, reference, short), env_first, env_last (the envelope in the
    window) and full. A construct that covers the padded envelope is cut; else its flanks come from the
    reference if it is placed well (coverage, edits outside the envelope); else what there is, flagged.
    Null constructs or envelopes have a null window."""
    text, a, z, known_ref = df[construct], df[first], df[last], df[reference]
    whole = covers(text, a, z, pad)
    known = text.isNotNull() & a.isNotNull() & z.isNotNull()
    lo = F.greatest(a - pad, F.lit(1))
    hi = F.least(z + pad, F.length(text))

    def made(window: Column, origin: str, start: Column, stop: Column, full: bool) -> Column:
        return F.struct(window.alias("window"), F.lit(origin).alias("origin"), start.cast("long").alias("env_first"), stop.cast("long").alias("env_last"), F.lit(full).alias("full"))

    cut = made(F.substring(text, a - pad, z - a + 1 + 2 * pad), "construct", F.lit(pad + 1), pad + z - a + 1, True)
    short = made(F.substring(text, lo, hi - lo + 1), "short", a - lo + 1, z - lo + 1, False)
    asked = df.where(known & ~whole & known_ref.isNotNull()).select(text.alias("c"), a.cast("long").alias("f"), z.cast("long").alias("l"), known_ref.alias("r")).distinct()

    def fill(batches):
        for b in batches:
            rows = list(zip(b["c"], b["r"], b["f"], b["l"], strict=True))
            own = Placed(rows, align_all([(r, c) for c, r, _, _ in rows], score, local=True))
            keep = own.good()
            end = np.array([len(r) for _, r, _, _ in rows], np.int64) - 1
            lo, hi = np.maximum(own.first - pad, 0), np.minimum(own.last + pad, end)
            text = own.borrowed(lo, hi, keep)
            full = (own.first >= pad) & (own.last + pad <= end)
            got = [dict(window=t, origin="reference", env_first=int(f), env_last=int(z), full=bool(w)) if k else None for k, t, f, z, w in zip(keep, text, own.first - lo + 1, own.last - lo + 1, full, strict=True)]
            yield b.assign(got=pd.Series(got, dtype=object))

    kind = "struct<window:string,origin:string,env_first:long,env_last:long,full:boolean>"
    filled = asked.mapInPandas(fill, f"c string, f long, l long, r string, got {kind}").where("got IS NOT NULL")
    on = (text == filled["c"]) & (a == filled["f"]) & (z == filled["l"]) & (known_ref == filled["r"])
    best = F.when(known & whole, cut).when(known, F.coalesce(filled["got"], short))
    return df.join(filled, on, "left").select(*[df[c] for c in df.columns], best.alias("__window")).select(*[f"`{c}`" for c in df.columns], "__window.*")


def conflicting(df: DataFrame, group: str, construct: str, score: Score = plain) -> DataFrame:
    """(group, conflict): whether any two constructs of a group differ in a residue where they overlap.
    Distinct constructs are paired within their group only; a group has few."""
    own = df.select(F.col(group).alias("g"), F.col(construct).alias("x")).where(F.col("x").isNotNull()).distinct()
    pairs = own.join(own.toDF("g", "y"), "g").where("x < y")

    def run(batches):
        for b in batches:
            rows = list(zip(b["x"], b["y"], strict=True))
            clash = [any(p >= 0 and q >= 0 and s[p] != t[q] for p, q in zip(x.tolist(), y.tolist(), strict=True)) for (s, t), (x, y) in zip(rows, align_all(rows, score), strict=True)]
            yield pd.DataFrame({"g": b["g"], "clash": clash})

    kind = own.schema["g"].dataType.simpleString()
    found = pairs.mapInPandas(run, f"g {kind}, clash boolean").groupBy("g").agg(F.bool_or("clash").alias("conflict"))
    return own.select("g").distinct().join(found, "g", "left").select(F.col("g").alias(group), F.coalesce("conflict", F.lit(False)).alias("conflict"))


def locate(protein: Column, construct: Column, domain: Column) -> Column:
    """1-based place of the construct in its protein, else of the domain, else NULL (left to `located`)."""
    at = lambda x: F.nullif(F.instr(protein, x), F.lit(0))
    return F.coalesce(at(construct), at(domain))


def _neighbourhood(domain: str, protein: str, k: int = 3, spare: int = 12) -> tuple[int, int]:
    """The part of a protein worth aligning a domain with: around the diagonal on which most of their
    words of k letters lie, the first of equal ones; the whole protein without a common word."""
    places: dict[str, list[int]] = {}
    for j in range(len(domain) - k + 1):
        places.setdefault(domain[j : j + k], []).append(j)
    hits = [i - j for i in range(len(protein) - k + 1) for j in places.get(protein[i : i + k], ())]
    if not hits:
        return 0, len(protein)
    diagonal, n = np.unique(hits, return_counts=True)
    # Insertions and deletions shift diagonals: neighbours within `spare` count together.
    total = np.concatenate([[0], np.cumsum(n)])
    near = total[np.searchsorted(diagonal, diagonal + spare, side="right")] - total[np.searchsorted(diagonal, diagonal - spare)]
    at = int(diagonal[int(near.argmax())])
    return max(0, at - 2 * spare), min(len(protein), at + len(domain) + 2 * spare)


def located(df: DataFrame, protein: str, construct: str, first: str, last: str, score: Score = plain) -> DataFrame:
    """df with start and stop (1-based) of the construct's envelope in its protein, and route: the construct
    stands in the protein word for word, or the envelope alone does, or a local alignment places at least
    95 % of the envelope. Without a place, or with a null or empty protein, all three are NULL. The
    alignment sees only what lies around the best diagonal of common words, and only rows that the other
    routes leave over reach it, each distinct pair once."""
    p, c, a, z = df[protein], df[construct], df[first].cast("long"), df[last].cast("long")
    domain = F.substring(c, a.cast("int"), (z - a + 1).cast("int"))
    at, inner = F.nullif(F.instr(p, c), F.lit(0)), F.nullif(F.instr(p, domain), F.lit(0))
    size = F.length(domain)
    known = p.isNotNull() & (p != "") & (size > 0)
    left = df.where(known & at.isNull() & inner.isNull()).select(p.alias("p"), domain.alias("d")).distinct()

    def run(batches):
        for b in batches:
            rows = list(zip(b["d"], b["p"], strict=True))
            part = [_neighbourhood(d, q) for d, q in rows]
            cut = [(d, q[lo:hi], 1, len(d)) for (d, q), (lo, hi) in zip(rows, part, strict=True)]
            own = Placed(cut, align_all([(q, d) for d, q, _, _ in cut], score, local=True))
            keep = own.found & (own.coverage >= LEAST_COVERAGE)
            lo = np.array([x for x, _ in part], np.int64)
            yield b.assign(s=lo + own.first + 1, e=lo + own.last + 1)[keep]

    found = left.mapInPandas(run, "p string, d string, s long, e long")
    route = F.when(~known, F.lit(None)).when(at.isNotNull(), "construct").when(inner.isNotNull(), "domain").when(found["s"].isNotNull(), "alignment")
    start = F.when(known, F.coalesce(at + a - 1, inner.cast("long"), found["s"]))
    stop = F.when(known, F.coalesce(at + z - 1, inner + size - 1, found["e"]))
    joined = df.join(found, (p == found["p"]) & (domain == found["d"]), "left")
    return joined.select(*[df[x] for x in df.columns], start.cast("long").alias("start"), stop.cast("long").alias("stop"), route.alias("route"))
