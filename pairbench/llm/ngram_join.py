"""Exact n-gram Jaccard self-join by vertical partitioning, returned as linked components.

A document is the set of its distinct word shingles (64-bit hashes). Documents with equal sets form a
class and are joined once. The steps:

1. `profiles`: each document's set size, digest and parity bitmap, and a sketch of how often n-grams
   occur: 2**20 counters, one for each range of hash values. The sketch gives the global order of
   n-grams, rare before frequent, and its cuts into fragments of equal weight. A counter too heavy for
   one fragment is dealt to several by class; all its lists count as long.
2. `postings`: each class's prefix in the global order (only pairs that share a prefix n-gram can
   reach the threshold) goes to its fragments, packed in arrays.
3. `fragment`: each fragment counts the overlaps of the pairs that meet in it. N-grams with at most
   SMALL classes give all their pairs. Longer lists give each class's pair with the least class of
   its size band, and are kept.
4. The fragments' counts are summed per pair. A pair stays if the sum can still reach the threshold:
   of the document whose prefix ends first, every unmatched prefix n-gram is missing in the other.
5. `alike`: bitmaps that differ in more bits than the symmetric difference of a linked pair can have
   rule a pair out; no linked pair is lost. `overlaps`: the whole sets of the pairs left are cut into
   fragments again, partial overlaps are counted apart and summed, and the sum decides exactly.
6. Components of the links. In ROUNDS rounds every kept list pairs its classes with a few of its largest
   component, which joins large groups of near copies. Then it gives all pairs of classes that are
   still in different components; the pairs go to
   their member in the smaller component, packed, and only those that can reach the threshold are
   sent on. All these pass through 4 and 5 (the last with complete counts), and
   the components are made again. A pair inside a component needs no check: it can't change them.
   Lists are salted or cut into blocks by class, so that no list is a single task.

So no link between components is lost, and no group of copies is expanded into its pairs. Nothing is
capped. Broadcast are the sketch and filters of fixed size.

Null and empty texts have no shingles, link with nothing and are their own component. A text with
fewer than k words is one shingle of the whole. Rows with a null key take no part and are returned
with a null component. Rows that repeat a key are joined as one document each, so equal keys can have
different components. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairbench.llm import scratch
from pairbench.llm.textkit import chunks, mix, shingles, tidy, words

SKETCH_BITS = 20
SKETCH_PARTS = 64
SMALL = 16
#: Rounds of leaders over long lists, and leaders of a list.
ROUNDS, LEADERS = 1, 6
FILTER_BITS = 24
#: Prefix n-grams in one fragment, about.
FRAGMENT = 250_000
#: N-grams that a counter must hold for each part it is dealt to.
HEAVY = 4 * FRAGMENT
VERIFY_FRAGMENTS = 4
#: Links that one task may solve.
FINISH = 50_000
#: Parts that a list's rows are dealt to when they meet its leaders, and rows of a list in one block.
SALTS, BLOCK = 16, 1_000


def sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every document, in rising order, and their n + 1 positions."""
    w = words(texts)
    h, offset = shingles(w, k)
    doc = np.repeat(np.arange(w.n_docs), np.diff(offset))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(w.n_docs + 1))


def digests(h: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of every set, independent of order; 0 for an empty set."""
    with np.errstate(over="ignore"):
        out = []
        for salt in (np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0x5851F42D4C957F2D)):
            total = np.zeros(len(h) + 1, np.uint64)
            np.cumsum(mix(h ^ salt), out=total[1:])
            out.append(mix(total[offset[1:]] - total[offset[:-1]]).view(np.int64))
    return out[0], out[1]


def bitmaps(h: np.ndarray, offset: np.ndarray) -> list[bytes]:
    """For every set the parities of its hashes' last bits: 2 to 4 bits an element, a power of two."""
    n = np.diff(offset)
    bits = np.int64(1) << np.ceil(np.log2(np.maximum(2 * n, 64))).astype(np.int64)
    edge = np.zeros(len(n) + 1, np.int64)
    np.cumsum(bits, out=edge[1:])
    at = np.repeat(edge[:-1], n) + (h & (np.repeat(bits, n) - 1).astype(np.uint64)).astype(np.int64)
    packed = np.packbits((np.bincount(at, minlength=edge[-1]) & 1).astype(bool), bitorder="little").tobytes()
    return [packed[i:j] for i, j in zip((edge[:-1] // 8).tolist(), (edge[1:] // 8).tolist(), strict=True)]


def differing(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """In how many bits the bitmaps of pairs differ; the longer one is folded. Never more than the
    elements that are in one set only."""
    size = np.array([[len(a), len(b)] for a, b in zip(x, y, strict=True)], np.int64).reshape(-1, 2)
    out = np.zeros(len(size), np.int64)
    for kind in np.unique(size, axis=0):
        rows = np.flatnonzero((size == kind).all(1))
        p, q = (np.frombuffer(b"".join(side[i] for i in rows), np.uint8).reshape(len(rows), -1) for side in (x, y))
        while p.shape[1] != q.shape[1]:
            p, q = (p, q) if p.shape[1] > q.shape[1] else (q, p)
            p = p[:, : p.shape[1] // 2] ^ p[:, p.shape[1] // 2 :]
        out[rows] = np.bitwise_count(p ^ q).sum(1)
    return out


def need(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap with which sets of n and m reach the threshold."""
    return -(-percent * (n + m) // (100 + percent))


class Order:
    """The global order: by level (rare first), then range of hash values, then hash."""

    def __init__(self, counts: np.ndarray, fragments: int, heavy: int):
        mean = max(counts.mean(), 1.0)
        spread = 6 * np.sqrt(mean)  # below this a range is like any other
        self.level = np.where(counts <= mean + spread, 0, np.minimum(1 + 4 * np.log2(np.maximum(counts - mean, 1) / spread), 60)).astype(np.uint8)
        at = np.argsort(self.level, kind="stable")
        before = np.cumsum(counts[at]) - counts[at]
        self.cut = np.empty(len(counts), np.int32)
        self.cut[at] = np.minimum(before * fragments // max(int(counts.sum()), 1), fragments - 1)
        self.split = np.clip(counts // heavy, 1, 4096).astype(np.int16)

    def key(self, h: np.ndarray) -> np.ndarray:
        place = (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
        return (self.level[place].astype(np.uint64) << np.uint64(58)) | (h >> np.uint64(6))

    def fragment(self, h: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """Each n-gram's fragment; negative (and one of several by class) if its counter is heavy."""
        place = (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
        parts = self.split[place]
        part = (mix(cls.view(np.uint64)) % parts.astype(np.uint64)).astype(np.int64)
        return np.where(parts > 1, -(place * 4096 + part) - 1, self.cut[place])


def _rows(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text")).where(F.col("id").isNotNull())


def profiles(df: DataFrame, k: int) -> DataFrame:
    """(id, t, n, d1, d2, bits, part, counts): a row for each document, and rows with part and counts
    for the sketch of each task. t is a hash of the text as it stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int32)
        names = ["id", "t", "n", "d1", "d2", "bits", "part", "counts"]
        for batch in batches:
            for part in chunks(batch, "text"):
                h, offset = sets(part.column("text"), k)
                total += np.bincount((h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(total)).astype(np.int32)
                a, b = digests(h, offset)
                size = len(offset) - 1
                own = [pa.array(np.diff(offset)), pa.array(a), pa.array(b), pa.array(bitmaps(h, offset), pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("t"), *own, pa.nulls(size, pa.int32()), pa.nulls(size, pa.binary())], names)
        lists = np.split(total, SKETCH_PARTS)
        live = [i for i, x in enumerate(lists) if x.any()]
        gone = pa.nulls(len(live), pa.int64())
        yield pa.RecordBatch.from_arrays([*[gone] * 5, pa.nulls(len(live), pa.binary()), pa.array(live, pa.int32()), pa.array([lists[i].tobytes() for i in live], pa.binary())], names)

    hashed = df.select("id", F.xxhash64("text").alias("t"), "text")
    return hashed.mapInArrow(tidy(run), "id long, t long, n long, d1 long, d2 long, bits binary, part int, counts binary")


def sketch(profile: DataFrame) -> np.ndarray:
    """All tasks' counters added up; 2**20 numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                size = len(c) // 4 if len(c) == 4 * (1 << SKETCH_BITS) // SKETCH_PARTS else -1
                own = np.frombuffer(c, np.int32 if size > 0 else np.int64)
                total[p] = total.get(p, 0) + own.astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["part", "counts"])

    own = profile.where(F.col("part").isNotNull()).select("part", "counts")
    got = own.mapInArrow(tidy(run), "part int, counts binary").repartition(8, "part").mapInArrow(tidy(run), "part int, counts binary").collect()
    out = np.zeros((SKETCH_PARTS, (1 << SKETCH_BITS) // SKETCH_PARTS), np.int64)
    for r in got:
        out[r["part"]] += np.frombuffer(r["counts"], np.int64)
    return out.ravel()


def postings(df: DataFrame, order, k: int, percent: int) -> DataFrame:
    """(fragment, data): packed prefix n-grams, each as hash, class and set size. A task sends a class once for as long as it remembers it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        o, seen = order.value, set()
        for batch in batches:
            for part in chunks(batch, "text"):
                h, offset = sets(part.column("text"), k)
                n = np.diff(offset)
                cls = digests(h, offset)[0]
                fresh = np.zeros(len(n), bool)
                for i, (c, size) in enumerate(zip(cls.tolist(), n.tolist(), strict=True)):
                    if size and c not in seen:
                        seen.add(c)
                        fresh[i] = True
                if len(seen) > 200_000:
                    seen.clear()
                doc = np.repeat(np.arange(len(n)), n)
                keep = fresh[doc]
                h, doc = h[keep], doc[keep]
                key = o.key(h)
                at = np.lexsort((key, doc))
                h, doc, key = h[at], doc[at], key[at]
                size = np.where(fresh, n, 0)
                begin = np.cumsum(size) - size
                pos = np.arange(len(h)) - np.repeat(begin, size)
                prefix = n - -(-percent * n // 100) + 1
                use = pos < prefix[doc]
                h, doc = h[use], doc[use]
                frag = o.fragment(h, cls[doc])
                at = np.argsort(frag, kind="stable")
                data = np.stack([h[at], cls[doc[at]].view(np.uint64), n[doc[at]].astype(np.uint64)], 1)
                frag = frag[at]
                edge = np.flatnonzero(np.r_[True, frag[1:] != frag[:-1]]) if len(frag) else np.zeros(0, np.int64)
                stop = np.r_[edge[1:], len(frag)].astype(np.int64)
                # Columns apart: equal numbers lie side by side and compress.
                yield pa.RecordBatch.from_arrays([pa.array(frag[edge], pa.int64()), pa.array([data[i:j].T.tobytes() for i, j in zip(edge, stop, strict=False)], pa.binary())], ["fragment", "data"])

    return df.mapInArrow(tidy(run), "fragment long, data binary")


PAIRS = "a long, b long, na long, nb long, c long, star boolean, data binary"


def _pairs(first: np.ndarray, second: np.ndarray, data: np.ndarray, percent: int) -> np.ndarray:
    """Rows of pairs (places in data) that pass the size filter, as counted pairs
    (a, b, na, nb, count) with a < b."""
    cls = data[:, 1].view(np.int64)
    n = data[:, 2].astype(np.int64)
    swap = cls[first] > cls[second]
    first, second = np.where(swap, second, first), np.where(swap, first, second)
    na, nb = n[first], n[second]
    ok = (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & (cls[first] != cls[second])
    first, second = first[ok], second[ok]
    if not len(first):
        return np.zeros((0, 5), np.int64)
    order = np.lexsort((cls[second], cls[first]))
    first, second = first[order], second[order]
    a, b = cls[first], cls[second]
    new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    count = np.diff(np.r_[new, len(a)])
    return np.stack([a[new], b[new], n[first[new]], n[second[new]], count], 1)


def _all_pairs(begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of each run of `size` rows from `begin`."""
    row = np.repeat(begin, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    left = np.repeat(begin + size, size) - row - 1  # rows after this one in its run
    first = np.repeat(row, left)
    second = first + 1 + np.arange(left.sum()) - np.repeat(np.cumsum(left) - left, left)
    return first, second


def _batch(p: np.ndarray, star: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array(p[:, i]) for i in range(5)), pa.array(np.full(len(p), star)), pa.nulls(len(p), pa.binary())], ["a", "b", "na", "nb", "c", "star", "data"])


def _lists(data: np.ndarray, least: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """data sorted by n-gram and class without repeats, and the begin and size of lists of `least` or more."""
    data = data[np.lexsort((data[:, 1], data[:, 0]))]
    new = np.r_[True, (data[1:, 0] != data[:-1, 0]) | (data[1:, 1] != data[:-1, 1])] if len(data) else np.zeros(0, bool)
    data = data[new]
    begin = np.flatnonzero(np.r_[True, data[1:, 0] != data[:-1, 0]]) if len(data) else np.zeros(0, np.int64)
    size = np.diff(np.r_[begin, len(data)])
    return data, begin[size >= least], size[size >= least]


def fragment(batches: Iterator[pa.RecordBatch], percent: int, small: int) -> Iterator[pa.RecordBatch]:
    """Counts each fragment's overlaps; see step 3."""
    held: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for f, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held.setdefault(f, []).append(np.frombuffer(d, np.uint64).reshape(3, -1).T)
    for f in list(held):
        data, begin, size = _lists(np.concatenate(held.pop(f)), 2 if f >= 0 else 1)
        few = size <= (small if f >= 0 else 0)
        first, second = _all_pairs(begin[few], size[few])
        yield _batch(_pairs(first, second, data, percent), False)
        many, long = begin[~few], size[~few]
        if not len(many):
            continue
        row = np.repeat(many, long) + np.arange(long.sum()) - np.repeat(np.cumsum(long) - long, long)
        n = data[row, 2].astype(np.float64)
        band = np.floor(np.log(np.maximum(n, 1)) / np.log(100 / percent)).astype(np.int64)
        which = np.repeat(np.arange(len(many)), long)
        at = np.lexsort((data[row, 1].view(np.int64), band, which))
        row, band, which = row[at], band[at], which[at]
        lead = np.r_[True, (which[1:] != which[:-1]) | (band[1:] != band[:-1])]
        leader = row[np.flatnonzero(lead)[np.cumsum(lead) - 1]]
        yield _batch(_pairs(leader[~lead], row[~lead], data, percent), True)
        for i in range(0, len(many), 4096):
            rows = np.concatenate([np.arange(b, b + s) for b, s in zip(many[i : i + 4096], long[i : i + 4096], strict=True)])
            for j in range(0, len(rows), 100_000):
                none = pa.array([None], pa.int64())
                yield pa.RecordBatch.from_arrays([none] * 5 + [pa.array([None], pa.bool_()), pa.array([data[rows[j : j + 100_000]].T.tobytes()], pa.binary())], ["a", "b", "na", "nb", "c", "star", "data"])


def bound(na, nb, percent: int, top, up):
    """The least number of shared prefix n-grams of a pair that reaches the threshold. All n-grams of
    the prefix that ends first lie in the range that both prefixes cover, so each one unmatched is
    missing in the other set; which ends first is left open, so the larger set is taken."""
    return up(percent * (na + nb) / (100 + percent)) + 1 - up(percent * top(na, nb) / 100)


def possible(pairs: DataFrame, percent: int, stars: float = 0.5) -> DataFrame:
    """Sums the fragments' counts of each pair and drops pairs that can't reach the threshold. Pairs
    from long lists have incomplete counts here: they need `stars` of the count, and the pairs so
    lost are checked in step 6."""
    total = pairs.groupBy("a", "b").agg(F.max("na").alias("na"), F.max("nb").alias("nb"), F.sum("c").alias("c"), F.max("star").alias("star"))
    least = bound(F.col("na"), F.col("nb"), percent, F.greatest, F.ceil)
    return total.where(F.col("c") >= F.when(F.col("star"), least * stars).otherwise(least)).select("a", "b", "na", "nb", "c")


def sieve(df: DataFrame, key: Column, ids: DataFrame) -> DataFrame:
    """df with `hit`: false only where the key is certainly not in ids (one long column). A filter of
    2**24 bits, so at most 2**19 rows are broadcast; no row of df is shuffled."""
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << FILTER_BITS))
    own = ids.toDF("id").select(F.shiftright(bit(F.col("id")), 5).cast("int").alias("word"), (bit(F.col("id")) % 32).cast("int").alias("s"))
    table = own.groupBy("word").agg(F.expr("bit_or(shiftleft(cast(1 as bigint), s))").alias("b"))
    word, b = (next(n for n in (name + "_" * i for i in range(len(df.columns) + 1)) if n not in df.columns) for name in ("word", "b"))
    out = df.join(F.broadcast(table.toDF(word, b)), F.shiftright(bit(key), 5).cast("int") == F.col(word), "left")
    hit = F.coalesce(F.col(b).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (bit(key) % 32).cast("int"))) != 0, F.lit(False))
    return out.select(*[df[c] for c in df.columns], hit.alias("hit"))


def alike(pairs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, na, nb, ...) that their bitmaps leave possible, with d, the bits that differ.
    marks: (cls, bits) of every document."""
    names = pairs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            d = differing(batch.column("x").to_pylist(), batch.column("y").to_pylist())
            ok = d <= na + nb - 2 * need(na, nb, percent)
            own = pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(d)], [*names, "d"])
            yield own.filter(pa.array(ok))

    of = lambda side: sieve(marks, F.col("cls"), pairs.select(side)).where("hit").groupBy("cls").agg(F.max("bits"))
    both = pairs.join(of("a").toDF("a", "x"), "a").join(of("b").toDF("b", "y"), "b").select(*names, "x", "y")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema)
    return both.mapInArrow(tidy(run), f"{kinds}, d long")


def overlaps(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b) of the pairs of classes whose whole sets reach the threshold, by partial overlaps of
    fragments; a sieve tells the scan which documents are needed. nodes: (cls, rep)."""
    ids = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct().join(nodes, "cls").select("rep")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        border = np.arange(VERIFY_FRAGMENTS + 1).astype(np.float64) * (2.0**64 / VERIFY_FRAGMENTS)
        for batch in batches:
            for part in chunks(batch, "text"):
                h, offset = sets(part.column("text"), k)
                cls = digests(h, offset)[0]
                data = []
                for i, j in zip(offset, offset[1:], strict=False):
                    edge = i + np.searchsorted(h[i:j].astype(np.float64), border)
                    edge[-1] = j
                    data += [h[x:y].tobytes() for x, y in zip(edge, edge[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(cls, VERIFY_FRAGMENTS)), pa.array(np.tile(np.arange(VERIFY_FRAGMENTS, dtype=np.int32), len(cls))), pa.array(data, pa.binary())], ["cls", "f", "data"])

    needed = sieve(docs, F.col("id"), ids).where("hit").select("text")
    segments = needed.mapInArrow(tidy(cut), "cls long, f int, data binary").groupBy("cls", "f").agg(F.max("data").alias("data"))
    spread = pairs.select("a", "b", "na", "nb", F.explode(F.sequence(F.lit(0), F.lit(VERIFY_FRAGMENTS - 1))).alias("f"))
    both = spread.join(segments.toDF("a", "f", "x"), ["a", "f"]).join(segments.toDF("b", "f", "y"), ["b", "f"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = [len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in ("a", "b", "na", "nb")), pa.array(c, pa.int64())], ["a", "b", "na", "nb", "c"])

    partial = both.select("a", "b", "na", "nb", "x", "y").mapInArrow(tidy(count), "a long, b long, na long, nb long, c long")
    total = partial.groupBy("a", "b", "na", "nb").agg(F.sum("c").alias("c"))
    return total.where(100 * F.col("c") >= percent * (F.col("na") + F.col("nb") - F.col("c"))).select("a", "b")


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, root): the least id of the component of every id in at most FINISH links."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = up
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = find(u), find(v)
            if x != y:
                root[max(x, y)] = min(x, y)
    yield pa.RecordBatch.from_arrays([pa.array(list(root), pa.int64()), pa.array([find(x) for x in root], pa.int64())], ["id", "root"])


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, comp): the least id of the component of every id in links. While there are more than
    FINISH links, each round maps every node to the neighbour (or itself) that comes first in an
    order hashed anew, and contracts the links, of which a constant share goes each time. The last
    FINISH at most are solved in one task, which spares the many rounds over nearly empty tables."""
    edges = scratch.keep(links.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u <> v").distinct())
    where, step = None, 0
    while edges.count() > FINISH:
        step += 1
        ranked = lambda c, step=step: F.struct(F.xxhash64(c, F.lit(step)).alias("r"), F.col(c).alias("x"))
        both = edges.select(F.col("u").alias("id"), ranked("v").alias("m")).union(edges.select(F.col("v").alias("id"), ranked("u").alias("m")))
        to = scratch.keep(both.groupBy("id").agg(F.min("m").alias("m")).select("id", F.least(F.col("m"), ranked("id"))["x"].alias("to")))
        old = where
        moved = to.toDF("id", "root") if where is None else where.join(to.toDF("root", "to"), "root", "left").select("id", F.coalesce("to", "root").alias("root"))
        where = scratch.keep(moved)
        left = edges.join(to.toDF("u", "tu"), "u").join(to.toDF("v", "tv"), "v").where("tu <> tv")
        before, edges = edges, scratch.keep(left.select(F.least("tu", "tv").alias("u"), F.greatest("tu", "tv").alias("v")).distinct())
        scratch.drop(before, old, to)
    last = edges.coalesce(1).mapInArrow(tidy(_solve), "id long, root long")
    if where is None:
        return last.toDF("id", "comp")
    where = where.join(last.toDF("root", "to"), "root", "left").select("id", F.coalesce("to", "root").alias("root"))
    return where.join(where.groupBy("root").agg(F.min("id").alias("comp")), "root").select("id", "comp")


def joined(comp: DataFrame | None, links: DataFrame) -> DataFrame:
    """The components comp after more links: only links between different ones are worked on."""
    if comp is None:
        return scratch.keep(components(links))
    ends = links.join(comp.toDF("a", "ca"), "a", "left").join(comp.toDF("b", "cb"), "b", "left")
    up = scratch.keep(components(ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))))
    moved = comp.join(up.toDF("comp", "to"), "comp", "left").select("id", F.coalesce("to", "comp").alias("comp"))
    out = scratch.keep(moved.union(up.join(comp, "id", "left_anti").select("id", "comp")))
    scratch.drop(comp, up)
    return out


def verify(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, marks: DataFrame, comp: DataFrame | None, k: int, percent: int) -> DataFrame:
    """The components after the pairs are decided. First each class's pair with the most alike bitmaps;
    then, of the others, those whose classes are still in different components, as a pair inside one
    can't change them. So a group of near copies costs a pair for each member."""
    counted = scratch.keep(pairs)  # its size is then known, and a small table needs no shuffle of all bitmaps
    pairs = scratch.keep(alike(counted, marks, percent))
    scratch.drop(counted)
    nearest = F.struct((-F.col("d") / (F.col("na") + F.col("nb"))).alias("s"), F.col("a"))
    best = scratch.keep(pairs.groupBy("b").agg(F.max_by(F.struct("a", "na", "nb"), nearest).alias("p")).select("p.a", "b", "p.na", "p.nb"))
    comp = joined(comp, scratch.keep(overlaps(docs, best, nodes, k, percent)))
    of = lambda side, name: comp.toDF(side, name)
    left = pairs.join(best.select("a", "b"), ["a", "b"], "left_anti").join(of("a", "x"), "a", "left").join(of("b", "y"), "b", "left")
    left = scratch.keep(left.where(F.coalesce("x", "a") != F.coalesce("y", "b")).select("a", "b", "na", "nb"))
    if not left.isEmpty():
        second = scratch.keep(overlaps(docs, left, nodes, k, percent))
        if not second.isEmpty():
            comp = joined(comp, second)
    scratch.drop(pairs, best, left)
    return comp


def members(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 75, small: int = SMALL) -> DataFrame:
    """(id, t, n, c, component_id): every row with a key, the hash of its text, its set size, its
    component (null if it is empty) and the least key in there; see the module's text."""
    spark = df.sparkSession
    docs = _rows(df, key, text)
    profile = scratch.keep(profiles(docs, k))
    own = profile.where(F.col("part").isNull()).drop("part", "counts")
    reps = own.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("id").alias("rep"))
    sizes = reps.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    fragments = max(2 * spark.sparkContext.defaultParallelism, int(sizes * (1 - percent / 100)) // FRAGMENT + 1)
    order = spark.sparkContext.broadcast(Order(sketch(profile), fragments, HEAVY))
    nodes = reps.groupBy(F.col("d1").alias("cls")).agg(F.min("rep").alias("rep"))
    marks = own.where("n > 0").select(F.col("d1").alias("cls"), "bits")
    found = postings(docs, order, k, percent).repartition(fragments, "fragment").mapInArrow(tidy(lambda it: fragment(it, percent, small)), PAIRS)
    found = scratch.keep(found)
    pairs = found.where(F.col("a").isNotNull()).drop("data")
    comp = verify(docs, possible(pairs, percent), nodes, marks, None, k, percent)
    # Written once: its readers need no Python worker beside their own.
    long = scratch.keep(found.where(F.col("data").isNotNull()).select("data").mapInArrow(tidy(_unpack), "h long, cls long, n long"))
    for salt in (*range(1, ROUNDS + 1), None):
        met = scratch.keep(meetings(long, pairs, comp, percent, fragments, salt))
        if not met.isEmpty():
            comp = verify(docs, possible(met, percent), nodes, marks, comp, k, percent)
        scratch.drop(met)
    scratch.drop(found, long)
    final = reps.join(comp.toDF("d1", "c"), "d1", "left").select("n", "d1", "d2", "rep", F.coalesce("c", "d1").alias("c"))
    final = final.join(final.groupBy("c").agg(F.min("rep").alias("least")), "c").select("n", "d1", "d2", "c", "least")
    return own.join(final, ["n", "d1", "d2"], "left").select("id", "t", "n", "c", F.coalesce("least", "id").alias("component_id"))


def join(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 75, small: int = SMALL) -> DataFrame:
    """(key, n_shingles, component_id) for every row; see the module's text."""
    out = members(df, key, text, k, percent, small).select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id")
    lost = df.where(F.col(key).cast("long").isNull())
    gone = lost.select(F.lit(None).cast("long").alias(key), F.lit(0).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return out.unionByName(gone)


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for d in batch.column(0).to_pylist():
            x = np.frombuffer(d, np.int64).reshape(3, -1)
            yield pa.RecordBatch.from_arrays([pa.array(x[i]) for i in range(3)], ["h", "cls", "n"])


def meetings(rows: DataFrame, pairs: DataFrame, comp: DataFrame, percent: int, fragments: int, salt: int | None) -> DataFrame:
    """Counted pairs of classes in different components that meet in the long lists (rows: h, cls, n). With a salt, each
    list gives the pairs of its other classes with LEADERS classes of its largest component: those in
    the most lists (an original is in more lists than its altered copies), then by a hash; without, all
    pairs of different components, with their counts from the short lists too."""
    # At class level first, so that the lists' rows are joined once.
    sizes = comp.groupBy("comp").agg(F.count("*").alias("size"))
    named = rows.groupBy("cls").agg(F.count("*").alias("met")).join(comp.toDF("cls", "comp"), "cls", "left").select("cls", F.coalesce("comp", "cls").alias("comp"), "met")
    named = scratch.keep(named.join(sizes, "comp", "left").select("cls", "comp", "met", F.coalesce("size", F.lit(1).cast("long")).alias("size")))
    rows = rows.join(named, "cls").select("h", "cls", "n", "comp", "met", "size")
    # Of each list: its largest component there, whether it has several, and its rows.
    in_list = rows.groupBy("h", "comp").agg(F.count("*").alias("c"), F.max("size").alias("size"))
    lists = in_list.groupBy("h").agg(F.max(F.struct("c", "size", "comp")).alias("top"), F.count("*").alias("comps"), F.sum("c").alias("rows"))
    lists = scratch.keep(lists.where("comps > 1").select("h", F.col("top.c").alias("c"), F.col("top.comp").alias("top"), "rows"))
    out = _leaders(rows, lists, percent, salt) if salt is not None else _partners(rows, lists, pairs, comp, sizes, percent, fragments)
    return out


def _leaders(rows: DataFrame, lists: DataFrame, percent: int, salt: int) -> DataFrame:
    inside = (F.col("c") == 1) | (F.col("comp") == F.col("top"))
    mixed = rows.join(lists.drop("rows"), "h")
    first = Window.partitionBy("h").orderBy(F.desc("met"), F.xxhash64("cls", F.lit(salt)), "cls")
    lead = mixed.where(inside).withColumn("r", F.row_number().over(first)).where(F.col("r") <= LEADERS).select("h", F.col("cls").alias("lead"), F.col("n").alias("nl"))
    lead = lead.groupBy("h").agg(F.collect_list(F.struct("lead", "nl")).alias("leads"))  # LEADERS at most
    lead = lead.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    others = mixed.where((F.col("c") == 1) | (F.col("comp") != F.col("top"))).select("h", "cls", "n", F.pmod(F.xxhash64("cls"), F.lit(SALTS)).cast("int").alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leads = batch.column("leads").combine_chunks() if isinstance(batch.column("leads"), pa.ChunkedArray) else batch.column("leads")
            flat = leads.flatten()
            size = np.diff(leads.offsets.to_numpy())
            own = [np.repeat(batch.column(c).to_numpy(), size) for c in ("cls", "n")]
            far = [flat.field(c).to_numpy() for c in ("lead", "nl")]
            m = len(flat)
            both = np.stack([np.zeros(2 * m, np.int64), np.r_[own[0], far[0]], np.r_[own[1], far[1]]], 1).view(np.uint64)
            yield _batch(_pairs(np.arange(m), np.arange(m, 2 * m), both, percent), True)

    return others.join(lead, ["h", "part"]).select("cls", "n", "leads").mapInArrow(tidy(run), PAIRS).drop("data")


def _partners(rows: DataFrame, lists: DataFrame, pairs: DataFrame, comp: DataFrame, sizes: DataFrame, percent: int, fragments: int) -> DataFrame:
    most = lists.agg(F.coalesce(F.max("rows"), F.lit(0))).first()[0]  # no list has more classes
    blocks = int(most) // 200_000 + 1
    kind = "x long, nx long, block long, y binary, ny binary"
    # A list of more than BLOCK rows is cut into blocks by class; each two blocks meet in a cell of their own.
    cut = F.floor(F.col("rows") / BLOCK) + 1
    mine = F.pmod(F.xxhash64("cls"), F.col("cut"))
    cell = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("cut") - 1), lambda j: F.struct(F.least(F.col("own"), j).alias("i"), F.greatest(F.col("own"), j).alias("j"))))
    dealt = rows.join(lists.select("h", cut.alias("cut")), "h").withColumn("own", mine).select("h", "cls", "n", "comp", "size", "own", cell.alias("at"))
    dealt = dealt.select("h", F.col("at.i").alias("i"), F.col("at.j").alias("j"), "size", "comp", "cls", "n", "own")

    def partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each row the classes of larger components in its cell, packed, in blocks by class; in a
        cell of two blocks only classes of the other block."""
        held = [np.stack([b.column(i).to_numpy() for i in range(8)], 1) for b in batches]
        data = np.concatenate(held) if held else np.zeros((0, 8), np.int64)
        data = data[np.lexsort([data[:, i] for i in (5, 4, 3, 2, 1, 0)])]
        new = (data[1:] != data[:-1])[:, :3].any(1)
        inner = np.r_[True, new | (data[1:, 4] != data[:-1, 4])][: len(data)]
        begin = np.flatnonzero(np.r_[True, new])[: len(data)]
        stop = np.r_[begin[1:], len(data)][: len(begin)]
        after = np.r_[np.flatnonzero(inner)[1:], len(data)][np.cumsum(inner) - 1]
        last = np.repeat(stop, stop - begin) if len(data) else after
        out: list[list] = [[], [], [], [], []]

        def batch() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, [pa.int64()] * 3 + [pa.binary()] * 2, strict=True)], ["x", "nx", "block", "y", "ny"])
            for c in out:
                c.clear()
            return got

        weight = 0
        for i in np.flatnonzero(after < last).tolist():
            y, ny = data[after[i] : last[i], 5], data[after[i] : last[i], 6]
            n = data[i, 6]
            fits = 100 * np.minimum(n, ny) >= percent * np.maximum(n, ny)
            if data[i, 1] != data[i, 2]:
                fits &= data[after[i] : last[i], 7] != data[i, 7]
            y, ny = y[fits], ny[fits]
            for block in np.unique(y % blocks).tolist() if blocks > 1 else [0]:
                own = y % blocks == block if blocks > 1 else slice(None)
                if len(y[own]):
                    for c, v in zip(out, (data[i, 5], n, block, y[own].tobytes(), ny[own].tobytes()), strict=True):
                        c.append(v)
                    weight += len(y)
            if weight > 500_000:
                yield batch()
                weight = 0
        yield batch()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        for b in batches:
            for x, nx, block, y, ny in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.setdefault((x, nx, block), []).append((y, ny))
        for (x, nx, _), own in held.items():
            y = np.frombuffer(b"".join(o[0] for o in own), np.int64)
            y, at, c = np.unique(y, return_index=True, return_counts=True)
            ny = np.frombuffer(b"".join(o[1] for o in own), np.int64)[at]
            ok = c >= bound(nx, ny, percent, np.maximum, np.ceil)
            y, ny, c = y[ok], ny[ok], c[ok]
            swap = y < x
            me, mine = np.full(len(y), x), np.full(len(y), nx)
            yield _batch(np.stack([np.where(swap, y, me), np.where(swap, me, y), np.where(swap, ny, mine), np.where(swap, mine, ny), c], 1), False)

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y, ny, c = (b.column(i).to_numpy() for i in (3, 4, 5))
            packed = [[np.repeat(v[i], c[i]).tobytes() for i in range(len(c))] for v in (y, ny)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), *(pa.array(v, pa.binary()) for v in packed)], ["x", "nx", "block", "y", "ny"])

    sent = dealt.repartition(fragments, "h", "i", "j").mapInArrow(tidy(partners), kind)
    # The same pairs' counts from the short lists, so that the sums are complete. Only pairs of classes
    # that met in a mixed list can have a part there.
    full = comp.join(sizes, "comp").select(F.col("id").alias("cls"), F.struct("size", "comp").alias("at"))
    alone = lambda c: F.struct(F.lit(1).cast("long").alias("size"), F.col(c).alias("comp"))
    met = pairs.where(~F.col("star")).join(full.toDF("a", "at_a"), "a", "left").join(full.toDF("b", "at_b"), "b", "left")
    met = met.withColumn("at_a", F.coalesce("at_a", alone("a"))).withColumn("at_b", F.coalesce("at_b", alone("b"))).where("at_a.comp <> at_b.comp")
    one = F.col("at_a") < F.col("at_b")
    of = lambda p, q: F.when(one, F.col(p)).otherwise(F.col(q))
    met = met.select(of("a", "b").alias("x"), of("na", "nb").alias("nx"), of("b", "a").alias("y"), of("nb", "na").alias("ny"), "c")
    met = met.select("x", "nx", F.pmod("y", F.lit(blocks)).alias("block"), "y", "ny", "c").mapInArrow(tidy(short), kind)
    return sent.unionByName(met).repartition(fragments, "x", "block").mapInArrow(tidy(counted), PAIRS).drop("data")


def one_each(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 75) -> DataFrame:
    """df without near duplicates: of each component its first row (by key, then by a hash of the text)
    stays, and of equal rows one. Rows with a null key stay. Decided per row: of rows that repeat a key,
    a text that links with nothing stays whatever its namesakes do."""
    got = scratch.keep(members(df, key, text, k, percent))
    first = got.where(F.col("c").isNotNull()).groupBy("c").agg(F.min(F.struct("id", "t")).alias("w"))
    stays = got.join(first, "c", "left").select("id", "t", (F.col("c").isNull() | (F.struct("id", "t") == F.col("w"))).alias("stays"))
    stays = scratch.keep(stays.groupBy("id").agg(F.count("*").alias("rows"), F.bool_or("stays").alias("any")).join(stays.where("stays").distinct(), "id", "left"))
    at, mark = (next(n for n in (name + "_" * i for i in range(len(df.columns) + 1)) if n not in df.columns) for name in ("key", "mark"))
    long = F.col(key).cast("long")
    losers = stays.where("rows = 1 AND NOT any").select(F.col("id").alias(at))
    # Only rows that the sieve can't clear are joined, so the text of most documents is never shuffled.
    flagged = sieve(df, long, losers)
    out = flagged.where("NOT hit").select(df.columns).unionByName(flagged.where("hit").select(df.columns).join(losers, long == F.col(at), "left_anti"))
    twice = stays.where("rows > 1").select(F.col("id").alias(at), F.col("t").alias(mark))
    if twice.isEmpty():
        return out
    keys = twice.select(at).distinct()
    text_hash = F.xxhash64(F.col(text).cast("string"))
    many = out.join(twice, (long == F.col(at)) & (text_hash == F.col(mark)), "left_semi")
    kept = many.withColumn(mark, text_hash).dropDuplicates([key, mark]).select(df.columns)
    return out.join(keys, long == F.col(at), "left_anti").select(df.columns).unionByName(kept)
