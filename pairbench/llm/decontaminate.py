"""Benchmark decontamination by SimHash of item-sized windows and multi-index Hamming blocks.

A document window with as many words as an item, slid word by word, gets a 64-bit SimHash of its
word shingles, each counted as often as it occurs. Fingerprints are cut into four 16-bit blocks. Two
fingerprints within RADIUS = 19 bits agree in some block up to 4 bits, so tables that hold, for each
block, every value within 4 bits of an item's value return all items within the radius. Pairs within
it are then verified by the exact weighted similarity of their shingle multisets (sum of minima over
sum of maxima). Windows that share no shingle with an item of their size have similarity 0 and get
no fingerprint. Where a window or an item repeats a shingle, a similarity of 0.75 can leave more
differing bits than the radius: such pairs go to the exact check wherever they share a shingle.

Items with fewer than k words are one shingle of their own length. A document shorter than an item is
one window for it. Null and empty texts and items match nothing. Keys may repeat: rows with the same
key and item are reported once per row. Texts are scanned whole. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pairbench.llm.textkit import Words, chunks, mix, select_rows, shingles, tidy, words

RADIUS = 19
BLOCKS, BLOCK_BITS = 4, 16
FILTER_BITS = 22
#: Windows, and pairs to verify, that are in memory at once.
WINDOWS = 1 << 14
#: Items in one scan of the documents; more items take more scans.
ITEMS = 2048
#: Bytes of their texts.
ITEM_BYTES = 16 << 20


def _near(radius: int) -> np.ndarray:
    """All 16-bit values with up to `radius` bits set."""
    return np.array([sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(BLOCK_BITS), r)], np.int64)


def _fingerprint(sums: np.ndarray) -> np.ndarray:
    """uint64 fingerprints of n x 64 sums of +1 and -1; a bit is set where its sum is positive."""
    return np.packbits(sums > 0, axis=1, bitorder="little").view(np.uint64).ravel()


def _bits(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32) * 2 - 1


def _grams(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles that begin at each word, for documents with k words or more, and
    the index of that word."""
    h, offset = shingles(w, k)
    full = w.count >= k
    n = np.where(full, w.count - k + 1, 0)
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return h[np.repeat(offset[:-1], n) + inner], np.repeat(w.offset[:-1], n) + inner


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All of first[i], first[i] + 1, ... (n[i] of them), end to end."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


class Benchmark:
    """The items of one scan, by shingle size k (their number of words, if that is less)."""

    def __init__(self, ids: list, texts: list[str], k: int = 5, kind: pa.DataType | None = None):
        w = words(pa.array(texts, pa.string()))
        keep = np.flatnonzero(w.count > 0)
        self.kind = kind or pa.int64()
        self.ids = pa.array([ids[i] for i in keep], self.kind).to_numpy(zero_copy_only=False)
        self.size = w.count[keep]
        self.by_k = {}
        for kk in np.unique(np.minimum(self.size, k)).tolist():
            own = np.flatnonzero(np.minimum(self.size, k) == kk)
            h, offset = shingles(w, kk)
            parts = [h[offset[keep[i]] : offset[keep[i] + 1]] for i in own]
            self.by_k[kk] = _Items(kk, own, self.size[own], parts)


class _Items:
    def __init__(self, k: int, index: np.ndarray, size: np.ndarray, parts: list[np.ndarray]):
        self.k, self.index, self.size = k, index, size
        item = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        every = np.concatenate(parts)
        self.finger = _fingerprint(np.stack([_bits(p).sum(0) for p in parts]))
        # Shingle -> items that have it.
        pair = np.unique(np.stack([every, item.astype(np.uint64)], 1), axis=0)
        self.shingle, start = np.unique(pair[:, 0], return_index=True)
        self.of = pair[:, 1].astype(np.int64)
        self.of_at = np.r_[start, len(pair)]
        self.repeats = np.bincount(pair[:, 1].astype(np.int64), minlength=len(parts)) < [len(p) for p in parts]
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[(self.shingle >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        # (Item, shingle) -> count, under one mixed key.
        key, count = np.unique(self.key(item, every), return_counts=True)
        self.counted, self.count = key, count
        self.near = []
        mask, flips = (1 << BLOCK_BITS) - 1, _near(RADIUS // BLOCKS)
        for b in range(BLOCKS):
            value = ((self.finger >> np.uint64(b * BLOCK_BITS)) & np.uint64(mask)).astype(np.int64)
            at = (value[:, None] ^ flips[None, :]).ravel()
            who = np.repeat(np.arange(len(parts)), len(flips))
            order = np.argsort(at, kind="stable")
            self.near.append((np.searchsorted(at[order], np.arange(mask + 2)), who[order].astype(np.int32)))

    @staticmethod
    def key(item: np.ndarray, shingle: np.ndarray) -> np.ndarray:
        return mix(shingle ^ mix(item.astype(np.uint64) + np.uint64(1)))

    def windows(self, w: Words, h: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, ...]:
        """(first shingle, number of shingles, size class, document) of every window that shares a
        shingle with an item of its size, by first shingle; and the (window, item) pairs that go to the
        exact check by a shared shingle, because the window or the item repeats a shingle."""
        hit = np.flatnonzero(self.filter[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.shingle, h[hit]), len(self.shingle) - 1)
        ok = self.shingle[place] == h[hit]
        hit, place = hit[ok], place[ok]
        n = self.of_at[place + 1] - self.of_at[place]
        item = self.of[_ranges(self.of_at[place], n)]
        by_item, of_size = np.repeat(hit, n), self.size[item]
        # Windows around the hits of one size: hits are in order, so what a hit before has is left out.
        span = int(self.size.max()) + 1
        both = np.unique(of_size * (len(h) + 1) + by_item)
        size, pos = both // (len(h) + 1), both % (len(h) + 1)
        low, high, grams, doc = self._around(w, word, pos, size)
        low = np.maximum(low, np.where(np.r_[False, size[1:] == size[:-1]], np.r_[-1, high[:-1]] + 1, 0)) if len(low) else low
        n = np.maximum(high - low + 1, 0)
        start = _ranges(low, n)
        size, grams, doc = np.repeat(size, n), np.repeat(grams, n), np.repeat(doc, n)
        code = start * span + size
        order = np.argsort(code, kind="stable")
        start, size, grams, doc, code = start[order], size[order], grams[order], doc[order], code[order]
        # The last place, up to each shingle, at which a shingle stood that came again by then.
        last = np.full(len(h), -1)
        if len(hit):
            same = np.argsort(h, kind="stable")
            again = np.flatnonzero(h[same[1:]] == h[same[:-1]])
            last[same[again + 1]] = same[again]
            last = np.maximum.accumulate(last)
        low, high, g, _ = self._around(w, word, by_item, of_size)
        some = np.flatnonzero(self.repeats[item] | (last[np.minimum(high + g, len(h)) - 1] >= low))
        direct = []
        for i in range(0, len(some), 1 << 12):
            part = some[i : i + (1 << 12)]
            n = high[part] - low[part] + 1
            begin, who, own = _ranges(low[part], n), np.repeat(item[part], n), np.repeat(part, n)
            ok = self.repeats[who] | (last[begin + g[own] - 1] >= begin)
            at = np.searchsorted(code, begin[ok] * span + of_size[own[ok]])
            direct.append(np.unique(at * len(self.size) + who[ok]))
        return start, grams, size, doc, np.unique(np.concatenate([np.zeros(0, np.int64), *direct]))

    def _around(self, w: Words, word: np.ndarray, pos: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """(first and last start, number of shingles, document) of the windows of `size` words on a shingle."""
        doc = np.searchsorted(w.offset, word[pos], side="right") - 1
        first = np.searchsorted(word, w.offset[doc])  # the document's first shingle
        last = first + w.count[doc] - self.k
        grams = np.minimum(size, w.count[doc]) - self.k + 1
        return np.maximum(pos - grams + 1, first), np.minimum(pos, last - grams + 1), grams, doc

    def _candidates(self, h: np.ndarray, start: np.ndarray, grams: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Pairs (window * items + item) of one size whose fingerprints differ in up to RADIUS bits."""
        # Fingerprints from running sums over the shingles that some window needs.
        base, end = int(start.min()), int((start + grams).max())
        need = np.zeros(end - base + 1, np.int64)
        np.add.at(need, start - base, 1)
        np.add.at(need, start + grams - base, -1)
        used = np.flatnonzero(np.cumsum(need)[:-1] > 0)
        total = np.zeros((len(used) + 1, 64), np.int32)
        np.cumsum(_bits(h[base + used]), axis=0, out=total[1:])
        at = np.searchsorted(used, start - base)
        finger = _fingerprint(total[at + grams] - total[at])
        found = []
        for b, (edge, who) in enumerate(self.near):
            value = ((finger >> np.uint64(b * BLOCK_BITS)) & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.int64)
            n = edge[value + 1] - edge[value]
            item = who[_ranges(edge[value], n)].astype(np.int64)
            window = np.repeat(np.arange(len(start)), n)
            ok = (self.size[item] == size[window]) & (np.bitwise_count(self.finger[item] ^ finger[window]) <= RADIUS)
            found.append(window[ok] * len(self.size) + item[ok])
        return np.unique(np.concatenate(found))

    def search(self, w: Words, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, item, similarity, first word in the document, words) of the best window of each pair."""
        h, word = _grams(w, self.k)
        start, grams, size, doc, direct = self.windows(w, h, word)
        got = []
        for i in range(0, len(start), WINDOWS):
            part = slice(i, i + WINDOWS)
            near = self._candidates(h, start[part], grams[part], size[part]) + i * len(self.size)
            of = direct[np.searchsorted(direct, i * len(self.size)) : np.searchsorted(direct, (i + WINDOWS) * len(self.size))]
            pair = np.union1d(near, of)
            # Verified some at a time, so that memory does not grow with the candidates.
            for j in range(0, len(pair), WINDOWS):
                got.append(self._verify(h, start, grams, pair[j : j + WINDOWS], threshold))
        if not got:
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(0), none, none
        window, item, similarity = (np.concatenate(x) for x in zip(*got, strict=True))
        order = np.lexsort((start[window], -similarity, item, doc[window]))
        window, item, similarity = window[order], item[order], similarity[order]
        d = doc[window]
        best = np.r_[True, (d[1:] != d[:-1]) | (item[1:] != item[:-1])] if len(d) else np.zeros(0, bool)
        window, item, similarity, d = window[best], item[best], similarity[best], d[best]
        return d, self.index[item], similarity, word[start[window]] - w.offset[d], grams[window] + self.k - 1

    def _verify(self, h: np.ndarray, start: np.ndarray, grams: np.ndarray, pair: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, similarity) of the pairs whose multisets have `threshold` similarity or more."""
        window, item = pair // len(self.size), pair % len(self.size)
        n = grams[window]
        who = np.repeat(np.arange(len(pair)), n)
        inner = h[_ranges(start[window], n)]
        order = np.lexsort((inner, who))
        who, inner = who[order], inner[order]
        new = np.flatnonzero(np.r_[True, (who[1:] != who[:-1]) | (inner[1:] != inner[:-1])])
        count = np.diff(np.r_[new, len(who)])
        who, key = who[new], self.key(item[who[new]], inner[new])
        place = np.minimum(np.searchsorted(self.counted, key), len(self.counted) - 1)
        both = np.where(self.counted[place] == key, np.minimum(self.count[place], count), 0)
        both = np.bincount(who, both, len(pair))
        similarity = both / (n + (self.size[item] - self.k + 1) - both)
        ok = similarity >= threshold
        return window[ok], item[ok], similarity[ok]


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", threshold: float = 0.75, k: int = 5) -> DataFrame:
    """(key, item_id, similarity, first_word, n_words): every document and item with a window of
    `threshold` similarity or more, by its most similar window (of equals the first). One narrow
    stage for each ITEMS items or ITEM_BYTES of them; the items of a scan are broadcast, so that what is
    broadcast is bounded whatever the benchmark's size."""
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, item_id {items.schema[item].dataType.simpleString()}, similarity double, first_word long, n_words long"
    rows = docs.select(F.col(key), F.col(text).cast("string").alias("_text"))
    out = None
    for shared in _scans(items, item, item_text):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            bench = Benchmark(*shared.value[:2], k, shared.value[2])
            for batch in batches:
                for part in chunks(batch, "_text"):
                    w = words(part.column("_text"))
                    for group in bench.by_k.values():
                        d, i, similarity, first, n = group.search(w, threshold)
                        if len(d):
                            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(d)), pa.array(bench.ids[i], bench.kind), pa.array(similarity), pa.array(first), pa.array(n)], [key, "item_id", "similarity", "first_word", "n_words"])

        found = rows.mapInArrow(tidy(run), schema)
        out = found if out is None else out.unionByName(found)
    return out


def _scans(items: DataFrame, item: str, item_text: str) -> list[Broadcast]:
    """The items with an id of any type and a text, broadcast in groups of about ITEMS / 2 and ITEM_BYTES / 2
    by a hash."""
    kind = to_arrow_type(items.schema[item].dataType)
    good = items.select(F.col(item).alias("i"), F.col(item_text).cast("string").alias("t")).where(F.col("i").isNotNull() & F.col("t").isNotNull())
    n, size = good.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()
    scans = max(1, -(-n // (ITEMS // 2)), -(-size // (ITEM_BYTES // 2)))
    out = []
    for s in range(scans):
        own = good if scans == 1 else good.where(F.pmod(F.xxhash64("i", "t"), F.lit(scans)) == s)
        got = sorted((r["i"], r["t"]) for r in own.collect())
        out.append(items.sparkSession.sparkContext.broadcast(([x[0] for x in got], [x[1] for x in got], kind)))
    return out


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", threshold: float = 0.75, k: int = 5) -> DataFrame:
    """The rows of docs that no item contaminates, with all their columns."""
    for shared in _scans(items, item, item_text):

        def keep(texts: pa.Array, shared=shared, held={}) -> np.ndarray:  # noqa: B006
            bench = held.get(0) or held.setdefault(0, Benchmark(*shared.value[:2], k, shared.value[2]))
            w = words(texts)
            ok = np.ones(w.n_docs, bool)
            for group in bench.by_k.values():
                ok[group.search(w, threshold)[0]] = False
            return ok

        docs = select_rows(docs, text, keep)
    return docs
