"""Removal of repeated passages by suffix sorting in two stages.

A byte goes when it is covered by a string of WIDTH bytes that also starts at a smaller (key, start)
anywhere in the corpus. Strings are those of the input, and none crosses documents.

Equal strings have to meet in one task, so the corpus is dealt by content. Each window of WIDTH bytes
has an anchor, the part of GRAM bytes in it with the least hash. Neighbouring windows share anchors:
each run of them is one text of at most WIDTH + RUN - 1 bytes, about one for 32 bytes.

1. Documents are packed into blocks, written once, bucketed by block in the shared folder, so that no
   later step shuffles them again. A block has the hashes of its anchors, each once.
2. Hashes are dealt by range and counted. Only those that occur twice or more go back to their blocks.
3. Blocks name the texts around these anchors by hashes, each once, with their least (key, start).
   Where equal texts meet, all but the eldest are covered whole.
4. Anchors around which different texts stand get these texts, each from the block that has the
   eldest. They meet in one task, which builds a suffix array over them: it sorts directly the
   suffixes that are smaller than their successors, induces the rest by scanning the buckets of first
   bytes, and takes the common prefixes of neighbours. Where WIDTH bytes agree, all but the least
   (key, start) are covered. (Two windows of one anchor are never equal: it stands at other places
   in them.)
5. Blocks get the answers to their texts, cover bytes, and hash what is left.

An anchor around which too many different texts stand (a frequent line) would be too much for one
task; its windows are dealt one by one by all their bytes instead, and go the same way.

A null text is empty; texts under WIDTH bytes stay whole; texts of any length are treated whole. A
null key comes before all others. Rows that share a key are one document's versions: a string is
repeated if a smaller (key, start) has it, whichever row it stands in, so equal rows have equal
results. An empty table gives an empty result, and extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairbench.llm import scratch
from pairbench.llm.textkit import mix, tidy

WIDTH, GRAM = 100, 37
RUN = WIDTH - GRAM + 1  # windows of one anchor at most: their marks fit into a long
BLOCK_BYTES = 4 << 20
PIECE = 1 << 18  # windows worked on at once; the places of their parts fit into 20 bits
PART = 1 << 20  # hashes counted in one task
SOME = 8192  # anchors of a block in one row
CROWD = 20_000  # texts of one anchor, each counted once a block, up to which they go to one task
BATCH_BYTES = 2 << 20
_BASES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
_LOW = np.uint64((1 << 20) - 1)


# ---- suffix sorting


def words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, the first byte highest; zeros behind the end."""
    out = np.zeros(len(text) + WIDTH + 16, np.uint64)
    out[: len(text)] = text
    for n in (1, 2, 4):
        out[:-n] = (out[:-n] << np.uint64(8 * n)) | out[n:]
    return out


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Whether the suffix at each place comes before its successor. Behind the text stands an end that
    is smaller than all bytes."""
    n = len(text)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1])
    step[-1:] = -1
    place = np.where(step != 0, np.arange(n), n)
    following = np.minimum.accumulate(place[::-1])[::-1]
    return step[following] > 0


def direct(place: np.ndarray, word: np.ndarray, depth: int) -> np.ndarray:
    """Places sorted by the `depth` bytes that follow: eight at a time, and only where still equal."""
    order = np.argsort(word[place], kind="stable")
    out = place[order]
    fresh = np.ones(len(out), bool)
    fresh[1:] = word[out[1:]] != word[out[:-1]]
    for at in range(8, depth, 8):
        tied = ~fresh
        tied[:-1] |= ~fresh[1:]
        live = np.flatnonzero(tied)
        if not len(live):
            break
        group, own = np.cumsum(fresh)[live], out[live]
        key = word[own + at]
        order = np.lexsort((key, group))
        own, key = own[order], key[order]
        out[live] = own
        fresh[live[1:]] |= (key[1:] != key[:-1]) & (np.diff(live) == 1)
    return out


def two_stage(text: np.ndarray, wanted: np.ndarray, depth: int = WIDTH) -> np.ndarray:
    """The wanted places of text, sorted by the `depth` bytes from there on (ties in any order)."""
    n, up, word = len(text), smaller_than_next(text), words(text)
    # A suffix is induced from its successor, so each run of wanted ones goes on to one that is sorted directly.
    following = np.minimum.accumulate(np.where(up, np.arange(n), n)[::-1])[::-1]
    last = np.flatnonzero(wanted & ~np.r_[wanted[1:], False])
    edge = np.zeros(n + 2, np.int64)
    np.add.at(edge, last, 1)
    np.add.at(edge, following[last] + 1, -1)
    used = np.zeros(n + 1, bool)
    used[:n] = wanted
    used |= np.cumsum(edge)[: n + 1] > 0
    sorted_up = direct(np.flatnonzero(used[:n] & up), word, depth + 8)
    cut = np.searchsorted(text[sorted_up], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []

    def induce(scanned: np.ndarray, byte: int) -> np.ndarray:
        """Deals the predecessors of scanned suffixes to their buckets; those of the same bucket are returned."""
        before = scanned[scanned > 0] - 1
        before = before[used[before] & ~up[before]]
        first = text[before]
        order = np.argsort(first, kind="stable")
        part = before[order]
        edges = np.flatnonzero(np.diff(first[order])) + 1
        here = part[:0]
        for chunk in np.split(part, edges):
            if len(chunk):
                if text[chunk[0]] == byte:
                    here = chunk
                else:
                    waiting[text[chunk[0]]].append(chunk)
        return here

    induce(np.array([n]) if used[n] else np.zeros(0, np.int64), -1)
    for byte in range(256):
        scanned = np.concatenate(waiting[byte]) if waiting[byte] else np.zeros(0, np.int64)
        waiting[byte] = []
        while len(scanned):
            out.append(scanned)
            scanned = induce(scanned, byte)
        scanned = sorted_up[cut[byte] : cut[byte + 1]]
        if len(scanned):
            out.append(scanned)
            induce(scanned, byte)
    every = np.concatenate(out) if out else np.zeros(0, np.int64)
    return every[wanted[every]]


def common_prefixes(word: np.ndarray, order: np.ndarray, most: int = WIDTH) -> np.ndarray:
    """The bytes that each place shares with the place before it in order, `most` at most; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    for at in range(0, most, 8):
        differ = word[order[live] + at] ^ word[order[live - 1] + at]
        out[live] += 8
        for k in range(8):  # less the bytes from the first differing one on
            out[live] -= (differ >> np.uint64(8 * k)) != 0
        live = live[differ == 0]
    return np.minimum(out, most)


def covered(texts: pa.Array, keys: pa.Array, start: np.ndarray) -> np.ndarray:
    """For each of these texts, standing at (key, start), a long whose bit i says that its window i also stands
    at a smaller (key, start) in these texts."""
    text, size = _bytes(texts)
    at = np.r_[0, np.cumsum(size)]
    windows = size - WIDTH + 1
    inside = np.arange(len(text)) - np.repeat(at[:-1], size)
    wanted = inside < np.repeat(windows, size)
    order = two_stage(text, wanted)
    run = np.cumsum(common_prefixes(words(text), order) < WIDTH)
    many = np.bincount(run, minlength=1)[run] > 1
    order, run = order[many], run[many]
    own = np.searchsorted(at, order, side="right") - 1
    key, begin = ranks(keys)[own], start[own] + inside[order]
    old = np.lexsort((begin, key, run))
    order, own, run, key, begin = order[old], own[old], run[old], key[old], begin[old]
    first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]]) if len(run) else run
    least = np.repeat(first, np.diff(np.r_[first, len(run)]))
    late = (key != key[least]) | (begin != begin[least])
    out = np.zeros(len(size), np.int64)
    np.bitwise_or.at(out, own[late], np.left_shift(np.int64(1), inside[order[late]]))
    return out


# ---- anchors


@lru_cache(maxsize=2)
def _powers(which: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base, and of its inverse, modulo 2**64."""
    out = []
    for base in (int(_BASES[which]), pow(int(_BASES[which]), -1, 1 << 64)):
        table = np.full(PIECE + WIDTH, base, np.uint64)
        table[0] = 1
        out.append(np.multiply.accumulate(table))
    return tuple(out)


class Piece:
    """Up to PIECE windows of a block's bytes: hashes of their parts, and the runs of one anchor."""

    def __init__(self, data: np.ndarray, end: np.ndarray, at: int):
        self.at, self.own, self.sums = at, data[at : at + PIECE + WIDTH - 1], {}
        n = len(self.own)
        many = max(0, n - WIDTH + 1)
        doc = np.searchsorted(end, np.arange(at, at + many), side="right")
        valid = end[doc] - np.arange(at, at + many) >= WIDTH
        gram = self.hash(np.arange(n - GRAM + 1), GRAM) if many else np.zeros(0, np.uint64)
        # The least hash of RUN neighbours, the leftmost of equals: the place stands in its low bits.
        least = (gram & ~_LOW) | np.arange(len(gram), dtype=np.uint64)
        width = 1
        while width * 2 <= RUN:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < RUN:
            least = np.minimum(least[: width - RUN], least[RUN - width :])
        anchor = (least & _LOW).astype(np.int64)
        fresh = valid.copy()
        fresh[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1] | (doc[1:] != doc[:-1])
        self.first = np.flatnonzero(fresh)
        ends = valid & ~np.r_[valid[1:] & ~fresh[1:], False]
        self.count = np.flatnonzero(ends) - self.first + 1
        # Least hashes are small numbers, so they are mixed once more to be dealt evenly by range.
        self.anchor = mix(gram[anchor[self.first]]) & ~np.uint64(1)

    def hash(self, begin: np.ndarray, size, which: int = 0) -> np.ndarray:
        """A hash of the `size` bytes from each place on."""
        power, back = _powers(which)
        if which not in self.sums:
            total = np.zeros(len(self.own) + 1, np.uint64)
            np.cumsum((self.own.astype(np.uint64) + np.uint64(1)) * power[: len(self.own)], out=total[1:])
            self.sums[which] = total
        total = (self.sums[which][begin + size] - self.sums[which][begin]) * back[begin]
        return mix(total + np.asarray(size, np.uint64) * _BASES[1 - which])

    def texts(self, anchors: np.ndarray, crowded: np.ndarray) -> tuple[np.ndarray, ...]:
        """(first window, windows, anchor, id) of the runs with one of these sorted anchors. Where it
        is crowded, each window is a run of its own and its own anchor."""
        place = np.minimum(np.searchsorted(anchors, self.anchor), max(len(anchors) - 1, 0))
        hit = anchors[place] == self.anchor if len(anchors) else np.zeros(len(place), bool)
        apart = hit.copy()
        apart[hit] = crowded[place[hit]]
        whole = hit & ~apart
        n = self.count[apart]
        single = np.repeat(self.first[apart] - np.cumsum(n) + n, n) + np.arange(n.sum())
        first = np.r_[self.first[whole], single]
        count = np.r_[self.count[whole], np.ones(len(single), np.int64)]
        anchor = np.r_[self.anchor[whole], self.hash(single, WIDTH) & ~np.uint64(1)]
        return first + self.at, count, anchor, self.hash(first, count + WIDTH - 1, 1)


def pieces(data: np.ndarray, size: np.ndarray) -> Iterator[Piece]:
    """All windows of documents that stand end to end."""
    end = np.cumsum(size)
    for at in range(0, max(len(data) - WIDTH + 1, 0), PIECE):
        yield Piece(data, end, at)


def anchors(data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct anchors of a block, and how many different texts stand around each; two for one
    text that stands there twice."""
    got = [(p.anchor, p.hash(p.first, p.count + WIDTH - 1)) for p in pieces(data, size)]
    if not got:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    anchor, text = (np.concatenate(x) for x in zip(*got, strict=True))
    order = np.lexsort((text, anchor))
    anchor, text = anchor[order], text[order]
    begin = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    fresh = np.r_[True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]
    number = np.diff(np.r_[begin, len(anchor)])
    return anchor[begin], np.maximum(np.add.reduceat(fresh.astype(np.int64), begin), np.minimum(number, 2))


# ---- steps


def blocks(df: DataFrame, key: str, text: str) -> DataFrame:
    """Documents (block, key, data), and rows (block, anchors, texts) with some of the block's anchors.
    Rows are kept small, as large cells cost a multiple of their size on the way."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held = TaskContext.get().partitionId(), 0, 0
        keys: list[pa.Array] = []
        data: list[pa.Array] = []

        def block():
            nonlocal number, held
            name, own, raw = part << 32 | number, pa.concat_arrays(keys), pa.concat_arrays(data)
            anchor, texts = anchors(*_bytes(raw))
            cut = range(0, len(anchor), SOME)
            cells = [pa.array([x[i : i + SOME].tobytes() for i in cut], pa.binary()) for x in (anchor, texts.astype(np.uint32))]
            none = lambda n, t: pa.nulls(n, t)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(own)), own, raw, *(none(len(own), pa.binary()) for _ in range(2))], names)
            if len(cut):
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(cut)), none(len(cut), own.type), none(len(cut), pa.binary()), *cells], names)
            keys.clear(), data.clear()
            number, held = number + 1, 0

        for batch in batches:
            raw = pc.fill_null(batch.column(1), b"")
            at = np.r_[0, np.cumsum(pc.binary_length(raw).to_numpy())].astype(np.int64)
            i = 0
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(at, at[i] + BLOCK_BYTES - held, side="right")) - 1)
                keys.append(batch.column(0).slice(i, j - i))
                data.append(raw.slice(i, j - i))
                held, i = held + int(at[j] - at[i]), j
                if held >= BLOCK_BYTES or i < batch.num_rows:
                    yield from block()
        if keys:
            yield from block()

    names = ["block", "key", "data", "anchors", "texts"]
    rows = df.select(F.col(key), F.col(text).cast("string").cast("binary"))
    return rows.mapInArrow(tidy(run), f"block long, key {kind}, data binary, anchors binary, texts binary")


def _bytes(data: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary array end to end, and the size of each element."""
    data = data.cast(pa.large_binary())
    at = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
    body = data.buffers()[2]
    raw = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], np.diff(at)


def _bucketed(df: DataFrame, by: str) -> DataFrame:
    """df as a table in the shared folder, bucketed so that joins by `by` leave its rows where they are."""
    spark = df.sparkSession
    name = f"blocks_{uuid.uuid4().hex}"
    at = f"{scratch.folder(spark)}/{name}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, by).format("parquet").option("path", at).saveAsTable(name)
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.table(name)


def repeated(kept: DataFrame) -> DataFrame:
    """(block, anchors): of each block's anchors those that occur twice or more anywhere, in pieces;
    the lowest bit is set for crowded ones."""
    kept = kept.where("anchors IS NOT NULL")
    total = kept.agg(F.sum(F.length("anchors") / 8)).first()[0] or 0
    bits = max(0, math.ceil(math.log2(total / PART))) if total else 0

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, own, many in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own, many = np.frombuffer(own, np.uint64), np.frombuffer(many, np.uint32)
                part = (own >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(own), np.int64)
                begin = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(own) else part
                cut = list(zip(begin.tolist(), np.r_[begin[1:], len(own)].tolist(), strict=True))
                for i in range(0, len(cut), 4096):
                    some = cut[i : i + 4096]
                    cells = [pa.array([int(part[a]) for a, _ in some], pa.int64()), pa.array([block] * len(some), pa.int64()), *(pa.array([x[a:b].tobytes() for a, b in some], pa.binary()) for x in (own, many))]
                    yield pa.RecordBatch.from_arrays(cells, ["part", "block", "anchors", "texts"])

    def count(table: pa.Table) -> pa.Table:
        own = [np.frombuffer(x, np.uint64) for x in table.column("anchors").to_pylist()]
        many = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("texts").to_pylist()]).astype(np.int64)
        every, place = np.unique(np.concatenate(own), return_inverse=True)
        total = np.bincount(place, many).astype(np.int64)
        out = every | (total > CROWD).astype(np.uint64)
        edge = np.cumsum([0, *map(len, own)])
        found = [out[p][total[p] > 1].tobytes() for p in (place[a:b] for a, b in zip(edge, edge[1:], strict=False))]
        some = [i for i, x in enumerate(found) if x]
        return _freed(pa.table({"block": table.column("block").take(pa.array(some, pa.int64())), "anchors": pa.array([found[i] for i in some], pa.binary())}))

    dealt = kept.select("block", "anchors", "texts").mapInArrow(tidy(deal), "part long, block long, anchors binary, texts binary")
    return dealt.groupBy("part").applyInArrow(count, "block long, anchors binary")


class _Block:
    """A block's documents with the texts around its repeated anchors: first window, windows, anchor, id."""

    def __init__(self, row: pa.Table, found: list[bytes]):
        self.keys = row.column("key").combine_chunks()
        self.data, self.size = _bytes(row.column("data").combine_chunks())
        known = np.sort(np.concatenate([np.frombuffer(x, np.uint64) for x in found])) if found else np.zeros(0, np.uint64)
        crowded = (known & np.uint64(1)).astype(bool)
        got = [p.texts(known & ~np.uint64(1), crowded) for p in pieces(self.data, self.size)] if len(known) else []
        none = [np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64)]
        self.first, self.count, anchor, one = [np.concatenate(x) for x in zip(*got, strict=True)] if got else none
        self.anchor, self.id = anchor.view(np.int64), one.view(np.int64)
        self.end = np.cumsum(self.size)
        self.doc = np.searchsorted(self.end, self.first, side="right")
        self.start = self.first - (self.end - self.size)[self.doc]

    def eldest(self) -> np.ndarray:
        """For each distinct (anchor, id), in their order, the place of the one with the least (key, start)."""
        age = ranks(self.keys)[self.doc]
        order = np.lexsort((self.start, age, self.id, self.anchor))
        a, i = self.anchor[order], self.id[order]
        return order[np.r_[True, (a[1:] != a[:-1]) | (i[1:] != i[:-1])]] if len(order) else order

    def of(self, anchor: np.ndarray, one: np.ndarray) -> np.ndarray:
        """For each own text the place of its (anchor, id) in a list that has all, each once."""
        n = len(anchor)
        a, i = np.r_[anchor, self.anchor], np.r_[one, self.id]
        order = np.lexsort((np.arange(len(a)) >= n, i, a))
        place = np.empty(len(a), np.int64)
        place[order] = order[np.maximum.accumulate(np.where(order < n, np.arange(len(a)), 0))]
        return place[n:]


def ranks(keys: pa.Array) -> np.ndarray:
    """Equal keys have equal ranks, and null the least."""
    by = pc.sort_indices(keys, null_placement="at_start").to_numpy().astype(np.int64)
    code = pc.fill_null(keys.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)[by]
    out = np.empty(len(by), np.int64)
    out[by] = np.cumsum(np.r_[True, code[1:] != code[:-1]][: len(by)])
    return out


def _freed(out: pa.Table) -> pa.Table:
    """out, after freed memory is given back."""
    return [*tidy(iter)([out])][0]


def _grouped(kept: DataFrame, other: DataFrame, by: str, run, schema: str) -> DataFrame:
    """run(block's documents, rows of other with this block); blocks without any get none."""

    def each(left: pa.Table, right: pa.Table) -> pa.Table:
        return _freed(run(left, right.combine_chunks()))

    return kept.where("anchors IS NULL").select("block", "key", "data").groupBy("block").cogroup(other.groupBy(by)).applyInArrow(each, schema)


def surroundings(kept: DataFrame, found: DataFrame, kind: str) -> DataFrame:
    """(of, anchor, id, key, start): each block's distinct texts around repeated anchors, with their
    least (key, start) in the block."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        own = _Block(left, right.column("anchors").to_pylist())
        pick = own.eldest()
        block = pa.array(np.full(len(pick), left.column("block")[0].as_py()))
        return pa.table({"of": block, "anchor": own.anchor[pick], "id": own.id[pick], "key": own.keys.take(pa.array(own.doc[pick])), "start": own.start[pick]})

    return _grouped(kept, found, "block", run, f"of long, anchor long, id long, key {kind}, start long")


def judged(texts: DataFrame) -> DataFrame:
    """(of, anchor, id, eldest, mixed): whether a block's text is the eldest of all equal ones, and
    whether other texts stand around its anchor."""
    alike = Window.partitionBy("anchor", "id").orderBy("key", "start")
    around = Window.partitionBy("anchor")
    rows = texts.withColumn("eldest", F.rank().over(alike) == 1)
    return rows.select("of", "anchor", "id", "eldest", (F.min("id").over(around) != F.max("id").over(around)).alias("mixed"))


def written(kept: DataFrame, found: DataFrame, asked: DataFrame, kind: str) -> DataFrame:
    """(of, anchor, id, key, start, text) of the texts that are asked for: rows (of, anchor, id)."""
    rows = _told(found, asked.withColumn("eldest", F.lit(True)).withColumn("marks", F.lit(0).cast("long")))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        want = right.filter(pc.is_valid(right.column("id"))).combine_chunks()
        own = _Block(left, right.column("anchors").drop_null().to_pylist() if len(want) else [])
        pick = own.eldest()
        key = np.stack([np.r_[own.anchor[pick], want.column("anchor").to_numpy()], np.r_[own.id[pick], want.column("id").to_numpy()]])
        _, at, n = np.unique(key, axis=1, return_inverse=True, return_counts=True)
        pick = pick[n[at.reshape(-1)[: len(pick)]] > 1]
        length = own.count[pick] + WIDTH - 1
        at = np.r_[0, np.cumsum(length)]
        raw = own.data[np.repeat(own.first[pick] - at[:-1], length) + np.arange(at[-1])] if len(pick) else np.zeros(0, np.uint8)
        text = pa.Array.from_buffers(pa.binary(), len(pick), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(raw)])
        block = pa.array(np.full(len(pick), left.column("block")[0].as_py()))
        return pa.table({"of": block, "anchor": own.anchor[pick], "id": own.id[pick], "key": own.keys.take(pa.array(own.doc[pick])), "start": own.start[pick], "text": text})

    return _grouped(kept, rows, "of", run, f"of long, anchor long, id long, key {kind}, start long, text binary")


def solved(texts: DataFrame) -> DataFrame:
    """(of, anchor, id, marks): the windows of these texts that are covered, where there are any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        weight = 0

        def out():
            table = pa.Table.from_batches(held).combine_chunks()
            marks = covered(table.column("text").combine_chunks(), table.column("key").combine_chunks(), table.column("start").to_numpy())
            got = table.select(["of", "anchor", "id"]).append_column("marks", pa.array(marks))
            return got.filter(pa.array(marks != 0)).combine_chunks().to_batches()

        for batch in batches:
            anchor = batch.column(1).to_numpy()
            edge = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]]).tolist() if len(anchor) else []
            if held and edge and held[-1].column(1)[-1].as_py() == anchor[0]:
                edge = edge[1:]
            done = 0
            for e in [*edge, len(anchor)]:  # texts are solved in batches that end where an anchor's texts end
                held += [batch.slice(done, e - done)] if e > done else []
                weight, done = weight + int(batch.nbytes * (e - done) / max(len(anchor), 1)), e
                if weight >= BATCH_BYTES and e < len(anchor):
                    yield from out()
                    held, weight = [], 0
        if held:
            yield from out()

    rows = texts.repartition("anchor").sortWithinPartitions("anchor")
    return rows.mapInArrow(tidy(run), "of long, anchor long, id long, marks long")


def _told(found: DataFrame, answers: DataFrame) -> DataFrame:
    """What blocks are told: answers to their texts, and which of their anchors are repeated."""
    none = lambda t: F.lit(None).cast(t)
    back = found.select("block", none("long"), none("long"), none("boolean"), none("long"), "anchors")
    return answers.select("of", "anchor", "id", "eldest", "marks", none("binary").alias("anchors")).unionAll(back)


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text", rest: bool = False) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) for every row of df; with `rest` also what is
    left of the text, as binary."""
    kind = df.schema[key].dataType.simpleString()
    kept = _bucketed(blocks(df, key, text), "block")
    found = scratch.keep(repeated(kept))
    verdict = scratch.keep(judged(surroundings(kept, found, kind)))
    marks = solved(written(kept, found, verdict.where("eldest AND mixed").select("of", "anchor", "id"), kind))
    answers = verdict.select("of", "anchor", "id", "eldest", F.lit(0).cast("long").alias("marks")).unionAll(marks.select("of", "anchor", "id", F.lit(True), "marks"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        own = _Block(left, right.column("anchors").drop_null().to_pylist())
        right = right.filter(pc.is_valid(right.column("id"))).combine_chunks()
        # A text can have two rows: whether it is the eldest, and marks.
        anchor, one, mark = (right.column(n).to_numpy() for n in ("anchor", "id", "marks"))
        eldest = right.column("eldest").combine_chunks().cast(pa.int8()).to_numpy().astype(bool) if len(right) else np.zeros(0, bool)
        order = np.lexsort((one, anchor))
        begin = np.flatnonzero(np.r_[True, (np.diff(anchor[order]) != 0) | (np.diff(one[order]) != 0)]) if len(order) else order
        anchor, one = anchor[order[begin]], one[order[begin]]
        mark, eldest = (f.reduceat(x[order], begin) if len(order) else x for f, x in ((np.bitwise_or, mark), (np.logical_and, eldest)))
        mine = own.of(anchor, one)
        # The eldest of a block's equal texts, and those with the same key and start.
        age, pick = ranks(own.keys)[own.doc], own.eldest()
        at = own.of(own.anchor[pick], own.id[pick])
        same = (age == age[pick][at]) & (own.start == own.start[pick][at]) & eldest[mine] if len(mine) else np.zeros(0, bool)
        window = np.zeros(len(own.data) + 1, np.int64)
        np.add.at(window, own.first[~same], 1)
        np.add.at(window, (own.first + own.count)[~same], -1)
        window = np.cumsum(window)[: len(own.data)] > 0
        part = np.flatnonzero(same & (mark[mine] != 0)) if len(mine) else mine
        row, bit = np.nonzero((mark[mine[part]][:, None] >> np.arange(RUN)) & 1)
        window[own.first[part[row]] + bit] = True
        total = np.r_[0, np.cumsum(window)]
        gone = total[1:] > total[np.maximum(np.arange(len(own.data)) - WIDTH + 1, 0)]
        begin = (own.end - own.size)[own.size > 0]
        spans = gone & ~np.r_[False, gone[:-1]][: len(gone)]
        spans[begin] = gone[begin]
        edge = np.r_[0, own.end]
        removed, runs = (np.diff(np.r_[0, np.cumsum(x)][edge]) for x in (gone, spans))
        left_over, edge = own.data[~gone], (edge - np.r_[0, np.cumsum(removed)]).tolist()
        parts = [left_over[a:b].tobytes() for a, b in zip(edge, edge[1:], strict=False)]
        cells = {key: own.keys, "n_bytes": own.size, "n_removed": removed, "n_spans": runs, "kept_sha256": [hashlib.sha256(x).hexdigest() for x in parts]}
        return pa.table(cells | ({"rest": pa.array(parts, pa.binary())} if rest else {}))

    schema = f"`{key}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", rest binary" if rest else "")
    return _grouped(kept, _told(found, answers), "of", run, schema)
