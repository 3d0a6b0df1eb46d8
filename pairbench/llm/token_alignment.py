"""Alignment of two tokenizers' tokens over the bytes they share.

Both encodings of a text spell the same bytes. Tokens are the nodes of a bipartite graph, and two
tokens are linked when their byte ranges overlap. Union-find over the links gives the connected
components, which are the least groups of tokens that cover the same bytes. Links are counted by id
pair over the whole corpus: in how many documents a pair stands linked.

1. A narrow pass encodes, aligns and packs: for every block of some 16 MB of text one row with the
   documents' figures, the block's distinct pairs with their numbers of documents, and each
   document's pairs as places in that list. It is written once to the shared folder.
2. Pairs are counted over all blocks. A block has a pair once, so a frequent pair is one row a block.
   The counts, with whether they are the highest of their A id, are joined with the blocks' lists.
3. Each block meets its own counts, and every document adds up those of its links.

Nothing goes through the driver, and no table is broadcast by this module. Text is a null, empty, or
has bytes that either tokenizer can't give back: no tokens, zeros, and an empty digest. Long texts
are encoded whole. Rows stay apart, so repeated rows give equal results and count as documents of
their own; ties for the highest count all count as best; a null key stays null. An empty table gives
an empty result, and extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairbench.llm import scratch
from pairbench.llm.textkit import chunks, tidy
from pairbench.llm.token_counts import PATTERN, _byte_names

BLOCK_BYTES = 16 << 20
FIGURES = ["n_a", "n_b", "n_groups", "n_links"]


class ByteTokens:
    """A byte-level vocabulary file of the tokenizers library. Where its merges stand in the order of
    their ids, the ids are the ranks of the same encoding in tiktoken, which is four times as fast."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, byte = spec["model"]["vocab"], _byte_names()
        special = {x["content"] for x in spec["added_tokens"]}
        made = [vocab["".join(x.split(" ") if isinstance(x, str) else x)] for x in spec["model"]["merges"]]
        if spec["pre_tokenizer"].get("type") != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space") or spec["normalizer"] or made != sorted(set(made)):
            raise ValueError("only plain byte-level vocabularies with merges in the order of their ids are supported")
        ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in special}
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for t, i in ranks.items():
            self.bytes[i] = t
        self._own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self._own.encode_ordinary(" " + t) for t in texts]


class PieceTokens:
    """A SentencePiece model file with a space put in front."""

    def __init__(self, path: str):
        import sentencepiece

        sp = self._own = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.bytes = [bytes([int(p[3:-1], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._own.encode(texts, num_threads=1) if texts else []


def union(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least node of each node's component: union-find over arrays. Each round hooks the greater
    root of every open link to the smaller, then all paths are compressed by pointer jumping."""
    parent = np.arange(n)
    while True:
        a, b = parent[u], parent[v]
        open_ = a != b
        if not open_.any():
            return parent
        u, v, a, b = u[open_], v[open_], a[open_], b[open_]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up


def overlaps(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links (token of A, token of B) whose byte ranges overlap. Both cover bytes 0 to the same
    end; between two neighbouring ends of any token lies exactly one token of each."""
    mark = np.zeros(int(a_end[-1]) + 1 if len(a_end) else 1, np.uint8)
    mark[a_end] |= 1
    mark[b_end] |= 2
    own = mark[np.flatnonzero(mark)]
    in_a, in_b = (own & 1).astype(np.int64), (own >> 1).astype(np.int64)
    return np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b


def groups(n_a: int, n_b: int, link_a: np.ndarray, link_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each token's group, for A and for B: components of the links, in text order.
    A token's node has the place of its first link, so roots are leftmost and a round suffices."""
    first_a, first_b = np.searchsorted(link_a, np.arange(n_a)), np.searchsorted(link_b, np.arange(n_b))
    root = union(2 * len(link_a), 2 * first_a[link_a], 2 * first_b[link_b] + 1)
    root_a, root_b = root[2 * first_a], root[2 * first_b + 1]
    place = np.zeros(2 * len(link_a) + 1, np.int64)
    place[root_a] = 1
    number = np.cumsum(place) - 1
    return number[root_a], number[root_b]


class Aligner:
    def __init__(self, byte_path: str, piece_path: str):
        self.a, self.b = ByteTokens(byte_path), PieceTokens(piece_path)
        self.a_size, self.b_size = (np.array([len(t) for t in x.bytes], np.int64) for x in (self.a, self.b))
        self.width = len(self.b.bytes)  # id pairs are numbered a * width + b
        self.text = [f"{i}{s}" for i in range(len(self.a.bytes)) for s in (",", "|")] + [f"{i}{s}" for i in range(self.width) for s in (",", ";", "")]

    def _spelt(self, texts: list[str]) -> tuple[list[int], list[list[int]], list[list[int]]]:
        """Places of the texts that both give back byte for byte, and their ids."""
        a, b = self.a.encode(texts), self.b.encode(texts)
        own_a, own_b = self.a.bytes, self.b.bytes
        good = []
        for i, t in enumerate(texts):
            want = b" " + t.encode()
            if b"".join([own_a[x] for x in a[i]]) == want and b"".join([own_b[x] for x in b[i]]) == want:
                good.append(i)
        return good, [a[i] for i in good], [b[i] for i in good]

    def align(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """For each text its FIGURES and digest; then all distinct (text's place, pair) with the
        number of such links, sorted."""
        figures, digest = np.zeros((len(texts), 4), np.int64), [""] * len(texts)
        full = [i for i, t in enumerate(texts) if t]
        good, a, b = self._spelt([texts[i] for i in full])
        none = np.zeros(0, np.int64)
        if not good:
            return figures, digest, none, none, none
        place = np.array(full, np.int64)[good]
        n_a, n_b = np.array([len(x) for x in a]), np.array([len(x) for x in b])
        ids_a, ids_b = (np.fromiter(chain.from_iterable(x), np.int64, int(n.sum())) for x, n in ((a, n_a), (b, n_b)))
        link_a, link_b = overlaps(np.cumsum(self.a_size[ids_a]), np.cumsum(self.b_size[ids_b]))
        group_a, group_b = groups(len(ids_a), len(ids_b), link_a, link_b)
        doc_a = np.repeat(np.arange(len(good)), n_a)
        doc = doc_a[link_a]
        last_a, last_b = (np.diff(np.r_[g, -1]) != 0 for g in (group_a, group_b))
        figures[place] = np.stack([n_a, n_b, np.bincount(doc_a[last_a], minlength=len(good)), np.bincount(doc, minlength=len(good))], 1)
        # Where each token is written: A's of a group, then B's.
        many = int(group_a[-1]) + 1
        before_b = np.cumsum(np.bincount(group_b, minlength=many)) - np.bincount(group_b, minlength=many)
        upto_a = np.cumsum(np.bincount(group_a, minlength=many))
        code = np.empty(len(ids_a) + len(ids_b), np.int64)
        code[np.arange(len(ids_a)) + before_b[group_a]] = 2 * ids_a + last_a
        end_b = np.zeros(len(ids_b), np.int64)
        end_b[np.cumsum(n_b) - 1] = 1
        code[np.arange(len(ids_b)) + upto_a[group_b]] = 2 * len(self.a.bytes) + 3 * ids_b + last_b + end_b
        edge = [0, *accumulate((n_a + n_b).tolist())]
        written = [self.text[i] for i in code.tolist()]
        for k, i in enumerate(place.tolist()):
            digest[i] = hashlib.sha256("".join(written[edge[k] : edge[k + 1]]).encode()).hexdigest()
        pair = ids_a[link_a] * self.width + ids_b[link_b]
        every = len(self.a.bytes) * self.width
        key, count = np.unique(doc * every + pair, return_counts=True)
        return figures, digest, place[key // every], key % every, count


@lru_cache(maxsize=1)
def aligner(byte_path: str, piece_path: str) -> Aligner:
    return Aligner(byte_path, piece_path)


def _pack(x: np.ndarray) -> bytes:
    """Small unsigned numbers, by byte planes, compressed."""
    planes = np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype(np.int64)


def blocks(df: DataFrame, byte_path: str, piece_path: str, key: str, text: str) -> DataFrame:
    """One row for each block of documents: see the module's text."""
    kind = df.schema[key].dataType.simpleString()
    schema = f"block long, key array<{kind}>, n_a array<int>, n_b array<int>, n_groups array<int>, n_links array<int>, digest array<string>, size array<int>, place binary, many binary, pair array<long>, docs array<int>"

    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, number, part = aligner(byte_path, piece_path), TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        weight = 0

        def block():
            keys = pa.concat_arrays([x[0] for x in held])
            rows = np.cumsum([0, *(len(x[0]) for x in held)])
            figures = np.concatenate([x[1] for x in held])
            doc = np.concatenate([x[3] + r for x, r in zip(held, rows, strict=False)])
            pair, at, docs = np.unique(np.concatenate([x[4] for x in held]), return_inverse=True, return_counts=True)
            many = np.concatenate([x[5] for x in held])
            size = np.bincount(doc, minlength=len(keys))
            step = np.diff(at, prepend=0)
            begin = (np.cumsum(size) - size)[size > 0]
            step[begin] = at[begin]  # places grow within a document
            digest = pa.array(list(chain.from_iterable(x[2] for x in held)), pa.string())
            lists = [keys, *(pa.array(c) for c in figures.T.astype(np.int32)), digest, pa.array(size.astype(np.int32))]
            cells = [pa.array([number << 32 | part]), *map(_list, lists), pa.array([_pack(step)]), pa.array([_pack(many)]), _list(pa.array(pair)), _list(pa.array(docs.astype(np.int32)))]
            return pa.RecordBatch.from_arrays(cells, names)

        for batch in batches:
            for piece in chunks(batch, text):
                held.append((piece.column(0), *own.align(piece.column(1).to_pylist())))
                weight += piece.nbytes
                if weight >= BLOCK_BYTES:
                    yield block()
                    held.clear()
                    weight, part = 0, part + 1
        if held:
            yield block()

    return df.select(F.col(key), F.col(text).cast("string").alias(text)).mapInArrow(tidy(run), schema)


def _list(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def pair_counts(found: DataFrame, width: int) -> DataFrame:
    """(pair, count, best) from rows (pair, docs): in how many documents a pair is linked, and whether
    no pair of its A id is linked in more."""
    counts = found.groupBy("pair").agg(F.sum("docs").alias("count")).withColumn("a", F.floor(F.col("pair") / width))
    top = counts.groupBy("a").agg(F.max("count").alias("top"))
    return counts.join(top, "a").select("pair", "count", (F.col("count") == F.col("top")).alias("best"))


def align(df: DataFrame, byte_path: str, piece_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of df."""
    kind = df.schema[key].dataType.simpleString()
    width = len(aligner(byte_path, piece_path).b.bytes)
    kept = scratch.keep(blocks(df, byte_path, piece_path, key, text))
    lists = kept.select(F.col("block").alias("of"), F.explode(F.arrays_zip("pair", "docs")).alias("x")).select("of", "x.pair", "x.docs")
    answers = lists.select("of", "pair").join(pair_counts(lists.select("pair", "docs"), width), "pair")
    packed = kept.drop("pair", "docs")

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right.column("pair").to_numpy())
        count = right.column("count").to_numpy()[order]
        best = right.column("best").combine_chunks().cast(pa.int8()).to_numpy()[order].astype(np.int64)
        row = {n: left.column(n).combine_chunks() for n in left.column_names}
        size = row["size"].values.to_numpy().astype(np.int64)
        n, edge = int(size.sum()), np.r_[0, np.cumsum(size)]
        step, many = (_unpack(row[c][0].as_py(), n) for c in ("place", "many"))
        total = np.cumsum(step)
        at = total - np.repeat(np.r_[0, total][edge[:-1]], size)
        sums = [np.diff(np.r_[0, np.cumsum(x[at] * many)][edge]) for x in (best, count)]
        return pa.table({key: row["key"].values, **{c: row[c].values.cast(pa.int64()) for c in FIGURES}, "n_best": sums[0], "count_sum": sums[1], "groups_sha256": row["digest"].values})

    schema = f"`{key}` {kind}, " + ", ".join(f"{n} long" for n in [*FIGURES, "n_best", "count_sum"]) + ", groups_sha256 string"
    return packed.groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(finish, schema)
