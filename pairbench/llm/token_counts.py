"""Exact byte-pair token counts at every prefix, by dynamic programming.

For byte-pair encoding the encoding of a prefix ends in exactly one token: the one whose pair with
the last token of what stands before it can stand side by side. So for each byte position of a
pre-token the program keeps the last token and the count (count before that token, plus one). One
pass answers "how many tokens has this text", "is it over the limit" and "how long a prefix fits in
a budget" without encoding again. All distinct pre-tokens of a batch go through the program
together, position by position, as numpy arrays.

Null and empty texts have 0 tokens and 0 bytes. Special strings inside a text count as one token,
as the library does by default. Texts of any length are counted whole. Rows stay apart, so repeated
rows give equal counts; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairbench.llm.textkit import mix, tidy

#: The pre-token pattern of byte-level vocabularies (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE_WORDS = 200_000
LONG = 200  # bytes; longer pre-tokens are walked one by one
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _byte_names() -> dict[str, int]:
    """Printable stand-ins of bytes in byte-level vocabulary files: printable Latin-1 characters
    stand for themselves, the others for code points from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in own}
    rest = [b for b in range(256) if b not in set(own)]
    out.update({chr(256 + i): b for i, b in enumerate(rest)})
    return out


class _Table:
    """uint64 keys to int32 values, open addressing over numpy arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.values = np.full(1 << self.bits, -1, np.int32)
        place, todo = self._place(keys), np.arange(len(keys))
        while len(todo):
            free = self.values[place] < 0
            self.values[place[free]] = values[todo[free]]
            self.keys[place[free]] = keys[todo[free]]
            lost = self.keys[place] != keys[todo]
            todo, place = todo[lost], (place[lost] + 1) & ((1 << self.bits) - 1)

    def _place(self, key: np.ndarray) -> np.ndarray:
        return ((key * _BASE) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, key: np.ndarray) -> np.ndarray:
        place = self._place(key)
        out = self.values[place]
        todo = np.flatnonzero((out >= 0) & (self.keys[place] != key))
        while len(todo):
            place[todo] = (place[todo] + 1) & ((1 << self.bits) - 1)
            got = self.values[place[todo]]
            out[todo] = got
            todo = todo[(got >= 0) & (self.keys[place[todo]] != key[todo])]
        return out


class PrefixCounter:
    """Token counts of every prefix of a text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["pre_tokenizer"].get("type") != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space") or spec["normalizer"]:
            raise ValueError("only plain byte-level vocabularies are supported")
        special = sorted((x["content"] for x in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.pattern = regex.compile(PATTERN)
        byte = _byte_names()
        merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in spec["model"]["merges"]]
        # Symbols in the order in which they arise: single bytes, then one for each merge.
        names = [c for c in byte if c in spec["model"]["vocab"]] + [a + b for a, b in merges]
        number = {}
        for s in names:
            number.setdefault(s, len(number))
        n = len(number)
        self.left, self.right = np.arange(n, dtype=np.int64), np.arange(n, dtype=np.int64)
        keys, made = [], []
        for a, b in merges:
            i = number[a + b]
            keys.append((number[a] << 20) | number[b])
            made.append(i)
            if self.left[i] == i:
                self.left[i], self.right[i] = number[a], number[b]
        self.pairs = dict(zip(keys, made, strict=True))
        self.pair = _Table(np.array(keys, np.uint64), np.array(made, np.int32))
        text = [bytes(byte[c] for c in s) for s in number]
        self.token = {t: i for i, t in enumerate(text)}
        self.longest = max(map(len, text))
        self.by_size = {}
        inv = pow(int(_BASE), -1, 1 << 64)
        self.power = np.array([pow(int(_BASE), i, 1 << 64) for i in range(LONG + 1)], np.uint64)
        self.inverse = np.array([pow(inv, i, 1 << 64) for i in range(LONG + 1)], np.uint64)
        hashes = [sum((b + 1) * pow(int(_BASE), i, 1 << 64) for i, b in enumerate(t)) & ((1 << 64) - 1) if len(t) <= LONG else 0 for t in text]
        self.lookup = _Table(mix(np.array(hashes, np.uint64)), np.arange(n, dtype=np.int32))
        self.cache: dict[str, bytes] = {}

    def beside(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether tokens a and b stay apart when they stand side by side: no merge across their
        border comes before the merges that make them."""
        a, b = a.astype(np.int64), b.astype(np.int64)
        ok = np.ones(len(a), bool)
        limit = np.full(len(a), 1 << 40, np.int64)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            made = self.pair.get(((x << 20) | y).astype(np.uint64))
            bad = (made >= 0) & (made < limit[live])
            ok[live[bad]] = False
            # Undo the later of the two merges; a single byte can't be undone.
            rx, ly = self.right[x], self.left[y]
            whole_x, whole_y = rx == x, ly == y
            undo_x = ((x > y) & ~whole_x) | whole_y
            limit[live] = np.where(undo_x, x, y + 1)
            a[live] = np.where(undo_x, rx, x)
            b[live] = np.where(undo_x, y, ly)
            live = live[~bad & ~(whole_x & whole_y)]
        return ok

    def _walk(self, data: bytes) -> np.ndarray:
        """The program for one long pre-token."""
        last, count, known = [-1] * (len(data) + 1), np.zeros(len(data) + 1, np.int64), {}
        for i in range(1, len(data) + 1):
            for size in range(min(i, self.longest), 0, -1):
                t = self.token.get(data[i - size : i])
                if t is None:
                    continue
                before = last[i - size]
                if before >= 0:
                    ok = known.get((before, t))
                    if ok is None:
                        ok = known[before, t] = bool(self.beside(np.array([before]), np.array([t]))[0])
                    if not ok:
                        continue
                last[i], count[i] = t, count[i - size] + 1
                break
        return count[1:]

    def _program(self, words: list[bytes]) -> list[bytes]:
        """Counts at every byte of each pre-token, as bytes (all counts are below 256)."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-size, kind="stable")
        size = size[order]
        begin = np.cumsum(size) - size
        raw = np.frombuffer(b"".join([words[i] for i in order.tolist()]), np.uint8)
        inside = np.arange(len(raw)) - np.repeat(begin, size)
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.power[inside], out=total[1:])
        last, count = np.full(len(raw), -1, np.int64), np.zeros(len(raw), np.uint8)
        for i in range(1, int(size[0]) + 1):
            n = int(np.searchsorted(-size, -i, side="right"))
            todo = begin[:n]  # where the words with i bytes or more begin
            end_hash = total[todo + i]
            for m in range(min(i, self.longest), 0, -1):
                at = todo + (i - m)
                t = self.lookup.get(mix((end_hash - total[at]) * self.inverse[i - m]))
                hit = np.flatnonzero(t >= 0)
                if m < i and len(hit):
                    hit = hit[self.beside(last[at[hit] - 1], t[hit])]
                if len(hit):
                    end = at[hit] + m - 1
                    last[end] = t[hit]
                    count[end] = 1 if m == i else count[at[hit] - 1] + 1
                    keep = np.ones(len(todo), bool)
                    keep[hit] = False
                    todo, end_hash = todo[keep], end_hash[keep]
                    if not len(todo):
                        break
        data = count.tobytes()
        out: list[bytes] = [b""] * len(words)
        for i, s, n in zip(order.tolist(), begin.tolist(), size.tolist(), strict=True):
            out[i] = data[s : s + n]
        return out

    def cut(self, text: str) -> list[str]:
        """Pre-tokens; special strings stand alone."""
        if self.special is None or not self.special.search(text):
            return self.pattern.findall(text)
        out = []
        for i, part in enumerate(self.special.split(text)):
            out += [part] if i % 2 else self.pattern.findall(part)
        return out

    def learn(self, cut: list[list[str]]) -> None:
        """Puts all pre-tokens into the cache."""
        new = {w for c in cut for w in c}
        if len(self.cache) + len(new) > CACHE_WORDS:
            self.cache = {w: c for w in new if (c := self.cache.get(w)) is not None}
        names, data = [], []
        for w in new:
            if w in self.cache:
                continue
            b = w.encode()
            if self.special is not None and self.special.fullmatch(w):
                self.cache[w] = bytes(len(b) - 1) + b"\1"
            elif len(b) <= LONG:
                names.append(w)
                data.append(b)
        if data:
            self.cache.update(zip(names, self._program(data), strict=True))

    def prefix(self, text: str) -> np.ndarray:
        """Token counts at every byte position 0 to n. Inside a special string it has no token yet."""
        cut = self.cut(text)
        self.learn([cut])
        parts, base = [np.zeros(1, np.int64)], 0
        for w in cut:
            c = self.cache.get(w)
            own = np.frombuffer(c, np.uint8).astype(np.int64) if c is not None else self._walk(w.encode())
            parts.append(own + base)
            base += int(own[-1])
        return np.concatenate(parts)

    def counts(self, texts: list[str | None], limit: int) -> list[tuple[int, int]]:
        """(tokens, bytes of the longest prefix of at most `limit` tokens that ends between characters)."""
        cut = [self.cut(t) if t else [] for t in texts]
        self.learn(cut)
        out = []
        for text, c in zip(texts, cut, strict=True):
            got = [self.cache.get(w) for w in c]
            if None in got:
                got = [self._walk(w.encode()) if x is None else x for w, x in zip(c, got, strict=True)]
            own = [int(x[-1]) for x in got]
            n = sum(own)
            fit = len(text.encode()) if text else 0
            if n > limit:
                total, fit = 0, 0
                for w, x, k in zip(c, got, own, strict=True):
                    if total + k > limit:
                        data = w.encode()
                        own_at = np.frombuffer(x, np.uint8).astype(np.int64) if isinstance(x, bytes) else x
                        inside = np.flatnonzero(own_at + total <= limit)
                        j = int(inside[-1]) + 1 if len(inside) else 0
                        j = 0 if self.special is not None and self.special.fullmatch(w) else j
                        while j and j < len(data) and data[j] & 0xC0 == 0x80:
                            j -= 1
                        fit += j
                        break
                    total += k
                    fit += len(w.encode())
            out.append((n, fit))
        return out


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def token_counts(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = 512) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit, fit_bytes): fit_bytes is the length of the longest prefix
    of at most `limit` tokens. One narrow stage without a shuffle."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                got = c.counts(part.column(1).to_pylist(), limit)
                n = pa.array([x[0] for x in got], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), n, pa.array([x[0] > limit for x in got], pa.bool_()), pa.array([x[1] for x in got], pa.int64())], [key, "n_bytes", "n_tokens", "over_limit", "fit_bytes"])

    size = F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)).cast("long")
    return df.select(F.col(key), F.col(text).cast("string").alias("_text"), size.alias("_size")).mapInArrow(tidy(run), f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean, fit_bytes long")
