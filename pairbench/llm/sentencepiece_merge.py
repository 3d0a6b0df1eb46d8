"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text is escaped (space to U+2581, one in front) and cut into words at places no piece spans. The
distinct words of a batch become one flat array of symbol ids. Each round looks up the piece that
every adjacent pair would make, takes each word's best pair (a segmented minimum; the leftmost of
equals), merges it in all words at once and compacts the array, until no pair remains. What is not a
piece then falls back to its bytes.

Decoding joins the pieces' bytes, drops the one escaped space in front, and replaces bytes that are
not UTF-8 by U+FFFD, each malformed byte on its own.

Null and empty texts have the end id only and decode to the empty text. Texts of any length are
encoded whole; rows stay apart, so ties and repeated rows give equal ids. Extra input columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairbench.llm.textkit import tidy

SPACE = "▁"
CACHE_WORDS = 80_000


class PieceModel:
    """Tables of one BPE model file: identity normaliser, byte fallback, one space put in front."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.end = sp.eos_id()
        if sp.normalize(" ﬁ  x\r\n") != f"{SPACE}{SPACE}ﬁ{SPACE}{SPACE}x\r\n":
            raise ValueError("only models with an identity normaliser and a space in front are supported")
        names = [sp.id_to_piece(i) for i in range(n)]
        kind = ["byte" if sp.is_byte(i) else "control" if sp.is_control(i) or sp.is_unknown(i) else "piece" for i in range(n)]
        if any(sp.is_unused(i) for i in range(n)) or kind.count("byte") != 256:
            raise ValueError("only models with byte fallback and without unused pieces are supported")
        self.of = {p: i for i, p in enumerate(names) if kind[i] == "piece"}
        self.byte = np.zeros(256, np.int64)
        self.bytes: list[bytes] = []
        for i, p in enumerate(names):
            if kind[i] == "byte":
                self.byte[int(p[1:-1], 16)] = i
                self.bytes.append(bytes([int(p[1:-1], 16)]))
            else:
                self.bytes.append(p.replace(SPACE, " ").encode() if kind[i] == "piece" else " ⁇ ".encode() if sp.is_unknown(i) else b"")
        # Symbols below n are pieces; characters that are no piece get ids from n on, and never merge.
        score = np.array([sp.get_score(i) for i in range(n)])
        order = np.argsort(-score, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.unique(-score[order], return_inverse=True)[1]  # equal scores are equal ranks
        pairs = []
        for p, i in self.of.items():
            for cut in range(1, len(p)):
                a, b = self.of.get(p[:cut]), self.of.get(p[cut:])
                if a is not None and b is not None:
                    pairs.append(((a << 20) | b, rank[i], i))
        pairs.sort()
        self.key = np.array([x[0] for x in pairs], np.int64)
        self.rank = np.array([x[1] for x in pairs], np.int64)
        self.made = np.array([x[2] for x in pairs], np.int64)
        # Pairs whose symbol is in no pair of the same or an earlier rank: all their occurrences can go at once.
        early = np.full(n, np.iinfo(np.int64).max)
        for part in (self.key >> 20, self.key & 0xFFFFF):
            np.minimum.at(early, part, self.rank)
        self.safe = early[self.made] > self.rank
        # An open table from a pair's key to its place.
        self.bits = 21
        self.slot = np.full(1 << self.bits, -1, np.int32)
        todo = np.arange(len(self.key), dtype=np.int32)
        place = self._place(self.key)
        while len(todo):
            free = self.slot[place] < 0
            self.slot[place[free]] = todo[free]
            lost = self.slot[place] != todo
            todo, place = todo[lost], (place[lost] + 1) & ((1 << self.bits) - 1)
        apart = "" if any("\n" in p for p in self.of) else "\n"
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.of):
            raise ValueError("a piece spans words")
        self.cut = re.compile(f"{SPACE}*[^{SPACE}{apart}]+|{SPACE}+" + (f"|{apart}" if apart else ""))
        self.n = n
        self.lead = [k == "piece" and p[:1] == SPACE for k, p in zip(kind, names, strict=True)]
        self.text = [str(i) for i in range(n)]

    def _place(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The place of each pair in the tables, -1 if it makes no piece."""
        key = (left << 20) | right
        place = self._place(key)
        out = self.slot[place]
        todo = np.flatnonzero((out >= 0) & (self.key[out] != key))
        while len(todo):
            place[todo] = (place[todo] + 1) & ((1 << self.bits) - 1)
            got = self.slot[place[todo]]
            out[todo] = got
            todo = todo[(got >= 0) & (self.key[got] != key[todo])]
        return out

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, merged round by round, and the number of ids of each."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        joined = "".join(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        char = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int64)
        table = {c: self.of.get(chr(c), self.n) for c in np.unique(char).tolist()}
        seen = np.array(sorted(table), np.int64)
        ids = np.array([table[c] for c in seen.tolist()], np.int64)[np.searchsorted(seen, char)]
        first = np.cumsum(size) - size
        sym, word = ids, np.repeat(np.arange(len(words)), size)
        at = np.arange(len(sym))  # the character at which a symbol begins
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        best_none = len(self.key) + self.n + 1
        place = np.full(len(sym), -1, np.int32)
        if len(sym) > 1:
            same = word[1:] == word[:-1]
            place[:-1][same] = self._pair(sym[:-1][same], sym[1:][same])
        while len(sym):
            rank = np.where(place >= 0, self.rank[place], best_none)
            begin = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(rank, begin)
            length = np.diff(np.r_[begin, len(sym)])
            over = np.repeat(least == best_none, length)
            if over.any():
                done.append((word[over], at[over], sym[over]))
                keep = ~over
                sym, word, at, place, rank = sym[keep], word[keep], at[keep], place[keep], rank[keep]
                live = least != best_none
                least, length = least[live], length[live]
                if not len(sym):
                    break
                begin = np.cumsum(length) - length
            hit = np.flatnonzero(rank == np.repeat(least, length))
            # The leftmost in each word; where it is safe, all: of those that overlap, every other one.
            first = np.r_[True, word[hit[1:]] != word[hit[:-1]]]
            run = np.flatnonzero(first | np.r_[True, np.diff(hit) != 1])
            other = (np.arange(len(hit)) - np.repeat(run, np.diff(np.r_[run, len(hit)]))) % 2 == 0
            begun = np.flatnonzero(first)
            safe = np.logical_and.reduceat(self.safe[place[hit]], begun)
            left = hit[first | (other & np.repeat(safe, np.diff(np.r_[begun, len(hit)])))]
            sym[left] = self.made[place[left]]
            keep = np.ones(len(sym), bool)
            keep[left + 1] = False
            where = np.cumsum(keep) - 1
            sym, word, at, place = sym[keep], word[keep], at[keep], place[keep]
            fresh = where[left]
            for i in (fresh, fresh[fresh > 0] - 1):  # only pairs beside a merge are new
                place[i] = -1
                j = i[i + 1 < len(sym)]
                j = j[word[j] == word[j + 1]]
                place[j] = self._pair(sym[j], sym[j + 1])
        w, a, s = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.lexsort((a, w))
        w, a, s = w[order], a[order], s[order]
        lost = np.flatnonzero(s >= self.n)
        if len(lost):
            spelt = [joined[c].encode() for c in a[lost].tolist()]
            size = np.ones(len(s), np.int64)
            size[lost] = [len(x) for x in spelt]
            begin = np.cumsum(size) - size
            w, s = np.repeat(w, size), np.repeat(s, size)
            s[np.repeat(begin[lost], size[lost]) + np.concatenate([np.arange(len(x)) for x in spelt])] = self.byte[np.frombuffer(b"".join(spelt), np.uint8)]
        return s, np.bincount(w, minlength=len(words))


def utf8(data: bytes) -> str:
    """Bytes as text; a byte that begins no valid character becomes one U+FFFD."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(data):
            for n in (1, 2, 3, 4):
                try:
                    out.append(data[i : i + n].decode())
                    i += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                i += 1
        return "".join(out)


class Encoder:
    """Encodes and decodes texts. Words met before are kept, with their ids end to end in one array."""

    def __init__(self, path: str):
        self.model = PieceModel(path)
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.at = np.zeros(1, np.int64)

    def _learn(self, words: list[str]) -> None:
        ids, size = self.model.merge(words)
        self.index.update(zip(words, range(len(self.index), len(self.index) + len(words)), strict=True))
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(size)])

    def encode(self, texts: list[str | None], end: bool = True) -> list[np.ndarray]:
        m = self.model
        cut = [m.cut.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        every = list(chain.from_iterable(cut))
        got = list(map(self.index.get, every))
        lost = [i for i, x in enumerate(got) if x is None] if None in got else []
        new = list(dict.fromkeys([every[i] for i in lost]))
        if new:
            if len(self.index) + len(new) > CACHE_WORDS:
                self._clear()
                new, lost = list(dict.fromkeys(every)), range(len(every))
            self._learn(new)
            for i in lost:
                got[i] = self.index[every[i]]
        word = np.fromiter(got, np.int64, len(got))
        size = self.at[word + 1] - self.at[word]
        total = np.concatenate([[0], np.cumsum(size)])
        flat = self.ids[np.repeat(self.at[word] - total[:-1], size) + np.arange(total[-1])]
        edge = total[np.cumsum([0, *map(len, cut)])].tolist()
        last = np.array([m.end] if end else [], np.int32)
        return [np.concatenate([flat[i:j], last]) for i, j in zip(edge, edge[1:], strict=False)]

    def decode(self, ids: list[int]) -> str:
        table = self.model.bytes
        data = b"".join([table[i] for i in ids])
        return utf8(data[1:] if len(ids) and self.model.lead[ids[0]] else data)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", end: bool = True, digests: bool = False) -> DataFrame:
    """(key, ids array<int>, decoded string), or with `digests` (key, n_tokens, ids_sha256,
    decoded_sha256). One narrow stage without a shuffle."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for i in range(0, max(batch.num_rows, 1), 128):
                part = batch.slice(i, 128)
                keys = part.column(0)
                ids = [x.tolist() for x in enc.encode(part.column(1).to_pylist(), end)]
                plain = [enc.decode(x) for x in ids]
                if digests:
                    name = enc.model.text
                    cols = [
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(" ".join([name[j] for j in x]).encode()).hexdigest() for x in ids], pa.string()),
                        pa.array([hashlib.sha256(x.encode()).hexdigest() for x in plain], pa.string()),
                    ]
                    yield pa.RecordBatch.from_arrays([keys, *cols], [key, "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    yield pa.RecordBatch.from_arrays([keys, pa.array(ids, pa.list_(pa.int32())), pa.array(plain, pa.string())], [key, "ids", "decoded"])

    out = f"`{key}` {kind}, " + ("n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string")
    return df.select(F.col(key), F.col(text).cast("string")).mapInArrow(tidy(run), out)
