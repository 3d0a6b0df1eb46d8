"""Main-text extraction by a linear-chain conditional random field over DOM leaf blocks.

A page is read into leaf blocks: runs of text between block-level tags, in page order, each with the
names, classes and ids of its open ancestors. Comments, scripts, styles and other raw or hidden
elements have no text. Features of a block are its ancestors' tags and class words, and its text's
length, link share, punctuation and neighbours. The field has weights for (feature, state) and for
(state, state), is fitted by gradient ascent of the conditional likelihood (forward-backward), and
decoded by Viterbi. The article is the blocks in state 1, joined by one space.

Training pages are labelled by their semantic containers: a block is article text if it stands in an
`article` or `main` element and in no container of menus, headers, footers, sidebars, notices,
adverts, forms or comments. The field sees more than those names, so it also decides where they are
missing.

Character references are decoded once, white space in a block becomes one space. Null and empty pages
give empty text. Unclosed and stray tags are allowed. Pages are read whole. Extra columns are passed
through, but `text` and `n_chars`, which give way to the results; rows that repeat are each extracted; an
empty table gives an empty result (and a field without weights).
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Container, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements without main text: scripts and styles, drawings, inert parts, and parts of forms.
RAW = frozenset("script style template textarea select svg iframe title".split())
#: Of these the ones whose text runs to the page's end when their end tag is missing; the others' tags are skipped.
ENDLESS = frozenset("script style".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
OUTSIDE = frozenset("nav header footer aside form dialog menu button".split())
OUTSIDE_NAME = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|sidebar|menu|nav\w*|footer|header|comments?|cookie\w*|consent|notice|popup|share|social|related|newsletter|subscribe|breadcrumbs?|login|search)(?:$|[\s_-])", re.I)
OPEN = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][a-zA-Z0-9:-]*))")
ATTRIBUTE = re.compile(r"[^>\"']*")
NAMES = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: An end tag that is implied when another of these begins.
CLOSES = {"p": BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}


class Node:
    """An open element: its tag, its class, id and role in lower case, and the element around it. What
    all elements around it give to the features is kept, so deep nesting costs nothing a block; of
    these only `known` ones (those of the trained field), so a node's cost is bounded by them."""

    __slots__ = ("inside", "marks", "names", "outside", "parent", "tag")

    def __init__(self, tag: str, names: str, parent: Node | None, known: Container[str] | None = None):
        self.tag, self.names, self.parent = tag, names, parent
        own = frozenset([f"in={tag}", *(f"name={x}" for x in re.split(r"[\s_-]+", names) if x)])
        odd = bool(names and OUTSIDE_NAME.search(names))
        if odd:
            own |= {"name=outside"}
        if known is not None:
            own = frozenset(x for x in own if x in known)
        self.marks: frozenset[str] = own if parent is None else parent.marks if own <= parent.marks else parent.marks | own
        self.inside = tag in ("article", "main") or "main" in names.split() or (parent is not None and parent.inside)
        self.outside = tag in OUTSIDE or odd or (parent is not None and parent.outside)


@dataclass
class Leaf:
    text: str
    node: Node | None
    links: int = 0


class Tokens:
    """Tags of a page in order, each character read once: an unclosed quote or tag is ordinary text."""

    def __init__(self, page: str):
        self.page, self.dead = page, set()

    def _find(self, what: str, at: int) -> int:
        if what in self.dead:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.dead.add(what)  # nor is there one farther on
        return found

    def next(self, at: int) -> tuple[int, int, str | None, bool, str] | None:
        """(begin, end, tag or None for a comment, whether it closes, attributes) of the next tag."""
        while (m := OPEN.search(self.page, at)) is not None:
            if m[2] is None:
                long = m[0] == "<!--"
                stop = self._find("-->" if long else ">", m.end())
                if stop < 0 and not long:
                    return None
                return m.start(), len(self.page) if stop < 0 else stop + (3 if long else 1), None, False, ""
            end = m.end()
            while True:
                end = ATTRIBUTE.match(self.page, end).end()
                if end == len(self.page):
                    return None
                if self.page[end] == ">":
                    return m.start(), end + 1, m[2].lower(), bool(m[1]), self.page[m.end() : end]
                before = end - 1
                while self.page[before].isspace():
                    before -= 1
                # A quote opens a value only after an equals sign; elsewhere it is a character of a name.
                stop = self._find(self.page[end], end + 1) if self.page[before] == "=" else -1
                end = stop + 1 if stop >= 0 else end + 1
        return None


def leaves(page: str, known: Container[str] | None = None) -> list[Leaf]:
    out: list[Leaf] = []
    stack: list[Node] = []
    blocks: list[int] = []  # places of block elements in the stack
    opened: Counter[str] = Counter()
    parts: list[str] = []
    links, node, begun = 0, None, False
    tokens, endings = Tokens(page), {}

    def end() -> None:
        nonlocal links, node, begun
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Leaf(text, node if begun else stack[-1] if stack else None, links))
            parts.clear()
        links, node, begun = 0, None, False

    def take(raw: str) -> None:
        nonlocal links, node, begun
        if raw:
            if not begun and not raw.isspace():
                node, begun = stack[-1] if stack else None, True
            parts.append(raw)
            if opened["a"]:
                links += len(raw)

    def cut(at: int) -> None:
        for gone in stack[at:]:
            opened[gone.tag] -= 1
        del stack[at:]
        while blocks and blocks[-1] >= at:
            blocks.pop()

    at, n = 0, len(page)
    while at < n:
        m = tokens.next(at)
        if m is None:
            take(page[at:])
            break
        begin, stop, tag, closes, attributes = m
        take(page[at:begin])
        at = stop
        if tag is None:
            continue
        if closes:
            if tag in BLOCK:
                end()
            if opened[tag]:
                i = len(stack) - 1
                while stack[i].tag != tag:
                    i -= 1
                cut(i)
            continue
        if tag in RAW:
            if tag not in endings:
                endings[tag] = re.compile(rf"</{re.escape(tag)}\s*>", re.I)
            empty = tag == "svg" and attributes.rstrip().endswith("/")
            close = None if empty or endings[tag] is None else endings[tag].search(page, at)
            if close is None and not empty:
                endings[tag] = None  # nor is there one farther on
            at = close.end() if close else n if tag in ENDLESS else at
            parts.append(" ")
            continue
        if tag == "br" or tag == "hr":
            parts.append(" ")
        if tag in VOID:
            continue
        if tag in BLOCK:
            end()
            for i in reversed(blocks):
                name = stack[i].tag
                if tag in CLOSES.get(name, ()):
                    cut(i)
                    break
                if name != "p":
                    break
        names = " ".join(next(g for g in x if g or g == "") if any(x) else "" for x in NAMES.findall(attributes)) if attributes.strip() else ""
        if not attributes.rstrip().endswith("/"):
            if tag in BLOCK:
                blocks.append(len(stack))
            opened[tag] += 1
            stack.append(Node(tag, names.lower(), stack[-1] if stack else None, known))
    end()
    return out


def label(leaf: Leaf) -> int:
    return int(leaf.node is not None and leaf.node.inside and not leaf.node.outside)


def features(page: list[Leaf]) -> list[list[str]]:
    out = []
    for i, b in enumerate(page):
        words = b.text.split()
        f = {"bias", f"tag={b.node.tag if b.node else '-'}", f"n={min(int(np.log2(len(words) + 1)), 8)}"}
        if b.node:
            f |= b.node.marks
        f.add(f"links={min(int(4 * b.links / max(len(b.text), 1)), 4)}")
        f.add(f"stop={b.text[-1] in '.!?…'}")
        f.add(f"upper={b.text[:1].isupper()}")
        f.add("mark=copyright" if "©" in b.text else "mark=none")
        f.add(f"commas={min(b.text.count(','), 3)}")
        f.update(x for x, here in (("first", i == 0), ("last", i == len(page) - 1)) if here)
        out.append(sorted(f))
    return out


@dataclass(frozen=True)
class Field:
    index: dict[str, int] = field(default_factory=dict)
    weight: np.ndarray = field(default_factory=lambda: np.zeros((0, 2)))
    step: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))

    def scores(self, feats: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(feats), 2))
        for i, f in enumerate(feats):
            rows = [j for x in f if (j := self.index.get(x)) is not None]
            if rows:
                out[i] = self.weight[rows].sum(0)
        return out

    def decode(self, feats: list[list[str]]) -> list[int]:
        """The best sequence of states; of equals the one with 0 earlier."""
        if not feats:
            return []
        s = self.scores(feats).tolist()
        (s00, s01), (s10, s11) = self.step.tolist()
        a, b = s[0]
        back = []
        for x, y in s[1:]:
            ra, rb = a + s00 >= b + s10, a + s01 >= b + s11
            a, b = (a + s00 if ra else b + s10) + x, (a + s01 if rb else b + s11) + y
            back.append((0 if ra else 1, 0 if rb else 1))
        state = 0 if a >= b else 1
        out = [state]
        for r in reversed(back):
            state = r[state]
            out.append(state)
        return out[::-1]


def fit(pages: list[tuple[list[list[str]], list[int]]], rounds: int = 60, rate: float = 0.5, decay: float = 1e-3) -> Field:
    """Gradient ascent (AdaGrad) of the mean conditional log-likelihood."""
    index: dict[str, int] = {}
    for feats, _ in pages:
        for f in feats:
            for x in f:
                index.setdefault(x, len(index))
    w, step = np.zeros((len(index), 2)), np.zeros((2, 2))
    gw2, gs2 = np.full_like(w, 1e-8), np.full_like(step, 1e-8)
    rows = [[np.array([index[x] for x in f]) for f in feats] for feats, _ in pages]
    for _ in range(rounds if pages else 0):
        gw, gs = np.zeros_like(w), np.zeros_like(step)
        for own, (_, y) in zip(rows, pages, strict=True):
            n = len(own)
            if not n:
                continue
            s = np.stack([w[r].sum(0) for r in own])
            alpha, beta = np.empty((n, 2)), np.zeros((n, 2))
            alpha[0] = s[0]
            for i in range(1, n):
                alpha[i] = s[i] + np.logaddexp(alpha[i - 1, 0] + step[0], alpha[i - 1, 1] + step[1])
            for i in range(n - 2, -1, -1):
                t = s[i + 1] + beta[i + 1]
                beta[i] = np.logaddexp(step[:, 0] + t[0], step[:, 1] + t[1])
            z = np.logaddexp(*alpha[-1])
            p = np.exp(alpha + beta - z)
            p[np.arange(n), y] -= 1
            for i in range(n):
                gw[own[i]] -= p[i]
            for i in range(1, n):
                gs -= np.exp(alpha[i - 1][:, None] + step + (s[i] + beta[i])[None, :] - z)
                gs[y[i - 1], y[i]] += 1
        gw, gs = gw / len(pages) - decay * w, gs / len(pages) - decay * step
        gw2, gs2 = gw2 + gw**2, gs2 + gs**2
        w, step = w + rate * gw / np.sqrt(gw2), step + rate * gs / np.sqrt(gs2)
    return Field(index, w, step)


def train(df: DataFrame, key: str = "page_id", page: str = "html", most: int = 120, seed: int = 7) -> Field:
    """A field fitted on the first `most` pages in a hashed order: a bounded sample."""
    rows = df.select(F.col(key).alias("k"), F.col(page).cast("string").alias("h")).where(F.length("h") > 0)
    drawn = rows.select("k", F.xxhash64("h", F.lit(seed)).alias("r")).orderBy("r", "k").limit(most)
    got = sorted(r["h"] for r in rows.withColumn("r", F.xxhash64("h", F.lit(seed))).join(F.broadcast(drawn.select("k", "r").distinct()), ["k", "r"]).select("h").collect())
    read = [leaves(x) for x in got[:most]]
    return fit([(features(x), [label(b) for b in x]) for x in read])


def article(crf: Field, page: str | None) -> str:
    blocks = leaves(page or "", crf.index)
    return " ".join(b.text for b, s in zip(blocks, crf.decode(features(blocks)), strict=True) if s)


def extract(df: DataFrame, crf: Field, key: str = "page_id", page: str = "html") -> DataFrame:
    """All columns of df but the page, with text and n_chars. One narrow stage."""
    rest = [c for c in df.columns if c not in (page, "text", "n_chars")]
    column = next(c for c in ("_html" + "_" * i for i in range(len(rest) + 1)) if c not in rest)
    shared = df.sparkSession.sparkContext.broadcast(crf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                text = [article(shared.value, h) for h in part.column(column).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], [*rest, "text", "n_chars"])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest)
    return df.select(*[F.col(f"`{c}`") for c in rest], F.col(page).cast("string").alias(column)).mapInArrow(run, f"{kinds}, text string, n_chars long")
