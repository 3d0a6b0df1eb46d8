"""Repair of conversation structure by error-correcting Earley parsing.

A sound conversation is (system? (user assistant)+)?, written as a left-linear grammar over the
initials of roles. The parser keeps, for every dotted rule, the least (cost, audit) with which the
rows so far can be brought there: a row may be kept (K), given another role (R) or deleted (D), and
turns with empty text may be inserted (I) anywhere. The completed start rule gives the repair.

As every rule begins at the first row, a chart column needs only the one before. What a column does
with a row depends on the differences of its costs, on the order of its audits and on the row's
initial and faults, so each such step is worked out once and then looked up; audits of one column
all end in K, R or D after the same number of rows, so none begins another, and their order is kept
as a rank. Every item carries the running SHA-256 of its repaired rows, which is why a conversation
is read in order, but as a stream: memory holds one batch, the column, and one byte a row of audit.

Rows of one turn stand by role, then text; null turns come first; null roles and texts are one space.
A role without a first letter, or with another than s, u or a, fits nowhere. Equal rows of one
turn are duplicates. A null conversation is a conversation of its own. An empty table gives an empty
result. Extra columns are ignored, and no column is added to them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairbench.llm.textkit import tidy

#: Left-linear rules: (left side, right side). Lower-case letters are initials of roles.
RULES = (("S", ""), ("S", "T"), ("H", ""), ("H", "s"), ("U", "Hu"), ("U", "Tu"), ("T", "Ua"))
NAMES = {"u": "user", "a": "assistant"}
RETYPE, DELETE, INSERT, CUT = 3, 4, 3, 3
BLANK, DUPLICATE, TRUNCATED, SOUND = 1, 2, 3, 0
_SPACE = r"\x20\x09-\x0D"


def _expand(column: list[tuple]) -> dict:
    """All items that a column of (item, cost, rank) reaches without a row, by completion and
    insertion: item -> ((cost, rank, inserted letters), parent place). Cheapest items go first."""
    best: dict = {}
    todo = [((cost, rank, "", place), item) for place, (item, cost, rank) in enumerate(column)]
    while todo:
        value, item = min(todo)
        todo.remove((value, item))
        if item in best:
            continue
        best[item] = value
        (rule, dot), (cost, rank, inserted, place) = item, value
        left, right = RULES[rule]
        if dot == len(right):
            todo += [(value, (i, 1)) for i, (_, r) in enumerate(RULES) if r[:1] == left]
        elif right[dot] in NAMES:
            todo.append(((cost + INSERT, rank, inserted + right[dot], place), (rule, dot + 1)))
    return best


def _begin() -> list[tuple]:
    """The column before the first row: the rules that can begin with it, or with nothing."""
    return [((i, 0), 0, 0) for i, (_, r) in enumerate(RULES) if not r or r[0].islower()]


def _audit(inserted: str, letter: str = "") -> str:
    return "I" * len(inserted) + letter


def _step(column: list[tuple], initial: str, fault: int) -> tuple[int, list[tuple], list[tuple]]:
    """One row: (cost added to all, next column, for each of its items (parent, inserted, letter,
    new role)). Costs of a column are relative to its least."""
    found: dict = {}

    def offer(item, cost, value, letter, role=""):
        _, rank, inserted, place = value
        new = (cost, rank, _audit(inserted, letter), place, inserted, letter, role)
        if item not in found or new[:3] < found[item][:3]:
            found[item] = new

    for (rule, dot), value in _expand(column).items():
        left, right = RULES[rule]
        want = right[dot] if dot < len(right) else ""
        if want.islower() or (not want and left == "S"):
            offer((rule, dot), value[0] + DELETE, value, "D")
        if want.islower() and fault not in (BLANK, DUPLICATE):
            extra = CUT if fault == TRUNCATED else 0
            if want == initial:
                offer((rule, dot + 1), value[0] + extra, value, "K")
            elif want in NAMES:
                offer((rule, dot + 1), value[0] + extra + RETYPE, value, "R", want)
    least = min(x[0] for x in found.values())
    order = {key: i for i, key in enumerate(sorted({x[1:3] for x in found.values()}))}
    items = sorted(found)
    return (
        least,
        [(i, found[i][0] - least, order[found[i][1:3]]) for i in items],
        [found[i][3:] for i in items],
    )


def _finish(column: list[tuple]) -> tuple[int, int, str]:
    """(cost, parent place, inserted letters) of the cheapest complete conversation."""
    ends = [v for (rule, dot), v in _expand(column).items() if RULES[rule][0] == "S" and dot == len(RULES[rule][1])]
    cost, _, inserted, place = min(ends, key=lambda v: (v[0], v[1], _audit(v[2])))
    return cost, place, inserted


class Parser:
    """Steps that were met before, and the running state of one conversation."""

    def __init__(self):
        self.columns: dict[tuple, int] = {}
        self.items: list[list[tuple]] = []
        self.steps: dict[tuple, tuple] = {}
        self.ends: dict[int, tuple] = {}
        self.first = self._number(_begin())
        self.reset()

    def _number(self, column: list[tuple]) -> int:
        key = tuple(column)
        if key not in self.columns:
            self.columns[key] = len(self.items)
            self.items.append(column)
        return self.columns[key]

    def reset(self) -> None:
        self.at, self.cost = self.first, 0
        # For each item: finished pieces of the audit, its last piece, and the hash (None: nothing written).
        self.state = [((), "", None)] * len(self.items[self.first])

    @staticmethod
    def _write(digest, parts: list[bytes]):
        digest = hashlib.sha256() if digest is None else digest.copy()
        digest.update(b"\n".join(parts))
        return digest

    def _grown(self, state: tuple, inserted: str, letter: str, parts: list[bytes]) -> tuple:
        pieces, tail, digest = state
        tail += _audit(inserted, letter)
        if len(tail) > 4096:
            pieces, tail = (pieces, tail), ""
        if parts:
            digest = self._write(digest, parts if digest is None else [b"", *parts])
        return pieces, tail, digest

    def row(self, role: str, text: str, fault: int) -> None:
        initial = role[:1] if role[:1] in ("s", "u", "a") else ""
        step = self.steps.get((self.at, initial, fault))
        if step is None:
            added, column, how = _step(self.items[self.at], initial, fault)
            step = self.steps[self.at, initial, fault] = added, self._number(column), how
        added, self.at, how = step
        self.cost += added
        data, own, state = text.encode(), f"{role}:".encode(), []
        for place, inserted, letter, new in how:
            parts = [f"{NAMES[x]}:".encode() for x in inserted]
            if letter != "D":
                parts.append((f"{NAMES[new]}:".encode() if new else own) + data)
            state.append(self._grown(self.state[place], inserted, letter, parts))
        self.state = state

    def end(self) -> tuple[int, str, str]:
        """(cost, audit, SHA-256 of the repaired rows)."""
        got = self.ends.get(self.at)
        if got is None:
            got = self.ends[self.at] = _finish(self.items[self.at])
        cost, place, inserted = got
        pieces, tail, digest = self._grown(self.state[place], inserted, "", [f"{NAMES[x]}:".encode() for x in inserted])
        while pieces:
            pieces, piece = pieces
            tail = piece + tail
        return self.cost + cost, tail, (digest or hashlib.sha256()).hexdigest()


def damage(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, there): rows dropped by the damage stay as rows that are not there,
    so that no conversation is lost."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(word(conv), F.lit(":"), word(turn)).cast("binary")) % 20
    body = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(word(text), "[.!?]", "")).otherwise(word(text))
    who = F.when(kind == 4, "user").otherwise(word(role))
    copies = F.when(kind == 3, F.array(F.lit(True), F.lit(True))).otherwise(F.array(kind != 0))
    names = [F.col(conv).alias("conv"), F.col(turn).alias("turn"), who.alias("role"), body.alias("text")]
    return df.select(*names, F.explode(copies).alias("there"))


def _faults(rows: DataFrame) -> DataFrame:
    """rows with `fault`: the first of blank, duplicate and truncated, else sound."""
    last: Column = F.regexp_extract("text", rf"([^{_SPACE}])[{_SPACE}]*\z", 1)
    # An equal row of the same conversation before it; the rows of a conversation are in one partition already.
    seen = Window.partitionBy("conv", "there", "role", F.sha2("text", 256)).orderBy("turn")
    return rows.withColumn("fault", F.when(last == "", BLANK).when(F.row_number().over(seen) > 1, DUPLICATE).when(~last.isin(".", "!", "?"), TRUNCATED).otherwise(SOUND))


def repair(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", there: str | None = None) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) for every
    conversation of df. Rows for which the boolean column `there` is false only name their
    conversation. One shuffle; a conversation is one stream through one task, because the hash of
    its rows can only be taken in order."""
    kind = df.schema[conv].dataType.simpleString()
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    here = F.col(there) if there else F.lit(True)
    rows = df.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), word(role).alias("role"), word(text).alias("text"), here.alias("there"))
    rows = _faults(rows.repartition("conv")).sortWithinPartitions("conv", "turn", "role", "text")
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser, now, out = Parser(), None, []

        def close():
            n, low, high, _, _, counts, illegal = now[1:]
            cost, audit, digest = parser.end()
            gaps = high - low + 1 - n if n else 0
            out.append((now[0], gaps, *counts, illegal, cost, audit, digest))
            parser.reset()

        def flush():
            cols = list(zip(*out, strict=True))
            data = [pa.array(cols[0], _arrow(batch.schema.field(0).type)), *(pa.array(c, pa.int64()) for c in cols[1:7]), pa.array(cols[7], pa.string()), pa.array(cols[8], pa.string())]
            out.clear()
            return pa.RecordBatch.from_arrays(data, [conv, *names, "audit", "repaired_sha256"])

        batch = None
        for batch in batches:
            for key, at, who, body, here, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or key != now[0]:
                    if now is not None:
                        close()
                    # conversation, distinct turns, least, greatest, last turn, last initial, faults, illegal
                    now = [key, 0, None, None, None, None, [0, 0, 0], 0]
                if not here:
                    continue
                if at is not None and at != now[4]:
                    now[1], now[2], now[3], now[4] = now[1] + 1, at if now[2] is None else now[2], at, at
                if fault:
                    now[6][fault - 1] += 1
                if now[5] is not None:
                    now[7] += now[5] + who[:1] not in ("su", "ua", "au")
                now[5] = who[:1]
                parser.row(who, body, fault)
            if len(out) >= 4096:
                yield flush()
        if now is not None:
            close()
        if out:
            yield flush()

    schema = f"`{conv}` {kind}, " + ", ".join(f"{n} long" for n in names) + ", audit string, repaired_sha256 string"
    return rows.mapInArrow(tidy(run), schema)


def _arrow(kind: pa.DataType) -> pa.DataType:
    return pa.string() if pa.types.is_string(kind) or pa.types.is_large_string(kind) else kind
