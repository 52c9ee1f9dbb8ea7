"""Repair of conversations by weighted interval parsing.

A conversation is well formed if the initials of its roles read ``(s?(ua)+)?``. In a grammar of
binary rules X(p,r) -> X(p,q) X(q,r) a nonterminal X(p,r) stands for rows that lead from place p
of that form to place r; a row gives X by being kept, given another role or deleted, and the
closure under insertion lets rows be put in before and behind it. A cell of the chart holds, for
one span of rows, the least (cost, audit) of each nonterminal, the audit being the initials of
the edits. Cells are combined bottom-up by span length: all spans of a block of ``BLOCK`` rows
with all their splits, then the blocks by doubling.

The rules make this enough. All splits of a span give the same cell, since X(p,r) may be split
at any q. Two audits of equal cost for one span never start one another (what the longer had more
would be insertions, which cost), so the least of both parts is the least of the whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns_apart, is_empty, stage

#: What edits cost; an undeleted truncated row adds TRUNCATED.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Places of the form: start, after s, after u, after a. The step (p, initial) leads to a place.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
PLACES, ENDS = 4, (0, 3)
BLOCK = 8
#: Spans whose cells a worker remembers; beyond it starts anew, which changes speed only.
CACHE = 100_000
SPACE = " \t\n\x0b\x0c\r"
ROLES = {"u": "user", "a": "assistant"}
REPAIRED = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"

Cell = dict[tuple[int, int], tuple[int, str]]


# ------------------------------------------------------------------ the chart


def combined(left: Cell, right: Cell) -> Cell:
    """The cell of two spans in a row."""
    out: Cell = {}
    for (p, q), (cost, audit) in left.items():
        for r in range(PLACES):
            if (end := right.get((q, r))) is not None:
                new = cost + end[0]
                old = out.get((p, r))
                if old is None or new < old[0] or new == old[0] and audit + end[1] < old[1]:
                    out[p, r] = (new, audit + end[1])
    return out


def _insertions() -> Cell:
    """The cell of no rows: ways between places by inserted users and assistants."""
    out: Cell = {(p, p): (0, "") for p in range(PLACES)}
    for _ in range(PLACES):
        for (p, q), (cost, audit) in list(out.items()):
            for c in ROLES:
                if (r := STEPS.get((q, c))) is not None and (cost + INSERT, audit + "I") < out.get((p, r), (cost + INSERT + 1, "")):
                    out[p, r] = (cost + INSERT, audit + "I")
    return out


NO_ROWS = _insertions()


def row_cell(kind: str) -> Cell:
    """The cell of one row, closed under insertion.

    Kinds are the role's initial (x for any but s, u, a), upper case if truncated, and - for a
    row that must go.
    """
    found: Cell = {(p, p): (DELETE, "D") for p in range(PLACES)}
    if kind != "-":
        more = TRUNCATED if kind.isupper() else 0
        for (p, c), q in STEPS.items():
            ways = [(more, "K")] if c == kind.lower() else []
            ways += [(more + REROLE, "R")] if c in ROLES else []
            for way in ways:
                found[p, q] = min(way, found.get((p, q), way))
    return combined(combined(NO_ROWS, found), NO_ROWS)


class Chart:
    """Cells by the kinds of a span's rows, which is all they depend on."""

    def __init__(self):
        self.cells: dict[str, Cell] = {}

    def block(self, kinds: str) -> Cell:
        """The cell of a block: all its spans, short ones first, each from all its splits."""
        cells = self.cells
        if kinds in cells:
            return cells[kinds]
        if len(cells) > CACHE:
            cells.clear()
        for n in range(1, len(kinds) + 1):
            for at in range(len(kinds) - n + 1):
                span = kinds[at : at + n]
                if span not in cells:
                    cells[span] = row_cell(span) if n == 1 else least(combined(cells[span[:k]], cells[span[k:]]) for k in range(1, n))
        return cells[kinds]


def least(found: Iterator[Cell]) -> Cell:
    out: Cell = {}
    for cell in found:
        for key, way in cell.items():
            if key not in out or way < out[key]:
                out[key] = way
    return out


class Parse:
    """The cells of one conversation, fed with the kinds of its rows; holds a cell a power of two of blocks."""

    def __init__(self, chart: Chart):
        self.chart, self.kinds, self.spans = chart, [], []

    def add(self, kind: str) -> None:
        self.kinds.append(kind)
        if len(self.kinds) == BLOCK:
            self._close()

    def _close(self) -> None:
        n, cell = 1, self.chart.block("".join(self.kinds))
        self.kinds.clear()
        while self.spans and self.spans[-1][0] == n:  # spans of equal length become one of twice the length
            n, cell = 2 * n, combined(self.spans.pop()[1], cell)
        self.spans.append((n, cell))

    def result(self) -> tuple[int, str]:
        """(cost, audit) of the cheapest repair, ties to the least audit."""
        tail = self.chart.block("".join(self.kinds)) if self.kinds else NO_ROWS
        for _, cell in reversed(self.spans):
            tail = combined(cell, tail)
        return min(tail[0, end] for end in ENDS if (0, end) in tail)


# ------------------------------------------------------------------ rows


def damaged(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The rows after the damage that the crc32 of ``conv_id:turn`` decides, with ``gone`` for dropped ones and ``copy`` for repeats.

    A null anywhere in that key, in role or in text counts as one space.
    """
    rows = columns_apart(conversations, conv_col, turn_col, role_col, text_col).toDF("conv_id", "turn", "role", "text")
    rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    how = rows.withColumn("how", F.crc32(key.cast("binary")) % 20)
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("how") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("how") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return how.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("how") == 0).alias("gone"), copies.alias("copy"))


def with_faults(rows: DataFrame) -> DataFrame:
    """Each row's first ``fault`` (b, d, t or empty) and its ``kind`` for the chart; rows of a conversation stand together and in order.

    Order: dropped rows last, turns with nulls first, then role and text, so that the order is
    the same in every run. One exchange by conversation serves the search for duplicates too.
    """
    dealt = rows.repartition("conv_id").withColumn("digest", F.sha2(F.encode("text", "utf-8"), 256))
    seen = Window.partitionBy("conv_id", "gone", "role", "digest").orderBy("turn", "copy")
    bare = F.rtrim("text", F.lit(SPACE))
    fault = F.when(bare == "", "b").when(F.row_number().over(seen) > 1, "d").when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "t").otherwise("")
    first = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("x")
    found = dealt.withColumn("fault", fault)
    kind = F.when(F.col("fault").isin("b", "d"), "-").when(F.col("fault") == "t", F.upper(first)).otherwise(first)
    return found.select("conv_id", "gone", "turn", "role", "text", "copy", "fault", kind.alias("kind")).sortWithinPartitions("conv_id", "gone", "turn", "role", "text", "copy")


class Repaired:
    """SHA-256 of the repaired ``role:text`` lines, fed with the rows that the audit speaks of."""

    def __init__(self, audit: str):
        self.audit, self.at, self.place = audit, 0, 0
        self.sha, self.lines = hashlib.sha256(), 0

    def _write(self, role: str, text: str) -> None:
        self.sha.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode("utf-8", "replace"))
        self.lines += 1
        self.place = STEPS[self.place, role[:1]]

    def _insert(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self._write(self._next_role(), "")
            self.at += 1

    def _next_role(self) -> str:
        return ROLES["a" if self.place == 2 else "u"]

    def add(self, role: str, text: str) -> None:
        self._insert()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            self._write(role if edit == "K" else self._next_role(), text)

    def digest(self) -> str:
        self._insert()
        return self.sha.hexdigest()


class Conversation:
    """What is counted while a conversation's rows pass by; texts are held up to a bound."""

    def __init__(self, conv_id: int | None, chart: Chart, most_held: int):
        self.conv_id, self.parse, self.most_held = conv_id, Parse(chart), most_held
        self.faults = {"b": 0, "d": 0, "t": 0, "": 0}
        self.illegal = self.turns = self.size = 0
        self.before = self.least = self.last = None
        self.held: list[tuple[str, str]] | None = []

    def add(self, turn: int | None, role: str, text: str, fault: str, kind: str) -> None:
        self.faults[fault] += 1
        if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = role[:1]
        if turn is not None and turn != self.last:  # turns come in order
            self.least = turn if self.turns == 0 else self.least
            self.last, self.turns = turn, self.turns + 1
        self.parse.add(kind)
        if self.held is not None:
            self.held.append((role, text))
            self.size += len(role) + len(text) + 100
            if self.size > self.most_held:
                self.held = None

    def result(self) -> tuple:
        cost, audit = self.parse.result()
        gaps = self.last - self.least + 1 - self.turns if self.turns else 0
        sha = None
        if self.held is not None:
            repaired = Repaired(audit)
            for role, text in self.held:
                repaired.add(role, text)
            sha = repaired.digest()
        return (self.conv_id, gaps, *[self.faults[f] for f in "bdt"], self.illegal, cost, audit, sha)


#: Characters of one conversation that a task holds till the parse is known.
MOST_HELD = 1 << 24


def repair(conversations: DataFrame, most_held: int = MOST_HELD) -> DataFrame:
    """Per original conv_id (a null one too): ``REPAIRED`` and repaired_sha256, of the damaged rows.

    Extra columns are ignored, repeated rows count each, an empty table gives an empty result, a
    conversation with no rows after the damage zeros, an empty audit and the hash of nothing.
    Rows are read as a stream: a task holds a conversation's texts only up to ``most_held``
    characters. Longer conversations are streamed again once their audit is known.
    """
    rows = with_faults(damaged(conversations))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chart, now, out = Chart(), None, []
        for b in batches:
            for conv, gone, turn, role, text, fault, kind in zip(*[c.to_pylist() for c in b.columns]):
                if now is None or now.conv_id != conv:
                    out += [now.result()] if now else []
                    now = Conversation(conv, chart, most_held)
                if not gone:
                    now.add(turn, role, text, fault, kind)
            yield _batch(out)
            out = []
        yield _batch([now.result()] if now else [])

    found = stage(rows.select("conv_id", "gone", "turn", "role", "text", "fault", "kind").mapInArrow(run, f"{REPAIRED}, repaired_sha256 string"), "repaired")
    late = found.where("repaired_sha256 IS NULL").drop("repaired_sha256")
    if is_empty(late):
        return found
    return found.where("repaired_sha256 IS NOT NULL").unionByName(late.join(_streamed_hashes(conversations, late), F.col("conv_id").eqNullSafe(F.col("hashed")), "left").drop("hashed"))


def _streamed_hashes(conversations: DataFrame, late: DataFrame) -> DataFrame:
    """``(hashed, repaired_sha256)`` of the conversations of ``late``: the audit comes first, then the rows in order."""
    ids = late.select(F.col("conv_id").alias("wanted"))
    rows = damaged(conversations).where("not gone").join(ids, F.col("conv_id").eqNullSafe(F.col("wanted")), "left_semi")
    head = late.select("conv_id", F.lit(0).alias("part"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(0).alias("copy"))
    body = rows.select("conv_id", F.lit(1).alias("part"), "turn", "role", "text", "copy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []
        done = lambda: pa.RecordBatch.from_pylist([{"hashed": c, "repaired_sha256": r.digest()} for c, r in out], schema=pa.schema([("hashed", pa.int64()), ("repaired_sha256", pa.string())]))
        for b in batches:
            for conv, part, role, text in zip(*[c.to_pylist() for c in b.columns]):
                if part == 0:
                    out += [now] if now else []
                    now = (conv, Repaired(text))
                else:
                    now[1].add(role, text)
            yield done()
            out = []
        out += [now] if now else []
        yield done()

    ordered = head.unionByName(body).repartition("conv_id").sortWithinPartitions("conv_id", "part", "turn", "role", "text", "copy")
    return ordered.select("conv_id", "part", "role", "text").mapInArrow(run, "hashed long, repaired_sha256 string")


_SCHEMA = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in f"{REPAIRED}, repaired_sha256 string".split(", ")])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(_SCHEMA)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA)], schema=_SCHEMA)
