"""Repair of the turn structure of conversations: the cheapest edits that make roles alternate.

A conversation is in order when its role initials read ``(s?(ua)+)?``. Its rows pass through a Viterbi search over four
states; edits are given out as soon as all survivors share them.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallmat.llm.common import saved, small_batches
from tallmat.operators.ordering import number_rows

WHITE = " \t\n\x0b\x0c\r"
# What an edit costs, and what an undeleted truncated row costs besides.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
# States by what was said last: nothing yet, the system, the user, the assistant. A conversation may end in those of ENDS.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ENDS = {NOTHING: "", ASSISTANT: "", USER: "a", SYSTEM: "ua"}
# Who may be inserted after each state, and the state then.
INSERTS = {
    NOTHING: {"": NOTHING, "u": USER, "ua": ASSISTANT},
    SYSTEM: {"": SYSTEM, "u": USER, "ua": ASSISTANT},
    USER: {"": USER, "a": ASSISTANT},
    ASSISTANT: {"": ASSISTANT, "u": USER},
}
# EXCHANGE[y][x]: what it costs at most to go on from y as if from x: a missing turn is inserted, a system row deleted.
EXCHANGE = {
    NOTHING: {NOTHING: 0, SYSTEM: 0, USER: 5, ASSISTANT: 0},
    SYSTEM: {NOTHING: 10, SYSTEM: 0, USER: 5, ASSISTANT: 10},
    USER: {NOTHING: 7, SYSTEM: 5, USER: 0, ASSISTANT: 5},
    ASSISTANT: {NOTHING: 2, SYSTEM: 0, USER: 5, ASSISTANT: 0},
}
# Rows of a conversation whose symbols travel as one string.
BLOCK = 4096
# A row's symbol tells its role's initial and whether it is sound, truncated, or must go.
INITIALS, CLASSES = "sua?", 3


class Move(NamedTuple):
    """A way over one row: from a state to a state, its cost, its edits and the initials of what is then said."""

    before: int
    after: int
    cost: int
    edits: str
    says: str


def _spoken(state: int, initial: str) -> int | None:
    """The state after a turn of ``initial``, or None where such a turn may not follow."""
    if initial == "s":
        return SYSTEM if state == NOTHING else None
    if initial == "u":
        return USER if state != USER else None
    return ASSISTANT if initial == "a" and state == USER else None


@cache
def moves(symbol: str) -> tuple[Move, ...]:
    """All ways over a row: turns inserted before it, then the row kept, given another role, or deleted."""
    initial, kind = INITIALS[ord(symbol[0]) // CLASSES % 4], ord(symbol[0]) % CLASSES
    best: dict[tuple[int, int], Move] = {}
    for before, inserted in INSERTS.items():
        for says, between in inserted.items():
            cost, edits = INSERT * len(says), "I" * len(says)
            ways = [Move(before, between, cost + DELETE, edits + "D", says)]
            if kind != 2:
                late = cost + (TRUNCATED if kind == 1 else 0)
                ways += [Move(before, n, late, edits + "K", says + initial) for n in [_spoken(between, initial)] if n is not None]
                other = "a" if between == USER else "u"
                ways.append(Move(before, _spoken(between, other), late + REROLE, edits + "R", says + other))
            for way in ways:
                key = (way.before, way.after)
                if key not in best or (way.cost, way.edits) < (best[key].cost, best[key].edits):
                    best[key] = way
    return tuple(best.values())


def symbol_of(initial: Column, truncated: Column, removed: Column) -> Column:
    """One character for what the search needs to know of a row; codes follow ``INITIALS`` and ``CLASSES``."""
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    kind = F.when(removed, 2).when(truncated, 1).otherwise(0)
    return F.char(F.lit(96) + role * CLASSES + kind)


class _Node:
    """The edits of one row on a survivor's way; lives while something leads on from it."""

    __slots__ = ("edits", "kids", "parent", "says")

    def __init__(self, parent: _Node | None, edits: str, says: str) -> None:
        self.parent, self.edits, self.says, self.kids = parent, edits, says, []


class Survivors:
    """The cheapest way to each state, as paths of a tree of back pointers.

    The length of a node's list of kids is its reference count: a way that died frees its nodes up to the
    first one in use. When the root has a single kid, all survivors agree on its edits, which are given out, and the
    root moves on. So memory holds what is still open, not the conversation. A survivor that costs more than another
    one's way to imitate it can never win and ends at once, without which "delete everything" would stay open for ever.

    Ties go to the least edits in ASCII order, over the whole open suffixes. Two survivors' edits cover the same rows and
    end with a row's own edit, so neither begins with the other, and what differs now decides later comparisons as well:
    the order of survivors is kept as ranks and equals that of their whole suffixes.
    """

    def __init__(self) -> None:
        self.root = _Node(None, "", "")
        self.alive = {NOTHING: (0, 0, self.root)}

    def push(self, symbol: str) -> None:
        best: dict[int, tuple[tuple[int, int, str], _Node, str]] = {}
        for move in moves(symbol):
            if move.before in self.alive:
                cost, rank, node = self.alive[move.before]
                key = (cost + move.cost, rank, move.edits)
                if move.after not in best or key < best[move.after][0]:
                    best[move.after] = (key, node, move.says)
        useful = [x for x in best if all(best[y][0][0] + EXCHANGE[y][x] >= best[x][0][0] for y in best)]
        former, self.alive = [node for _, _, node in self.alive.values()], {}
        for rank, state in enumerate(sorted(useful, key=lambda x: best[x][0][1:])):
            (cost, _, edits), parent, says = best[state]
            node = _Node(parent, edits, says)
            parent.kids.append(node)
            self.alive[state] = (cost, rank, node)
        for node in former:
            while not node.kids and node.parent is not None:
                node.parent.kids.remove(node)
                node = node.parent

    def resolved(self) -> Iterator[tuple[str, str]]:
        """Edits that all survivors share, but for the last row, which trailing turns may join."""
        while len(self.root.kids) == 1 and self.root.kids[0].kids:
            self.root = self.root.kids[0]
            self.root.parent = None
            yield self.root.edits, self.root.says

    def finish(self) -> Iterator[tuple[str, str]]:
        """The edits that were open, of the cheapest way that ends in order."""
        ends = [(cost + INSERT * len(ENDS[s]), rank, "I" * len(ENDS[s]), ENDS[s], node) for s, (cost, rank, node) in self.alive.items()]
        _, _, edits, says, node = min(ends, key=lambda e: e[:3])
        way = []
        while node is not self.root:
            way.append((node.edits, node.says))
            node = node.parent
        if way:
            way[0] = (way[0][0] + edits, way[0][1] + says)
        yield from reversed(way)


FOUND = pa.schema([("position", pa.int64()), ("edits", pa.string()), ("says", pa.string()), ("illegal", pa.bool_())])


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits per row, from blocks of symbols in order of conversation; only open rows are held."""
    nobody = object()
    talk, survivors, open_rows, last, out = nobody, Survivors(), deque(), None, []

    def give(edits: Iterator[tuple[str, str]]) -> None:
        for e, says in edits:
            position, illegal = open_rows.popleft()
            out.append((position, e, says, illegal))

    def batch() -> pa.RecordBatch:
        columns = [pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), FOUND, strict=True)]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, schema=FOUND)

    for blocks in batches:
        for conv, positions, symbols in zip(*(blocks.column(i).to_pylist() for i in range(3)), strict=True):
            if conv != talk:
                give(survivors.finish())
                talk, survivors, last = conv, Survivors(), None
            for position, symbol in zip(positions, symbols, strict=True):
                initial = INITIALS[ord(symbol) // CLASSES % 4]
                open_rows.append((position, last is not None and last + initial not in ("su", "ua", "au")))
                last = initial
                survivors.push(symbol)
                give(survivors.resolved())
            if len(out) >= BLOCK:
                yield batch()
    give(survivors.finish())
    if out:
        yield batch()


def _hash_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits and digest of each conversation, from its edited rows in order; lines are hashed as they come."""
    schema = pa.schema([("first", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    now, audit, digest, lines = None, [], hashlib.sha256(), 0

    def row() -> tuple[int, str, str]:
        return now, "".join(audit), digest.hexdigest()

    for rows in batches:
        done = []
        for i in range(rows.num_rows):
            first, edits, says = (rows.column(c)[i].as_py() for c in range(3))
            if first != now:
                if now is not None:
                    done.append(row())
                now, audit, digest, lines = first, [], hashlib.sha256(), 0
            audit.append(edits)
            for line in rows.column(3)[i].as_py():
                digest.update((b"\n" if lines else b"") + line.encode("utf-8", "surrogatepass"))
                lines += 1
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], schema=schema)
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c]) for c in row()], schema=schema)


def judged(conversations: DataFrame) -> DataFrame:
    """``(position, first, conv_id, turn, role, text, fault, edits, says, illegal)``: each row with its fault and edits.

    ``first`` is the position of its conversation's first row. ``fault`` is blank, duplicate, truncated or null. ``edits``
    are I for each turn inserted before the row (after the last one also behind it), then K, R or D for the row; ``says``
    are the role initials of what these leave. Saved, as callers read it more than once.

    Rows of a conversation count in order of turn, nulls first, equal turns by role, then text. Null roles and texts are one
    space; rows with a null ``conv_id`` form a conversation of their own. An empty table gives no rows; other columns
    are not read. A long conversation is numbered and its faults are found in many tasks; the search sees one
    character per row and holds the rows that are still open.
    """
    small_batches(conversations.sparkSession)
    plain = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")
    )
    order = F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")
    rows = saved(number_rows(plain, *order, name="position"))
    final = F.substring(F.rtrim("text", F.lit(WHITE)), -1, 1)
    facts = rows.select(
        "position", "conv_id", F.substring("role", 1, 1).alias("initial"), final.alias("final"),
        F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256).alias("content"),
    )
    sound = F.col("final") != ""
    originals = facts.where(sound).groupBy("conv_id", "content").agg(F.min("position").alias("position")).select("position", F.lit(True).alias("new"))
    fault = (
        F.when(~sound, "blank").when(F.col("new").isNull(), "duplicate").when(~F.col("final").isin(".", "!", "?"), "truncated")
    )
    faults = facts.join(originals, "position", "left").select("position", "conv_id", "initial", fault.alias("fault"))
    removed = F.coalesce(F.col("fault").isin("blank", "duplicate"), F.lit(False))
    truncated = F.coalesce(F.col("fault") == "truncated", F.lit(False))
    told = saved(faults.select("position", "conv_id", "fault", symbol_of(F.col("initial"), truncated, removed).alias("symbol")))
    blocks = (
        told.groupBy("conv_id", F.floor(F.col("position") / BLOCK).alias("block"))
        .agg(F.array_sort(F.collect_list(F.struct("position", "symbol"))).alias("rows"))
        .select("conv_id", F.col("rows.position").alias("positions"), F.array_join("rows.symbol", "").alias("symbols"))
    )
    together = blocks.repartition("conv_id").sortWithinPartitions("conv_id", F.col("positions")[0])
    edits = together.mapInArrow(_search, "position long, edits string, says string, illegal boolean")
    firsts = told.groupBy(F.col("conv_id").alias("of")).agg(F.min("position").alias("first"))
    found = told.select("position", "conv_id", "fault").join(firsts, F.col("conv_id").eqNullSafe(F.col("of"))).select("position", "first", "fault")
    return saved(rows.join(found, "position").join(edits, "position").select(
        "position", "first", "conv_id", "turn", "role", "text", "fault", "edits", "says", "illegal"
    ))


def _spoken_rows(judgement: DataFrame) -> Column:
    """What the edits of a row leave, in order: kept and re-roled turns with the row's text, inserted ones with none."""
    said = F.filter(F.split("edits", ""), lambda e: ~e.isin("D", ""))
    names = F.transform(F.split("says", ""), lambda s: F.when(s == "u", F.lit("user")).when(s == "a", F.lit("assistant")))
    return F.transform(
        said,
        lambda e, i: F.struct(
            F.when(e == "K", F.col("role")).otherwise(F.get(names, i)).alias("role"),
            F.when(e == "I", F.lit("")).otherwise(F.col("text")).alias("text"),
            e.alias("edit"),
        ),
    )


def repaired(conversations: DataFrame) -> DataFrame:
    """``(conv_id, number, role, text, edit)``: the repaired conversations, turns numbered in order.

    ``edit`` is K, R or I. Numbers rise along a conversation and have gaps. Rows are handled as :func:`judged` says.
    """
    turns = judged(conversations)
    return turns.select("conv_id", "position", F.posexplode(_spoken_rows(turns)).alias("part", "turn")).select(
        "conv_id", F.struct("position", "part").alias("number"), "turn.role", "turn.text", "turn.edit"
    )


def report(original: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """One row per ``conv_id`` of ``original``: gaps, faults, cost, edits and a digest of the repaired turns.

    ``conversations`` are the rows to repair, if they differ; a conversation without any gets zeros, no edits and the digest of
    nothing. ``gaps`` counts missing turn numbers between the smallest and the largest, ``illegal`` neighbours whose
    initials are not su, ua or au. The digest is taken line by line in one pass over a conversation's sorted rows,
    which are not held; its edits, one character each, form one string.
    """
    turns = judged(original if conversations is None else conversations)
    of = F.col("fault")
    letters = {e: F.length("edits") - F.length(F.replace("edits", F.lit(e), F.lit(""))) for e in "IRD"}
    late = F.when((of == "truncated") & ~F.contains("edits", F.lit("D")), TRUNCATED).otherwise(0)
    cost = INSERT * letters["I"] + REROLE * letters["R"] + DELETE * letters["D"] + late
    spread = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    counts = turns.groupBy("first").agg(
        F.first("conv_id").alias("of"),
        F.coalesce(spread, F.lit(0)).cast("long").alias("gaps"),
        *[F.count_if(of == name).alias(name) for name in ("blank", "duplicate", "truncated")],
        F.count_if("illegal").alias("illegal"),
        F.sum(cost).cast("long").alias("cost"),
    )
    lines = F.transform(_spoken_rows(turns), lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    ordered = turns.select("first", "position", "edits", "says", lines.alias("lines")).repartition("first").sortWithinPartitions("first", "position")
    digests = ordered.select("first", "edits", "says", "lines").mapInArrow(_hash_lines, "first long, audit string, repaired_sha256 string")
    found = counts.join(digests, "first").drop("first")
    every = original.select("conv_id").distinct()
    zero = F.lit(0).cast("long")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return every.join(found, every["conv_id"].eqNullSafe(found["of"]), "left").select(
        every["conv_id"],
        *[F.coalesce(n, zero).alias(n) for n in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with planted faults, by CRC32 of conversation and turn: some dropped, emptied, cut, repeated or given to the user."""
    conv, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    key = F.concat(conv, F.lit(":"), turn)
    fault = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), fault.alias("fault")).where("fault <> 0")
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.sequence(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")
