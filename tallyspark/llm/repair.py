"""Operator 11: conversation structure repair by a dynamic program with checkpoints.

A conversation's rows, in order, are edited (Keep 0, Rerole 3, Delete 4, Insert 3, and 3 for
each truncated row that stays) until the roles' initials read ``(s?(ua)+)?``. What may follow
depends on one of four states: nothing kept yet, after s, after u, after a.

Rows are sorted once, range-partitioned over (conv_id, turn, role, text), and cut into blocks
of bounded size, so a conversation that holds a third of all rows is many blocks. A block
carries its least costs from state to state, a 4 x 4 table. A stream over each conversation's
blocks, last first, adds these up to the backward state-cost vector at every block's end: the
outer checkpoints. Then each block, alone, stores backward vectors at every square root of its
length only, and walks forward from each of the four states it might be entered in, recomputing
one stretch of vectors at a time: an edit is tight if its cost and the vector behind it make up
the vector before it, and the ASCII-least tight edit is taken (each letter leads to one state,
so this gives the least string). A second stream, first block first, picks the states that
really arise. Memory is a block and its vectors, however long the conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ship import ship
from .token_files import shared_path

BLOCK_ROWS = 4096
BLOCK_BYTES = 1 << 20
SPACE = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
NONE, SYSTEM, USER, ASSISTANT = range(4)  # states; OTHER is a class of rows only
OTHER = NONE
CLASS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
NEXT = (USER, USER, ASSISTANT, USER)  # state after an inserted or re-roled row
NAME = {USER: "user", ASSISTANT: "assistant"}
FAR = 1 << 60
LEGAL = ("su", "ua", "au")
MUST, CUT = 4, 8  # flags beside the class in a symbol: has to be deleted, is truncated
END = (0, 2 * INSERT, INSERT, 0)  # least costs from each state when no row is left


def before(after: tuple, symbol: int, copies: int) -> tuple:
    """Backward vector in front of a row from the one behind it."""
    if symbol & MUST:
        return tuple(min(FAR, x + DELETE * copies) for x in after)
    cut = TRUNCATED if symbol & CUT else 0
    kind = symbol & 3
    to_user, to_assistant = after[USER] + cut, after[ASSISTANT] + cut
    user = to_user if kind == USER else to_user + REROLE
    n = min(after[NONE] + DELETE, user)
    if kind == SYSTEM:
        n = min(n, after[SYSTEM] + cut)
    s = min(after[SYSTEM] + DELETE, user)
    a = min(after[ASSISTANT] + DELETE, user)
    u = min(after[USER] + DELETE, to_assistant if kind == ASSISTANT else to_assistant + REROLE)
    u, a = min(u, a + INSERT), min(a, u + INSERT)
    return min(n, u + INSERT, FAR), min(s, u + INSERT, FAR), min(u, FAR), min(a, FAR)


def table_of(symbols: bytes, copies: list[int]) -> list[int]:
    """Least costs of a block from each state (rows) to each state behind it (columns), inserts at the end included."""
    columns = []
    for end in range(4):
        v = tuple(0 if s == end else FAR for s in range(4))
        if end == USER:
            v = (INSERT, INSERT, 0, INSERT)
        elif end == ASSISTANT:
            v = (2 * INSERT, 2 * INSERT, INSERT, 0)
        for k in range(len(symbols) - 1, -1, -1):
            v = before(v, symbols[k], copies[k])
        columns.append(v)
    return [columns[t][s] for s in range(4) for t in range(4)]


def through(table: list[int], end: tuple) -> tuple:
    """Backward vector in front of a block from the one behind it."""
    return tuple(min(FAR, min(table[4 * s + t] + end[t] for t in range(4))) for s in range(4))


def walk(symbols: bytes, copies: list[int], end: tuple, last: bool, entries: tuple = (0, 1, 2, 3)) -> list[tuple[int, int, str]]:
    """(state behind the block, cost, edits) for each state it may be entered in.

    Vectors are kept at every square root of the block only; each stretch between two of
    them is recomputed when the walk comes to it. Inserts behind the last row belong to the
    block only if it is the conversation's ``last``; else the next block makes them.
    """
    n = len(symbols)
    step = isqrt(n) + 1
    kept, v = {n: end}, end
    for k in range(n - 1, -1, -1):
        v = before(v, symbols[k], copies[k])
        if k % step == 0:
            kept[k] = v
    now = [[s, 0, []] for s in entries]
    for first in range(0, n, step):
        stop = min(first + step, n)
        vectors = [kept[stop]]
        for k in range(stop - 1, first - 1, -1):
            vectors.append(before(vectors[-1], symbols[k], copies[k]))
        vectors.reverse()
        for path in now:
            for k in range(first, stop):
                _row(path, symbols[k], copies[k], vectors[k - first], vectors[k - first + 1])
    for path in now if last else ():
        while path[0] in (SYSTEM, USER):
            path[0] = NEXT[path[0]]
            path[1] += INSERT
            path[2].append("I")
    return [(s, cost, "".join(edits)) for s, cost, edits in now]


def _row(path: list, symbol: int, copies: int, ahead: tuple, behind: tuple) -> None:
    """The ASCII-least tight edits up to and with this row: D, I, K, R."""
    state, cost, edits = path
    if symbol & MUST:
        edits.append("D" * copies)
        path[1] = cost + DELETE * copies
        return
    cut, kind = TRUNCATED if symbol & CUT else 0, symbol & 3
    while True:
        want, then = ahead[state], NEXT[state]
        if want >= FAR:  # cannot be entered in this state
            break
        if behind[state] + DELETE == want:
            cost += DELETE
            edits.append("D")
            break
        if ahead[then] + INSERT == want:
            cost += INSERT
            edits.append("I")
            state = then
            continue
        if kind and (kind == then or (kind == SYSTEM and state == NONE)) and behind[kind] + cut == want:
            cost += cut
            edits.append("K")
            state = kind
        else:
            cost += REROLE + cut
            edits.append("R")
            state = then
        break
    path[0], path[1] = state, cost


def damage(rows: DataFrame) -> DataFrame:
    """Rows damaged by crc32(``conv_id:turn``) modulo 20, with ``copies``; a dropped row leaves its conv_id with 0 copies.

    0 drops a row, 1 empties its text, 2 removes ``. ! ?`` from it, 3 repeats it, 4 sets the
    role user. A null in any of the four columns is read as one space (conv_id and turn stay
    null in the result). Further columns are ignored.
    """
    said = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    k = F.pmod(F.crc32(F.concat(said["conv_id"], F.lit(":"), said["turn"]).cast("binary")), F.lit(20))
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                       said["role"].alias("role"), said["text"].alias("text"), k.alias("fault"))
    kept = F.col("fault") != 0
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", F.when(kept, F.col("turn")).alias("turn"), F.when(kept, role).alias("role"), F.when(kept, text).alias("text"),
                       F.when(~kept, 0).when(F.col("fault") == 3, 2).otherwise(1).cast("long").alias("copies"))


def _faults(rows: DataFrame, copies: str | None) -> DataFrame:
    """Equal rows as one with ``copies``, and their faults, by DataFrame functions alone.

    Equal rows meet by partial sums, so a row that is repeated very often travels once a task;
    a later row with a role and text that came before is found against a table of these only.
    """
    count = F.col(copies).cast("long") if copies else F.lit(1).cast("long")
    real = count > 0
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.when(real, F.col("turn")).cast("long").alias("turn"),
                       *(F.when(real, F.coalesce(F.col(c), F.lit(" "))).alias(c) for c in ("role", "text")), count.alias("copies"))
    keys = ("conv_id", "role", "text")
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    again = rows.where("copies > 0").groupBy(*keys).agg(F.count("*").alias("n"), F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("first")).where("n > 1")
    again = again.select(*(F.col(c).alias(f"{c}_2") for c in keys), F.col("first.turn").alias("first_turn"), F.lit(True).alias("repeated"))
    rows = rows.join(again, F.expr(" AND ".join(f"{c} <=> {c}_2" for c in keys)), "left")
    stripped = F.rtrim("text", F.lit(SPACE))
    blank = F.length(stripped) == 0
    return rows.select(
        "conv_id", "turn", "role", "text", "copies", F.coalesce(blank, F.lit(False)).alias("blank"),
        (F.coalesce("repeated", F.lit(False)) & ~F.col("turn").eqNullSafe(F.col("first_turn"))).alias("later"),
        F.coalesce(~F.substring(stripped, -1, 1).isin(".", "!", "?"), F.lit(False)).alias("cut"))


_BLOCK = ("conv_id long, part int, seq long, symbols binary, copies array<long>, roles array<string>, texts array<string>, costs array<long>, "
          "blank long, duplicate long, truncated long, illegal long, first string, last string, first_turn long, last_turn long, turns long")
_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int64()),
          pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]


def _batch(schema: str, types: list, rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in schema.split(", ")]
    columns = list(zip(*rows)) or [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


class _Block:
    """Rows of one conversation that are collected for a block."""

    def __init__(self, conv: int | None):
        self.conv, self.symbols, self.copies, self.roles, self.texts = conv, bytearray(), [], [], []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = self.size = 0
        self.first = self.last = self.first_turn = self.last_turn = None

    def add(self, turn: int | None, role: str, text: str, copies: int, blank: bool, later: bool, cut: bool) -> None:
        initial = role[:1]
        if self.first is None:
            self.first = initial
        else:
            self.illegal += self.last + initial not in LEGAL
        self.last = initial
        self.illegal += copies - 1
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.last_turn = turn
            if self.first_turn is None:
                self.first_turn = turn
        kind, gone = CLASS.get(initial, OTHER), copies
        if blank:
            self.blank += copies
        elif later:
            self.duplicate += copies
        else:
            self.truncated += cut
            self.duplicate += copies - 1
            self.symbols.append(kind | (CUT if cut else 0))
            self.copies.append(1)
            self.roles.append(role)
            self.texts.append(text)
            self.size += len(text) + len(role)
            gone -= 1
        if gone:
            self.symbols.append(kind | MUST)
            self.copies.append(gone)
            self.roles.append(None)
            self.texts.append(None)

    def row(self, part: int, seq: int) -> tuple:
        symbols = bytes(self.symbols)
        return (self.conv, part, seq, symbols, self.copies, self.roles, self.texts, table_of(symbols, self.copies), self.blank, self.duplicate,
                self.truncated, self.illegal, self.first, self.last, self.first_turn, self.last_turn, self.turns)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, seq, block, out, size = TaskContext.get().partitionId(), 0, None, [], 0
    for batch in batches:
        for conv, turn, role, text, copies, blank, later, cut in zip(*(c.to_pylist() for c in batch.columns)):
            if block is not None and (conv != block.conv or len(block.symbols) >= BLOCK_ROWS or block.size >= BLOCK_BYTES):
                out.append(block.row(part, seq))
                seq, size, block = seq + 1, size + block.size, None
                if len(out) >= 500 or size >= 4 * BLOCK_BYTES:
                    yield _batch(_BLOCK, _TYPES, out)
                    out, size = [], 0
            if block is None:
                block = _Block(conv)
            if copies:
                block.add(turn, role, text, copies, blank, later, cut)
    if block is not None:
        out.append(block.row(part, seq))
    yield _batch(_BLOCK, _TYPES, out)


def _by_conversation(blocks: DataFrame, backward: bool = False) -> DataFrame:
    """Blocks of each conversation one after the other, read by one task as a stream."""
    order = [F.desc("part"), F.desc("seq")] if backward else ["part", "seq"]
    return blocks.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Backward vector behind each block, the last block first."""
    seen, now = False, None
    for batch in batches:
        ends, lasts = [], []
        for conv, costs in zip(batch["conv_id"].to_pylist(), batch["costs"].to_pylist()):
            lasts.append(not seen or conv != now)
            if lasts[-1]:
                vector = END
            ends.append(list(vector))
            vector, seen, now = through(costs, vector), True, conv
        yield pa.RecordBatch.from_arrays(
            [batch[c] for c in ("conv_id", "part", "seq", "symbols", "copies")] + [pa.array(ends, pa.list_(pa.int64())), pa.array(lasts, pa.bool_())],
            ["conv_id", "part", "seq", "symbols", "copies", "end", "last_block"])


def _walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [walk(symbols, copies, tuple(end), last) for symbols, copies, end, last in
                 zip(*(batch[c].to_pylist() for c in ("symbols", "copies", "end", "last_block")))]
        yield pa.RecordBatch.from_arrays(
            [batch[c] for c in ("conv_id", "part", "seq")]
            + [pa.array([[w[i] for w in four] for four in found], pa.list_(t)) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))],
            ["conv_id", "part", "seq", "states", "costs", "edits"])


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state each block is entered in, the first block first; its edits and their cost."""
    seen, now, state = False, None, NONE
    for batch in batches:
        entries, costs, edits = [], [], []
        for conv, states, cost, audit in zip(*(batch[c].to_pylist() for c in ("conv_id", "states", "costs", "edits"))):
            if not seen or conv != now:
                seen, now, state = True, conv, NONE
            entries.append(state)
            costs.append(cost[state])
            edits.append(audit[state])
            state = states[state]
        yield pa.RecordBatch.from_arrays(
            [batch["part"], batch["seq"], pa.array(entries, pa.int32()), pa.array(costs, pa.int64()), pa.array(edits, pa.string())],
            ["part_2", "seq_2", "entry", "cost", "audit"])


def edited(state: int, symbols: bytes, copies: list[int], roles: list[str | None], texts: list[str | None], audit: str) -> tuple[list[str], list[str]]:
    """Roles and texts of a block after its edits."""
    at, out_roles, out_texts = 0, [], []
    row = 0
    while at < len(audit):
        edit = audit[at]
        at += 1
        if edit == "I":
            state = NEXT[state]
            out_roles.append(NAME[state])
            out_texts.append("")
            continue
        if edit == "D":
            at += copies[row] - 1
        elif edit == "K":
            state = symbols[row] & 3
            out_roles.append(roles[row])
            out_texts.append(texts[row])
        else:
            state = NEXT[state]
            out_roles.append(NAME[state])
            out_texts.append(texts[row])
        row += 1
    return out_roles, out_texts


_STATS = ["blank", "duplicate", "truncated", "illegal", "first", "last", "first_turn", "last_turn", "turns"]
_PIECE = ("conv_id long, part int, seq long, audit string, cost long, roles array<string>, texts array<string>, "
          "blank long, duplicate long, truncated long, illegal long, first string, last string, first_turn long, last_turn long, turns long")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [edited(*x) for x in zip(*(batch[c].to_pylist() for c in ("entry", "symbols", "copies", "roles", "texts", "audit")))]
        text = pa.list_(pa.string())
        yield pa.RecordBatch.from_arrays(
            [batch[c] for c in ("conv_id", "part", "seq", "audit", "cost")] + [pa.array([r[i] for r in rows], text) for i in (0, 1)] + [batch[c] for c in _STATS],
            [x.split()[0] for x in _PIECE.split(", ")])


def repair(rows: DataFrame, copies: str | None = None) -> DataFrame:
    """Repaired conversations in blocks: conv_id, part, seq (their order), audit, cost, roles, texts, and counts of the rows as they came.

    ``rows``: conv_id, turn, role, text; ``copies`` names a column that says how often a row
    stands there (0: only its conv_id counts). Order is by turn, role, text, nulls first, and
    equal rows follow each other. A null role or text is one space; rows with a null conv_id
    are one conversation; further columns are ignored; an empty table gives no rows. Texts of
    any length work: a block holds one row at least. The jobs that sort the rows into blocks
    and write them to the shared folder run when this is called; ``turns`` and ``report`` read the result.
    """
    spark = rows.sparkSession
    ship(spark)
    path = shared_path(spark, "conversation-blocks")
    keys = ("conv_id", "turn", "role", "text")
    faulty = _faults(rows, copies)
    faulty.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(_cut, _BLOCK).write.parquet(path)
    blocks = spark.read.parquet(path)
    small = blocks.select("conv_id", "part", "seq", "symbols", "copies", "costs")
    ends = _by_conversation(small, backward=True).mapInArrow(
        _ends, "conv_id long, part int, seq long, symbols binary, copies array<long>, end array<long>, last_block boolean")
    walks = ends.repartition("part", "seq").mapInArrow(_walks, "conv_id long, part int, seq long, states array<long>, costs array<long>, edits array<string>")
    chain = _by_conversation(walks).mapInArrow(_chain, "part_2 int, seq_2 long, entry int, cost long, audit string")
    found = blocks.drop("costs").join(chain, F.expr("part = part_2 AND seq = seq_2"))
    return found.select("conv_id", "part", "seq", "entry", "symbols", "copies", "roles", "texts", "audit", "cost", *_STATS).mapInArrow(_pieces, _PIECE)


def turns(pieces: DataFrame) -> DataFrame:
    """Repaired rows of ``repair``: conv_id, part, seq, place (their order), role, text."""
    both = F.posexplode(F.arrays_zip(F.col("roles").alias("role"), F.col("texts").alias("text")))
    return pieces.select("conv_id", "part", "seq", both.alias("place", "row")).select("conv_id", "part", "seq", "place", "row.role", "row.text")


_REPORT = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
_REPORT_TYPES = [pa.int64()] * 7 + [pa.string()] * 2


class _Report:
    """Running totals over a conversation's blocks; the digest is fed block by block."""

    def __init__(self, conv: int | None):
        self.conv, self.sums, self.edits, self.digest, self.lines = conv, [0] * 5, [], hashlib.sha256(), 0
        self.initial = self.low = self.high = None
        self.distinct = 0

    def add(self, audit, cost, roles, texts, blank, duplicate, truncated, illegal, first, last, first_turn, last_turn, turns) -> None:
        if first is not None:
            illegal += self.initial is not None and self.initial + first not in LEGAL
            self.initial = last
        self.sums = [a + b for a, b in zip(self.sums, (blank, duplicate, truncated, illegal, cost))]
        if first_turn is not None:
            self.distinct += turns - (self.high == first_turn)
            self.low = first_turn if self.low is None else self.low
            self.high = last_turn
        self.edits.append(audit)
        if roles:
            lines = "\n".join(f"{r}:{t}" for r, t in zip(roles, texts))
            self.digest.update((("\n" if self.lines else "") + lines).encode())
            self.lines += len(roles)

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return (self.conv, gaps, *self.sums, "".join(self.edits), self.digest.hexdigest())


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now = None
    for batch in batches:
        out = []
        columns = ["conv_id", "audit", "cost", "roles", "texts", *_STATS]
        for conv, *rest in zip(*(batch[c].to_pylist() for c in columns)):
            if now is None or conv != now.conv:
                if now:
                    out.append(now.row())
                now = _Report(conv)
            now.add(*rest)
        yield _batch(_REPORT, _REPORT_TYPES, out)
    yield _batch(_REPORT, _REPORT_TYPES, [now.row()] if now else [])


def report(pieces: DataFrame) -> DataFrame:
    """One row a conversation from the blocks of ``repair``: faults, cost, audit string and the digest of the repaired rows.

    SHA-256 runs from a conversation's start to its end, so one task reads its blocks in order, as a stream.
    """
    return _by_conversation(pieces).mapInArrow(_reports, _REPORT)
