"""Faults of conversations and their cheapest repair."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldstats.llm.common import computed, settled
from fieldstats.llm.edit_lattice import NEXT, ROLES, START, SYSTEM, Joined, through, whole

#: Turns of a conversation that are searched as one piece.
PIECE = 1_024
#: Fixed by the contract: what a text of nothing but these is blank for.
BLANK = " \t\n\x0b\x0c\r"
_LEGAL = {"su", "ua", "au"}
_COUNTS = ("blank", "duplicate", "truncated", "illegal")


def damage(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Rows ``conv``, ``turn``, ``role``, ``text`` with faults planted by crc32(``conv:turn``) modulo 20.

    0 drops the row, 1 empties its text, 2 takes ``.``, ``!`` and ``?`` out of it, 3 repeats it,
    4 makes it a user's. A null role or text is one space, and so is a null in the key.
    """
    space = F.lit(" ")
    as_text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), space)
    draw = F.crc32(F.concat_ws(":", as_text(conv_col), as_text(turn_col)).cast("binary")) % 20
    rows = computed(
        rows.select(
            F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").alias("turn"), as_text(role_col).alias("role"), as_text(text_col).alias("text"), draw.alias("_draw")
        ).filter(F.col("_draw") != 0),
        _text=F.when(F.col("_draw") == 1, F.lit("")).when(F.col("_draw") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")),
        _role=F.when(F.col("_draw") == 4, F.lit("user")).otherwise(F.col("role")),
    )
    rows = rows.select("conv", "turn", F.col("_role").alias("role"), F.col("_text").alias("text"), F.when(F.col("_draw") == 3, 2).otherwise(1).alias("_n"))
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("_n", "_copy")


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def faults(rows: DataFrame) -> DataFrame:
    """Equal turns folded: ``conv``, ``turn``, ``role``, ``digest``, ``n``, ``initial``, ``fault``, ``first``.

    ``fault`` is ``blank``, ``truncated`` or null; ``first`` is false where a row of an earlier
    turn has the same role and text. Of ``n`` equal rows, all but one are duplicates anyway.
    """
    body = F.rtrim(F.col("text"), F.lit(BLANK))
    fault = F.when(body == "", "blank").when(~F.substring(body, -1, 1).isin(".", "!", "?"), "truncated")
    cells = rows.groupBy("conv", "turn", "role", _digest(F.col("text")).alias("digest"), fault.alias("fault")).agg(F.count(F.lit(1)).alias("n"))
    # Nulls are the first turns. Only texts of more than one turn are looked up.
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    again = (
        cells.filter(~F.col("fault").eqNullSafe("blank"))
        .groupBy(F.col("conv").alias("_conv"), F.col("role").alias("_role"), F.col("digest").alias("_digest"))
        .agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("_turns"))
        .filter(F.col("_turns") > 1)
    )
    same = F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest"))
    initial = F.substring("role", 1, 1)
    return cells.join(again, same, "left").select(
        "conv",
        "turn",
        "role",
        "digest",
        "n",
        F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"),
        "fault",
        (F.col("_first").isNull() | (F.col("_first") == order)).alias("first"),
    )


class _Piece:
    """Turns of a conversation that follow each other, with what is counted in them."""

    def __init__(self) -> None:
        self.turns: list[str] = []
        self.counts = dict.fromkeys(_COUNTS, 0)
        self.initials = ["", ""]
        self.bounds: list = [None, None]
        self.distinct = 0

    def add(self, turn, initial: str, fault: str | None, times: int) -> None:
        letter = "x" if fault in ("blank", "duplicate") else initial.upper() if fault else initial
        self.turns.append(letter * times)
        if fault:
            self.counts[fault] += times
        self.counts["illegal"] += (times - 1) + (self.initials[1] != "" and self.initials[1] + initial not in _LEGAL)
        self.initials = [self.initials[0] or initial, initial]
        if turn is not None and turn != self.bounds[1]:
            self.distinct += 1
            self.bounds = [turn if self.bounds[0] is None else self.bounds[0], turn]

    def __len__(self) -> int:
        return sum(map(len, self.turns))


def _pieces(batches: Iterator[pa.RecordBatch], kinds: pa.Schema, piece_rows: int) -> Iterator[pa.RecordBatch]:
    """One row a piece, with its ways; turns come in the order of their conversations.

    A conversation that may reach into another task's turns, the first and the last of a
    task, or that has more than one piece keeps all ways through each piece.
    """
    part, out, number = TaskContext.get().partitionId(), [], 0
    conv, open_pieces, first = None, [], True

    def close(last: bool) -> None:
        nonlocal number
        apart = not first and not last and len(open_pieces) == 1
        for p in open_pieces:
            turns = "".join(p.turns)
            ways = [(START, START, *whole(turns))] if apart else through(turns)
            counts = {c: p.counts[c] for c in _COUNTS}
            out.append(
                {"conv": conv, "part": part, "piece": number, "initials": p.initials, "bounds": p.bounds, "distinct": p.distinct, **counts}
                | {"ways": [{"entry": e, "to": t, "cost": c, "audit": a} for e, t, c, a in ways]}
            )
            number += 1

    for batch in batches:
        for row in batch.to_pylist():
            if open_pieces and row["conv"] != conv:
                close(False)
                first, open_pieces = False, []
            conv, times, duplicate = row["conv"], row["n"], not row["first"]
            while times:
                if not open_pieces or len(open_pieces[-1]) >= piece_rows:
                    open_pieces.append(_Piece())
                    if len(open_pieces) > 8:  # surely more than one piece: hand on what is full
                        keep, open_pieces = open_pieces[-1:], open_pieces[:-1]
                        close(True)
                        open_pieces, first = keep, True
                now = open_pieces[-1]
                fault = row["fault"]
                if fault == "blank" or duplicate:
                    taken = min(times, piece_rows - len(now))
                    now.add(row["turn"], row["initial"], fault if fault == "blank" else "duplicate", taken)
                else:
                    taken = 1
                    now.add(row["turn"], row["initial"], fault, 1)
                    duplicate = True
                times -= taken
        if len(out) >= 1_000:
            yield pa.RecordBatch.from_pylist(out, schema=kinds)
            out.clear()
    if open_pieces:
        close(True)
    yield pa.RecordBatch.from_pylist(out, schema=kinds)


class _Conversation:
    """One conversation: its pieces, then its rows, of which only the digest is kept."""

    def __init__(self, conv) -> None:
        self.conv = conv
        self.joined, self.counts = Joined(), dict.fromkeys(_COUNTS, 0)
        self.last, self.bounds, self.distinct = "", [None, None], 0
        self.plan: Iterator[str] | None = None
        self.cost, self.audit, self.state = 0, "", START
        self.sha, self.lines = hashlib.sha256(), 0

    def piece(self, row: dict) -> None:
        self.joined.join([(w["entry"], w["to"], w["cost"], w["audit"]) for w in row["ways"]])
        for c in _COUNTS:
            self.counts[c] += row[c]
        start, end = row["initials"]
        self.counts["illegal"] += self.last != "" and self.last + start not in _LEGAL
        self.last = end
        low, high = row["bounds"]
        if low is not None:
            self.distinct += row["distinct"] - (low == self.bounds[1])
            self.bounds = [low if self.bounds[0] is None else self.bounds[0], high]

    def _line(self, text: str) -> None:
        self.sha.update((("\n" if self.lines else "") + text).encode())
        self.lines += 1

    def _begin(self) -> None:
        if self.plan is None:
            self.cost, self.audit = self.joined.best()
            self.plan = iter(self.audit)

    def _insert(self) -> None:
        self._line(ROLES[self.state] + ":")
        self.state = NEXT[self.state]

    def row(self, role: str, text: str) -> None:
        self._begin()
        while (letter := next(self.plan)) == "I":
            self._insert()
        if letter == "D":
            return
        if letter == "R":
            role = ROLES[self.state]
        self._line(f"{role}:{text}")
        self.state = SYSTEM if letter == "K" and role[0] == "s" else NEXT[self.state]

    def result(self) -> dict:
        self._begin()
        for _ in self.plan:
            self._insert()
        low, high = self.bounds
        gaps = 0 if low is None else high - low + 1 - self.distinct
        return {"conv": self.conv, "gaps": gaps, **self.counts, "cost": self.cost, "audit": self.audit, "repaired_sha256": self.sha.hexdigest()}


def _repaired(batches: Iterator[pa.RecordBatch], kinds: pa.Schema) -> Iterator[pa.RecordBatch]:
    now: _Conversation | None = None
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if now is None or row["conv"] != now.conv:
                if now is not None:
                    out.append(now.result())
                now = _Conversation(row["conv"])
            if row["side"] == 0:
                now.piece(row)
            elif row["side"] == 1:
                now.row(row["role"], row["text"])
        yield pa.RecordBatch.from_pylist(out, schema=kinds)
    if now is not None:
        yield pa.RecordBatch.from_pylist([now.result()], schema=kinds)


def repair(rows: DataFrame, conversations: DataFrame, piece_rows: int = PIECE) -> DataFrame:
    """Per conversation of ``conversations`` (column ``conv``) its faults and cheapest repair.

    ``rows`` has ``conv``, ``turn``, ``role`` and ``text``, the last two without nulls. A
    conversation's rows are taken by turn (nulls first), then role, then the text's SHA-256;
    equal rows are interchangeable. Columns: ``conv``, ``gaps`` (turns missing between the
    lowest and the highest), ``blank``, ``duplicate``, ``truncated`` (each row by its first
    fault), ``illegal`` (neighbours whose initials may not follow each other), ``cost``,
    ``audit``, and ``repaired_sha256`` of the repaired ``role:text`` lines. A role that begins
    with none of s, u, a, an empty one too, can't be kept. A null conversation is one of its
    own. Without rows: zeros, an empty audit, the hash of nothing.

    First the rows without their texts: equal ones are folded, then spread by conversation
    and turn, so that one large conversation is searched in pieces by many tasks. Then pieces and texts meet by conversation, in order;
    that task streams them and holds a batch, the conversation's audit and the state of its hash. The hash
    is of one text from end to end, so only this part of a conversation is for one task.
    """
    schema = rows.schema
    conv, turn = (schema[c].dataType.simpleString() for c in ("conv", "turn"))
    counts = ", ".join(f"{c} long" for c in _COUNTS)
    ways = "array<struct<entry: int, to: int, cost: bigint, audit: string>>"
    cells = settled(faults(rows)).repartitionByRange("conv", "turn", "role", "digest").sortWithinPartitions("conv", "turn", "role", "digest")
    piece_schema = f"conv {conv}, part int, piece int, initials array<string>, bounds array<{turn}>, distinct long, {counts}, ways {ways}"
    empty = cells.sparkSession.createDataFrame([], piece_schema)
    kinds = _arrow(empty)
    pieces = cells.mapInArrow(lambda batches: _pieces(batches, kinds, piece_rows), piece_schema)
    stream = (
        pieces.withColumn("side", F.lit(0))
        .unionByName(rows.select("conv", "turn", "role", "text", _digest(F.col("text")).alias("digest"), F.lit(1).alias("side")), allowMissingColumns=True)
        .unionByName(conversations.select("conv", F.lit(2).alias("side")).distinct(), allowMissingColumns=True)
        .repartition("conv")
        .sortWithinPartitions("conv", "side", "part", "piece", "turn", "role", "digest")
        .drop("digest", "turn")
    )
    result_schema = f"conv {conv}, gaps long, {counts}, cost long, audit string, repaired_sha256 string"
    result_kinds = _arrow(cells.sparkSession.createDataFrame([], result_schema))
    return stream.mapInArrow(lambda batches: _repaired(batches, result_kinds), result_schema)


def _arrow(df: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.schema)
