"""Repair of conversation structure by a dynamic program over runs.

Rows of a conversation, ordered by turn, become symbols of their role and fault.  A row is kept,
given another role or deleted, and empty rows are inserted, so that roles read
``(s?(ua)+)?`` by their initials at the least cost.  Each symbol is a min-plus matrix over the four
states of that pattern.  Equal symbols that follow each other are collapsed to a run, which cached
binary powers of its matrix cross at once; the choices of a run are unrolled when the costs at its
end are known.  Of cheapest repairs the one whose audit comes first in ASCII is taken.

Rows are sorted by range, not dealt by conversation, so one conversation may lie in many tasks.  A
piece of a conversation is its rows in one task, at most ``PIECE_ROWS`` of them.  Pieces that are
whole conversations are repaired where they are.  The others are linked by their matrices: costs
come backwards over the pieces, states forwards.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, lru_cache
from hashlib import sha256
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrain.session import kept_table

PIECE_ROWS = 50_000
_PIECE_CHARS = 4 << 20
#: Fixed costs.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: States: nothing yet, after s, after u, after a.  The next states by initial.
_NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The one role that may be inserted or given in each state, and the state after it.
_GIVEN = (("user", 2), ("user", 2), ("assistant", 3), ("user", 2))
_FAR = 1 << 60
#: Costs at the end of a conversation: only the first and last state may end it.
END = (0, 2 * INSERT, INSERT, 0)
_SPACE = " \t\n\x0b\x0c\r"
#: Symbol of a row that has to go; others are the role's initial, upper case if truncated.
GONE = "x"

Vector = tuple[int, int, int, int]


def _times(a: tuple, b: tuple) -> tuple:
    return tuple(tuple(min(a[i][k] + b[k][j] for k in range(4)) for j in range(4)) for i in range(4))


def _apply(a: tuple, v: Vector) -> Vector:
    return tuple(min(row[k] + v[k] for k in range(4)) for row in a)


def _choices(symbol: str, state: int) -> list[tuple[str, int, int]]:
    """``(letter, cost, next state)`` for a row, in ASCII order of letters."""
    found = [("D", DELETE, state)]
    if symbol == GONE:
        return found
    truncated = TRUNCATED if symbol.isupper() else 0
    after = _NEXT[state].get(symbol.lower())
    if after is not None:
        found.append(("K", KEEP + truncated, after))
    found.append(("R", REROLE + truncated, _GIVEN[state][1]))
    return found


def _insertions() -> tuple:
    """Costs of going from state to state by insertions alone."""
    one = [[0 if i == j else _FAR for j in range(4)] for i in range(4)]
    for i, (_, j) in enumerate(_GIVEN):
        one[i][j] = min(one[i][j], INSERT)
    closed = tuple(map(tuple, one))
    for _ in range(2):
        closed = _times(closed, closed)
    return closed


@cache
def power(symbol: str, k: int) -> tuple:
    """Matrix of ``2**k`` rows with this symbol."""
    if k:
        half = power(symbol, k - 1)
        return _times(half, half)
    row = [[_FAR] * 4 for _ in range(4)]
    for state in range(4):
        for _, cost, after in _choices(symbol, state):
            row[state][after] = min(row[state][after], cost)
    return _times(_insertions(), tuple(map(tuple, row)))


def runs_of(symbols: str) -> list[tuple[str, int]]:
    return [(symbol, sum(1 for _ in same)) for symbol, same in groupby(symbols)]


def _back_over(symbol: str, count: int, costs: Vector) -> Vector:
    k = 0
    while count:
        if count & 1:
            costs = _apply(power(symbol, k), costs)
        count >>= 1
        k += 1
    return costs


def matrix(symbols: str) -> tuple:
    """Costs from each state before the rows to each state after them."""
    columns = []
    for j in range(4):
        costs = tuple(0 if i == j else _FAR for i in range(4))
        for symbol, count in reversed(runs_of(symbols)):
            costs = _back_over(symbol, count, costs)
        columns.append(costs)
    return tuple(zip(*columns, strict=True))


def unroll(symbols: str, state: int, costs: Vector, last: bool) -> tuple[str, int]:
    """``(audit, state after it)`` of the cheapest repair of the rows, the first one in ASCII.

    ``costs`` are those behind the rows; ``last`` says that the conversation ends there.
    """
    runs = runs_of(symbols)
    behind = [costs]
    for symbol, count in reversed(runs):
        behind.append(_back_over(symbol, count, behind[-1]))
    behind = behind[::-1][1:]
    audit = []
    for (symbol, count), after in zip(runs, behind, strict=True):
        inside = [after]  # costs at each place of the run, from its end
        step = power(symbol, 0)
        for _ in range(count):
            inside.append(_apply(step, inside[-1]))
        for at in range(count, 0, -1):
            here, then = inside[at], inside[at - 1]
            done = False
            while not done:
                choices = {c: (cost, to) for c, cost, to in _choices(symbol, state)}
                given = _GIVEN[state][1]
                for letter in "DIKR":
                    if letter == "I":
                        if INSERT + here[given] == here[state]:
                            audit.append(letter)
                            state = given
                            break
                    elif letter in choices:
                        cost, to = choices[letter]
                        if cost + then[to] == here[state]:
                            audit.append(letter)
                            state, done = to, True
                            break
    while last and costs[state]:
        audit.append("I")
        state = _GIVEN[state][1]
    return "".join(audit), state


@lru_cache(maxsize=1 << 14)
def _short(symbols: str) -> tuple[str, int]:
    return unroll(symbols, 0, END, True)


def repaired_lines(
    symbols: str, roles: list[str], texts: list[str], audit: str, state: int
) -> tuple[list[str], int]:
    """``role:text`` of the rows that an audit leaves, and its cost."""
    lines, cost, row = [], 0, 0
    for letter in audit:
        given, after = _GIVEN[state]
        if letter == "I":
            lines.append(f"{given}:")
            cost, state = cost + INSERT, after
            continue
        symbol = symbols[row]
        if letter == "D":
            cost += DELETE
        elif letter == "R":
            lines.append(f"{given}:{texts[row]}")
            cost, state = cost + REROLE + TRUNCATED * symbol.isupper(), after
        else:
            lines.append(f"{roles[row]}:{texts[row]}")
            cost, state = cost + KEEP + TRUNCATED * symbol.isupper(), _NEXT[state][symbol.lower()]
        row += 1
    return lines, cost


_STATS = "blank bigint, duplicate bigint, truncated bigint, illegal bigint, turns bigint, low bigint, high bigint"
_STAT_NAMES = ["blank", "duplicate", "truncated", "illegal", "turns", "low", "high"]
_PIECE = (
    "conv_id {0}, part int, piece int, whole boolean, symbols string, first string, final string, "
    f"{_STATS}"
)


class _Piece:
    """Rows of one conversation that follow each other in a task."""

    def __init__(self, conv_id, number: int):
        self.conv_id, self.number = conv_id, number
        self.roles, self.texts, self.symbols = [], [], []
        self.chars = 0
        self.stats = dict.fromkeys(_STAT_NAMES[:5], 0) | {"low": None, "high": None}

    def add(self, turn, role: str, text: str, repeated: bool, previous: str | None) -> str:
        """Add a row and return its role's initial."""
        stats, initial = self.stats, role[:1]
        body = text.rstrip(_SPACE)
        symbol = initial if initial in ("s", "u", "a") else "o"
        if not body:
            stats["blank"] += 1
            symbol = GONE
        elif repeated:
            stats["duplicate"] += 1
            symbol = GONE
        elif body[-1] not in ".!?":
            stats["truncated"] += 1
            symbol = symbol.upper()
        if previous is not None and previous + initial not in ("su", "ua", "au"):
            stats["illegal"] += 1
        if turn is not None:
            stats["turns"] += turn != stats["high"]
            stats["low"] = turn if stats["low"] is None else stats["low"]
            stats["high"] = turn
        self.roles.append(role)
        self.texts.append(text)
        self.symbols.append(symbol)
        self.chars += len(text) + len(role)
        return initial

    def full(self, most_rows: int) -> bool:
        return len(self.symbols) >= most_rows or self.chars >= _PIECE_CHARS


def _record(piece: _Piece, part: int, whole: bool) -> dict:
    return {
        "conv_id": piece.conv_id,
        "part": part,
        "piece": piece.number,
        "whole": whole,
        "symbols": "".join(piece.symbols),
        "first": piece.roles[0][:1],
        "final": piece.roles[-1][:1],
        **piece.stats,
        "roles": piece.roles,
        "texts": piece.texts,
    }


def _piece_cutter(schema: pa.Schema, most_rows: int):
    """Sorted rows of a task to pieces; a mark says that the row after it occurred before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        piece, first, waiting, held = None, True, [], 0
        before, marked, previous = None, None, None

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(waiting, schema)

        for table in batches:
            for conv_id, turn, role, digest, mark, text in zip(*(c.to_pylist() for c in table.columns), strict=True):
                key = (conv_id, turn, role, digest)
                if mark:
                    marked = key
                    continue
                if piece is None or piece.conv_id != conv_id:
                    if piece is not None:
                        waiting.append(_record(piece, part, not first and piece.number == 0))
                        held += piece.chars
                        first = False
                    piece, previous = _Piece(conv_id, 0), None
                elif piece.full(most_rows):
                    waiting.append(_record(piece, part, False))
                    held += piece.chars
                    piece = _Piece(conv_id, piece.number + 1)
                if held >= _PIECE_CHARS:
                    yield batch()
                    waiting, held = [], 0
                previous = piece.add(turn, role, text, key in (before, marked), previous)
                before = key
        if piece is not None:
            waiting.append(_record(piece, part, False))
        if waiting:
            yield batch()

    return run


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows and marks by conversation, turn (nulls first), role and digest, in range partitions.

    A mark stands before each row whose role and text occur earlier in its conversation.  Marks are
    found on digests alone, so texts are shuffled once.
    """
    narrow = rows.select("conv_id", "turn", "role", "digest")
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    firsts = (
        narrow.groupBy("conv_id", "digest")
        .agg(F.min(turn).alias("first"), F.max(turn).alias("final"))
        .where(F.col("first") != F.col("final"))
        .select(F.col("conv_id").alias("_conv"), F.col("digest").alias("_digest"), "first")
    )
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("digest") == F.col("_digest"))
    marks = narrow.join(firsts, same).where(turn > F.col("first")).select(*narrow.columns)
    nothing = F.lit(None).cast("string").alias("text")
    both = rows.select(*narrow.columns, F.lit(0).alias("mark"), "text").unionAll(
        marks.select(*narrow.columns, F.lit(1).alias("mark"), nothing)
    )
    key = [F.col(c).asc_nulls_first() for c in narrow.columns]
    return both.repartitionByRange(*key).sortWithinPartitions(*key, F.col("mark").desc())


def _linked(edges: DataFrame, conv_type: str) -> DataFrame:
    """``(conv_id, part, piece, state, costs, last)`` of pieces that aren't whole conversations.

    Pieces that share an end of a task or exceed a piece's size: a group holds one narrow row for
    each piece of a conversation, never its symbols or texts.
    """
    key = f"conv_id {conv_type}, part int, piece int"

    def with_matrix(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            cells = [np.array(matrix(s)).ravel().tolist() for s in part["symbols"]]
            yield part[["conv_id", "part", "piece"]].assign(cells=cells)

    def backwards(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["part", "piece"])
        costs, found = END, []
        for cells in reversed(group["cells"].tolist()):
            found.append(list(costs))
            costs = _apply(tuple(tuple(cells[4 * i : 4 * i + 4]) for i in range(4)), costs)
        last = [False] * (len(found) - 1) + [True]
        return group[["conv_id", "part", "piece"]].assign(costs=found[::-1], last=last)

    def with_states(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = zip(part["symbols"], part["costs"], strict=True)
            after = [[unroll(s, q, tuple(int(x) for x in v), False)[1] for q in range(4)] for s, v in rows]
            yield part[["conv_id", "part", "piece", "costs", "last"]].assign(after=after)

    def forwards(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["part", "piece"])
        state, found = 0, []
        for after in group["after"].tolist():
            found.append(state)
            state = int(after[state])
        return group[["conv_id", "part", "piece", "costs", "last"]].assign(state=found)

    cells = edges.select("conv_id", "part", "piece", "symbols").mapInPandas(with_matrix, f"{key}, cells array<bigint>")
    costs = cells.groupBy("conv_id").applyInPandas(backwards, f"{key}, costs array<bigint>, last boolean")
    on = edges["conv_id"].eqNullSafe(costs["conv_id"]) & (edges["part"] == costs["part"]) & (edges["piece"] == costs["piece"])
    known = edges.join(costs, on).select(edges["conv_id"], edges["part"], edges["piece"], "symbols", "costs", "last")
    states = known.mapInPandas(with_states, f"{key}, costs array<bigint>, last boolean, after array<int>")
    return states.groupBy("conv_id").applyInPandas(forwards, f"{key}, costs array<bigint>, last boolean, state int")


def repaired_pieces(
    rows: DataFrame,
    id_column: str = "conv_id",
    turn_column: str = "turn",
    role_column: str = "role",
    text_column: str = "text",
    piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """The repaired conversations in pieces, whose order is ``(part, piece)``.

    Columns: ``conv_id, part, piece, whole`` (the piece is a whole conversation), ``audit`` (letters
    of Keep, Rerole, Delete, Insert), ``repaired`` (lines ``role:text``), ``n_lines``, ``cost``, counts
    of first faults (``blank``, ``duplicate``, ``truncated``) and of ``illegal`` neighbours, ``turns``
    (distinct), ``low``, ``high`` and the initials of the ``first`` and ``final`` row.

    Rows are ordered by turn, nulls first; rows of one turn by role and a digest of the text.  Null
    roles and texts count as one space.  Rows that are repeated count as duplicates; a null
    ``conv_id`` is a conversation like others; an empty table gives no row.
    """
    space = F.lit(" ")
    role, text = F.coalesce(role_column, space), F.coalesce(text_column, space)
    conv_type = rows.schema[id_column].dataType.simpleString()
    plain = rows.select(
        F.col(id_column).alias("conv_id"),
        F.col(turn_column).cast("bigint").alias("turn"),
        role.alias("role"),
        text.alias("text"),
        F.unhex(F.sha2(F.concat_ws(":", F.length(role), role, text), 256)).alias("digest"),
    )
    ddl = f"{_PIECE.format(conv_type)}, roles array<string>, texts array<string>"
    schema = _arrow(plain, ddl)
    pieces = kept_table(_ordered(plain).mapInArrow(_piece_cutter(schema, piece_rows), ddl), "conversation-pieces")
    edges = pieces.where(~F.col("whole"))
    links = _linked(edges, conv_type)
    on = edges["conv_id"].eqNullSafe(links["conv_id"]) & (edges["part"] == links["part"]) & (edges["piece"] == links["piece"])
    linked = edges.join(links, on).select(*(edges[c] for c in edges.columns), "costs", "last", "state")
    alone = pieces.where("whole").select(
        "*",
        F.array(*map(F.lit, END)).cast("array<bigint>").alias("costs"),
        F.lit(True).alias("last"),
        F.lit(0).alias("state"),
    )
    out = (
        f"{_PIECE.format(conv_type).replace('symbols string', 'audit string')}, repaired string, "
        "n_lines bigint, cost bigint"
    )
    result = _arrow(plain, out)
    held = [n for n in result.names if n not in ("audit", "repaired", "n_lines", "cost")]

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = {"audit": [], "repaired": [], "n_lines": [], "cost": []}
            read = ["symbols", "roles", "texts", "costs", "last", "state"]
            for symbols, roles, texts, costs, last, state in zip(*(batch.column(c).to_pylist() for c in read), strict=True):
                if state == 0 and last and len(symbols) <= 64 and tuple(costs) == END:
                    audit = _short(symbols)[0]
                else:
                    audit = unroll(symbols, state, tuple(costs), last)[0]
                lines, cost = repaired_lines(symbols, roles, texts, audit, state)
                for name, value in zip(made, (audit, "\n".join(lines), len(lines), cost), strict=True):
                    made[name].append(value)
            columns = {c: batch.column(c) for c in held} | {
                c: pa.array(v, result.field(c).type) for c, v in made.items()
            }
            yield pa.RecordBatch.from_arrays([columns[c] for c in result.names], schema=result)

    return alone.unionByName(linked).mapInArrow(repair, out)


def _arrow(df: DataFrame, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def conversation_report(pieces: DataFrame) -> DataFrame:
    """One row per conversation: ``conv_id``, ``gaps``, faults, ``illegal``, ``cost``, ``audit``, ``repaired_sha256``.

    Whole conversations are reported as they are.  Pieces of others are brought together in order;
    the digest is fed piece by piece, so a task holds one piece and the audit, never a conversation.
    """
    conv_type = pieces.schema["conv_id"].dataType.simpleString()
    counts = ["blank", "duplicate", "truncated", "illegal", "cost"]
    alone = pieces.where("whole").select(
        "conv_id",
        F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).alias("gaps"),
        *counts,
        "audit",
        F.sha2("repaired", 256).alias("repaired_sha256"),
    )
    ddl = f"conv_id {conv_type}, gaps bigint, " + ", ".join(f"{c} bigint" for c in counts) + ", audit string, repaired_sha256 string"
    schema = _arrow(pieces, ddl)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict | None = None

        def done() -> pa.RecordBatch:
            gaps = held["high"] - held["low"] + 1 - held["turns"] if held["high"] is not None else 0
            row = {c: held[c] for c in ["conv_id", *counts]} | {"gaps": gaps}
            row |= {"audit": "".join(held["audits"]), "repaired_sha256": held["digest"].hexdigest()}
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            for at in range(batch.num_rows):
                piece = batch.slice(at, 1).to_pylist()[0]
                if held is None or held["conv_id"] != piece["conv_id"]:
                    if held is not None:
                        yield done()
                    held = piece | {"audits": [piece["audit"]], "digest": sha256(piece["repaired"].encode())}
                    continue
                for c in counts:
                    held[c] += piece[c]
                held["illegal"] += held["final"] + piece["first"] not in ("su", "ua", "au") and piece["piece"] == 0
                if piece["high"] is not None:
                    held["turns"] += piece["turns"] - (held["high"] == piece["low"])
                    held["low"] = piece["low"] if held["low"] is None else held["low"]
                    held["high"] = piece["high"]
                if piece["n_lines"]:
                    held["digest"].update(b"\n" * (held["n_lines"] > 0) + piece["repaired"].encode())
                    held["n_lines"] += piece["n_lines"]
                held["audits"].append(piece["audit"])
                held["final"] = piece["final"]
        if held is not None:
            yield done()

    order = ["conv_id", "part", "piece"]
    apart = pieces.where(~F.col("whole")).repartition("conv_id").sortWithinPartitions(*order)
    return alone.unionByName(apart.mapInArrow(join, ddl))
