import hashlib
import heapq
import random
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from lexgrain.llm.conversations import END, conversation_report, matrix, repaired_pieces, unroll
from lexgrain.llm.queries import op11_conversation_repair
from lexgrain.session import ship_package

AFTER = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
SPACE = " \t\n\x0b\x0c\r"
SCHEMA = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()),
        *(T.StructField(c, T.StringType()) for c in ("audit", "piece", "part", "whole", "cost")),
    ]
)


def cheapest(rows):
    """Dijkstra over (row, state) by cost, then audit: rows are (role, text, must go, truncated)."""
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in (0, 3):
            return cost, audit, "\n".join(out)
        given_roles = [r for r in ("user", "assistant") if r[0] in AFTER[state]]
        for r in given_roles:
            heapq.heappush(heap, (cost + 2, audit + "I", i, AFTER[state][r[0]], (*out, f"{r}:")))
        if i == len(rows):
            continue
        role, text, must, cut = rows[i]
        heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, out))
        if must:
            continue
        if role[:1] in AFTER[state]:
            heapq.heappush(heap, (cost + cut, audit + "K", i + 1, AFTER[state][role[:1]], (*out, f"{role}:{text}")))
        for r in given_roles:
            heapq.heappush(heap, (cost + 2 + cut, audit + "R", i + 1, AFTER[state][r[0]], (*out, f"{r}:{text}")))
    raise AssertionError


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}:{text}".encode()).digest()


def report(rows):
    """The report of ``(conv_id, turn, role, text)`` rows in plain Python."""
    conversations = defaultdict(list)
    for conv_id, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        conversations[conv_id].append((turn is not None, turn or 0, role, digest(role, text), text))
    out = []
    for conv_id, members in conversations.items():
        counts, seen, steps, before = [0] * 4, set(), [], None
        for _, _, role, _, text in sorted(members):
            body, must, cut = text.rstrip(SPACE), True, False
            if not body:
                counts[0] += 1
            elif (role, text) in seen:
                counts[1] += 1
            else:
                must, cut = False, body[-1] not in ".!?"
                counts[2] += cut
            seen.add((role, text))
            counts[3] += before is not None and before + role[:1] not in ("su", "ua", "au")
            before = role[:1]
            steps.append((role, text, must, cut))
        turns = {m[1] for m in members if m[0]}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        cost, audit, text = cheapest(steps)
        out.append((conv_id, gaps, *counts, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def damaged(rows):
    out = []
    for conv_id, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 2:
            text = text.replace(".", "").replace("!", "").replace("?", "")
        row = (conv_id, turn, "user" if kind == 4 else role, "" if kind == 1 else text)
        out += [row] * {0: 0, 3: 2}.get(kind, 1)
    return out


@pytest.fixture(scope="module")
def table(spark):
    ship_package(spark)

    def build(rows, partitions=3):
        return spark.createDataFrame([(*r, *["x"] * 5) for r in rows], SCHEMA).repartition(partitions)

    return build


def got(frame):
    return sorted(map(tuple, frame.collect()), key=str)


@settings(max_examples=300, deadline=None)
@given(st.text("suaoSUAOx", max_size=9), st.integers(0, 9))
def test_audit_is_the_first_of_the_cheapest(symbols, cut):
    rows = [(s.lower(), "t", s == "x", s.isupper()) for s in symbols]
    cost, audit, _ = cheapest(rows)
    assert unroll(symbols, 0, END, True)[0] == audit
    # The same in two pieces: costs come backwards, the state forwards.
    left, right = symbols[:cut], symbols[cut:]
    behind = tuple(min(row[k] + END[k] for k in range(4)) for row in matrix(right))
    assert min(matrix(left)[0][k] + behind[k] for k in range(4)) == cost
    first, state = unroll(left, 0, behind, False)
    assert first + unroll(right, state, END, True)[0] == audit


def test_long_runs_of_one_symbol():
    for symbols in ("u" * 3001, "a" * 2000, "S" * 1500, "x" * 4000, "ua" * 3000 + "s"):
        rows = [(s.lower(), "t", s == "x", s.isupper()) for s in symbols]
        assert unroll(symbols, 0, END, True)[0] == cheapest(rows)[1]


def conversation_rows():
    pick = random.Random(5)
    rows = []
    for conv_id in range(40):
        for turn in range(pick.randrange(1, 12)):
            role = pick.choice(["system", "user", "user", "assistant", "assistant", "tool", None, ""])
            text = pick.choice(["Yes.", "No", "Why? ", " \n", "", None, "é ok!", "a\x85", f"{pick.random()}."])
            rows.append((conv_id, pick.choice([turn, turn, 2 * turn, None]), role, text))
    rows += [(None, 1, "user", "Hi."), (None, None, "user", "Hi."), (None, 2, "assistant", "Hi.")]
    rows += [(77, None, "user", "Same."), (77, None, "user", "Same."), (78, 3, "user", "w" * 300_000)]
    return rows


def test_reports_of_odd_rows(table):
    rows = conversation_rows()
    assert got(conversation_report(repaired_pieces(table(rows)))) == report(rows)
    empty = conversation_report(repaired_pieces(table([])))
    assert empty.count() == 0


@pytest.mark.parametrize("piece_rows", [1, 3])
def test_conversations_in_many_pieces(table, piece_rows):
    pick = random.Random(6)
    rows = conversation_rows()
    rows += [
        (1000, turn // 2, pick.choice(["user", "assistant"]), pick.choice(["Yes.", f"{turn}.", f"{turn}", ""]))
        for turn in range(400)
    ]
    pieces = repaired_pieces(table(rows), piece_rows=piece_rows)
    assert pieces.where("conv_id = 1000").count() >= 400 // piece_rows
    assert got(conversation_report(pieces)) == report(rows)


def test_query_matches_brute_force(spark, tables):
    stored = spark.read.parquet(f"{tables}/conversations.parquet").select("conv_id", "turn", "role", "text")
    rows = [tuple(r) for r in stored.collect()]
    expected = {r[0]: r for r in report(damaged(rows))}
    nothing = hashlib.sha256(b"").hexdigest()
    result = got(op11_conversation_repair(spark, tables))
    assert {r[0] for r in result} == {r[0] for r in rows} and len(result) == len({r[0] for r in rows})
    assert all(r == expected.get(r[0], (r[0], 0, 0, 0, 0, 0, 0, "", nothing)) for r in result)


def test_query_reports_conversations_without_rows(spark, tmp_path, table):
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [(dropped, 0, "user", "Hi."), (None, 1, None, None)]
    table(rows, 1).write.parquet(f"{tmp_path}/conversations.parquet")
    result = {r["conv_id"]: tuple(r)[1:] for r in op11_conversation_repair(spark, str(tmp_path)).collect()}
    assert result[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) and None in result
