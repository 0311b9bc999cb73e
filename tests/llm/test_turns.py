"""Conversation repair against a search over all edits."""

import hashlib
import heapq
import random
import re
import zlib

from notewarden.llm import turn_repair
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def cheapest(rows):
    """Dijkstra over (rows read, role initials' state), the queue ordered by (cost, audit)."""
    nexts = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    queue, done = [(0, "", 0, "0", ())], set()
    while True:
        cost, audit, n, state, lines = heapq.heappop(queue)
        if n == len(rows) and state in "0a":
            return cost, audit, lines
        if (n, state) in done:
            continue
        done.add((n, state))
        for role, name in (("u", "user"), ("a", "assistant")):
            if (state, role) in nexts:
                heapq.heappush(queue, (cost + 3, audit + "I", n, nexts[state, role], (*lines, f"{name}:")))
        if n < len(rows):
            role, text, fault = rows[n]
            heapq.heappush(queue, (cost + 4, audit + "D", n + 1, state, lines))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if (state, role[:1]) in nexts:
                    heapq.heappush(queue, (cost + more, audit + "K", n + 1, nexts[state, role[:1]], (*lines, f"{role}:{text}")))
                for r, name in (("u", "user"), ("a", "assistant")):
                    if (state, r) in nexts:
                        heapq.heappush(queue, (cost + more + 3, audit + "R", n + 1, nexts[state, r], (*lines, f"{name}:{text}")))


def expected(rows, hurt):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in hurt if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        seen, marked = set(), []
        for _, _, role, text in mine:
            bare = text.rstrip(SPACE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            marked.append((role, text, fault))
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        faults = [m[2] for m in marked]
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(marked, marked[1:])]
        cost, audit, lines = cheapest(marked)
        counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        out[conv] = (gaps, *counts, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()), lines
    return out


def checked(spark, rows, hurt_first=True):
    table = spark.createDataFrame(rows, SCHEMA)
    hurt = turn_repair.damaged(table) if hurt_first else table
    result = turn_repair.repair(hurt)
    want = expected(rows, damage(rows) if hurt_first else [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows])
    got = {r[0]: tuple(r)[1:] for r in result.collect()}
    assert got == {c: v[0] for c, v in want.items()}
    lines = {}
    for r in turn_repair.repaired_turns(hurt, result).orderBy("conv_id", "place").collect():
        lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
        assert r["place"] == len(lines[r["conv_id"]]) - 1
    assert lines == {c: list(v[1]) for c, v in want.items() if v[1]}


def conversations(seed, n=150, longest=9):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "User"])
            text = rng.choice(["Yes.", "No!", "cut off", "  ", "", None, "é漢?", "same.", "ends. \n", "a\x1fb."])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), role, text))
    return rows


def test_damaged_conversations(spark):
    checked(spark, conversations(3))


def test_undamaged_ties_nulls_and_repeats(spark):
    rows = conversations(4, 120) + [(None, 0, "user", "Hi."), (None, 1, None, None), (-7, None, "assistant", "x.")]
    checked(spark, rows + rows[:40], hurt_first=False)


def test_long_conversation_keeps_audits_apart(spark):
    """Far longer than REBASE, with stacks that differ from the first turn on."""
    rng = random.Random(8)
    rows = [(1, t, rng.choice(["user", "assistant"]), f"t{t}.") for t in range(1500)]
    rows += [(2, t, ("assistant", "user")[t % 2], f"t{t}.") for t in range(700)] + [(3, t, ("user", "assistant")[t % 2], f"t{t}") for t in range(401)]
    checked(spark, rows, hurt_first=False)


def test_every_row_dropped(spark):
    conv = next(c for c in range(10_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = turn_repair.repair(turn_repair.damaged(spark.createDataFrame([(conv, 0, "user", "Hi.")], SCHEMA))).collect()
    assert [tuple(r) for r in got] == [(conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_empty_table_extra_columns_and_very_long_text(spark):
    assert turn_repair.repair(spark.createDataFrame([], SCHEMA)).collect() == []
    long = "word " * 400_000 + "end."
    table = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", "Ok.")], SCHEMA)
    clash = table.withColumns({"fault": F.lit("x"), "nth": F.lit(1), "audit": F.lit("y")})
    got = turn_repair.repair(clash).first()
    assert (got["cost"], got["audit"]) == (0, "KK")
    assert got["repaired_sha256"] == hashlib.sha256(f"user:{long}\nassistant:Ok.".encode()).hexdigest()
