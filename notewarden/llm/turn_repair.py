"""Repair of a conversation's structure: generalised LR over the role grammar.

Every stack of the graph-structured stack reads the same turns with other edits.
Stacks that come to the same top are merged, and the one of the least (cost, audit)
stays.  That is exact here: in this grammar the top decides what may follow, and of
two audits of one cost for the same turns none begins the other, since an audit
fixes its edits; so a smaller audit stays smaller whatever follows."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import importable, small_batches

#: Role grammar: an optional system turn, then pairs of a user and an assistant turn, or nothing.
GRAMMAR = [
    ("Talk", ()),
    ("Talk", ("Body",)),
    ("Body", ("s", "Pairs")),
    ("Body", ("Pairs",)),
    ("Pairs", ("Pair",)),
    ("Pairs", ("Pairs", "Pair")),
    ("Pair", ("u", "a")),
]
ROLES = {"u": "user", "a": "assistant"}
LEGAL = frozenset(("su", "ua", "au"))
BLANKS = " \t\n\x0b\x0c\r"
#: Edits after which the audits of all stacks are cut to what still tells them apart.
REBASE = 64
COSTS = {"rerole": 3, "delete": 4, "insert": 3, "truncated": 3}


def _closure(items: frozenset) -> frozenset:
    out, todo = set(items), list(items)
    while todo:
        rule, dot = todo.pop()
        right = GRAMMAR[rule][1]
        for k, (left, _) in enumerate(GRAMMAR):
            if dot < len(right) and left == right[dot] and (k, 0) not in out:
                out.add((k, 0))
                todo.append((k, 0))
    return frozenset(out)


@functools.cache
def automaton() -> tuple[list[frozenset], dict[tuple[int, str], int]]:
    """LR(0) states of the grammar and the moves between them."""
    states = [_closure(frozenset((k, 0) for k, (left, _) in enumerate(GRAMMAR) if left == "Talk"))]
    moves: dict[tuple[int, str], int] = {}
    for at, state in enumerate(states):
        for symbol in sorted({GRAMMAR[r][1][d] for r, d in state if d < len(GRAMMAR[r][1])}):
            to = _closure(frozenset((r, d + 1) for r, d in state if d < len(GRAMMAR[r][1]) and GRAMMAR[r][1][d] == symbol))
            if to not in states:
                states.append(to)
            moves[at, symbol] = states.index(to)
    return states, moves


def _reduced(node: tuple, goals: tuple[str, ...]) -> tuple[tuple, str | None]:
    """The stack after all reductions whose left side is not one of `goals`, and the goal that it ends with, if any."""
    states, moves = automaton()
    while True:
        ready = [GRAMMAR[r] for r, d in states[node[0]] if d == len(GRAMMAR[r][1])]
        rule = next((r for r in ready if r[0] not in goals), None)
        if rule is None:
            return node, ready[0][0] if ready else None
        for _ in rule[1]:
            node = node[1]
        node = (moves[node[0], rule[0]], node)


@functools.cache
def shift(node: tuple, role: str) -> tuple | None:
    """The stack `node` (state, stack below) after a turn of this role, or None."""
    to = automaton()[1].get((node[0], role))
    return None if to is None else _reduced((to, node), ("Body", "Talk"))[0]


@functools.cache
def complete(node: tuple) -> bool:
    return _reduced(node, ("Talk",))[1] == "Talk"


class Stack:
    """A stack's edits so far.  Audits compare by (`rank`, `tail`): equal ranks have
    the same edits up to the tail, other ranks differ before it."""

    __slots__ = ("node", "cost", "rank", "tail", "past", "digest", "size")

    def __init__(self, node, cost, rank, tail, past, digest, size):
        self.node, self.cost, self.rank, self.tail, self.past, self.digest, self.size = node, cost, rank, tail, past, digest, size

    def edited(self, node: tuple, cost: int, edit: str, line: str | None) -> Stack:
        digest, size = self.digest, self.size
        if line is not None:
            digest = digest.copy()
            digest.update((("\n" if size else "") + line).encode("utf-8", "surrogatepass"))
            size += 1
        return Stack(node, self.cost + cost, self.rank, self.tail + edit, self.past, digest, size)


class Repair:
    """Reads a conversation's turns in order; memory holds one stack for each top, and their audits."""

    def __init__(self, costs: dict[str, int]):
        self.costs = costs
        self.tops: dict[int, Stack] = {0: Stack((0, None), 0, 0, "", None, hashlib.sha256(), 0)}
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.low = self.high = self.turn = self.before = None
        self._inserted()

    def _inserted(self) -> None:
        """Stacks that inserted turns reach; each is kept where it is the least for its top."""
        todo = list(self.tops.values())
        while todo:
            at = todo.pop()
            if self.tops[at.node[0]] is not at:
                continue
            for role, name in ROLES.items():
                node = shift(at.node, role)
                if node is not None:
                    key, old = (at.cost + self.costs["insert"], at.rank, at.tail + "I"), self.tops.get(node[0])
                    if old is None or key < (old.cost, old.rank, old.tail):
                        self.tops[node[0]] = new = at.edited(node, self.costs["insert"], "I", f"{name}:")
                        todo.append(new)

    def _rebase(self) -> None:
        """Ranks anew, so that tails stay short.  Audits of which one begins the other keep one rank."""
        rank, head = -1, None
        for s in sorted(self.tops.values(), key=lambda s: (s.rank, s.tail)):
            if head is None or s.rank != head[0] or not s.tail.startswith(head[1]):
                rank, head = rank + 1, (s.rank, s.tail)
            s.rank, s.past, s.tail = rank, (s.past, head[1]), s.tail[len(head[1]) :]

    def read(self, turn: int | None, role: str, text: str, fault: str | None) -> None:
        if turn is not None:
            self.low, self.high = turn if self.low is None else self.low, turn
            self.distinct += turn != self.turn
            self.turn = turn
        if self.before is not None and self.before + role[:1] not in LEGAL:
            self.illegal += 1
        self.before = role[:1]
        if fault:
            setattr(self, fault, getattr(self, fault) + 1)
        best: dict[int, tuple] = {}

        def offer(s: Stack, node: tuple | None, cost: int, edit: str, name: str | None) -> None:
            if node is not None:
                key, old = (s.cost + cost, s.rank, s.tail + edit), best.get(node[0])
                if old is None or key < old[0]:
                    best[node[0]] = key, s, node, cost, edit, name

        extra = self.costs["truncated"] if fault == "truncated" else 0
        for s in self.tops.values():
            offer(s, s.node, self.costs["delete"], "D", None)
            if fault not in ("blank", "duplicate"):
                offer(s, shift(s.node, role[:1]), extra, "K", role)
                for initial, name in ROLES.items():
                    offer(s, shift(s.node, initial), extra + self.costs["rerole"], "R", name)
        self.tops = {top: s.edited(node, cost, edit, None if name is None else f"{name}:{text}") for top, (_, s, node, cost, edit, name) in best.items()}
        if max(len(s.tail) for s in self.tops.values()) > REBASE:
            self._rebase()
        self._inserted()

    def result(self) -> tuple:
        s = min((s for s in self.tops.values() if complete(s.node)), key=lambda s: (s.cost, s.rank, s.tail))
        parts, past = [s.tail], s.past
        while past:
            parts.append(past[1])
            past = past[0]
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, s.cost, "".join(reversed(parts)), s.digest.hexdigest()


def damaged(rows: DataFrame) -> DataFrame:
    """`rows` (conv_id, turn, role, text) damaged by crc32("conv_id:turn") % 20:
    0 marks a row as `gone`, 1 empties its text, 2 takes its `[.!?]`, 3 repeats it, 4
    sets its role to user.  A null role, text or part of the key is one space."""
    blank = F.lit(" ")
    spoken = lambda c: F.coalesce(F.col(c).cast("string"), blank)
    kind = (F.crc32(F.concat(spoken("conv_id"), F.lit(":"), spoken("turn"))) % 20).cast("int")
    text, role = spoken("text"), spoken("role")
    hit = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), kind.alias("kind"))
    return hit.select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("kind") == 0).alias("gone"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )


def _fault(seen: Column) -> Column:
    bare = F.rtrim("text", F.lit(BLANKS))
    return F.when(bare == "", "blank").when(seen, "duplicate").when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "truncated")


def ordered(rows: DataFrame, partitions: int | None = None) -> DataFrame:
    """Rows with their `fault`, a conversation's rows one after the other in one
    partition: by turn (nulls first), role and text.  One shuffle; sorts can spill."""
    if "gone" not in rows.columns:
        rows = rows.withColumn("gone", F.lit(False))
    if "copy" not in rows.columns:
        rows = rows.withColumn("copy", F.lit(0))
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), "gone", "copy")
    dealt = rows.repartition(partitions, "conv_id") if partitions else rows.repartition("conv_id")
    same = Window.partitionBy("conv_id", "gone", "role", "text").orderBy("turn", "copy")
    marked = dealt.withColumn("nth", F.row_number().over(same)).withColumn("fault", _fault(F.col("nth") > 1)).drop("nth")
    return marked.sortWithinPartitions("conv_id", "turn", "role", "text", "copy")


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repair(rows: DataFrame, costs: dict[str, int] | None = None) -> DataFrame:
    """One row per conv_id of `rows` (conv_id, turn, role, text; optionally `gone`, for
    rows that only name their conversation, and `copy`, an order inside equal rows).

    Faults of a row, the first counts: `blank`, `duplicate` (role and text stood
    earlier), `truncated` (does not end in `.`, `!` or `?`).  `illegal` counts
    neighbours whose role initials are not su, ua or au, `gaps` the missing turn
    numbers.  `audit` has the initials of the cheapest edits (Keep, Rerole, Delete,
    Insert) in order, the ASCII-least of several, after which the role initials are
    `(s?(ua)+)?`; `repaired_sha256` is the digest of the repaired `role:text` lines,
    and `repaired_turns` gives them as rows.

    Null roles and texts are one space.  A null conv_id is a conversation; rows of one
    turn go by role and text; other columns are left out; an empty table gives an empty
    one.  A digest needs its conversation in order, so one task reads it as a stream:
    it holds a few stacks and their audits, never the texts."""
    importable(rows.sparkSession)
    small_batches(rows.sparkSession)
    costs = COSTS | (costs or {})
    work = ordered(rows)
    schema = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {RESULT}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        current, parser, names = None, None, [x.split()[0] for x in RESULT.split(", ")]

        def flushed() -> pa.RecordBatch:
            ids, columns = pa.array([x[0] for x in done], id_type), list(zip(*(x[1] for x in done)))
            types = [pa.string() if n in ("audit", "repaired_sha256") else pa.int64() for n in names]
            done.clear()
            return pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(columns, types))], names=["conv_id", *names])

        for batch in batches:
            id_type = batch.schema.field("conv_id").type
            cols = {n: batch.column(n) for n in batch.schema.names}
            for conv, turn, role, text, gone, fault in zip(*(cols[n].to_pylist() for n in ("conv_id", "turn", "role", "text", "gone", "fault"))):
                if parser is None or conv != current:
                    if parser is not None:
                        done.append((current, parser.result()))
                    current, parser = conv, Repair(costs)
                if not gone:
                    parser.read(turn, role, text, fault)
            if len(done) >= 1000:
                yield flushed()
        if parser is not None:
            done.append((current, parser.result()))
            yield flushed()

    return work.select("conv_id", "turn", "role", "text", "gone", "fault").mapInArrow(run, schema)


def repaired_turns(rows: DataFrame, repaired: DataFrame) -> DataFrame:
    """The repaired conversations as rows: conv_id, `place` (from 0), `edit`, role, text.
    `repaired` is the result of `repair` for `rows`; only its audits are exploded."""
    steps = repaired.select(F.col("conv_id").alias("c"), F.posexplode(F.split("audit", "(?!^)")).alias("step", "edit")).filter(F.col("edit") != "")
    by = Window.partitionBy("c").orderBy("step")
    stays = (F.col("edit") != "D").cast("long")
    steps = steps.select(
        "c", "edit", (F.sum((F.col("edit") != "I").cast("long")).over(by)).alias("n"), (F.sum(stays).over(by) - 1).alias("place")
    ).withColumn("n", F.when(F.col("edit") != "I", F.col("n")))
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text", "copy"))
    turns = ordered(rows).filter(~F.col("gone")).select("conv_id", "role", "text", number.cast("long").alias("m"))
    joined = steps.filter(F.col("edit") != "D").join(turns, F.col("c").eqNullSafe(F.col("conv_id")) & (F.col("n") == F.col("m")), "left")
    # the initial at each place follows from the grammar: a kept system turn first, then user and assistant by turns
    lead = F.max(F.when((F.col("place") == 0) & (F.col("edit") == "K") & (F.left("role", F.lit(1)) == "s"), 1).otherwise(0)).over(Window.partitionBy("c"))
    odd = (F.col("place") - lead) % 2 == 1
    role = F.when(F.col("edit") == "K", F.col("role")).when(odd, "assistant").otherwise("user")
    return joined.select(F.col("c").alias("conv_id"), F.col("place").cast("long").alias("place"), "edit", role.alias("role"), F.coalesce("text", F.lit("")).alias("text"))
