"""Cheapest repair of conversations whose roles break a grammar: generalised LR parsing with weighted edits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .common import only, rows_below, written

# Repaired initials are ``(s?(ua)+)?``: Talk -> nothing | Pairs | s Pairs; Pairs -> Pair | Pairs Pair; Pair -> u a. The states
# on top of the parser's stack: nothing read, after s, after u, after Pairs. After u a the parser reduces: Pair takes both
# off, and Pairs, new or grown, lies on top.
START, SYSTEM, USER, PAIRS = range(4)
SHIFT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (PAIRS, "u"): USER, (USER, "a"): PAIRS}
ACCEPTING = (START, PAIRS)
# What may be inserted, or a turn made to, on each top: the symbol of the two that the parser can shift.
WANTED = ("u", "u", "a", "u")
ROLES = {"u": "user", "a": "assistant"}
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
# Inserted turns before a kept one or the end: two lead from any top to every other that can be reached.
INSERTS = 2
SPACE = " \t\n\v\f\r"
# Initials of neighbours that may follow each other.
LEGAL = {"su", "ua", "au"}
# A conversation's rows that are parsed together, and their characters; longer ones are parsed in parts that are put together.
PART_ROWS, PART_CHARS = 4096, 1 << 22
# Rows of some 40 bytes up to which repeated turns are sent to the texts; beyond, texts are shuffled.
BROADCAST_ROWS = 500_000

TURNS = "conv_id long, turn long, role string, text string, repeated boolean"
RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
# What a part tells besides its turns: counts, ends, and for each top before it the cost and rank of each top after it.
SUMMARY = (
    "conv_id long, part long, seq long, blank long, duplicate long, truncated long, illegal long, turns long, first_turn long, last_turn long, "
    "first_role string, last_role string, costs array<long>, ranks array<int>"
)
PART = SUMMARY + ", kinds binary, roles array<string>, texts array<string>"


class Step(NamedTuple):
    """One turn read: costs of the tops after it (None: no stack has that top), their ranks by audit, and where each came from."""

    costs: tuple[int | None, ...]
    ranks: tuple[int, ...]
    base: int
    came: tuple[tuple[int, str] | None, ...]


class Parser:
    """Reads turns by kind. All stacks with equal tops merge into the one of the least (cost, audit), so that at most four
    tops are alive; what follows depends on their costs, up to a constant, and on the order of their audits only, and is
    kept once it is known.

    Audits are made of steps, inserts and then a turn's letter, none of which begins another; so two audits compare as the
    first steps in which they differ, and the order after a turn follows from the order before it.
    """

    def __init__(self) -> None:
        self.known: dict[tuple, Step] = {}

    def step(self, costs: tuple, ranks: tuple, kind: int) -> Step:
        key = (costs, ranks, kind)
        found = self.known.get(key)
        if found is None:
            found = self.known[key] = self._step(costs, ranks, kind)
        return found

    def _step(self, costs: tuple, ranks: tuple, kind: int) -> Step:
        best: list[tuple | None] = [None] * 4
        initial, fault = "sua?"[kind // 3], kind % 3
        for came, cost in enumerate(costs):
            if cost is None:
                continue
            top = came
            for inserts in range(INSERTS + 1):
                if inserts:
                    top, cost = SHIFT[top, WANTED[top]], cost + INSERT
                ways = [("D", top, DELETE)]
                if fault != 2:
                    extra = TRUNCATED * (fault == 1)
                    ways.append(("R", SHIFT[top, WANTED[top]], REROLE + extra))
                    if (top, initial) in SHIFT:
                        ways.append(("K", SHIFT[top, initial], extra))
                for letter, after, more in ways:
                    way = (cost + more, ranks[came], "I" * inserts + letter, came)
                    if best[after] is None or way < best[after]:
                        best[after] = way
        alive = [w for w in best if w]
        base = min(w[0] for w in alive)
        order = sorted(w[1:3] for w in alive)
        return Step(
            tuple(w and w[0] - base for w in best), tuple(order.index(w[1:3]) if w else -1 for w in best), base,
            tuple(w and (w[3], w[2]) for w in best),
        )

    def read(self, kinds: bytes, start: int) -> tuple[list[int | None], list[int], list[Step]]:
        """Costs and ranks of the tops after all turns, from one top, and the steps."""
        costs: tuple = tuple(0 if t == start else None for t in range(4))
        ranks: tuple = tuple(0 if t == start else -1 for t in range(4))
        total, steps = 0, []
        for kind in kinds:
            step = self.step(costs, ranks, kind)
            costs, ranks, total = step.costs, step.ranks, total + step.base
            steps.append(step)
        return [None if c is None else c + total for c in costs], list(ranks), steps


def closing(top: int) -> int:
    """Turns to insert after the last one."""
    return {START: 0, PAIRS: 0, USER: 1, SYSTEM: 2}[top]


def trace(steps: list[Step], end: int) -> str:
    """The audit that leads to the top ``end``."""
    audit = []
    for step in reversed(steps):
        end, letters = step.came[end]
        audit.append(letters)
    return "".join(reversed(audit))


def repaired(audit: str, start: int, roles: list[str], texts: list[str]) -> Iterator[str]:
    """``role:text`` of every turn that an audit leaves, from the top before it."""
    top, turns = start, zip(roles, texts, strict=True)
    for letter in audit:
        if letter == "D":
            next(turns)
            continue
        wanted = WANTED[top]
        if letter == "I":
            role, text, symbol = ROLES[wanted], "", wanted
        else:
            role, text = next(turns)
            role, symbol = (ROLES[wanted], wanted) if letter == "R" else (role, role[:1])
        top = SHIFT[top, symbol]
        yield f"{role}:{text}"


class Run:
    """Turns of a conversation that follow each other, with what counts over them."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.seq, self.chars = conv_id, 0, 0
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.kinds = bytearray()
        self.counts = [0, 0, 0, 0]  # blank, duplicate, truncated, illegal
        self.turns, self.first_turn, self.last_turn = 0, None, None
        self.last: tuple | None = None  # the turn before, also across parts

    def add(self, turn: int | None, role: str, text: str, repeated: bool) -> None:
        core = text.strip(SPACE)
        fault = 0 if not core else 1 if repeated or self.last == (turn, role, text) else 2 if core[-1] not in ".!?" else None
        if fault is not None:
            self.counts[fault] += 1
        if self.roles:
            self.counts[3] += self.roles[-1][:1] + role[:1] not in LEGAL
        initial = "sua".find(role[:1]) if role else -1
        self.kinds.append(3 * (initial if initial >= 0 else 3) + (2 if fault in (0, 1) else 1 if fault == 2 else 0))
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        self.roles.append(role)
        self.texts.append(text)
        self.chars += len(text)
        self.last = (turn, role, text)

    def full(self) -> bool:
        return len(self.roles) >= PART_ROWS or self.chars >= PART_CHARS

    def next_part(self) -> Run:
        rest = Run(self.conv_id)
        rest.seq, rest.last = self.seq + 1, self.last
        return rest


def solve(run: Run, parser: Parser) -> tuple:
    """The result row of a whole conversation."""
    costs, ranks, steps = parser.read(bytes(run.kinds), START)
    cost, _, end = min((c + INSERT * closing(t), ranks[t], t) for t, c in enumerate(costs) if c is not None)
    audit = trace(steps, end) + "I" * closing(end)
    digest = hashlib.sha256("\n".join(repaired(audit, START, run.roles, run.texts)).encode()).hexdigest()
    gaps = run.last_turn - run.first_turn + 1 - run.turns if run.turns else 0
    return (run.conv_id, gaps, *run.counts, cost, audit, digest)


def summary(run: Run, parser: Parser, part: int, seq: int) -> tuple:
    """A ``PART`` row."""
    costs, ranks = [], []
    for start in range(4):
        c, r, _ = parser.read(bytes(run.kinds), start)
        costs += c
        ranks += r
    return (
        run.conv_id, part, seq, *run.counts, run.turns, run.first_turn, run.last_turn, run.roles[0][:1], run.roles[-1][:1], costs, ranks,
        bytes(run.kinds), run.roles, run.texts,
    )


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}
    return pa.schema([(name, kinds[kind]) for name, kind in (field.split(" ") for field in ddl.split(", "))])


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    schema = _schema(ddl)
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def parse_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function over turns in global order: ``RESULT`` of conversations that lie whole and small in the task, ``PART`` of
    the others, which may go on in the tasks beside this one."""
    parser, place = Parser(), TaskContext.get().partitionId()
    done: list[tuple] = []
    parts: list[tuple] = []
    empty_done, empty_part = (None,) * len(RESULT.split(", ")), (None,) * (len(PART.split(", ")) - 1)
    run, first, number = None, True, 0

    def flush() -> pa.RecordBatch:
        rows = [d + empty_part for d in done] + [p[:1] + empty_done[1:] + p[1:] for p in parts]
        done.clear()
        parts.clear()
        return _batch(rows, MIXED)

    for batch in rows_below(batches, 1024):
        for conv_id, turn, role, text, repeated in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "repeated")), strict=True):
            if run is None:
                run = Run(conv_id)
            elif run.conv_id != conv_id:
                if first or run.seq:
                    parts.append(summary(run, parser, place, number))
                    number += 1
                else:
                    done.append(solve(run, parser))
                run, first = Run(conv_id), False
            elif run.full():
                parts.append(summary(run, parser, place, number))
                number += 1
                run = run.next_part()
                yield flush()
            run.add(turn, role, text, repeated)
        yield flush()
    if run is not None:
        parts.append(summary(run, parser, place, number))
    yield flush()


MIXED = RESULT + ", " + PART.removeprefix("conv_id long, ").replace("blank long, duplicate long, truncated long, illegal long", "n_blank long, n_duplicate long, n_truncated long, n_illegal long")


def choose_tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function over summaries sorted by (conversation, part, seq): ``part, seq, start, end, last`` of the cheapest repair.

    The stacks of a conversation's parts are put together as those of its turns are: the tops before a part and the costs and
    ranks it adds give the tops after it. For each part one number a top is kept.
    """
    names = ("conv_id", "part", "seq", "costs", "ranks")
    own: list = []

    def chosen(trail: list[tuple], costs: list, ranks: list) -> list[tuple]:
        _, _, end = min((c + INSERT * closing(t), ranks[t], t) for t, c in enumerate(costs) if c is not None)
        rows = []
        for k in range(len(trail) - 1, -1, -1):
            part, seq, came = trail[k]
            rows.append((part, seq, came[end], end, int(k == len(trail) - 1)))
            end = came[end]
        return rows

    kinds = "part long, seq long, start int, end int, last int"
    trail: list[tuple] = []
    costs: list = []
    ranks: list = []
    for batch in batches:
        rows = []
        for conv_id, part, seq, more, order in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            if own != [conv_id]:
                if trail:
                    rows += chosen(trail, costs, ranks)
                own, trail, costs, ranks = [conv_id], [], [0, None, None, None], [0, -1, -1, -1]
            best: list[tuple | None] = [None] * 4
            for came, cost in enumerate(costs):
                for end in range(4):
                    add = more[4 * came + end]
                    if cost is not None and add is not None:
                        way = (cost + add, ranks[came], order[4 * came + end], came)
                        best[end] = way if best[end] is None else min(best[end], way)
            places = sorted(w[1:3] for w in best if w)
            costs, ranks = [w and w[0] for w in best], [places.index(w[1:3]) if w else -1 for w in best]
            trail.append((part, seq, bytes(w[3] if w else 0 for w in best)))
        yield _batch(rows, kinds)
    yield _batch(chosen(trail, costs, ranks) if trail else [], kinds)


def repair_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function: the audit and the repaired lines of every part between its chosen tops."""
    parser = Parser()
    for batch in rows_below(batches, 16):
        audits, lines, added = [], [], []
        for kinds, start, end, last, roles, texts in zip(*(batch.column(c).to_pylist() for c in ("kinds", "start", "end", "last", "roles", "texts")), strict=True):
            costs, _, steps = parser.read(kinds, start)
            audits.append(trace(steps, end) + "I" * (closing(end) if last else 0))
            added.append(costs[end] + (INSERT * closing(end) if last else 0))
            kept = list(repaired(audits[-1], start, roles, texts))
            lines.append("\n".join(kept).encode() if kept else None)
        keep = batch.select(_schema(SUMMARY).names[:12])
        yield pa.RecordBatch.from_arrays(
            [*keep.columns, pa.array(added, pa.int64()), pa.array(audits, pa.string()), pa.array(lines, pa.binary())], [*keep.schema.names, "cost", "audit", "lines"]
        )


REPAIRED = ", ".join(SUMMARY.split(", ")[:12]) + ", cost long, audit string, lines binary"


def join_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function over repaired parts sorted by (conversation, part, seq): ``RESULT``. Lines pass through the checksum one
    part at a time; of a conversation only its audit is held, which is a value of its result."""
    own: list = []
    counts = [0] * 5
    audits: list[str] = []
    digest, any_line, turns, first_turn, last_turn, last_role = hashlib.sha256(), False, 0, None, None, ""

    def result() -> tuple:
        gaps = last_turn - first_turn + 1 - turns if turns else 0
        return (own[0], gaps, *counts, "".join(audits), digest.hexdigest())

    for batch in rows_below(batches, 16):
        rows = []
        for r in batch.to_pylist():
            if own != [r["conv_id"]]:
                if own:
                    rows.append(result())
                own, counts, audits = [r["conv_id"]], [0] * 5, []
                digest, any_line, turns, first_turn, last_turn, last_role = hashlib.sha256(), False, 0, None, None, None
            for k, name in enumerate(("blank", "duplicate", "truncated", "illegal", "cost")):
                counts[k] += r[name]
            if last_role is not None:
                counts[3] += last_role + r["first_role"] not in LEGAL
            last_role = r["last_role"]
            if r["turns"]:
                turns += r["turns"] - (turns > 0 and last_turn == r["first_turn"])
                first_turn = r["first_turn"] if first_turn is None else first_turn
                last_turn = r["last_turn"]
            audits.append(r["audit"])
            if r["lines"] is not None:
                digest.update(b"\n" if any_line else b"")
                digest.update(r["lines"])
                any_line = True
        yield _batch(rows, RESULT)
    yield _batch([result()] if own else [], RESULT)


def turn_key() -> Column:
    """A checksum of conversation, role and text."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit(":"), "role", F.lit(":"), F.md5("text"))))


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The cheapest edits that make every conversation's roles fit ``(s?(ua)+)?`` by their initials, one row (``RESULT``) each.

    A conversation's rows are taken by turn, nulls first, rows of one turn by role and then by a checksum of their text. A
    row's first fault counts: ``blank`` (nothing but ASCII white space), ``duplicate`` (role and text as in a row before),
    ``truncated`` (the last character that is not white space is none of ``.!?``); ``illegal`` counts neighbours whose initials are
    none of su, ua, au; ``gaps`` are turns missing between the least and the greatest. Edits: keep 0, rerole to user or assistant
    1, delete 2 (blank and duplicate rows must go), insert an empty turn 5; a truncated row that stays costs 5 more.
    ``audit`` holds the edits' initials of the cheapest repair, the ASCII-least of several; ``repaired_sha256`` is the
    checksum of its ``role:text`` lines.

    Turns are sorted over the whole table, so a conversation of any size lies in as many tasks as its rows ask for. One that
    lies in one task is parsed there; the others are parsed in parts, for every top of the stack that may come
    before: parts join as turns do, by minimum (cost, audit). Only small summaries of the parts meet; then each part is
    repaired on its own. A checksum is sequential: the repaired lines of such a conversation pass one task, one part at a time, unheld.

    Null roles and texts are one space; a null conversation is one, too; roles count by their first letter, an empty role or
    another letter fits nowhere unless reroled; repeated rows are duplicates; an empty table gives an empty result; other columns are
    not carried along.
    """
    rows = only(turns, conv_id=f"{conv_col}:long", turn=f"{turn_col}:long", role=f"{role_col}:string", text=f"{text_col}:string")
    rows = rows.withColumn("role", F.coalesce("role", F.lit(" "))).withColumn("text", F.coalesce("text", F.lit(" "))).withColumn("key", turn_key())
    # Nulls come first: no turn is 0, a turn 1, and then by its number.
    place = F.struct(F.col("turn").isNotNull().alias("given"), "turn")
    seen = rows.groupBy("key").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first <> last").select("key", "first")
    seen = written(seen, "repeated-turns")
    if seen.count() <= BROADCAST_ROWS:
        seen = F.broadcast(seen)
    rows = rows.join(seen, "key", "left").withColumn("repeated", F.coalesce(place > F.col("first"), F.lit(False)))
    # Rows alike in all of these are equal, and so stay together.
    order = ("conv_id", "turn", "role", "key")
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "repeated")
    parsed = written(sorted_rows.mapInArrow(parse_turns, MIXED), "parsed-turns")
    whole = parsed.filter("part IS NULL").select(*_schema(RESULT).names)
    parts = parsed.filter("part IS NOT NULL").drop(*_schema(RESULT).names[1:]).withColumnsRenamed({f"n_{c}": c for c in ("blank", "duplicate", "truncated", "illegal")})
    summaries = parts.select("conv_id", "part", "seq", "costs", "ranks").repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    chosen = summaries.mapInArrow(choose_tops, "part long, seq long, start int, end int, last int")
    mended = parts.join(chosen, ["part", "seq"]).mapInArrow(repair_parts, REPAIRED)
    split = mended.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(join_parts, RESULT)
    return whole.unionByName(split)


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with faults set by a checksum of their place: a turn in twenty each dropped, emptied, robbed of its
    sentence marks, repeated, or made the user's. Nulls count as one space."""
    filled = only(conversations, conv_id="conv_id:long", turn="turn:long", role="role:string", text="text:string")
    filled = filled.withColumn("role", F.coalesce("role", F.lit(" "))).withColumn("text", F.coalesce("text", F.lit(" ")))
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    way = F.crc32(name.cast("binary")) % 20
    copies = F.when(way == 0, 0).when(way == 3, 2).otherwise(1)
    return filled.select(
        "conv_id", "turn", F.when(way == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(way == 1, "").when(way == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(0), copies)).alias("copy"),
    ).drop("copy")


def with_every_conversation(repaired: DataFrame, conversations: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Add the conversations of which no row is left: nothing counted, no edits, the checksum of the empty text."""
    ids = only(conversations, every=f"{conv_col}:long").distinct()
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    joined = ids.join(repaired, F.col("every").eqNullSafe(F.col("conv_id")), "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return joined.select(
        F.col("every").alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256")
    )
