"""Repair of conversations against a search over all edits."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from palisade.llm import queries, turn_repair
from pyspark.sql import functions as F

SCHEMA = "conv_id long, turn long, role string, text string, audit string, repeated boolean, part long"


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def search(rows):
    """Cheapest edits of [(role, text, fault)] by uniform cost over (cost, audit): the first end found is the least."""
    queue = [(0, "", 0, "", ())]
    seen = set()
    while queue:
        cost, audit, at, initials, lines = heapq.heappop(queue)
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            return cost, audit, "\n".join(lines)
        known = (at, initials if len(rows) < 50 else initials[-1:])
        if known in seen or not re.fullmatch("s?(ua)*u?", initials):
            continue
        seen.add(known)
        if len(initials) < 2 * len(rows) + 2:
            for role in ("user", "assistant"):
                heapq.heappush(queue, (cost + 5, audit + "I", at, initials + role[0], (*lines, f"{role}:")))
        if at < len(rows):
            role, text, fault = rows[at]
            heapq.heappush(queue, (cost + 2, audit + "D", at + 1, initials, lines))
            if fault not in ("blank", "duplicate"):
                extra = 5 * (fault == "truncated")
                heapq.heappush(queue, (cost + extra, audit + "K", at + 1, initials + (role[:1] or "?"), (*lines, f"{role}:{text}")))
                for other in ("user", "assistant"):
                    heapq.heappush(queue, (cost + 1 + extra, audit + "R", at + 1, initials + other[0], (*lines, f"{other}:{text}")))
    raise AssertionError


def brute_force(turns):
    """Result rows of (conv_id, turn, role, text) by plain Python."""
    out = set()
    for conv in {r[0] for r in turns}:
        rows = [(t, " " if role is None else role, " " if text is None else text) for c, t, role, text in turns if c == conv]
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), bytes.fromhex(md5(f"{'' if conv is None else conv}:{r[1]}:{md5(r[2])}"))))
        counts, seen, judged = {"blank": 0, "duplicate": 0, "truncated": 0}, set(), []
        for _, role, text in rows:
            core = text.strip(" \t\n\v\f\r")
            fault = "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            judged.append((role, text, fault))
        given = [t for t, _, _ in rows if t is not None]
        gaps = max(given) - min(given) + 1 - len(set(given)) if given else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit, text = search(judged)
        out.add((conv, gaps, *counts.values(), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return out


def repaired(spark, turns, parts=4):
    df = spark.createDataFrame([(*r, "x", True, 1) for r in turns], SCHEMA).repartition(parts)
    got = turn_repair.repair(df)
    assert got.columns == turn_repair._schema(turn_repair.RESULT).names
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def some_turns(seed, conversations, most):
    draw = random.Random(seed)
    texts = ["a.", "b!", "c?", "open", " ", "", None, "d. \n", "é.", "x.\x0b"]
    roles = ["user"] * 5 + ["assistant"] * 5 + ["system", "system", "tool", "", None, "User"]
    turns = []
    for conv in range(conversations):
        for k in range(draw.randint(1, most)):
            turns += [(conv, draw.choice([k, k, k, k + 2, None]), draw.choice(roles), draw.choice(texts))] * draw.choice([1, 1, 1, 1, 2])
    return turns


@pytest.mark.parametrize("limit", [4096, 2])
def test_random_conversations(spark, limit, monkeypatch):
    monkeypatch.setattr(turn_repair, "PART_ROWS", limit)
    turns = some_turns(limit, 150, 7) + [(None, 0, "user", "a."), (None, None, None, None), (None, 2, "assistant", "b.")]
    assert repaired(spark, turns) == brute_force(turns)


def test_parser_without_spark():
    parser = turn_repair.Parser()
    for seed in range(300):
        run = turn_repair.Run(1)
        turns = sorted(some_turns(seed, 1, 8), key=lambda r: (r[1] is not None, r[1] or 0))
        for _, turn, role, text in turns:
            run.add(turn, role or " ", " " if text is None else text, any(role == o[2] and text == o[3] for o in turns[: len(run.roles)]))
        faults = [("s", "u", "a", "?")[k // 3] for k in run.kinds]
        assert len(faults) == len(turns)
        judged = [(r, t, [None, "truncated", "blank"][k % 3]) for r, t, k in zip(run.roles, run.texts, run.kinds, strict=True)]
        cost, audit, text = search(judged)
        assert turn_repair.solve(run, parser)[-3:] == (cost, audit, hashlib.sha256(text.encode()).hexdigest())


def test_one_conversation_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(turn_repair, "PART_ROWS", 50)
    monkeypatch.setattr(turn_repair, "BROADCAST_ROWS", 0)
    draw = random.Random(2)
    turns = [(7, k, draw.choice(["user", "assistant", "assistant", "tool"]), f"t{k}" + draw.choice(["", "."])) for k in range(1500)]
    turns += [(c, k, ("user", "assistant")[k % 2], "same.") for c in range(20) for k in range(3)] + [(7, 1000, "user", "long " * 100_000)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        assert repaired(spark, turns) == brute_force(turns)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_damage_and_lost_conversations(spark, sf, table):
    rows = table("conversations").select("conv_id", "turn", "role", "text").collect()
    turns = []
    for conv, turn, role, text in rows:
        way = zlib.crc32(f"{conv}:{turn}".encode()) % 20
        role, text = "user" if way == 4 else role, "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text
        turns += [(conv, turn, role, text)] * (0 if way == 0 else 2 if way == 3 else 1)
    got = {tuple(r) for r in queries.op12_turn_repair(spark, sf).collect()}
    want = brute_force(turns)
    lost = {r[0] for r in rows} - {r[0] for r in turns}
    assert got == want | {(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in lost}
    name = next(n for n in range(1000) if zlib.crc32(f"{n}: ".encode()) % 20 == 0)
    gone = spark.createDataFrame([(name, None, "user", "a.", "x", True, 1), (None, 3, None, None, "x", True, 1)], SCHEMA)
    left = turn_repair.with_every_conversation(turn_repair.repair(turn_repair.damaged(gone)), gone).collect()
    assert {r["conv_id"]: (r["cost"], r["audit"]) for r in left} == {name: (0, ""), None: (2, "D") if zlib.crc32(b" :3") % 20 not in (0, 3) else (0, "")}


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert turn_repair.repair(empty).collect() == []
    assert turn_repair.with_every_conversation(turn_repair.repair(turn_repair.damaged(empty)), empty).collect() == []
    assert turn_repair.damaged(empty).filter(F.col("role").isNull()).count() == 0
