"""Conversation repair against a plain recursion over all edits, whole and in small blocks."""

import hashlib
import random
import re
import zlib
from functools import cache

import pytest
from pyspark.sql import functions as F

from skeinframe.llm import conversation_repair as c
from skeinframe.llm import queries as q
from tests.conftest import DATA

SPACE = " \t\n\x0b\x0c\r"
GOAL = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if d:
            text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
            out += [(conv, turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
    return out


def plain_repair(rows):
    """rows: (turn, role, text) of one conversation, after damage; ties of a turn in the operator's order."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
    seen, faults = set(), []
    for _, role, text in rows:
        t = text.rstrip(SPACE)
        faults.append("blank" if not t else "duplicate" if (role, text) in seen else "truncated" if t[-1] not in ".!?" else "")
        seen.add((role, text))

    @cache
    def best(i, state, spare):
        """(cost, audit, lines) of the cheapest way on; spare: inserts that may still come here."""
        ways = []
        if i == len(rows) and state in (0, 3):
            ways.append((0, "", ()))
        need = "a" if state == 2 else "u"
        name = {"a": "assistant", "u": "user"}[need]
        if spare:
            w = best(i, GOAL[need][state], spare - 1)
            ways.append((w[0] + 5, "I" + w[1], (f"{name}:", *w[2])))
        if i < len(rows):
            _, role, text = rows[i]
            w = best(i + 1, state, 3)
            ways.append((w[0] + 2, "D" + w[1], w[2]))
            if faults[i] not in ("blank", "duplicate"):
                more = 5 if faults[i] == "truncated" else 0
                if state in GOAL.get(role[:1], {}):
                    w = best(i + 1, GOAL[role[:1]][state], 3)
                    ways.append((w[0] + more, "K" + w[1], (f"{role}:{text}", *w[2])))
                w = best(i + 1, GOAL[need][state], 3)
                ways.append((w[0] + more + 1, "R" + w[1], (f"{name}:{text}", *w[2])))
        return min(ways, key=lambda w: w[:2], default=(1 << 40, "", ()))

    cost, audit, lines = best(0, 0, 3)
    turns = {t for t, _, _ in rows if t is not None}
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def by_conversation(rows):
    groups = {}
    for conv, *rest in rows:
        groups.setdefault(conv, []).append(tuple(rest))
    return groups


NOTHING = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def results(df):
    return {r[0]: tuple(r[1:]) for r in df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}


def test_query_equals_plain_recursion(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    hurt = by_conversation(plain_damage(rows))
    want = {conv: plain_repair(hurt[conv]) if conv in hurt else NOTHING for conv in by_conversation(rows)}
    assert results(q.op12_conversation_repair(spark, DATA)) == want


def odd_rows(seed, conversations=40):
    random.seed(seed)
    rows = []
    for conv in [None, *range(conversations)]:
        for _ in range(random.randint(1, 14)):
            role = random.choice(["user", "assistant", "system", "tool", "", None, "User", "user", "assistant"])
            rows.append((conv, random.choice([None, *range(12)]), role, random.choice(["Yes.", "no", "", " \n", None, "What?", "Go on!  ", "x.y", f"t{random.randint(0, 9)}."])))
    return rows + rows[:5]


@pytest.mark.parametrize("block", [1 << 16, 2])
def test_odd_rows_whole_and_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(c, "BLOCK", block)
    rows = odd_rows(block)
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumns({"key": F.lit("x"), "pos": F.lit(1), "content": F.lit("y"), "block": F.lit(3)})
    want = {conv: plain_repair([tuple(" " if v is None and i else v for i, v in enumerate(r)) for r in group]) for conv, group in by_conversation(rows).items()}
    assert results(c.repair_digests(df, c.repair(df))) == want


def test_a_conversation_with_a_third_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(c, "BLOCK", 64)
    rows = [(1, i, ("user", "assistant", "system")[i * i % 3], f"t{i % 90}{'.' if i % 7 else ''}") for i in range(900)] + [(i, i % 4, "user", "same.") for i in range(2, 1500)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    found = c.repair(df)
    want = {conv: plain_repair(group) for conv, group in by_conversation(rows).items() if conv > 1}
    got = results(c.repair_digests(df, found))
    assert {k: v for k, v in got.items() if k > 1} == want
    fixed = [r.role[0] for r in found.rows.filter("conv_id = 1").orderBy("place").collect()]
    assert re.fullmatch("(s?(ua)+)?", "".join(fixed)) and len(fixed) == sum(got[1][6].count(k) for k in "KRI")


def test_empty_tables_and_conversations_without_rows(spark):
    df = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    ids = spark.createDataFrame([(4,), (None,)], "conv_id long")
    assert results(c.repair_digests(df, c.repair(df))) == {}
    assert results(c.repair_digests(ids, c.repair(df))) == {4: NOTHING, None: NOTHING}
