"""Repair of conversations: the cheapest edits that make the roles alternate.

Rows of a conversation, in order, and the states of a small automaton (nothing yet,
after a system, a user, an assistant row) are the nodes of a graph whose arcs are
edits: Keep, Rerole and Delete lead past a row, Insert stays in front of it. Least
costs from the start and least costs to the end tell for each arc whether it is
tight, that is, on some cheapest way. The tight arcs form an acyclic graph; from the
set of states at the start, always the arcs of the least letter are followed.

A conversation is cut into blocks of BLOCK rows at most. The costs of a block are a
4 x 4 table (state to state, least cost), and tables multiply, so blocks are worked
on apart: first each block's table, then the costs at blocks' borders from the
tables in turn, then where the followed set of states goes in each block, then the
edits. No task needs a whole conversation, but for its chain of tables.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, prepare_workers, release

#: Rows (different ones) of a block; a power of two, as blocks are cut from row numbers.
BLOCK = 1 << 16
INFINITE = 1 << 60

#: Costs of edits; an undeleted truncated row costs TRUNCATED more.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5

#: States: 0 nothing yet, 1 after a system row, 2 after a user row, 3 after an assistant row. Where an initial leads from each, and which role each needs next.
STEPS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
NEEDED = ("user", "user", "assistant", "user")
AFTER = tuple(STEPS[role[0]][x] for x, role in enumerate(NEEDED))
STATES, ACCEPTED = range(4), (0, 3)

BLANK, DUPLICATE, CUT = 1, 2, 3


class Repair(NamedTuple):
    #: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit; a row for each conversation
    conversations: DataFrame
    #: conv_id, key (the id as text), place (block, row, number within), edit, role, text: the repaired rows
    rows: DataFrame


def arcs(initial: str, fault: int) -> list[tuple[str, int, int, int]]:
    """(letter, from, to, cost) of the edits that lead past a row."""
    out = [("D", x, x, DELETE) for x in STATES]
    if fault not in (BLANK, DUPLICATE):
        more = TRUNCATED if fault == CUT else 0
        out += [("K", x, y, more) for x, y in STEPS.get(initial, {}).items()]
        out += [("R", x, AFTER[x], REROLE + more) for x in STATES]
    return out


def inserted(costs: list[int]) -> list[int]:
    """Least costs at the same row after any inserts. Inserts lead from 0 or 1 to 2, and between 2 and 3."""
    a, b, c, d = costs
    c = min(c, a + INSERT, b + INSERT, d + INSERT)
    return [a, b, c, min(d, c + INSERT)]


def still_to_insert(costs: list[int]) -> list[int]:
    """Least costs from each state to the end, if inserts come first."""
    a, b, c, d = costs
    c = min(c, d + INSERT)
    d = min(d, c + INSERT)
    return [min(a, c + INSERT), min(b, c + INSERT), c, d]


def past(costs: list[int], initial: str, fault: int, copies: int) -> list[int]:
    """Least costs behind a row and its ``copies`` repeats, which must all be deleted."""
    out = [INFINITE] * 4
    for _, x, y, c in arcs(initial, fault):
        out[y] = min(out[y], costs[x] + c)
    return inserted([min(c + DELETE * copies, INFINITE) for c in out])


def before(costs: list[int], initial: str, fault: int, copies: int) -> list[int]:
    """Least costs to the end in front of a row, from those behind it."""
    out = [INFINITE] * 4
    for _, x, y, c in arcs(initial, fault):
        out[x] = min(out[x], costs[y] + c + DELETE * copies)
    return still_to_insert([min(c, INFINITE) for c in out])


def table_of(rows: list[tuple[str, int, int]]) -> list[int]:
    """Least costs from each state in front of a block to each state behind it, as 16 numbers; rows: (initial, fault, copies)."""
    out: list[int] = []
    for start in STATES:
        costs = inserted([0 if x == start else INFINITE for x in STATES])
        for row in rows:
            costs = past(costs, *row)
        out += [min(c, INFINITE) for c in costs]
    return out


def chained(tables: list[list[int]]) -> tuple[list[list[int]], list[list[int]], int]:
    """Costs from the start in front of each block, costs to the end behind each, and the least cost of all; tables: of a conversation's blocks in turn."""
    first = [[0, INFINITE, INFINITE, INFINITE]]
    for t in tables:
        first.append([min(INFINITE, *(first[-1][x] + t[4 * x + y] for x in STATES)) for y in STATES])
    last = [still_to_insert([0 if x in ACCEPTED else INFINITE for x in STATES])]
    for t in reversed(tables):
        last.append([min(INFINITE, *(t[4 * x + y] + last[-1][y] for y in STATES)) for x in STATES])
    return first[:-1], last[-2::-1], min(first[-1][x] for x in ACCEPTED)


class Block:
    """A block's rows with the costs from the start and to the end at each, so that tight arcs are known."""

    def __init__(self, rows: list[tuple[str, int, int]], costs_in: list[int], costs_out: list[int], best: int, is_last: bool):
        self.rows, self.best, self.is_last = rows, best, is_last
        self.forward, self.backward = [inserted(costs_in)], [costs_out]
        for row in rows:
            self.forward.append(past(self.forward[-1], *row))
        for row in reversed(rows):
            self.backward.append(before(self.backward[-1], *row))
        self.backward.reverse()

    def follow(self, states: frozenset[int]) -> tuple[frozenset[int], list[tuple[list[str], str, str | None]]]:
        """From a set of states in front of the block, along the tight arcs of the least letter: the states behind it, and for each row (roles inserted before it, its letter, its new role or None), with one more entry for inserts at the end of the conversation."""
        edits = []
        for i in range(len(self.rows) + 1):
            roles: list[str] = []
            ahead, here = self.forward[i], self.backward[i]
            while True:
                if i == len(self.rows) and (not self.is_last or any(x in ACCEPTED and ahead[x] == self.best for x in states)):
                    break
                tight = [("I", x, AFTER[x]) for x in states if ahead[x] + INSERT + here[AFTER[x]] == self.best]
                if i < len(self.rows):
                    initial, fault, copies = self.rows[i]
                    tight += [(k, x, y) for k, x, y, c in arcs(initial, fault) if x in states and ahead[x] + c + DELETE * copies + self.backward[i + 1][y] == self.best]
                letter = min(k for k, _, _ in tight)
                states, came = frozenset(y for k, _, y in tight if k == letter), states
                # the states of a set have the same letters behind them, which tell the row's or insert's role
                role = NEEDED[min(x for k, x, _ in tight if k == letter and x in came)]
                if letter != "I":
                    edits.append((roles, letter, role if letter == "R" else None))
                    break
                roles.append(role)
            if i == len(self.rows) and self.is_last:
                edits.append((roles, "", None))
        return states, edits


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role and text with planted damage, drawn by d = crc32("conv_id:turn") % 20: 0 drops the row, 1 empties its text, 2 removes the marks . ! ?, 3 repeats it, 4 sets its role to user. Nulls count as one space; ids and turns stay null."""
    d = F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" "))).cast("binary")) % 20
    text = F.when(d == 1, "").when(d == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    filled = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")).filter(d > 0)
    hit = filled.select("conv_id", "turn", F.when(d == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.when(d == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"))
    return hit.drop("_copy")


def _named(turns: DataFrame) -> DataFrame:
    """key, conv_id, turn, role, text, content: the key is the id as text, apart for null; content is a digest of role and text."""
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    key = F.when(F.col("conv_id").isNull(), "").otherwise(F.concat(F.lit(":"), F.col("conv_id").cast("string")))
    content = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    return turns.select(key.alias("key"), "conv_id", "turn", role.alias("role"), text.alias("text"), content.alias("content"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of sorted batches by their first two columns, a block of a conversation at a time."""
    rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
    for head, group in groupby(rows, key=lambda r: r[:2]):
        yield head, list(group)


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _yielded(schema: pa.Schema, rows: Iterator[tuple], size: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(schema, held)
            held = []
    if held:
        yield _batch(schema, held)


_TABLES = pa.schema([("key", pa.string()), ("block", pa.int64()), ("costs", pa.list_(pa.int64()))])
_BORDERS = pa.schema([("key", pa.string()), ("block", pa.int64()), ("costs_in", pa.list_(pa.int64())), ("costs_out", pa.list_(pa.int64())), ("best", pa.int64()), ("is_last", pa.bool_()), ("blocks", pa.int64())])
_WAYS = pa.schema([("key", pa.string()), ("block", pa.int64()), ("ways", pa.list_(pa.int64()))])
_STARTS = pa.schema([("key", pa.string()), ("block", pa.int64()), ("start", pa.int64())])
_EDITS = pa.schema([("key", pa.string()), ("block", pa.int64()), ("pos", pa.int64()), ("part", pa.int64()), ("letters", pa.string()), ("role", pa.string())])


def _set_of(bits: int) -> frozenset[int]:
    return frozenset(x for x in STATES if bits >> x & 1)


def _bits_of(states: frozenset[int]) -> int:
    return sum(1 << x for x in states)


def _tables(batches):
    return _yielded(_TABLES, ((*head, table_of([r[3:6] for r in rows])) for head, rows in _pieces(batches)))


def _borders(batches):
    def found():
        for b in batches:
            for key, chain in zip(b.column("key").to_pylist(), b.column("chain").to_pylist()):
                chain.sort(key=lambda c: c["block"])
                into, out, best = chained([c["costs"] for c in chain])
                for i, c in enumerate(chain):
                    yield key, c["block"], into[i], out[i], best, i + 1 == len(chain), len(chain)

    return _yielded(_BORDERS, found())


def _block_of(rows: list[tuple]) -> Block:
    """rows: key, block, pos, initial, fault, copies, costs_in, costs_out, best, is_last"""
    return Block([r[3:6] for r in rows], *rows[0][6:10])


def _ways(batches):
    """For a block that others follow: the set of states behind it for each set of states before it that cheapest ways can have, as bits."""

    def found():
        for head, rows in _pieces(batches):
            block = _block_of(rows)
            able = frozenset(x for x in STATES if block.forward[0][x] + block.backward[0][x] == block.best)
            yield *head, [_bits_of(block.follow(_set_of(b))[0]) if b and _set_of(b) <= able else 0 for b in range(16)]

    return _yielded(_WAYS, found())


def _starts(batches):
    def found():
        for b in batches:
            for key, chain in zip(b.column("key").to_pylist(), b.column("chain").to_pylist()):
                at = 1
                for c in sorted(chain, key=lambda c: c["block"]):
                    yield key, c["block"], at
                    at = c["ways"][at] if c["ways"] else 0

    return _yielded(_STARTS, found())


def _edits(batches):
    """Per row: what is inserted before it, and what stays of it. part numbers what one row yields; a row that is deleted has letters, but no role; a kept one has an empty role."""

    def found():
        for head, rows in _pieces(batches):
            _, edits = _block_of(rows).follow(_set_of(rows[0][10]))
            for i, (roles, letter, role) in enumerate(edits):
                pos = rows[i][2] if i < len(rows) else rows[-1][2] + 1
                for k, r in enumerate(roles):
                    yield *head, pos, k, "I", r
                if letter:
                    yield *head, pos, len(roles), letter + "D" * rows[i][5], {"K": "", "R": role}.get(letter)

    return _yielded(_EDITS, found())


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.string(): "string", pa.int64(): "long", pa.bool_(): "boolean", pa.list_(pa.int64()): "array<long>"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def repair(turns: DataFrame) -> Repair:
    """Faults, cheapest edits and repaired rows of conversations; turns: conv_id, turn, role, text.

    Rows of a conversation stand by turn, nulls first; rows of one turn by role, then
    by a digest of their text, so that equal rows are neighbours. A null role or text
    counts as one space; a null id is a conversation of its own. A row's fault is
    the first that holds: blank (no character but ASCII white space), duplicate
    (role and text seen earlier in the conversation), truncated (the last such
    character is none of . ! ?). Keep costs 0, Rerole (to user or assistant) 1,
    Delete 2, an Insert of an empty user or assistant row 5; blank and duplicate rows
    must be deleted, and an undeleted truncated row costs 5 more. What is left has the
    role initials s?(ua)+, or none. The audit is the edits' initials in order, of
    equal costs the least in ASCII order. gaps is how many turns between the least
    and the greatest are missing; illegal counts neighbours whose initials are not
    su, ua or au. Conversations without rows give none, empty tables nothing; other
    columns are not looked at. Equal rows are counted before they are shuffled, very
    long texts are shuffled once, and a conversation of any length is worked on in
    blocks; only its audit is one value.
    """
    prepare_workers(turns.sparkSession)
    named = _named(turns)
    # equal rows of a turn as one, with their number
    solid = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    looks = F.when(solid == "", BLANK).when(F.substring(solid, -1, 1).isin(".", "!", "?"), 0).otherwise(CUT)
    coded = named.select("key", "conv_id", "turn", "role", "content", F.substring("role", 1, 1).alias("initial"), looks.alias("looks"))
    counted = coded.groupBy("key", "turn", "role", "content").agg(F.first("conv_id").alias("conv_id"), F.first("initial").alias("initial"), F.first("looks").alias("looks"), F.count("*").alias("n"))
    order = ["key", F.col("turn").asc_nulls_first(), "role", "content"]
    # a row's number tells its block, as the rows of a task are numbered in turn
    numbered = counted.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id())
    codes = durable(numbered.withColumn("block", F.expr(f"pos div {BLOCK}")), "turns")
    firsts = codes.groupBy("key", "role", "content").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("is_first"))
    known = codes.join(firsts, "pos", "left")
    is_copy = F.col("is_first").isNull()
    fault = F.when(F.col("looks") == BLANK, BLANK).when(is_copy, DUPLICATE).otherwise(F.col("looks"))
    facts = durable(known.withColumns({"fault": fault.cast("long"), "copies": F.col("n") - 1}).drop("is_first", "looks"), "facts")
    release(codes)

    counts = facts.groupBy("key").agg(
        F.first("conv_id").alias("conv_id"), F.sum(F.when(F.col("fault") == BLANK, F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("fault") == DUPLICATE, F.col("n")).when(F.col("fault") != BLANK, F.col("copies")).otherwise(0)).alias("duplicate"), F.sum((F.col("fault") == CUT).cast("long")).alias("truncated"),
    )
    of_turns = facts.filter("turn is not null").select("key", "turn").distinct().groupBy("key").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    # neighbours within a block by a window, across blocks by the blocks' ends; equal rows are neighbours too
    legal = F.concat("was", "initial").isin("su", "ua", "au")
    near = facts.withColumn("was", F.lag("initial").over(Window.partitionBy("key", "block").orderBy("pos")))
    inside = near.groupBy("key", "block").agg(
        F.sum(F.col("copies") + (F.col("was").isNotNull() & ~legal).cast("long")).alias("illegal"), F.min(F.struct("pos", "initial"))["initial"].alias("initial"), F.max(F.struct("pos", "initial"))["initial"].alias("ending"),
    )
    across = inside.withColumn("was", F.lag("ending").over(Window.partitionBy("key").orderBy("block")))
    illegal = across.groupBy("key").agg(F.sum(F.col("illegal") + (F.col("was").isNotNull() & ~legal).cast("long")).alias("illegal"))

    blocks = facts.select("key", "block", "pos", "initial", "fault", "copies").repartition("key", "block").sortWithinPartitions("key", "block", "pos")
    tables = blocks.mapInArrow(_tables, _ddl(_TABLES))
    chains = tables.groupBy("key").agg(F.collect_list(F.struct("block", "costs")).alias("chain"))
    borders = durable(chains.mapInArrow(_borders, _ddl(_BORDERS)), "borders")
    asked = facts.select("key", "block", "pos", "initial", "fault", "copies").join(borders, ["key", "block"])
    columns = ["key", "block", "pos", "initial", "fault", "copies", "costs_in", "costs_out", "best", "is_last"]
    # where blocks follow one another, the set of states in front of each
    followed = asked.filter("not is_last").select(*columns).repartition("key", "block").sortWithinPartitions("key", "block", "pos").mapInArrow(_ways, _ddl(_WAYS))
    several = borders.filter("blocks > 1").select("key", "block").join(followed, ["key", "block"], "left")
    starts = several.groupBy("key").agg(F.collect_list(F.struct("block", "ways")).alias("chain")).mapInArrow(_starts, _ddl(_STARTS))
    begun = asked.join(starts, ["key", "block"], "left").select(*columns, F.coalesce("start", F.lit(1)).cast("long").alias("start"))
    edits = durable(begun.repartition("key", "block").sortWithinPartitions("key", "block", "pos").mapInArrow(_edits, _ddl(_EDITS)), "edits")

    letters = edits.groupBy("key", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "part", "letters"))), lambda e: e["letters"]), "").alias("letters"))
    audits = letters.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "letters"))), lambda e: e["letters"]), "").alias("audit"))
    best = borders.select("key", F.col("best").alias("cost")).distinct()
    conversations = counts.join(of_turns, "key", "left").join(illegal, "key").join(best, "key").join(audits, "key").select(
        "conv_id", F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit",
    )

    # the edits know their rows' digests; each text that stays is the first of its kind in its conversation
    stays = edits.filter("role is not null").join(facts.select("pos", "turn", "content", F.col("role").alias("was")), "pos", "left")
    stays = stays.join(counts.select("key", "conv_id"), "key").withColumn("own", F.substring("letters", 1, 1) != "I")
    texts = named.groupBy("key", "turn", "role", "content").agg(F.first("text").alias("text")).select(F.col("key").alias("k"), F.col("turn").alias("t"), F.col("role").alias("r"), F.col("content").alias("c"), "text")
    joined = stays.join(texts, F.col("own") & (F.col("key") == F.col("k")) & F.col("turn").eqNullSafe(F.col("t")) & (F.col("was") == F.col("r")) & (F.col("content") == F.col("c")), "left")
    rows = joined.select(
        "conv_id", "key", F.struct("block", "pos", "part").alias("place"), F.substring("letters", 1, 1).alias("edit"), F.when(F.col("role") == "", F.col("was")).otherwise(F.col("role")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    return Repair(conversations, rows)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sha256 of each key's lines, one line in memory at a time. In: (key, line), sorted."""
    schema = pa.schema([("key", pa.string()), ("repaired_sha256", pa.string())])

    def found():
        rows = (row for b in batches for row in zip(b.column("key").to_pylist(), b.column("line").to_pylist()))
        for key, lines in groupby(rows, key=lambda r: r[0]):
            digest, sep = hashlib.sha256(), b""
            for _, line in lines:
                digest.update(sep + line.encode())
                sep = b"\n"
            yield key, digest.hexdigest()

    return _yielded(schema, found())


def repair_digests(ids: DataFrame, repaired: Repair) -> DataFrame:
    """A row for each of ``ids`` (conv_id): its numbers and audit, and the sha256 of its repaired lines role:text. Ids without rows have zeros, an empty audit and the digest of an empty text. A digest of one text is made in turn, so a conversation's lines pass through one task, but are not kept there."""
    key = F.when(F.col("conv_id").isNull(), "").otherwise(F.concat(F.lit(":"), F.col("conv_id").cast("string")))
    lines = repaired.rows.select("key", "place", F.concat("role", F.lit(":"), "text").alias("line"))
    digests = lines.repartition("key").sortWithinPartitions("key", "place").select("key", "line").mapInArrow(_digested, "key string, repaired_sha256 string")
    every = ids.select("conv_id").distinct().withColumn("key", key)
    whole = every.join(repaired.conversations.withColumn("key", key).drop("conv_id"), "key", "left").join(digests, "key", "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return whole.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
