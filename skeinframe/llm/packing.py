"""Best-fit packing of documents into token sequences by linear grouping.

Only how many pieces have each length decides the packing, so the plan is made
on the driver from at most ``capacity`` counts, at any input size: large lengths
are rounded up within groups of equal cardinality, configurations of the few
group sizes are optimised by column generation, actual lengths take the slots,
and small ones go best-fit into what is left. The plan is a list of runs; each
piece finds its place by its length and its rank among the pieces of that length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, prepare_workers, sliced, text_or_empty, tokenizer_path, trimmed
from .encoding import encoder

CAPACITY, GROUPS = 2048, 40
#: Shares of the capacity up to which a length is small; of their plans, the one with the fewest sequences is taken.
SMALL = (1 / 8, 1 / 4, 1 / 3, 1 / 2)


def _configurations(sizes: list[int], demand: list[float], capacity: int, most_rounds: int = 2000) -> list[tuple[list[int], float]]:
    """The cutting-stock linear programme by column generation: (slots by size, sequences) of an optimal basis."""
    k = len(sizes)
    basis = np.diag([float(capacity // s) for s in sizes])
    d = np.array(demand, float)
    for _ in range(most_rounds):
        x, dual = np.linalg.solve(basis, d), np.linalg.solve(basis.T, np.ones(k))
        best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for i in np.flatnonzero(dual > 1e-12).tolist():  # knapsack: the most valuable configuration; each pass allows one more piece of a size
            s = sizes[i]
            for _copy in range(capacity // s):
                worth = best[:-s] + dual[i]
                better = worth > best[s:] + 1e-12
                if not better.any():
                    break
                best[s:][better] = worth[better]
                pick[s:][better] = i
        if best[capacity] <= 1 + 1e-7:
            break
        column, c = np.zeros(k), capacity
        while pick[c] >= 0:
            column[pick[c]] += 1
            c -= sizes[pick[c]]
        step = np.linalg.solve(basis, column)
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(np.argmin(ratio))] = column
    x = np.linalg.solve(basis, d)
    return [([int(v) for v in basis[:, j]], max(0.0, x[j])) for j in range(k)]


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, smalls: tuple[float, ...] = SMALL) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, pieces, first sequence, pieces a sequence, first offset) that place every piece.

    Deterministic in ``counts`` (length -> pieces). The work is bounded by the
    capacity, not by the number of pieces.
    """
    plans = [_plan(counts, capacity, groups, small) for small in smalls]
    return min(plans, key=lambda runs: max((first - (-n // per) for _, _, n, first, per, _ in runs), default=0))


def _plan(counts: dict[int, int], capacity: int, groups: int, small: float) -> list[tuple[int, int, int, int, int, int]]:
    runs: list[tuple[int, int, int, int, int, int]] = []
    taken = dict.fromkeys(counts, 0)
    room: dict[int, list[tuple[int, int]]] = {}  # what is left -> ranges of sequences
    total = 0

    def put(length: int, n: int, first: int, per: int, offset: int) -> None:
        runs.append((length, taken[length], n, first, per, offset))
        taken[length] += n

    def opened(n: int) -> int:
        nonlocal total
        total += n
        return total - n

    if counts.get(capacity):
        put(capacity, counts[capacity], opened(counts[capacity]), 1, 0)
    large = [(s, n) for s, n in sorted(counts.items(), reverse=True) if capacity * small < s < capacity and n]
    if large:
        # groups of equal cardinality, each rounded up to its largest length
        each = max(1, -(-sum(n for _, n in large) // groups))
        members: list[list[list[int]]] = []
        left = 0
        for s, n in large:
            while n:
                if left == 0:
                    members.append([])
                    left = each
                m = min(n, left)
                members[-1].append([s, m])
                n -= m
                left -= m
        merged: dict[int, list[list[int]]] = {}
        for g in members:
            merged.setdefault(g[0][0], []).extend(g)
        sizes = list(merged)
        queue = [merged[s] for s in sizes]
        for slots, x in _configurations(sizes, [sum(m for _, m in q) for q in queue], capacity):
            n = int(x + 1e-9)
            if n < 1:
                continue
            first = opened(n)
            parts = [(first, n, 0)]  # (sequence, sequences, used)
            for i, times in enumerate(slots):
                for _ in range(times):
                    after = []
                    for at, m, used in parts:
                        while m and queue[i]:
                            s, have = queue[i][0]
                            k = min(m, have)
                            put(s, k, at, 1, used)
                            after.append((at, k, used + s))
                            at, m = at + k, m - k
                            if k == have:
                                queue[i].pop(0)
                            else:
                                queue[i][0][1] -= k
                        if m:
                            after.append((at, m, used))
                    parts = after
            for at, m, used in parts:
                room.setdefault(capacity - used, []).append((at, m))

    for s in sorted((s for s in counts if s < capacity), reverse=True):
        n = counts[s] - taken[s]
        while n:
            fits = [r for r in room if r >= s]
            if not fits:
                per = capacity // s
                m = -(-n // per)
                room.setdefault(capacity, []).append((opened(m), m))
                continue
            r = min(fits)
            at, m = room[r].pop()
            if not room[r]:
                del room[r]
            per = r // s
            full = min(m, n // per)
            if full:
                put(s, full * per, at, per, capacity - r)
                n -= full * per
                room.setdefault(r - per * s, []).append((at, full))
                at, m = at + full, m - full
            elif n:
                put(s, n, at, n, capacity - r)
                room.setdefault(r - n * s, []).append((at, 1))
                at, m, n = at + 1, m - 1, 0
            if m:
                room.setdefault(r, []).append((at, m))
        room.pop(0, None)
    return runs


def encoded_pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int | None = 0, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's ids, ended by ``end_id``, as pieces of at most ``capacity``: doc_id, piece, start, length, ids, and part and rank, the piece's number among those of its length in its part. Only the first piece of a long document may be shorter than ``capacity``."""
    path = vocabulary or tokenizer_path("byte_bpe_50k.json")
    prepare_workers(docs.sparkSession)
    picked = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text).alias("text"))
    kind = picked.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids binary, part int, rank long"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, part, seen = encoder(path), TaskContext.get().partitionId(), {}
        end = np.array([] if end_id is None else [end_id], "<u4").tobytes()
        for batch in sliced(batches):
            rows = []
            for doc, blob in zip(batch.column(0).to_pylist(), codec.encode_many(batch.column(1).to_pylist())):
                blob += end
                n = len(blob) // 4
                first = n - max(0, -(-n // capacity) - 1) * capacity
                for k, (s, e) in enumerate(zip([0, *range(first, n, capacity)], [*range(first, n, capacity), n])):
                    if e > s:
                        rank = seen.get(e - s, 0)
                        seen[e - s] = rank + 1
                        rows.append((doc, k, s, e - s, blob[4 * s : 4 * e], part, rank))
            types = (batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], [c.split(" ")[0] for c in schema.split(", ")])

    return durable(picked.mapInArrow(trimmed(work), schema), "pieces")


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, derive: dict[str, Column] | None = None) -> DataFrame:
    """Adds sequence_id and offset to ``encoded_pieces``; with ``derive``, these columns stand in for ids."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    runs = sorted(plan(counts, capacity))
    keys = np.array([r[0] * (1 << 44) + r[1] for r in runs], np.int64)
    first, per, offset, length, begin = (np.array([r[i] for r in runs], np.int64) for i in (3, 4, 5, 0, 1))
    sizes = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.withColumn("begin", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    kept = pieces.withColumns(derive or {})
    if derive:
        kept = kept.drop("ids")
    ranked = kept.join(begins, ["part", "length"]).withColumn("rank", F.col("begin") + F.col("rank")).drop("begin", "part")
    names = [c for c in ranked.columns if c != "rank"]
    types = dict(ranked.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in names) + ", sequence_id long, offset long"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(keys, n * (1 << 44) + rank, "right") - 1
            k = rank - begin[at]
            arrays = [batch.column(c) for c in names] + [pa.array(first[at] + k // per[at]), pa.array(offset[at] + k % per[at] * length[at])]
            yield pa.RecordBatch.from_arrays(arrays, [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(trimmed(work), schema)


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int | None = 0, derive: dict[str, Column] | None = None, **columns) -> DataFrame:
    """doc_id, piece, start, length, ids (or ``derive``), sequence_id and offset for each piece of each document.

    Null text: as empty, so only the end id. Repeated rows are packed as often
    as they occur. No rows: none. Sequence ids are 0 to n - 1, offsets gapless.
    """
    return pack_pieces(encoded_pieces(docs, vocabulary, capacity, end_id, **columns), capacity, derive)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its ids (binary), the pieces joined by their offset; a sequence has at most ``capacity`` pieces."""
    return packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p")).select("sequence_id", F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
