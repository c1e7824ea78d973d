"""Exact top-k search by inner product over a bit-sliced index.

Vectors become integers. A block of rows is stored as bit slices: for each
dimension, one bitmap over the rows for each bit of (value - block minimum).
A query adds its multiples of these slices with carry-save bitmap arithmetic,
which leaves the slices of every row's score; the top rows are picked from the
most significant slice downward, and rows tied at the boundary by their id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, prepare_workers

#: Rows of an index block, and queries that are compared with it at a time.
BLOCK_ROWS, CHUNK_QUERIES = 8192, 1024


def quantised(vectors: DataFrame, id_col: str = "vec_id", embedding: str = "embedding", scale: float = 64.0) -> DataFrame:
    """row, vec_id and q, the components as floor(scale * x). Vectors and ids that are null, and vectors with null or non-finite components, take no part; rows that repeat an id all do."""
    x = F.col(embedding).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    good = vectors.filter(F.col(id_col).isNotNull() & F.col(embedding).isNotNull() & finite)
    return good.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * F.lit(scale))).alias("q"))


def _matrix(lists: pa.ChunkedArray) -> np.ndarray:
    """Rows of integers, the shorter ones filled up with zeros."""
    rows = lists.to_pylist()
    out = np.zeros((len(rows), max(map(len, rows), default=0)), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _small(m: np.ndarray) -> np.dtype:
    return next(np.dtype(t) for t in ("<i2", "<i4", "<i8") if not m.size or (m.min() >= np.iinfo(t).min and m.max() <= np.iinfo(t).max))


BLOCK = "block int, n int, width int, kind string, ids binary, rownums binary, rows binary, least binary, bits binary, slices binary"


def _block(table: pa.Table) -> pa.Table:
    table = table.sort_by([("vec_id", "ascending"), ("row", "ascending")])
    ids, rownums, m = table.column("vec_id").to_numpy(), table.column("row").to_numpy(), _matrix(table.column("q"))
    least = m.min(axis=0)
    above = (m - least).astype(np.uint64)
    bits = np.array([int(x).bit_length() for x in above.max(axis=0)], np.int64)
    words = -(-len(ids) // 64)
    slices = np.zeros((int(bits.sum()), words * 8), np.uint8)
    k = 0
    for d, n in enumerate(bits):
        for j in range(n):
            packed = np.packbits(((above[:, d] >> np.uint64(j)) & np.uint64(1)).astype(bool), bitorder="little")
            slices[k, : len(packed)] = packed
            k += 1
    kind = _small(m)
    one = {"block": table.column("block")[0].as_py(), "n": len(ids), "width": m.shape[1], "kind": kind.str, "ids": ids.astype("<i8").tobytes(), "rownums": rownums.astype("<i8").tobytes(), "rows": m.astype(kind).tobytes(), "least": least.astype("<i8").tobytes(), "bits": bits.astype("<i8").tobytes(), "slices": slices.tobytes()}
    return pa.table({k: pa.array([v], pa.int32() if isinstance(v, int) else None) for k, v in one.items()})


def build_index(vectors: DataFrame, blocks: int) -> DataFrame:
    """The index, one row a block: ids, integers and bit slices."""
    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    return durable(dealt.groupBy("block").applyInArrow(_block, BLOCK), "slices")


class Block:
    def __init__(self, n: int, width: int, kind: str, ids: bytes, rownums: bytes, rows: bytes, least: bytes, bits: bytes, slices: bytes):
        self.n, self.width, words = n, width, -(-n // 64)
        self.ids, self.rownums = np.frombuffer(ids, "<i8"), np.frombuffer(rownums, "<i8")
        self.rows = np.frombuffer(rows, kind).reshape(n, width).astype(np.int64)
        self.bits = np.frombuffer(bits, "<i8")
        s = np.frombuffer(slices, "<u8").reshape(-1, words)
        self.slices = np.concatenate([s, ~s])  # the second half: complements
        self.first = np.concatenate([[0], np.cumsum(self.bits)])
        everyone = np.zeros(words * 8, np.uint8)
        packed = np.packbits(np.ones(n, bool), bitorder="little")
        everyone[: len(packed)] = packed
        self.everyone = everyone.view("<u8")

    def scores(self, q: np.ndarray) -> list[np.ndarray]:
        """Slices, lowest first, of each row's score less a constant. A negative factor takes complements: -f v = f (top - v) - f top."""
        total, by_weight = len(self.slices) // 2, {}
        for d in np.flatnonzero(q[: self.width]).tolist():
            f = int(q[d])
            base = int(self.first[d]) + (total if f < 0 else 0)
            f, n, b = abs(f), int(self.bits[d]), 0
            while f:
                if f & 1:
                    for j in range(n):
                        by_weight.setdefault(b + j, []).append(base + j)
                f >>= 1
                b += 1
        out, carried, w = [], [], 0
        while w <= max(by_weight, default=-1) or carried:
            parts = carried + ([self.slices[by_weight[w]]] if w in by_weight else [])
            carried = []
            x = np.concatenate(parts) if len(parts) > 1 else parts[0] if parts else np.zeros((1, len(self.everyone)), np.uint64)
            while len(x) > 2:  # three slices of one weight make one of it and one of the next
                k = len(x) // 3
                a, b, c = x[:k], x[k : 2 * k], x[2 * k : 3 * k]
                u = a ^ b
                carried.append((a & b) | (u & c))
                x = np.concatenate([u ^ c, x[3 * k :]])
            if len(x) == 2:
                carried.append(x[:1] & x[1:])
                x = x[:1] ^ x[1:]
            out.append(x[0])
            w += 1
        return out

    def top(self, own: int, row: int, q: np.ndarray, k: int) -> np.ndarray:
        """Positions of the k best rows (fewer if there are fewer) without the row of number ``row``, whose id is ``own``."""
        left = self.everyone.copy()
        lo, hi = np.searchsorted(self.ids, [own, own + 1]) if own < np.iinfo(np.int64).max else (np.searchsorted(self.ids, own), self.n)
        for at in (int(lo) + np.flatnonzero(self.rownums[lo:hi] == row)).tolist():
            left[at // 64] &= ~(np.uint64(1) << np.uint64(at % 64))
        sure, have = np.zeros_like(left), 0
        for s in reversed(self.scores(q)):
            up = left & s
            n = have + int(np.bitwise_count(up).sum())
            if n > k:
                left = up
                continue
            sure |= up
            have = n
            left = left & ~s
            if n == k:
                break
        spots = lambda x: np.flatnonzero(np.unpackbits(x.view(np.uint8), bitorder="little"))
        best = spots(sure)
        # rows of the boundary have one score; ids ascend with positions
        return best if have >= k else np.concatenate([best, spots(left)[: k - have]])


def top_k(vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", embedding: str = "embedding", scale: float = 64.0, block_rows: int = BLOCK_ROWS, chunk_queries: int = CHUNK_QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k best other rows for each row that ``queries`` (a condition on vec_id) picks.

    Ties go to the smaller id; fewer than k others: all of them. Shorter vectors
    count as filled up with zeros. Rows that repeat an id are candidates, and
    queries, each by itself. Null ids and vectors, and vectors with a null or
    non-finite component, take no part. Scores are 64-bit: integers so large that
    a product of two vectors may not fit raise ValueError. No vectors or no
    queries: no rows. Other columns are not looked at. Blocks of queries meet
    blocks of rows, each of bounded size, and each pair of blocks is a task's
    unit; it hands on k rows a query.
    """
    spark = vectors.sparkSession
    prepare_workers(spark)
    all_ = durable(quantised(vectors, id_col, embedding, scale), "quantised")
    size = F.aggregate("q", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x.cast("double"))))
    n, m, largest, width = all_.agg(F.count("*"), F.count(F.when(queries, 1)), F.max(size), F.max(F.size("q"))).first()
    if n and largest * largest * width >= 2.0**62:
        raise ValueError(f"components up to {largest:g} in {width} dimensions: inner products may not fit 64 bits")
    blocks, chunks = max(1, -(-n // block_rows)), max(1, -(-m // chunk_queries))
    index = build_index(all_, blocks)
    # queries are a share of the rows at most, and stand in chunks of bounded size
    chunked = durable(all_.filter(queries).withColumn("chunk", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(chunks)).cast("int")).groupBy("chunk").agg(F.collect_list(F.struct("vec_id", "row", "q")).alias("asked")), "queries")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    names = [c.split(" ")[0] for c in BLOCK.split(", ")][1:]
    tasks = min(blocks * chunks, 100_000)
    pairs = index.withColumn("chunk", every(chunks)).repartition(tasks, "block", "chunk").join(chunked.withColumn("block", every(blocks)).repartition(tasks, "block", "chunk"), ["block", "chunk"])

    def work(pair: pa.Table) -> pa.Table:
        row = pair.slice(0, 1)
        block = Block(*(row.column(c)[0].as_py() for c in names))
        out: tuple[list, list, list, list] = ([], [], [], [])
        for a in row.column("asked")[0].as_py():
            q = np.zeros(max(block.width, len(a["q"])), np.int64)
            q[: len(a["q"])] = a["q"]
            at = block.top(a["vec_id"], a["row"], q, k)
            out[0].append(np.full(len(at), a["vec_id"]))
            out[1].append(np.full(len(at), a["row"]))
            out[2].append(block.ids[at])
            out[3].append(block.rows[at] @ q[: block.width])
        return pa.table([pa.array(np.concatenate(x).astype(np.int64)) for x in out], ["query_id", "query_row", "vec_id", "score"])

    # a group is one row, a pair of blocks, so a worker holds one pair at a time
    found = pairs.select("block", "chunk", *names, "asked").groupBy("block", "chunk").applyInArrow(work, "query_id long, query_row long, vec_id long, score long")
    best = F.row_number().over(Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", best).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
