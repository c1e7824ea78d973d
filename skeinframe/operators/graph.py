"""Components, shortest paths and hierarchies on DataFrames (survey G-01 to G-06, J-22)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import durable, prepare_workers, release

#: Parts into which the edges of a node are dealt; edges that a task looks at together before the shuffle.
SALTS, CHUNK_EDGES = 32, 1_000_000


def _with_least(edges: DataFrame) -> DataFrame:
    """Adds to each edge (u, v) the least v of its u, as m. A node with a third of all edges is dealt over SALTS tasks."""
    salted = edges.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    part = salted.groupBy("u", "s").agg(F.min("v").alias("m"))
    return salted.join(part.withColumn("m", F.min("m").over(Window.partitionBy("u"))), ["u", "s"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (u, v) with u > v, distinct. Large: each node hands its larger neighbours its least one; small: the same for the smaller ones."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        sent = _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
    else:
        sent = _with_least(edges).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
    return sent.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _checksum(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def least_of_each(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the least one that it reaches by the edges (u, v)."""
    least = np.arange(n)
    while True:
        a, b = least[u], least[v]
        open_ = a != b
        if not open_.any():
            return least
        u, v, a, b = u[open_], v[open_], a[open_], b[open_]
        np.minimum.at(least, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(least, least[least]):
            least = least[least]


def _starred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a task's chunks as stars: of those of a chunk that reach each other, each node with the least one. There are fewer of them than nodes."""

    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        ends = pa.Table.from_batches(held)
        nodes = pa.concat_arrays([c for name in ("u", "v") for c in ends.column(name).chunks]).dictionary_encode()
        order = pa.compute.array_sort_indices(nodes.dictionary).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        at = place[nodes.indices.to_numpy()]
        least = least_of_each(at[: len(ends)], at[len(ends) :], len(order))
        moved = np.flatnonzero(least != np.arange(len(order)))
        return pa.RecordBatch.from_arrays([nodes.dictionary.take(pa.array(order[x])) for x in (moved, least[moved])], ["u", "v"])

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= CHUNK_EDGES:
            yield stars(held)
            held, n = [], 0
    if n:
        yield stars(held)


def components(edges: DataFrame, in_tasks: bool = True) -> DataFrame:
    """(node, component) for each node of an edge: the least node that it reaches.

    Alternating large-star and small-star steps until nothing changes, which is
    after a number of rounds that grows with the logarithm of the nodes. edges:
    two columns u and v of one orderable type, in any direction; null ends and
    self-loops are dropped, repeated edges count once. No edges: no rows. Each
    round is a table in the shared folder, and takes the place of the last one.
    Numbers and texts are first brought to stars in each task, by chunks of bounded
    size, so that what is shuffled grows with the nodes that tasks see, not with the edges;
    without ``in_tasks`` the edges are shuffled as they are, by expressions only.
    """
    now = edges.filter("u is not null and v is not null and u <> v").select("u", "v")
    kinds = {f.dataType.simpleString() for f in now.schema}
    if in_tasks and len(kinds) == 1 and kinds <= {"int", "bigint", "string"}:
        prepare_workers(edges.sparkSession)
        now = now.mapInArrow(_starred, now.schema)
    now = durable(now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = _checksum(now)
    while seen[0]:
        new = durable(_star(_star(now, True), False), "stars")
        release(now)
        now = new
        if (mark := _checksum(now)) == seen:
            break
        seen = mark
    found = now.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("component")), F.struct(F.col("v").alias("node"), F.col("v").alias("component")))).alias("n")).select("n.*").distinct()
    found._skeinframe_folder = now._skeinframe_folder
    return found


def first_come(edges: DataFrame) -> DataFrame:
    """(node) of what a walk in order leaves out, if it takes each node that no node taken before conflicts with. edges: (u, v), v comes before u and conflicts with it.

    By rounds: a node without an open edge to an earlier one is taken, its later
    neighbours are left out, and their edges go with them. There are as many rounds
    as the longest chain of conflicts needs; each is a table in the shared folder.
    Repeated edges count once, null ends never; no edges: no rows.
    """
    open_ = durable(edges.filter("u is not null and v is not null and u <> v").select("u", "v").distinct(), "conflicts")
    lost = None
    while open_.limit(1).count():
        waiting = open_.select(F.col("u").alias("v")).distinct()
        hit = open_.join(waiting, "v", "left_anti").select(F.col("u").alias("node")).distinct()
        new = durable(hit if lost is None else lost.unionByName(hit), "left-out")
        gone = new.select(F.col("node").alias("u"))
        left = open_.join(gone, "u", "left_anti").join(gone.withColumnRenamed("u", "v"), "v", "left_anti")
        left = durable(left, "conflicts")
        release(open_, *([lost] if lost is not None else []))
        open_, lost = left, new
    release(open_)
    return lost if lost is not None else edges.select(F.col("u").alias("node")).limit(0)


def undirected(edges: DataFrame, default: float = 120.0) -> DataFrame:
    """(src, dst, w) both ways; self-loops dropped, unknown weights as ``default``, parallel edges kept."""
    e = edges.filter("src <> dst").withColumn("w", F.coalesce(F.col("w").cast("double"), F.lit(default)))
    return e.select("src", "dst", "w").unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))


def shortest_paths(edges: DataFrame, start) -> DataFrame:
    """(node, total, path) from ``start`` to all it reaches, by relaxation of a frontier until nothing gets better; of equal totals the least path. Weights are not negative."""
    e = durable(edges.groupBy("src", "dst").agg(F.min("w").alias("w")), "links")
    kind = e.schema["src"].dataType
    spark = edges.sparkSession
    best = spark.range(1).select(F.lit(start).cast(kind).alias("node"), F.lit(0.0).alias("total"), F.array(F.lit(start).cast(kind)).alias("path"))
    frontier, last = best, None
    while True:
        tried = frontier.join(e, F.col("node") == F.col("src")).filter(~F.array_contains("path", F.col("dst"))).select(F.col("dst").alias("node"), (F.col("total") + F.col("w")).alias("total"), F.concat("path", F.array("dst")).alias("path"))
        tried = tried.groupBy("node").agg(F.min(F.struct("total", "path")).alias("n"))
        old = F.when(F.col("total").isNotNull(), F.struct("total", "path"))
        merged = durable(best.join(tried, "node", "full_outer").select("node", F.least(old, F.col("n")).alias("b"), (F.col("n").isNotNull() & F.coalesce(F.col("n") < old, F.lit(True))).alias("better")), "paths")
        if last is not None:
            release(last)
        last = merged
        best = merged.select("node", "b.total", "b.path")
        frontier = merged.filter("better").select("node", "b.total", "b.path")
        if not frontier.limit(1).count():
            release(e)
            return best


def climb(links: DataFrame, starts: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, root, depth): the nearest root above each start; of roots as near, the least. links: (child, parent). A start that comes back to what it has seen ends there, so cycles do no harm, at any depth."""
    at = starts.select(F.col("node"), F.col("node").alias("here")).distinct()
    seen, found, depth = at, None, 0
    r = roots.select(F.col("node").alias("here")).distinct()
    while True:
        hit = at.join(r, "here").groupBy("node").agg(F.min("here").alias("root")).withColumn("depth", F.lit(depth))
        found = durable(hit if found is None else found.unionByName(hit), "found")
        at = at.join(found.select("node"), "node", "left_anti").join(links.select(F.col("child").alias("here"), "parent"), "here").select("node", F.col("parent").alias("here")).distinct()
        at = durable(at.join(seen, ["node", "here"], "left_anti"), "climbing")
        if not at.limit(1).count():
            return found
        seen, depth = durable(seen.unionByName(at), "seen"), depth + 1
