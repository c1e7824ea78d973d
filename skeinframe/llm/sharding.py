"""Sharding by a K-d tree over document metadata, split at distributed weighted medians.

Atoms are groups of equal texts with their bytes as weight, at a place on a grid of
metadata dimensions. Every node above the target bytes is cut at the weighted
median of its widest dimension: level by level with histograms in the cluster
while a node has many atoms, and to the end in one task once it has few. All atoms
go down the tree. Shards are runs of its leaves in tree order, so that neighbours
stay together; only where a heavy text leaves runs uneven, leaves are exchanged.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, release, text_or_empty

#: Cells of a dimension, as 2 ** (2 * HALF): a median takes two histograms of 2 ** HALF bins.
HALF = 11
#: Leaves for each shard, at least; atoms of a node that a task cuts to the end.
LEAVES, TASK_ATOMS = 256, 2_000
#: Dimensions: size on a log scale, two labels, smallest id; the last one breaks ties where these are all alike.
DIMS = ("d0", "d1", "d2", "d3", "tie")
KEY = ("text_hash", "text_crc32", "size")


def documents_meta(docs: DataFrame, id_col: str = "doc_id", text: str = "text", labels: Sequence[str] = ("lang", "source")) -> DataFrame:
    """doc_id, size (UTF-8 bytes and 1), crc, row and hash of the text, and two labels; a label that ``docs`` has no column for is empty."""
    whole = text_or_empty(text)
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")) if c in docs.columns else F.lit("") for c in labels]
    meta = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(whole) + 1).cast("long").alias("size"), F.crc32(whole.cast("binary")).alias("text_crc32"), F.xxhash64(whole, F.lit("t")).alias("text_hash"), *[x.alias(f"label{i}") for i, x in enumerate(named)])
    return meta.withColumn("row", F.monotonically_increasing_id())


def _cell(*columns) -> Column:
    """A hash as a cell."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 64 - 2 * HALF)


def _unit(*columns) -> Column:
    """A hash in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 12).cast("double") / F.lit(float(1 << 52))


def atoms_of(meta: DataFrame) -> DataFrame:
    """One row for each distinct text: its key, weight, place on the grid, and the root as its node."""
    a = meta.groupBy(*KEY).agg(F.count("*").alias("copies"), F.min("label0").alias("label0"), F.min("label1").alias("label1"), F.min("doc_id").alias("first_id"))
    a = a.withColumns({"x": F.log2("size"), "y": F.coalesce(F.col("first_id").try_cast("double"), F.lit(0.0)), "weight": F.col("copies") * F.col("size")})
    lo_x, hi_x, lo_y, hi_y = a.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    scaled = lambda c, lo, hi: F.floor((F.col(c) - F.lit(lo or 0.0)) * F.lit(((1 << 2 * HALF) - 1) / (hi - lo) if lo is not None and hi > lo else 0.0))
    places = (scaled("x", lo_x, hi_x), _cell("label0"), _cell("label1"), scaled("y", lo_y, hi_y), _cell("text_hash", F.lit(1)))
    return a.select(*KEY, "weight", F.lit(1).cast("long").alias("node"), *[x.cast("long").alias(d) for x, d in zip(places, DIMS)])


def split_of(x: np.ndarray, w: np.ndarray, target: int) -> tuple[int, int] | None:
    """(dimension, cut) of a node: atoms up to the cut are one half. None for a leaf."""
    span = x.max(axis=0) - x.min(axis=0)
    d = int(np.argmax(span[:-1])) if span[:-1].max() else len(span) - 1
    if w.sum() <= target or not span[d]:
        return None
    order = np.argsort(x[:, d], kind="stable")
    sums = np.cumsum(w[order])
    cut = int(x[order[np.searchsorted(2 * sums, sums[-1])], d])
    return d, min(cut, int(x[:, d].max()) - 1)


def leaves_of(x: np.ndarray, w: np.ndarray, target: int) -> np.ndarray:
    """Each atom's leaf in the subtree of one node."""
    out, left, n = np.zeros(len(w), np.int64), [np.arange(len(w))], 0
    while left:
        at = left.pop()
        if (s := split_of(x[at], w[at], target)) is None:
            out[at] = n
            n += 1
        else:
            low = x[at, s[0]] <= s[1]
            left += [at[~low], at[low]]
    return out


def _cut_level(atoms: DataFrame, target: int, most: int) -> DataFrame | None:
    """One level of cuts of the nodes with more than ``most`` atoms; None if there is no such node."""
    spans = [(F.max(d) - F.min(d)).alias(f"span_{d}") for d in DIMS]
    stats = atoms.groupBy("node").agg(F.count("*").alias("n"), F.sum("weight").alias("total"), *spans, *[F.max(d).alias(f"top_{d}") for d in DIMS])
    widest = F.greatest(*[F.col(f"span_{d}") for d in DIMS[:-1]])
    pick = lambda of: F.coalesce(*[F.when((widest > 0) & (F.col(f"span_{d}") == widest), of(d)) for d in DIMS[:-1]], of(DIMS[-1]))
    chosen = stats.filter((F.col("n") > most) & (F.col("total") > target)).select("node", "total", pick(F.lit).alias("dim"), pick(lambda d: F.col(f"top_{d}")).alias("top"), pick(lambda d: F.col(f"span_{d}")).alias("span")).filter("span > 0")
    chosen = durable(chosen.drop("span"), "nodes")
    if not chosen.limit(1).count():
        release(chosen)
        return None
    value = F.coalesce(*[F.when(F.col("dim") == d, F.col(d)) for d in DIMS])
    open_ = atoms.join(chosen, "node").select("node", "weight", "total", "top", value.alias("x"))

    def reached(bins: DataFrame, before: Column) -> DataFrame:
        # at most 2 ** HALF bins a node
        upto = Window.partitionBy("node").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        sums = bins.withColumn("upto", before + F.sum("w").over(upto)).filter(2 * F.col("upto") >= F.col("total"))
        return sums.groupBy("node").agg(F.min(F.struct("bin", "upto", "w", "top")).alias("b")).select("node", F.col("b.bin").alias("bin"), (F.col("b.upto") - F.col("b.w")).alias("before"), "b.top")

    coarse = open_.groupBy("node", F.shiftright("x", HALF).alias("bin")).agg(F.sum("weight").alias("w"), F.first("total").alias("total"), F.first("top").alias("top"))
    first = durable(reached(coarse, F.lit(0)).select("node", F.col("bin").alias("high"), "before"), "bins")
    inside = open_.join(first, "node").filter(F.shiftright("x", HALF) == F.col("high"))
    fine = inside.groupBy("node", F.col("x").alias("bin")).agg(F.sum("weight").alias("w"), F.first("total").alias("total"), F.first("top").alias("top"), F.first("before").alias("before"))
    cuts = reached(fine, F.col("before")).select("node", F.least(F.col("bin"), F.col("top") - 1).alias("cut")).join(chosen.select("node", "dim"), "node")
    moved = atoms.join(cuts, "node", "left").withColumn("node", F.when(F.col("cut").isNull(), F.col("node")).otherwise(2 * F.col("node") + F.when(value > F.col("cut"), 1).otherwise(0)))
    out = durable(moved.select(*KEY, "weight", "node", *DIMS), "atoms")
    release(chosen, first)
    return out


def kd_leaves(atoms: DataFrame, target: int, most: int | None = None) -> DataFrame:
    """The key of each atom with its weight and its leaf (node, leaf). ``target``: bytes up to which a node is a leaf."""
    most = TASK_ATOMS if most is None else most
    while (cut := _cut_level(atoms, target, most)) is not None:
        release(atoms)
        atoms = cut

    def finish(group: pd.DataFrame) -> pd.DataFrame:
        leaf = leaves_of(group[list(DIMS)].to_numpy(), group["weight"].to_numpy(), target)
        return group[[*KEY, "weight", "node"]].assign(leaf=leaf)

    kinds = dict(atoms.dtypes)
    out = durable(atoms.groupBy("node").applyInPandas(finish, ", ".join(f"{c} {kinds[c]}" for c in (*KEY, "weight", "node")) + ", leaf long"), "leaves")
    release(atoms)
    return out


def runs_of_leaves(weights: np.ndarray, filled: np.ndarray, uneven: float = 0.01) -> np.ndarray:
    """The shard of each leaf, leaves being in tree order: runs as heavy as what the shards still lack. If the fullest and the emptiest shard then differ by more than ``uneven`` of a shard, leaves go from one to the other, or change places, as long as that helps."""
    shards, level = len(filled), (int(weights.sum()) + int(filled.sum())) / len(filled)
    room = np.maximum(0, level - filled)
    ends = np.cumsum(room) * (weights.sum() / max(1e-9, room.sum()))
    home = np.minimum(np.searchsorted(ends, np.cumsum(weights) - weights / 2, side="right"), shards - 1)
    sums = filled + np.bincount(home, weights, shards)
    for _ in range(200 * shards):
        a, b = int(sums.argmax()), int(sums.argmin())
        gap = sums[a] - sums[b]
        mine, other = np.flatnonzero(home == a), np.flatnonzero(home == b)
        if gap <= uneven * level or not len(mine):
            break
        # against which leaf of the other shard, or none, does each leaf change the gap most nearly by half
        other = other[np.argsort(weights[other], kind="stable")]
        back = np.concatenate([[0], weights[other]])
        at = np.searchsorted(back, weights[mine] - gap / 2)
        pairs = np.stack([np.clip(at - 1, 0, len(back) - 1), np.clip(at, 0, len(back) - 1)], axis=1)
        moved = weights[mine][:, None] - back[pairs]
        miss = np.where((moved > 0) & (moved < gap), np.abs(moved - gap / 2), np.inf)
        i, k = np.unravel_index(int(miss.argmin()), miss.shape)
        if not np.isfinite(miss[i, k]):
            break
        home[mine[i]] = b
        if pairs[i, k]:
            home[other[pairs[i, k] - 1]] = a
        sums[a] -= moved[i, k]
        sums[b] += moved[i, k]
    return home


def kd_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text: str = "text", labels: Sequence[str] = ("lang", "source")) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard for each row of ``docs``; shards have nearly equal bytes.

    Equal texts share a shard, but for a text whose copies weigh more than a
    shard: no shard can hold it, so its rows are spread over several. Null text:
    one byte. Null labels or ids, and labels without a column: empty or zero as a
    coordinate. Repeated rows are rows like others. Fewer texts than shards leave
    shards empty; no rows: none. Very long texts are measured where they are and
    never shuffled. Slots are in the order of doc_id within hashed buckets,
    gapless from 0. About 2 * shards * LEAVES leaves reach the driver, and one more
    for each text heavier than a leaf.
    """
    meta = durable(documents_meta(docs, id_col, text, labels), "meta")
    total, rows = (x or 0 for x in meta.agg(F.sum("size"), F.count("*")).first())
    target = max(1, total // (shards * LEAVES))
    tree = kd_leaves(durable(atoms_of(meta), "atoms"), target)
    leaves = [(r["w"], r["node"], r["leaf"]) for r in tree.groupBy("node", "leaf").agg(F.sum("weight").alias("w")).collect()]
    # a leaf that is heavier than a shard goes to several, in parts
    level, filled = -(-total // shards), np.zeros(shards, np.int64)
    spread = sorted((x for x in leaves if x[0] * shards > total), reverse=True)
    parts = []
    for whole, _, _ in spread:
        left, taken = whole, []
        for s in np.argsort(filled, kind="stable").tolist():
            part = int(min(left, max(0, level - filled[s])))
            if part:
                taken.append((s, part / whole))
                left -= part
                filled[s] += part
        parts.append(taken)
    deep = max((node.bit_length() for _, node, _ in leaves), default=0)
    homes = sorted((x for x in leaves if x[0] * shards <= total), key=lambda x: (x[1] << (deep - x[1].bit_length()), x[2]))
    dealt = [(node, leaf, -1 - i) for i, (_, node, leaf) in enumerate(spread)]
    dealt += [(node, leaf, s) for (_, node, leaf), s in zip(homes, runs_of_leaves(np.array([w for w, _, _ in homes], np.int64), filled).tolist())]
    home = docs.sparkSession.createDataFrame(dealt, "node long, leaf long, shard int")
    placed = meta.join(tree.join(home, ["node", "leaf"]).select(*KEY, "shard"), list(KEY))
    for i, taken in enumerate(parts):
        # each row by a hash, in proportion to what a shard takes
        u, pick = _unit("row", F.lit(7)), F.lit(taken[-1][0])
        for k in range(len(taken) - 2, -1, -1):
            pick = F.when(u < sum(p for _, p in taken[: k + 1]), F.lit(taken[k][0])).otherwise(pick)
        placed = placed.withColumn("shard", F.when(F.col("shard") == -1 - i, pick).otherwise(F.col("shard")))
    return _slotted(placed, rows, shards).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _slotted(dealt: DataFrame, rows: int, shards: int, rows_a_bucket: int = 20_000) -> DataFrame:
    """Adds ``slot``: a shard's rows are ranked in hashed buckets of bounded size, and each bucket begins where the last one ended."""
    buckets = max(8, -(-rows // (shards * rows_a_bucket)))
    dealt = durable(dealt.withColumn("bucket", F.pmod(F.xxhash64("row", F.lit(3)), F.lit(buckets)).cast("int")), "dealt")
    sizes = dealt.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    begins = sizes.withColumn("begin", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "row")) - 1)
    return ranked.join(begins, ["shard", "bucket"]).withColumn("slot", (F.col("begin") + F.col("rank")).cast("long"))


def write_shards(docs: DataFrame, path: str, shards: int = 8, id_col: str = "doc_id", text: str = "text") -> None:
    """Write every row of ``docs`` with all its columns into ``path/shard=K/``.

    Rows find their shard by id and text, so repeated ids and rows are written as
    often as they occur. A column called ``shard`` gives way to the new one; all
    other columns stay, whatever they are called. Null ids and texts have their
    shard too; an empty table writes no rows.
    """
    where = kd_shards(docs, shards, id_col, text).groupBy("doc_id", "size", "text_crc32").agg(F.min("shard").alias("shard")).alias("w")
    d = docs.drop("shard").alias("d")
    whole = text_or_empty(F.col(f"d.`{text}`"))
    same = F.col(f"d.`{id_col}`").eqNullSafe(F.col("w.doc_id")) & (F.octet_length(whole) + 1 == F.col("w.size")) & (F.crc32(whole.cast("binary")) == F.col("w.text_crc32"))
    d.join(where, same).select("d.*", "w.shard").write.partitionBy("shard").parquet(path)
