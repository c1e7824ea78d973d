"""N-gram Jaccard self-join by token-combination prefixes.

A document is its set of distinct word n-grams, as 64-bit hashes. Of two linked
sets, the larger one's tokens that the other lacks are fewer than p.

* Region: the p - 1 + k lowest tokens of a set in the order of their hashes. The
  regions of two linked sets share k tokens at least (of the smaller set's k).
* Tokens are counted over all regions. A set with fewer than k tokens that some
  other region has too is linked with nothing and leaves here.
* Prefix: with the rarest tokens first, two linked sets share one of the first
  ``region - k + 1`` tokens of their regions. Rare tokens are indexed alone.
* A prefix that reaches frequent tokens is extended by g tokens, which are dealt
  into g groups; pairs of a group's tokens are indexed. Linked sets without a
  rare token in common share g + 1 of these tokens, so a pair of some group.
* Sets with the same least frequent token come to the same tasks. Where a chunk of
  sets has many under one key, they are one family already and stand under it once.
* Sets that meet under a key are compared by parity bitmaps, whose difference is
  at most that of the sets; what may link is closed into families, whose sets are
  verified exactly in blocks of bounded size. Only edges of spanning forests are
  handed on, never all pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import components, least_of_each
from .common import durable, prepare_workers, release, sliced, text_or_empty, trimmed

#: Documents up to which a token is rare; entries of a key beyond which they are taken as one family without looking at bitmaps.
RARE, HOT = 8, 512
#: Entries of a key within a chunk beyond which they are taken as one family at once; entries of a chunk; tokens of all sets for each of the parts into which sets with one least frequent token are dealt.
OFTEN, CHUNK_KEYS, PART_TOKENS = 64, 1_000_000, 8_000_000
#: Tokens of a block of sets; documents of a chunk in which heavy tokens are looked for; words whose hashes a worker keeps.
BLOCK_TOKENS, CHUNK_DOCS, KEPT_WORDS = 1_000_000, 2048, 250_000
#: Bits of a set's parity bitmap, and of that of a set of LONG tokens or more.
BITS, LONG_BITS, LONG = 512, 2048, 2000

_C = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0x7FB5D329728EA185, 0x81DADEF4BC2DD44D))


class _Words(dict):
    """Hashes of words, each made once while it is kept."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word, seed=20)
        if len(word) < 64:
            self[word] = h
        return h


_hash_of = _Words()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _C[1]
    h = (h ^ (h >> np.uint64(27))) * _C[2]
    return h ^ (h >> np.uint64(33))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes (int64) of the ``width``-word sequences of a text; with fewer words, of the whole sequence; without words none. Words: runs without ASCII white space, A-Z in lower case."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.int64)
    w = np.fromiter(map(_hash_of.__getitem__, words), np.uint64, len(words))
    k = min(width, len(w))
    with np.errstate(over="ignore"):
        h = _mixed(w[: len(w) - k + 1] + _C[0])
        for j in range(1, k):
            h = _mixed(h * _C[0] + w[j : len(w) - k + 1 + j])
    return np.unique(h.view(np.int64))


def extra_of(width: int) -> float:
    """k as a multiple of p. Short n-grams recur by chance, so more of them are looked at."""
    return 1.0 if width <= 3 else 0.5


def sizes_of(n: int, percent: int, extra: float) -> tuple[int, int]:
    """Length of the region of a set of n tokens, and k of that set."""
    p = n - -(-n * percent // 100) + 1
    k = min(int(np.ceil(extra * p)), n - p + 1)
    return p - 1 + k, k


def least_shared(n: int, percent: int, extra: float) -> int:
    """Tokens that the region of a set of n tokens shares with that of any linked set: k of the smallest set that can link with it."""
    return sizes_of(-(-n * percent // 100), percent, extra)[1]


def bitmap(tokens: np.ndarray) -> bytes:
    """Parities of the tokens' counts by their low bits."""
    width = LONG_BITS if len(tokens) >= LONG else BITS
    return np.packbits((np.bincount(tokens & (width - 1), minlength=width) & 1).astype(bool)).tobytes()


def sketches(docs: DataFrame, width: int, marks_of: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """row, doc_id, n, digest of the set, its bitmap and its marks (int64 numbers that ``marks_of`` takes from the set)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            ns, digests, bits, marks = [], [], [], []
            for t in batch.column("text"):
                s = shingles(t.as_py(), width)
                ns.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                bits.append(bitmap(s))
                marks.append(marks_of(s) if len(s) else s)
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in marks])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(marks) if marks else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(ns, pa.int64()), pa.array(digests, pa.binary()), pa.array(bits, pa.binary()), lists], ["row", "doc_id", "n", "digest", "bits", "marks"])
        _hash_of.clear()  # workers live on, and later stages need the room

    kind = docs.schema["doc_id"].dataType.simpleString()
    return durable(docs.select("row", "doc_id", "text").mapInArrow(trimmed(work), f"row long, doc_id {kind}, n long, digest binary, bits binary, marks array<bigint>"), "sketches")


def _heavy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens that more than RARE regions of a chunk of documents have. They are known to be frequent, so their rows need not meet to be counted."""

    def chunk(parts: list[np.ndarray]) -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(parts), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(values[counts > RARE])], ["t"])

    held, n = [], 0
    for batch in batches:
        held.append(batch.column("marks").flatten().to_numpy())
        n += batch.num_rows
        if n >= CHUNK_DOCS:
            yield chunk(held)
            held, n = [], 0
    if held:
        yield chunk(held)


def _key(*values: int) -> int:
    return int.from_bytes(hashlib.blake2b(np.array(values, np.int64).tobytes(), digest_size=8).digest(), "little", signed=True)


def signature(n: int, percent: int, extra: float, tokens: list[tuple[int, int]]) -> list[int]:
    """Keys of a document; none if it is linked with nothing. tokens: (documents, token) of those in its region that another region has too; counts of frequent ones are all taken as RARE + 1."""
    region, _ = sizes_of(n, percent, extra)
    unique, shared = region - len(tokens), least_shared(n, percent, extra)
    if len(tokens) < shared:
        return []
    tokens.sort()
    prefix = region - shared + 1 - unique
    keys = [t for c, t in tokens[:prefix] if c <= RARE]
    if len(keys) < prefix:
        # groups by the binary order of the size. Orders of linked sets differ by one at most, so each set stands under its own and the one below
        own = n.bit_length() - 1
        for order in (own, own - 1) if own else (own,):
            g = sizes_of(1 << order, percent, extra)[1] // 2
            if g == 0:  # too small for pairs: frequent tokens alone
                keys += [_key(order, t) for c, t in tokens[:prefix] if c > RARE]
                continue
            groups: dict[int, list[int]] = {}
            for c, t in tokens[: prefix + g]:
                if c > RARE:
                    groups.setdefault(t % g, []).append(t)
            keys += [_key(order, t, u) for m in groups.values() for t, u in combinations(m, 2)]
    return keys


def met_often(keys: np.ndarray, at: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries (key, position of a row) of a chunk of ``rows`` rows: which of them stay, how many each stands for, and for each row the first one that it reaches by keys of more than OFTEN entries. Of such a key one entry stays."""
    values, first, inverse, counts = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    often = (counts > min(OFTEN, HOT))[inverse]
    reached = least_of_each(at[often], rows + inverse[often], rows + len(values))[:rows]
    stays = ~often
    stays[first] = True
    return stays, np.where(often, counts[inverse], 1), reached


class Bitmaps:
    """Bitmaps of some sets, with a bound that tells which of them may link."""

    def __init__(self, sizes: np.ndarray, bits: pa.Array, percent: int):
        self.sizes, self.percent = sizes, percent
        offsets = np.frombuffer(bits.buffers()[1], np.int32)[bits.offset : bits.offset + len(bits) + 1].astype(np.int64)
        data = np.frombuffer(bits.buffers()[2], np.uint8) if bits.buffers()[2] else np.zeros(0, np.uint8)
        long = np.diff(offsets) > BITS // 8
        self.short = np.zeros((len(sizes), BITS // 8), np.uint8)
        self.short[~long] = data[offsets[:-1][~long][:, None] + np.arange(BITS // 8)]
        whole = data[offsets[:-1][long][:, None] + np.arange(LONG_BITS // 8)]
        self.short[long] = np.bitwise_xor.reduce(whole.reshape(len(whole), LONG_BITS // BITS, BITS // 8), axis=1)
        self.short, self.long = self.short.view(np.uint64), np.ascontiguousarray(whole).view(np.uint64)
        self.at = np.where(long, np.cumsum(long) - 1, -1)

    def may_link(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For pairs of positions (a may be one for all of b)."""
        a = np.broadcast_to(a, b.shape)
        x, y, t = self.sizes[a], self.sizes[b], self.percent
        most = x + y - 2 * -(-t * (x + y) // (100 + t))
        ok = (np.minimum(x, y) * 100 >= np.maximum(x, y) * t) & (np.bitwise_count(self.short[a] ^ self.short[b]).sum(axis=1) <= most)
        both = np.flatnonzero(ok & (self.at[a] >= 0) & (self.at[b] >= 0))
        ok[both] = np.bitwise_count(self.long[self.at[a[both]]] ^ self.long[self.at[b[both]]]).sum(axis=1) <= most[both]
        return ok


def runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Sorted batches cut anew, so that rows that are equal in ``names`` are never in two of them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = [batch.column(c)[batch.num_rows - 1].as_py() for c in names]
        same = np.ones(batch.num_rows, bool)
        for c, x in zip(names, last):
            same &= batch.column(c).to_numpy() == x
        cut = int(np.argmax(same))  # the last run begins here
        if cut or (held and [held[-1].column(c)[0].as_py() for c in names] != last):
            held.append(batch.slice(0, cut))
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def likely_edges(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(u, v): which entries of a key may link by their bitmaps. In: (key, row, n, bits), sorted by key and row; a key has HOT entries at most."""
    for batch in runs(batches, ["key"]):
        key, row = batch.column("key").to_numpy(), batch.column("row").to_numpy()
        maps = Bitmaps(batch.column("n").to_numpy(), batch.column("bits"), percent)
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        counts = np.diff(np.concatenate([starts, [len(key)]]))
        small = np.repeat(counts <= RARE, counts)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for d in range(1, min(RARE, int(counts.max()))):
            a = np.flatnonzero(small[:-d] & (key[:-d] == key[d:]))
            a = a[maps.may_link(a, a + d)]
            found.append((a, a + d))
        for s, n in zip(starts[counts > RARE].tolist(), counts[counts > RARE].tolist()):
            left, queue = np.arange(s, s + n), []
            while len(left):
                if not queue:
                    queue.append(int(left[0]))
                    left = left[1:]
                x = queue.pop()
                ok = maps.may_link(np.int64(x), left)
                near, left = left[ok], left[~ok]
                found.append((np.full(len(near), x), near))
                queue += near.tolist()
        pairs = np.unique(np.stack([row[np.concatenate([f[i] for f in found])] if found else np.zeros(0, np.int64) for i in (1, 0)], axis=1), axis=0)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])


class Sets:
    """Some sets of tokens, compared exactly; large collections look at bitmaps first."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.sizes, self.percent = np.array([len(s) for s in sets], np.int64), percent
        flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
        values, self.local = np.unique(flat, return_inverse=True)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.mark = np.zeros(len(values), bool)
        self.maps = None
        if len(sets) > 16:
            bits = pa.array([bitmap(s) for s in sets], pa.binary())
            self.maps = Bitmaps(self.sizes, bits, percent)

    def linked(self, x: int, others: np.ndarray) -> np.ndarray:
        """Which of ``others`` link with x."""
        n, sizes, t = self.sizes[x], self.sizes[others], self.percent
        near = others[(sizes > 0) & (n > 0) & (sizes * 100 >= n * t) & (n * 100 >= sizes * t)]
        if self.maps is not None and len(near):
            near = near[self.maps.may_link(np.int64(x), near)]
        if not len(near):
            return near
        sizes, own = self.sizes[near], self.local[self.starts[x] : self.starts[x] + n]
        self.mark[own] = True
        at = np.repeat(self.starts[near] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        common = np.add.reduceat(self.mark[self.local[at]].astype(np.int64), np.cumsum(sizes) - sizes)
        self.mark[own] = False
        return near[100 * common >= t * (n + sizes - common)]


def family_edges(rows: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among these sets, by breadth-first search over those not yet reached."""
    these = Sets(sets, percent)
    left, queue, out = np.arange(len(sets)), [], []
    while len(left):
        if not queue:
            queue.append(int(left[0]))
            left = left[1:]
        x = queue.pop()
        found = these.linked(x, left)
        if len(found):
            out += [(int(rows[x]), int(rows[y])) for y in found]
            queue += found.tolist()
            left = left[~np.isin(left, found)]
    return out


def joining_edges(rows: np.ndarray, asking: np.ndarray, parts: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links from asking sets to sets of other parts, one for each two parts that turn out as one."""
    these, parts, out = Sets(sets, percent), parts.copy(), []
    for x in np.flatnonzero(asking).tolist():
        for y in these.linked(x, np.flatnonzero(parts != parts[x])).tolist():
            if parts[y] != parts[x]:
                out.append((int(rows[x]), int(rows[y])))
                parts[parts == parts[y]] = parts[x]
    return out


def _edges_of(members: DataFrame, percent: int, joining: bool) -> DataFrame:
    """(u, v) by group: members (family, a, b, row, asks, part, tokens)."""
    names = ["family", "a", "b"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, names):
            ids = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in names])
            cuts = np.flatnonzero(np.concatenate([[True], (ids[:, 1:] != ids[:, :-1]).any(axis=0), [True]]))
            row, asks, part = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("row", "asks", "part"))
            edges: list[tuple[int, int]] = []
            for s, e in zip(cuts[:-1], cuts[1:]):
                sets = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("tokens").slice(s, e - s)]
                if joining:
                    edges += joining_edges(row[s:e], asks[s:e], part[s:e], sets, percent)
                else:
                    edges += family_edges(row[s:e], sets, percent)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in edges], pa.int64()) for i in (0, 1)], ["u", "v"])

    columns = ["family", "a", "b", "row", "asks", "part", "tokens"]
    return members.select(*columns).repartition(*names).sortWithinPartitions(*names, "row").mapInArrow(trimmed(work), "u long, v long")


def likely_families(distinct: DataFrame, width: int, percent: int) -> DataFrame:
    """(row, family) of the sets that may link with another. distinct: row, n, bits and marks (regions) of distinct sets."""
    extra = extra_of(width)
    heavy = durable(distinct.select("marks").mapInArrow(trimmed(_heavy), "t long").distinct(), "heavy")
    tokens = distinct.select("row", F.explode("marks").alias("t"))
    counted = tokens.join(heavy, "t", "left_anti").repartition("t").withColumn("c", F.least(F.count("*").over(Window.partitionBy("t")), F.lit(RARE + 1)).cast("int")).filter("c > 1")
    shared = counted.select("row", "c", "t").unionByName(tokens.join(heavy, "t", "left_semi").select("row", F.lit(RARE + 1).alias("c"), "t"))
    enough = shared.groupBy("row").agg(F.collect_list(F.struct("c", "t")).alias("tokens"))
    by_row = enough.join(distinct.select("row", "n", "bits"), "row")
    parts = 1 + (distinct.agg(F.sum("n")).first()[0] or 0) // PART_TOKENS
    least = F.array_min(F.transform(F.filter("tokens", lambda x: x["c"] > RARE), lambda x: x["t"]))
    met = by_row.withColumns({"least": F.coalesce(least, "row"), "salt": F.pmod(F.xxhash64("row"), F.lit(parts))}).repartition("least", "salt").sortWithinPartitions("least")

    def kept(held: list[tuple[np.ndarray, np.ndarray, pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
        """The entries that stay, and after them, without a key, rows with the one that stands for them in the place of n."""
        starts = np.cumsum([0, *(batch.num_rows for _, _, batch in held)])
        stays, m, reached = met_often(np.concatenate([k for k, _, _ in held]), np.concatenate([at + s for (_, at, _), s in zip(held, starts)]), int(starts[-1]))
        done = 0
        for keys, at, batch in held:
            here = stays[done : done + len(keys)]
            yield pa.RecordBatch.from_arrays([pa.array(keys[here]), *batch.take(pa.array(at[here])).columns, pa.array(m[done : done + len(keys)][here])], names)
            done += len(keys)
        row = np.concatenate([batch.column("row").to_numpy() for _, _, batch in held])
        moved = np.flatnonzero(reached != np.arange(len(row)))
        yield pa.RecordBatch.from_arrays([pa.nulls(len(moved), pa.int64()), pa.array(row[moved]), pa.array(row[reached[moved]]), pa.nulls(len(moved), pa.binary()), pa.array(np.zeros(len(moved), np.int64))], names)

    names = ["key", "row", "n", "bits", "m"]

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in sliced(batches):
            keys, at = [], []
            for i, (size, tokens) in enumerate(zip(batch.column("n").to_pylist(), batch.column("tokens"))):
                v = tokens.values
                found = signature(size, percent, extra, list(zip(*(v.field(j).to_pylist() for j in range(2)))))
                keys += found
                at += [i] * len(found)
            held.append((np.array(keys, np.int64), np.array(at, np.int64), batch.select(["row", "n", "bits"])))
            n += len(keys)
            if n >= CHUNK_KEYS:
                yield from kept(held)
                held, n = [], 0
        if held:
            yield from kept(held)

    keys = durable(met.select("row", "n", "bits", "tokens").mapInArrow(trimmed(keyed), "key long, row long, n long, bits binary, m long"), "keys")
    found = families_of(keys.filter("key is not null"), percent, keys.filter("key is null").select(F.col("row").alias("u"), F.col("n").alias("v")))
    release(keys, heavy)
    return found


def families_of(keys: DataFrame, percent: int, known: DataFrame | None = None) -> DataFrame:
    """(row, family) of the sets that meet others under a key and may link with them by their bitmaps, closed. keys: a table of (key, row, n, bits, m), of which an entry stands for m that are one family by ``known`` (u, v)."""
    hot = durable(keys.groupBy("key").agg(F.sum("m").alias("all"), F.max("m").alias("most"), F.min("row").alias("centre")).filter((F.col("all") > HOT) | (F.col("most") > 1)).select("key", "centre"), "hot")
    stars = keys.select("key", "row").join(hot, "key").filter("row <> centre").select(F.col("row").alias("u"), F.col("centre").alias("v")).distinct()
    sorted_ = keys.select("key", "row", "n", "bits").join(hot, "key", "left_anti").repartition("key").sortWithinPartitions("key", "row")
    likely = sorted_.mapInArrow(trimmed(lambda batches: likely_edges(batches, percent)), "u long, v long")
    found = stars.unionByName(likely)
    edges = durable((found if known is None else found.unionByName(known)).distinct(), "likely")
    release(hot)
    families = components(edges)
    release(edges)
    found = families.select(F.col("node").alias("row"), F.col("component").alias("family"))
    found._skeinframe_folder = families._skeinframe_folder
    return found


def verified_parts(families: DataFrame, distinct: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(node, component) of the sets that link with another. families: (row, family); distinct: row, doc_id, n and digest; texts: doc_id and text."""
    members = families.join(distinct.select("row", "doc_id", "n", "digest"), "row")
    blocks = members.groupBy("family").agg(F.ceil(F.sum("n") / BLOCK_TOKENS).cast("int").alias("blocks"), *[F.min(F.struct(F.xxhash64("row", F.lit(i)), "row"))["row"].alias(f"pivot{i}") for i in range(3)])
    placed = durable(members.join(blocks, "family").withColumn("a", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")), "placed")
    kind = distinct.schema["doc_id"].dataType.simpleString()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [shingles(t.as_py(), width).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([hashlib.blake2b(s, digest_size=16).digest() for s in found], pa.binary()), pa.array(found, pa.binary())], ["doc_id", "digest", "tokens"])
        _hash_of.clear()

    again = texts.join(placed.select("doc_id").distinct(), "doc_id", "left_semi").mapInArrow(trimmed(sets), f"doc_id {kind}, digest binary, tokens binary")
    # rows that repeat an id and a text would come as often as they are repeated
    whole = durable(placed.join(again, ["doc_id", "digest"]).dropDuplicates(["row"]).select("family", "a", "blocks", "row", "pivot0", "pivot1", "pivot2", "tokens"), "sets")
    # first each block by itself, with three sets of the family that all of its blocks have
    is_pivot = (F.col("blocks") > 1) & F.col("row").isin(F.col("pivot0"), F.col("pivot1"), F.col("pivot2"))
    everywhere = whole.withColumn("a", F.explode(F.when(is_pivot, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("a"))))
    within = durable(_edges_of(everywhere.withColumns({"b": F.lit(-1), "asks": F.lit(False), "part": F.col("row")}), percent, False), "within")
    parts = components(within)
    # then what is outside its family's largest part against all of the family's other parts
    several = whole.filter("blocks > 1").join(parts.select(F.col("node").alias("row"), F.col("component").alias("part")), "row", "left").withColumn("part", F.coalesce("part", "row"))
    counts = several.groupBy("family", "part").agg(F.count("*").alias("m"))
    main = counts.groupBy("family").agg(F.max(F.struct("m", "part"))["part"].alias("main"), F.count("*").alias("parts")).filter("parts > 1")
    split = durable(several.join(main, "family"), "split")
    asking = split.filter("part <> main")
    askers = asking.groupBy("family").agg(F.ceil(F.sum(F.octet_length("tokens") / 8) / BLOCK_TOKENS).cast("int").alias("asker_blocks"))
    asked = split.join(askers, "family").withColumns({"b": F.explode(F.sequence(F.lit(0), F.col("asker_blocks") - 1)), "asks": F.lit(False)})
    asks = asking.join(askers, "family").withColumns({"b": F.pmod(F.xxhash64("row", F.lit(5)), F.col("asker_blocks")).cast("int"), "a": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), "asks": F.lit(True)})
    columns = ["family", "a", "b", "row", "asks", "part", "tokens"]
    if split.limit(1).count():
        across = durable(_edges_of(asked.select(*columns).unionByName(asks.select(*columns)), percent, True), "across")
        old = parts
        parts = components(old.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(across))
        release(old, across)
    release(placed, whole, within, split)
    return parts


def set_components(docs: DataFrame, width: int, percent: int, marks_of: Callable[[np.ndarray], np.ndarray], families: Callable[[DataFrame], DataFrame], id_col: str, text: str) -> DataFrame:
    """doc_id, n_shingles and component_id for each row of ``docs``: equal sets are compared once, ``families`` brings together which of the distinct sets (row, n, bits, marks) may link, and links are confirmed on full sets."""
    prepare_workers(docs.sparkSession)
    picked = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text).alias("text")).withColumn("row", F.monotonically_increasing_id())
    sketch = sketches(picked, width, marks_of)
    able = sketch.filter("n > 0 and doc_id is not null")
    first = durable(able.groupBy("digest").agg(F.min(F.struct("doc_id", "row")).alias("f"), F.first("n").alias("n")).select("digest", "n", "f.doc_id", "f.row"), "distinct")
    copies = durable(able.select("row").join(first.select("row"), "row", "left_anti"), "copies")
    near = families(able.join(copies, "row", "left_anti"))
    texts = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text).alias("text"))
    found = verified_parts(near, first, texts, width, percent)
    release(near, copies)
    parts = found.select(F.col("node").alias("row"), F.col("component").alias("part"))
    # a table of its own, so that Spark knows its size and a large part is not dealt to one task
    least = durable(parts.join(first.select("row", "doc_id"), "row").groupBy("part").agg(F.min("doc_id").alias("least")), "least")
    of_set = first.join(parts, "row", "left").join(least, "part", "left").select("digest", F.coalesce("least", "doc_id").alias("component_id"))
    linked = sketch.select("doc_id", "n", F.when(F.col("n") > 0, F.col("digest")).alias("digest")).join(of_set, "digest", "left")
    return linked.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def ngram_components(docs: DataFrame, width: int = 3, percent: int = 90, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) for each row of ``docs``.

    Two rows link if 100 * intersection >= percent * union of their sets of
    ``width``-word sequences. Empty sets (null text, no words) link with nothing.
    Equal sets link; each distinct set is compared once. A row whose id is null
    links with nothing and has a null component. Repeated rows each get their
    result; no rows: none. Very long texts count whole; a worker holds one text's
    set at a time, of 8 bytes a token. Other columns are not looked at.
    """
    extra = extra_of(width)
    return set_components(docs, width, percent, lambda s: s[: sizes_of(len(s), percent, extra)[0]], lambda distinct: likely_families(distinct, width, percent), id_col, text)


def one_of_each_group(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its group; of repeated rows with that id, all. Rows with a null id stay."""
    found = ngram_components(docs, width, percent, id_col, text).filter("doc_id is not null")
    lost = found.groupBy(F.col("doc_id").alias(id_col)).agg(F.max(F.col("component_id") == F.col("doc_id")).alias("kept")).filter("not kept").select(id_col)
    return docs.join(lost, id_col, "left_anti")
