"""Near duplicates by min-max hashing.

Each document is its set of distinct word n-grams, as 64-bit hashes. Under each of
PERMUTATIONS random orders of the hashes both the least and the greatest element
are kept. Both agree between two sets with the probability of their Jaccard
similarity, so the signature has two values for each pass over the set, and the
share of equal values has a lower variance than that of as many single minima.

BAND values in turn make a key. Two sets of similarity s meet under none of the
keys with a probability of about (1 - s ** BAND) ** (2 * PERMUTATIONS / BAND):
2e-8 at 0.85. Sets that meet are compared by parity bitmaps, closed into families
and verified on their full sets in blocks, as in the n-gram join, so that no link
is reported that is not there.
"""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, release
from .ngram_join import families_of, set_components

#: Random orders (two values of the signature each), and values of a band.
PERMUTATIONS, BAND = 48, 4
#: Hashes of a set that are put in all orders at a time.
PART = 4096


@cache
def _orders(count: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**64, (count, 1), np.uint64), rng.integers(0, 2**64, (count, 1), np.uint64) | np.uint64(1)


def signature(tokens: np.ndarray, permutations: int = PERMUTATIONS) -> np.ndarray:
    """Least and greatest value of a set under each order, in turn (uint64). An empty set has none."""
    if not len(tokens):
        return np.zeros(0, np.uint64)
    mask, factor = _orders(permutations)
    least, most = np.full(permutations, 2**64 - 1, np.uint64), np.zeros(permutations, np.uint64)
    t = tokens.view(np.uint64)
    for i in range(0, len(t), PART):
        # the high bits of a product depend on all bits of the hash
        h = (t[None, i : i + PART] ^ mask) * factor
        np.minimum(least, h.min(axis=1), out=least)
        np.maximum(most, h.max(axis=1), out=most)
    return np.stack([least, most], axis=1).reshape(-1)


def band_keys(tokens: np.ndarray, permutations: int = PERMUTATIONS, band: int = BAND) -> np.ndarray:
    """One key (int64) for each ``band`` values of the signature; it depends on the band's place."""
    values = signature(tokens, permutations).reshape(-1, band)
    keys = np.arange(1, len(values) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for j in range(band):
        keys = (keys ^ values[:, j]) * np.uint64(0xD6E8FEB86659FD93)
        keys ^= keys >> np.uint64(32)
    return keys.view(np.int64)


def _families(distinct: DataFrame, percent: int) -> DataFrame:
    """Only sets that meet others are given their bitmaps. A key's sets are counted by partial sums; the counts are a table of their own, so that Spark can split a join's large keys."""
    bands = distinct.select("row", F.explode("marks").alias("key"))
    met = durable(bands.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1").select("key"), "met")
    shared = durable(bands.join(met, "key").select("key", "row"), "shared")
    keys = durable(shared.join(distinct.select("row", "n", "bits"), "row").select("key", "row", "n", "bits"), "keys")
    found = families_of(keys.withColumn("m", F.lit(1)), percent)
    release(met, shared, keys)
    return found


def minmax_components(docs: DataFrame, width: int = 5, percent: int = 85, id_col: str = "doc_id", text: str = "text", permutations: int = PERMUTATIONS, band: int = BAND) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links) and kept (whether that is the row's own id) for each row of ``docs``.

    Two rows link if 100 * intersection >= percent * union of their sets of
    ``width``-word sequences, with A-Z in lower case; with fewer words, the whole
    sequence is the set's one member. Null and empty texts and texts without words
    have empty sets and link with nothing. Equal sets always link. A row whose id is
    null links with nothing, has a null component and is kept. Repeated rows each
    get their result, so of repeated rows with a group's smallest id all are kept;
    no rows give none. Very long texts count whole, in parts of PART hashes. Other
    columns are not looked at.
    """
    if 2 * permutations % band:
        raise ValueError("a signature is cut into whole bands")
    found = set_components(docs, width, percent, lambda s: band_keys(s, permutations, band), lambda distinct: _families(distinct, percent), id_col, text)
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
