"""Runs of repeated words, found behind a mask of repeated k-grams.

A run is a stretch of consecutive words with smallest period q and a length of at
least max(min_length, min_exponent * q) that no neighbouring word extends. Moved by
its period, a run overlaps itself in length - q words. The least overlap over all q
is k, so each word of a run lies in a k-gram that stands twice in the text. Words
outside such k-grams can't join runs; the stretches between them are the segments
in which Main-Lorentz looks for runs: halve, find what crosses the middle from the
longest common extensions of both halves, and go on within the halves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_crc, prepare_workers, sliced, text_or_empty

_MIX = np.uint64(0x9E3779B97F4A7C15)

#: A word, as SQL and Java write it.
WORD = r"[^\x20\x09-\x0D]+"


def least_overlap(min_length: int, min_exponent: int) -> int:
    """Words in which any run overlaps itself moved by its period: the least max(min_length, min_exponent * q) - q. From q = min_length on that grows."""
    return max(1, min(max(min_length, min_exponent * q) - q for q in range(1, min_length + 1)))


def repeated(ids: np.ndarray, k: int) -> np.ndarray:
    """Which words lie in a k-gram that stands twice. Hashes that clash can only let more words through."""
    n = len(ids) - k + 1
    covered = np.zeros(len(ids), bool)
    if n < 2:
        return covered
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            h = (h ^ ids[j : j + n].astype(np.uint64)) * _MIX
            h ^= h >> np.uint64(29)
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    for j in range(k):
        covered[j : j + n] |= twice
    return covered


def _prefix_lengths(a: list[int], stop: int) -> list[int]:
    """z[i]: the length of the longest common prefix of a and a[i:], for i below ``stop``."""
    n, left, right = len(a), 0, 0
    z = [0] * stop
    for i in range(1, stop):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and a[k] == a[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def segment_runs(words: list[int], min_length: int, min_exponent: int) -> dict[tuple[int, int], int]:
    """(start, end) to smallest period of the runs of one segment, by Main-Lorentz. What is cut off by the border of a half is found across that border; of several periods of one stretch the smallest counts."""
    found: dict[tuple[int, int], int] = {}
    last, todo = len(words), [(0, len(words))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < min_length:
            continue
        mid, longest = (lo + hi) // 2, (hi - lo) // min_exponent
        todo += [(lo, mid), (mid, hi)]
        right, left = words[mid:hi], words[lo:mid][::-1]
        longest = min(longest, len(left), len(right))
        # right + [-1] + words from mid - longest on: common prefixes of the right half with itself and with what begins left of the middle; left the same, backwards
        ahead = _prefix_lengths([*right, -1, *words[mid - longest : hi]], len(right) + 1 + longest)
        back = _prefix_lengths([*left, -1, *words[lo : mid + longest][::-1]], len(left) + 1 + longest)
        for q in range(1, longest + 1):
            least = max(min_length, min_exponent * q)
            for s, e in (
                (mid - back[len(left) + 1 + longest - q], mid + q + (ahead[q] if q < len(right) else 0)),  # at least q words right of the middle
                (mid - q - (back[q] if q < len(left) else 0), mid + ahead[len(right) + 1 + longest - q]),  # at least q words left of it
            ):
                if e - s < least or (s and words[s - 1] == words[s - 1 + q]) or (e < last and words[e] == words[e - q]):
                    continue
                if found.get((s, e), q) >= q:
                    found[s, e] = q
    return found


def runs_of(ids: np.ndarray, min_length: int = 6, min_exponent: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs among word numbers, by start, then period."""
    covered = np.concatenate([[False], repeated(ids, least_overlap(min_length, min_exponent)), [False]])
    borders = np.flatnonzero(covered[1:] != covered[:-1])
    out = []
    for a, b in zip(borders[::2].tolist(), borders[1::2].tolist()):
        if b - a >= min_length:
            out += [(a + s, e - s, q) for (s, e), q in segment_runs(ids[a:b].tolist(), min_length, min_exponent).items()]
    return sorted(out, key=lambda r: (r[0], r[2]))


def words_of(text: pa.Scalar) -> tuple[pa.Array, np.ndarray]:
    """A text's words (runs without ASCII white space), and for each the number of its kind."""
    words = pc.ascii_split_whitespace(pa.array([text.as_py()], pa.large_string())).flatten()
    words = words.filter(pc.not_equal(words, ""))
    return words, words.dictionary_encode().indices.to_numpy(zero_copy_only=False)


def _collapsed(words: pa.Array, runs: list[tuple[int, int, int]]) -> str:
    """The words that are in no run behind its first period."""
    if runs:
        steps = np.zeros(len(words) + 1, np.int64)
        for s, n, q in runs:
            steps[s + q] += 1
            steps[s + n] -= 1
        words = words.filter(pa.array(np.cumsum(steps[:-1]) == 0))
    return " ".join(words.to_pylist())


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text: str | Column = "text", min_length: int = 6, min_exponent: int = 4) -> DataFrame:
    """doc_id, runs (array of start, length, period; by start, then period) and collapsed (kept words joined by one space) for each row of ``docs``.

    Words are runs without ASCII white space, numbered from 0. A word goes if any
    run contains it after that run's first period. Null and empty texts and texts
    without words have no runs and an empty collapsed text. Null ids stay null,
    repeated rows each get their result, other columns are not looked at, no rows
    give none. No shuffle; a worker holds one text's words at a time, and very long
    texts count whole.
    """
    if min_exponent < 2 or min_length < 2:
        raise ValueError("runs have at least two periods and two words")
    prepare_workers(docs.sparkSession)
    picked = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in sliced(batches, 64):
            found, texts = [], []
            for t in batch.column("text"):
                words, ids = words_of(t)
                runs = runs_of(ids, min_length, min_exponent)
                found.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                texts.append(_collapsed(words, runs))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind), pa.array(texts, pa.string())], ["doc_id", "runs", "collapsed"])

    return picked.mapInArrow(work, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` whose texts have a periodic end in a tenth of the rows, drawn by h = crc32(id): if h % 10 = 0, word i >= a becomes word a + (i - a) % p, with g = h div 10, a = g % n and p = 1 + (n - a) div (3 + g % 8). Rows with a null id, or without words, stay as they are."""
    h, g = id_crc(id_col), F.floor(id_crc(id_col) / 10)

    def periodic(words: Column) -> Column:
        n = F.size(words)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        kept = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.element_at(words, (F.when(i < a, i).otherwise(a + (i - a) % p) + 1).cast("int")))
        return F.when(n > 0, F.array_join(kept, " "))

    # an array of one list of words, so that the text is cut once
    planted = F.transform(F.array(F.regexp_extract_all(F.col(text), F.lit(WORD), 0)), periodic)[0]
    return docs.withColumn(text, F.when(h % 10 == 0, F.coalesce(planted, F.col(text))).otherwise(F.col(text)))


def run_digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of greatest exact length / period (ties: smallest start, then period) and digests of all runs and of the collapsed text; found: result of ``periodic_runs``."""
    best = F.expr("aggregate(runs, runs[0], (b, r) -> if(r.length * b.period > b.length * r.period, r, b))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    return found.withColumn("_best", F.when(F.size("runs") > 0, best)).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_best.start").alias("start"), F.col("_best.length").alias("length"), F.col("_best.period").alias("period"),
        F.expr("1000 * _best.length div _best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
