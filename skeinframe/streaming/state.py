"""Stateful event operators, in batch and as Structured Streaming (survey T-01 to T-08)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rate_limited(events: DataFrame, key: str, at: str, order: str, most: int = 30, seconds: int = 600) -> DataFrame:
    """Adds ``allowed``: the first ``most`` calls of a window that opens with a key's first call after the last one's end. Refused calls count too."""
    schema = ", ".join(f"`{c}` {t}" for c, t in events.dtypes) + ", allowed boolean"
    length = pd.Timedelta(seconds=seconds)

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values([at, order])
        out, reset, n = [], None, 0
        for t in group[at]:
            if reset is None or reset < t:
                reset, n = t + length, 1
            else:
                n += 1
            out.append(n <= most)
        return group.assign(allowed=out)

    return events.groupBy(key).applyInPandas(walk, schema)


def rate_limited_stream(events: DataFrame, key: str, at: str, most: int = 30, seconds: int = 600, late: str = "10 minutes") -> DataFrame:
    """The same on a stream: (key, at, allowed) of each call, in event time.

    Calls wait in their key's state until the watermark (the latest time seen,
    less ``late``) has passed them, and are then judged in the order of their
    times, so a replay or calls out of order give what the batch gives; calls that
    come after the watermark are left out. A key's state goes once its window is
    over and nothing waits.
    """
    kinds = dict(events.dtypes)

    def walk(k, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        reset, n, held = state.get if state.exists else (-1, 0, [])
        held = sorted([*held, *(int(t) for b in batches for t in b["_us"])])
        mark = state.getCurrentWatermarkMs()
        ready = [t for t in held if t < mark * 1000]
        allowed = []
        for t in ready:
            if reset < t:
                reset, n = t + seconds * 1_000_000, 1
            else:
                n += 1
            allowed.append(n <= most)
        held = held[len(ready) :]
        wake = (held[0] if held else reset) // 1000 + 1
        if held or wake > mark:
            state.update((reset, n, held))
            state.setTimeoutTimestamp(max(wake, mark + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({key: [k[0]] * len(ready), "_us": pd.Series(ready, dtype="int64"), "allowed": pd.Series(allowed, dtype=bool)})

    timed = events.withWatermark(at, late).select(key, at, F.unix_micros(at).alias("_us"))
    judged = timed.groupBy(key).applyInPandasWithState(walk, f"`{key}` {kinds[key]}, _us long, allowed boolean", "reset long, n long, held array<bigint>", "append", "EventTimeTimeout")
    return judged.select(key, F.timestamp_micros("_us").alias(at), "allowed")


def without_repeats(events: DataFrame, key: str, value: str, order) -> DataFrame:
    """Events whose value differs from the key's event before."""
    w = Window.partitionBy(key).orderBy(*order)
    before, n = F.lag(value).over(w), F.row_number().over(w)
    return events.withColumns({"_b": before, "_n": n}).filter((F.col("_n") == 1) | ~F.col(value).eqNullSafe(F.col("_b"))).drop("_b", "_n")


def recent(events: DataFrame, key: str, item: str, at: str, order: str, most: int = 12) -> DataFrame:
    """Each key's last ``most`` distinct items, the latest first, with their place."""
    last = events.groupBy(key, item).agg(F.max(F.struct(at, order)).alias("m"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col("m").desc()))
    return last.withColumn("place", rank).filter(F.col("place") <= most).select(key, item, "place")


def latest(events: DataFrame, key: str, at: str, order: str) -> DataFrame:
    """The latest event a key; of one time the later arrival."""
    return events.groupBy(key).agg(F.max_by(F.struct(*[c for c in events.columns if c != key]), F.struct(at, order)).alias("r")).select(key, "r.*")


def windowed_counts(events: DataFrame, at: str, kind: str, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Counts by window and kind; on a stream, events later than ``late`` are left out."""
    return events.withWatermark(at, late).groupBy(F.window(at, window), kind).agg(F.count("*").alias("n")) if events.isStreaming else events.groupBy(F.window(at, window), kind).agg(F.count("*").alias("n"))
